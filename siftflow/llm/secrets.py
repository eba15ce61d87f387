"""Secret scanning with multipart credential linking, with DataFrame functions only.

Regular expressions find parts in each text: secrets that stand on their own (the base kinds), and weak
identifiers, secrets and endpoints that mean little alone. Running sums over a row's own matches give their
offsets; parts are then joined by interval within the row, by sweeping over their sorted ends: a weak part is
reported only if complementary parts that it doesn't overlap stand within ``SCOPE`` code points of it. All of
that happens inside a row, so nothing is exchanged and no pairs are written.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bind, running, table

#: Code points between the end of a part and the start of another that belongs to it.
SCOPE = 300
MASK = "[SECRET]"

#: Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"
HEX = r"[0-9a-f]{32,}+"
#: Patterns of the weak kinds.
WEAK_ACCESS = r"""(?i:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}+"""
WEAK_SECRET = r"[A-Za-z0-9+/]{20,}+={0,2}+"
ENDPOINT = r"""(?i:https?|wss?|s3|ftp|jdbc:[a-z]{2,12}|mongodb|amqps?|redis|postgres(?:ql)?|mysql)://[^\s"'<>]{3,}+"""

#: Kind, pattern, and which part of a credential it can be; the first three are the base kinds.
KINDS = (
    ("assign", ASSIGN, "secret"),
    ("access", ACCESS, "access"),
    ("hex", HEX, "secret"),
    ("weak_access", WEAK_ACCESS, "access"),
    ("weak_secret", WEAK_SECRET, "secret"),
    ("endpoint", ENDPOINT, "endpoint"),
)
BASE = 3
#: Which part owns a stretch of text that several kinds match: base kinds, then endpoints, identifiers, secrets.
RANKS = (0, 0, 0, 2, 3, 1)

#: Further tests of a match by kind: a value of 8 characters or more; letters and digits both.
TESTS = {
    0: lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8,
    4: lambda m: F.rlike(m, F.lit("[0-9]")) & F.rlike(m, F.lit("[A-Za-z]")),
}

_SPAN = "struct<start:int,k:int,end:int>"
_MISSING = 1 << 30


def _matches(text: Column, number: int, pattern: str) -> Column:
    """The spans of all leftmost non-overlapping matches of a pattern that pass the kind's further test."""
    passes = TESTS.get(number, lambda m: F.lit(True))
    found = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))
    found = F.transform(F.filter(found, lambda x: x["m"].isNotNull()), lambda x: F.struct(x["gap"].alias("gap"), F.length(x["m"]).alias("len"), passes(x["m"]).alias("ok")))
    placed = running(
        found,
        F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(False).alias("ok")),
        lambda s, x: F.struct((s["end"] + x["gap"]).alias("start"), (s["end"] + x["gap"] + x["len"]).alias("end"), x["ok"].alias("ok")),
        "struct<start:int,end:int,ok:boolean>",
    )
    spans = F.transform(F.filter(placed, lambda s: s["ok"]), lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("k"), s["end"].alias("end")))
    return F.when(F.rlike(text, F.lit(pattern)), spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _of(value: Column, table_: tuple) -> Column:
    """The entry of a fixed table at a kind's number."""
    return F.element_at(F.array(*(F.lit(x) for x in table_)), value + 1)


def _events(spans: Column, back: bool) -> Column:
    """Starts and ends of spans as ``(at, opens, span)`` in order; where they meet, spans that touch don't overlap."""
    side = lambda at, opens: F.transform(spans, lambda s: F.struct((-s[at] if back else s[at]).alias("at"), F.lit(opens).alias("opens"), s.alias("span")))
    # of equal places, the side that a sweep must have seen before the other one sorts first
    return F.array_sort(F.concat(side("start", -1 if back else 1), side("end", 0)))


def _sweep(spans: Column, zero: Column, step, element: str, back: bool, opens: bool) -> Column:  # noqa: ANN001
    """``(span, seen)`` by span: what ``step`` has gathered of earlier events when a span opens, or closes."""
    full = f"struct<span:{_SPAN},at_opening:boolean,seen:{element}>"
    no_span = F.lit(None).cast(_SPAN)
    states = running(
        _events(spans, back),
        F.struct(no_span.alias("span"), F.lit(False).alias("at_opening"), zero.alias("seen")),
        lambda s, x: F.struct(x["span"].alias("span"), (x["opens"] != 0).alias("at_opening"), step(s["seen"], x["span"], x["opens"] != 0).alias("seen")),
        full,
    )
    return F.array_sort(F.transform(F.filter(states, lambda s: s["at_opening"] if opens else ~s["at_opening"]), lambda s: F.struct(s["span"].alias("span"), s["seen"].alias("seen"))))


def _owned(spans: Column) -> Column:
    """Spans that overlap none of a rank before their own: those begun before a span's end, less those over by its start."""
    ranks = max(RANKS)
    element = "struct<" + ",".join(f"c{r}:int" for r in range(ranks)) + ">"
    zero = F.struct(*(F.lit(0).alias(f"c{r}") for r in range(ranks)))

    def counted(seen: Column, span: Column, opens: Column, of_opening: bool) -> Column:
        # c{r} counts spans of rank r or before, of which a span of the next rank must meet none
        mine = opens if of_opening else ~opens
        return F.struct(*((seen[f"c{r}"] + (mine & (_of(span["k"], RANKS) <= r)).cast("int")).alias(f"c{r}") for r in range(ranks)))

    begun = _sweep(spans, zero, lambda s, x, o: counted(s, x, o, True), element, back=False, opens=False)
    over = _sweep(spans, zero, lambda s, x, o: counted(s, x, o, False), element, back=False, opens=True)

    def meets(x: Column) -> Column:
        out = F.lit(False)
        for r in range(ranks):
            out = F.when(_of(x["span"]["k"], RANKS) == r + 1, x["n"][f"c{r}"] > 0).otherwise(out)
        return out

    less = lambda b, o: F.struct(b["span"].alias("span"), F.struct(*((b["seen"][f"c{r}"] - o["seen"][f"c{r}"]).alias(f"c{r}") for r in range(ranks))).alias("n"))
    return F.transform(F.filter(F.zip_with(begun, over, less), lambda x: ~meets(x)), lambda x: x["span"])


def _linked(spans: Column) -> Column:
    """Base spans, and weak ones whose complement is near; spans that overlap a part are no complement of it."""
    parts = ("access", "secret", "endpoint")
    kinds = tuple(x[2] for x in KINDS)
    element = "struct<" + ",".join(f"{p}:int" for p in parts) + ">"
    zero = F.struct(*(F.lit(-_MISSING).alias(p) for p in parts))

    def last(seen: Column, span: Column, counts: Column, at: Column) -> Column:
        return F.struct(*(F.when(counts & (_of(span["k"], kinds) == p), at).otherwise(seen[p]).alias(p) for p in parts))

    # going forward, the last end of each part when a span opens; going back, the first start when it closes
    before = _sweep(spans, zero, lambda s, x, o: last(s, x, ~o, x["end"]), element, back=False, opens=True)
    after = _sweep(spans, zero, lambda s, x, o: last(s, x, o, -x["start"]), element, back=True, opens=False)

    def near(b: Column, a: Column) -> Column:
        gaps = {p: F.least(b["span"]["start"] - b["seen"][p], -a["seen"][p] - a["span"]["end"]) <= SCOPE for p in parts}
        part = _of(b["span"]["k"], kinds)
        complete = F.when(part == "access", gaps["secret"]).when(part == "secret", gaps["access"] | gaps["endpoint"]).otherwise(gaps["access"] & gaps["secret"])
        return F.struct(b["span"].alias("span"), ((b["span"]["k"] < BASE) | complete).alias("ok"))

    return F.transform(F.filter(F.zip_with(before, after, near), lambda x: x["ok"]), lambda x: x["span"])


def with_spans(rows: DataFrame, text: Column) -> DataFrame:
    """``rows`` with ``spans`` of a text; see ``find_secrets``."""
    text = F.coalesce(text, F.lit(""))
    out = rows.withColumns({
        "spans": F.concat(*(_matches(text, k, KINDS[k][1]) for k in range(BASE))),
        "weak": F.concat(*(_matches(text, k, KINDS[k][1]) for k in range(BASE, len(KINDS)))),
    })
    # one part has no complement to look for
    alone = (F.size("weak") == 0) | (F.size("weak") + F.size("spans") < 2)
    linked = bind(_owned(F.concat("spans", "weak")), _linked)
    return out.withColumn("spans", F.array_sort(F.when(alone, F.col("spans")).otherwise(linked))).drop("weak")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, spans)``, one row per input row, in place: no row is moved.

    ``spans`` are ``(start, k, end)``, sorted: offsets in code points, end exclusive, ``k`` the number of the
    kind. Base spans are exactly the leftmost non-overlapping matches of their patterns that are long enough.
    A weak part that overlaps a base span, or a weak part that owns its text (endpoints before identifiers
    before secrets), is no part at all. Of the rest, an identifier counts if a secret is in its scope, a
    secret if an identifier or an endpoint is, and an endpoint if both an identifier and a secret are; the
    scope reaches ``SCOPE`` code points from the end of the earlier to the start of the later, and parts that
    overlap never complete each other. Null and empty texts have no spans; ids may be null or repeated, rows
    stay apart; an empty table gives none. Other columns are not read.
    """
    return with_spans(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), F.col("text")).select("doc_id", "spans")


def redact(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """``docs`` with every found span replaced by ``[SECRET]``, and ``count_col`` (if there is one) counted anew.

    No row is dropped or moved; columns, whatever their names, and their order stay as they are. Overlapping
    spans become one mask.
    """
    rows = with_spans(docs.select(F.struct("*").alias("doc")), F.col("doc")[text_col])
    text = F.col("doc")[text_col]
    reached = running(
        F.col("spans"),
        F.struct(F.lit(0).alias("start"), F.lit(0).alias("reach"), F.lit(0).alias("before")),
        lambda s, x: F.struct(x["start"].alias("start"), F.greatest(s["reach"], x["end"]).alias("reach"), s["reach"].alias("before")),
        "struct<start:int,reach:int,before:int>",
    )
    rows = rows.withColumn("reached", reached)
    shown = F.transform(
        "reached", lambda s: F.when((s["start"] >= s["before"]), F.concat(F.substring(text, s["before"] + 1, s["start"] - s["before"]), F.lit(MASK))).otherwise("")
    )
    tail = F.substring(text, F.element_at("reached", -1)["reach"] + 1, F.length(text))
    clean = F.when(F.size("spans") == 0, text).otherwise(F.concat(F.array_join(shown, ""), tail))
    rows = rows.select("doc", (F.size("spans") > 0).alias("found"), clean.alias("clean"))
    changed = {text_col: F.col("clean")}
    if count_col in docs.columns:
        old = F.col("doc")[count_col]
        changed[count_col] = F.when(F.col("found"), F.length("clean")).otherwise(old).cast(docs.schema[count_col].dataType)
    return rows.select(*(changed.get(c, F.col("doc")[c]).alias(c) for c in docs.columns))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    names = F.array(*(F.lit(x[0]) for x in KINDS))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["k"] == kind)).cast("long")

    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(joined(F.filter("spans", lambda s: s["k"] < BASE)).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


#: The query in DuckDB's SQL, written out by itself. Its patterns fold case by Unicode, so letters are spelled out;
#: a text's weak parts are compared with all its parts, pair by pair.
OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
p(k, part, rank, pattern) AS (VALUES
  (0, 'secret', 0, '([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'),
  (1, 'access', 0, 'AKIA[A-Z0-9]{12,}'),
  (2, 'secret', 0, '[0-9a-f]{32,}'),
  (3, 'access', 2, '(?:[aA][cC][cC][eE][sS][sS]_?[kK][eE][yY]_?[iI][dD]|[cC][lL][iI][eE][nN][tT]_?[iI][dD]|[aA][cC][cC][oO][uU][nN][tT]_?[iI][dD]|[uU][sS][eE][rR]_?[nN][aA][mM][eE]|[lL][oO][gG][iI][nN])["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9_.@-]{3,}'),
  (4, 'secret', 3, '[A-Za-z0-9+/]{20,}={0,2}'),
  (5, 'endpoint', 1, '(?:[hH][tT][tT][pP][sS]?|[wW][sS][sS]?|[sS]3|[fF][tT][pP]|[jJ][dD][bB][cC]:[a-zA-Z]{2,12}|[mM][oO][nN][gG][oO][dD][bB]|[aA][mM][qQ][pP][sS]?|[rR][eE][dD][iI][sS]|[pP][oO][sS][tT][gG][rR][eE][sS](?:[qQ][lL])?|[mM][yY][sS][qQ][lL])://[^\s"''<>]{3,}')),
hits AS (SELECT row, k, part, rank, regexp_extract_all(t, pattern) AS ms, string_split_regex(t, pattern) AS gaps, pattern FROM d, p),
each AS (SELECT row, k, part, rank, pattern, unnest(ms) AS m, unnest(gaps[:len(ms)]) AS gap, unnest(range(len(ms))) AS n FROM hits),
placed AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY row, k ORDER BY n) AS finish FROM each),
spans AS (SELECT row, k, part, rank, CAST(finish - length(m) AS BIGINT) AS start, CAST(finish AS BIGINT) AS finish FROM placed
  WHERE CASE k WHEN 0 THEN length(regexp_extract(m, pattern, 2)) >= 8 WHEN 4 THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') ELSE TRUE END),
parts AS (SELECT * FROM spans a WHERE NOT EXISTS (SELECT 1 FROM spans b WHERE b.row = a.row AND b.rank < a.rank AND b.start < a.finish AND b.finish > a.start)),
near AS (SELECT a.row, a.k, a.start, bool_or(b.part = 'access') AS has_access, bool_or(b.part = 'secret') AS has_secret, bool_or(b.part = 'endpoint') AS has_endpoint
  FROM parts a JOIN parts b ON a.row = b.row AND (b.start - a.finish BETWEEN 0 AND 300 OR a.start - b.finish BETWEEN 0 AND 300) WHERE a.k >= 3 GROUP BY ALL),
kept AS (SELECT s.row, s.k, s.start, ['assign', 'access', 'hex', 'weak_access', 'weak_secret', 'endpoint'][s.k + 1] || ':' || s.start || ':' || s.finish AS shown
  FROM parts s LEFT JOIN near n ON n.row = s.row AND n.k = s.k AND n.start = s.start
  WHERE CASE s.part WHEN 'access' THEN s.k < 3 OR has_secret WHEN 'secret' THEN s.k < 3 OR has_access OR has_endpoint ELSE has_access AND has_secret END),
found AS (SELECT row, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2,
    string_agg(shown, ',' ORDER BY start, k) FILTER (k < 3) AS base, string_agg(shown, ',' ORDER BY start, k) AS shown FROM kept GROUP BY row)
SELECT doc_id, coalesce(n0, 0)::BIGINT AS n_assign, coalesce(n1, 0)::BIGINT AS n_access, coalesce(n2, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(shown, '') AS spans
FROM d LEFT JOIN found ON found.row = d.row
"""
