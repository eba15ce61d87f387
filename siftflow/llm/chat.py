"""Chat formatting: fold event logs into final messages, then render them with a reversible template.

DataFrame functions only. Logs are dealt out by conversation and message, sorted by sequence number, folded
(streamed deltas append, edits replace, regenerations replace and discard what came after), rendered message
by message, and joined to conversations through blocks of turns, so that a conversation with very many rows
is put together from a few long strings.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import running, table

#: Turns that are joined to one string before a conversation's rows meet.
BLOCK = 64
#: The place of events without a number.
_LAST = (1 << 63) - 1
#: Turns whose events can be numbered, events between two turns, and between two messages of a turn.
_NUMBERED, _TURN, _PART = 1 << 30, 1 << 32, 8


@dataclass(frozen=True)
class Template:
    """Markers around each turn, and the control strings that texts must not hold unescaped."""

    start: str = "<|im_start|>"
    sep: str = "\n"
    end: str = "<|im_end|>\n"
    control: tuple[str, ...] = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<|endoftext|>")

    @property
    def _first(self) -> str:
        return "([" + "".join(sorted({re.escape(c[0]) for c in self.control})) + "])"

    @property
    def _rest(self) -> str:
        return "(" + "|".join(re.escape(c[1:]) for c in self.control) + ")"

    def escape(self, text: Column) -> Column:
        """One backslash goes in after the first character of every control string, escaped or not."""
        return F.regexp_replace(text, rf"{self._first}(\\*){self._rest}", r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"{self._first}\\(\\*){self._rest}", "$1$2$3")

    def escape_role(self, role: Column) -> Column:
        return self.escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))

    def unescape_role(self, role: Column) -> Column:
        return F.replace(F.replace(self.unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def _block(turn: Column) -> Column:
    return F.floor(turn / BLOCK)


def _cuts(events: DataFrame) -> DataFrame:
    """``(conv_id, turn, part, cut)``: the last regeneration of an earlier message of the conversation, if there is one.

    Running maxima, without texts: within blocks of turns, and over the blocks of a conversation.
    """
    again = F.max(F.when(F.col("kind") == "regenerate", F.col("seq")))
    messages = events.groupBy("conv_id", "turn", "part").agg(again.alias("again")).withColumn("block", _block(F.col("turn")))
    earlier = Window.partitionBy("conv_id", "block").orderBy("turn", "part").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = messages.groupBy("conv_id", "block").agg(F.max("again").alias("again")).withColumn("floor", F.max("again").over(before)).where("floor is not null")
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), "floor")
    met = messages.withColumn("inner", F.max("again").over(earlier)).join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")), "left")
    return met.select("conv_id", "turn", "part", F.greatest("inner", "floor").alias("cut")).where("cut is not null")


def fold(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, turn, part, role, text)`` of an event log.

    ``events`` has ``conv_id``, ``seq`` (order of events), ``turn`` and ``part`` (which message, and its
    place), ``role``, ``kind`` and ``text``. ``delta`` appends its text to the message; ``edit`` replaces what
    the message held; ``regenerate`` does too and discards all events of later messages that came before it.
    All of that goes by one total order of a conversation's events: ``seq`` (null: after all others), then
    turn and part (nulls first), kind, text and role. So of an edit and a delta with one number the edit
    stays, and of two edits the one with the greater text. Unknown and null kinds count as ``delta``; null
    texts and roles as empty. A message's role is that of its last event. Messages whose events are all
    discarded vanish. Null ids, turns and parts are keys like any other. Other columns are not read.
    """
    key = ["conv_id", "turn", "part"]
    empty = F.lit("")
    e = events.select(
        *key, F.coalesce("seq", F.lit(_LAST)).alias("seq"), F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("text", empty).alias("text"), F.coalesce("role", empty).alias("role")
    )
    messages = e.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("seq", "kind", "text", "role"))).alias("log"))
    cuts = _cuts(e).toDF("c", "t", "p", "cut")
    met = messages.join(cuts, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & F.col("part").eqNullSafe(F.col("p")), "left")
    # what comes before the last edit or regeneration of the message is gone
    reset = F.array_max(F.transform("log", lambda x, i: F.when(x["kind"].isin("edit", "regenerate"), i).otherwise(0)))
    live = F.slice("log", reset + 1, F.size("log"))
    live = F.filter(live, lambda x: F.col("cut").isNull() | (x["seq"] >= F.col("cut")))
    return (
        met.select(*key, live.alias("live"))
        .where(F.size("live") > 0)
        .select(*key, F.element_at("live", -1)["role"].alias("role"), F.array_join(F.transform("live", lambda x: x["text"]), "").alias("text"))
    )


def render(messages: DataFrame, template: Template = Template(), learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``(conv_id, formatted, loss_runs)``, one row per conversation.

    ``loss_runs`` is the loss mask as one ``(skip, take)`` pair of code-point counts per turn: ``skip``
    characters without loss, then ``take`` characters (an assistant's text, escaped) with it; what follows
    the last pair has none. Messages sort by turn, part, role and text, nulls first, repeated ones stay.
    """
    text = template.escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(template.start), template.escape_role(F.coalesce("role", F.lit(""))), F.lit(template.sep))
    m = messages.select("conv_id", "turn", "part", head.alias("head"), text.alias("body"), F.coalesce("role", F.lit("")).isin(*learn).alias("learn"))
    one = F.struct(
        "turn",
        "part",
        F.concat("head", "body", F.lit(template.end)).alias("shown"),
        F.when(F.col("learn"), F.length("head")).otherwise(F.length(F.concat("head", "body"))).alias("skip"),
        F.when(F.col("learn"), F.length("body")).otherwise(0).alias("take"),
    )
    blocks = m.groupBy("conv_id", _block(F.col("turn")).alias("block")).agg(F.array_sort(F.collect_list(one)).alias("t"))
    shown = blocks.select(
        "conv_id",
        F.struct("block", F.array_join(F.transform("t", lambda x: x["shown"]), "").alias("shown"), F.transform("t", lambda x: F.struct(x["skip"], x["take"])).alias("runs")).alias("b"),
    )
    whole = shown.groupBy("conv_id").agg(F.array_sort(F.collect_list("b")).alias("b"))
    end = len(template.end)
    runs = F.flatten(F.transform("b", lambda x: x["runs"]))
    # from the second turn on, the end mark of the turn before is skipped too
    runs = F.transform(runs, lambda r, i: F.struct((r["skip"] + F.when(i > 0, end).otherwise(0)).alias("skip"), r["take"].alias("take")))
    return whole.select("conv_id", F.array_join(F.transform("b", lambda x: x["shown"]), "").alias("formatted"), runs.alias("loss_runs"))


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """``(conv_id, turns array<struct<role, text, learned>>, formatted_chars)``, parsed from the output alone.

    ``learned`` is what lies under the loss mask, unescaped: the mask's own offsets from the beginning of the
    output say where, in which turn's piece of it.
    """
    pieces = F.split("formatted", re.escape(template.end))
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    n, sep, end = len(template.start), template.sep, len(template.end)
    both = F.zip_with(pieces, "loss_runs", lambda p, r: F.struct(F.length(p).alias("long"), r["skip"].alias("skip"), r["take"].alias("take")))
    places = running(
        both,
        F.struct(F.lit(0).alias("next"), F.lit(0).alias("upto"), F.lit(0).alias("begin"), F.lit(0).alias("take")),
        lambda s, x: F.struct(
            (s["next"] + x["long"] + end).alias("next"), (s["upto"] + x["skip"] + x["take"]).alias("upto"), (s["upto"] + x["skip"] - s["next"]).alias("begin"), x["take"].alias("take")
        ),
        "struct<next:int,upto:int,begin:int,take:int>",
    )
    body = lambda p: F.substring(p, F.instr(p, sep) + len(sep), F.length(p))
    turns = F.zip_with(
        "pieces",
        "places",
        lambda p, m: F.struct(
            template.unescape_role(F.substring(p, F.lit(n + 1), F.instr(p, sep) - F.lit(n + 1))).alias("role"),
            template.unescape(body(p)).alias("text"),
            template.unescape(F.substring(p, m["begin"] + 1, m["take"])).alias("learned"),
        ),
    )
    cut = formatted.select("conv_id", pieces.alias("pieces"), places.alias("places"), F.length("formatted").cast("long").alias("formatted_chars"))
    return cut.select("conv_id", turns.alias("turns"), "formatted_chars")


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Rows by turn as events: each row is a message of its own, also where rows share a turn."""
    w = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.row_number().over(w).cast("long").alias("part"), F.col("turn").cast("long").alias("seq"), "role", F.lit("delta").alias("kind"), "text")


def streamed(events: DataFrame) -> DataFrame:
    """The log that streaming such messages leaves, one delta each: it folds to the same messages.

    A message is first a draft. An assistant's draft is answered by a message of its own, and regenerated,
    which discards that answer; other drafts are edited. That gives the first half of the text, and a delta
    adds the rest. Messages without a turn, or with one too far out to be numbered, stay as they are.
    """
    text, assistant = F.coalesce("text", F.lit("")), F.coalesce(F.col("role") == "assistant", F.lit(False))
    half = F.floor(F.length(text) / 2).cast("int")
    fits = F.coalesce(F.abs("turn") < _NUMBERED, F.lit(False))
    place = F.when(fits, F.col("turn")).otherwise(0) * F.lit(_TURN) + F.col("part") * _PART

    def event(step: int, kind: Column | str, said: Column, later: int = 0, role: Column | None = None) -> Column:
        return F.struct((F.col("part") + F.lit(later)).alias("part"), (place + step).alias("seq"), (F.col("role") if role is None else role).alias("role"), (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), said.alias("text"))

    log = F.array(
        event(0, "delta", F.lit("draft")),
        event(2, F.when(assistant, "regenerate").otherwise("edit"), F.substring(text, F.lit(1), half)),
        event(3, "delta", F.substring(text, half + 1, F.length(text))),
    )
    answer = F.array(event(1, "delta", F.lit("an answer to the draft"), later=1 << 40, role=F.lit("user")))
    far = F.when(F.col("turn") > 0, F.lit(_LAST)).otherwise(F.lit(-_LAST))
    plain = F.array(F.struct("part", far.alias("seq"), "role", F.lit("delta").alias("kind"), text.alias("text")))
    return events.select("conv_id", "turn", F.inline(F.when(~fits, plain).when(assistant, F.concat(log, answer)).otherwise(log)))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    read = read_back(render(fold(streamed(conversation_events(rows.unionByName(extra))))))
    learned = F.array_join(F.transform("turns", lambda t: t["learned"]), "")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    read = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), said.alias("said"), learned.alias("learned"), "formatted_chars")
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2(F.col("said").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), shown AS (
  SELECT *, regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'),
      '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|s>|/s>|INST\]|/INST\]|\|endoftext\|>)', '\1\\\2\3', 'g') AS r,
    regexp_replace(text, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|s>|/s>|INST\]|/INST\]|\|endoftext\|>)', '\1\\\2\3', 'g') AS t
  FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(r) + 1 + length(t) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM shown GROUP BY conv_id
"""
