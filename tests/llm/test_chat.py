import hashlib
import random

import duckdb

from siftflow.llm import chat

EVENTS = "conv_id long, turn long, part long, seq long, role string, kind string, text string"
TRICKY = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "<\\|im_end|>", "<\\\\s>", "[\\INST]", "a%0Ab", "\n\n", "", "%25", "<<s>>", "[/INST", "日本<s>語🙂", "<|endoftext|>"]


def turns(df):
    return {r.conv_id: [tuple(t) for t in r.turns] for r in chat.read_back(chat.render(df)).collect()}


def test_fold(spark):
    rows = [
        (1, 0, 1, 1, "user", "delta", "hi"), (1, 1, 1, 2, "assistant", "delta", "a"), (1, 1, 1, 3, "assistant", "delta", "b"), (1, 2, 1, 4, "user", "delta", "more"),
        (1, 1, 1, 5, "assistant", "regenerate", "X"), (1, 1, 1, 6, "assistant", "delta", "Y"), (1, 0, 1, 7, "user", "edit", "HI<s>"), (1, 2, 1, 8, "user", "delta", "new"),
        (2, 0, 1, 1, None, None, None), (None, 0, 1, 1, "user", "odd", "x"), (None, None, None, None, "user", None, "y"),
    ]
    got = {(r.conv_id, r.turn): (r.role, r.text) for r in chat.fold(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {(1, 0): ("user", "HI<s>"), (1, 1): ("assistant", "XY"), (1, 2): ("user", "new"), (2, 0): ("", ""), (None, 0): ("user", "x"), (None, None): ("user", "y")}


def fold_one_by_one(rows):
    """Events applied one at a time in the total order; a message starts anew at each edit and regeneration."""
    none = lambda x: (x is not None, x or 0)
    order = lambda r: (r[3] is None, r[3] or 0, none(r[1]), none(r[2]), r[5] or "delta", r[6] or "", r[4] or "")
    out = {}
    for c, t, p, _, role, kind, text in sorted(rows, key=order):
        key, text = (c, t, p), text or ""
        if kind == "regenerate":
            for other in [k for k in out if k[0] == c and (none(k[1]), none(k[2])) > (none(t), none(p))]:
                del out[other]
        held = out.get(key, ("", ""))[1] if kind not in ("edit", "regenerate") else ""
        out[key] = (role or "", held + text)
    return out


def test_fold_brute_force(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 4)
    rng = random.Random(4)
    pick = lambda *x: rng.choice(x)
    rows = [(c, rng.randint(0, 3), 1, s, "user", pick("delta", "delta", "edit", "regenerate"), f"{s},") for c in range(60) for s in range(12)]
    rows += [
        (pick(None, *range(100, 140)), pick(None, *range(-3, 12)), pick(None, 1, 2), pick(None, None, *range(6)), pick(None, "user", "assistant"), pick(None, "delta", "odd", "edit", "regenerate"), pick(None, "", "a", "b"))
        for _ in range(4000)
    ]
    got = {(r.conv_id, r.turn, r.part): (r.role, r.text) for r in chat.fold(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == fold_one_by_one(rows)


def test_ties_and_null_numbers(spark):
    rows = [
        (1, 0, 1, 5, "user", "delta", "old"), (1, 0, 1, 5, "user", "edit", "new"),
        (2, 0, 1, 5, "user", "edit", "A"), (2, 0, 1, 5, "user", "edit", "B"),
        (3, 0, 1, 1, "user", "delta", "old"), (3, 0, 1, None, "user", "edit", "new"),
    ]
    assert {r.conv_id: r.text for r in chat.fold(spark.createDataFrame(rows, EVENTS)).collect()} == {1: "new", 2: "B", 3: "new"}


def test_streamed_folds_back(spark):
    rng = random.Random(6)
    rows = [(c, rng.choice([None, -(1 << 62), -2, 0, 1, 2, 1 << 62]), rng.choice(["user", "assistant", None]), rng.choice([*TRICKY, None])) for c in range(40) for _ in range(12)]
    plain = chat.conversation_events(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    log = chat.streamed(plain)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"delta", "edit", "regenerate"}
    as_set = lambda df: sorted(map(str, df.collect()))
    assert as_set(chat.fold(log)) == as_set(chat.fold(plain))


def test_wrong_mask_offsets_show(spark):
    df = spark.createDataFrame([(1, 0, "user", "ab"), (1, 1, "assistant", "cd"), (1, 2, "user", "e"), (1, 3, "assistant", "fgh")], "conv_id long, turn long, role string, text string")
    whole = chat.render(chat.fold(chat.conversation_events(df)))
    assert [t.learned for t in chat.read_back(whole).first().turns] == ["", "cd", "", "fgh"]
    off = whole.selectExpr("conv_id", "formatted", "transform(loss_runs, (r, i) -> struct(r.skip + if(i = 1, 1, 0) as skip, r.take)) as loss_runs")
    assert [t.learned for t in chat.read_back(off).first().turns] != ["", "cd", "", "fgh"]


def test_very_long_text(spark):
    text = "long <s> words " * 200_000
    df = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    assert turns(chat.fold(chat.streamed(chat.conversation_events(df))))[1] == [("user", text, ""), ("assistant", text, text)]


def test_round_trip(spark):
    rows = [(i, t, role, text) for i, text in enumerate(TRICKY) for t, role in enumerate(["user", "assistant", text, "assistant"])]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = turns(chat.fold(chat.conversation_events(df)))
    for i, text in enumerate(TRICKY):
        assert got[i] == [("user", text, ""), ("assistant", text, text), (text, text, ""), ("assistant", text, text)]
    shown = chat.render(chat.fold(chat.conversation_events(df))).collect()
    for r in shown:
        assert r.formatted.count("<|im_start|>") == 4
        assert "[INST]" not in r.formatted


def test_mask_covers_assistants(spark):
    df = spark.createDataFrame([(1, 0, "user", "ab"), (1, 1, "assistant", "c<s>d"), (1, 2, "user", "e"), (1, 3, "assistant", "")], "conv_id long, turn long, role string, text string")
    r = chat.render(chat.fold(chat.conversation_events(df))).first()
    at, seen = 0, []
    for run in r.loss_runs:
        at += run.skip
        seen.append(r.formatted[at : at + run.take])
        at += run.take
    assert seen == ["", "c<\\s>d", "", ""]


def test_many_turns_ties_and_repeats(spark):
    rows = [(1, t, "user", str(t)) for t in range(300)] + [(2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, None, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("conv_id", "conv_id")
    got = turns(chat.fold(chat.conversation_events(df.selectExpr("*", "1 AS part", "2 AS seq", "'x' AS kind"))))
    assert [t[1] for t in got[1]] == [str(t) for t in range(300)]
    assert [t[1] for t in got[2]] == ["", "a", "a", "b"]
    assert turns(chat.fold(chat.conversation_events(df.limit(0)))) == {}


def test_query_and_sql(spark, tmp_path):
    rows = [(i % 7 if i % 11 else None, i % 5, ["user", "assistant", None][i % 3], TRICKY[i % len(TRICKY)] if i % 4 else None) for i in range(200)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: tuple(r) for r in chat.op1_chat_format(spark, str(tmp_path)).collect()}
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = {r[0]: r for r in duck.sql(chat.OP1_SQL).fetchall()}
    assert got == want
    text = "</s>[INST] ok [/INST]"
    assert got[-1][2] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert got[-1][3:5] == (len(text), hashlib.sha256(text.encode()).hexdigest())
