import random

import xxhash

from siftflow.llm import graph, simhash


def brute(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def components(fps):
    up = {x: x for x in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 2:
                up[find(a)] = find(b)
    return {x: find(x) for x in fps}


def test_fingerprints():
    rng = random.Random(2)
    alphabet = ["The", "the", "É", "é", "x", " ", "  ", "\n", "\t", " ", "日本", "A\x0bB", "a\x1cb"]
    for _ in range(300):
        text = " ".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30)))
        assert simhash.simhash(text) & (1 << 64) - 1 == brute(text)
    assert simhash.simhash(None) == simhash.simhash("") == simhash.simhash(" \n") == 0


def test_long_text():
    words = [str(i % 977) for i in range(70_000)]
    assert simhash.simhash(" ".join(words)) & (1 << 64) - 1 == brute(" ".join(words))


def family(rng, n):
    """Fingerprints in clusters: steps of one to three bits, and far ones."""
    out = {0}
    while len(out) < n:
        x = rng.choice(sorted(out)) if rng.random() < 0.8 else rng.getrandbits(64)
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_links_by_either_way(spark):
    fps = family(random.Random(3), 300)
    want = components(fps)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for cap in (1, 5, 1000):
        links = simhash.linked_fingerprints(df, bucket_cap=cap).collect()
        mask = (1 << 64) - 1
        assert all(((r.a ^ r.b) & mask).bit_count() <= 2 for r in links)
        got = {r.node & mask: r.root for r in graph.connected_components(simhash.linked_fingerprints(df, bucket_cap=cap)).collect()}
        groups = {}
        for x in fps:
            groups.setdefault(want[x], set()).add(got.get(x, signed(x)))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_hot_family_is_not_paired_off(spark):
    base = [1 << i | 1 << j for i in range(40) for j in range(i)]
    df = spark.createDataFrame([(signed(x),) for x in base], "fp long")
    assert simhash.linked_fingerprints(df, bucket_cap=8).count() < 65 * len(base)
    assert graph.connected_components(simhash.linked_fingerprints(df, bucket_cap=8)).select("root").distinct().count() == 1


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(100)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    noise = [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(90)] + [(7, 7), (None, 1), (1, 0), (1, 0)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in chain + star + noise:
        if a is not None and a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(chain + star + noise, "a long, b long")).collect()}
    assert got == {x: min(y for y in up if find(y) == find(x)) for x in up}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_of_components_join_once(spark, tmp_path):
    """A round joins its edges to their minima once for each star, and a forest of stars is settled."""
    rng = random.Random(6)
    spark.createDataFrame([(i, rng.randrange(i)) for i in range(1, 300) for _ in range(3)], "u long, v long").distinct().write.parquet(str(tmp_path / "edges"))
    out = graph._small_star(graph._large_star(spark.read.parquet(str(tmp_path / "edges"))))
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert sum("Join [" in line for line in plan.splitlines()) == 2
    comp = graph.connected_components(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "a long, b long"))
    assert sorted(map(tuple, graph.forest(comp).collect())) == [(2, 1), (3, 1), (8, 7)]


def test_near_duplicates(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(400))
    rows = [(5, long, "a"), (3, long.upper(), "b"), (9, long + " tail", "c"), (7, "", "d"), (8, None, "e"), (2, "other words entirely here", "f"), (2, "other words entirely here", "f"), (None, "no id at all", "g"), (None, long, "h"), (4, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    fps = {r.doc_id: r.fingerprint & (1 << 64) - 1 for r in got if r.doc_id is not None}
    comp = components(sorted({brute(t) for _, t, _ in rows}))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[comp[brute(t)]] = min(i, least.get(comp[brute(t)], i))
    assert sorted(((r.doc_id or -1), r.component_id or -1) for r in got) == sorted((i or -1, least.get(comp[brute(t)], -1)) for i, t, _ in rows)
    assert all(fps[i] == brute(t) for i, t, _ in rows if i is not None)
    kept = simhash.deduplicate(df).collect()
    assert sorted(r.doc_id or -1 for r in kept) == sorted({least.get(comp[brute(t)], -1) for _, t, _ in rows})
    assert simhash.deduplicate(df).columns == df.columns
    assert simhash.near_duplicates(df.limit(0)).count() == simhash.deduplicate(df.limit(0)).count() == 0
    df.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    q = simhash.op5_simhash_neardup(spark, str(tmp_path)).collect()
    assert {r.fingerprint for r in q} == {f"{brute(t):016x}" for _, t, _ in rows}
