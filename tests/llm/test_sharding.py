import math
import random
from collections import Counter

from gleaner.llm import sharding
from gleaner.llm.common import seeded
from gleaner.llm.sharding import _first, assign_shards, deal, holders, links, sharded_documents

SCHEMA = "doc_id long, text string"


def test_linked_documents_meet_and_sizes_stay_even(spark):
    rows = [(g * 10 + k, " ".join(f"w{g}_{i}" for i in range(40 + k))) for g in range(30) for k in range(10)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r["doc_id"]: r["shard"] for r in assign_shards(docs, 4, 0.1, 8).collect()}
    assert sorted(got) == [i for i, _ in rows]
    assert max(Counter(got.values()).values()) <= math.ceil(300 * 1.1 / 4) + 1
    edges = [(r["a"], r["b"], r["weight"]) for r in links(docs).collect()]
    assert all(a // 10 == b // 10 for a, b, _ in edges) and len(edges) >= 2 * 270 * 0.9
    before = {r["doc"]: r["shard"] for r in deal(docs, 4, 300).collect()}
    assert max(Counter(before.values()).values()) - min(Counter(before.values()).values()) <= 1
    cut = lambda s: sum(w for a, b, w in edges if s[a] != s[b])
    assert cut(got) < 0.45 * cut(before)


def test_defined_results(spark):
    rows = [(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f"), (None, "a b"), (5, "x " * 100_000)]
    docs = spark.createDataFrame([(i, t, "s", 9) for i, t in rows], SCHEMA + ", shard string, doc int")
    got = sorted(tuple(r) for r in assign_shards(docs, 2).collect())
    assert [i for i, _ in got] == [1, 2, 3, 4, 5] and {s for _, s in got} <= {0, 1}
    full = sharded_documents(docs, 2)
    assert full.columns == docs.columns and full.count() == len(rows) and dict(full.dtypes)["shard"] == "int"
    assert len({r["shard"] for r in full.filter("doc_id = 3").collect()}) == 1 and full.filter("shard is null").count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert assign_shards(empty).collect() == sharded_documents(empty).collect() == []


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y", "z", 2)], SCHEMA + ", shard_key string, shard_label string, _shard string, SHARD int")
    full = sharded_documents(docs, 2)
    assert [c.lower() for c in full.columns] == [c.lower() for c in docs.columns]
    assert tuple(full.first())[2:5] == ("x", "y", "z")


def test_documents_that_share_a_passage_are_linked(spark):
    """Against brute force over all pairs: every pair with 50 words in a row in common has a hash in common, in texts of any length."""
    rng = random.Random(5)
    passages = [[f"p{g}_{i}" for i in range(60)] for g in range(6)]
    texts = []
    for i in range(40):
        words = [f"d{i}_{k}" for k in range(rng.choice((10, 400, 3000)))]
        at = rng.randrange(len(words))
        texts.append(words[:at] + passages[i % 6] + words[at:])
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], SCHEMA).repartition(3)
    held = {}
    for r in holders(docs).collect():
        held.setdefault(r["hash"], set()).add(r["doc"])
    linked = {(a, b) for ids in held.values() for a in ids for b in ids if a < b}
    assert linked == {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 6 == b % 6}


def test_first_wishes_equal_a_sort(spark):
    rng = random.Random(6)
    rows = [(d, rng.randrange(2), rng.randrange(2), rng.choice((1, 2, 15, 16, 40, 1000))) for d in range(2000)]
    quota = {(0, 0): 0, (0, 1): 100, (1, 0): 300, (1, 1): 10_000}
    wishes = spark.createDataFrame([(*r, quota[r[1:3]]) for r in rows], "doc long, i int, j int, gain long, quota long")
    chance = {r["doc"]: r["c"] for r in wishes.select("doc", seeded(wishes["doc"]).alias("c")).collect()}
    step = lambda g: g if g < 16 else 16 + math.floor(4 * math.log2(g))
    want = set()
    for (i, j), n in quota.items():
        want |= {r[0] for r in sorted((r for r in rows if r[1:3] == (i, j)), key=lambda r: (-step(r[3]), chance[r[0]]))[:n]}
    assert {r["doc"] for r in _first(wishes).collect()} == want


def test_a_large_group_meets(spark):
    rows = [(i, " ".join(f"copied {k}" for k in range(40)) if i % 4 == 0 else " ".join(f"own {i} {k}" for k in range(10))) for i in range(400)]
    got = {r["doc_id"]: r["shard"] for r in assign_shards(spark.createDataFrame(rows, SCHEMA).repartition(3), 4, 1.0).collect()}
    assert len(got) == 400 and max(Counter(got.values()).values()) <= 201
    assert max(Counter(got[i] for i in range(0, 400, 4)).values()) >= 90


def test_rounds_read_one_row_for_each_document_and_set_of_holders(spark, monkeypatch):
    """Brute force over the hashes: as many links as before between any two documents, from fewer rows."""
    passages = [" ".join(f"p{g}_{k}" for k in range(300)) for g in range(3)]
    rows = [(i, f"{passages[i % 3]} own {i} " + (passages[(i + 1) % 3] if i % 4 == 0 else "")) for i in range(24)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    made, write = {}, sharding.materialise
    monkeypatch.setattr(sharding, "materialise", lambda df, name: made.setdefault(name, write(df, name)))
    assert assign_shards(docs, 4, rounds=0).count() == 24
    by = {}
    for r in made["holders"].collect():
        by.setdefault(r["hash"], set()).add(r["doc"])
    want = Counter(frozenset(v) for v in by.values())
    read = [df for name, df in made.items() if name not in ("anchors", "shards")][-1].collect()
    got, weight = {}, {}
    for r in read:
        got.setdefault(r["hash"], set()).add(r["doc"])
        weight[r["hash"]] = r.asDict().get("weight", 1)
    assert len(read) == sum(map(len, want)) < sum(map(len, by.values())) / 2
    assert {frozenset(v): weight[h] for h, v in got.items()} == want
