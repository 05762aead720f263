import random
from collections import Counter

import pytest
from gleaner.llm import mixing
from gleaner.llm.mixing import fit, mix_sources, mixed_documents
from gleaner.llm.token_lengths import lengths

SCHEMA = "doc_id long, text string, source string"


def best_sum(counts, budget):
    """The largest sum not over the budget, by a set of all sums."""
    sums = {0}
    for n, c in counts.items():
        for _ in range(c):
            sums |= {s + n for s in sums if s + n <= budget}
    return max(sums)


def test_fit_keeps_to_counts_and_budget_and_can_not_be_improved():
    rng = random.Random(3)
    exact = 0
    for _ in range(200):
        counts = {rng.randint(0, 60): rng.randint(1, 6) for _ in range(rng.randint(1, 12))}
        budget = rng.randint(0, sum(n * c for n, c in counts.items()) + 5)
        take = fit(counts, budget)
        used = sum(n * c for n, c in take.items())
        assert all(0 <= c <= counts[n] for n, c in take.items()) and used <= budget
        assert take.get(0, 0) == counts.get(0, 0)
        left = {n: c - take.get(n, 0) for n, c in counts.items()}
        assert best_sum({n: c for n, c in left.items() if n}, budget - used) == 0
        exact += used == best_sum(counts, budget)
    assert exact > 150


def test_all_lengths_keep_their_share():
    counts = {n: 1 for n in range(1, 2001)}
    take = fit(counts, sum(counts) // 2)
    assert 950 < sum(take.values()) < 1050 and 450 < sum(c for n, c in take.items() if n <= 1000) < 550


@pytest.mark.parametrize("ranked", [100_000, 4])
def test_query_meets_weights_and_equals_counting_by_hand(spark, monkeypatch, ranked):
    monkeypatch.setattr(mixing, "RANKED", ranked)
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "x", "1234", "é"], k=rng.randint(0, 30))), rng.choice("aabc")) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    of = lengths()
    token = {i: of(t) for i, t, _ in rows}
    total = sum(token.values())
    got = mix_sources(docs, {"a": 3, "b": 1}, total=total // 3).collect()
    assert all(r["n_tokens"] == token[r["doc_id"]] and r["source"] == rows[r["doc_id"]][2] for r in got)
    sums = Counter()
    for r in got:
        sums[r["source"]] += r["n_tokens"]
    for source, weight in (("a", 3), ("b", 1)):
        own = Counter(token[i] for i, _, s in rows if s == source)
        budget = int(total // 3 * weight / 4)
        assert sums[source] == best_sum(own, budget)
    assert set(sums) == {"a", "b"}
    again = mix_sources(docs.repartition(5), {"a": 3, "b": 1}, total=total // 3).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in again)


def test_defined_results(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (4, "one two three", "a"), (4, "one two three", "a"), (None, "word", "b"), (5, "x " * 50_000, "b")]
    docs = spark.createDataFrame([(*r, 0, "q") for r in rows], SCHEMA + ", n_tokens int, _rank string")
    everything = mixed_documents(docs, weights={"a": 1, "b": 1, None: 1}, total=10**9)
    assert everything.columns == docs.columns and everything.count() == len(rows)
    assert sorted(r["doc_id"] for r in mixed_documents(docs, weights={"a": 1}, total=0).collect()) == [1, 2]
    both = mixed_documents(docs, weights={"a": 1}, total=6).filter("doc_id = 4").count()
    assert both == 2 and mixed_documents(docs, weights={"a": 1}, total=5).filter("doc_id = 4").count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert mix_sources(empty).collect() == mixed_documents(empty).collect() == []
