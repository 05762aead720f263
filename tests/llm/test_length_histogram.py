import random

from gleaner.llm.length_histogram import length_histogram, quantile, truncated_total
from gleaner.llm.token_lengths import lengths

SCHEMA = "doc_id long, text string"


def test_equals_counting_one_by_one(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["alpha", "beta", "Gänse", "12", "?!"], k=rng.randint(0, 12))) for _ in range(300)]
    texts += [None, "", "x " * 100_000, texts[0], texts[0]]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], SCHEMA + ", n_tokens int").repartition(4)
    of = lengths()
    n = [of(t) for t in texts]
    histogram = length_histogram(docs)
    rows = histogram.collect()
    assert sorted(r["n_tokens"] for r in rows) == sorted(set(n))
    for r in rows:
        at = r["n_tokens"]
        assert r["documents"] == n.count(at) and r["tokens"] == at * n.count(at)
        assert r["documents_at_least"] == sum(x >= at for x in n) and r["tokens_at_least"] == sum(x for x in n if x >= at)
        assert r["truncated_tokens"] == sum(min(x, at) for x in n) == truncated_total(histogram, at)
        assert abs(r["share_at_most"] - sum(x <= at for x in n) / len(n)) < 1e-12
    assert truncated_total(histogram, 5) == sum(min(x, 5) for x in n)
    assert quantile(histogram, 0.5) == sorted(n)[(len(n) + 1) // 2 - 1] and quantile(histogram, 1) == max(n)


def test_empty_table(spark):
    histogram = length_histogram(spark.createDataFrame([], SCHEMA))
    assert histogram.collect() == [] and quantile(histogram, 0.5) is None and truncated_total(histogram, 9) == 0
