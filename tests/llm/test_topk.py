import random

import numpy as np
from gleaner.llm import registry
from gleaner.llm.topk import top_k

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k):
    out = []
    for i, v in rows:
        a = np.array(v, np.float64)
        scored = []
        for j, w in rows:
            if i != j and len(v) == len(w):
                b = np.array(w, np.float64)
                norm = np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())
                scored.append((-round(float(a @ b) / norm if norm else 0.0, 6) + 0.0, j))
        out += [(i, r, j, -s + 0.0) for r, (s, j) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def test_equals_brute_force_with_ties(spark):
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(4)]) for i in range(150)]
    for k, block in ((1, 4096), (10, 16), (200, 64)):
        for every in (1, 7):
            got = sorted(tuple(r) for r in top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), k, every, block, 4 * block).collect())
            assert got == [r for r in brute([(i, np.float32(v)) for i, v in rows], k) if r[0] % every == 0]


def test_thousands_of_equal_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(3000)] + [(i, [2.0, 1.0]) for i in range(3000, 3010)]
    got = [tuple(r) for r in top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), 3, 1000, chunk=500).orderBy("query_id", "rank").collect()]
    assert [(q, v) for q, _, v, _ in got] == [(0, 1), (0, 2), (0, 3), (1000, 0), (1000, 1), (1000, 2), (2000, 0), (2000, 1), (2000, 2), (3000, 3001), (3000, 3002), (3000, 3003)]
    assert {s for _, _, _, s in got} == {1.0}


def test_the_registered_query(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(130)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in registry.op8_exact_top_k(spark, str(tmp_path)).collect())
    assert got == [r for r in brute([(i, np.float32(v)) for i, v in rows], 10) if r[0] in (0, 50, 100)]


def test_defined_results(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, []), (5, [float("nan"), 1.0]), (6, [1.0, None]), (None, [1.0, 1.0]), (7, [1e30, 1e30]), (8, [1.0, 2.0, 3.0])]
    vectors = spark.createDataFrame([(i, v, 5, "x") for i, v in rows], SCHEMA + ", rank int, block string")
    assert sorted(tuple(r) for r in top_k(vectors, 2, 1).collect()) == [(1, 1, 7, 0.707107), (1, 2, 2, 0.0), (2, 1, 1, 0.0), (2, 2, 7, 0.0), (7, 1, 1, 0.707107), (7, 2, 2, 0.0)]
    assert top_k(spark.createDataFrame([], SCHEMA)).collect() == []
