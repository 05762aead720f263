import random

import pytest
from gleaner.llm import registry, substrings
from gleaner.llm.common import WORD
from gleaner.llm.substrings import duplicate_spans

SCHEMA = "doc_id long, text string"


def brute(rows, length):
    """Spans of words covered by runs that a document of lesser id has, and where the first run's copy is."""
    words = {(i, t): WORD.findall(t.lower()) for i, t in rows if i is not None and t}
    first = {}
    for i, t in sorted(words):
        w = words[i, t]
        for k in range(len(w) - length + 1):
            run = tuple(w[k : k + length])
            first[run] = min(first.get(run, (i, k)), (i, k))
    out = set()
    for (i, _), w in words.items():
        end = None
        for k in range(len(w) - length + 1):
            ref = first[tuple(w[k : k + length])]
            if ref[0] < i:
                if end is None or k > end:
                    if end is not None:
                        out.add((i, begin, end, *source))
                    begin, source = k, ref
                end = k + length
        if end is not None:
            out.add((i, begin, end, *source))
    return sorted(out)


def found(df):
    return sorted((r["doc_id"], r["first_word"], r["end_word"], r["ref_doc_id"], r["ref_word"]) for r in df.collect())


@pytest.mark.parametrize("hot", [200_000, 8])
def test_spans_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = random.Random(9)
    new = lambda k: [f"w{rng.randrange(50)}" for _ in range(k)]
    passages = [new(rng.choice((9, 10, 15, 40))) for _ in range(8)]
    rows = []
    for i in range(150):
        words = new(rng.randint(0, 30))
        for _ in range(rng.randint(0, 3)):
            part = rng.choice(passages)
            words += part[rng.randint(0, 3) :] + new(rng.randint(0, 3))
        rows.append((i, " ".join(words)))
    rows += [(150 + i, rng.choice(rows)[1]) for i in range(10)]
    got = found(duplicate_spans(spark.createDataFrame(rows, SCHEMA).repartition(3), 10, 4))
    assert got == brute(rows, 10) and len(got) > 60


def test_defined_results(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    long = "x " * 100_000 + passage + " y" * 10
    rows = [(3, None), (4, ""), (5, passage), (5, passage), (2, "a b " + passage.upper() + " c"), (None, passage), (7, long), (8, " ".join(f"p{i}" for i in range(49))), (9, passage + " z " + passage)]
    docs = spark.createDataFrame([(i, t, 1, "b") for i, t in rows], SCHEMA + ", row int, bucket string")
    assert found(duplicate_spans(docs)) == [(5, 0, 60, 2, 2), (7, 100_000, 100_060, 2, 2), (9, 0, 60, 2, 2), (9, 61, 121, 2, 2)]
    assert duplicate_spans(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_short_rest_beyond_a_factor_boundary_prolongs_the_span(spark):
    a, b = [f"a{i}" for i in range(12)], [f"b{i}" for i in range(4)]
    rows = [(1, " ".join(a)), (2, " ".join(a[6:] + b)), (3, " ".join(a + b))]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [r for r in duplicate_spans(docs, 8, 3).collect() if r["doc_id"] == 3]
    assert [(r["first_word"], r["end_word"], r["factors"]) for r in got] == [(0, 16, 2)]


def test_the_registered_query(spark, tmp_path):
    rng = random.Random(10)
    passages = [[f"p{g}_{k}" for k in range(70)] for g in range(5)]
    rows = []
    for i in range(60):
        own = [f"d{i}_{k}" for k in range(rng.randint(0, 200))]
        part = rng.choice(passages)
        at = rng.randrange(len(own) + 1)
        rows.append((i, " ".join(own[:at] + part[rng.randint(0, 30) :] + own[at:])))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = found(registry.op5_substring_dedup(spark, str(tmp_path)))
    assert got == brute(rows, 50) and len(got) > 20
