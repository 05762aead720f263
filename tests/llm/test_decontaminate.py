import random

from gleaner.llm import decontaminate as D
from gleaner.llm.common import WORD

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def brute_score(text, item):
    """Plain Smith-Waterman over words."""
    a, b = WORD.findall((text or "").lower()), WORD.findall((item or "").lower())
    best, row = 0, [0] * (len(a) + 1)
    for w in b:
        new = [0] * (len(a) + 1)
        for j, v in enumerate(a, 1):
            new[j] = max(0, row[j - 1] + (D.MATCH if v == w else -D.MISMATCH), row[j] - D.GAP, new[j - 1] - D.GAP)
            best = max(best, new[j])
        row = new
    return best / (D.MATCH * len(b))


def test_alignment_equals_brute_force_and_edited_copies_are_found(spark):
    rng = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    text = lambda k: rng.choices(vocabulary, k=k)
    items = [(i, " ".join(text(rng.randint(12, 50)))) for i in range(12)]
    docs = []
    for i in range(90):
        words = text(rng.randint(5, 200))
        if i % 3 == 0:
            copy = rng.choice(items)[1].split()
            for _ in range(len(copy) * rng.choice((0, 1, 2, 4)) // 12):
                at = rng.randrange(len(copy))
                rng.choice((lambda: copy.pop(at), lambda: copy.insert(at, rng.choice(vocabulary)), lambda: copy.__setitem__(at, "new")))()
            words[3:3] = copy
        docs.append((i, " ".join(words)))
    found = {(r["doc_id"], r["item_id"]): r for r in D.leaks(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(items, ITEMS)).collect()}
    want = {(d, i): s for d, t in docs for i, u in items if (s := brute_score(t, u)) >= D.SCORE}
    assert set(found) <= set(want) and len(found) >= 0.9 * len(want) and len(want) >= 28
    for key, r in found.items():
        assert abs(r["score"] - want[key]) < 1e-9
        part = " ".join(WORD.findall(docs[key[0]][1])[r["first_word"] : r["end_word"]])
        assert abs(brute_score(part, items[key[1]][1]) - r["score"]) < 1e-9


def test_defined_results(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(20))
    long = "x " * 200_000 + item.upper() + " y"
    docs = [(1, None), (2, ""), (3, "?!"), (None, item), (4, item), (4, item), (5, long), (6, "unrelated words only"), (7, "w0 w1")]
    items = [(9, item), (9, item), (9, item + " more"), (None, item), (8, "a b"), (7, None), (6, "")]
    d, t = spark.createDataFrame([(i, x, "s", 1.0) for i, x in docs], DOCS + ", score string, item_id double"), spark.createDataFrame(items, ITEMS)
    for part in (D.PART, 10):  # all in one part; a part for each item
        monkeypatch.setattr(D, "PART", part)
        rows = D.leaks(d, t).collect()
        assert sorted({(r["doc_id"] or 0, r["item_id"] or 0) for r in rows}) == [(0, 0), (0, 9), (4, 0), (4, 9), (5, 0), (5, 9)]
        assert {r["score"] for r in rows if r["item_id"] is None} == {1.0}
        kept = D.clean_documents(d, t)
        assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 6, 7]


def test_empty_tables(spark):
    no, none = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "a b c d")], DOCS)
    assert D.leaks(no, none).collect() == D.leaks(some, none).collect() == D.leaks(no, spark.createDataFrame([(1, "a b c d")], ITEMS)).collect() == []
    assert D.clean_documents(some, none).count() == 1
