import math
import random
from collections import Counter, defaultdict

import pytest
from gleaner.llm import language_model as L
from gleaner.llm.common import WORD

SCHEMA = "doc_id long, text string"


def brute(corpus, texts):
    """Interpolated modified Kneser-Ney from dictionaries of words."""
    events = lambda t: (lambda w: list(zip(["<s>", *w], [*w, "</s>"])) if w else [])(WORD.findall((t or "").lower()))
    pairs = Counter(e for t in corpus for e in events(t))
    follow = defaultdict(list)
    before = Counter(w for _, w in pairs)
    for (v, _), c in pairs.items():
        follow[v].append(c)
    cc = lambda counts: [sum(c == n for c in counts) for n in (1, 2, 3, 4)]
    d2, d1 = L.discounts(*cc(pairs.values())), L.discounts(*cc(before.values()))
    cut = lambda c, d: d[min(c, 3) - 1] if c else 0
    kinds, size = len(pairs), len(before) + 1

    def p(v, w):
        low = (before[w] - cut(before[w], d1)) / kinds + sum(cut(c, d1) for c in before.values()) / kinds / size
        if v not in follow:
            return low
        total = sum(follow[v])
        return (pairs[v, w] - cut(pairs[v, w], d2)) / total + sum(cut(c, d2) for c in follow[v]) / total * low

    return [sum(math.log(p(*e)) for e in events(t)) for t in texts], p, before


@pytest.mark.parametrize(("seed", "block", "counted"), [(1, 4_000_000, 12_000_000), (2, 300, 500)])
def test_equals_brute_force_and_sums_to_one(spark, monkeypatch, seed, block, counted):
    monkeypatch.setattr(L, "BLOCK", block)
    monkeypatch.setattr(L, "COUNTED", counted)
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    corpus = [" ".join(words[i : i + rng.randint(1, 40)]) for i in range(0, 3000, 30)]
    texts = [*corpus[:60], "never seen words w1", "w1 w1 w1"]
    frame = lambda t: spark.createDataFrame(list(enumerate(t)), SCHEMA).repartition(3)
    got = {r["doc_id"]: r for r in L.perplexities(frame(texts), frame(corpus)).collect()}
    want, p, before = brute(corpus, texts)
    for i, x in enumerate(want):
        assert math.isclose(got[i]["log_prob"], x, rel_tol=1e-9)
        assert math.isclose(got[i]["perplexity"], math.exp(-x / (got[i]["words"] + 1)), rel_tol=1e-9)
    for v in ("w1", "w2", "nothing"):
        assert math.isclose(sum(p(v, w) for w in [*before, "unknown"]), 1, rel_tol=1e-9)


def test_defined_results(spark):
    rows = [(1, None), (2, ""), (3, "?"), (4, "a b a b"), (4, "a b a b"), (None, "a"), (5, "x y " * 60_000)]
    docs = spark.createDataFrame([(i, t, 1, "p") for i, t in rows], SCHEMA + ", words int, bucket string")
    got = L.perplexities(docs).collect()
    assert sorted((r["doc_id"] or 0, r["words"]) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 0), (4, 4), (4, 4), (5, 120_000)]
    assert all((r["perplexity"] is None and r["log_prob"] == 0) == (r["words"] == 0) for r in got)
    want = brute([t for _, t in rows], [t for _, t in rows])[0]
    assert all(any(math.isclose(r["log_prob"], w, rel_tol=1e-8) for w in want) for r in got)
    empty = spark.createDataFrame([], SCHEMA)
    assert L.perplexities(empty).collect() == []
    assert L.perplexities(spark.createDataFrame([(1, "a b")], SCHEMA), empty).first()["words"] == 2


def brute_of_order(corpus, texts, order):
    """The same at any order, by recursion over tuples of words; histories begin with one mark at most."""

    def events(text):
        words = WORD.findall((text or "").lower())
        marked = ["<s>", *words, "</s>"] if words else []
        return [tuple(marked[max(0, i - order + 1) : i + 1]) for i in range(1, len(marked))]

    raw = Counter(g for t in corpus for g in events(t))
    counts = {order: Counter({g: c for g, c in raw.items() if len(g) == order})}
    for m in range(order - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
        for g, c in raw.items():  # n-grams that begin with the document have their own count
            if len(g) >= m > 1 and g[0] == "<s>":
                counts[m][g[:m]] = 0
        for g, c in raw.items():
            if len(g) == m > 1 and g[0] == "<s>":
                counts[m][g] += c
        counts[m] = +counts[m]
    follow = {m: defaultdict(list) for m in counts}
    for m in counts:
        for g, c in counts[m].items():
            follow[m][g[:-1]].append(c)
    d = {m: L.discounts(*[sum(c == n for c in counts[m].values()) for n in (1, 2, 3, 4)]) for m in counts}
    cut = lambda c, x: x[min(c, 3) - 1] if c else 0
    size = len(counts[1]) + 1

    def p(g):
        m = len(g)
        after = follow[m].get(g[:-1], [])
        low = p(g[1:]) if m > 1 else 1 / size
        c = counts[m][g]
        return (c - cut(c, d[m])) / sum(after) + sum(cut(x, d[m]) for x in after) / sum(after) * low if after else low

    return [sum(math.log(p(g)) for g in events(t)) for t in texts]


@pytest.mark.parametrize("order", [3, 4])
def test_higher_orders_equal_brute_force(spark, monkeypatch, order):
    monkeypatch.setattr(L, "BLOCK", 300)
    monkeypatch.setattr(L, "COUNTED", 500)
    rng = random.Random(order)
    words = [f"w{int(rng.paretovariate(0.9))}" for _ in range(2000)]
    corpus = [" ".join(words[i : i + rng.randint(1, 40)]) for i in range(0, 2000, 20)]
    texts = [*corpus[:40], "never seen words w1", "w1 w1 w1", "w2"]
    frame = lambda t: spark.createDataFrame(list(enumerate(t)), SCHEMA).repartition(3)
    got = {r["doc_id"]: r["log_prob"] for r in L.perplexities(frame(texts), frame(corpus), order=order).collect()}
    for i, x in enumerate(brute_of_order(corpus, texts, order)):
        assert math.isclose(got[i], x, rel_tol=1e-9)
