import itertools
import random

import pytest
from gleaner.llm import jaccard, registry
from gleaner.llm.common import WORD

SCHEMA = "doc_id long, text string"


def brute(rows, n, threshold):
    """All pairs of ids, by sets of tuples of words."""
    sets = {}
    for i, text in rows:
        words = WORD.findall((text or "").lower())
        if i is not None and words:
            k = min(n, len(words))
            sets[i] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)}
    out = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and both / len(sets[a] | sets[b]) >= threshold - 1e-9:
            out[a, b] = both
    return out


def brute_classes(rows, n, threshold):
    """doc_id: class_id, copies, links of all documents with a link; all doc_ids differ."""
    pairs = brute(rows, n, threshold)
    words = {i: WORD.findall((t or "").lower()) for i, t in rows}
    sets = {i: {tuple(w[j : j + min(n, len(w))]) for j in range(len(w) - min(n, len(w)) + 1)} for i, w in words.items()}
    group = {i: i for pair in pairs for i in pair}
    for a, b in pairs:
        x, y = group[a], group[b]
        group = {i: min(x, y) if g in (x, y) else g for i, g in group.items()}
    return {i: (g, 1 + sum(i in p and sets[p[0]] == sets[p[1]] for p in pairs), sum(i in p for p in pairs)) for i, g in group.items()}


def found(docs, *options):
    rows = jaccard.similarity_classes(docs, *options).collect()
    assert len({r["doc_id"] for r in rows}) == len(rows)
    return {r["doc_id"]: (r["class_id"], r["copies"], r["links"]) for r in rows}


def corpus(seed, count=120):
    rng = random.Random(seed)
    vocabulary = ["wort%d" % i for i in range(300)] + ["é", "Ünd", "x_1"]
    rows = []
    for i in range(count):
        kind = rng.random()
        if rows and kind < 0.3:
            rows.append((i, rng.choice(rows)[1]))
        elif rows and kind < 0.6:
            words = rng.choice(rows)[1].split()
            for _ in range(rng.randint(1, 5)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append((i, " ".join(words)))
        else:
            rows.append((i, " ".join(rng.choices(vocabulary, k=rng.choice((1, 3, 5, 30, 80))))))
    return rows


@pytest.mark.parametrize(("n", "threshold", "tile", "hot"), [(5, 0.5, 3000, 500_000), (3, 0.7, 3000, 8), (5, 0.5, 7, 4)])
def test_classes_and_links_equal_brute_force(spark, monkeypatch, n, threshold, tile, hot):
    monkeypatch.setattr(jaccard, "TILE", tile)
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "PAIRS", tile)
    rows = corpus(n)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(docs, n, threshold) == brute_classes(rows, n, threshold)
    links, sets, members = jaccard.similar_sets(docs, n, threshold)
    of = {}
    for r in members.collect():
        of.setdefault(r["sig"], []).append(r["doc_id"])
    want = brute(rows, n, threshold)
    got = {(min(a, b), max(a, b)): r["overlap"] for r in links.collect() for a in of[r["a"]] for b in of[r["b"]]}
    got |= {(a, b): want[a, b] for ids in of.values() for a, b in itertools.combinations(sorted(ids), 2)}
    assert got == want and len(got) > 30


def test_hot_ngrams_skip_the_columns(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT", 8)
    docs = spark.createDataFrame([(i, f"the same five words everywhere x{i}") for i in range(20)], SCHEMA)
    assert len(jaccard.hot_grams(docs, 5, 20, 700)) == 1


def test_nulls_empty_ties_long_and_repeated_rows(spark):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " ?! "), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "A, b c d e F"), (6, long), (7, long + " end"), (8, "a"), (9, "a")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == {4: (4, 2, 1), 5: (4, 2, 1), 6: (6, 1, 1), 7: (6, 1, 1), 8: (8, 2, 1), 9: (8, 2, 1)}
    twice = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "g h i j k l"), (3, "g h i j k l")]
    assert found(spark.createDataFrame(twice, SCHEMA)) == {1: (1, 2, 1), 2: (1, 4, 2), 3: (1, 2, 1)}
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA + ", doc_a string, grp int, size int")
    kept = jaccard.without_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 4, 6, 8]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert jaccard.similarity_classes(docs).collect() == []
    assert jaccard.without_near_copies(docs).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(40)] + [(200, i) for i in range(100, 110)] + [(300, 301), (301, 300)]
    got = dict(map(tuple, jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in [*range(100, 110), 200]}, 300: 300, 301: 300}


def test_more_blocks_of_columns_than_upper_bits_tell_apart(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SPLIT", 4)
    monkeypatch.setattr(jaccard, "buckets_for", lambda *_: 11)
    rows = corpus(8)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == brute_classes(rows, 5, 0.5)


def test_the_registered_query(spark, tmp_path):
    rows = corpus(3)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["class_id"], r["copies"], r["links"]) for r in registry.op4_ngram_jaccard_join(spark, str(tmp_path)).collect()}
    assert got == brute_classes(rows, 5, 0.5)


@pytest.mark.parametrize(("run", "tile", "size"), [(3, 2000, 4_000_000), (2, 5, 4_000_000), (6, 2000, 2000)])
def test_groups_of_near_copies_equal_brute_force(spark, monkeypatch, run, tile, size):
    """Sets that share crowded n-grams are multiplied tile by tile; others, and pairs across groups, are candidates as before."""
    for name, value in (("RUN", run), ("GROUP_TILE", tile), ("GROUP_BYTES", size)):
        monkeypatch.setattr(jaccard, name, value)
    rows = corpus(4)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert found(docs) == brute_classes(rows, 5, 0.5)
    links, _, members = jaccard.similar_sets(docs)
    of = {}
    for r in members.collect():
        of.setdefault(r["sig"], []).append(r["doc_id"])
    want = brute(rows, 5, 0.5)
    got = [((min(a, b), max(a, b)), r["overlap"], r["copies_a"] * r["copies_b"]) for r in links.collect() for a in of[r["a"]] for b in of[r["b"]]]
    assert len({p for p, *_ in got}) == len(got) and all(want[p] == n for p, n, _ in got)
    assert {p for p, *_ in got} | {p for ids in of.values() for p in itertools.combinations(sorted(ids), 2)} == set(want)


def test_near_copies_of_one_text_are_no_rows_for_each_pair(spark, monkeypatch):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        words = [f"w{k}" for k in range(100)]
        words[rng.randrange(100)] = f"own{i}"
        rows.append((i, " ".join(words)))
    sizes, write = {}, jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda df, name: sizes.setdefault(name, []).append(write(df, name)) or sizes[name][-1])
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3)) == {i: (0, 1, 299) for i in range(300)}
    assert all(df.count() <= 3000 for dfs in sizes.values() for df in dfs)
