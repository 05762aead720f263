import random
import tracemalloc

import numpy as np
import pyarrow as pa
import zstandard
from gleaner.llm.quality import accepted_documents, classify, features, learn, p_bad

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def corpus(seed):
    rng = random.Random(seed)
    syllables = ["ta", "ren", "is", "on", "the", "li", "mo", "sa", "er", "qu"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(900):
        words = [word() for _ in range(rng.randint(60, 200))]
        kind = rng.choice((0, 0, 0, 1, 2))
        if kind == 1:
            words = rng.choice(([w.upper() + "!!" for w in words], [w + rng.choice(("$$$", "&&&")) for w in words], [words[0]] * len(words)))
        if kind == 2:
            for _ in range(rng.randint(3, 8)):
                words[rng.randrange(len(words))] = rng.choice(("vilest", "brutish", "wretch"))
        docs.append((i, " ".join(words)))
        labels.append((i, int(kind != 1), int(kind == 2)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(1)
    found = {r["doc_id"]: r for r in classify(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels[:500], LABELS)).collect()}
    bad = {i for i, q, t in labels if not q or t}
    unseen = range(500, 900)
    assert sum(found[i]["rejected"] for i in unseen if i in bad) > 0.95 * len(bad & set(unseen))
    assert sum(found[i]["rejected"] for i in unseen if i not in bad) < 0.03 * 400
    assert all(0 <= r["p_bad"] <= 1 for r in found.values()) and len(found) == 900


def test_defined_results(spark):
    docs, labels = corpus(2)
    odd = [(None, docs[0][1]), (2000, None), (2001, ""), (2002, "?"), (2003, "on " * 200_000), (2004, docs[1][1]), (2004, docs[1][1])]
    table = spark.createDataFrame([(*r, 1, "z") for r in docs + odd], DOCS + ", p_bad int, rejected string")
    told = spark.createDataFrame([*labels, labels[0], (None, 1, 0), (5, None, 1), (7, 1, None)], LABELS)
    got = classify(table, told).collect()
    assert len(got) == len(docs) + len(odd)
    by = {r["doc_id"]: r for r in got}
    assert by[2000]["p_bad"] == by[2001]["p_bad"] == 0.5 and not by[2000]["rejected"] and not by[2001]["rejected"]
    assert len({r["p_bad"] for r in got if r["doc_id"] == 2004}) == 1
    kept = accepted_documents(table, told)
    assert kept.columns == table.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(r["doc_id"] or -1 for r in got if not r["rejected"])


def test_nothing_to_learn_and_empty_tables(spark):
    docs, labels = spark.createDataFrame([(1, "a b"), (2, "c d")], DOCS), spark.createDataFrame([(1, 1, 0)], LABELS)
    none = spark.createDataFrame([], LABELS)
    for told in (labels, none):
        assert sorted((r["doc_id"], r["p_bad"], r["rejected"]) for r in classify(docs, told).collect()) == [(1, 0.5, False), (2, 0.5, False)]
        assert accepted_documents(docs, told).count() == 2
    empty = spark.createDataFrame([], DOCS)
    assert classify(empty, none).collect() == accepted_documents(empty, none).collect() == []


def test_p_bad_is_calibrated(spark):
    """On documents that weren't learned from, the mean of p_bad is the share of bad ones, over all and above and below one half."""
    docs, labels = corpus(3)
    found = {r["doc_id"]: r["p_bad"] for r in classify(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels[:450], LABELS)).collect()}
    told = [(found[i], not q or t) for i, q, t in labels[450:]]
    for part in (told, [x for x in told if x[0] < 0.5], [x for x in told if x[0] >= 0.5]):
        assert abs(sum(p - bad for p, bad in part) / len(part)) < 0.06


def test_windowed_sizes_equal_compressing_by_hand():
    rng = np.random.default_rng(1)
    words = rng.integers(1, 1 << 60, 400).astype(np.uint64)
    dictionaries = b"good text " * 20, b"b!d t!xt " * 20, bytes(16) + words[:50].tobytes(), bytes(16) + words[50:100].tobytes()
    texts = ["good text b!d t!xt " * 300, "", "one", "é " * 5000]
    got = features(pa.array(texts), dictionaries)
    size = lambda d, level, data: len(zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False).compress(data))
    for text, row in zip(texts, got):
        data = text.encode()
        if not data:
            assert (row == 0).all()
            continue
        good, bad = (sum(size(d, 3, data[at : at + 2048]) for at in range(0, len(data), 2048)) for d in dictionaries[:2])
        assert abs(row[0] - (good - bad) / max(good, bad)) < 0.02


def test_scoring_a_batch_takes_memory_for_a_part_of_it():
    """A worker has its batch, and what it needs besides doesn't grow with that."""
    model = learn(*([f"{kind} text {i} of words" for i in range(60)] for kind in ("good", "poor", "toxic")))
    texts = pa.array([None] + [f"word{i} " * 250 for i in range(4000)], pa.large_string())
    p_bad(texts.slice(0, 10), model)
    before = pa.total_allocated_bytes()
    tracemalloc.start()
    p, rejected = p_bad(texts, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert p[0] == 0.5 and not rejected[0] and len(p) == 4001
    assert peak < 30_000_000 and pa.total_allocated_bytes() - before < 1_000_000
