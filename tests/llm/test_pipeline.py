"""The registered queries of the subpackage, and the pipeline stage by stage against brute force on a small fixture."""

import inspect
import random

import corpus_pipeline
import pytest
from gleaner.llm import jaccard, registry
from gleaner.llm.common import WORD
from gleaner.llm.decontaminate import SCORE
from gleaner.llm.jaccard import NGRAM, THRESHOLD
from gleaner.llm.quality import classify
from gleaner.llm.token_lengths import lengths

from .test_decontaminate import brute_score
from .test_jaccard import brute as brute_pairs
from .test_quality import corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    rng = random.Random(11)
    docs, labels = corpus(5)
    items = [(i, " ".join(f"item{i}w{k}" for k in range(rng.randint(15, 40)))) for i in range(10)]
    rows = []
    for i, text in docs:
        if i % 30 == 0:
            text += " " + items[i // 30 % 10][1]
        rows.append([i, text])
    for k in range(60):  # near copies and copies of clean documents
        source = rng.choice(rows[:900])[1].split()
        if k % 3:
            source[len(source) // 2] = "edited"
        rows.append([1000 + k, " ".join(source)])
    rows = [(i, t, "en", f"src{i % 3}", len(t)) for i, t in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_every_stage_of_the_pipeline(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        before, docs = docs.collect(), spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.columns == (columns if k < 4 else [*columns, "shard"])
        kept.append((before, docs.collect()))
    ids = [({r["doc_id"] for r in a}, {r["doc_id"] for r in b}) for a, b in kept]
    rejected = {r["doc_id"] for r in classify(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")).filter("rejected").collect()}
    assert ids[0][1] == ids[0][0] - rejected and len(rejected) > 200
    # One document of each connected group stays.
    group = {i: i for i in ids[1][0]}
    for a, b in brute_pairs([(r["doc_id"], r["text"]) for r in kept[1][0]], NGRAM, THRESHOLD):
        x, y = group[a], group[b]
        group = {i: min(x, y) if g in (x, y) else g for i, g in group.items()}
    assert ids[1][1] == set(group.values()) and len(ids[1][0] - ids[1][1]) >= 30
    items = [r["text"] for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    leaked = {r["doc_id"] for r in kept[2][0] if max(brute_score(r["text"], t) for t in items) >= SCORE}
    assert ids[2][1] == ids[2][0] - leaked and len(leaked) >= 10
    of = lengths()
    tokens = sum(of(r["text"]) for r in kept[3][0])
    for source in ("src0", "src1", "src2"):
        used = sum(of(r["text"]) for r in kept[3][1] if r["source"] == source)
        own = sum(of(r["text"]) for r in kept[3][0] if r["source"] == source)
        assert used <= tokens / 6 and used >= min(own, tokens / 6) - 3
    assert ids[4][1] == ids[4][0] and all(0 <= r["shard"] < 16 for r in kept[4][1])
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()) == sorted(ids[4][1])


def test_the_near_copies_stage_makes_no_row_for_each_pair(spark, monkeypatch):
    rng = random.Random(12)
    rows = []
    for i in range(300):
        words = [f"w{k}" for k in range(100)]
        words[rng.randrange(100)] = f"own{i}"
        rows.append((i, " ".join(words)))
    made, write = [], jaccard.materialise
    monkeypatch.setattr(jaccard, "materialise", lambda df, name: made.append(write(df, name)) or made[-1])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert [r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, "").collect()] == [0]
    assert made and max(df.count() for df in made) <= 3000  # of 44,850 pairs


def test_one_query_for_each_operator():
    names = registry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram jaccard join", "benchmark decontamination", "mixing sources", "sharding"]
    assert set(registry.oracle_sql()) <= set(names)
    assert "localCheckpoint" not in "".join(inspect.getsource(m) for m in (registry, corpus_pipeline))


def test_words_are_what_the_docstring_says():
    assert WORD.findall("A-b_1 é".lower()) == ["a", "b_1", "é"]
