"""Properties of the retrieval plans, and every query with SQL against DuckDB on the driver's smallest tables, if these are there."""

import os

import pytest
from gleaner import evaluate as V
from gleaner import queries as Q
from gleaner.operators import dense, fusion
from gleaner.plans import retrieval as R
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def index(spark):
    rows = [(1, "solve the PoissonSolver system", "a", ["rbf"]), (2, "compute_stencil weights rbf", "b", ["rbf", "fd"]), (3, "boundary conditions bdf3", "a", []), (4, "poisson solver weights", "b", ["fd"]), (5, "", "a", None)]
    return R.build_index(spark.createDataFrame(rows, "doc_id long, text string, module string, terms array<string>"))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(10, "poisson solver"), (11, "rbf weights"), (12, "?!")], "query_id long, text string")


def rows(df):
    return [tuple(r) for r in df.select("query_id", "doc_id", "fused_rank", "fused_score").orderBy("query_id", "fused_rank").collect()]


def test_hybrid_ranks_from_zero_without_gaps(index, asked):
    found = R.hybrid(index, asked, 3)
    got = rows(found)
    for q in (10, 11):
        own = [r for r in got if r[0] == q]
        assert [r[2] for r in own] == list(range(len(own))) and 1 <= len(own) <= 3 and [r[3] for r in own] == sorted((r[3] for r in own), reverse=True)
    assert not [r for r in got if r[0] == 12] and {r[1] for r in got if r[0] == 10 and r[2] < 2} == {1, 4}
    assert set(found.first()["leg_scores"]) == {"dense", "sparse"}


def test_filters_come_before_ranking(index, asked):
    assert {r[1] for r in rows(R.hybrid_filtered(index, asked, "module", ["b"], 5))} == {2, 4}
    assert {r[1] for r in rows(R.hybrid_filtered(index, asked, "terms", ["fd"], 5))} == {2, 4}
    assert rows(R.hybrid_filtered(index, asked, "terms", [], 5)) == rows(R.hybrid(index, asked, 5, injected_ids=[1])) == []
    assert rows(R.retrieve_code(index, asked, "a", 2)) == rows(R.hybrid(index, asked, 2, condition=F.col("module") == "a"))


def test_fusion_is_monotone_in_ranks(spark):
    leg = lambda *ids: spark.createDataFrame([(1, d, float(-r), r) for r, d in enumerate(ids)], "query_id long, doc_id long, score double, rank int")
    got = rows(fusion.fuse({"x": leg(1, 2, 3), "y": leg(2, 1, 4)}, 10))
    assert [r[1] for r in got] == [1, 2, 3, 4] and got[0][3] == round(1 / 61 + 1 / 62, 6)
    assert rows(fusion.fuse({"x": leg(1, 2, 3), "y": leg(2, 1, 4)}, 10, {"y": 3.0}))[0][1] == 2


def test_reranking_and_packing(spark):
    c = spark.createDataFrame([(1, i, i, 1.0, {"dense": 0.5}, "x" * n, s) for i, (n, s) in enumerate([(10, 0.1), (10, 0.9), (10, 0.9)])], "query_id long, doc_id long, fused_rank int, fused_score double, leg_scores map<string,double>, text string, s double")
    again = fusion.rerank(c, F.col("s")).orderBy("fused_rank").collect()
    assert [r["doc_id"] for r in again] == [1, 2, 0] and again[0]["leg_scores"] == {"dense": 0.5, "rerank": 0.9}
    same = fusion.rerank(c, None, 2).orderBy("fused_rank").collect()
    assert [r["doc_id"] for r in same] == [0, 1] and same[0]["leg_scores"] == {"dense": 0.5}
    assert fusion.pack_prompt(c, 25).count() == 2 and fusion.pack_prompt(c, 5).count() == 0


def test_graph_expansion(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 9)], "src long, dst long")
    points = spark.createDataFrame([(i,) for i in (1, 2, 3)], "doc_id long")
    start = spark.createDataFrame([(7, 1)], "query_id long, doc_id long")
    hops = lambda n: {r["doc_id"]: r["hop"] for r in R.expand_refs(start, edges, points, n).collect()}
    assert hops(0) == {1: 0} and hops(1) == {1: 0, 2: 1} and hops(5) == {1: 0, 2: 1, 3: 2}


def test_missing_payload_is_flagged(spark, index):
    c = spark.createDataFrame([(1, 1), (1, 77)], "query_id long, doc_id long")
    assert {r["doc_id"]: (r["module"], r["missing"]) for r in R.with_payload(c, index.points, "module").collect()} == {1: ("a", False), 77: (None, True)}


def test_wrong_requests_are_refused(spark, index, asked):
    with pytest.raises(ValueError, match="unknown plan"):
        R.run_plan("nope")
    with pytest.raises(ValueError, match="another length"):
        R.dense_leg(index, asked, 3, dims=128)
    with pytest.raises(ValueError, match="unknown metric"):
        dense.nearest(asked, asked, 1, "hamming")


def test_evaluation(spark):
    found = spark.createDataFrame([(1, 5, 0), (1, 6, 4), (2, 7, 8)], "query_id long, doc_id long, fused_rank int")
    targets = spark.createDataFrame([(1, 6), (2, 7), (3, 1)], "query_id long, doc_id long")
    ranks = V.target_ranks(found, targets)
    one = V.gate(V.recall(ranks)).first()
    assert (one["queries"], one["recall_at_3"], one["recall_at_5"], one["recall_at_10"], one["passed"]) == (3, 0.0, 1 / 3, 2 / 3, False)
    assert [tuple(r) for r in V.compare(ranks, V.target_ranks(found.filter("query_id = 2"), targets), 5).collect()] == [(1, "regressed")]
    q = spark.createDataFrame([("a", ["src/x.py:10-20", "README.md"]), ("b", ["y.py"])], "id string, source_refs array<string>")
    c = spark.createDataFrame([("a", 6, "/r/src/x.py", 20, 30), ("b", 0, "/r/z.py", 1, 2), ("b", 1, "/r/y.py", 5, 6)], "id string, fused_rank int, source_file string, line_start int, line_end int")
    assert {r["id"]: (r["hit_at_5"], r["hit_at_10"]) for r in V.mcq_hits(c, q).collect()} == {"a": (False, True), "b": (True, True)}
    how = q.select("id", V.indexability(F.col("source_refs"), ["src/x.py"]).alias("i"))
    assert {r["id"]: r["i"] for r in how.collect()} == {"a": "full", "b": "none"}
    refs = spark.createDataFrame([("1",), ("9",), ("9",), (None,), ("",)], "ref string")
    assert V.dangling(refs, "ref", targets, "query_id").first()["n"] == 4
    assert "| 3 |" in V.report("Recall", V.recall(ranks))
    said = spark.createDataFrame([(["f", "g", "h"], ["f"], ["f", "g"])], "named array<string>, retrieved array<string>, package array<string>")
    assert tuple(V.unknown_identifiers(said).first())[3:] == (["g", "h"], ["h"])


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["tokenize_tf", "okapi_topk", "rrf_hybrid", "two_leg_bridge", "fine_to_coarse", "expand_refs", "section_subsplit", "header_neighbors", "uuid5_ids", "upsert_merge", "sessions_global", "session_mode", "recall_by_tier", "range_overlap"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in os.listdir(DATA):
        db.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{t}')")
    df = Q.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({Q.SQL[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, want))


def test_every_query_with_sql_is_registered():
    assert set(Q.SQL) <= set(Q.QUERIES) and len(Q.QUERIES) >= 60


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
def test_both_tokenizers_agree_on_the_whole_corpus(spark):
    from gleaner.functions import text as T
    from gleaner.operators import sparse

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    a, b = sparse.postings(docs), sparse.postings_by(docs, T.tokens)
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count() > 10_000


def test_reports_have_every_row_or_refuse(spark):
    rows = spark.range(30).withColumn("x", F.lit(0.5))
    assert V.report("R", rows).count("| 0.5000 |") == 30
    with pytest.raises(ValueError, match="more than 29 rows"):
        V.report("R", rows, 29)


def test_duplicate_chunks_count_once_in_an_index(spark):
    chunks = spark.createDataFrame([(1, "first words", 0), (1, "second words", 1), (2, "other words", 2)], "doc_id long, text string, place int")
    index = R.unique_index(chunks, "place")
    assert sorted((r["doc_id"], r["text"]) for r in index.points.collect()) == [(1, "first words"), (2, "other words")]


def test_parents_that_are_missing_take_a_place(spark):
    fine = spark.createDataFrame([(10, 1, "rbf rbf rbf weights"), (11, 9, "rbf rbf"), (12, 2, "rbf")], "doc_id long, parent_id long, text string")
    coarse = spark.createDataFrame([(1,), (2,)], "doc_id long")
    asked = spark.createDataFrame([(5, "rbf")], "query_id long, text string")
    leg = lambda i, q, n: R.sparse_leg(i, q, n).select("query_id", "doc_id", F.col("rank").alias("fused_rank"), F.col("score").alias("fused_score"))
    assert [(r["doc_id"], r["fused_rank"]) for r in R.fine_to_coarse(fine, coarse, asked, 2, leg).orderBy("fused_rank").collect()] == [(1, 0)]
    assert [(r["doc_id"], r["fused_rank"]) for r in R.fine_to_coarse(fine, coarse, asked, 3, leg).orderBy("fused_rank").collect()] == [(1, 0), (2, 1)]
