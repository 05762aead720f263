"""Ingest of a small source tree into a store, what plans read from it, and the drivers around it."""

import json

import pytest
from gleaner import drivers
from gleaner.__main__ import main
from gleaner.operators import embed, fusion
from gleaner.plans import ingest as I
from gleaner.plans import retrieval as R
from gleaner.sources import files as S
from gleaner.sources.store import Store, check_config, collection, existing, existing_hashes, look_up
from pyspark.sql import functions as F

POISSON = '''"""Poisson solvers."""
import numpy as np
from numba import njit


@njit
def assemble(n):
    # the stencil's weights
    w = np.zeros(n)
    for i in range(n):
        w[i] = weight_of(
            i
        )
    return w


class PoissonSolver:
    """Solves the Poisson equation with rbf weights."""

    def solve(self, n):
        return assemble(n)
'''
WEIGHTS = "def weight_of(i):\n    return 1.0 / (1 + i)\n"


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    package = root / "src" / "pkg"
    package.mkdir(parents=True)
    (package / "__init__.py").write_text("from .poisson import PoissonSolver\n")
    (package / "poisson.py").write_text(POISSON)
    (package / "weights.py").write_text(WEIGHTS)
    (package / "broken.py").write_text("def broken(:\n")
    (root / "lexicon.json").write_text(json.dumps(["rbf", "poisson equation", "stencil"]))
    (root / "README.md").write_text("Intro text.\n\n## Install\n\nRun the thing.\n\n## Empty\n")
    papers = root / "papers"
    papers.mkdir()
    (papers / "one.md").write_text("A paper on rbf weights.")
    (papers / "one.json").write_text(json.dumps({"math_terms": ["rbf"], "section": "Intro"}))
    return root


def run(spark, store, tree, **options):
    return I.ingest(store, S.source_files(spark, str(tree / "src" / "pkg")), "pkg", S.lexicon(spark, str(tree / "lexicon.json")), **options).first().asDict()


@pytest.fixture(scope="module")
def store(spark, tree, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    first = run(spark, store, tree)
    assert first == {"seen": 6, "skipped": 0, "embedded": 6, "cache_hits": 0, "cache_misses": 6, "pruned": 0}
    return store


def test_points_have_the_whole_payload(spark, store):
    points = {(r["granularity"], r["function_name"] or r["chunk_type"], r["text"]): r for r in store.read("points").collect()}
    coarse = {k[1]: r for k, r in points.items() if k[0] == "coarse"}
    assert set(coarse) == {"module_exports", "module_docstring", "assemble", "class_header", "solve", "weight_of"}
    assert coarse["assemble"]["has_numba"] and coarse["assemble"]["cross_refs"] == ["pkg.weights.weight_of"] and coarse["assemble"]["math_terms"] == ["stencil"]
    assert coarse["class_header"]["math_terms"] == ["poisson equation", "rbf"] and "import numpy" in coarse["assemble"]["context_header"]
    assert coarse["solve"]["parent_class"] == "PoissonSolver" and coarse["solve"]["line_range"]["start"] == 20
    fine = [r for k, r in points.items() if k[0] == "fine"]
    assert fine and all(r["parent_id"] in {c["point_id"] for c in coarse.values()} and r["content_hash"] in {c["content_hash"] for c in coarse.values()} for r in fine)
    assert store.layout("points") == ("granularity",) and store.layout("vectors") == ("space",)
    assert store.read("vectors").count() == len(points)
    assert existing_hashes(store.read("points")).count() == 6


def test_a_second_run_skips_all_and_a_changed_file_is_worked_on(spark, store, tree):
    assert run(spark, store, tree) == {"seen": 6, "skipped": 6, "embedded": 0, "cache_hits": 0, "cache_misses": 0, "pruned": 0}
    (tree / "src" / "pkg" / "weights.py").write_text(WEIGHTS + "\n\ndef other():\n    return weight_of(3)\n")
    (tree / "src" / "pkg" / "__init__.py").unlink()
    got = run(spark, store, tree)
    assert got == {"seen": 6, "skipped": 5, "embedded": 1, "cache_hits": 0, "cache_misses": 1, "pruned": 1}
    assert store.layout("points") == ("granularity",)
    names = sorted(r["function_name"] for r in store.read("points").filter("granularity = 'coarse' and function_name is not null").collect())
    assert names == ["assemble", "other", "solve", "weight_of"]
    assert store.read("postings").select("point_id").distinct().count() == store.read("points").count()


def test_summaries_are_cached_by_hash(spark, tree, tmp_path):
    own = Store(spark, str(tmp_path))
    told = F.udf(lambda t: "sum " + t[:5] if "def" in t else "", "string")
    first = run(spark, own, tree, summarizer=told)
    chunks = I.chunk_points(S.source_files(spark, str(tree / "src" / "pkg")), "pkg")
    told_of = chunks.filter(F.contains("text", F.lit("def"))).count()
    assert first["cache_hits"] == 0 and own.read("summaries").count() == told_of > 2
    own.write("points", own.read("points").filter("false"))
    again = run(spark, own, tree, summarizer=told)
    assert again["embedded"] == first["embedded"] and again["cache_hits"] == told_of


def test_readme_and_papers(spark, store, tree):
    assert I.ingest_readme(store, S.readme(spark, str(tree / "README.md"))) == 3
    assert I.ingest_readme(store, S.readme(spark, str(tree / "README.md"))) == 3
    readme = store.read("points").filter("module = 'README'")
    assert sorted(r["function_name"] for r in readme.collect()) == ["Empty", "Install", "overview"]
    links = I.ingest_papers(store, S.papers(spark, str(tree / "papers")))
    assert links.count() == 1
    linked = store.read("points").filter("math_source_id is not null").collect()
    assert [r["chunk_type"] for r in linked] == ["class_header"]
    assert store.read("vectors").filter("space = 'math__hashed'").count() == 1
    assert run(spark, store, tree)["pruned"] == 0 and store.read("points").filter("module = 'README'").count() == 3


def test_plans_read_from_the_store(spark, store, tmp_path):
    index = R.open_index(store, F.col("granularity") == "coarse")
    asked = spark.createDataFrame([("q1", "PoissonSolver solve"), (None, "stencil weights")], "query_id string, text string")
    log = str(tmp_path / "log")
    asked_ids = spark.createDataFrame([("q1", "PoissonSolver solve"), ("q2", "stencil weights")], "query_id string, text string")
    found = R.hybrid(index, asked_ids, 3, log=log)
    best = R.with_payload(found.filter("fused_rank = 0"), index.points, "function_name", "chunk_type").collect()
    assert {r["query_id"]: r["function_name"] or r["chunk_type"] for r in best}["q1"] in ("class_header", "solve")
    events = S.event_log(spark, log).collect()
    assert sorted(e["query_id"] for e in events) == ["q1", "q2"] and all(e["payload"]["plan"] == "hybrid" for e in events)
    R.trimodal(index, asked, injected_ids=["x", "y"], log=log)
    injected = [e for e in S.event_log(spark, log).collect() if e["payload"]["plan"] == "trimodal"]
    assert [(e["query_id"], e["payload"]["injected_ids"], e["payload"]["candidates"]) for e in injected] == [("q1", ["x", "y"], None)]
    reranked = R.hybrid(index, asked_ids, 2, reranker=fusion.LEXICAL, fetch_k=6)
    assert reranked.groupBy("query_id").count().filter("count > 2").count() == 0 and "rerank" in reranked.first()["leg_scores"]
    assert fusion.reranker_id(None) == "none" and fusion.reranker_id(fusion.LEXICAL) == "lexical-overlap"
    few = R.single_leg(R.sparse_leg(index, asked_ids, 5), "sparse", 5).filter("fused_rank = 0").collect()
    assert {round(r["fused_score"], 6) for r in few} == {round(1 / 61, 6)}
    assert R.pooled_hybrid(index, asked_ids, 30, pool=2).groupBy("query_id").count().filter("count > 4").count() == 0
    first = R.pooled_hybrid(index, asked_ids, 1, pool=2).first()
    assert first["fused_score"] in (round(1 / 60, 6), round(2 / 60, 6), round(1 / 60 + 1 / 61, 6))


def test_expansion_comes_last_with_score_0(spark, store):
    points = store.read("points").filter("granularity = 'coarse'").withColumnRenamed("point_id", "doc_id")
    edges = points.select(F.col("doc_id").alias("src"), F.explode("cross_ref_ids").alias("dst"))
    start = points.filter("function_name = 'solve'").select(F.lit("q").alias("query_id"), "doc_id", F.lit(0).alias("fused_rank"), F.lit(0.5).alias("fused_score"))
    got = R.expand_candidates(start, edges, points, 2).join(points.select("doc_id", "function_name"), "doc_id").orderBy("fused_rank").collect()
    assert [(r["function_name"], r["fused_score"], r["expansion"]) for r in got] == [("solve", 0.5, False), ("assemble", 0.0, True), ("weight_of", 0.0, True)]
    assert R.expand_candidates(start, edges, points, 0).collect()[0]["expansion"] is False


def test_verification_and_exit_codes(spark, store, tmp_path, capsys):
    questions = [{"query_id": "a", "text": "PoissonSolver.solve", "symbol": "PoissonSolver.solve", "source_file": "pkg/poisson.py"}, {"query_id": "b", "text": "weight_of", "symbol": "weight_of", "source_file": "weights.py"}]
    (tmp_path / "q.json").write_text(json.dumps(questions))
    assert main(["verify", store.root, "--questions", str(tmp_path / "q.json"), "--json", str(tmp_path / "out.json")]) == 0
    facts = json.loads((tmp_path / "out.json").read_text())
    assert facts["passed"] and facts["recall"]["recall_at_5"] == 1.0 and facts["invariants"] == {"missing_primary": 0, "dangling_parents": 0, "dangling_papers": 0, "passed": True}
    assert "passed" in capsys.readouterr().out
    broken = Store(spark, str(tmp_path / "broken"))
    for t in ("points", "vectors", "postings"):
        broken.write(t, store.read(t).filter("space <> 'ctx__hashed'") if t == "vectors" else store.read(t))
    assert main(["verify", broken.root]) == 1
    broken.write("points", broken.read("points").drop("module"))
    code, facts, text = drivers.verify(broken)
    assert code == 1 and "module" in facts["schema"][0] and "FAILED" in text
    assert main(["ask", store.root, "PoissonSolver solve", "-k", "2", "--rerank"]) == 0


def test_multiple_choice_report(spark, store):
    index = R.open_index(store, F.col("granularity") == "coarse")
    schema = "id string, difficulty string, category string, question string, options array<string>, answer string, source_refs array<string>"
    rows = [("1", "easy", "api", "What does weight_of return?", ["a", "b"], "A", ["src/pkg/weights.py:1-2"]), ("2", "hard", "api", "What of nothing?", ["a"], "A", ["src/other.py"])]
    facts, text = drivers.evaluate_choices(index, spark.createDataFrame(rows, schema))
    assert facts["indexed"] == {"full": 1, "none": 1} and "## Hits" in text
    assert {(r["difficulty"], r["category"]): r["questions"] for r in facts["summary"]} == {("easy", None): 1, ("hard", None): 1, (None, "api"): 2, (None, None): 2}


def test_registry_refuses_duplicates_and_unknown_names(spark):
    registry = embed.Registry(embed.HASHED)
    with pytest.raises(ValueError, match="registered already"):
        registry.register(embed.HASHED)
    with pytest.raises(KeyError, match="nope"):
        registry.get("nope")
    with pytest.raises(ValueError, match="dimensions"):
        registry.register(embed.Embedder("qwen3", 3, embed.HASHED.encode))
    states = lambda t: F.array(F.array(F.length(t).cast("double"), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0)))
    texts = spark.createDataFrame([("p", "ab")], "point_id string, text string")
    registry.register(embed.code_embedder(states))
    assert registry.get("jinacode").passages(texts).first()["embedding"] == [0.6, 0.8]
    assert embed.mean_pool_embedder(states).passages(texts).first()["embedding"] == [2.5, 2.0]
    asked = embed.instruction_embedder(lambda t: F.array(F.array(F.length(t).cast("double"))), "Go")
    assert asked.queries(texts, "point_id").first()["embedding"] == [1.0] and asked.passages(texts).first()["embedding"] == [1.0]
    assert embed.needed(["ctx__hashed", "code__jinacode", "com__hashed"]) == ["hashed", "jinacode"]


def test_spaces_of_fine_points_and_of_chunks_without_comments(spark):
    points = spark.createDataFrame([("a", "x = 1", "coarse", None, None), ("b", "x = 1  # one", "coarse", "sum", "# h"), ("c", "y", "fine", None, None)], "point_id string, text string, granularity string, llm_summary string, context_header string")
    got = {(r["point_id"], r["space"]) for r in embed.embed_spaces(points, ["ctx__hashed", "com__hashed", "code__hashed", "summary__hashed"], embed.Registry(embed.HASHED)).collect()}
    assert got == {("a", "ctx__hashed"), ("b", "ctx__hashed"), ("c", "ctx__hashed"), ("b", "com__hashed"), ("a", "code__hashed"), ("b", "code__hashed"), ("b", "summary__hashed")}


def test_lookups_and_configurations(spark, store):
    points = spark.createDataFrame([("a", 1), ("b", 2)], "point_id string, n int")
    ids = spark.createDataFrame([("b", 0), ("zz", 1), ("a", 2), (None, 3)], "point_id string, place int")
    assert [r["point_id"] for r in look_up(points, ids).collect()] == ["b", "a"]
    assert sorted(r["point_id"] for r in existing(points, ids).collect()) == ["a", "b"]
    good = collection(("ctx__hashed", "math__qwen3"))
    check_config(good, collection(("ctx__hashed", "math__qwen3")))
    for wrong, name in ((good | {"math__qwen3": good["math__qwen3"] | {"quantised": False}}, "quantised"), (good | {"bm25_code": {"kind": "sparse", "modifier": "idf"}}, "modifier"), ({"ctx__hashed": good["ctx__hashed"]}, "missing")):
        with pytest.raises(ValueError, match=name):
            check_config(wrong, good)
    assert store.ensure_index("points") and not store.ensure_index("points")


def test_symbols_are_written(spark, tree, tmp_path):
    drivers.dump_symbols(I.chunk_points(S.source_files(spark, str(tree / "src" / "pkg")), "pkg"), str(tmp_path / "symbols"))
    assert "pkg.poisson.assemble" in {r["qualname"] for r in spark.read.json(str(tmp_path / "symbols")).collect()}
