"""Drivers around the plans: verification, multiple-choice evaluation and session reports, each with a report, JSON and an exit code."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import evaluate as V
from gleaner.functions import text as T
from gleaner.operators import embed
from gleaner.plans import ingest, retrieval
from gleaner.sources import store as S
from gleaner.streaming import events as E


def check_tables(store: S.Store) -> list[str]:
    """Names of the tables whose schema isn't the expected one, with the reason."""
    wrong = []
    for name, schema in (("points", ingest.PAYLOAD), ("vectors", ingest.VECTOR), ("postings", ingest.POSTING)):
        try:
            S.check_schema(store.read(name).schema, store.spark.createDataFrame([], schema).schema)
        except (ValueError, FileNotFoundError) as error:
            wrong.append(f"{name}: {error}")
    return wrong


def invariants(store: S.Store, primary: str = "ctx__hashed") -> DataFrame:
    """One row: missing_primary, dangling_parents, dangling_papers (only where there are papers), passed."""
    points, vectors = store.read("points"), store.read("vectors")
    with_vector = vectors.filter((F.col("space") == primary) & (F.size("embedding") > 0)).select("point_id")
    checks = {"missing_primary": V.dangling(points, "point_id", with_vector, "point_id"), "dangling_parents": V.dangling(points.filter("granularity = 'fine'"), "parent_id", points, "point_id")}
    if store.exists("papers") and store.has_points("papers"):
        checks["dangling_papers"] = V.dangling(points.filter("math_source_id is not null"), "math_source_id", store.read("papers"), "point_id")
    return V.invariants(checks)


def golden(store: S.Store, questions: DataFrame, k: int = 10, embedder: embed.Embedder = embed.HASHED) -> tuple[DataFrame, DataFrame]:
    """Recall with the gate, and each query's first five, for questions (query_id, text, symbol, source_file): a point is right if it is the symbol of that file."""
    index = retrieval.open_index(store, F.col("granularity") == "coarse")
    found = retrieval.hybrid(index, questions, k, space=f"ctx__{embedder.name}", embed=embedder.queries)
    targets = questions.join(index.points.select("doc_id", "parent_class", "function_name", F.col("source_file").alias("_file")), F.endswith("_file", "source_file") & T.symbol_matches(F.col("symbol"), F.col("parent_class"), F.col("function_name")), "left")
    ranks = V.target_ranks(found, targets.select("query_id", "doc_id"))
    return V.gate(V.recall(ranks)), V.top_each(found)


def verify(store: S.Store, questions: DataFrame | None = None) -> tuple[int, dict, str]:
    """(exit code, facts, report): schema, invariants, population, and the recall gate where questions are given. 1 if anything fails."""
    wrong = check_tables(store)
    facts: dict = {"schema": wrong}
    parts = ["# Verification\n", "schema: " + ("; ".join(wrong) if wrong else "as expected") + "\n"]
    passed = not wrong
    if not wrong:
        found = invariants(store)
        population = ingest.population_report(store)
        parts += [V.report("Invariants", found), V.report("Population", population)]
        facts |= {"invariants": found.first().asDict(), "population": {r["measure"]: r["value"] for r in population.collect()}}
        passed &= facts["invariants"]["passed"]
        if questions is not None:
            recall, top = golden(store, questions)
            parts += [V.report("Recall", recall), V.report("First five", top)]
            facts["recall"] = recall.first().asDict()
            passed &= facts["recall"]["passed"]
    facts["passed"] = bool(passed)
    return (0 if passed else 1), facts, "\n".join([*parts, "passed" if passed else "FAILED", ""])


def evaluate_choices(index: retrieval.Index, questions: DataFrame, k: int = 10, limit_files: list[str] | None = None, reranker=None) -> tuple[dict, str]:
    """Hit rates of multiple-choice questions (id, difficulty, category, question, options, answer, source_refs) by difficulty and category, with how far their references are indexed. Points have source_file and line_range."""
    asked = questions.select(F.col("id").alias("query_id"), T.question_text(F.col("question"), F.col("options")).alias("text"))
    found = retrieval.hybrid(index, asked, k, reranker=reranker)
    placed = found.join(index.points.select("doc_id", "source_file", "line_range"), "doc_id").select(F.col("query_id").alias("id"), "fused_rank", "source_file", F.col("line_range.start").alias("line_start"), F.col("line_range.end").alias("line_end"))
    hits = V.mcq_hits(placed, questions)
    files = limit_files or [r[0] for r in index.points.select("source_file").distinct().collect()]  # names of files, as many as the source tree has
    indexed = questions.select(V.indexability(F.col("source_refs"), [relative(f) for f in files]).alias("indexed")).groupBy("indexed").agg(F.count(F.lit(1)).alias("questions"))
    summary = V.mcq_summary(hits)
    facts = {"summary": [r.asDict() for r in summary.collect()], "indexed": {r["indexed"]: r["questions"] for r in indexed.collect()}}
    return facts, "\n".join(["# Multiple choice\n", V.report("Hits in the first five", summary), V.report("References indexed", indexed)])


def relative(path: str) -> str:
    """T.relative_source for a string."""
    return path[path.rindex("src/") :] if "src/" in path else path


def compare_retrievers(retrievers: dict[str, DataFrame], targets: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """retriever, queries and recall_at_k of several retrievers' candidates."""
    out = None
    for name, found in retrievers.items():
        one = V.recall(V.target_ranks(found, targets), ks).select(F.lit(name).alias("retriever"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def session_records(events: DataFrame, registry: DataFrame, zone: str = "UTC", top: int = 3) -> tuple[DataFrame, DataFrame]:
    """(records, labels) of permissive retrieval events (query_id, ts, query_text, plan, candidates): a record for each session with its label, queries in order, each with its `top` candidates, scores to four decimals."""
    placed = E.sessions(events, tie="query_id")
    labelled = E.labels(E.first_events(placed), registry, zone).join(E.first_events(placed).select("session_id", "session_key"), "session_key")
    shown = F.transform(F.slice(F.array_sort("candidates", lambda a, b: a["fused_rank"] - b["fused_rank"]), 1, top), lambda c: F.struct(c["point_id"].alias("point_id"), F.round(c["fused_score"], 4).alias("fused_score"), T.rounded_scores(c["leg_scores"]).alias("leg_scores")))
    queries = placed.select("session_id", F.struct("ts", "query_id", "query_text", "plan", shown.alias("candidates")).alias("q"))
    before = lambda a, b, f: F.when(a[f] < b[f], -1).when(a[f] > b[f], 1)
    in_time = lambda a, b: F.coalesce(before(a, b, "ts"), before(a, b, "query_id"), F.lit(0))
    records = queries.groupBy("session_id").agg(F.array_sort(F.collect_list("q"), in_time).alias("queries"))
    return records.join(labelled.select("session_id", "session_key", "label"), "session_id"), labelled


def write_sessions(spark: SparkSession, events: DataFrame, out: str, zone: str = "UTC", force: bool = False) -> list[str]:
    """Writes each session as JSON with a README, an index and the registry of labels; folders that are there stay unless `force`. The labels that were written. A session is written by the driver, one at a time."""
    store = S.Store(spark, f"{out}/.registry")
    schema = "session_key string, label string"
    registry = store.read("labels") if store.exists("labels") else spark.createDataFrame([], schema)
    records, labelled = session_records(events, registry, zone)
    items = E.appearances(E.sessions(events, tie="query_id").select("session_id", F.explode("candidates").alias("c")).select("session_id", F.col("c.point_id").alias("item"), F.col("c.fused_rank").alias("rank")), "item", "rank")
    most = {r["session_id"]: r["item"] for r in E.most_appearing(items, "item").collect()}
    written, index = [], []
    for r in records.orderBy("session_id").toLocalIterator():
        folder, queries = f"{out}/{r['label']}", [q.asDict(True) for q in r["queries"]]
        index.append({"label": r["label"], "session": r["session_id"], "queries": len(queries), "most_appearing": most.get(r["session_id"])})
        if os.path.isdir(folder) and not force:
            continue
        os.makedirs(folder, exist_ok=True)
        with open(f"{folder}/session.json", "w") as f:
            json.dump({"label": r["label"], "session_key": r["session_key"], "queries": queries}, f, default=str, indent=1, sort_keys=True)
        lines = [f"# {r['label']}", ""] + [f"- {q['ts']} `{q['plan']}` {q['query_text']}: " + (", ".join(c["point_id"] for c in q["candidates"]) or "nothing") for q in queries]
        with open(f"{folder}/README.md", "w") as f:
            f.write("\n".join(lines) + "\n")
        written.append(r["label"])
    os.makedirs(out, exist_ok=True)
    with open(f"{out}/index.json", "w") as f:
        json.dump(index, f, indent=1)
    E.register(labelled, store)
    return written


def dump_symbols(chunks: DataFrame, path: str) -> None:
    """The symbol table as JSON lines."""
    from gleaner.operators.enrich import symbol_table

    symbol_table(chunks).coalesce(1).write.mode("overwrite").json(path)
