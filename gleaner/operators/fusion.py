"""Reciprocal rank fusion of ranked legs, rerankers, prompt packing."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions.text import context_text, lexical_overlap
from gleaner.operators.scan import named
from gleaner.operators.sparse import DIGITS, plain_unions, ranked

CONSTANT, WIDTH = 60, 20


def prefetch(k: int) -> int:
    """How deep a leg is ranked."""
    return k if k > WIDTH else WIDTH


def fuse(legs: dict[str, DataFrame], k: int, weights: dict[str, float] | None = None, id_col: str = "doc_id", constant: int = CONSTANT, offset: int = 1) -> DataFrame:
    """query_id, id, fused_rank (from 0), fused_score, leg_scores. A leg adds weight / (constant + rank + offset); a document has 0 for a leg that lacks it."""
    plain_unions(next(iter(legs.values())).sparkSession)
    weights = weights or {}
    parts = [leg.select("query_id", id_col, F.lit(name).alias("leg"), "score", (F.lit(float(weights.get(name, 1.0))) / (constant + F.col("rank") + offset)).alias("part")) for name, leg in legs.items()]
    merged = reduce(DataFrame.unionByName, parts).groupBy("query_id", id_col).agg(F.round(F.sum("part"), DIGITS).alias("score"), F.map_from_entries(F.collect_list(F.struct("leg", "score"))).alias("found"))
    best = ranked(merged, k, id_col)
    scores = F.create_map(*[x for name in legs for x in (F.lit(name), F.coalesce(F.element_at("found", name), F.lit(0.0)))])
    return best.select("query_id", id_col, F.col("rank").alias("fused_rank"), F.col("score").alias("fused_score"), scores.alias("leg_scores"))


def renumber(candidates: DataFrame, *order: Column) -> DataFrame:
    return candidates.withColumn("fused_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)) - 1)


def rerank(candidates: DataFrame, score: Column | None, k: int | None = None) -> DataFrame:
    """Orders by `score`, adds it to leg_scores as rerank; earlier rank first on ties. None leaves scores and order as they are."""
    if score is None:
        out = renumber(candidates, F.col("fused_rank"))
    else:
        scored = candidates.withColumn("_s", score.cast("double"))
        out = renumber(scored, F.desc("_s"), F.col("fused_rank")).withColumn("leg_scores", F.map_concat(F.map_filter("leg_scores", lambda n, _: n != "rerank"), F.create_map(F.lit("rerank"), "_s"))).drop("_s")
    return out if k is None else out.filter(F.col("fused_rank") < k)


@dataclass(frozen=True)
class Reranker:
    """`score` is a function of the query's and the candidate's text; a model is a vectorised UDF. None changes nothing."""

    name: str
    score: Callable[[Column, Column], Column] | None


NO_OP = Reranker("none", None)
LEXICAL = Reranker("lexical-overlap", lexical_overlap)


def reranker_id(reranker: Reranker | None) -> str:
    return (reranker or NO_OP).name


def candidate_text(columns: list[str]) -> Column:
    """What a reranker reads of a point: its summary and header, where it has them, before its text."""
    return context_text(*[F.coalesce(c, F.lit("")) for c in ("llm_summary", "context_header", "text") if c in columns])


def rerank_with(candidates: DataFrame, queries: DataFrame, points: DataFrame, reranker: Reranker, k: int | None = None) -> DataFrame:
    """The same with a Reranker: texts are joined to the candidates alone."""
    if reranker.score is None:
        return rerank(candidates, None, k)
    asked = queries.select("query_id", F.col("text").alias("_query"))
    theirs = points.select("doc_id", candidate_text(points.columns).alias("_candidate"))
    candidates = candidates.persist(StorageLevel.MEMORY_AND_DISK)
    joined = candidates.join(asked, "query_id").join(named(theirs, candidates), "doc_id", "left")
    return rerank(joined, reranker.score(F.col("_query"), F.coalesce("_candidate", F.lit(""))), k).select(*candidates.columns)


def pack_prompt(candidates: DataFrame, most: int = 8000) -> DataFrame:
    """The first candidates of each query whose texts are together no longer than `most`; nothing after the first that is too much."""
    so_far = F.sum(F.length("text")).over(Window.partitionBy("query_id").orderBy("fused_rank").rowsBetween(Window.unboundedPreceding, 0))
    return candidates.withColumn("chars", so_far).filter(F.col("chars") <= most)
