"""Verification and evaluation: invariants, recall, comparisons of retrievers, multiple-choice questions, sessions' reports."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import scan

GATE = 0.8


def dangling(refs: DataFrame, ref: str, known: DataFrame, key: str) -> DataFrame:
    """One row, n: references that resolve to nothing; null and empty ones count, and repeated ones each time."""
    ids = known.select(F.col(key).cast("string").alias("_id")).distinct()
    asked = refs.select(F.nullif(F.col(ref).cast("string"), F.lit("")).alias("_ref"))
    return asked.join(ids, asked["_ref"] == ids["_id"], "left_anti").agg(F.count(F.lit(1)).alias("n"))


def invariants(checks: dict[str, DataFrame]) -> DataFrame:
    """One row: each check's count of offences (its column n), and whether all are 0."""
    out = None
    for name, df in checks.items():
        one = df.select(F.col("n").alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out.withColumn("passed", F.greatest(F.lit(0), *[F.col(c) for c in checks]) == 0)


def population(vectors: DataFrame, total: int) -> DataFrame:
    """space, populated, rate."""
    n = F.count_if(F.coalesce(F.size("embedding") > 0, F.lit(False)))
    return vectors.groupBy("space").agg(n.alias("populated"), T.rate(n, F.lit(total)).alias("rate"))


def target_ranks(candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """query_id, first_rank (null if the target isn't among them) for each query of targets (query_id, doc_id)."""
    hits = candidates.join(targets, ["query_id", "doc_id"]).groupBy("query_id").agg(F.min("fused_rank").alias("first_rank"))
    return targets.select("query_id").distinct().join(hits, "query_id", "left")


def recall(ranks: DataFrame, ks: tuple[int, ...] = (3, 5, 10), by: str | None = None) -> DataFrame:
    """queries and recall_at_k, for each group and, as `all`, together; the denominator is the number of queries."""
    measures = [F.count(F.lit(1)).alias("queries"), *[T.rate(F.count_if(F.col("first_rank") < k), F.count(F.lit(1))).alias(f"recall_at_{k}") for k in ks]]
    if by is None:
        return ranks.agg(*measures)
    return ranks.rollup(by).agg(F.grouping(by).alias("_g"), *measures).withColumn(by, F.when(F.col("_g") == 1, F.lit("all")).otherwise(F.col(by))).drop("_g")


def gate(summary: DataFrame, least: float = GATE) -> DataFrame:
    return summary.withColumn("passed", F.col("recall_at_5") >= least)


def compare(a: DataFrame, b: DataFrame, k: int = 3) -> DataFrame:
    """query_id, change: regressed or recovered from one retriever's target ranks to another's."""
    hit = lambda c: F.coalesce(F.col(c) < k, F.lit(False))
    both = a.select("query_id", F.col("first_rank").alias("ra")).join(b.select("query_id", F.col("first_rank").alias("rb")), "query_id")
    return both.filter(hit("ra") != hit("rb")).select("query_id", F.when(hit("ra"), "regressed").otherwise("recovered").alias("change"))


def parity(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """query_id, equal, first_difference: whether two retrievers have the same ids in the same order up to k."""
    left = a.filter(F.col("fused_rank") < k).select("query_id", "fused_rank", F.col("doc_id").alias("ia"))
    right = b.filter(F.col("fused_rank") < k).select("query_id", "fused_rank", F.col("doc_id").alias("ib"))
    first = F.min(F.when(~F.col("ia").eqNullSafe(F.col("ib")), F.col("fused_rank")))
    return left.join(right, ["query_id", "fused_rank"], "full").groupBy("query_id").agg(first.alias("first_difference")).withColumn("equal", F.col("first_difference").isNull())


def covers(source_file: Column, start: Column, end: Column, ref: Column) -> Column:
    """Whether a chunk (its file and lines) covers a reference struct(file, start, end). A README matches by its name; lines 0 to 0 stand for a whole file."""
    overlap = ref["start"].isNull() | ref["end"].isNull() | ((start == 0) & (end == 0)) | ((end >= ref["start"]) & (start <= ref["end"]))
    return F.when(ref["file"] == "README.md", source_file == "README.md").otherwise(F.endswith(source_file, ref["file"]) & overlap)


def mcq_hits(candidates: DataFrame, questions: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """id, hit_at_k: whether one of the first k candidates (id, fused_rank, source_file, line_start, line_end) covers one of the question's source_refs."""
    refs = questions.select("id", F.explode("source_refs").alias("r")).select("id", T.parse_ref(F.col("r")).alias("ref"))
    met = candidates.join(refs, "id").filter(covers(F.col("source_file"), F.col("line_start"), F.col("line_end"), F.col("ref"))).groupBy("id").agg(F.min("fused_rank").alias("at"))
    return questions.join(met, "id", "left").select(*questions.columns, *[F.coalesce(F.col("at") < k, F.lit(False)).alias(f"hit_at_{k}") for k in ks])


def indexability(refs: Column, indexed: list[str]) -> Column:
    known = lambda r: (T.parse_ref(r)["file"] == "README.md") | T.parse_ref(r)["file"].isin(*indexed)
    return F.when(~F.exists(refs, known), "none").when(F.forall(refs, known), "full").otherwise("partial")


def mcq_summary(hits: DataFrame, k: int = 5) -> DataFrame:
    """difficulty, category, questions, rate: by each, and over all (both null)."""
    sets = [[F.col("difficulty")], [F.col("category")], []]
    return hits.groupingSets(sets, "difficulty", "category").agg(F.count(F.lit(1)).alias("questions"), F.avg(F.col(f"hit_at_{k}").cast("double")).alias("rate"))


def pass_rate(results: DataFrame) -> DataFrame:
    """One row: passed, judged, rate, of rows without flags; and a count for each flag is `flag_counts`."""
    judged = F.size(F.coalesce("flags", F.array().cast("array<string>"))) == 0
    ok, n = F.count_if(judged & F.col("correct")), F.count_if(judged)
    return results.agg(ok.alias("passed"), n.alias("judged"), T.rate(ok, n).alias("rate"))


def flag_counts(results: DataFrame) -> DataFrame:
    return results.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


def unknown_identifiers(generated: DataFrame) -> DataFrame:
    """Adds what a response names that neither retrieval nor the package has (arrays named, retrieved, package)."""
    return generated.withColumn("identifiers_not_in_retrieved", F.array_except("named", "retrieved")).withColumn("identifiers_not_in_package", F.array_except("named", "package"))


def vector_parity(old: DataFrame, new: DataFrame, most: float = 1e-5) -> DataFrame:
    """One row: missing, changed_text, off (vectors that differ by more than `most`)."""
    from gleaner.functions.vectors import max_abs_diff

    right = new.select("point_id", F.col("text").alias("_t"), F.col("embedding").alias("_v"), F.lit(True).alias("_in"))
    both = old.join(right, "point_id", "left")
    return both.agg(F.count_if(F.col("_in").isNull()).alias("missing"), F.count_if(F.col("_in") & ~F.col("text").eqNullSafe(F.col("_t"))).alias("changed_text"), F.count_if(F.col("_in") & (max_abs_diff(F.col("embedding"), F.col("_v")) > most)).alias("off"))


def report(title: str, rows: DataFrame, most: int = 100_000) -> str:
    """A Markdown table of a summary, all of it; one of more rows than `most` is refused."""
    head = rows.columns
    lines = [f"## {title}", "", "| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    found = rows.orderBy(*head).take(most + 1)
    if len(found) > most:
        raise ValueError(f"{title} has more than {most} rows: write it as a table")
    for r in found:
        lines.append("| " + " | ".join(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |")
    return "\n".join(lines) + "\n"


def set_comparison(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: both, left_only, right_only (distinct keys), equal."""
    left, right = a.select(key).distinct().withColumn("_a", F.lit(1)), b.select(key).distinct().withColumn("_b", F.lit(1))
    sides = left.join(right, key, "full").agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"), F.count_if(F.col("_b").isNull()).alias("left_only"), F.count_if(F.col("_a").isNull()).alias("right_only"))
    return sides.withColumn("equal", F.col("left_only") + F.col("right_only") == 0)


def collisions(rows: DataFrame, key: str) -> DataFrame:
    """One row, n: rows whose key an earlier one has."""
    return rows.agg((F.count(key) - F.count_distinct(key)).alias("n"))


def validation_counts(results: DataFrame) -> DataFrame:
    """difficulty, passed, total of results (difficulty, passed)."""
    return results.groupBy("difficulty").agg(F.count_if("passed").alias("passed"), F.count(F.lit(1)).alias("total"))


def rank_rows(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """query_id, fused_rank, left_id, right_id, same: two retrievers rank by rank up to k."""
    left, right = (x.filter(F.col("fused_rank") < k).select("query_id", "fused_rank", F.col("doc_id").alias(c)) for x, c in ((a, "left_id"), (b, "right_id")))
    return left.join(right, ["query_id", "fused_rank"], "full").withColumn("same", F.col("left_id").eqNullSafe(F.col("right_id")))


def parities(a: DataFrame, b: DataFrame, ks: tuple[int, ...] = (3, 5, 10)) -> DataFrame:
    """k, queries, equal: of how many queries both retrievers have the same ids in the same order up to each k; one join for all k."""
    first = F.min(F.when(~F.col("same"), F.col("fused_rank")))
    found = rank_rows(a, b, max(ks)).groupBy("query_id").agg(first.alias("at"))
    return found.select(F.explode(F.array(*map(F.lit, ks))).alias("k"), "at").groupBy("k").agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("at").isNull() | (F.col("at") >= F.col("k"))).alias("equal"))


def top_each(candidates: DataFrame, n: int = 5) -> DataFrame:
    """query_id, top: the first n ids of each query in order, for a report."""
    listed = F.array_sort(F.collect_list(F.struct("fused_rank", "doc_id")))
    return candidates.filter(F.col("fused_rank") < n).groupBy("query_id").agg(F.transform(listed, lambda x: x["doc_id"]).alias("top"))


def wide_ranks(candidates: DataFrame, targets: DataFrame, points: DataFrame, top: int = 10) -> DataFrame:
    """query_id, first_rank, mentioned: the target's rank in a wide pool, and whether one of the first texts names its symbol (targets has symbol)."""
    candidates = candidates.persist(StorageLevel.MEMORY_AND_DISK)
    first = candidates.filter(F.col("fused_rank") < top)
    texts = first.join(scan.named(points.select("doc_id", "text"), first), "doc_id").join(targets.select("query_id", "symbol").distinct(), "query_id")
    named = texts.groupBy("query_id").agg(F.max(F.contains("text", "symbol")).alias("mentioned"))
    return target_ranks(candidates, targets).join(named, "query_id", "left").withColumn("mentioned", F.coalesce("mentioned", F.lit(False)))
