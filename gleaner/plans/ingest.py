"""Ingest into a Store: sources to chunks, enrichment, embeddings and postings; only what has changed is worked on, and what is gone is pruned.

The store has the tables points, vectors, postings, summaries and, for papers, papers. A point is worked on when it is new, has another content hash, or lacks one of the wanted
spaces. Fine points go with the coarse point that they are windows of.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators import chunking, embed, enrich
from gleaner.sources import store as S

DEFAULT = ("ctx__hashed",)
PAYLOAD = (
    "point_id string, text string, context_header string, llm_summary string, chunk_type string, module string, parent_class string, function_name string, math_terms array<string>, cross_refs array<string>, "
    "cross_ref_ids array<string>, has_numba boolean, source_file string, line_range struct<start:int,end:int>, granularity string, parent_id string, math_source_id string, content_hash string"
)
PAPER = "point_id string, text string, math_terms array<string>, section string, equation_labels array<string>, source_file string, content_hash string"
VECTOR, POSTING, SUMMARY = "point_id string, space string, embedding array<double>", "point_id string, term string, tf bigint", "content_hash string, summary string"


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns in its order; what isn't there is null, and empty for arrays."""
    wanted = df.sparkSession.createDataFrame([], schema).schema
    value = lambda f: F.col(f.name).cast(f.dataType) if f.name in df.columns else F.array().cast(f.dataType) if f.dataType.typeName() == "array" else F.lit(None).cast(f.dataType)
    return df.select(*[(F.coalesce(value(f), F.array().cast(f.dataType)) if f.dataType.typeName() == "array" else value(f)).alias(f.name) for f in wanted])


def function_name(kind: str, qualname: str) -> F.Column:
    return F.when(F.col(kind).isin("function", "method"), F.element_at(F.split(qualname, r"\."), -1))


def chunk_points(files: DataFrame, package: str) -> DataFrame:
    """Coarse chunks with their point_id and content_hash; the first of a file's chunks with one id counts."""
    chunks = chunking.code_chunks(files, package).withColumn("point_id", T.coarse_id(F.col("source_file"), F.col("module"), F.col("qualname")))
    return chunking.unique_chunks(chunks, "point_id", F.col("line_start")).withColumn("content_hash", T.content_hash(F.col("text")))


def coarse_payload(chunks: DataFrame, files: DataFrame, symbols: DataFrame, lexicon: DataFrame, cache: DataFrame, summarizer: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """Payload of coarse chunks, with cache_hit, and the summaries to cache. Headers see all chunks of `files`; cross references see all `symbols`."""
    headed = enrich.context_headers(chunks, files)
    facts = enrich.code_facts(headed)
    terms = enrich.lexicon_terms(chunks, lexicon, "point_id").withColumnRenamed("terms", "math_terms")
    refs = enrich.cross_references(facts.select("point_id", F.explode("calls").alias("name")), symbols)
    whole = facts.join(terms, "point_id", "left").join(refs, "point_id", "left")
    summed, fresh = enrich.summarise(whole, cache, summarizer)
    payload = summed.withColumns({"function_name": function_name("chunk_type", "qualname"), "line_range": F.struct(F.col("line_start").alias("start"), F.col("line_end").alias("end")), "granularity": F.lit("coarse")})
    return conform(payload, PAYLOAD).join(summed.select("point_id", "cache_hit"), "point_id"), fresh


def fine_payload(chunks: DataFrame, coarse: DataFrame) -> DataFrame:
    """Windows of the coarse chunks' functions; header, summary, terms, references and hash are the parent's."""
    own = chunking.fine_chunks(chunks).select("point_id", "parent_id", "text", "chunk_type", "module", "parent_class", "source_file", "granularity", F.struct(F.col("line_start").alias("start"), F.col("line_end").alias("end")).alias("line_range"))
    theirs = coarse.select(F.col("point_id").alias("parent_id"), "context_header", "llm_summary", "function_name", "math_terms", "cross_refs", "cross_ref_ids", "has_numba", "math_source_id", "content_hash")
    return conform(own.join(theirs, "parent_id"), PAYLOAD)


def paper_payload(papers: DataFrame) -> DataFrame:
    """Papers (text, source_file, section, math_terms, equation_labels, source) as points; rows of one id once."""
    rows = papers.withColumns({"point_id": T.paper_id(F.col("source_file"), F.col("section"), F.col("text")), "content_hash": T.content_hash(F.col("text"))})
    return conform(rows, PAPER).dropDuplicates(["point_id"])


def readme_payload(readme: DataFrame, most: int = chunking.SECTION_TOKENS) -> DataFrame:
    """Sections of a README (path, text), long ones by paragraphs, as coarse points of module README; parts without tokens are left out."""
    parts = chunking.subsections(chunking.sections(readme, "path"), most=most)
    rows = parts.withColumns({"point_id": T.readme_id(F.col("title"), F.col("paragraph_idx")), "chunk_type": F.lit("readme"), "module": F.lit("README"), "function_name": F.col("title"), "source_file": F.lit("README.md"), "granularity": F.lit("coarse"), "has_numba": F.lit(False), "content_hash": T.content_hash(F.col("text")), "context_header": F.lit(""), "llm_summary": F.lit("")})
    return conform(rows, PAYLOAD).filter(F.size(T.tokens(F.col("text"))) > 0).dropDuplicates(["point_id"])


def _tables(store: S.Store) -> None:
    for name, schema, by in (("points", PAYLOAD, ("granularity",)), ("vectors", VECTOR, ("space",)), ("postings", POSTING, ()), ("summaries", SUMMARY, ())):
        if not store.exists(name):
            store.create(name, store.spark.createDataFrame([], schema).schema, by)


def _write(store: S.Store, rows: DataFrame, spaces: list[str], registry: embed.Registry) -> None:
    """Points with their vectors and postings. Postings and vectors of the points' earlier text go first."""
    ids = rows.select("point_id")
    for table, made in (("vectors", embed.embed_spaces(rows, spaces, registry)), ("postings", embed.point_postings(rows))):
        kept = store.read(table).join(ids, "point_id", "left_anti") if table == "postings" else store.read(table).join(ids.crossJoin(store.spark.createDataFrame([(s,) for s in spaces], "space string")), ["point_id", "space"], "left_anti")
        store.write(table, kept.unionByName(made))
    store.upsert("points", rows)


def _prune(store: S.Store, gone: DataFrame) -> int:
    n = gone.count()
    if n:
        for table in ("points", "vectors", "postings"):
            store.delete(table, gone)
    return n


def ingest(store: S.Store, files: DataFrame, package: str, lexicon: DataFrame, spaces: list[str] | None = None, registry: embed.Registry | None = None, summarizer: Callable | None = None) -> DataFrame:
    """One run over a source tree (path, source): a row with seen, skipped, embedded, cache_hits, cache_misses (coarse chunks), pruned (points of either kind). Points of READMEs stay.

    Intermediate results that several writes need are tables in the shared folder, so nothing is parsed or summarised twice and a lost executor costs little."""
    spark = store.spark
    spaces, registry = S.requested_spaces(spaces, DEFAULT), registry or embed.Registry(embed.HASHED)
    for model in embed.needed(spaces):
        registry.get(model)  # an unknown one fails before anything is written
    _tables(store)
    work = S.Store(spark, S.scratch(spark, "ingest"))

    def kept(name: str, df: DataFrame) -> DataFrame:
        work.write(name, df)
        return work.read(name)

    chunks = kept("chunks", chunk_points(files, package))
    points = store.read("points")
    have = store.read("vectors").filter(F.col("space").isin(*spaces)).groupBy("point_id").agg(F.count_distinct("space").alias("have"))
    # A point without any vector in a wanted space may be one that has none there (com without comments); what counts is whether the first space, which all have, is there.
    first = store.read("vectors").filter(F.col("space") == spaces[0]).select("point_id")
    known = S.existing_hashes(points).join(first if len(spaces) == 1 else have.filter(F.col("have") > 0).select("point_id"), "point_id", "left_semi")
    new = kept("new", S.changed(chunks, known))
    symbols = enrich.symbol_table(chunks)
    payload, fresh = coarse_payload(new, files, symbols, lexicon, store.read("summaries"), summarizer)
    coarse = kept("coarse", payload)
    rows = kept("rows", coarse.drop("cache_hit").unionByName(fine_payload(new, coarse)))
    # Fine points of a changed chunk may be fewer than before.
    replaced = points.filter("granularity = 'fine'").join(new.select(F.col("point_id").alias("parent_id")), "parent_id", "left_semi").select("point_id").join(rows.select("point_id"), "point_id", "left_anti")
    gone_coarse = S.stale(points.filter("granularity = 'coarse' and module <> 'README'").select("point_id"), chunks)
    gone = kept("gone", gone_coarse.unionByName(points.filter("granularity = 'fine'").join(gone_coarse.withColumnRenamed("point_id", "parent_id"), "parent_id", "left_semi").select("point_id")).unionByName(replaced).distinct())
    _prune(store, gone)
    _write(store, rows, spaces, registry)
    store.upsert("summaries", kept("fresh", fresh), ("content_hash",))
    flagged = chunks.select("point_id").join(coarse.select("point_id", F.lit(True).alias("changed"), "cache_hit"), "point_id", "left").na.fill(False, ["changed", "cache_hit"])
    return S.run_counts(flagged).crossJoin(gone.agg(F.count(F.lit(1)).alias("pruned")))  # one row each


def ingest_readme(store: S.Store, readme: DataFrame, spaces: list[str] | None = None, registry: embed.Registry | None = None) -> int:
    """Points of a README; those of its earlier state that it hasn't any more are pruned. How many points it has."""
    spaces, registry = S.requested_spaces(spaces, DEFAULT), registry or embed.Registry(embed.HASHED)
    _tables(store)
    work = S.Store(store.spark, S.scratch(store.spark, "readme"))
    work.write("rows", readme_payload(readme))
    rows = work.read("rows")
    work.write("gone", S.stale(store.read("points").filter("module = 'README'"), rows))
    _prune(store, work.read("gone"))
    _write(store, rows, spaces, registry)
    return rows.count()


def ingest_papers(store: S.Store, papers: DataFrame, registry: embed.Registry | None = None, model: str = "hashed", space: str = "math__hashed") -> DataFrame:
    """Papers as points with vectors; coarse code points that share a term with a paper get the paper's vector in `space`, and math_source_id. The links are returned."""
    registry = registry or embed.Registry(embed.HASHED)
    _tables(store)
    work = S.Store(store.spark, S.scratch(store.spark, "papers"))
    work.write("papers", paper_payload(papers))
    rows = work.read("papers")
    store.upsert("papers", rows)
    work.write("vectors", registry.get(model).passages(rows.select("point_id", "text")))
    work.write("links", enrich.paper_links(store.read("points"), rows))
    links = work.read("links")
    taken = enrich.paper_vectors(links, work.read("vectors"), space)
    store.write("vectors", store.read("vectors").filter(F.col("space") != space).unionByName(taken))
    store.update("points", links)
    return links


def population_report(store: S.Store, spaces: list[str] | None = None) -> DataFrame:
    """measure, value: points of either kind, share of points with a vector in each space, share of coarse points with cross references, and with a summary."""
    points, total = store.read("points"), store.read("points").count()
    rate = lambda c: F.coalesce(F.count_if(c) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0))
    coarse = points.filter("granularity = 'coarse'").agg(rate(F.size("cross_refs") > 0).alias("cross_refs"), rate(F.coalesce("llm_summary", F.lit("")) != "").alias("summaries"))
    counts = points.groupBy(F.concat(F.lit("points_"), "granularity").alias("measure")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    rates = coarse.select(F.explode(F.create_map(F.lit("cross_refs"), "cross_refs", F.lit("summaries"), "summaries")).alias("measure", "value"))
    filled = store.read("vectors").filter(F.size("embedding") > 0).groupBy(F.concat(F.lit("space_"), "space").alias("measure")).agg((F.count_distinct("point_id") / F.lit(float(max(1, total)))).alias("value"))
    return counts.unionByName(rates).unionByName(filled)
