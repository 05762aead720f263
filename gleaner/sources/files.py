"""Readers of source trees, papers, lexicons, question banks and event logs."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD = (
    "query_text string, plan string, spaces array<string>, fusion string, filters string, reranker_id string, "
    "candidates array<struct<point_id:string,leg_scores:map<string,double>,fused_rank:int,fused_score:double>>, injected_ids array<string>, "
    "model string, response_text string, referenced_ids array<string>, unreferenced_ids array<string>, identifiers_not_in_retrieved array<string>, identifiers_not_in_package array<string>, result string, detail string"
)
EVENT = f"query_id string, event string, ts string, payload struct<{', '.join(f.replace(' ', ':', 1) for f in PAYLOAD.split(', '))}>"


def listed(spark: SparkSession, root: str, pattern: str) -> list[str]:
    """Paths of the files under a folder whose name matches. The driver lists them, as Spark's readers do, but without leaving out names with an underscore before them, as package files have."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found, out = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while found.hasNext():
        p = found.next().getPath()
        if fnmatch.fnmatchcase(p.getName(), pattern):
            out.append(p.toString())
    return out


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            system, path = FileSystem.from_uri(uri)
            with system.open_input_stream(path) as f:
                source = f.read().decode("utf-8", "replace")
            yield pa.RecordBatch.from_arrays([pa.array([re.sub("^file:/+", "/", uri)]), pa.array([source], pa.string())], ["path", "source"])


def whole_files(spark: SparkSession, root: str | list[str], pattern: str = "*.py") -> DataFrame:
    """path, source of every file under the folders whose name matches; each path once. Workers read the files, from any file system that they can reach."""
    uris = set()
    for r in [root] if isinstance(root, str) else root:
        if "://" not in r and not os.path.exists(r):
            raise FileNotFoundError(f"no folder {r}")
        uris.update(re.sub("^file:/+", "file:///", p) for p in listed(spark, r, pattern))
    cores = spark.sparkContext.defaultParallelism
    return spark.createDataFrame([(u,) for u in sorted(uris)], "uri string").repartition(max(1, min(len(uris), 4 * cores))).mapInArrow(_read, "path string, source string")


def source_files(spark: SparkSession, package: str) -> DataFrame:
    """A package's Python files and those of a tests folder beside it."""
    tests = os.path.join(os.path.dirname(package.rstrip("/")), "tests")
    return whole_files(spark, [package, tests] if os.path.isdir(tests) else package)


def papers(spark: SparkSession, folder: str) -> DataFrame:
    """text, source_file, section, math_terms, equation_labels, source: Markdown with what a JSON file of the same stem says of it. Blank ones are left out."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1)
    texts = whole_files(spark, folder, "*.md").select(stem.alias("stem"), F.col("path").alias("source_file"), F.regexp_replace("source", r"^\s+|\s+$", "").alias("text")).filter("text <> ''")
    schema = "section string, math_terms array<string>, equation_labels array<string>, source string"
    facts = whole_files(spark, folder, "*.json").select(stem.alias("stem"), F.from_json("source", schema).alias("j"))
    none = F.array().cast("array<string>")
    return texts.join(facts, "stem", "left").select("text", "source_file", F.coalesce("j.section", "stem").alias("section"), F.coalesce("j.math_terms", none).alias("math_terms"), F.coalesce("j.equation_labels", none).alias("equation_labels"), F.coalesce("j.source", F.lit("")).alias("source"))


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """term, position of a JSON array of strings."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("position", "term"))


def readme(spark: SparkSession, path: str) -> DataFrame:
    """path, text: the whole file."""
    return spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("text"))


def json_table(spark: SparkSession, path: str, schema: str, limit: int | None = None) -> DataFrame:
    """Rows of a JSON array (questions, tasks, summaries); with `limit` its first ones, in file order."""
    if limit is None:
        return spark.read.schema(schema).json(path, multiLine=True)
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", f"array<struct<{', '.join(f.strip().replace(' ', ':', 1) for f in split_fields(schema))}>>")).alias("place", "row"))
    return rows.filter(F.col("place") < limit).orderBy("place").select("row.*")


def split_fields(schema: str) -> list[str]:
    """The fields of a DDL string; commas within <> don't part them."""
    out, depth = [""], 0
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def with_summaries(chunks: DataFrame, summaries: DataFrame) -> DataFrame:
    """Chunks (function_name, class_name) with `summary`, "" where none is given for the function and class."""
    theirs = summaries.select(F.col("function_name").alias("_f"), F.coalesce("class_name", F.lit("")).alias("_c"), F.col("summary").alias("_s")).dropDuplicates(["_f", "_c"])
    same = (F.col("function_name") == F.col("_f")) & (F.coalesce("class_name", F.lit("")) == F.col("_c"))
    return chunks.join(theirs, same, "left").withColumn("summary", F.coalesce("_s", F.lit(""))).drop("_f", "_c", "_s")


def event_log(spark: SparkSession, path: str, strict: bool = True, stream: bool = False) -> DataFrame:
    """Events of a log of JSON lines, ts as a timestamp. Strict: a line that can't be read is an error. Otherwise such lines and blank ones are left out, as are events other
    than retrievals, and missing fields get defaults."""
    reader = spark.readStream if stream else spark.read
    if strict:
        return reader.schema(EVENT).json(path, mode="FAILFAST").withColumn("ts", F.to_timestamp("ts"))
    raw = reader.schema(EVENT + ", _bad string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    good = raw.filter("_bad is null and event = 'retrieval' and ts is not null").drop("_bad")
    return good.select(F.coalesce("query_id", F.lit("")).alias("query_id"), "event", F.to_timestamp("ts").alias("ts"), F.coalesce("payload.query_text", F.lit("")).alias("query_text"), F.coalesce("payload.plan", F.lit("unknown")).alias("plan"), F.coalesce("payload.candidates", F.array().cast("array<struct<point_id:string,leg_scores:map<string,double>,fused_rank:int,fused_score:double>>")).alias("candidates"))
