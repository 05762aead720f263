"""A store of points, vectors and postings in Parquet: each table is a folder of numbered versions, the last finished one being current.

A write makes a new version from the old one; it counts once Spark has marked it as finished, so readers see whole versions and a failed write changes nothing.
"""

from __future__ import annotations

import atexit
import json
import re
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SPACE = re.compile(r"^(?P<kind>[a-z]+)__(?P<model>[a-z0-9]+)$")
MODELS = {"jinacode": 896, "qwen3": 1024, "unixcoder": 768, "hashed": 64}
KINDS = ("ctx", "code", "codecom", "com", "summary", "math", "paper")
FINE_SPACES = ("ctx__jinacode", "ctx__hashed")
INDEXED = ("granularity", "module", "chunk_type", "parent_class", "function_name", "math_terms", "source_file", "has_numba")


def parse_space(space: str) -> tuple[str, str, int, bool]:
    """Representation, model, dimensions, whether the space is quantised (those of 1,024 are)."""
    found = SPACE.match(space)
    if not found or found["kind"] not in KINDS or found["model"] not in MODELS:
        raise ValueError(f"unknown vector space {space!r}")
    dims = MODELS[found["model"]]
    return found["kind"], found["model"], dims, dims == 1024


def requested_spaces(spaces: list[str] | None, default: tuple[str, ...] = ("ctx__hashed",)) -> list[str]:
    """The spaces asked for or the default, each once in order, all known."""
    out = list(dict.fromkeys(spaces or default))
    for s in out:
        parse_space(s)
    return out


def check_schema(found: StructType, wanted: StructType) -> None:
    """Raises with the field's name if a field is missing, extra or of another type."""
    have, want = ({f.name: f.dataType.simpleString() for f in s} for s in (found, wanted))
    for name in want:
        if name not in have:
            raise ValueError(f"field {name!r} is missing")
        if have[name] != want[name]:
            raise ValueError(f"field {name!r} is {have[name]}, not {want[name]}")
    for name in have:
        if name not in want:
            raise ValueError(f"field {name!r} isn't in the schema")


def check_vectors(vectors: DataFrame, spaces: list[str]) -> None:
    """Raises if a space isn't declared or has a vector of another length."""
    for r in vectors.groupBy("space").agg(F.collect_set(F.size("embedding")).alias("sizes")).collect():  # a row for each space
        if r["space"] not in spaces:
            raise ValueError(f"space {r['space']!r} isn't declared")
        if set(r["sizes"]) - {parse_space(r["space"])[2]}:
            raise ValueError(f"space {r['space']!r} has vectors of {sorted(r['sizes'])} dimensions")


def check_config(found: dict, wanted: dict) -> None:
    """Raises with its name if a space of the collection is missing or extra, or has another size, distance, model or quantisation; `sparse` must be of terms and have no idf applied."""
    for name in sorted(wanted.keys() | found.keys()):
        if name not in found or name not in wanted:
            raise ValueError(f"space {name!r} is {'missing' if name not in found else 'not wanted'}")
        for field in sorted(wanted[name].keys() | found[name].keys()):
            if found[name].get(field) != wanted[name].get(field):
                raise ValueError(f"space {name!r} has {field} {found[name].get(field)!r}, not {wanted[name].get(field)!r}")


def collection(spaces: tuple[str, ...]) -> dict:
    """What check_config compares: dense spaces, and the sparse one that all points have."""
    return {s: json.loads(config(s)) for s in spaces} | {"bm25_code": {"kind": "sparse", "modifier": "none"}}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder in spark.checkpoint.dir, which executors share; a local one, which goes at exit, only where that is unset and there is but one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="store-")
        atexit.register(shutil.rmtree, base, True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Store:
    """Tables under a folder that Hadoop's file systems can reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _versions(self, table: str) -> list[str]:
        """Names of the finished versions, the oldest first."""
        fs, path = self._fs(f"{self.root}/{table}")
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        return sorted(n for n in names if n.startswith("v") and fs.exists(self._fs(f"{self.root}/{table}/{n}/_SUCCESS")[1]))

    def _pointer(self, table: str) -> str | None:
        versions = self._versions(table)
        return versions[-1] if versions else None

    def exists(self, table: str) -> bool:
        return self._pointer(table) is not None

    def _meta(self, table: str, version: str) -> dict:
        """Schema and partition columns, which are written before the version is."""
        fs, path = self._fs(f"{self.root}/{table}/_{version}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str) -> DataFrame:
        version = self._pointer(table)
        if version is None:
            raise FileNotFoundError(f"no table {table} in {self.root}")
        schema = StructType.fromJson(self._meta(table, version)["schema"])
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}/{version}")

    def layout(self, table: str) -> tuple[str, ...]:
        """Columns by which the current version is partitioned."""
        version = self._pointer(table)
        return tuple(self._meta(table, version)["partition_by"]) if version else ()

    def write(self, table: str, df: DataFrame, partition_by: tuple[str, ...] | None = None, sort_by: tuple[str, ...] = ()) -> None:
        """Partitioned as it was, unless `partition_by` says otherwise. `sort_by` orders rows within files, so that their statistics prune."""
        last = self._pointer(table)
        partition_by = self.layout(table) if partition_by is None and last else partition_by or ()
        df = df.select(*[c for c in df.columns if c not in partition_by], *partition_by)
        df = df.sortWithinPartitions(*partition_by, *sort_by) if sort_by else df
        version = f"v{int(last[1:13]) + 1 if last else 0:012d}-{uuid.uuid4().hex}"
        fs, path = self._fs(f"{self.root}/{table}/_{version}.json")
        stream = fs.create(path)
        stream.write(json.dumps({"schema": df.schema.jsonValue(), "partition_by": partition_by}).encode())
        stream.close()
        df.write.partitionBy(*partition_by).parquet(f"{self.root}/{table}/{version}")

    def expire(self, table: str, keep: int = 2) -> None:
        """Deletes all but the last versions."""
        for name in self._versions(table)[:-keep]:
            for old in (name, f"_{name}.json"):
                fs, path = self._fs(f"{self.root}/{table}/{old}")
                fs.delete(path, True)

    def ensure_index(self, table: str, columns: tuple[str, ...] = INDEXED) -> bool:
        """Once for a table and set of columns: rows are ordered by the payload columns that filters name, so that row groups are skipped by their statistics."""
        present = [c for c in columns if c in self.read(table).columns and not dict(self.read(table).dtypes)[c].startswith("array")]
        fs, mark = self._fs(f"{self.root}/{table}/_index-{'-'.join(present)}")
        if fs.exists(mark):
            return False
        df = self.read(table)
        self.write(table, df.repartitionByRange(*present) if present else df, sort_by=tuple(present))
        fs.create(mark).close()
        return True

    def create(self, table: str, schema: StructType, partition_by: tuple[str, ...] = ()) -> bool:
        """Makes an empty table if there is none; otherwise its schema must be the wanted one."""
        if self.exists(table):
            check_schema(self.read(table).schema, schema)
            return False
        self.write(table, self.spark.createDataFrame([], schema), partition_by)
        return True

    def upsert(self, table: str, rows: DataFrame, key: tuple[str, ...] = ("point_id",), partition_by: tuple[str, ...] | None = None, order: tuple[str, ...] = ()) -> None:
        """Rows replace those of equal key. Of rows with one key the last wins: by the columns of `order`, or as they come where none are given."""
        self.write(table, merged(self.read(table), rows, key, order) if self.exists(table) else last_of(rows, key, order), partition_by)

    def update(self, table: str, changes: DataFrame, key: tuple[str, ...] = ("point_id",)) -> None:
        """Sets the columns of `changes` where they aren't null."""
        self.write(table, updated(self.read(table), changes, key))

    def delete(self, table: str, ids: DataFrame, key: tuple[str, ...] = ("point_id",)) -> None:
        self.write(table, self.read(table).join(ids.select(*key), [*key], "left_anti"))

    def load(self, table: str, rows: DataFrame, recreate: bool = False) -> int:
        """A bulk load whose count is checked; rows are evaluated once and counted on their way."""
        if self.exists(table) and not recreate:
            raise ValueError(f"table {table} exists")
        seen = Observation()
        self.write(table, rows.observe(seen, F.count(F.lit(1)).alias("n")))
        found, wanted = self.read(table).count(), seen.get["n"]
        if found != wanted:
            raise ValueError(f"{found} rows of {wanted} in {table}")
        return found

    def scroll(self, table: str, condition=None, columns: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
        df = self.read(table)
        df = df if condition is None else df.filter(condition)
        df = df.select(*columns) if columns else df
        return df if limit is None else df.limit(limit)

    def has_points(self, table: str) -> bool:
        return self.exists(table) and not self.read(table).isEmpty()


def last_of(rows: DataFrame, key: tuple[str, ...], order: tuple[str, ...] = ()) -> DataFrame:
    """One row for each key: the last by the columns of `order`, or as they come."""
    place = F.struct(*order) if order else F.monotonically_increasing_id()
    others = [c for c in rows.columns if c not in key]
    if not others:
        return rows.distinct()
    last = rows.withColumn("_place", place).groupBy(*key).agg(F.max_by(F.struct(*others), "_place").alias("_last"))
    return last.select(*[F.col(c) if c in key else F.col(f"_last.{c}").alias(c) for c in rows.columns])


def merged(old: DataFrame, new: DataFrame, key: tuple[str, ...], order: tuple[str, ...] = ()) -> DataFrame:
    return old.join(new.select(*key), [*key], "left_anti").unionByName(last_of(new, key, order), allowMissingColumns=True)


def look_up(points: DataFrame, ids: DataFrame, key: str = "point_id") -> DataFrame:
    """Points of ids (key, place) in the order of `place`; ids that aren't there are left out."""
    return points.join(ids.select(key, "place"), key).orderBy("place")


def existing(points: DataFrame, ids: DataFrame, key: str = "point_id") -> DataFrame:
    """The distinct ids, null ones aside, that are there."""
    return ids.select(key).filter(F.col(key).isNotNull()).distinct().join(points.select(key), key, "left_semi")


def existing_hashes(points: DataFrame) -> DataFrame:
    """point_id, content_hash of coarse points that have one."""
    return points.filter("granularity = 'coarse' and content_hash is not null").select("point_id", "content_hash")


def updated(old: DataFrame, changes: DataFrame, key: tuple[str, ...]) -> DataFrame:
    values = [c for c in changes.columns if c not in key]
    renamed = changes.select(*key, *[F.col(c).alias(f"_new_{c}") for c in values])
    joined = old.join(renamed, [*key], "left")
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in values else F.col(c) for c in old.columns])


def changed(current: DataFrame, existing: DataFrame, key: tuple[str, ...] = ("point_id",), hash_col: str = "content_hash") -> DataFrame:
    """Rows of `current` that are new or have another hash; with the space in the key, a space that is new counts as well."""
    known = existing.select(*key, F.col(hash_col).alias("_old"), F.lit(True).alias("_known"))
    return current.join(known, [*key], "left").filter(F.col("_known").isNull() | ~F.col(hash_col).eqNullSafe(F.col("_old"))).drop("_old", "_known")


def stale(existing: DataFrame, current: DataFrame, key: tuple[str, ...] = ("point_id",)) -> DataFrame:
    """Ids to prune: those that the sources don't give any more."""
    return existing.select(*key).join(current.select(*key), [*key], "left_anti")


def run_counts(flagged: DataFrame) -> DataFrame:
    """One row: seen, skipped, embedded, cache_hits, cache_misses, of rows flagged `changed` and `cache_hit`."""
    return flagged.agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(~F.col("changed")).alias("skipped"), F.count_if("changed").alias("embedded"), F.count_if(F.col("changed") & F.col("cache_hit")).alias("cache_hits"), F.count_if(F.col("changed") & ~F.col("cache_hit")).alias("cache_misses")
    )


def from_columns(export: DataFrame) -> DataFrame:
    """Rows of a column-oriented export (ids, documents, metadatas, embeddings); raises if they differ in length or are empty."""
    names = ("ids", "documents", "metadatas", "embeddings")
    missing = [n for n in names if n not in export.columns]
    if missing:
        raise ValueError(f"the export has no {', '.join(missing)}")
    same = reduce(lambda a, b: a & b, [F.size(n) == F.size("ids") for n in names[1:]])
    ok = F.when(same & (F.size("ids") > 0), F.lit(True)).otherwise(F.raise_error(F.lit("the export's columns are empty or differ in length")))
    zipped = export.withColumn("_ok", ok).filter("_ok").select(F.explode(F.arrays_zip(*names)).alias("z"))
    return zipped.select(F.col("z.ids").alias("point_id"), F.col("z.documents").alias("text"), F.col("z.metadatas").alias("metadata"), F.col("z.embeddings").alias("embedding"))


def config(space: str) -> str:
    kind, model, dims, quantised = parse_space(space)
    return json.dumps({"distance": "cosine", "model": model, "quantised": quantised, "representation": kind, "size": dims}, sort_keys=True)
