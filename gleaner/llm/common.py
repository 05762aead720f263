"""Shared pieces of the training-data operators: text to words, hashes, packed blocks, shared folders.

Words are maximal runs of ASCII letters, digits, underscores and all characters beyond ASCII, in the lower-cased text. A null
text has no words. They are found, and hashed, for whole Arrow batches at once; no Python object is made for a word.
"""

from __future__ import annotations

import atexit
import ctypes
import math
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

if TaskContext.get() is not None and hasattr(ctypes.CDLL(None), "mallopt"):
    # In a worker large blocks of memory go back to the system when they are freed, Arrow's too, so that what one stage needed isn't kept through the next.
    ctypes.CDLL(None).mallopt(-3, 4 << 20)
    pa.set_memory_pool(pa.system_memory_pool())



def give_back() -> None:
    """Freed memory of this process goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


WORD = re.compile(r"[a-z0-9_\u0080-\U0010ffff]+")
MIX = np.uint64(0x9E3779B97F4A7C15)
SEED = 20240607
ROWS_AT_ONCE = "spark.sql.execution.arrow.maxRecordsPerBatch"


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


_IN_WORD = np.array([c >= 128 or chr(c).isalnum() or c == 95 for c in range(256)])
_POWERS = np.ones(1, np.uint64)
_INVERSES = np.ones(1, np.uint64)
_BASE = 0xD6E8FEB86659FD93
#: Powers that a worker keeps.
KEPT = 1 << 22


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; those for usual lengths are kept, those for a very long text aren't."""
    global _POWERS, _INVERSES
    if len(_POWERS) >= n:
        return _POWERS[:n], _INVERSES[:n]
    size = max(1 << 16, n if n > KEPT else 1 << (n - 1).bit_length())
    base, inverse = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    base[0] = inverse[0] = 1
    found = np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    if size <= KEPT:
        _POWERS, _INVERSES = found
    return found[0][:n], found[1][:n]


class Words:
    """The words of some consecutive documents: `hashes` (64 bits each), byte offsets `starts` and `ends` in the UTF-8 of `lowered`, and `bounds`: document i has the words bounds[i]:bounds[i + 1]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        inside = _IN_WORD[data]
        inside = np.concatenate(([False], inside, [False]))
        edges = inside[1:] != inside[:-1]
        cut = np.unique(offsets)
        cut = cut[inside[cut] & inside[cut + 1]]  # one document ends in a word and the next begins with one
        at = np.sort(np.concatenate((np.flatnonzero(edges), cut, cut)))
        self.starts, self.ends = at[0::2], at[1::2]
        power, inverse = _powers(len(data) + 1)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)))
            self.hashes = mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts])
        self.bounds = np.searchsorted(self.starts, offsets)
        self.data, self.offsets = data, offsets


def words_of(texts: pa.Array, most_bytes: int = 400_000) -> Iterator[tuple[int, int, Words]]:
    """(first, end, Words) over documents first:end of an Arrow string column, some MB at a time; a longer document comes alone."""
    texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(ends, ends[first] + most_bytes, "right")) - 1)
        part = texts.slice(first, end - first)  # a part at a time: no copy of the whole batch
        part = pc.utf8_lower(pc.fill_null(part, "") if part.null_count else part)
        _, offset_buffer, data_buffer = part.buffers()
        offsets = np.frombuffer(offset_buffer, np.int64)[part.offset : part.offset + len(part) + 1]
        data = np.frombuffer(data_buffer, np.uint8) if data_buffer else np.zeros(0, np.uint8)
        yield first, end, Words(data[offsets[0] : offsets[-1]], offsets - offsets[0])
        first = end


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, in order; none if there are fewer words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:count].copy()
        for i in range(1, n):
            out = out * MIX + hashes[i : i + count]
            out ^= out >> np.uint64(29)
    return mix(out)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors share; set to a local one, which goes at exit, only where it is unset and there is but one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        atexit.register(shutil.rmtree, base[7:], True)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def local_path(folder: str) -> str:
    """The path under which workers open a shared folder as files."""
    if re.match(r"^(?!file:)[a-z0-9]+:", folder):
        raise ValueError(f"memory-mapped files need a shared folder that is mounted, not {folder}")
    return re.sub(r"^file:(//)?", "", folder)


def save_array(folder: str, name: str, array: np.ndarray) -> None:
    """Written under another name first: a file is whole or isn't there."""
    os.makedirs(folder, exist_ok=True)
    other = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(other, "wb") as f:
        f.write(memoryview(np.ascontiguousarray(array)).cast("B") if array.size else b"")
    os.replace(other, f"{folder}/{name}")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a small intermediate table to the shared folder and read it back: lineage ends there, so lost executors cost nothing."""
    spark = df.sparkSession
    folder = shared_folder(spark, name)
    # Rows may be whole texts: fewer of them at a time on their way to Python and back. The session's own setting holds again afterwards.
    usual = spark.conf.get(ROWS_AT_ONCE)
    spark.conf.set(ROWS_AT_ONCE, min(3000, int(usual)) if int(usual) > 0 else 3000)
    try:
        df.write.parquet(folder)
    finally:
        spark.conf.set(ROWS_AT_ONCE, usual)
    return spark.read.schema(df.schema).parquet(folder)


def text_bytes(docs: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of text, over the whole table."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    return row["n"], row["b"]


def buckets_for(units: float, per_bucket: float, least: int = 6) -> int:
    return max(least, math.ceil(units / per_bucket))


def row_key(*columns: str) -> Column:
    """A 64-bit, null-safe key of a row's own columns."""
    return F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")) for c in columns])


def seeded(key: Column, seed: int = SEED) -> Column:
    """A seeded pseudo-random, non-negative 63-bit number of a key."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 1)


def batches(iterator: Iterator, *names: str) -> Iterator[tuple]:
    """Columns of Arrow batches as Python lists."""
    for batch in iterator:
        yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, in time that doesn't depend on n; none if there are fewer words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(hashes))
    with np.errstate(over="ignore"):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * power, dtype=np.uint64)))
        return mix((sums[n:] - sums[:-n]) * inverse[:count])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every `width` neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out, have = np.minimum(out[: len(out) - step], out[step:]), have + step
    return out
