"""Substring dedup by relative Lempel-Ziv parsing: documents are factored against all documents of lesser id.

`duplicate_spans(docs)` has a row for each span of words that factors of MIN_WORDS words or more cover: doc_id, first_word, end_word (from 0,
end exclusive), factors, ref_doc_id, ref_word (where the first factor's copy is). A factor is a maximal run of words that lies
in a document of lesser doc_id, the reference being the least such document, at its first such place, for each run of MIN_WORDS words.
Factors of a greedy parse end where the reference ends; there the parse is checked: a factor that begins before that boundary and
reaches beyond it prolongs the span, although what lies beyond it may be shorter than MIN_WORDS.

1. Every MIN_WORDS words have an anchor, the least hash of their ANCHOR-word runs. Equal runs of words have equal anchors. Anchors are
   counted; one that only one document has ends there.
2. Documents with shared anchors, and only their runs of MIN_WORDS words around these, are looked up in the index: runs go to the block
   of their anchor as hashes, neighbours together, and come back as stretches of words with a reference. Runs whose anchor HOT documents or more have
   don't go to a block: their first occurrences are found by each task and then in all, and joined to them.
3. Stretches are joined to factors and spans.

So nothing is missed at block boundaries, and no document is compared with all others. Repeats within one document aren't spans. Null texts and texts
of fewer than MIN_WORDS words have no row. Rows without doc_id are left out. Rows that agree in doc_id don't refer to each other; equal
rows have their spans once. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, buckets_for, materialise, rolling, row_key, sliding_min, text_bytes, words_of

MIN_WORDS, ANCHOR = 50, 20
#: Runs of words in a block of the index; bytes of text worked on at once.
BLOCK, TEXT = 4_000_000, 2_000_000
#: Documents of an anchor whose runs don't go to a block.
HOT = 200_000
_HEAD = np.dtype([("doc", "<i8"), ("row", "<i8")])
_RUN = np.dtype([("head", "<u4"), ("at", "<u4"), ("length", "<u4")])
_PACKED = "bucket int, count int, data binary"


def anchors(words: Words, length: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, word and anchor of every run of `length` words."""
    least = sliding_min(rolling(words.hashes, anchor), length - anchor + 1)
    doc = np.repeat(np.arange(len(words.bounds) - 1), np.maximum(0, np.diff(words.bounds) - length + 1))
    at = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist())] or [np.zeros(0, np.int64)]).astype(np.int64)
    return doc, at, least[at]


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    # Anchors are the least of many hashes: their lower bits are used.
    return ((anchor & np.uint64(0xFFFFFF)).astype(np.int64) * buckets) >> 24


def _slices(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        yield b, order[bounds[b] : bounds[b + 1]]


def _packed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "count", "data"])


def _keyed(docs: DataFrame) -> DataFrame:
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null and text is not null")
    return named.select("doc_id", "text", row_key("doc_id", "text").alias("row"))


def _index(length: int, anchor: int) -> Callable:
    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            for first, _, words in words_of(batch.column(1), TEXT):
                doc, _, least = anchors(words, length, anchor)
                order = np.lexsort((least, doc))
                doc, least = doc[order], least[order]
                new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])))[: len(doc)]
                doc, least = doc[new], least[new]
                yield pa.RecordBatch.from_arrays([pa.array(ids[first + doc]), pa.array(keys[first + doc]), pa.array(least.view(np.int64))], ["doc_id", "row", "anchor"])

    return index


def _asked(batches: Iterable[pa.RecordBatch], length: int, anchor: int, hot: np.ndarray, is_hot: bool) -> Iterator[tuple]:
    """Ids and keys of the documents of some text, and document, word, anchor and hash of its runs with a shared anchor, hot ones or others."""
    for batch in batches:
        ids, keys, own = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3)
        for first, end, words in words_of(batch.column(1), TEXT):
            doc, at, least = anchors(words, length, anchor)
            bounds = np.searchsorted(doc, np.arange(end - first + 1))
            shared = np.zeros(len(doc), bool)
            for i in range(end - first):
                mine = own[first + i].values.to_numpy().view(np.uint64)
                shared[bounds[i] : bounds[i + 1]] = np.isin(least[bounds[i] : bounds[i + 1]], mine)
            shared &= np.isin(least, hot) == is_hot
            doc, at, least = doc[shared], at[shared], least[shared]
            if len(doc):
                yield ids[first:end], keys[first:end], doc, at - words.bounds[doc], least, rolling(words.hashes, length)[at]


def _lookups(length: int, anchor: int, buckets: int, hot: np.ndarray) -> Callable:
    def lookups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, doc, at, least, value in _asked(batches, length, anchor, hot, False):
            start = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1))))
            size = np.diff(np.append(start, len(doc)))
            rows = []
            for b, pick in _slices(_bucket(least[start], buckets), buckets):
                used, local = np.unique(doc[start[pick]], return_inverse=True)
                heads = np.empty(len(used), _HEAD)
                heads["doc"], heads["row"] = ids[used], keys[used]
                runs = np.empty(len(pick), _RUN)
                runs["head"], runs["at"], runs["length"] = local, at[start[pick]], size[pick]
                where = np.repeat(start[pick] - np.cumsum(size[pick]) + size[pick], size[pick]) + np.arange(size[pick].sum())
                rows.append((b, len(used), np.int64(len(pick)).tobytes() + heads.tobytes() + runs.tobytes() + value[where].tobytes()))
            yield _packed(rows)

    return lookups


def _hot_stretches(asked: DataFrame, length: int, anchor: int, hot: np.ndarray) -> DataFrame:
    """A stretch for each run of a hot anchor that a document of lesser id has."""

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, keys, doc, at, _, value in _asked(batches, length, anchor, hot, True):
            yield pa.RecordBatch.from_arrays([pa.array(ids[doc]), pa.array(keys[doc]), pa.array(at), pa.array(value.view(np.int64))], ["doc_id", "row", "at", "value"])

    every = materialise(asked.mapInArrow(runs, "doc_id long, row long, at long, value long").dropDuplicates(["row", "at"]), "hot-runs")
    first = every.groupBy(F.col("value").alias("v")).agg(F.min(F.struct("doc_id", "at")).alias("first"))
    later = every.join(first, F.col("value") == F.col("v")).filter("doc_id > first.doc_id")
    return later.select("doc_id", "row", "at", F.lit(1).cast("long").alias("length"), F.col("first.doc_id").alias("ref_doc_id"), F.col("first.at").alias("ref_word"))


_STRETCH = "doc_id long, row long, at long, length long, ref_doc_id long, ref_word long"


def _references(part: pa.Table) -> pa.Table:
    """Stretches of runs whose first occurrence is in a document of lesser id."""
    doc, row, at, value = [], [], [], []
    for count, data in zip(part.column("count").to_pylist(), part.column("data").to_pylist()):
        n = int(np.frombuffer(data, np.int64, 1)[0])
        heads = np.frombuffer(data, _HEAD, count, 8)
        runs = np.frombuffer(data, _RUN, n, 8 + heads.nbytes)
        size = runs["length"].astype(np.int64)
        doc.append(np.repeat(heads["doc"][runs["head"]], size))
        row.append(np.repeat(heads["row"][runs["head"]], size))
        at.append(np.repeat(runs["at"].astype(np.int64) - np.cumsum(size) + size, size) + np.arange(size.sum()))
        value.append(np.frombuffer(data, np.uint64, offset=8 + heads.nbytes + runs.nbytes))
    doc, row, at, value = (np.concatenate(x) for x in (doc, row, at, value))
    order = np.lexsort((at, doc, value))
    doc, row, at, value = doc[order], row[order], at[order], value[order]
    starts = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
    of = np.repeat(starts, np.diff(np.append(starts, len(value))))
    later = doc > doc[of]
    ref_doc, ref_at = doc[of[later]], at[of[later]]
    doc, row, at = doc[later], row[later], at[later]
    order = np.lexsort((at, row))
    doc, row, at, ref_doc, ref_at = (x[order] for x in (doc, row, at, ref_doc, ref_at))
    once = np.concatenate(([True], (row[1:] != row[:-1]) | (at[1:] != at[:-1])))[: len(row)]  # equal rows
    doc, row, at, ref_doc, ref_at = (x[once] for x in (doc, row, at, ref_doc, ref_at))
    goes_on = (row[1:] == row[:-1]) & (at[1:] == at[:-1] + 1) & (ref_doc[1:] == ref_doc[:-1]) & (ref_at[1:] == ref_at[:-1] + 1)
    starts = np.flatnonzero(np.concatenate(([True], ~goes_on))[: len(row)])
    columns = doc[starts], row[starts], at[starts], np.diff(np.append(starts, len(row))), ref_doc[starts], ref_at[starts]
    return pa.table({c.split()[0]: pa.array(x, pa.int64()) for c, x in zip(_STRETCH.split(", "), columns)})


def duplicate_spans(docs: DataFrame, min_words: int = MIN_WORDS, anchor: int = ANCHOR) -> DataFrame:
    _, size = text_bytes(docs)
    buckets = buckets_for(size / 6, BLOCK)
    texts = _keyed(docs)
    found = materialise(texts.mapInArrow(_index(min_words, anchor), "doc_id long, row long, anchor long").distinct(), "anchors")
    shared = found.groupBy(F.col("anchor").alias("a")).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("n")).filter("least < most")
    shared = materialise(shared.select("a", "n"), "shared")
    most = max(HOT, size // 6_000_000)  # so a million hot anchors at most
    hot = np.array([r["a"] for r in shared.filter(F.col("n") >= most).select("a").collect()], np.int64).view(np.uint64)
    wanted = found.join(shared, F.col("anchor") == F.col("a")).groupBy(F.col("row").alias("s_row")).agg(F.collect_list("anchor").alias("own"))
    asked = texts.join(wanted, F.col("row") == F.col("s_row")).select("doc_id", "text", "row", "own")
    if len(hot):
        asked = materialise(asked, "asked")
    stretches = asked.mapInArrow(_lookups(min_words, anchor, buckets, hot), _PACKED).groupBy("bucket").applyInArrow(_references, _STRETCH)
    if len(hot):
        stretches = stretches.unionByName(_hot_stretches(asked, min_words, anchor, hot))
    order = Window.partitionBy("doc_id", "row").orderBy("at")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    continues = (F.lag("at").over(order) + F.lag("length").over(order) == F.col("at")) & (F.lag("ref_doc_id").over(order) == F.col("ref_doc_id")) & (F.lag("ref_word").over(order) + F.lag("length").over(order) == F.col("ref_word"))
    marked = (
        stretches.withColumn("end", F.col("at") + F.col("length") + (min_words - 1))
        .withColumn("new", F.coalesce((F.col("at") > before).cast("int"), F.lit(1)))
        .withColumn("factor", 1 - F.coalesce(continues.cast("int"), F.lit(0)))
        .withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    spans = marked.groupBy("doc_id", "row", "span").agg(
        F.min("at").alias("first_word"), F.max("end").alias("end_word"), F.sum("factor").alias("factors"), F.min_by(F.struct("ref_doc_id", "ref_word"), "at").alias("ref")
    )
    return spans.select("doc_id", "first_word", "end_word", "factors", F.col("ref.ref_doc_id").alias("ref_doc_id"), F.col("ref.ref_word").alias("ref_word"))
