"""Benchmark decontamination: rare word n-grams of test items seed candidate passages, which Smith-Waterman alignment scores.

`leaks(docs, items)` has a row for each document and item whose best local alignment reaches SCORE of what the whole item would score
against itself: doc_id, item_id, score (that share), first_word, end_word (the aligned words of the document, from 0, end exclusive).

1. Items are indexed by their n-grams; each n-gram's documents are counted over the whole corpus.
2. An item's seeds are the SEEDS share of its n-grams that fewest documents have, ties included. Being a share, they are there for every
   item, in however many documents it has leaked.
3. Where a document has a seed, the words around it, as many as the item has and a quarter more, are aligned with the item: MATCH
   for equal words, minus MISMATCH for replaced ones, minus GAP for each word left out or put in. So edited copies are found.

The index goes to the workers in parts of at most PART n-grams (or of one item), a pass over the documents for each: its size follows the benchmark, not
the corpus, and a part is bounded. A benchmark of more than MOST bytes of text is refused. Null texts and texts without words have no row. Items of fewer than n words can't be told from
chance and have no row; items that agree in id are each tried, the best score counting. A document without doc_id has rows with null;
repeated rows of a document have a row each. Ties go to the alignment that starts later. Empty tables give no rows. Only doc_id, text and
item_id, text are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, ngrams, text_bytes, words_of

NGRAM, SEEDS, SCORE = 3, 0.6, 0.5
MATCH, MISMATCH, GAP = 2, 1, 1
PART, MOST = 2_000_000, 1 << 28
_ONE = np.int64(1) << np.int64(32)


class Item(NamedTuple):
    item_id: int | None
    words: np.ndarray
    grams: np.ndarray


class Index(NamedTuple):
    """Sorted distinct n-grams, and for each the items and positions (`at[first[i]:first[i + 1]]`)."""

    grams: np.ndarray
    first: np.ndarray
    at: np.ndarray
    table: np.ndarray


def index_of(items: list[Item], chosen: list[np.ndarray] | None = None) -> Index:
    """Of all n-grams, or of the chosen ones (a mask for each item)."""
    grams = [i.grams if chosen is None else i.grams[chosen[k]] for k, i in enumerate(items)]
    where = [np.column_stack((np.full(len(g), k), np.arange(len(items[k].grams)) if chosen is None else np.flatnonzero(chosen[k]))) for k, g in enumerate(grams)]
    every, at = np.concatenate([*grams, np.zeros(0, np.uint64)]), np.concatenate([*where, np.zeros((0, 2), np.int64)])
    order = np.argsort(every, kind="stable")
    distinct, first = np.unique(every[order], return_index=True)
    table = np.zeros(1 << 16, bool)
    table[distinct >> np.uint64(48)] = True
    return Index(distinct, np.append(first, len(every)), at[order], table)


def hits(words: Words, n: int, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, position and number of the n-gram of every n-gram that the index has."""
    grams = ngrams(words.hashes, n)
    at = np.flatnonzero(index.table[grams >> np.uint64(48)]) if len(index.grams) else np.zeros(0, np.int64)
    number = np.searchsorted(index.grams, grams[at])
    found = index.grams[np.minimum(number, len(index.grams) - 1)] == grams[at] if len(at) else np.zeros(0, bool)
    at, number = at[found], number[found]
    doc = np.searchsorted(words.bounds, at, "right") - 1
    inside = at + n <= words.bounds[doc + 1]  # not over the end of a document
    return doc[inside], at[inside], number[inside]


def align(windows: list[np.ndarray], item: np.ndarray) -> list[tuple[int, int, int]]:
    """Score, start and end of the best local alignment of each window with the item.

    A row of the matrix is computed for all windows at once. A cell holds the score in its upper 32 bits and where the alignment starts in
    the lower ones; gaps along the row are a running maximum of cells with the gaps' cost added in advance.
    """
    width = max(map(len, windows))
    text = np.zeros((len(windows), width), np.uint64)
    real = np.zeros((len(windows), width), bool)
    for k, w in enumerate(windows):
        text[k, : len(w)] = w
        real[k, : len(w)] = True
    fresh = np.arange(width + 1, dtype=np.int64)
    along = fresh * GAP * _ONE
    row = np.tile(fresh, (len(windows), 1))
    best, end = np.zeros(len(windows), np.int64), np.zeros(len(windows), np.int64)
    every = np.arange(len(windows))
    for word in item:
        step = np.where((text == word) & real, MATCH * _ONE, -MISMATCH * _ONE)
        new = np.maximum(row - GAP * _ONE, fresh)
        np.maximum(new[:, 1:], row[:, :-1] + step, out=new[:, 1:])
        row = np.maximum.accumulate(new + along, axis=1) - along
        at = row.argmax(axis=1)
        value = row[every, at]
        better = value > best
        best[better], end[better] = value[better], at[better]
    return [(int(b >> 32), int(b & 0xFFFFFFFF), int(e)) for b, e in zip(best, end)]


def read_items(items: DataFrame, n: int) -> list[Item]:
    """The benchmark's items; the benchmark is read by the driver, as its size is that of a test set and not of a corpus; this is checked first."""
    if (size := text_bytes(items)[1]) > MOST:
        raise ValueError(f"the benchmark has {size} bytes of text; {MOST} are the most that goes to the workers")
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct().orderBy("item_id", "text").collect()
    out = []
    for first, end, words in words_of(pa.array([r["text"] for r in rows], pa.large_string())):
        for i in range(first, end):
            own = words.hashes[words.bounds[i - first] : words.bounds[i - first + 1]].copy()
            if len(own) >= n:
                out.append(Item(rows[i]["item_id"], own, ngrams(own, n)))
    return out


def _parts(items: list[Item]) -> Iterator[list[Item]]:
    part, held = [], 0
    for item in items:
        if part and held + len(item.grams) > PART:
            yield part
            part, held = [], 0
        part.append(item)
        held += len(item.grams)
    if part:
        yield part


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def document_counts(docs: DataFrame, items: list[Item], n: int) -> dict[int, int]:
    """Documents of the whole corpus that have each n-gram of the items: partial counts, then a row for each n-gram."""
    index = index_of(items)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(index.grams), np.int64)
        for batch in batches:
            for _, _, words in words_of(batch.column(1)):
                doc, _, number = hits(words, n, index)
                np.add.at(total, np.unique(doc * np.int64(len(total)) + number) % max(1, len(total)), 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["number", "docs"])

    rows = _texts(docs).mapInArrow(count, "number long, docs long").groupBy("number").agg(F.sum("docs").alias("docs")).collect()  # PART rows at most
    return {int(index.grams[r["number"]]): r["docs"] for r in rows}


def seeds_of(items: list[Item], counts: dict[int, int], share: float) -> Index:
    chosen = []
    for item in items:
        often = np.array([counts.get(g, 0) for g in item.grams.tolist()])
        limit = np.sort(often)[int(np.ceil(share * len(often))) - 1]
        chosen.append(often <= limit)
    return index_of(items, chosen)


def search(batch_texts: pa.Array, items: list[Item], index: Index, n: int, score: float) -> list[tuple[int, int, float, int, int]]:
    """(document's place, item's place, share, first word, end word) of each leak in a batch of texts."""
    windows: dict[int, list[tuple[int, int, np.ndarray]]] = defaultdict(list)
    for first, _, words in words_of(batch_texts):
        doc, at, number = hits(words, n, index)
        spans: dict[tuple[int, int], list[int]] = defaultdict(list)
        for d, p, g in zip(doc.tolist(), at.tolist(), number.tolist()):
            for k, q in index.at[index.first[g] : index.first[g + 1]].tolist():
                spans[d, k].append(p - q)
        for (d, k), starts in spans.items():
            low, high = int(words.bounds[d]), int(words.bounds[d + 1])
            length = len(items[k].words)
            slack = max(n, length // 4)
            starts.sort()
            begin = last = starts[0]
            for s in [*starts[1:], None]:
                if s is not None and s - last <= length + 2 * slack:
                    last = s
                    continue
                a, b = max(low, begin - slack), min(high, last + length + slack)
                windows[k].append((first + d, a - low, words.hashes[a:b].copy()))
                begin = last = s
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for k, own in windows.items():
        item = items[k].words
        own.sort(key=lambda w: len(w[2]))
        at = 0
        while at < len(own):
            end = at + 1
            while end < len(own) and (end - at + 1) * len(own[end][2]) <= 300_000:
                end += 1
            for (d, start, _), (value, a, b) in zip(own[at:end], align([w for _, _, w in own[at:end]], item)):
                share = value / (MATCH * len(item))
                if share >= score and (share, start + a, start + b) > best.get((d, k), (0.0, 0, 0)):
                    best[d, k] = share, start + a, start + b
            at = end
    return [(d, k, *v) for (d, k), v in sorted(best.items())]


def leaks(docs: DataFrame, items: DataFrame, n: int = NGRAM, seeds: float = SEEDS, score: float = SCORE) -> DataFrame:
    """doc_id, item_id, score, first_word, end_word."""
    schema = "doc_id long, item_id long, score double, first_word long, end_word long"
    found = None
    for part in _parts(read_items(items, n)):
        index = seeds_of(part, document_counts(docs, part, n), seeds)

        def find(batches: Iterable[pa.RecordBatch], part: list[Item] = part, index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                best: dict[tuple, tuple] = {}
                for d, k, share, a, b in search(batch.column(1), part, index, n, score):
                    key = d, part[k].item_id
                    best[key] = max(best.get(key, (0.0, 0, 0)), (share, a, b))
                ids = batch.column(0).to_pylist()
                rows = [(ids[d], item, *v) for (d, item), v in best.items()]
                names = ["doc_id", "item_id", "score", "first_word", "end_word"]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)

        own = _texts(docs).mapInArrow(find, schema)
        found = own if found is None else found.unionByName(own)
    return docs.sparkSession.createDataFrame([], schema) if found is None else found


def clean_documents(docs: DataFrame, items: DataFrame, n: int = NGRAM, seeds: float = SEEDS, score: float = SCORE) -> DataFrame:
    """The documents without a leak, with all their columns: judged where they are read, without a join."""
    for part in _parts(read_items(items, n)):
        docs = docs.filter(~_leaked(part, seeds_of(part, document_counts(docs, part, n), seeds), n, score)(F.col("text").cast("string")))
    return docs


def _leaked(part: list[Item], index: Index, n: int, score: float) -> Callable:
    @F.arrow_udf("boolean")
    def leaked(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        out[[d for d, *_ in search(texts, part, index, n, score)]] = True
        return pa.array(out)

    return leaked
