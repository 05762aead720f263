"""LM scoring: an interpolated modified Kneser-Ney model of any order, counted over the whole corpus and stored as sorted hash arrays.

`perplexities(docs, order=n)` trains on docs and scores them: a row for every row of docs with doc_id, words, log_prob (natural logarithm, of the words and
the end mark) and perplexity (exp of minus log_prob for each of these).

1. Words are counted and numbered, the frequent ones first, so that n-grams pack well.
2. Each task counts the n-grams of its own documents, with marks for their beginning and end, and sends them to blocks by their middle words. An n-gram
   and those one word shorter share these, so a block knows nearly all there is of them. A frequent middle word has as many blocks as its count asks
   for, told apart by the last word. A block sums its n-grams and writes their sorted hashes and counts. It passes on, for each n-gram one word shorter, what
   Kneser-Ney needs of it: how often it is followed, by how many words once, twice, and more often, and how many words it follows.
3. Each shorter order is summed and written in the same way, down to words: there the count is the number of different words before. An n-gram that
   begins with the document has its own count. Discounts come from the counts of counts of each order.
4. Workers map the arrays into memory and look up the sorted distinct n-grams of some MB of text at a time. Nothing is loaded or broadcast, so the model may
   be larger than a worker; the operating system keeps what is used.

An array is in order of hashes; their upper bits are left to an index of some 16 n-grams an entry, the next 24 bits are stored. What is known of an n-gram is a code
into the block's distinct values, which are whole 64-bit numbers. The files are in the folder that all executors share. Every block has one, which is made anew as an equal
one; a file that is missing is an error. p(w|h) is
(c(hw) - D(c)) / c(h) + gamma(h) p(w|h') for h' without the first word of h, and p(w) is (k(w) - D'(k)) / K + gamma' / V for k(w) different words before w.
V counts the words, the end mark and one unknown word. After an h that never occurred p(w|h) is p(w|h'); a word that never occurred has k = 0. The first
words of a document have shorter histories, which begin with the mark.

About one in 10^6 words and n-grams is taken for another one. Null texts and texts without words aren't counted; their row has 0 words, log_prob 0 and no perplexity.
Repeated rows count each time. Rows without doc_id count and have rows. An empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, buckets_for, local_path, mix, save_array, shared_folder, text_bytes, words_of

#: Words of text for each block; bytes of text that are counted, and scored, together.
BLOCK, COUNTED, SCORED = 1_200_000, 9_000_000, 3_000_000
#: Numbers of what isn't a word of the corpus; words follow.
BEGIN, END, UNKNOWN, FIRST = 0, 1, 2, 3
#: What is known of an n-gram below the highest order; the last one is its count.
_FACTS = ("total", "n1", "n2", "n3", "before")
_PACKED = "bucket int, data binary"


class Vocabulary(NamedTuple):
    """Where the words' numbers are, in how many parts, and the words that have several blocks, in order, with how many."""

    folder: str
    parts: int
    frequent: np.ndarray
    salts: np.ndarray


class Model(NamedTuple):
    """Where the arrays are, in how many blocks, the discounts of each order from words up, and what the words' estimate needs."""

    words: Vocabulary
    folder: str
    order: int
    blocks: int
    discounts: list[tuple[float, float, float]]
    lower_gamma: float
    kinds: int
    vocabulary: int


def _top(hashes: np.ndarray, blocks: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)).astype(np.int64) * blocks) >> 31


def _key(grams: np.ndarray) -> np.ndarray:
    key = mix(grams[0].astype(np.uint64) + np.uint64(0xABCDEF))
    with np.errstate(over="ignore"):
        for word in grams[1:]:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + word.astype(np.uint64))
    return key


def _block(grams: np.ndarray, blocks: int, words: Vocabulary) -> np.ndarray:
    """Of n-grams up to two words by all of them; of longer ones by the middle, and the last word where the middle is frequent."""
    if len(grams) < 3:
        return _top(mix(_key(grams) ^ np.uint64(0x5555555555555555)), blocks)  # not by the bits that order a block
    key, middle = _key(grams[1:-1]), grams[-2]
    if len(words.frequent):
        at = np.minimum(np.searchsorted(words.frequent, middle), len(words.frequent) - 1)
        salts = np.where(words.frequent[at] == middle, words.salts[at], 1)
        with np.errstate(over="ignore"):
            key = mix(key + mix(grams[-1].astype(np.uint64)) % salts.astype(np.uint64))
    return _top(key, blocks)


def _whole(grams: np.ndarray) -> np.ndarray:
    """Not filled up with more than the one mark that a beginning has."""
    return ~((grams[0] == BEGIN) & (grams[1] == BEGIN)) if len(grams) > 1 else np.ones(grams.shape[1], bool)


def _packed(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], ["bucket", "data"])


def _parts(bucket: np.ndarray, blocks: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each block, in order; numbers of 16 bits are sorted by radix."""
    order = np.argsort(bucket.astype(np.uint16 if blocks <= 1 << 16 else np.int64), kind="stable")
    sizes = np.bincount(bucket, minlength=blocks)
    ends = np.cumsum(sizes)
    for b in np.flatnonzero(sizes).tolist():
        yield b, order[ends[b] - sizes[b] : ends[b]]


def _columns(level: int) -> list[int]:
    """The places of an n-gram's words in the order in which n-grams are sorted: those in the middle, the first, the last."""
    return [*range(1, level - 1), 0, level - 1] if level > 1 else [0]


def _planes(values: np.ndarray) -> bytes:
    """Non-negative numbers as planes of as many bytes as the largest needs."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _encode(grams: np.ndarray, values: np.ndarray) -> bytes:
    """Sorted n-grams as differences within what equals the one before, and rows of values."""
    new, out = np.zeros(grams.shape[1], bool), []
    new[0] = True
    for c in _columns(len(grams)):
        x = grams[c]
        step = np.concatenate((x[:1], np.diff(x)))
        out.append(_planes(np.where(new, x, step)))
        new = new | (step != 0)
    out += [_planes(v) for v in values]
    return np.int64(grams.shape[1]).tobytes() + zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _decode(data: bytes, level: int) -> tuple[np.ndarray, np.ndarray]:
    n, raw = int(np.frombuffer(data, np.int64, 1)[0]), zstandard.ZstdDecompressor().decompress(data[8:])
    found, at = [], 0
    while at < len(raw):
        width = raw[at]
        out = np.zeros((n, 8), np.uint8)
        out[:, :width] = np.frombuffer(raw, np.uint8, width * n, at + 1).reshape(width, n).T
        found.append(out.view("<i8").ravel())
        at += 1 + width * n
    grams, new = np.empty((level, n), np.int64), np.zeros(n, bool)
    new[0] = True
    for c, step in zip(_columns(level), found):
        sums, starts = np.cumsum(step), np.flatnonzero(new)
        grams[c] = sums - np.repeat(sums[starts] - step[starts], np.diff(np.append(starts, n)))
        new = new | (step != 0)
    return grams, np.stack(found[level:])


def save_table(folder: str, name: str, keys: np.ndarray, values: np.ndarray) -> None:
    """Rows of values by 64-bit key: sizes, distinct rows of values, index of the upper bits of sorted keys, codes of the rows, next 24 bits of the keys."""
    order = np.argsort(keys)
    keys, values = keys[order], values[:, order]
    n = len(keys)
    bits = max(0, (n // 16).bit_length() - 1) if n else 0
    code, distinct = pd.factorize(_key(values) if n else np.zeros(0, np.uint64))
    first = np.zeros(len(distinct), np.int64)
    first[code[::-1]] = np.arange(n)[::-1]
    width = 1 if len(first) <= 1 << 8 else 2 if len(first) <= 1 << 16 else 4
    upper = (keys >> np.uint64(63 - bits)) >> np.uint64(1)
    index = np.searchsorted(upper, np.arange((1 << bits) + 1, dtype=np.uint64))
    low = (keys >> np.uint64(40 - bits)) & np.uint64(0xFFFFFF)
    pieces = [np.array([n, bits, width, len(first), len(values)], np.int64), values[:, first].T.astype(np.int64), index.astype("<u4"), code.astype(f"<u{width}"), low.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]]
    save_array(folder, name, np.frombuffer(b"".join(np.ascontiguousarray(p).tobytes() for p in pieces), np.uint8))


@lru_cache(maxsize=4096)
def _mapped(path: str) -> tuple:
    raw = np.asarray(np.memmap(path, np.uint8, "r"))
    n, bits, width, rows, facts = raw[:40].view(np.int64).tolist()
    ends = np.cumsum([40, 8 * rows * facts, 4 * ((1 << bits) + 1), width * n, 3 * n]).tolist()
    values, index, code, low = (raw[a:b] for a, b in zip(ends, ends[1:]))
    return bits, values.view(np.int64).reshape(rows, facts), index.view("<u4"), code.view(f"<u{width}"), low.reshape(-1, 3)


def look_up(path: str, keys: np.ndarray, width: int) -> np.ndarray:
    """The rows of values of the keys; 0 where there is none."""
    bits, values, index, code, low = _mapped(path)
    out = np.zeros((len(keys), width), np.int64)
    if not len(code):
        return out
    upper = ((keys >> np.uint64(63 - bits)) >> np.uint64(1)).astype(np.int64)
    target = ((keys >> np.uint64(40 - bits)) & np.uint64(0xFFFFFF)).astype(np.int64)

    def at(place: np.ndarray) -> np.ndarray:
        three = low[place]
        return three[:, 0] + (three[:, 1].astype(np.int64) << 8) + (three[:, 2].astype(np.int64) << 16)

    a, b = index[upper].astype(np.int64), index[upper + 1].astype(np.int64)
    end = b
    for _ in range(int((b - a).max()).bit_length()):
        middle = np.minimum((a + b) >> 1, len(code) - 1)
        less = (a < b) & (at(middle) < target)
        a, b = np.where(less, middle + 1, a), np.where(less, b, middle)
    place = np.minimum(a, len(code) - 1)
    found = np.flatnonzero((a < end) & (at(place) == target))
    out[found] = values[code[place[found]]]
    return out


def _count_words(parts: int):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def rows() -> pa.RecordBatch:
            word, often = np.unique(np.concatenate(held), return_counts=True)
            return _packed([(b, np.int64(len(at)).tobytes() + word[at].tobytes() + often[at].astype("<u4").tobytes()) for b, at in _parts(_top(word, parts), parts)])

        for batch in batches:
            for _, _, words in words_of(batch.column(0)):
                held.append(words.hashes)
                size += len(words.data)
                if size >= COUNTED:
                    yield rows()
                    held, size = [], 0
        if held:
            yield rows()

    return count


def number_words(texts: DataFrame, size: int) -> Vocabulary:
    """Words by falling count in each part, the numbers of the parts interleaved. Words with more than BLOCK occurrences, and more than a millionth of all, are collected: a million at most."""
    spark = texts.sparkSession
    folder, parts, block = local_path(shared_folder(spark, "words")), buckets_for(size / 6.5, 20 * BLOCK), max(BLOCK, size // 6_500_000)

    def store(rows: pa.Table) -> pa.Table:
        part, words, counts = rows.column("bucket")[0].as_py(), [], []
        for data in rows.column("data").to_pylist():
            n = int(np.frombuffer(data, np.int64, 1)[0]) if data else 0
            if n:
                words.append(np.frombuffer(data, np.uint64, n, 8))
                counts.append(np.frombuffer(data, "<u4", n, 8 + 8 * n))
        word, of = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]), return_inverse=True)
        count = np.bincount(of, np.concatenate([np.zeros(0), *counts]), len(word)).astype(np.int64)
        number = np.empty(len(word), np.int64)
        number[np.lexsort((word, -count))] = np.arange(len(word)) * parts + part + FIRST
        # Parts differ in the upper half of the hash, so the lower half is the upper one of the key.
        save_table(folder, f"words-{part}", _word_key(word), number[None])
        often = count > block
        return pa.table({"number": pa.array(number[often], pa.int64()), "count": pa.array(count[often], pa.int64())})

    rows = texts.mapInArrow(_count_words(parts), _PACKED).unionByName(_every_block(spark, parts))
    found = sorted((r["number"], -(-r["count"] // block)) for r in rows.groupBy("bucket").applyInArrow(store, "number long, count long").collect())
    return Vocabulary(folder, parts, np.array([n for n, _ in found], np.int64), np.array([s for _, s in found], np.int64))


def _word_key(word: np.ndarray) -> np.ndarray:
    return word << np.uint64(32) | word >> np.uint64(32)


def _every_block(spark: SparkSession, blocks: int) -> DataFrame:
    """An empty row for each block: every block is written."""
    return spark.range(blocks).select(F.col("id").cast("int").alias("bucket"), F.lit(b"").alias("data"))


def numbers(words: Vocabulary, hashes: np.ndarray) -> np.ndarray:
    distinct, of = np.unique(hashes, return_inverse=True)
    out = np.zeros(len(distinct), np.int64)
    for b, at in _parts(_top(distinct, words.parts), words.parts):
        out[at] = look_up(f"{words.folder}/words-{b}", _word_key(distinct[at]), 1)[:, 0]
    return np.where(out == 0, UNKNOWN, out)[of]


def grams_of(words: Words, number: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """A row of words' numbers for each place in an n-gram, and the document, of every event; marks fill what is missing. Texts without words have none."""
    size = np.diff(words.bounds)
    used = np.flatnonzero(size)
    ends = np.cumsum(size[used] + 1)
    total = int(ends[-1]) if len(used) else 0
    word = np.full(total, END)
    inside = np.ones(total, bool)
    inside[ends - 1] = False
    word[inside] = number
    place = np.arange(total) - np.repeat(ends - size[used] - 1, size[used] + 1)
    grams = np.full((order, total), BEGIN)
    for back in range(order):
        has = np.flatnonzero(place >= back)
        grams[order - 1 - back, has] = word[has - back]
    return grams, np.repeat(used, size[used] + 1)


def _summed(grams: np.ndarray, values: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, sorted, and the sums of their rows of values (by default, how often they occur)."""
    columns = [grams[c] for c in _columns(len(grams))]
    if grams.size and grams.max() < 1 << 31:  # two to a key
        columns = [columns[i] << 32 | columns[i + 1] if i + 1 < len(columns) else columns[i] for i in range(0, len(columns), 2)]
    order = np.argsort(columns[0])
    x = columns[0][order]
    new = np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1]))
    for c in columns[1:]:  # by the number of what is equal so far, and the next
        group, x = np.cumsum(new), c[order]
        if len(x) < 1 << 31 and x.max(initial=0) < 1 << 32:
            again = np.argsort(group << 32 | x)
        else:
            again = np.lexsort((x, group))
        order, x = order[again], x[again]
        new[1:] |= x[1:] != x[:-1]
    starts = np.flatnonzero(new)
    if values is None:
        return grams[:, order[starts]], np.diff(np.append(starts, len(order)))[None]
    return grams[:, order[starts]], np.stack([np.add.reduceat(v[order], starts, dtype=np.int64) if len(starts) else v.astype(np.int64) for v in values])


def _rows(grams: np.ndarray, values: np.ndarray, blocks: int, words: Vocabulary) -> list[tuple[int, bytes]]:
    return [(b, _encode(grams[:, at], values[:, at])) for b, at in _parts(_block(grams, blocks, words), blocks)]


def _count_grams(order: int, blocks: int, words: Vocabulary):
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for _, _, found in words_of(batch.column(0)):
                held.append(grams_of(found, numbers(words, found.hashes), order)[0])
                size += len(found.data)
                if size >= COUNTED:
                    yield _packed(_rows(*_summed(np.concatenate(held, axis=1), None), blocks, words))
                    held, size = [], 0
        if held:
            yield _packed(_rows(*_summed(np.concatenate(held, axis=1), None), blocks, words))

    return count


def _counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == n).sum()) for n in (1, 2, 3, 4)]


def _store(folder: str, level: int, blocks: int, words: Vocabulary, top: bool):
    """Writes a block of n-grams and passes on rows for those one word shorter; rows of bucket -m have the counts of counts of order m."""

    def store(part: pa.Table) -> pa.Table:
        bucket = part.column("bucket")[0].as_py()
        parts = [d for d in part.column("data").to_pylist() if d]
        if bucket < 0:
            return pa.Table.from_batches([_packed([(bucket, sum(np.frombuffer(d, np.int64) for d in parts).tobytes())])])
        if not parts:
            save_table(folder, f"grams{level}-{bucket}", np.zeros(0, np.uint64), np.zeros((1 if top else len(_FACTS), 0), np.int64))
            return pa.Table.from_batches([_packed([])])
        grams, values = _summed(*(np.concatenate(x, axis=1) for x in zip(*(_decode(d, level) for d in parts))))
        whole = _whole(grams)
        count = values[-1]
        save_table(folder, f"grams{level}-{bucket}", _key(grams)[whole], values[:, whole])
        own = count[whole]
        rows = [(-level, np.array([*_counts_of_counts(own), own.sum(), (own > 0).sum()], np.int64).tobytes())]
        if level > 1:
            # As a beginning: total and numbers of words once, twice, more often after it. As an end: words before it, or its own count after a mark.
            ends = np.where(whole, 1, count)
            del values
            begins = _summed(grams[:-1, whole], np.stack([own, own == 1, own == 2, own > 2]).astype(np.uint32))
            none = np.zeros((1, begins[0].shape[1]), np.int64)
            rows += _rows(begins[0], np.concatenate((begins[1], none)), blocks, words)
            del begins
            ends = _summed(grams[1:], ends[None])
            rows += _rows(ends[0], np.concatenate((np.zeros((4, len(ends[1][0])), np.int64), ends[1])), blocks, words)
        return pa.Table.from_batches([_packed(rows)])

    return store


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's, for counts 1, 2 and more; where a count of counts is 0 or they leave 0 to the count itself, 0.5, 1 and 1.5."""
    usual = (0.5, 1.0, 1.5)
    if not (n1 and n2 and n3 and n4):
        return usual
    y = n1 / (n1 + 2 * n2)
    found = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3
    return tuple(d if 0 < d < i else u for i, (d, u) in enumerate(zip(found, usual), 1))


def train(docs: DataFrame, order: int = 2) -> Model:
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = docs.sparkSession
    _, size = text_bytes(docs)
    texts = docs.select(F.col("text").cast("string").alias("text")).filter("text is not null")
    words = number_words(texts, size)
    folder, blocks = local_path(shared_folder(spark, "model")), buckets_for(size / 6.5, BLOCK)
    rows = texts.mapInArrow(_count_grams(order, blocks, words), _PACKED)
    for level in range(order, 0, -1):
        rows = rows.unionByName(_every_block(spark, blocks)).groupBy("bucket").applyInArrow(_store(folder, level, blocks, words, level == order), _PACKED)
    sums = np.zeros((order + 1, 6), np.int64)
    for r in rows.collect():  # a row for each block of words and each order
        sums[-r["bucket"]] += np.frombuffer(r["data"], np.int64)
    found = [discounts(*map(int, sums[level, :4])) for level in range(1, order + 1)]
    n1, n2, _, _, kinds, seen = map(int, sums[1])
    left = found[0][0] * n1 + found[0][1] * n2 + found[0][2] * (seen - n1 - n2)
    return Model(words, folder, order, blocks, found, left / kinds if kinds else 1.0, kinds, seen + 1)


def _find(model: Model, grams: np.ndarray) -> np.ndarray:
    """The facts that are stored for n-grams, a row for each; 0 where there is nothing."""
    level, keys = len(grams), _key(grams)
    width = 1 if level == model.order else len(_FACTS)
    out = np.zeros((len(keys), width), np.int64)
    for b, at in _parts(_block(grams, model.blocks, model.words), model.blocks):
        out[at] = look_up(f"{model.folder}/grams{level}-{b}", keys[at], width)
    return out


def _discounted(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return count - np.array([0, *d])[np.minimum(count, 3)]


def log_probs(model: Model, grams: np.ndarray) -> np.ndarray:
    """Natural logarithm of p(last word | those before) for every event of some documents in order. What an event's history is, the event before has ended with, so each n-gram is looked up once."""
    word, of = np.unique(np.append(grams[-1], BEGIN), return_inverse=True)
    facts = _find(model, word[None])[of]
    begin, facts = facts[-1], facts[:-1]
    p = _discounted(facts[:, -1], model.discounts[0]) / max(1, model.kinds) + model.lower_gamma / model.vocabulary
    first = grams[-2] == BEGIN
    for level in range(2, model.order + 1):
        own, before = grams[-level:], np.concatenate((facts[-1:], facts[:-1]))[:, :4]
        if level == 2:
            before[first] = begin[:4]
        total, n1, n2, n3 = before.T
        whole = _whole(own)
        facts = np.zeros((len(whole), 1 if level == model.order else len(_FACTS)), np.int64)
        facts[whole] = _find(model, own[:, whole])
        d = model.discounts[level - 1]
        longer = (_discounted(facts[:, -1], d) + (d[0] * n1 + d[1] * n2 + d[2] * n3) * p) / np.maximum(total, 1)
        p = np.where((total > 0) & whole, longer, p)
    return np.log(p)


def score(docs: DataFrame, model: Model) -> DataFrame:
    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            log = np.zeros(batch.num_rows)
            for first, end, words in words_of(batch.column(1), SCORED):
                n[first:end] = np.diff(words.bounds)
                grams, doc = grams_of(words, numbers(model.words, words.hashes), model.order)
                if len(doc):
                    log[first:end] = np.bincount(doc, log_probs(model, grams), end - first)
            out = np.exp(-log / (n + 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(log), pa.array(out, mask=n == 0)], ["doc_id", "words", "log_prob", "perplexity"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(apply, "doc_id long, words long, log_prob double, perplexity double")


def perplexities(docs: DataFrame, corpus: DataFrame | None = None, order: int = 2) -> DataFrame:
    """Perplexity of every row of docs, under a model of the corpus (of docs themselves by default)."""
    return score(docs, train(docs if corpus is None else corpus, order))
