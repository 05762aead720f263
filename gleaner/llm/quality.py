"""Quality classifier: compressed-size differences under zstandard dictionaries of good and of bad labelled text.

Two codings of a document are compressed, each with a good and a bad dictionary. Its raw UTF-8 shows the look of junk; the
dictionaries there are trained by zstandard on windows of all training texts. Its distinct words, each coded as its 8-byte hash, show rare
telling words: a word costs 8 bytes unless the dictionary holds it. These two dictionaries have the words of labelled text
that one class has and the other has hardly, so that the sizes differ by the telling words alone.

Features are normalised differences, (good - bad) / max(good, bad), of the sizes of windows: the raw one over all of the text, that of all words, the largest one and the sum of the
word windows (single words tell, so length doesn't dilute them), and besides the logarithm of the size under the good dictionary over the size of the text. Two logistic regressions on labelled documents that no
dictionary has seen, of poor and of toxic against good ones, each kind weighing as much as it has documents among the labels, make the odds of either kind
and so `p_bad`: of the documents with p_bad near p about a share of p is bad.

A document is bad where its label has quality 0 or toxic 1. Labels that are null in quality or doc_id aren't used; repeated
labels of a document are used once, the worst counting. At most TRAIN labelled documents of each kind are learned from, in
an order of seeded hashes. Where a class has no usable example, nothing can be learned: p_bad is 0.5 and nothing rejected.

Null and empty texts tell nothing: p_bad is 0.5, they aren't rejected. Every row is scored by itself over its whole text;
repeated rows get equal scores. An empty table gives no rows. Only doc_id and text are read; other columns are carried by
`accepted_documents` whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, seeded, words_of

#: Labelled documents of each of the three kinds (good, poor, toxic) that are learned from, at most.
TRAIN = 1500
#: Bytes of a raw dictionary; log likelihood ratio from which a word tells good from bad.
RAW_BYTES, EVIDENCE = 110 << 10, 8.0
#: Bytes of a raw window; distinct words of a word window; sum of word windows beyond which there is no doubt.
RAW_LEVEL, WORD_LEVEL, WINDOW, WORDS, MOST = 3, 9, 2048, 128, 0.05
REJECT = 0.35


class Model(NamedTuple):
    """Dictionaries (raw good, raw bad, words good, words bad) and the calibration; None where nothing could be learned."""

    dictionaries: tuple[bytes, bytes, bytes, bytes]
    centre: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]


def compressors(dictionaries: tuple[bytes, ...]) -> list[zstandard.ZstdCompressor]:
    out = []
    for data, level in zip(dictionaries, (RAW_LEVEL, RAW_LEVEL, WORD_LEVEL, WORD_LEVEL)):
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=level)
        out.append(zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Distinct words in the order of their first occurrence."""
    found, first = np.unique(hashes, return_index=True)
    return found[np.argsort(first)]


def features(texts: pa.Array, dictionaries: tuple[bytes, ...]) -> np.ndarray:
    """A row for each text: normalised difference raw, that of all words, largest one and sum of the word windows, log of the compression ratio."""
    raw_good, raw_bad, word_good, word_bad = compressors(dictionaries)
    texts = texts.cast(pa.large_string())
    out = np.zeros((len(texts), 5))
    raw = texts.view(pa.large_binary())
    for first, end, words in words_of(texts):
        for i in range(first, end):
            data = raw[i].as_py()
            if not data:
                continue
            windows = [data[at : at + WINDOW] for at in range(0, len(data), WINDOW)]
            good, bad = (sum(len(c.compress(w)) for w in windows) for c in (raw_good, raw_bad))
            coded = distinct(words.hashes[words.bounds[i - first] : words.bounds[i - first + 1]]).tobytes()
            # zstd stores a block as it is where it can't save 1/64; these zeros cost the same in both.
            windows = [coded[at : at + 8 * WORDS] + bytes(64) for at in range(0, len(coded), 8 * WORDS)] or [bytes(64)]
            sizes = [(len(word_good.compress(w)), len(word_bad.compress(w))) for w in windows]
            told = [(g - b) / max(g, b) for g, b in sizes]
            whole = sum(g - b for g, b in sizes) / sum(map(max, sizes))
            out[i] = (good - bad) / max(good, bad), whole, max(told), np.clip(sum(told), -MOST, MOST), np.log(good / len(data))
    return out


def _telling(of: Counter, other: Counter, n: int, m: int) -> list[int]:
    """Words that chance can't have put into so many documents of one class, the most telling last: nearest to the text, they are cheapest. The evidence is the Poisson log likelihood ratio against the other class's rate."""
    scores = []
    for word, count in of.items():
        expected = n * (other[word] + 0.5) / m
        if count > 20 * expected and (evidence := count * np.log(count / expected) - count + expected) > EVIDENCE:
            scores.append((evidence, word))
    return [w for _, w in sorted(scores)]


def _raw(texts: list[str]) -> bytes:
    """A dictionary that zstandard trains on all windows of the texts; where they are too few for that, their beginnings as they are."""
    windows = [data[at : at + WINDOW] for data in (t.encode() for t in texts) for at in range(0, len(data), WINDOW)]
    try:
        return zstandard.train_dictionary(RAW_BYTES, windows, level=RAW_LEVEL).as_bytes()
    except zstandard.ZstdError:
        return (bytes(8) + b"\n".join(windows))[:RAW_BYTES]


def learn(good: list[str], poor: list[str], toxic: list[str], counts: tuple[int, int, int] | None = None) -> Model | None:
    """Dictionaries from two thirds of the examples, the calibration from the others; `counts` of each kind among all labels."""
    kinds = [[t for t in k if t] for k in (good, poor, toxic)]
    if not kinds[0] or not kinds[1] + kinds[2]:
        return None
    parts = [(k[: max(1, len(k) * 2 // 3)], k[max(1, len(k) * 2 // 3) :] or k) for k in kinds]

    def document_counts(texts: list[str]) -> Counter:
        counts: Counter = Counter()
        for first, end, words in words_of(pa.array(texts, pa.large_string())):
            for i in range(end - first):
                counts.update(np.unique(words.hashes[words.bounds[i] : words.bounds[i + 1]]).tolist())
        return counts

    g, p, t = (document_counts(a) for a, _ in parts)
    n = [max(1, len(a)) for a, _ in parts]
    bad_words = dict.fromkeys(_telling(p, g, n[1], n[0]) + _telling(t, g, n[2], n[0]))
    good_words = _telling(g, p + t, n[0], n[1] + n[2])
    words = [bytes(16) + np.array(list(w), np.uint64).tobytes() for w in (good_words, bad_words)]
    dictionaries = (_raw(parts[0][0]), _raw(parts[1][0] + parts[2][0]), *words)
    x = features(pa.array([t for _, b in parts for t in b], pa.large_string()), dictionaries)
    sizes = [len(b) if k else 0 for k, (_, b) in zip(kinds, parts)]
    kind = np.repeat(range(3), sizes)
    share = np.repeat([c / max(1, m) for c, m in zip(counts or sizes, sizes)], sizes)
    centre, spread = x.mean(0), x.std(0) + 1e-9
    x = np.column_stack((np.ones(len(x)), (x - centre) / spread))
    weights = []
    for bad in (1, 2):
        own = (kind == 0) | (kind == bad)
        if sizes[bad]:
            weights.append(_logistic(x[own], (kind[own] == bad).astype(float), share[own] * own.sum() / share[own].sum()))
    return Model(dictionaries, centre, spread, weights)


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Newton steps on the penalised weighted likelihood."""
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [0.05] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (share * p * (1 - p))) @ x + penalty, x.T @ (share * (y - p)) - penalty @ w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> Model | None:
    """Learns from a bounded, seeded sample of labelled documents: `most` ids of each kind go to the driver and back as a filter."""
    spark = docs.sparkSession
    kinds = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").alias("q"), F.coalesce("toxic", F.lit(0)).alias("t"))
        .filter("id is not null and q is not null")
        .groupBy("id")
        .agg(F.when(F.max("t") > 0, 2).when(F.min("q") < 1, 1).otherwise(0).alias("kind"))
    )
    counted = {r["kind"]: r["count"] for r in kinds.groupBy("kind").count().collect()}
    wanted = [(r["id"], k) for k in range(3) for r in kinds.filter(F.col("kind") == k).orderBy(seeded(F.col("id")), "id").limit(most).select("id").collect()]
    ids = F.broadcast(spark.createDataFrame(wanted, "id long, kind int"))  # 3 * most rows at most
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, F.col("doc_id") == F.col("id")).filter("text is not null")
    examples: list[list[str]] = [[], [], []]
    rows = texts.groupBy("id", "kind").agg(F.min("text").alias("text")).collect()
    for r in sorted(rows, key=lambda r: (r["id"] * 0x9E3779B97F4A7C15 % (1 << 64), r["id"])):
        examples[r["kind"]].append(r["text"])
    model = learn(*examples, tuple(counted.get(k, 0) for k in range(3)))
    rows = examples = None
    give_back()  # the driver goes on to other work
    return model


def p_bad(texts: pa.Array, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """p_bad, and whether it is rejected, of each text."""
    p, told = np.full(len(texts), 0.5), np.zeros(len(texts), bool)
    if model is not None and len(texts):
        x = (features(texts, model.dictionaries) - model.centre) / model.spread
        told = pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0).to_numpy(zero_copy_only=False)
        odds = sum(np.exp(np.clip(w[0] + x[told] @ w[1:], -30, 30)) for w in model.weights)
        p[told] = odds / (1 + odds)
    return p, told & (p > REJECT)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, p_bad, rejected for every row."""

    def apply(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            p, rejected = p_bad(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array(rejected)], ["doc_id", "p_bad", "rejected"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(apply, "doc_id long, p_bad double, rejected boolean")


def classify(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> DataFrame:
    return score(docs, train(docs, labels, most))


def accepted_documents(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> DataFrame:
    """The rows that aren't rejected, with all their columns: scored where they are read, without a join."""
    model = train(docs, labels, most)

    @F.arrow_udf("boolean")
    def rejected(texts: pa.Array) -> pa.Array:
        return pa.array(p_bad(texts, model)[1])

    return docs.filter(~rejected(F.col("text").cast("string")))
