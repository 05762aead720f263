"""Postings, inverse document frequencies, TF-IDF and Okapi BM25 scores, for many queries at once."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.functions.vectors import stable_u32

DIGITS = 6


def plain_unions(spark: SparkSession) -> None:
    """Spark 4.1 may zip the partitions of a union's sides although adaptive execution has coalesced them differently, which fails; unions are then better kept plain."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def spread(df: DataFrame) -> DataFrame:
    """A table of few files is read by few tasks; its rows are then dealt to all cores before text is worked on."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < cores else df


LEXICAL, _CAMEL = re.compile(T.LEXICAL, re.A), re.compile(T.CAMEL)
#: Tokens that a worker remembers the terms of; texts cut and postings passed on at a time.
MEMO, AT_ONCE, MOST = 200_000, 256, 50_000


def terms_of(token: str) -> tuple[str, ...]:
    """What one lexical token counts as; `T.token_terms` for a string."""
    out = [token.lower()]
    for part in token.split("."):
        out.append(part.lower())
        out += [piece.lower() for snake in part.split("_") for piece in _CAMEL.findall(snake)]
    return tuple(dict.fromkeys(filter(None, out)))


#: What isn't part of any token becomes a blank; dots are looked at later. UTF-8 beyond ASCII is no part of tokens.
_BLANKS = bytes(c if c < 128 and (chr(c).isalnum() or c in b"_.") else 32 for c in range(256))


def pieces(text: bytes | None) -> list[bytes]:
    """What stands between blanks; several lexical tokens where dots are doubled."""
    return text.translate(_BLANKS).split() if text else []


def piece_terms(piece: bytes) -> tuple[str, ...]:
    """Terms of all lexical tokens in a piece; plain words and numbers are their own only term."""
    token = piece.strip(b".").decode()
    if token.isdigit() or (token.isalpha() and token.islower()):
        return (token,)
    if token.isalpha() and (token.isupper() or token[1:].islower()):
        return (token.lower(),)
    return tuple(t for lexical in LEXICAL.findall(token) for t in terms_of(lexical))


class Coder(dict):
    """A number for each piece of text that a worker met. `of` gives the entries that matter of a piece's terms: places in a vocabulary, hashed dimensions."""

    def __init__(self, of: Callable[[tuple[str, ...]], Iterable[int]]):
        self.of = of
        self._forget()

    def _forget(self) -> None:
        self.clear()
        self._new: tuple[list, list, list] = [], [], []
        self._sizes = self._counts = self._entries = np.zeros(0, np.int64)

    def __missing__(self, piece: bytes) -> int:
        terms = piece_terms(piece)
        found = list(self.of(terms))
        self._new[0].append(len(terms))
        self._new[1].append(len(found))
        self._new[2].extend(found)
        self[piece] = code = len(self)
        return code

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of some texts: the number of terms of each; and row and entry of every entry, as often as it occurs."""
        if len(self) > MEMO:
            self._forget()
        cut = [pieces(t) for t in texts.cast(pa.binary()).to_pylist()]
        row = np.repeat(np.arange(len(cut)), [len(c) for c in cut])
        code = np.fromiter(map(self.__getitem__, chain.from_iterable(cut)), np.int64, len(row))
        self._sizes, self._counts, self._entries = (np.concatenate((old, np.array(new, np.int64))) for old, new in zip((self._sizes, self._counts, self._entries), self._new))
        self._new = [], [], []
        length = np.bincount(row, self._sizes[code], len(cut)).astype(np.int64)
        some = self._counts[code] > 0
        row, code = row[some], code[some]
        n = self._counts[code]
        first = (np.cumsum(self._counts) - self._counts)[code]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return length, np.repeat(row, n), self._entries[np.repeat(first, n) + within]


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unique: bool = True) -> DataFrame:
    """id, term, tf by the identifier-aware tokenizer.

    Whole documents are counted where they are read, in Arrow batches, so nothing is shuffled; a worker takes each distinct piece of text apart once. `T.tokens` gives the same in the JVM,
    but its nested functions over arrays take more than ten times as long. With unique=False, rows that agree in id are added up, which shuffles.
    """

    def rows(ids: pa.Array, row: list, terms: list, tf: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ids.take(pa.array(row, pa.int64())), pa.array(terms, pa.string()), pa.array(tf, pa.int64())], [id_col, "term", "tf"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, tuple[str, ...]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(at, AT_ONCE)
                row, terms, tf = [], [], []
                for i, text in enumerate(part.column(1).cast(pa.binary()).to_pylist()):
                    own: dict[str, int] = {}
                    for piece, n in Counter(pieces(text)).items():
                        found = memo.get(piece)
                        if found is None:
                            if len(memo) >= MEMO:
                                memo.clear()
                            found = memo[piece] = piece_terms(piece)
                        for term in found:
                            own[term] = own.get(term, 0) + n
                    terms.extend(own.keys())
                    tf.extend(own.values())
                    row.extend([i] * len(own))
                    if len(terms) > MOST:
                        yield rows(part.column(0), row, terms, tf)
                        row, terms, tf = [], [], []
                yield rows(part.column(0), row, terms, tf)

    narrow = docs.select(id_col, F.col(text_col).cast("string").alias(text_col))
    found = narrow.mapInArrow(count, f"{id_col} {dict(docs.dtypes)[id_col]}, term string, tf long")
    return found if unique else found.groupBy(id_col, "term").agg(F.sum("tf").alias("tf"))


def postings_by(docs: DataFrame, split: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same by another tokenizer, which gives an array."""
    return docs.select(id_col, F.explode(split(F.col(text_col))).alias("term")).groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"))


def idf(posts: DataFrame, total: int, id_col: str = "doc_id") -> DataFrame:
    df = posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return df.select("term", "df", idf_of(F.col("df"), total).alias("idf"))


def idf_of(df: Column, total: int) -> Column:
    return F.log(F.lit(1.0) + (F.lit(float(total)) - df + 0.5) / (df + 0.5))


def sparse_vectors(posts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, indices (ascending 32-bit hashes), values; the greatest term wins where two share a hash. Terms are hashed once each."""
    hashed = posts.select("term").distinct().withColumn("idx", stable_u32("term"))
    entry = posts.join(hashed, "term").groupBy(id_col, "idx").agg(F.max_by("tf", "term").cast("float").alias("tf"))
    entries = entry.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("idx", "tf"))).alias("e"))
    return entries.select(id_col, F.transform("e", lambda x: x["idx"]).alias("indices"), F.transform("e", lambda x: x["tf"]).alias("values"))


def asked(posts: DataFrame, queries: DataFrame) -> DataFrame:
    """Postings of the queries' terms, with the queries. Document frequencies are counted over these terms only."""
    return queries.select("query_id", "term", F.col("tf").alias("q_tf")).join(posts, "term")


def tfidf_scores(posts: DataFrame, queries: DataFrame, total: int, id_col: str = "doc_id") -> DataFrame:
    wanted = posts.join(queries.select("term").distinct(), "term", "left_semi")
    weights = idf(wanted, total, id_col).select("term", "idf")
    score = F.sum(F.col("q_tf") * F.col("tf") * F.col("idf"))
    return asked(wanted, queries).join(weights, "term").groupBy("query_id", id_col).agg(F.round(score, DIGITS).alias("score"))


def okapi_scores(posts: DataFrame, queries: DataFrame, total: int, k1: float = 1.5, b: float = 0.75, id_col: str = "doc_id") -> DataFrame:
    """Documents without any of the terms have no row."""
    lengths = posts.groupBy(id_col).agg(F.sum("tf").alias("dl"))
    average = lengths.agg((F.sum("dl") / F.lit(float(max(1, total)))).alias("avgdl"))
    wanted = posts.join(queries.select("term").distinct(), "term", "left_semi")
    weights = idf(wanted, total, id_col).select("term", "idf")
    joined = asked(wanted, queries).join(weights, "term").join(lengths, id_col).crossJoin(F.broadcast(average))  # one row
    part = F.col("q_tf") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return joined.groupBy("query_id", id_col).agg(F.round(F.sum(part), DIGITS).alias("score"))


def ranked(scores: DataFrame, k: int, id_col: str = "doc_id", descending: bool = True) -> DataFrame:
    """The best k of each query with `rank` from 0; ties by id. Spark cuts each partition to k before it shuffles."""
    order = F.desc("score") if descending else F.asc("score")
    window = Window.partitionBy("query_id").orderBy(order, id_col)
    return scores.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)
