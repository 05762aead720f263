"""Token counts: the exact histogram of encoded lengths, and what its suffix sums answer.

`length_histogram(docs)` has a row for each encoded length L that occurs, taken as a context limit too:
n_tokens (L), documents (of that length), tokens (theirs), documents_at_least, tokens_at_least (of documents of L tokens or
more), truncated_tokens (sum of min(length, L) over all documents), share_at_most (documents of L tokens or fewer, over all).

Null and empty texts have length 0 and count as documents. Repeated rows count each time. An empty table gives no rows.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches
from .token_lengths import VOCABULARY, lengths


def count_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """n_tokens, documents: one partial count for each partition, then one row for each length."""

    def partial(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, seen = lengths(vocabulary), {}
        for (texts,) in batches(rows, "text"):
            for text in texts:
                n = of(text)
                seen[n] = seen.get(n, 0) + 1
        yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(list(seen), pa.int64()), "documents": pa.array(list(seen.values()), pa.int64())})

    parts = docs.select("text").mapInArrow(partial, "n_tokens long, documents long")
    return parts.groupBy("n_tokens").agg(F.sum("documents").alias("documents"))


def length_histogram(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The windows run over one row for each distinct length, not for each document; their number is bounded by the longest text."""
    upwards = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("n_tokens") * F.col("documents")
    below = F.sum(tokens).over(upwards) - tokens
    fewer = F.sum("documents").over(upwards) - F.col("documents")
    out = count_lengths(docs, vocabulary).select(
        "n_tokens",
        "documents",
        tokens.alias("tokens"),
        (F.sum("documents").over(whole) - fewer).alias("documents_at_least"),
        (F.sum(tokens).over(whole) - below).alias("tokens_at_least"),
        below.alias("_below"),
        (F.sum("documents").over(upwards) / F.sum("documents").over(whole)).alias("share_at_most"),
    )
    return out.select("n_tokens", "documents", "tokens", "documents_at_least", "tokens_at_least", (F.col("_below") + F.col("n_tokens") * F.col("documents_at_least")).alias("truncated_tokens"), "share_at_most")


def quantile(histogram: DataFrame, share: float) -> int | None:
    """The least length that `share` of the documents don't exceed; None for an empty table."""
    return histogram.filter(F.col("share_at_most") >= share).agg(F.min("n_tokens")).first()[0]


def truncated_total(histogram: DataFrame, limit: int) -> int:
    """Tokens left when every document is cut to `limit` tokens."""
    return histogram.agg(F.coalesce(F.sum(F.col("documents") * F.least("n_tokens", F.lit(limit))), F.lit(0))).first()[0]
