"""Mixing sources to target weights: fit each source's token budget exactly, by lengths.

Documents are counted by source and exact token length. A source's budget is its weight's share of the total. From every
part of the lengths it first takes the same proportion of documents; what the budget then lacks is fitted by a bounded
knapsack (a reachability bitset over token sums) from the documents left over; so the sum comes as close to the budget as the
lengths left over allow, without exceeding it. Which documents fill a length's count is decided by a seeded hash.

Rows that agree in doc_id, source and text are one unit: they go or stay together and count with their joint length, one
unit for each such group. A null source is a source of its own, with weight 0 unless `weights` names None. Null and empty texts have length 0, cost nothing, and are all kept where
their source has a weight. An empty table, or a total of 0, selects nothing but documents of length 0. Other columns are carried through and never read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SEED, materialise, row_key, seeded
from .token_lengths import VOCABULARY, lengths

#: Share of all tokens that is selected when no total is given.
SHARE = 0.5
#: Tokens of each budget that are left to the knapsack: at most these, of a small budget a tenth or four of its longest documents; what rounding adds to them is first taken off, longest documents first.
RESERVE = 2048
#: Units of a source and length that are ranked together.
RANKED = 100_000


def fit(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take, for the largest sum that doesn't exceed the budget."""
    total, reserve = sum(n * c for n, c in counts.items()), min(RESERVE, max(budget // 10, 4 * max(counts, default=0)), budget)
    if total <= budget:
        return dict(counts)
    # The same share of every part of the lengths, shortest first: rounding goes over from length to length, as most have few documents.
    take, seen, used = {0: counts[0]} if 0 in counts else {}, 0, 0
    for n in sorted(n for n in counts if n):
        seen += counts[n]
        take[n] = seen * (budget - reserve) // total - used
        used += take[n]
    lack = budget - sum(n * c for n, c in take.items())
    while lack < 0:  # too much by the rounding: the shortest document that mends it goes, or else the longest
        n = min((n for n in take if n >= -lack and take[n]), default=None) or max(n for n in take if take[n])
        take[n] -= 1
        lack += n
    for n in sorted((n for n in counts if n), reverse=True):  # a large lack is first brought down to what the bitset spans
        more = max(0, min(counts[n] - take[n], (lack - reserve) // n))
        take[n] += more
        lack -= more * n
    # Of each length, at most lack // n more can fit. Counts are split into powers of two, and a bit of `reach` says that a sum can be made.
    reach, steps = 1, []
    mask = (1 << (lack + 1)) - 1
    for n in sorted((n for n in counts if 0 < n <= lack and counts[n] > take[n]), reverse=True):
        left, size = min(counts[n] - take[n], lack // n), 1
        while left:
            part = min(size, left)
            new = (reach | reach << n * part) & mask
            if new != reach:
                steps.append((n, part, reach))
            reach, left, size = new, left - part, size * 2
        if reach >> lack & 1:
            break
    best = reach.bit_length() - 1
    for n, part, before in reversed(steps):
        if not before >> best & 1:
            take[n] += part
            best -= n * part
    return take


def token_table(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, _row (64-bit key of doc_id, source and text), n_tokens: a narrow table, so that nothing later moves texts."""

    def count(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lengths(vocabulary)
        for batch in rows:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "source", "_row")], pa.array([of(t) for t in texts], pa.int64())], ["doc_id", "source", "_row", "n_tokens"])

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text"), row_key("doc_id", "source", "text").alias("_row"))
    return narrow.mapInArrow(count, "doc_id long, source string, _row long, n_tokens long")


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, total: int | None = None, share: float = SHARE, vocabulary: str = VOCABULARY, seed: int = SEED) -> DataFrame:
    """doc_id, source, n_tokens of each selected unit, and its _row key. `weights`: of sources; equal for all non-null sources by default. `total`: tokens wanted; by default `share` of all there are."""
    units = materialise(token_table(docs, vocabulary).groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.sum("n_tokens").alias("n_tokens")), "lengths")
    counts: dict[str | None, dict[int, int]] = {}
    # One row for each source and distinct length: bounded by the longest text, however many documents there are.
    for source, n, c in units.groupBy("source", "n_tokens").count().collect():
        counts.setdefault(source, {})[n] = c
    weights = weights if weights is not None else {s: 1.0 for s in counts if s is not None}
    all_tokens = sum(n * c for s in counts.values() for n, c in s.items())
    total = int(all_tokens * share) if total is None else total
    scale = sum(weights.get(s, 0) for s in counts) or 1
    quotas = [(s, n, k, max(1, c[n] // RANKED)) for s, c in counts.items() if weights.get(s, 0) > 0 for n, k in fit(c, int(total * weights[s] / scale)).items() if k]
    wanted = docs.sparkSession.createDataFrame(quotas, "q_source string, q_tokens long, q_take long, q_parts long")
    # Ranks in two steps, by the part of the hash's range and within it: no length, however common, is one task.
    chance = seeded(F.col("_row"), seed)
    asked = units.join(wanted, units.source.eqNullSafe(wanted.q_source) & (units.n_tokens == wanted.q_tokens)).withColumn("_part", F.floor(chance / F.lit(2.0**63) * F.col("q_parts")))
    before = F.sum("n").over(Window.partitionBy("p_source", "p_tokens").orderBy("p_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = asked.groupBy(F.col("source").alias("p_source"), F.col("n_tokens").alias("p_tokens"), F.col("_part").alias("p_part")).agg(F.count(F.lit(1)).alias("n")).withColumn("_before", F.coalesce(before, F.lit(0)))
    placed = asked.join(parts, asked.source.eqNullSafe(parts.p_source) & (asked.n_tokens == parts.p_tokens) & (asked._part == parts.p_part)).filter(F.col("_before") < F.col("q_take"))
    rank = F.row_number().over(Window.partitionBy("source", "n_tokens", "_part").orderBy(chance, "_row"))
    return placed.withColumn("_rank", F.col("_before") + rank).filter(F.col("_rank") <= F.col("q_take")).select("doc_id", "source", "n_tokens", "_row")


def mixed_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The selected documents with all their columns. The join is by a key that is null-safe; Spark broadcasts the keys only where they are measured to be small."""
    chosen = mix_sources(docs, **options).select(F.col("_row").alias("chosen"))
    return docs.join(chosen, row_key("doc_id", "source", "text") == chosen["chosen"], "left_semi")
