"""Line dedup by pairwise alignment: overlapping documents are aligned with patience diff, and blocks they share leave the later one.

`without_common_blocks(docs)` has every row of docs once: doc_id, text (without the deleted lines), removed (lines deleted).

1. Lines are compared by the hash of their text without blanks around it; blank lines are never compared or deleted. A line is rare
   if 2 documents or more have it, and no more than RARE of all documents, or LEAST of them.
2. Each document that has a rare line is paired with the first one that has it, so a line with m documents makes m - 1 pairs.
   Lines that more documents have are seeds in runs: two of them that follow each other, blank lines aside, and the whole document if it has no
   other lines. Each document that has a run is paired with the first one that has it, however many have it. A single line over the limit is no seed.
3. Each pair is aligned by its lines: equal lines at both ends, then lines that are once in both in their longest common order, then the
   same again between these. All aligned lines, rare or not, are deleted from the later document, and then every run of two
   lines over the limit that no alignment touched, though a first one has it (it occurs twice or in another order). Alignments are of the
   original texts, so a deleted line is still in the first document that has it.

Later means a larger doc_id. Rows that agree in doc_id aren't compared with each other; equal rows lose the same lines. Rows
without doc_id or text are returned as they are. A document that is all repeated becomes an empty text. An empty table gives no rows.
Only doc_id and text are read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MIX, materialise, mix, row_key

RARE, LEAST = 0.01, 10


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions of two sequences, by patience diff."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, i_end, j, j_end = todo.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        in_a, in_b = Counter(a[i:i_end]), Counter(b[j:j_end])
        where = {b[y]: y for y in range(j, j_end) if in_b[b[y]] == 1}
        both = [(x, where[a[x]]) for x in range(i, i_end) if in_a[a[x]] == 1 and a[x] in where]
        if not both:
            continue
        # The longest increasing run of positions in b, by patience sorting.
        tops, piles, back = [], [], []
        for n, (_, y) in enumerate(both):
            p = bisect_left(tops, y)
            tops[p : p + 1], piles[p : p + 1] = [y], [n]
            back.append(piles[p - 1] if p else -1)
        n, chain = piles[-1], []
        while n >= 0:
            chain.append(both[n])
            n = back[n]
        last_x, last_y = i, j
        for x, y in reversed(chain):
            out.append((x, y))
            todo.append((last_x, x, last_y, y))
            last_x, last_y = x + 1, y + 1
        todo.append((last_x, i_end, last_y, j_end))
    return sorted(out)


def _align(frequent: np.ndarray):
    def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = frozenset(frequent.tolist())
        for batch in batches:
            rows, gone, runs = [], [], []
            for row, own, at, first in zip(*(batch.column(c).to_pylist() for c in ("row", "lines", "places", "first_lines"))):
                aligned = [at[y] for _, y in patience(first, own)]
                blocks = {b for b in zip(first, first[1:]) if b[0] in over and b[1] in over}
                shared = [[at[k], at[k + 1]] for k, b in enumerate(zip(own, own[1:])) if b in blocks]
                if aligned or shared:
                    rows.append(row)
                    gone.append(aligned)
                    runs.append(shared)
            places = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(gone, places), pa.array(runs, pa.list_(places))], ["row", "gone", "runs"])

    return align


def _runs(frequent: np.ndarray):
    """Hashes of two frequent lines that follow each other, and of whole documents of frequent lines."""

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            for i, lines in enumerate(batch.column("lines").to_pylist()):
                own = np.array(lines, np.int64)
                is_frequent = np.isin(own, frequent)
                own = own.view(np.uint64)
                with np.errstate(over="ignore"):
                    some = np.unique(mix(mix(own[:-1]) * MIX + own[1:])[is_frequent[:-1] & is_frequent[1:]])
                    if len(own) and is_frequent.all():
                        whole = np.bitwise_xor.reduce(mix(mix(own) + np.arange(1, len(own) + 1, dtype=np.uint64) * MIX))
                        some = np.append(some, mix(np.array([whole + np.uint64(len(own))], np.uint64)))
                at.append(np.full(len(some), i))
                found.append(some)
            at = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("row").take(at), pa.array(np.concatenate(found).view(np.int64))], ["doc_id", "row", "run"])

    return runs


def without_common_blocks(docs: DataFrame, rare: float = RARE, least: int = LEAST) -> DataFrame:
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("row", row_key("doc_id", "text"))
    named = own.filter("doc_id is not null and text is not null")
    trimmed = F.transform(F.split("text", "\n"), lambda x: F.trim(x))
    places = F.filter(F.sequence(F.lit(0), F.size("all") - 1), lambda i: F.element_at("all", i + 1) != "").cast("array<int>")
    hashed = named.select("doc_id", "row", trimmed.alias("all")).select("doc_id", "row", F.transform(F.filter("all", lambda x: x != ""), lambda x: F.xxhash64(x)).alias("lines"), places.alias("places"))
    distinct = hashed.select("doc_id", "row", F.explode(F.array_distinct("lines")).alias("line"))
    count = named.select(F.col("doc_id")).agg(F.greatest(F.lit(float(least)), F.count(F.lit(1)) * F.lit(rare)).alias("most")).first()["most"]
    shared = materialise(distinct.groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "row")).alias("first")).filter("n > 1"), "shared-lines")
    # Fewer than 1 / rare times the mean number of lines in a document.
    frequent = shared.filter(F.col("n") > F.lit(count)).select("line").toPandas()["line"].to_numpy(np.int64)
    pairs = distinct.join(shared.filter(F.col("n") <= F.lit(count)).select("line", "first"), "line").filter("doc_id > first.doc_id").select("row", F.col("first.row").alias("first_row"))
    if len(frequent):
        runs = materialise(hashed.select("doc_id", "row", "lines").mapInArrow(_runs(frequent), "doc_id long, row long, run long"), "runs")
        first = runs.groupBy("run").agg(F.min(F.struct("doc_id", "row")).alias("first"))
        pairs = pairs.unionByName(runs.join(first, "run").filter("doc_id > first.doc_id").select("row", F.col("first.row").alias("first_row")))
    pairs = pairs.distinct()
    texts = hashed.dropDuplicates(["row"]).select("row", "lines", "places")
    firsts = texts.select(F.col("row").alias("first_row"), F.col("lines").alias("first_lines"))
    gone = pairs.join(texts, "row").join(firsts, "first_row").select("row", "lines", "places", "first_lines").mapInArrow(_align(frequent), "row long, gone array<int>, runs array<array<int>>")
    gone = gone.groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"), F.flatten(F.collect_list("runs")).alias("runs"))
    untouched = F.flatten(F.filter("runs", lambda x: ~F.arrays_overlap(x, "gone")))
    gone = gone.select(F.col("row").alias("g_row"), F.array_distinct(F.concat("gone", untouched)).alias("gone"))
    every = F.split("text", "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(every) - 1), "gone"), lambda i: F.get(every, i))
    joined = own.join(gone, own["row"] == gone["g_row"], "left")
    return joined.select("doc_id", F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
