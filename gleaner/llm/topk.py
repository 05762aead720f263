"""Exact top-k search by distributed histogram selection: a stated set of query vectors against all others.

`top_k(vectors, k, every)` has k rows for each query (fewer if there are fewer other vectors): query_id, rank (from 1), vec_id, score. Queries are the
vectors whose vec_id is divisible by `every` (1: all of them). The score is the cosine rounded to six decimals, so an integer number of
millionths; ties go to the lesser vec_id.

1. Queries are written as blocks of unit vectors to the shared folder, from which workers map them into memory. The other vectors stay where they are
   read: everything is scored there, a block of queries against a chunk of vectors at a time. Of a chunk only its own k best (by score, then
   vec_id) go on, as no other can be among the k best of all. Vectors aren't shuffled or broadcast, and each product is computed once.
2. What is left is counted by query in COARSE wide bins of score. The histograms, summed over all chunks, tell the bin of each
   query's kth score, and how many scores lie above it. Within that bin scores are counted singly: now the kth score itself is known.
3. Scores not below it are kept; ties at the kth are broken by vec_id.

Vectors that are null or empty, or have an element that is null, NaN or infinite, are neither queries nor results. Rows that agree in vec_id
are one vector, the least array counting; rows without vec_id are left out. A zero vector has cosine 0 with all. Vectors of
different lengths aren't compared. An empty table gives no rows. Only vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import local_path, materialise, save_array, shared_folder

K, EVERY = 10, 50
#: Millionths in a coarse bin; queries in a block; numbers in a chunk of vectors; queries scored at once.
COARSE, BLOCK, CHUNK, STRIP = 1000, 4096, 1 << 22, 256
SCALE = 1_000_000


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, one row for each vec_id."""
    whole = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return whole.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def units(flat: np.ndarray, dim: int) -> np.ndarray:
    m = flat.reshape(-1, dim)
    top = np.abs(m).max(axis=1, keepdims=True)  # scaled first, so that squares neither overflow nor vanish
    m = m / np.where(top > 0, top, 1)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm > 0, norm, 1)


def _by_dim(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, ids and vectors, for each length."""
    ids, lists = batch.column("vec_id").to_numpy(), batch.column("embedding")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    size = np.diff(lists.offsets.to_numpy())
    flat, dim = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(size, size)
    for d in np.unique(size).tolist():
        yield d, ids[size == d], flat[dim == d].reshape(-1, d)


def query_blocks(queries: DataFrame, block: int) -> tuple[str, list[tuple[int, int]]]:
    """Writes the queries to the shared folder and names the blocks: pairs of length and number, one for about `block` queries. A block that is made again replaces its file by an equal one."""
    folder = local_path(shared_folder(queries.sparkSession, "queries"))
    count = queries.count()
    numbered = queries.select("vec_id", "embedding", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-count // block)))).alias("number"))

    def store(part: pa.Table) -> pa.Table:
        number, made = part.column("number")[0].as_py(), []
        for d, ids, vectors in _by_dim(part.sort_by("vec_id")):
            save_array(folder, f"ids-{d}-{number}", ids)
            save_array(folder, f"units-{d}-{number}", units(vectors, d))
            made.append(d)
        return pa.table({"dim": pa.array(made, pa.int64()), "number": pa.array([number] * len(made), pa.int64())})

    return folder, [tuple(r) for r in numbered.groupBy("number").applyInArrow(store, "dim long, number long").collect()]


def best_of_chunk(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query, vector and score in millionths of each query's k best of a chunk whose ids ascend."""
    for first in range(0, len(q), STRIP):
        own = q_ids[first : first + STRIP]
        s = np.rint((q[first : first + STRIP] @ v.T) * SCALE).astype(np.int32)
        np.clip(s, -SCALE, SCALE, out=s)
        at = np.searchsorted(ids, own)
        same = np.flatnonzero((at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] == own))
        s[same, at[same]] = -2 * SCALE  # a query isn't its own neighbour
        least = np.partition(s, len(ids) - k, axis=1)[:, len(ids) - k, None] if k < len(ids) else np.full((len(s), 1), -SCALE, np.int32)
        row, column = np.nonzero((s >= least) & (s >= -SCALE))
        score = s[row, column]
        order = np.lexsort((column, -score, row))
        row, column, score = row[order], column[order], score[order]
        starts = np.searchsorted(row, np.arange(len(s)))
        kept = np.arange(len(row)) - starts[row] < k
        yield own[row[kept]], ids[column[kept]], score[kept]


def survivors(vectors: DataFrame, folder: str, blocks: list[tuple[int, int]], k: int, chunk: int) -> DataFrame:
    """query_id, vec_id, s: the k best of every chunk of vectors for each query."""

    def scored(dim: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        ids, v = np.concatenate([i for i, _ in parts]), units(np.concatenate([x for _, x in parts]), dim)
        order = np.argsort(ids)
        ids, v = ids[order], v[order]
        for d, number in blocks:
            if d == dim:
                q_ids, q = np.fromfile(f"{folder}/ids-{d}-{number}", np.int64), np.memmap(f"{folder}/units-{d}-{number}", np.float64, "r").reshape(-1, d)
                for found in best_of_chunk(q_ids, q, ids, v, k):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "s"])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for dim, ids, rows in _by_dim(batch):
                parts = held.setdefault(dim, [])
                parts.append((ids, rows))
                if sum(x.size for _, x in parts) >= chunk:
                    yield from scored(dim, held.pop(dim))
        for dim, parts in held.items():
            yield from scored(dim, parts)

    return vectors.mapInArrow(score, "query_id long, vec_id long, s int")


def _kth(counts: DataFrame, k: int) -> DataFrame:
    """query, bin, above: of counts (query, bin, n, above) the highest bin at or above which the query has k scores, or its lowest bin if it has fewer; and the scores above that bin."""
    down = Window.partitionBy("query").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    reached = counts.withColumn("reached", F.col("above") + F.sum("n").over(down))
    at = F.coalesce(F.max(F.when(F.col("reached") >= k, F.col("bin"))), F.min("bin"))
    return reached.groupBy("query").agg(at.alias("kth"), F.coalesce(F.max(F.when(F.col("reached") < k, F.col("reached"))), F.min("above")).alias("kth_above"))


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    whole = usable(vectors)
    folder, blocks = query_blocks(usable(vectors.filter(F.pmod(F.col("vec_id").cast("long"), F.lit(every)) == 0)), block)
    best = materialise(survivors(whole, folder, blocks, k, chunk), "survivors")
    coarse = best.groupBy(F.col("query_id").alias("query"), F.floor(F.col("s") / COARSE).alias("bin")).agg(F.count(F.lit(1)).alias("n")).withColumn("above", F.lit(0).cast("long"))
    bins = _kth(coarse, k)
    within = best.join(bins, best["query_id"] == bins["query"]).filter(F.floor(F.col("s") / COARSE) == F.col("kth"))
    bound = _kth(within.groupBy("query", F.col("s").alias("bin"), F.col("kth_above").alias("above")).agg(F.count(F.lit(1)).alias("n")), k)
    kept = best.join(bound, best["query_id"] == bound["query"]).filter("s >= kth").select("query_id", "vec_id", "s")
    order = Window.partitionBy("query_id").orderBy(F.desc("s"), "vec_id")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", (F.col("s") / SCALE).alias("score"))


ORACLE = f"""
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, d.vec_id AS vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])), 6) AS score
    FROM embeddings q JOIN embeddings d ON q.vec_id <> d.vec_id WHERE q.vec_id % {EVERY} = 0))
WHERE rank <= {K}"""
