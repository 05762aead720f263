"""Exact nearest neighbours in named vector spaces, and the offline embedder.

A batch of few queries goes to the vectors, which are scored where they are: nothing but k rows for each query and task is shuffled. Otherwise queries and vectors are
dealt to the cells of a grid, whose rows are groups of queries and whose columns are groups of vectors: a cell holds its queries, and vectors pass by
in blocks. Products are made in single precision; what may be among the k best so far, its error allowed for, is scored again in double precision.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.functions.vectors import hashed_dimension, norm
from gleaner.operators.scan import Best, Gate, numpy_ids
from gleaner.operators.sparse import DIGITS, plain_unions, ranked

#: Vectors in a block; numbers of all queries that are sent to the vectors; queries of a cell, and those multiplied at once; products of a cell.
BLOCK, SENT, HELD, STRIP, PAIRS = 1024, 1 << 21, 1 << 16, 1024, 20_000_000_000
DIMS = 64


def _usable(df: DataFrame, id_col: str, vec_col: str, *others: str) -> DataFrame:
    return df.select(F.col(id_col), F.col(vec_col).cast("array<double>"), *others).filter(F.col(id_col).isNotNull() & (F.size(vec_col) > 0) & ~F.exists(vec_col, lambda x: x.isNull()))


def _by_dim(ids: pa.Array, lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, places and vectors, for each length."""
    size = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    dim = np.repeat(size, size)
    for d in np.unique(size).tolist():
        yield d, np.flatnonzero(size == d), flat[dim == d].reshape(-1, d)


class Scorer:
    """Queries of one length by a metric, and the k best vectors of each so far. Scores of l2 are negative distances."""

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.q, self.metric, self.best = queries, metric, Best(len(queries), k)
        self.square = (queries * queries).sum(1)
        self.single = self._single(queries, self.square, True)

    def _single(self, m: np.ndarray, square: np.ndarray, query: bool) -> tuple[np.ndarray, np.ndarray]:
        """What is multiplied in single precision, and its rows' lengths: the product is the score, for l2 less the query's square."""
        if self.metric == "cosine":
            m = m / np.sqrt(np.where(square > 0, square, 1))[:, None]
        elif self.metric == "l2":
            m = np.column_stack((2 * m, np.full(len(m), -1.0)) if query else (m, square))
        with np.errstate(over="ignore"):
            return m.astype(np.float32), np.sqrt((m * m).sum(1))

    def _pairs(self, at: np.ndarray, v: np.ndarray, square: np.ndarray) -> np.ndarray:
        a = self.q[at]
        if self.metric == "l2":
            return -((a - v) ** 2).sum(1)
        s = (a * v).sum(1)
        return s if self.metric == "dot" else self._cosine(s, np.sqrt(self.square[at]) * np.sqrt(square))

    @staticmethod
    def _cosine(s: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Vectors without length have none."""
        return np.where(length > 0, s / np.where(length > 0, length, 1), -np.inf)

    def _all(self, at: slice, v: np.ndarray, square: np.ndarray) -> np.ndarray:
        s = self.q[at] @ v.T
        if self.metric == "l2":
            return -np.maximum(self.square[at, None] + square - 2 * s, 0)
        return s if self.metric == "dot" else self._cosine(s, np.sqrt(self.square[at])[:, None] * np.sqrt(square))

    def add(self, ids: np.ndarray, v: np.ndarray, allowed: np.ndarray | None = None) -> None:
        with np.errstate(invalid="ignore", over="ignore"):
            square = (v * v).sum(1)
            single, length = self._single(v, square, False)
            for first in range(0, len(self.q), STRIP):
                at = slice(first, first + STRIP)
                least = self.best.score[at, -1]
                own, own_length = self.single[0][at], self.single[1][at]
                top = length.max(initial=0)
                if allowed is not None or np.isneginf(least).any() or not own_length.max() * top < 1e30:
                    s = np.round(self._all(at, v, square), DIGITS)
                    s[~np.isfinite(s)] = -np.inf
                    if allowed is not None:
                        s[~allowed[at]] = -np.inf
                    self._take(first, s, ids)
                    continue
                bound = least - 1e-6 - (own.shape[1] + 8) * 2.0**-22 * own_length * top + (self.square[at] if self.metric == "l2" else 0)
                flat = np.flatnonzero(own @ single.T >= bound.astype(np.float32)[:, None])
                row, place = np.divmod(flat, len(v))
                if len(flat):
                    s = np.round(self._pairs(row + first, v[place], square[place]), DIGITS)
                    self.best.add_pairs(row + first, ids[place], np.where(np.isfinite(s), s, -np.inf))

    def _take(self, first: int, s: np.ndarray, ids: np.ndarray) -> None:
        k = self.best.k
        least = self.best.score[first : first + STRIP, -1]
        if s.shape[1] > k:
            least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k])
        at, place = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        if len(at):
            self.best.add_pairs(at + first, ids[place], s[at, place])


def nearest(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", query_id: str = "query_id", id_col: str = "vec_id", vec_col: str = "embedding", same_dims: int | None = None, marks: dict[object, list[str]] | None = None) -> DataFrame:
    """query_id, id, score, rank (from 0) of the k best by cosine or dot (highest) or l2 (least squared distance). Vectors without length have no cosine.
    With `marks` of each query, only vectors that share one with it (their array column marks) are taken; queries are few then."""
    if metric not in ("cosine", "dot", "l2"):
        raise ValueError(f"unknown metric {metric}")
    if same_dims is not None:
        wrong = vectors.filter(F.size(vec_col) != same_dims).limit(1).count() + queries.filter(F.size(vec_col) != same_dims).limit(1).count()
        if wrong:
            raise ValueError(f"vectors of another length than {same_dims}")
    q, v = _usable(queries, query_id, vec_col), _usable(vectors, id_col, vec_col, *([] if marks is None else ["marks"]))
    schema = f"query_id {dict(queries.dtypes)[query_id]}, {id_col} {dict(vectors.dtypes)[id_col]}, score double"
    sent = q.limit(SENT // DIMS + 1).toArrow().combine_chunks()
    fits = sent.num_rows <= SENT // DIMS and sum(sent.column(1).chunk(0).offsets.to_numpy()[[-1]] if sent.num_rows else [0]) <= SENT
    if marks is not None or fits:
        whole = sent if fits else q.toArrow().combine_chunks()
        found = v.mapInArrow(_sent(whole, k, metric, id_col, marks), schema)
    else:
        found = _grid(q, v, schema, k, metric, query_id, id_col)
    return ranked(found, k, id_col, metric != "l2")


def _sent(queries: pa.Table, k: int, metric: str, id_col: str, marks: dict[object, list[str]] | None):
    """Scores vectors where they are."""
    names, sign = ["query_id", id_col, "score"], -1.0 if metric == "l2" else 1.0

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not queries.num_rows:
            return
        q_ids, id_kind = queries.column(0).chunk(0), None
        own = {d: (q_ids.take(pa.array(at)), Scorer(m, k, metric)) for d, at, m in _by_dim(q_ids, queries.column(1).chunk(0))}
        gates = {d: Gate(marks, ids) for d, (ids, _) in own.items()} if marks is not None else {}
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.slice(first, BLOCK)
                ids, id_kind = part.column(0), part.column(0).type
                for d, at, m in _by_dim(ids, part.column(1)):
                    if d in own:
                        place = pa.array(at)
                        own[d][1].add(numpy_ids(ids.take(place)), m, gates[d](part.column(2).take(place)) if gates else None)
        for ids, scorer in own.values():
            yield from scorer.best.rows(ids, id_kind, names, sign)

    return score


def _grid(q: DataFrame, v: DataFrame, schema: str, k: int, metric: str, query_id: str, id_col: str) -> DataFrame:
    """Every cell has a group of at most about HELD queries, and a group of vectors. Each group of vectors passes on k rows for every query, so there are no more of them
    than keep all cores at work and cells below PAIRS products."""
    spark = q.sparkSession
    plain_unions(spark)
    asked, there = q.count(), v.count()
    down = max(1, -(-asked // HELD))
    across = max(1, -(-max(2 * spark.sparkContext.defaultParallelism, asked * there // PAIRS) // down))
    names, sign = ["query_id", id_col, "score"], -1.0 if metric == "l2" else 1.0

    def pack(df: DataFrame, of: str, other: str, side: int, groups: int) -> DataFrame:
        def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            number = TaskContext.get().partitionId()
            for batch in batches:
                for first in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(first, BLOCK)
                    for d, at, m in _by_dim(part.column(0), part.column(1)):
                        ids = pa.array([part.column(0).take(pa.array(at)).to_pylist()], pa.list_(part.schema.field(0).type))
                        none = pa.nulls(1, pa.list_(pa.int64() if other in ("bigint", "int") else pa.string()))
                        if other == "int":
                            none = pa.nulls(1, pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_arrays([pa.array([number % groups], pa.int32()), pa.array([d], pa.int32()), *((ids, none) if side == 0 else (none, ids)), pa.array([m.tobytes()])], ["own", "dim", "q_ids", "v_ids", "block"])
                        number += 1

        kinds = (of, other) if side == 0 else (other, of)
        found = df.mapInArrow(packed, f"own int, dim int, q_ids array<{kinds[0]}>, v_ids array<{kinds[1]}>, block binary")
        return found.withColumn("side", F.lit(side))

    q_kind, v_kind = dict(q.dtypes)[query_id], dict(v.dtypes)[id_col]
    queries, vectors = pack(q, q_kind, v_kind, 0, down), pack(v, v_kind, q_kind, 1, across)
    cells_q = queries.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(across - 1)), lambda c: F.col("own") * across + c)).alias("cell"), "side", "dim", "q_ids", "v_ids", "block")
    cells_v = vectors.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(down - 1)), lambda r: r * across + F.col("own"))).alias("cell"), "side", "dim", "q_ids", "v_ids", "block")
    dealt = cells_q.unionByName(cells_v).repartitionById(down * across, F.col("cell")).sortWithinPartitions("cell", "side")

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        scorers: dict[int, tuple[pa.Array, Scorer]] = {}
        v_type = None
        for batch in batches:
            q_type, v_type = batch.schema.field("q_ids").type.value_type, batch.schema.field("v_ids").type.value_type
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                m = np.frombuffer(batch.column("block")[i].as_buffer(), np.float64).reshape(-1, dim)
                if batch.column("side")[i].as_py() == 0:
                    held.setdefault(dim, []).append((batch.column("q_ids")[i].as_py(), m.copy()))
                    continue
                if dim in held:
                    parts = held.pop(dim)
                    scorers[dim] = pa.array([x for ids, _ in parts for x in ids], q_type), Scorer(np.concatenate([x for _, x in parts]), k, metric)
                if dim in scorers:
                    scorers[dim][1].add(np.array(batch.column("v_ids")[i].as_py()), m)
        for ids, scorer in scorers.values():
            yield from scorer.best.rows(ids, v_type, names, sign)

    return dealt.mapInArrow(score, schema)


def hashed_embeddings(posts: DataFrame, id_col: str = "doc_id", dims: int = DIMS) -> DataFrame:
    """id, embedding: unit vectors of term counts by hashed dimension, the embedder that needs no model. From texts, `scan.hashed_vectors` gives the same without a shuffle."""
    counts = posts.groupBy(id_col, hashed_dimension(F.col("term"), dims).alias("dim")).agg(F.sum("tf").cast("double").alias("x"))
    dense = counts.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("dim", "x"))).alias("m"))
    raw = dense.select(id_col, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(dims - 1).cast("long")), lambda d: F.coalesce(F.element_at("m", d), F.lit(0.0))).alias("embedding"))
    return raw.withColumn("n", norm(F.col("embedding"))).select(id_col, F.transform("embedding", lambda x: x / F.col("n")).alias("embedding"))
