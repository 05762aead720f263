"""Embedders by name, adapters for models, and the embedding of points in several named spaces."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.vectors import norm
from gleaner.operators import dense, represent, scan, sparse
from gleaner.sources.store import FINE_SPACES, MODELS, parse_space

#: From id, text to id, embedding; the flag tells queries from passages.
Encode = Callable[[DataFrame, str, bool], DataFrame]


@dataclass(frozen=True)
class Embedder:
    name: str
    dims: int
    encode: Encode

    def passages(self, texts: DataFrame, id_col: str = "point_id") -> DataFrame:
        return self.encode(texts, id_col, False)

    def queries(self, texts: DataFrame, id_col: str = "query_id") -> DataFrame:
        return self.encode(texts, id_col, True)


class Registry:
    """Embedders by name. A name that is taken or unknown is an error, never a default."""

    def __init__(self, *embedders: Embedder):
        self._known: dict[str, Embedder] = {}
        for e in embedders:
            self.register(e)

    def register(self, embedder: Embedder) -> None:
        if embedder.name in self._known:
            raise ValueError(f"embedder {embedder.name!r} is registered already")
        if MODELS.get(embedder.name, embedder.dims) != embedder.dims:
            raise ValueError(f"embedder {embedder.name!r} has {embedder.dims} dimensions, not {MODELS[embedder.name]}")
        self._known[embedder.name] = embedder

    def get(self, name: str) -> Embedder:
        if name not in self._known:
            raise KeyError(f"no embedder {name!r}; there are {', '.join(sorted(self._known)) or 'none'}")
        return self._known[name]

    def names(self) -> list[str]:
        return sorted(self._known)


def _hashed(texts: DataFrame, id_col: str, _: bool) -> DataFrame:
    return scan.hashed_vectors(texts, id_col)


HASHED = Embedder("hashed", dense.DIMS, _hashed)


def normalised(v: Column) -> Column:
    return F.when(norm(v) > 0, F.transform(v, lambda x: x / norm(v))).otherwise(v)


def last_pool(states: Column) -> Column:
    """The last token's state."""
    return F.element_at(states, -1)


def mean_pool(states: Column) -> Column:
    """The mean of the tokens' states."""
    zero = F.transform(states[0], lambda x: F.lit(0.0))
    total = F.aggregate(states, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    return F.transform(total, lambda x: x / F.size(states))


def _adapter(states: Callable[[Column], Column], pool: Callable[[Column], Column], passage: str, query: str, unit: bool) -> Encode:
    def encode(texts: DataFrame, id_col: str, is_query: bool) -> DataFrame:
        prefix = query if is_query else passage
        vector = pool(states(F.concat(F.lit(prefix), F.coalesce("text", F.lit("")))))
        found = texts.select(id_col, vector.alias("v"))
        return found.select(id_col, (normalised(F.col("v")) if unit else F.col("v")).alias("embedding"))

    return encode


def code_embedder(states: Callable[[Column], Column], passage: str = "Candidate code snippet:\n", query: str = "Find the most relevant code snippet given the following query:\n") -> Embedder:
    """A model for code: prefixes for passages and queries, the last token's state, unit length. `states` is a vectorised UDF from text to its tokens' states."""
    return Embedder("jinacode", MODELS["jinacode"], _adapter(states, last_pool, passage, query, True))


def instruction_embedder(states: Callable[[Column], Column], task: str = "Given a question, retrieve passages that answer it") -> Embedder:
    """An instruction model: only queries have the task before them; the last token's state, unit length."""
    return Embedder("qwen3", MODELS["qwen3"], _adapter(states, last_pool, "", f"Instruct: {task}\nQuery: ", True))


def mean_pool_embedder(states: Callable[[Column], Column]) -> Embedder:
    """A model without prefixes: the mean of all tokens' states, of any length, so whoever scores must normalise."""
    return Embedder("unixcoder", MODELS["unixcoder"], _adapter(states, mean_pool, "", "", False))


def needed(spaces: list[str]) -> list[str]:
    """The models of some spaces, each once, in order."""
    return list(dict.fromkeys(parse_space(s)[1] for s in spaces))


def embed_spaces(points: DataFrame, spaces: list[str], registry: Registry) -> DataFrame:
    """point_id, space, embedding: every coarse point in all the spaces, fine points in those of FINE_SPACES only. A point whose representation is null (com without comments) has no vector there."""
    none = F.lit(None).cast("string")
    column = lambda c: F.col(c) if c in points.columns else none
    parts = []
    for space in spaces:
        kind, model, _, _ = parse_space(space)
        own = points if space in FINE_SPACES else points.filter("granularity = 'coarse'")
        text = column("llm_summary") if kind == "summary" else represent.representation("codecom" if kind in ("math", "paper") else kind, F.col("text"), column("llm_summary"), column("context_header"))
        texts = own.select("point_id", text.alias("text")).filter("text <> ''")
        parts.append(registry.get(model).passages(texts).select("point_id", F.lit(space).alias("space"), "embedding"))
    return reduce(DataFrame.unionByName, parts)


def point_postings(points: DataFrame) -> DataFrame:
    """point_id, term, tf of every point's raw text; points without tokens have none."""
    return sparse.postings(points.select("point_id", "text"), "point_id")
