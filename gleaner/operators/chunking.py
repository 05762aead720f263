"""Chunkers: sections in the JVM, fixed lines in Arrow batches; Python sources by their syntax tree, a file at a time, in Arrow batches."""

from __future__ import annotations

import ast
import io
import re
import tokenize as lexer
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T

FINE_MOST, FINE_LEAST, SECTION_TOKENS = 5, 3, 400
CHUNK = "text string, qualname string, chunk_type string, line_start int, line_end int, source_file string, parent_class string, module string"
#: Continued lines, and other ends of lines than newlines.
_ODD = re.compile(r"[\\\r\f\v\x1c-\x1e\x85\u2028\u2029]")
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def line_chunks(docs: DataFrame, lines: int = 40, id_col: str = "doc_id") -> DataFrame:
    """id, chunk_idx, line_start, line_end, text: every `lines` lines. A text is cut once, where it is read: its time grows with its length, not with the number of its chunks times that."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                row, at, ends, texts = [], [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    if text is None:
                        continue
                    own = text.split("\n")
                    starts = range(0, len(own), lines)
                    row += [i] * len(starts)
                    at += starts
                    ends += [min(s + lines, len(own)) for s in starts]
                    texts += ["\n".join(own[s : s + lines]) for s in starts]
                begins = np.array(at, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), pa.array(begins // lines), pa.array(begins + 1), pa.array(ends, pa.int32()), pa.array(texts, pa.string())], [id_col, "chunk_idx", "line_start", "line_end", "text"])

    return docs.select(id_col, F.col("text").cast("string").alias("text")).mapInArrow(cut, f"{id_col} {dict(docs.dtypes)[id_col]}, chunk_idx int, line_start int, line_end int, text string")


def sections(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, section_idx, title, text: a part for each `## ` header, and what comes before as overview. Empty parts are left out."""
    parts = docs.select(id_col, F.posexplode(F.split("text", r"(?m)^(?=## .)")).alias("section_idx", "part"))
    header = F.regexp_extract("part", r"^## (.+)", 1)
    return parts.select(id_col, "section_idx", F.when(header == "", F.lit("overview")).otherwise(F.trim(header)).alias("title"), F.regexp_replace("part", r"^\s+|\s+$", "").alias("text")).filter("text <> ''")


def subsections(parts: DataFrame, count: Callable[[Column], Column] | None = None, most: int = SECTION_TOKENS) -> DataFrame:
    """Sections of more tokens than `most` become their paragraphs, with paragraph_idx from 0. `count` is the token counter, of words by default."""
    count = count or (lambda c: F.size(T.whitespace_tokens(c)))
    paragraphs = F.filter(F.transform(F.split("text", "\n\n"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    texts = F.when(count(F.col("text")) <= most, F.array("text")).otherwise(paragraphs)
    others = [c for c in parts.columns if c != "text"]
    return parts.select(*others, F.posexplode(texts).alias("paragraph_idx", "text"))


Spans = list[tuple[int, int]]


def windows_of(ends: list[int], line_count: int) -> Spans:
    """Greedy windows over statements that end at these lines: one closes once it has FINE_LEAST lines and the next statement would make it longer than FINE_MOST."""
    out: Spans = []
    start, end, held = 1, 0, 0
    for place, statement_end in enumerate(ends):
        full = held and statement_end - start >= FINE_MOST and end - start + 1 >= FINE_LEAST
        if full:
            out.append((start, end))
            start, held = end + 1, 0
        held += 1
        end = line_count if place == len(ends) - 1 else statement_end
    if held:
        out.append((start, end))
    return out


def line_windows(docs: DataFrame, id_col: str = "doc_id", size: int = FINE_MOST) -> DataFrame:
    """id, window_idx, line_start, line_end, text: what windows of single-line statements come to."""
    return line_chunks(docs, size, id_col).withColumnRenamed("chunk_idx", "window_idx")


def _start(node: ast.AST) -> int:
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])


def _slice(lines: list[str], first: int, last: int, without: set[int] = frozenset()) -> str:
    return "\n".join(line for n, line in enumerate(lines[first - 1 : last], first) if n not in without).rstrip("\n")


def coarse_chunks_of(path: str, source: str, module: str) -> list[tuple]:
    """Rows of CHUNK: module docstring, functions, class headers without their methods, methods. A file that doesn't parse has none."""
    lines = source.split("\n")
    if path.rsplit("/", 1)[-1] == "__init__.py":
        return [(source.rstrip("\n"), f"{module}.__init__", "module_exports", 1, len(source.splitlines()), path, None, module)] if source.strip() else []
    try:
        body = ast.parse(source).body
    except (SyntaxError, ValueError):
        return []
    out = []

    def add(node: ast.AST, name: str, kind: str, parent: str | None, without: set[int] = frozenset()) -> None:
        out.append((_slice(lines, _start(node), node.end_lineno, without), name, kind, _start(node), node.end_lineno, path, parent, module))

    if body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
        add(body[0], module, "module_docstring", None)
    for node in body:
        if isinstance(node, _FUNCTIONS):
            add(node, node.name, "function", None)
        elif isinstance(node, ast.ClassDef):
            methods = [m for m in node.body if isinstance(m, _FUNCTIONS)]
            add(node, node.name, "class_header", None, {n for m in methods for n in range(_start(m), m.end_lineno + 1)})
            for m in methods:
                add(m, f"{node.name}.{m.name}", "method", node.name)
    return out


def function_chunks_of(path: str, source: str, module: str, nested: bool = True) -> list[tuple]:
    """All functions with the class around them, those within functions too unless `nested` is false; each range of lines once."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out, seen = [], set()

    def visit(node: ast.AST, parent: str | None) -> None:
        children = [*ast.iter_child_nodes(node)]
        for child in children:
            if isinstance(child, _FUNCTIONS):
                span = _start(child), child.end_lineno
                if span not in seen:
                    seen.add(span)
                    out.append((_slice(source.split("\n"), *span), f"{parent}.{child.name}" if parent else child.name, "function", *span, path, parent, module))
                if nested:
                    visit(child, parent)
            else:
                visit(child, child.name if isinstance(child, ast.ClassDef) else parent)

    visit(tree, None)
    return out


def _chunk(of: Callable):
    def chunk(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for p, s, m in zip(*(c.to_pylist() for c in batch.columns)) for r in of(p, s or "", m)]
            kinds = {"string": pa.string(), "int": pa.int32()}
            fields = [f.split() for f in CHUNK.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[t]) for i, (_, t) in enumerate(fields)], [n for n, _ in fields])

    return chunk


def code_chunks(files: DataFrame, package: str, functions_only: bool = False, nested: bool = True) -> DataFrame:
    """Chunks of Python files (path, source): coarse ones, or all functions."""
    of = (lambda p, s, m: function_chunks_of(p, s, m, nested)) if functions_only else coarse_chunks_of
    return files.select("path", "source", T.module_name(F.col("path"), package).alias("module")).mapInArrow(_chunk(of), CHUNK)


def split_by_length(chunks: DataFrame, least: int = 5, inclusive: bool = True) -> tuple[DataFrame, DataFrame]:
    """Those of `least` lines or more, and the others; without `inclusive` the difference of the lines counts."""
    size = F.col("line_end") - F.col("line_start") + (1 if inclusive else 0)
    return chunks.filter(size >= least), chunks.filter(~(size >= least))


def statement_ends(source: str) -> list[int]:
    """Last lines of the statements of the first function's body, comments on lines of their own among them."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        import textwrap

        try:
            tree = ast.parse(textwrap.dedent(source))
        except (SyntaxError, ValueError):
            return []
    node = next((n for n in tree.body if isinstance(n, _FUNCTIONS)), None)
    if node is None:
        return []
    spans = [(_start(s), s.end_lineno) for s in node.body]
    ends = [e for _, e in spans]
    if "#" not in source:
        return sorted(ends)
    header = max([node.lineno, *(n.end_lineno for n in ast.walk(node.args) if hasattr(n, "end_lineno")), *([node.returns.end_lineno] if node.returns else [])])
    if not _ODD.search(source):
        # Beyond the header, what is outside all statements is no part of a string: a line that begins with a hash is a comment.
        for line, own in enumerate(source.split("\n"), 1):
            if own.lstrip().startswith("#") and header < line <= node.end_lineno and not any(a <= line <= b for a, b in spans):
                ends.append(line)
        return sorted(ends)
    try:
        for token in lexer.generate_tokens(io.StringIO(source).readline):
            line = token.start[0]
            own = token.type == lexer.COMMENT and not token.line[: token.start[1]].strip()
            if own and header < line <= node.end_lineno and not any(a <= line <= b for a, b in spans):
                ends.append(line)
    except (lexer.TokenError, SyntaxError):
        pass
    return sorted(ends)


def fine_chunks(chunks: DataFrame) -> DataFrame:
    """Windows of functions and methods: the coarse columns with the window's text and lines, parent_id, window_idx, granularity."""
    names = [f.split()[0] for f in CHUNK.split(", ")]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                lines = row["text"].splitlines()
                if row["chunk_type"] in ("function", "method") and lines:
                    for k, (a, b) in enumerate(windows_of(statement_ends(row["text"]) or [len(lines)], len(lines))):
                        out.append(row | {"text": "\n".join(lines[a - 1 : b]).rstrip("\n"), "chunk_type": "fine", "line_start": a + row["line_start"] - 1, "line_end": b + row["line_start"] - 1, "window_idx": k})
            schema = pa.schema([(n, pa.int32() if n.startswith("line") else pa.string()) for n in names] + [("window_idx", pa.int32())])
            yield pa.RecordBatch.from_pylist(out, schema)

    fine = chunks.select(*names).mapInArrow(cut, CHUNK + ", window_idx int")
    key = F.col("source_file"), F.col("module"), F.col("qualname")
    return fine.withColumn("parent_id", T.coarse_id(*key)).withColumn("point_id", T.fine_id(*key, F.col("window_idx"))).withColumn("granularity", F.lit("fine"))


def unique_chunks(chunks: DataFrame, id_col: str, *order: Column) -> DataFrame:
    """The first row of each id."""
    return chunks.withColumn("_n", F.row_number().over(Window.partitionBy(id_col).orderBy(*order))).filter("_n = 1").drop("_n")
