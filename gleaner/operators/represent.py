"""Representations of code chunks: ctx, code, codecom and com."""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from gleaner.functions.text import context_text

_TRIPLE = re.compile(r"('''|\"\"\").*?('''|\"\"\")", re.S)
#: A docstring opens a statement: only blanks, parentheses and its prefix are between it and the line's start, a colon or a semicolon.
_OPENING = re.compile(r"(?:\A|[\n\r\f:;])[\s(\\]*[A-Za-z]{0,2}[\"']")
_WITH_BODY = (ast.ClassDef, ast.Module, ast.AsyncFunctionDef, ast.FunctionDef)


def _comment_at(line: str) -> int:
    """Where a comment begins, by the state of quotes; -1 if nowhere."""
    if "#" not in line:
        return -1
    quote = ""
    for at, c in enumerate(line):
        if c == "#" and not quote:
            return at
        if c in "'\"" and quote in ("", c):
            quote = "" if quote else c
    return -1


def _may_have_docstring(text: str) -> bool:
    """Texts of which this is false needn't be parsed."""
    return bool(_OPENING.search(text)) or '"""' in text or "'''" in text


def without_docstrings(text: str) -> str:
    if not _may_have_docstring(text):
        return text
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return _TRIPLE.sub("", text)
    gone: set[int] = set()
    for node in ast.walk(tree):
        head = node.body[0] if isinstance(node, _WITH_BODY) and node.body else None
        if isinstance(head, ast.Expr) and isinstance(head.value, ast.Constant) and isinstance(head.value.value, str):
            gone |= set(range(head.lineno, head.end_lineno + 1))
    return "".join(x for n, x in enumerate(text.splitlines(keepends=True), 1) if n not in gone)


def docstring(text: str) -> str | None:
    if not _may_have_docstring(text):
        return None
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        found = _TRIPLE.search(text)
        return found.group(0)[3:-3].strip() if found else None
    return next((d for n in ast.walk(tree) if isinstance(n, _WITH_BODY) and (d := ast.get_docstring(n))), None)


def code_only(text: str) -> str:
    lines = []
    for line in without_docstrings(text).splitlines(keepends=True):
        body = line.rstrip("\n")
        at = _comment_at(body)
        lines.append((body if at < 0 else body[:at].rstrip()) + line[len(body) :])
    return "".join(lines).strip() or text


def comments_only(text: str) -> str | None:
    found = [c for line in text.splitlines() if (at := _comment_at(line)) >= 0 and (c := line[at + 1 :].strip())]
    parts = [p for p in (docstring(text), "\n".join(found)) if p]
    return "\n".join(parts) or None


def _mapped(of, texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else of(t) for t in texts.to_pylist()], pa.string())


def _code(texts: pa.Array) -> pa.Array:
    return _mapped(code_only, texts)


def _com(texts: pa.Array) -> pa.Array:
    return _mapped(comments_only, texts)


def representation(kind: str, text: Column, summary: Column | None = None, header: Column | None = None) -> Column:
    """The text to embed; com is null for a chunk that has neither docstring nor comments, so it gets no vector."""
    empty = F.lit("")
    if kind == "ctx":
        return context_text(F.coalesce(summary if summary is not None else empty, empty), F.coalesce(header if header is not None else empty, empty), F.coalesce(text, empty))
    if kind == "code":
        return F.arrow_udf(_code, "string")(text)
    if kind == "codecom":
        return text
    if kind == "com":
        return F.arrow_udf(_com, "string")(text)
    raise ValueError(f"unknown representation {kind}")
