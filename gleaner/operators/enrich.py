"""Enrichment of chunks: context headers, lexicon terms, cross references, symbols, summaries, vectors taken over from papers."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import text as T
from gleaner.operators.scan import FEW
from gleaner.operators.sparse import Coder, plain_unions, postings

NUMBA = frozenset("cfunc guvectorize jit njit prange stencil vectorize".split())
Imports = list[tuple[str, list[str]]]
_DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def signature(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?m)^\s*((?:async\s+)?def\b.*)$", 1), F.lit(""))


def neighbours(rows: DataFrame, group: str, order: str, value: Column, eligible: Column | None = None) -> DataFrame:
    """above, below: the value of the nearest eligible row before and after, strictly by `order` within the group. Rows that aren't eligible have neighbours, too."""
    kept = F.when(F.lit(True) if eligible is None else eligible, value)
    w = Window.partitionBy(group).orderBy(order)
    marked = rows.withColumn("_v", kept)
    return marked.withColumn("above", F.last("_v", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, -1))).withColumn("below", F.first("_v", ignorenulls=True).over(w.rangeBetween(1, Window.unboundedFollowing))).drop("_v")


def imports_of(source: str) -> Imports:
    """Every import statement, in one form, with the names it binds; star imports bind none and are left out."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return []
    out = []
    for node in filter(lambda n: isinstance(n, ast.Import | ast.ImportFrom), ast.walk(tree)):
        whole = isinstance(node, ast.Import)
        names = [a.asname or (a.name.partition(".")[0] if whole else a.name) for a in node.names if a.name != "*"]
        if names:
            out.append((ast.unparse(node), names))
    return out


def file_imports(files: DataFrame) -> DataFrame:
    """source_file, imports (line, names): one row for each file."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("line", pa.string()), ("names", pa.list_(pa.string()))]))
        for batch in batches:
            found = [[{"line": line, "names": names} for line, names in imports_of(s or "")] for s in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["source_file", "imports"])

    return files.select("path", "source").mapInArrow(find, "source_file string, imports array<struct<line:string,names:array<string>>>")


def context_headers(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Adds context_header: class, imports that the text uses, signatures of the functions above and below."""
    near = neighbours(chunks, "source_file", "line_start", F.struct(signature(F.col("text")).alias("s")), F.col("chunk_type").isin("function", "method"))
    with_imports = near.join(file_imports(files), "source_file", "left")
    used = F.transform(F.filter(F.coalesce("imports", F.array().cast("array<struct<line:string,names:array<string>>>")), lambda i: T.mentions_name(F.col("text"), i["names"])), lambda i: F.concat(F.lit("# "), i["line"]))
    named = lambda prefix, c: F.concat(F.lit(prefix), c)
    lines = F.concat(F.array(named("# class: ", F.col("parent_class"))), used, F.array(named("# above: ", F.col("above.s")), named("# below: ", F.col("below.s"))))
    return with_imports.withColumn("context_header", F.array_join(lines, "\n")).drop("imports", "above", "below")


def with_terms(docs: DataFrame, lexicon: DataFrame, name: str = "terms") -> DataFrame:
    """Adds an array of the lexicon's (term) entries in each text, once each, longest first. Terms with a space or hyphen are searched as substrings; others must be
    tokens. A lexicon of no more than FEW terms goes to the texts, so that nothing is shuffled; a larger one is joined with their postings."""
    rows = lexicon.select(F.lower("term").alias("term")).filter("term is not null").distinct().limit(FEW + 1).collect()
    if len(rows) > FEW:
        found = docs.withColumn("_row", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
        terms = _joined_terms(found, lexicon, "_row").groupBy("_row").agg(_longest_first().alias(name))
        return found.join(terms, "_row", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>"))).drop("_row")
    words = [r["term"] for r in rows]
    phrases, single = [w for w in words if " " in w or "-" in w], {w: i for i, w in enumerate(words) if " " not in w and "-" not in w}
    columns = docs.columns
    at = columns.index("text")

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(lambda terms: [single[t] for t in terms if t in single])
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = part.column(at).cast(pa.string())
                out: list[set[str]] = [set() for _ in range(part.num_rows)]
                _, row, entry = coder.read(texts)
                for r, e in zip(row.tolist(), entry.tolist()):
                    out[r].add(words[e])
                for own, text in zip(out, texts.to_pylist() if phrases else ()):
                    lower = (text or "").lower()
                    own.update(p for p in phrases if p in lower)
                out = [sorted(own, key=lambda t: (-len(t), t)) for own in out]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.list_(pa.string()))], [*columns, name])

    fields = ", ".join(f"`{c}` {kind}" for c, kind in docs.dtypes)
    return docs.mapInArrow(find, f"{fields}, {name} array<string>")


def _longest_first() -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct((-F.length("term")).alias("n"), "term"))), lambda x: x["term"])


def _joined_terms(docs: DataFrame, lexicon: DataFrame, id_col: str, posts: DataFrame | None = None) -> DataFrame:
    plain_unions(docs.sparkSession)
    words = lexicon.select(F.lower("term").alias("term")).distinct()
    phrases, single = words.filter("term rlike '[ -]'"), words.filter("not term rlike '[ -]'")
    by_phrase = docs.select(id_col, F.lower("text").alias("lower")).join(phrases, F.contains("lower", "term")).select(id_col, "term")
    posts = postings(docs, id_col) if posts is None else posts
    return posts.select(id_col, "term").join(single, "term").select(id_col, "term").unionByName(by_phrase)


def term_table(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", posts: DataFrame | None = None) -> DataFrame:
    """id, term: the lexicon's entries in each text, as rows. With `posts` (postings that are there already) they are joined with these."""
    if posts is not None:
        return _joined_terms(docs, lexicon, id_col, posts)
    return with_terms(docs.select(id_col, "text"), lexicon, "_terms").select(id_col, F.explode("_terms").alias("term"))


def lexicon_terms(docs: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", posts: DataFrame | None = None) -> DataFrame:
    """id, terms: the same as one array for each id that has any, longest first."""
    if posts is None:
        return with_terms(docs.select(id_col, "text"), lexicon).filter(F.size("terms") > 0).select(id_col, "terms")
    return term_table(docs, lexicon, id_col, posts).groupBy(id_col).agg(_longest_first().alias("terms"))


def symbol_table(chunks: DataFrame) -> DataFrame:
    """qualname, last_segment, point_id of functions, classes and methods; names with double underscores at both ends and package files are left out."""
    named = chunks.filter(F.col("chunk_type").isin("function", "class_header", "method") & ~F.endswith("source_file", F.lit("__init__.py"))).withColumn("last_segment", F.element_at(F.split("qualname", r"\."), -1))
    full = F.concat_ws(".", "module", "qualname")
    return named.filter((F.col("chunk_type") == "class_header") | ~T.is_dunder(F.col("last_segment"))).select(full.alias("qualname"), "last_segment", T.coarse_id(F.col("source_file"), F.col("module"), F.col("qualname")).alias("point_id"))


def cross_references(calls: DataFrame, symbols: DataFrame, id_col: str = "point_id") -> DataFrame:
    """id, cross_refs, cross_ref_ids: all symbols whose last segment is called, by name."""
    hits = calls.select(id_col, "name").distinct().join(symbols.select(F.col("last_segment").alias("name"), "qualname", F.col("point_id").alias("ref_id")), "name")
    refs = hits.groupBy(id_col).agg(F.array_sort(F.collect_set(F.struct("qualname", "ref_id"))).alias("r"))
    return refs.select(id_col, F.transform("r", lambda x: x["qualname"]).alias("cross_refs"), F.transform("r", lambda x: x["ref_id"]).alias("cross_ref_ids"))


def code_facts_of(text: str) -> tuple[list[str], bool]:
    """Names called in a chunk, and whether its definition has a numba decorator."""
    import textwrap

    try:
        tree = ast.parse(textwrap.dedent(text))
    except (SyntaxError, ValueError):
        return [], False
    last = lambda f: f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
    calls = sorted({n for c in ast.walk(tree) if isinstance(c, ast.Call) and (n := last(c.func))})
    node = next((n for n in tree.body if isinstance(n, _DEFINITIONS)), None)
    marks = [last(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list] if node is not None and not isinstance(node, ast.ClassDef) else []
    return calls, any(m in NUMBA for m in marks)


def code_facts(chunks: DataFrame) -> DataFrame:
    """Adds calls and has_numba."""

    @F.arrow_udf("struct<calls:array<string>,has_numba:boolean>")
    def facts(texts: pa.Array) -> pa.Array:
        rows = [code_facts_of(t or "") for t in texts.to_pylist()]
        return pa.array([{"calls": c, "has_numba": n} for c, n in rows], pa.struct([("calls", pa.list_(pa.string())), ("has_numba", pa.bool_())]))

    return chunks.withColumn("_f", facts("text")).withColumns({"calls": F.col("_f.calls"), "has_numba": F.col("_f.has_numba")}).drop("_f")


def summarise(chunks: DataFrame, cache: DataFrame, summarizer: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks with llm_summary and cache_hit, and the rows to append to the cache. A summary is taken from the cache by content hash; `summarizer`
    is a vectorised UDF for the others; where it gives null or "" nothing is cached."""
    found = chunks.withColumn("content_hash", T.content_hash(F.col("text"))).join(cache.select("content_hash", F.col("summary").alias("_cached")), "content_hash", "left")
    made = F.lit(None).cast("string") if summarizer is None else F.when(F.col("_cached").isNull(), summarizer(F.col("text")))
    out = found.withColumn("cache_hit", F.col("_cached").isNotNull()).withColumn("llm_summary", F.coalesce("_cached", made, F.lit(""))).drop("_cached")
    return out, out.filter("not cache_hit and llm_summary <> ''").groupBy("content_hash").agg(F.min("llm_summary").alias("summary"))


def paper_links(points: DataFrame, papers: DataFrame) -> DataFrame:
    """point_id, math_source_id: for coarse points, the least paper that shares a term; found by an equi-join over terms."""
    code = points.filter("granularity = 'coarse'").select("point_id", F.explode("math_terms").alias("term"))
    theirs = papers.select(F.col("point_id").alias("paper_id"), F.explode("math_terms").alias("term"))
    return code.join(theirs, "term").groupBy("point_id").agg(F.min("paper_id").alias("math_source_id"))


def paper_vectors(links: DataFrame, vectors: DataFrame, space: str = "math__qwen3") -> DataFrame:
    """The papers' vectors as rows of the points that refer to them."""
    theirs = vectors.select(F.col("point_id").alias("math_source_id"), "embedding")
    return links.join(theirs, "math_source_id").select("point_id", F.lit(space).alias("space"), "embedding")
