from gleaner.operators import chunking as C
from gleaner.operators import enrich as N
from gleaner.operators import represent as P
from hypothesis import given
from hypothesis import strategies as st

SOURCE = '''"""Module words."""
import os
from math import floor as fl, *

@njit(cache=True)
def alone(x):
    """Doc."""
    # a comment
    y = fl(x)  # why

    def inner():
        return "#no"
    return helper(y)


class Thing(Base):
    kind = 1

    @property
    def name(self):
        return os.sep

    async def go(self): return alone(1)
'''.replace(", *", "")


def test_coarse_chunks():
    rows = C.coarse_chunks_of("/s/src/pkg/m.py", SOURCE, "pkg.m")
    assert [(r[1], r[2], r[3], r[4], r[6]) for r in rows] == [("pkg.m", "module_docstring", 1, 1, None), ("alone", "function", 5, 13, None), ("Thing", "class_header", 16, 23, None), ("Thing.name", "method", 19, 21, "Thing"), ("Thing.go", "method", 23, 23, "Thing")]
    header = rows[2][0]
    assert "kind = 1" in header and "os.sep" not in header and "async" not in header
    assert rows[1][0].startswith("@njit") and rows[3][0].startswith("    @property")
    assert C.coarse_chunks_of("a/__init__.py", "x = 1\n", "a")[0][1:5] == ("a.__init__", "module_exports", 1, 1)
    assert C.coarse_chunks_of("a/__init__.py", " \n", "a") == C.coarse_chunks_of("m.py", "def (", "m") == []


def test_function_chunks_with_and_without_nested():
    names = lambda n: [r[1] for r in C.function_chunks_of("m.py", SOURCE, "m", n)]
    assert names(True) == ["alone", "inner", "Thing.name", "Thing.go"] and names(False) == ["alone", "Thing.name", "Thing.go"]


def test_windows_by_hand():
    assert C.windows_of([2, 3, 4, 5, 6, 7, 8, 9], 9) == [(1, 5), (6, 9)]
    assert C.windows_of([6, 7, 8], 8) == [(1, 6), (7, 8)]
    assert C.windows_of([], 4) == []


@given(st.lists(st.integers(1, 6), min_size=1, max_size=30))
def test_windows_cover_all_lines_and_break_between_statements(sizes):
    ends = [sum(sizes[: i + 1]) + 1 for i in range(len(sizes))]
    windows = C.windows_of(ends, ends[-1])
    assert windows[0][0] == 1 and windows[-1][1] == ends[-1]
    assert all(a[1] + 1 == b[0] for a, b in zip(windows, windows[1:]))
    assert all(b in ends for _, b in windows) and all(b - a + 1 >= 3 for a, b in windows[:-1])


def test_comments_count_as_statements():
    assert C.statement_ends("def f(x):\n    # one\n    y = 1\n    return (\n        y\n    )\n") == [2, 3, 6]
    assert C.statement_ends("x = 1") == C.statement_ends("def (") == []


def test_imports_calls_and_decorators():
    assert N.imports_of(SOURCE) == [("import os", ["os"]), ("from math import floor as fl", ["fl"])]
    assert N.imports_of("import a.b\nfrom c import *\nfrom d import e") == [("import a.b", ["a"]), ("from d import e", ["e"])]
    assert N.code_facts_of("@nb.njit\ndef f():\n    g(h.k())") == (["g", "k"], True)
    assert N.code_facts_of("    @plain\n    def f(self): pass") == ([], False) and N.code_facts_of("def (") == ([], False)


def test_representations():
    text = 'def f():\n    """Doc."""\n    x = "#a"  # note\n    return x\n'
    assert P.code_only(text) == 'def f():\n    x = "#a"\n    return x'
    assert P.comments_only(text) == "Doc.\nnote" and P.comments_only("x = 1") is None
    broken = "    x = (\n '''inner'''\n # c"
    assert P.comments_only(broken) == "inner\nc" and "inner" not in P.code_only(broken)
    assert P.code_only("# only") == "# only"


def test_headers_symbols_and_fine_points(spark):
    files = spark.createDataFrame([("/s/src/pkg/m.py", SOURCE), ("/s/src/pkg/__init__.py", "from .m import alone\n")], "path string, source string")
    chunks = C.code_chunks(files, "pkg")
    heads = {r["qualname"]: r["context_header"] for r in N.context_headers(chunks, files).collect()}
    assert heads["alone"] == "# from math import floor as fl\n# below: def name(self):"
    assert heads["Thing.name"] == "# class: Thing\n# import os\n# above: def alone(x):\n# below: async def go(self): return alone(1)"
    symbols = {r["qualname"] for r in N.symbol_table(chunks).collect()}
    assert symbols == {"pkg.m.alone", "pkg.m.Thing", "pkg.m.Thing.name", "pkg.m.Thing.go"}
    fine = C.fine_chunks(chunks).orderBy("line_start").collect()
    assert {r["qualname"] for r in fine} == {"alone", "Thing.name", "Thing.go"} and all(r["granularity"] == "fine" and r["parent_id"] for r in fine)
    refs = {r["point_id"]: r["cross_refs"] for r in N.cross_references(spark.createDataFrame([("p", "go"), ("p", "alone"), ("q", "none")], "point_id string, name string"), N.symbol_table(chunks)).collect()}
    assert refs == {"p": ["pkg.m.Thing.go", "pkg.m.alone"]}
    kept, dropped = C.split_by_length(chunks, 5)
    assert kept.count() + dropped.count() == chunks.count() and {r["qualname"] for r in kept.collect()} == {"alone", "Thing"}


def test_summaries_and_their_cache(spark):
    from pyspark.sql import functions as F

    chunks = spark.createDataFrame([("a",), ("b",), ("bad",)], "text string")
    cache = spark.createDataFrame([("none", "x")], "content_hash string, summary string")
    made = lambda c: F.when(c != "bad", F.concat(F.lit("about "), c))
    out, new = N.summarise(chunks, cache, made)
    assert sorted((r["text"], r["llm_summary"], r["cache_hit"]) for r in out.collect()) == [("a", "about a", False), ("b", "about b", False), ("bad", "", False)]
    again, none = N.summarise(chunks.filter("text <> 'bad'"), new, made)
    assert again.filter("cache_hit").count() == 2 and none.count() == 0
