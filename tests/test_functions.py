import hashlib
import re
import uuid

import pytest
from gleaner.functions import text as T
from gleaner.functions.vectors import cosine, has_vector, max_abs_diff, squared_l2, stable_u32
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

CAMEL = re.compile(T.CAMEL)


def spec(text):
    """The tokenizer as a plain loop."""
    out = []
    for token in re.findall(T.LEXICAL, text, re.A):
        mine = [token.lower()]
        for part in filter(None, token.split(".")):
            mine.append(part.lower())
            mine += [m.lower() for snake in part.split("_") for m in CAMEL.findall(snake)]
        out += dict.fromkeys(mine)
    return out


def on(spark, column, *values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["y"] for r in rows.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_tokens_of_identifiers(spark):
    cases = ["PoissonSolver.solve", "alpha alpha", "compute_stencil", "RBFStencil", "FDDiffOp", "__init__", "bdf3", "", "   ", "()[]{}", "a.b.c x..y .z", "réaile HTTPServer2Go", "A1b_C2"]
    assert on(spark, T.tokens, *cases) == [spec(c) for c in cases]
    assert on(spark, T.tokens, "HeatModel.run")[0] == ["heatmodel.run", "heatmodel", "heat", "model", "run"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="aBcD12_. -é", max_size=30), min_size=30, max_size=30))
def test_tokens_equal_the_plain_loop(texts):
    from pyspark.sql import SparkSession

    assert on(SparkSession.getActiveSession(), T.tokens, *texts) == [spec(t) for t in texts]


def test_other_tokenizers(spark):
    assert on(spark, T.simple_tokens, "HTTPServer.do_it camelCase x2Y")[0] == ["http", "server", "do", "it", "camel", "case", "x2", "y"]
    assert on(spark, T.whitespace_tokens, " a  b\nc ", "") == [["a", "b", "c"], []]
    assert on(spark, lambda c: T.lexical_overlap(F.lit("a b zz"), c), "b a a", "none", "") == [2 / 3, 0.0, 0.0]
    assert on(spark, lambda c: T.lexical_overlap(c, F.lit("a")), "?!") == [0.0]


def test_ids_and_hashes(spark):
    names = ["code:src/a.py:a.f:coarse:0", "", "ü"]
    namespace = uuid.UUID(hex=T.NAMESPACE)
    assert on(spark, T.uuid5, *names) == [str(uuid.uuid5(namespace, n)) for n in names]
    assert on(spark, T.content_hash, "x") == [hashlib.sha256(b"x").hexdigest()]
    many = [f"t{i}" for i in range(50)]
    assert on(spark, T.id63, *many) == [int(hashlib.sha256(t.encode()).hexdigest()[:16], 16) % 2**63 for t in many]
    assert on(spark, stable_u32, "solve", None) == [int.from_bytes(hashlib.blake2b(b"solve", digest_size=4).digest(), "little"), None]
    assert on(spark, T.relative_source, "/home/src/x/src/a.py", "b/c.py", "src/d.py") == ["src/a.py", "b/c.py", "src/d.py"]
    assert on(spark, lambda c: T.module_name(c, "shop"), "/h/src/shop/sub/m.py", "/h/tests/test_x.py", "/h/src/shop/__init__.py") == ["shop.sub.m", "test_x", "shop"]
    f = lambda q: T.coarse_id(F.lit("/h/src/a.py"), F.lit("a"), q)
    assert len(set(on(spark, f, "f", "a.f"))) == 1


def test_display_helpers(spark):
    assert on(spark, T.slugify, "How do I SOLVE it, please, right now?", "?!", "a" * 60) == ["how-do-i-solve-it-please", "session", "a" * 40]
    assert on(spark, T.preview, "see [docs](http://x)\nnow", None, "y" * 251) == ["see docs now", "", "y" * 250 + "…"]
    assert [tuple(r) for r in on(spark, T.parse_ref, "src/a.py:10-25", "a.py:7", "README.md")] == [("src/a.py", 10, 25), ("a.py", 7, 7), ("README.md", None, None)]
    assert on(spark, lambda c: T.shorten_path(c, "pkg/"), "/x/pkg/a.py", "b.py") == ["pkg/a.py", "b.py"]
    assert on(spark, T.fenced_code, "a\n```python\nx = 1\n```\nb", "plain") == ["x = 1\n", "plain"]
    assert on(spark, T.answer_letter, '```json\n{"answer": "b"}\n```', '{"answer": "E"}', "no") == ["B", "X", "X"]
    assert on(spark, lambda c: T.question_text(F.lit("Q?"), c), ["one", "two"], kind="array<string>") == ["Q?\nA. one\nB. two"]
    assert on(spark, lambda c: T.symbol_matches(c, F.lit("A"), F.lit("f")), "A.f", "B.f", "f", "g") == [True, False, True, False]
    assert on(spark, lambda c: T.symbol_matches(c, F.lit(""), F.lit("f"), False), "f", "A.f") == [True, False]
    assert on(spark, T.is_dunder, "__init__", "__", "___", "_x") == [True, True, True, False]
    assert on(spark, lambda c: T.mentions_name(c, F.array(F.lit("np"))), "np.array", "npx", "a_np") == [True, False, False]
    assert on(spark, lambda c: T.context_text(F.lit(" "), c, F.lit("t")), "h", "") == ["h\n\nt", "t"]
    assert on(spark, lambda c: T.rate(c, F.lit(0)), 3, kind="int") == [0.0]
    assert on(spark, lambda c: T.fraction(c, F.lit(4)), 3, kind="int") == ["3/4 (75%)"]
    assert on(spark, lambda c: T.source_label(c, F.lit("f"), "/x/"), "/x/a.py", None) == ["a.py:f", ":f"]


def test_vectors(spark):
    one = F.array(F.lit(1.0), F.lit(0.0))
    assert on(spark, lambda c: cosine(c, one), [0.0, 2.0], [3.0, 0.0], [0.0, 0.0], kind="array<float>") == [0.0, 1.0, None]
    assert on(spark, lambda c: squared_l2(c, one), [0.0, 2.0], kind="array<float>") == [5.0]
    assert on(spark, lambda c: max_abs_diff(c, one), [0.5, 2.0], kind="array<float>") == [2.0]
    assert on(spark, has_vector, [1.0], [], None, kind="array<float>") == [True, False, False]


def test_unknown_representation_is_refused():
    from gleaner.operators.represent import representation

    with pytest.raises(ValueError, match="unknown representation"):
        representation("nope", None)
