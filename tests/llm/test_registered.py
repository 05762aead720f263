"""The registered queries with their production parameters, over small tables, against brute force."""

import math
import random

import pytest
from gleaner.llm import registry
from gleaner.llm.decontaminate import NGRAM, SCORE
from gleaner.llm.token_lengths import lengths

from .test_decontaminate import brute_score
from .test_language_model import brute_of_order
from .test_lines import brute as brute_lines


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(400)]
    items = [" ".join(f"item{i}w{k}" for k in range(20)) for i in range(5)]
    out = []
    for i in range(120):
        own = rng.choices(words, k=rng.randint(3, 60))
        if i % 10 == 0:
            own += items[i // 10 % 5].split()
        text = " ".join(own)
        if out and i % 7 == 3:
            text = out[-3][1] + "\n" + text
        out.append((i, text, "en", f"s{i % 3}", len(text)))
    return [*out, (500, None, "en", "s0", 0), (501, "", None, None, 0)], items


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("registered"))
    spark.createDataFrame(rows[0], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(list(enumerate(rows[1])), "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_language_model_of_order_three(spark, rows, folder):
    got = {r["doc_id"]: r["log_prob"] for r in registry.op2_lm_scoring(spark, folder).collect()}
    texts = [t for _, t, *_ in rows[0]]
    for (i, *_), want in zip(rows[0], brute_of_order(texts, texts, 3)):
        assert math.isclose(got[i], want, rel_tol=1e-9, abs_tol=1e-12)


def test_decontamination(spark, rows, folder):
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in registry.op3_benchmark_decontamination(spark, folder).collect()}
    want = {(i, k): s for i, t, *_ in rows[0] if t for k, item in enumerate(rows[1]) if (s := brute_score(t, item)) >= SCORE}
    assert got == pytest.approx(want) and len(got) >= 12 and NGRAM == 3


def test_mixing_keeps_to_equal_budgets(spark, rows, folder):
    of = lengths()
    token = {i: of(t) for i, t, *_ in rows[0]}
    got = registry.op6_mix_sources(spark, folder).collect()
    for source in ("s0", "s1", "s2"):
        used = sum(token[r["doc_id"]] for r in got if r["source"] == source)
        budget = int(sum(token.values()) * 0.5) // 3
        assert budget - 2 <= used <= budget


def test_sharding_deals_every_document_once_within_its_bound(spark, rows, folder):
    got = registry.op7_sharding(spark, folder).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(i for i, *_ in rows[0])
    sizes = [sum(r["shard"] == k for r in got) for k in range(16)]
    assert max(sizes) <= math.ceil(len(rows[0]) * 1.05 / 16) + 1


def test_line_dedup(spark, rows, folder):
    got = {r["doc_id"]: (r["text"], r["removed"]) for r in registry.op9_line_dedup(spark, folder).collect()}
    assert got == brute_lines([(i, t) for i, t, *_ in rows[0]], 10) and sum(n for _, n in got.values()) >= 10


def test_token_counts(spark, rows, folder):
    of = lengths()
    token = sorted(of(t) for _, t, *_ in rows[0])
    got = {r["n_tokens"]: (r["documents"], r["truncated_tokens"]) for r in registry.op10_token_counts(spark, folder).collect()}
    assert got == {n: (token.count(n), sum(min(n, t) for t in token)) for n in set(token)}
