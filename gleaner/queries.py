"""The registered queries over the driver's tables, and the same in DuckDB's SQL.

Documents are the corpus and benchmark items the queries. All run over whole tables and texts. A score is rounded to six decimals before it is ranked; ties go to the lesser id.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner import drivers
from gleaner import evaluate as V
from gleaner.functions import text as T
from gleaner.functions.vectors import as_double, max_abs_diff, stable_u32
from gleaner.operators import chunking, dense, embed, enrich, fusion, represent, scan, sparse
from gleaner.plans import ingest
from gleaner.plans import retrieval as R
from gleaner.sources import files, store
from gleaner.streaming import events as E

K = 10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql.strip()
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# SQL pieces.

LEX = r"\w+(?:\.\w+)*"


def _terms(name: str, source: str, id_col: str, text: str = "text") -> str:
    """CTEs that end in `name`(id, term, tf). RE2 has no lookahead: humps are found by four replacements."""
    return f"""
{name}_lex AS (SELECT {id_col}, tok, count(*) AS c FROM (SELECT {id_col}, unnest(regexp_extract_all({text}, '{LEX}')) AS tok FROM {source}) GROUP BY ALL),
{name}_tok AS (SELECT DISTINCT tok FROM {name}_lex),
{name}_dot AS (SELECT tok, p FROM (SELECT tok, unnest(string_split(tok, '.')) AS p FROM {name}_tok) WHERE p <> ''),
{name}_snake AS (SELECT tok, s FROM (SELECT tok, unnest(string_split(p, '_')) AS s FROM {name}_dot) WHERE s <> ''),
{name}_camel AS (SELECT tok, unnest(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '([a-z])([A-Z0-9])', '\\1 \\2', 'g'), '([0-9])([A-Za-z])', '\\1 \\2', 'g'), '([A-Z])([0-9])', '\\1 \\2', 'g'), ' ')) AS f FROM {name}_snake),
{name}_cand AS (SELECT tok, lower(tok) AS term FROM {name}_tok UNION SELECT tok, lower(p) FROM {name}_dot UNION SELECT tok, lower(f) FROM {name}_camel WHERE f <> ''),
{name} AS (SELECT {id_col}, term, CAST(sum(c) AS BIGINT) AS tf FROM {name}_lex JOIN {name}_cand USING (tok) GROUP BY ALL)"""


DOC, ASK = _terms("doc", "documents", "doc_id"), _terms("ask", "(SELECT item_id AS query_id, text FROM benchmark)", "query_id")


def _tfidf(name: str = "tfidf", doc: str = "doc", total: str = "(SELECT count(*) FROM documents)") -> str:
    return f"""
{name}_df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM {doc} GROUP BY term),
{name} AS (SELECT query_id, doc_id, round(sum(a.tf * d.tf * ln(1.0 + ({total} - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE)))), 6) AS score
  FROM ask a JOIN {doc} d USING (term) JOIN {name}_df USING (term) GROUP BY ALL)"""


OKAPI = """
okapi_df AS (SELECT term, CAST(count(*) AS DOUBLE) AS df FROM doc GROUP BY term),
dl AS (SELECT doc_id, CAST(sum(tf) AS DOUBLE) AS dl FROM doc GROUP BY doc_id),
al AS (SELECT sum(dl) / (SELECT count(*) FROM documents) AS avgdl FROM dl),
okapi AS (SELECT query_id, doc_id, round(sum(a.tf * ln(1.0 + ((SELECT count(*) FROM documents) - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) * d.tf * CAST(2.5 AS DOUBLE) / (d.tf + CAST(1.5 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * dl / avgdl))), 6) AS score
  FROM ask a JOIN doc d USING (term) JOIN okapi_df USING (term) JOIN dl USING (doc_id) CROSS JOIN al GROUP BY ALL)"""


def _hashed(name: str, terms: str, id_col: str) -> str:
    return f"""
{name}_x AS (SELECT {id_col}, CAST('0x' || substr(md5(term), 1, 8) AS BIGINT) % {dense.DIMS} AS dim, CAST(sum(tf) AS DOUBLE) AS x FROM {terms} GROUP BY ALL),
{name} AS (SELECT {id_col}, dim, x / sqrt(sum(x * x) OVER (PARTITION BY {id_col})) AS x FROM {name}_x)"""


def _dense(name: str = "near", vectors: str = "dv") -> str:
    return f"""
{name} AS (SELECT query_id, doc_id, round(sum(q.x * d.x), 6) AS score FROM qv q JOIN {vectors} d USING (dim) GROUP BY ALL),
{name}_all AS (SELECT q.query_id, d.doc_id, coalesce(score, 0.0) AS score FROM (SELECT DISTINCT query_id FROM qv) q CROSS JOIN (SELECT DISTINCT doc_id FROM {vectors}) d LEFT JOIN {name} n ON n.query_id = q.query_id AND n.doc_id = d.doc_id)"""


def _leg(name: str, scores: str, k: int = 20, weight: float = 1.0) -> str:
    return f"""
{name} AS (SELECT query_id, doc_id, score, r - 1 AS rank, CAST({weight} AS DOUBLE) / (60 + r) AS part FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM {scores}) WHERE r <= {k})"""


def _fused(legs: list[str], k: int = K, name: str = "fused") -> str:
    union = " UNION ALL ".join(f"SELECT query_id, doc_id, part FROM {leg}" for leg in legs)
    return f"""
{name} AS (SELECT query_id, doc_id, CAST(r - 1 AS INTEGER) AS fused_rank, s AS fused_score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id) AS r FROM (SELECT query_id, doc_id, round(sum(part), 6) AS s FROM ({union}) GROUP BY ALL)) WHERE r <= {k})"""


HYBRID = DOC + "," + ASK + "," + _tfidf() + "," + _hashed("dv", "doc", "doc_id") + "," + _hashed("qv", "ask", "query_id") + "," + _dense() + "," + _leg("l1", "near_all") + "," + _leg("l2", "tfidf")
TOPK = "SELECT query_id, doc_id, score, CAST(r - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM {scores}) WHERE r <= {k}"
LONG = ["query_id", "doc_id", "fused_rank", "fused_score"]


# Tokens and postings.


@query(f"WITH {DOC} SELECT doc_id, term, tf FROM doc")
def tokenize_tf(spark, sf_dir):
    return sparse.postings(texts(spark, sf_dir))


@query(r"""SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(string_split(lower(regexp_replace(regexp_replace(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'), '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g')), ' ')) AS term FROM documents) WHERE term <> '' GROUP BY ALL""")
def simple_tf(spark, sf_dir):
    return sparse.postings_by(texts(spark, sf_dir), T.simple_tokens)


@query(r"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS term FROM documents) WHERE term <> '' GROUP BY ALL")
def whitespace_tf(spark, sf_dir):
    return sparse.postings_by(texts(spark, sf_dir), T.whitespace_tokens)


@query(f"WITH {DOC}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents) SELECT term, df, round(ln(1.0 + (n - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))), 6) AS idf FROM (SELECT term, count(*) AS df FROM doc GROUP BY term) CROSS JOIN n")
def idf(spark, sf_dir):
    return sparse.idf(sparse.postings(texts(spark, sf_dir)), table(spark, sf_dir, "documents").count()).withColumn("idf", F.round("idf", 6))


@query()
def sparse_vectors(spark, sf_dir):
    return sparse.sparse_vectors(sparse.postings(texts(spark, sf_dir)))


@query()
def stable_hash(spark, sf_dir):
    terms = sparse.postings(texts(spark, sf_dir)).select("term").distinct()
    return terms.withColumn("hash", stable_u32("term"))


# Ranking.


@query(f"WITH {DOC}, {ASK}, {_tfidf()} " + TOPK.format(scores="tfidf", k=K))
def tfidf_topk(spark, sf_dir):
    return R.sparse_leg(_index(spark, sf_dir), items(spark, sf_dir), K)


@query(f"WITH {DOC}, {ASK}, {OKAPI} " + TOPK.format(scores="okapi", k=K))
def okapi_topk(spark, sf_dir):
    return R.okapi_leg(_index(spark, sf_dir), items(spark, sf_dir), K)


_PAIRS = "embeddings q CROSS JOIN embeddings d"


def _near(spark, sf_dir, metric):
    vectors = table(spark, sf_dir, "embeddings")
    return dense.nearest(vectors.withColumnRenamed("vec_id", "query_id"), vectors, K, metric)


def _near_sql(score: str, order: str) -> str:
    return f"SELECT query_id, vec_id, score, CAST(r - 1 AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score {order}, vec_id) AS r FROM (SELECT q.vec_id AS query_id, d.vec_id AS vec_id, round({score}, 6) AS score FROM {_PAIRS})) WHERE r <= {K}"


_V = "CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])"


@query(_near_sql(f"list_cosine_similarity({_V})", "DESC"))
def dense_cosine_topk(spark, sf_dir):
    return _near(spark, sf_dir, "cosine")


@query(_near_sql(f"list_inner_product({_V})", "DESC"))
def dense_dot_topk(spark, sf_dir):
    return _near(spark, sf_dir, "dot")


@query(_near_sql(f"pow(list_distance({_V}), 2)", "ASC"))
def dense_l2_topk(spark, sf_dir):
    return _near(spark, sf_dir, "l2")


def _index(spark, sf_dir) -> R.Index:
    return R.build_index(table(spark, sf_dir, "documents"))


@query(f"WITH {HYBRID}, {_fused(['l1', 'l2'])} SELECT * FROM fused")
def rrf_hybrid(spark, sf_dir):
    return R.hybrid(_index(spark, sf_dir), items(spark, sf_dir), K).select(*LONG)


@query(f"WITH {HYBRID}, {_fused(['l1', 'l2'])} SELECT fused.query_id, fused.doc_id, fused_rank, coalesce(l1.score, 0.0) AS dense, coalesce(l2.score, 0.0) AS sparse FROM fused LEFT JOIN l1 USING (query_id, doc_id) LEFT JOIN l2 USING (query_id, doc_id)")
def leg_scores(spark, sf_dir):
    found = R.hybrid(_index(spark, sf_dir), items(spark, sf_dir), K)
    return found.select("query_id", "doc_id", "fused_rank", F.element_at("leg_scores", "dense").alias("dense"), F.element_at("leg_scores", "sparse").alias("sparse"))


@query(f"WITH {HYBRID}, {OKAPI}, {_leg('w1', 'near_all', 20, 1.0)}, {_leg('w2', 'okapi', 20, 0.5)}, {_leg('w3', 'tfidf', 20, 2.0)}, {_fused(['w1', 'w2', 'w3'])} SELECT * FROM fused")
def trimodal_weighted(spark, sf_dir):
    return R.trimodal(_index(spark, sf_dir), items(spark, sf_dir), {"ctx": 1.0, "math": 0.5, "sparse": 2.0}, K).select(*LONG)


_FR = "(SELECT * FROM documents WHERE lang IN ('fr', 'es'))"


@query(f"WITH {_terms('doc', _FR, 'doc_id')}, {ASK}, {_tfidf(total=f'(SELECT count(*) FROM {_FR} x)')}, {_hashed('dv', 'doc', 'doc_id')}, {_hashed('qv', 'ask', 'query_id')}, {_dense()}, {_leg('l1', 'near_all')}, {_leg('l2', 'tfidf')}, {_fused(['l1', 'l2'])} SELECT * FROM fused")
def hybrid_filtered(spark, sf_dir):
    docs = R.build_index(sparse.spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")), keep=False)
    return R.hybrid_filtered(docs, items(spark, sf_dir), "lang", ["fr", "es"], K).select(*LONG)


@query("SELECT CAST(NULL AS BIGINT) AS query_id, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS INTEGER) AS fused_rank, CAST(NULL AS DOUBLE) AS fused_score WHERE false")
def oracle_mode(spark, sf_dir):
    return R.hybrid(_index(spark, sf_dir), items(spark, sf_dir), K, injected_ids=[1, 2]).select(*LONG)


@query(f"""WITH {HYBRID}, {_fused(['l1', 'l2'], 20)},
words AS (SELECT f.query_id, f.doc_id, f.fused_rank, list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9_]+')) AS q, list_distinct(regexp_extract_all(lower(d.text), '[a-z0-9_]+')) AS t FROM fused f JOIN benchmark b ON b.item_id = f.query_id JOIN documents d USING (doc_id)),
scored AS (SELECT query_id, doc_id, fused_rank, CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / CAST(len(q) AS DOUBLE) ELSE 0.0 END AS rerank FROM words)
SELECT query_id, doc_id, rerank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, fused_rank) - 1 AS INTEGER) AS fused_rank FROM scored""")
def lexical_rerank(spark, sf_dir):
    asked, docs = items(spark, sf_dir), table(spark, sf_dir, "documents")
    best = R.hybrid(_index(spark, sf_dir), asked, 20).persist(StorageLevel.MEMORY_AND_DISK)
    found = best.join(asked.select("query_id", F.col("text").alias("query_text")), "query_id").join(scan.named(docs.select("doc_id", "text"), best), "doc_id")
    return fusion.rerank(found, T.lexical_overlap(F.col("query_text"), F.col("text"))).select("query_id", "doc_id", F.element_at("leg_scores", "rerank").alias("rerank"), "fused_rank")


@query(f"""WITH {HYBRID}, {_fused(['l1', 'l2'], 20)},
packed AS (SELECT query_id, doc_id, fused_rank, CAST(sum(length(text)) OVER (PARTITION BY query_id ORDER BY fused_rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS chars FROM fused JOIN documents USING (doc_id))
SELECT * FROM packed WHERE chars <= 8000""")
def prompt_pack(spark, sf_dir):
    found = R.with_payload(R.hybrid(_index(spark, sf_dir), items(spark, sf_dir), 20), table(spark, sf_dir, "documents"), "text")
    return fusion.pack_prompt(found).select("query_id", "doc_id", "fused_rank", "chars")


_LEXICON = "SELECT DISTINCT term FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9_]{7,}')) AS term FROM benchmark) UNION SELECT DISTINCT regexp_extract(lower(text), '^[a-z0-9_]+ [a-z0-9_]+') FROM benchmark WHERE regexp_matches(lower(text), '^[a-z0-9_]+ [a-z0-9_]+')"


def _lexicon(spark, sf_dir) -> DataFrame:
    """Long words of the items, and the phrases that they begin with."""
    text = F.lower("text")
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(text, F.lit("[a-z0-9_]{7,}"), F.lit(0))).alias("term"))
    phrases = table(spark, sf_dir, "benchmark").select(F.regexp_extract(text, "^[a-z0-9_]+ [a-z0-9_]+", 0).alias("term")).filter("term <> ''")
    return words.unionByName(phrases).distinct()


_TERMS = f"""lexicon AS ({_LEXICON}),
found AS (SELECT doc_id, term FROM doc JOIN lexicon USING (term) WHERE NOT regexp_matches(term, '[ -]') UNION SELECT doc_id, term FROM documents JOIN lexicon ON contains(lower(text), term) WHERE regexp_matches(term, '[ -]'))"""


@query(f"WITH {DOC}, {_TERMS} SELECT doc_id, term FROM found")
def lexicon_terms(spark, sf_dir):
    return enrich.lexicon_terms(texts(spark, sf_dir), _lexicon(spark, sf_dir)).select("doc_id", F.explode("terms").alias("term"))


_PAPER, _CODE = "(SELECT * FROM documents WHERE lang = 'en')", "(SELECT * FROM documents WHERE lang <> 'en')"


@query(f"""WITH {_terms('pd', _PAPER, 'doc_id')}, {_terms('cd', _CODE, 'doc_id')}, {DOC}, {ASK}, {_TERMS},
{_tfidf('ps', 'pd', f'(SELECT count(*) FROM {_PAPER} x)')}, {_tfidf('cs', 'cd', f'(SELECT count(*) FROM {_CODE} x)')},
{_hashed('qv', 'ask', 'query_id')}, {_hashed('pv', 'pd', 'doc_id')}, {_hashed('cv', 'cd', 'doc_id')}, {_dense('pn', 'pv')}, {_dense('cn', 'cv')},
{_leg('p1', 'pn_all')}, {_leg('p2', 'ps')}, {_fused(['p1', 'p2'], 10, 'pf')},
best AS (SELECT query_id, doc_id FROM pf WHERE fused_rank < 5),
allowed AS (SELECT DISTINCT b.query_id, c.doc_id FROM best b JOIN found p ON p.doc_id = b.doc_id JOIN found c ON c.term = p.term JOIN {_CODE} x ON x.doc_id = c.doc_id),
a1 AS (SELECT n.* FROM cn_all n SEMI JOIN allowed USING (query_id, doc_id)), a2 AS (SELECT n.* FROM cs n SEMI JOIN allowed USING (query_id, doc_id)),
{_leg('c1', 'a1')}, {_leg('c2', 'a2')}, {_fused(['c1', 'c2'])} SELECT * FROM fused""")
def two_leg_bridge(spark, sf_dir):
    docs = sparse.spread(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    lexicon = _lexicon(spark, sf_dir)
    sides = [docs.filter(c) for c in ("lang = 'en'", "lang <> 'en'")]
    papers, code = (replace(R.build_index(d, dealt=True), points=enrich.with_terms(d, lexicon)) for d in sides)
    return R.two_leg(papers, code, items(spark, sf_dir), "terms", K).select(*LONG)


_WINDOWS = """
line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
win AS (SELECT doc_id AS parent_id, CAST((n - 1) // 5 AS INTEGER) AS w, string_agg(line, chr(10) ORDER BY n) AS text FROM line GROUP BY ALL),
fine AS (SELECT parent_id * 10000000 + w AS doc_id, parent_id, text FROM win)"""


@query(f"""WITH {_WINDOWS}, {_terms('doc', 'fine', 'doc_id')}, {ASK}, {_tfidf(total='(SELECT count(*) FROM fine)')}, ranked AS ({TOPK.format(scores='tfidf', k=20)}),
best AS (SELECT query_id, parent_id AS doc_id, arg_min(doc_id, rank) AS child_id, min(rank) AS rank, arg_min(score, rank) AS score FROM ranked JOIN fine USING (doc_id) GROUP BY ALL)
SELECT query_id, doc_id, child_id, score AS fused_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) - 1 AS INTEGER) AS fused_rank FROM best QUALIFY fused_rank < 10""")
def fine_to_coarse(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    windows = chunking.line_windows(texts(spark, sf_dir))
    fine = windows.select((F.col("doc_id") * F.lit(10_000_000).cast("long") + F.col("window_idx")).alias("doc_id"), F.col("doc_id").alias("parent_id"), "text")
    leg = lambda index, asked, n: R.sparse_leg(index, asked, n).select("query_id", "doc_id", F.col("rank").alias("fused_rank"), F.col("score").alias("fused_score"))
    return R.fine_to_coarse(fine, docs, items(spark, sf_dir), K, leg, dealt=True).select("query_id", "doc_id", "child_id", "fused_score", "fused_rank")


@query("""WITH RECURSIVE edge AS (SELECT c_custkey AS src, n_nationkey + 1000000 AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_nationkey + 1000000, n_regionkey + 2000000 FROM nation),
hop AS (SELECT c_custkey AS query_id, CAST(c_custkey AS BIGINT) AS doc_id, 0 AS hop FROM customer UNION SELECT h.query_id, e.dst, h.hop + 1 FROM hop h JOIN edge e ON e.src = h.doc_id WHERE h.hop < 2)
SELECT query_id, doc_id, CAST(min(hop) AS INTEGER) AS hop FROM hop GROUP BY query_id, doc_id""")
def expand_refs(spark, sf_dir):
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    here, there = F.col("n_nationkey") + F.lit(1000000).cast("long"), F.col("n_regionkey") + F.lit(2000000).cast("long")
    edges = customer.select(F.col("c_custkey").alias("src"), (F.col("c_nationkey") + F.lit(1000000).cast("long")).alias("dst")).unionByName(nation.select(here.alias("src"), there.alias("dst")))
    points = nation.select(here.alias("doc_id")).unionByName(region.select((F.col("r_regionkey") + F.lit(2000000).cast("long")).alias("doc_id")))
    start = customer.select(F.col("c_custkey").alias("query_id"), F.col("c_custkey").alias("doc_id"))
    return R.expand_refs(start, edges, points, 2)


# Chunks and enrichment.


@query("""WITH line AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT doc_id, CAST((n - 1) // 40 AS INTEGER) AS chunk_idx, CAST(min(n) AS INTEGER) AS line_start, CAST(max(n) AS INTEGER) AS line_end, string_agg(line, chr(10) ORDER BY n) AS text FROM line GROUP BY doc_id, (n - 1) // 40""")
def fixed_line_chunks(spark, sf_dir):
    return chunking.line_chunks(texts(spark, sf_dir))


_BOOK = "SELECT conv_id AS doc_id, string_agg(concat('## ', role, chr(10), text), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"


def _book(spark, sf_dir) -> DataFrame:
    """Conversations as documents with a section for each turn."""
    part = F.concat(F.lit("## "), "role", F.lit("\n"), "text")
    turns = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", part.alias("part")))).alias("t"))
    return turns.select("doc_id", F.array_join(F.transform("t", lambda x: x["part"]), "\n").alias("text"))


@query(r"SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS section_idx, role AS title, regexp_replace(concat('## ', role, chr(10), text), '^\s+|\s+$', '', 'g') AS text FROM conversations")
def section_split(spark, sf_dir):
    return chunking.sections(_book(spark, sf_dir))


@query(r"""WITH sec AS (SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS section_idx, regexp_replace(concat('## ', role, chr(10), text), '^\s+|\s+$', '', 'g') AS text FROM conversations)
SELECT doc_id, section_idx, CAST(row_number() OVER (PARTITION BY doc_id, section_idx ORDER BY n) - 1 AS INTEGER) AS paragraph_idx, p AS text FROM (
  SELECT doc_id, section_idx, unnest(ps) AS p, generate_subscripts(ps, 1) AS n FROM (
    SELECT doc_id, section_idx, CASE WHEN len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) <= 30 THEN [text] ELSE list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') END AS ps FROM sec))""")
def section_subsplit(spark, sf_dir):
    return chunking.subsections(chunking.sections(_book(spark, sf_dir)), most=30).select("doc_id", "section_idx", "paragraph_idx", "text")


@query("""SELECT conv_id, turn, last_value(CASE WHEN role <> 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above,
first_value(CASE WHEN role <> 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS below FROM conversations""")
def header_neighbors(spark, sf_dir):
    return enrich.neighbours(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("text"), F.col("role") != "system").select("conv_id", "turn", "above", "below")


@query("""WITH sym AS (SELECT p_partkey, p_name, list_extract(string_split(p_name, ' '), -1) AS last FROM part), calls AS (SELECT DISTINCT p_partkey AS point_id, unnest(string_split(p_name, ' ')) AS name FROM part)
SELECT point_id, count(DISTINCT p_name) AS refs, min(p_name) AS first_ref FROM calls JOIN sym ON last = name GROUP BY point_id""")
def cross_refs(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    symbols = part.select(F.col("p_name").alias("qualname"), F.element_at(F.split("p_name", " "), -1).alias("last_segment")).distinct().withColumn("point_id", T.uuid5(F.col("qualname")))
    calls = part.select(F.col("p_partkey").alias("point_id"), F.explode(F.split("p_name", " ")).alias("name"))
    found = enrich.cross_references(calls, symbols)
    return found.select("point_id", F.size("cross_refs").cast("long").alias("refs"), F.col("cross_refs")[0].alias("first_ref"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN quality = 1 THEN 'good' ELSE '' END, concat('# source: ', source), text], lambda p: trim(p) <> ''), chr(10) || chr(10)) AS ctx FROM documents LEFT JOIN labels USING (doc_id)""")
def ctx_repr(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    summary = F.when(F.col("quality") == 1, "good").otherwise("")
    return docs.select("doc_id", represent.representation("ctx", F.col("text"), summary, F.concat(F.lit("# source: "), "source")).alias("ctx"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))


@query(f"""WITH h AS (SELECT doc_id, sha1(unhex('{T.NAMESPACE}') || encode(concat('code:', source, ':', lang, '.', doc_id, ':coarse:0'))) AS d FROM documents)
SELECT doc_id, concat(substr(d, 1, 8), '-', substr(d, 9, 4), '-5', substr(d, 14, 3), '-', substr('89ab', 1 + CAST('0x' || substr(d, 17, 1) AS INTEGER) % 4, 1), substr(d, 18, 3), '-', substr(d, 21, 12)) AS point_id FROM h""")
def uuid5_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.coarse_id(F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("point_id"))


@query("SELECT doc_id, CAST(CAST('0x' || substr(sha256(text), 1, 16) AS UBIGINT) % 9223372036854775808 AS BIGINT) AS id FROM documents")
def id63(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.id63(F.col("text")).alias("id"))


@query(r"""SELECT item_id, CASE WHEN s = '' THEN 'session' ELSE s END AS slug FROM (SELECT item_id, regexp_replace(substr(array_to_string(list_slice(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), lambda w: w <> ''), 1, 6), '-'), 1, 40), '-+$', '') AS s FROM benchmark)""")
def slugify(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", T.slugify(F.col("text")).alias("slug"))


@query(r"""SELECT doc_id, CASE WHEN length(p) > 250 THEN concat(substr(p, 1, 250), '…') ELSE p END AS preview FROM (SELECT doc_id, trim(replace(regexp_replace(trim(text), '\x5B([^\x5D]+)\x5D\x28[^\x29]+\x29', '\1', 'g'), chr(10), ' ')) AS p FROM documents)""")
def preview(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"))


_REF = "concat('src/', source, '.py', CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN concat(':', n_chars) ELSE concat(':', doc_id, '-', doc_id + n_chars) END)"


@query(f"""SELECT doc_id, split_part(r, ':', 1) AS file, coalesce(TRY_CAST(NULLIF(split_part(split_part(r, ':', 2), '-', 1), '') AS INTEGER), 0) AS start_line, coalesce(TRY_CAST(NULLIF(CASE WHEN contains(r, '-') THEN split_part(split_part(r, ':', 2), '-', 2) ELSE split_part(r, ':', 2) END, '') AS INTEGER), 0) AS end_line FROM (SELECT doc_id, {_REF} AS r FROM documents)""")
def parse_ref(spark, sf_dir):
    ref = table(spark, sf_dir, "documents").select("doc_id", T.parse_ref(F.expr(_REF)).alias("r"))
    return ref.select("doc_id", "r.file", F.coalesce("r.start", F.lit(0)).alias("start_line"), F.coalesce("r.end", F.lit(0)).alias("end_line"))


@query("SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://')) ELSE url END AS short FROM pages")
def shorten_path(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.shorten_path(F.col("url"), "://").alias("short"))


@query(r"SELECT conv_id, turn, CASE WHEN regexp_matches(t, '(?s)`{3}(?:python)?\n.*?`{3}') THEN regexp_extract(t, '(?s)`{3}(?:python)?\n(.*?)`{3}', 1) ELSE t END AS code FROM (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN concat('so:', chr(10), '```python', chr(10), text, chr(10), '``` done') ELSE text END AS t FROM conversations)")
def fenced_code(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    wrapped = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("so:\n```python\n"), "text", F.lit("\n``` done"))).otherwise(F.col("text"))
    return talk.select("conv_id", "turn", T.fenced_code(wrapped).alias("code"))


@query("SELECT a.vec_id, b.vec_id AS other, round(list_max(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda z: abs(z[1] - z[2]))), 6) AS diff FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def vector_diff(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", as_double(F.col("embedding")).alias("e"))
    other = v.select(F.col("vec_id").alias("other"), F.col("e").alias("f"))
    return v.join(other, F.col("other") == F.col("vec_id") + 1).select("vec_id", "other", F.round(max_abs_diff(F.col("e"), F.col("f")), 6).alias("diff"))


@query(f"WITH {DOC}, n AS (SELECT doc_id, sum(tf) AS n FROM doc GROUP BY doc_id) SELECT quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, CAST(max(n) AS BIGINT) AS longest, count(*) FILTER (n > 512) AS over_512, count(*) FILTER (n > 450) AS over_450 FROM n")
def token_percentiles(spark, sf_dir):
    n = scan.lengths(texts(spark, sf_dir))
    p = F.percentile("n", F.array(F.lit(0.5), F.lit(0.9)))
    return n.agg(p.alias("p"), F.max("n").alias("longest"), F.count_if(F.col("n") > 512).alias("over_512"), F.count_if(F.col("n") > 450).alias("over_450")).select(F.col("p")[0].alias("p50"), F.col("p")[1].alias("p90"), "longest", "over_512", "over_450")


# Store.
# The stored state stands for an earlier run: the labelled documents, those of poor quality with another text. The sources now have all but Spanish ones.


def _stored(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    text = F.when(F.col("quality") == 0, F.concat("text", F.lit(" old"))).otherwise(F.col("text"))
    return docs.select(F.col("doc_id").alias("point_id"), text.alias("text"), T.content_hash(text).alias("content_hash"))


def _current(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter("lang <> 'es'")
    return docs.select(F.col("doc_id").alias("point_id"), "text", T.content_hash(F.col("text")).alias("content_hash"))


_STATE = "(SELECT doc_id AS point_id, text, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))"


@query(f"SELECT point_id FROM {_STATE} WHERE lang <> 'es' AND coalesce(quality, 0) = 0")
def incremental_skip(spark, sf_dir):
    return store.changed(_current(spark, sf_dir), _stored(spark, sf_dir)).select("point_id")


@query(f"SELECT point_id FROM {_STATE} WHERE lang = 'es' AND quality IS NOT NULL")
def prune_stale(spark, sf_dir):
    return store.stale(_stored(spark, sf_dir), _current(spark, sf_dir))


@query(f"SELECT point_id, CASE WHEN lang = 'es' AND quality = 0 THEN concat(text, ' old') ELSE text END AS text FROM {_STATE} WHERE lang <> 'es' OR quality IS NOT NULL")
def upsert_merge(spark, sf_dir):
    return store.merged(_stored(spark, sf_dir), _current(spark, sf_dir), ("point_id",)).select("point_id", "text")


@query(f"SELECT point_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 0 THEN concat(text, ' old') ELSE text END AS text FROM {_STATE} WHERE quality IS NOT NULL")
def payload_update(spark, sf_dir):
    changes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("point_id"), F.when(F.col("toxic") == 1, "toxic").alias("text"))
    return store.updated(_stored(spark, sf_dir), changes, ("point_id",)).select("point_id", "text")


@query(f"""SELECT count(*) AS seen, count(*) FILTER (NOT c) AS skipped, count(*) FILTER (c) AS embedded, count(*) FILTER (c AND h) AS cache_hits, count(*) FILTER (c AND NOT h) AS cache_misses
FROM (SELECT coalesce(quality, 0) = 0 AS c, quality IS NOT NULL AS h FROM {_STATE} WHERE lang <> 'es')""")
def ingest_counts(spark, sf_dir):
    current = _current(spark, sf_dir)
    new = store.changed(current, _stored(spark, sf_dir)).select("point_id", F.lit(True).alias("changed"))
    cached = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("point_id"), F.lit(True).alias("cache_hit"))
    flagged = current.select("point_id").join(new, "point_id", "left").join(cached, "point_id", "left").na.fill(False)
    return store.run_counts(flagged)


@query("""SELECT *, (unlabelled = 0 AND orphan_lines = 0 AND orphan_orders = 0) AS passed FROM (SELECT (SELECT count(*) FROM documents d ANTI JOIN labels l USING (doc_id)) AS unlabelled,
(SELECT count(*) FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey) AS orphan_lines, (SELECT count(*) FROM orders ANTI JOIN customer ON o_custkey = c_custkey) AS orphan_orders)""")
def invariants(spark, sf_dir):
    t = lambda name: table(spark, sf_dir, name)
    return V.invariants({"unlabelled": V.dangling(t("documents"), "doc_id", t("labels"), "doc_id"), "orphan_lines": V.dangling(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey"), "orphan_orders": V.dangling(t("orders"), "o_custkey", t("customer"), "c_custkey")})


# Events.


@query("SELECT user_id, event_type, max_by(value, (ts, event_id)) AS value FROM events GROUP BY ALL")
def event_fold(spark, sf_dir):
    return E.fold(table(spark, sf_dir, "events"), "user_id", "event_type", "value", ("ts", "event_id"))


@query("""SELECT event_id, CAST(sum(s) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS session_id FROM (
SELECT event_id, ts, CASE WHEN lag(ts) OVER (ORDER BY ts, event_id) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id)) > 60000000 THEN 1 ELSE 0 END AS s FROM events)""")
def sessions_global(spark, sf_dir):
    return E.sessions(table(spark, sf_dir, "events"), 60, tie="event_id").select("event_id", "session_id")


_USER = """SELECT event_id, user_id, event_type, ts, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS session_id FROM (
SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 3600000000 THEN 1 ELSE 0 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query(f"SELECT event_id, session_id FROM ({_USER})")
def sessions_by_user(spark, sf_dir):
    return E.sessions(table(spark, sf_dir, "events"), 3600, "user_id", tie="event_id").select("event_id", "session_id")


_GLOBAL = """SELECT event_type, CAST(sum(s) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS session_id, CAST(user_id AS INTEGER) AS user_id FROM (
SELECT *, CASE WHEN lag(ts) OVER (ORDER BY ts, event_id) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id)) > 60000000 THEN 1 ELSE 0 END AS s FROM events)"""


@query(f"SELECT session_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n DESC, best, event_type) AS r FROM (SELECT session_id, event_type, count(*) AS n, min(user_id) AS best FROM ({_GLOBAL}) GROUP BY session_id, event_type)) WHERE r = 1")
def session_mode(spark, sf_dir):
    found = E.sessions(table(spark, sf_dir, "events"), 60, tie="event_id")
    return E.most_appearing(E.appearances(found, "event_type", "user_id"), "event_type").select("session_id", "event_type", "n")


# Evaluation.
# The targets: documents that have an item's whole text.

_TARGETS = "targets AS (SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
_RANKS = "(SELECT q.query_id, min(f.fused_rank) AS first_rank FROM (SELECT DISTINCT query_id FROM targets) q LEFT JOIN (SELECT x.* FROM {found} x JOIN targets USING (query_id, doc_id)) f USING (query_id) GROUP BY ALL)"


def _targets(spark, sf_dir) -> DataFrame:
    return scan.few(scan.containing(texts(spark, sf_dir), items(spark, sf_dir)))


def _sparse_found(spark, sf_dir, *legs: Callable) -> list[DataFrame]:
    """The 50 best by each leg; the items' terms are counted once."""
    index, asked = _index(spark, sf_dir), items(spark, sf_dir)
    return [leg(index, asked, 50).select("query_id", "doc_id", F.col("rank").alias("fused_rank"), F.col("score").alias("fused_score")) for leg in legs]


_TF, _BM = (f"(SELECT query_id, doc_id, rank AS fused_rank FROM ({TOPK.format(scores=s, k=50)}))" for s in ("tfidf", "okapi"))
_BOTH = f"WITH {DOC}, {ASK}, {_tfidf()}, {OKAPI}, {_TARGETS}, ta AS {_RANKS.format(found=_TF)}, tb AS {_RANKS.format(found=_BM)}"


@query(_BOTH + """, tier AS (SELECT query_id, CASE WHEN length(text) < 200 THEN 'short' ELSE 'long' END AS tier FROM benchmark JOIN (SELECT item_id, item_id AS query_id FROM benchmark) USING (item_id))
SELECT coalesce(tier, 'all') AS tier, count(*) AS queries, avg(CASE WHEN first_rank < 3 THEN 1.0 ELSE 0.0 END) AS recall_at_3, avg(CASE WHEN first_rank < 5 THEN 1.0 ELSE 0.0 END) AS recall_at_5, avg(CASE WHEN first_rank < 10 THEN 1.0 ELSE 0.0 END) AS recall_at_10 FROM ta JOIN tier USING (query_id) GROUP BY ROLLUP (tier)""")
def recall_by_tier(spark, sf_dir):
    tiers = items(spark, sf_dir).select("query_id", F.when(F.length("text") < 200, "short").otherwise("long").alias("tier"))
    ranks = V.target_ranks(*_sparse_found(spark, sf_dir, R.sparse_leg), _targets(spark, sf_dir)).join(tiers, "query_id")
    return V.recall(ranks, by="tier")


@query(_BOTH + " SELECT query_id, CASE WHEN coalesce(ta.first_rank < 1, false) THEN 'regressed' ELSE 'recovered' END AS change FROM ta JOIN tb USING (query_id) WHERE coalesce(ta.first_rank < 1, false) <> coalesce(tb.first_rank < 1, false)")
def version_compare(spark, sf_dir):
    targets = _targets(spark, sf_dir)
    a, b = (V.target_ranks(found, targets) for found in _sparse_found(spark, sf_dir, R.sparse_leg, R.okapi_leg))
    return V.compare(a, b, 1)


@query(f"""WITH {DOC}, {ASK}, {_tfidf()}, {OKAPI}, a AS (SELECT * FROM {_TF} WHERE fused_rank < 5), b AS (SELECT * FROM {_BM} WHERE fused_rank < 5)
SELECT query_id, CAST(min(CASE WHEN a.doc_id IS DISTINCT FROM b.doc_id THEN fused_rank END) AS INTEGER) AS first_difference, min(CASE WHEN a.doc_id IS DISTINCT FROM b.doc_id THEN fused_rank END) IS NULL AS equal FROM a FULL JOIN b USING (query_id, fused_rank) GROUP BY query_id""")
def rank_parity(spark, sf_dir):
    a, b = _sparse_found(spark, sf_dir, R.sparse_leg, R.okapi_leg)
    return V.parity(a, b, 5)


@query(_BOTH + f""", sym AS (SELECT item_id AS query_id, regexp_extract(text, '[A-Za-z]+') AS symbol FROM benchmark SEMI JOIN (SELECT query_id AS item_id FROM targets) USING (item_id)),
m AS (SELECT query_id, bool_or(contains(text, symbol)) AS mentioned FROM {_TF} JOIN documents USING (doc_id) JOIN sym USING (query_id) WHERE fused_rank < 10 GROUP BY query_id)
SELECT query_id, coalesce(CAST(first_rank AS INTEGER), -1) AS first_rank, coalesce(mentioned, false) AS mentioned FROM ta LEFT JOIN m USING (query_id)""")
def wide_rank(spark, sf_dir):
    symbol = items(spark, sf_dir).select("query_id", F.regexp_extract("text", "[A-Za-z]+", 0).alias("symbol"))
    return V.wide_ranks(*_sparse_found(spark, sf_dir, R.sparse_leg), _targets(spark, sf_dir).join(symbol, "query_id"), table(spark, sf_dir, "documents")).withColumn("first_rank", F.coalesce("first_rank", F.lit(-1)))


@query("""WITH w AS (SELECT o_orderkey AS id, o_custkey % 50 AS lo, o_custkey % 50 + o_orderkey % 7 AS hi FROM orders), c AS (SELECT l_orderkey AS id, l_linenumber - 1 AS fused_rank, l_partkey % 50 AS a, l_partkey % 50 + l_linenumber AS b FROM lineitem)
SELECT w.id, coalesce(min(fused_rank) FILTER (b >= lo AND a <= hi OR (a = 0 AND b = 0)) < 3, false) AS hit_at_3 FROM w LEFT JOIN c USING (id) GROUP BY w.id""")
def range_overlap(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    low = F.col("o_custkey") % 50
    ref = F.concat(F.lit("bar.py:"), low.cast("string"), F.lit("-"), (low + F.col("o_orderkey") % 7).cast("string"))
    questions = orders.select(F.col("o_orderkey").alias("id"), F.array(ref).alias("source_refs"))
    at = F.col("l_partkey") % 50
    found = lines.select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") - 1).alias("fused_rank"), F.lit("/src/foo/bar.py").alias("source_file"), at.alias("line_start"), (at + F.col("l_linenumber")).alias("line_end"))
    return V.mcq_hits(found, questions, (3,)).select("id", "hit_at_3")


@query("SELECT o_orderstatus AS difficulty, o_orderpriority AS category, count(*) AS questions, avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END) AS rate FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def mcq_summary(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return V.mcq_summary(orders.select(F.col("o_orderstatus").alias("difficulty"), F.col("o_orderpriority").alias("category"), (F.col("o_totalprice") > 150000).alias("hit_at_5")))


@query("""SELECT count(*) FILTER (f = 0 AND ok) AS passed, count(*) FILTER (f = 0) AS judged, count(*) FILTER (f = 0 AND ok) / CAST(count(*) FILTER (f = 0) AS DOUBLE) AS rate
FROM (SELECT CASE WHEN quality = 0 THEN 1 ELSE 0 END + CASE WHEN toxic = 1 THEN 1 ELSE 0 END AS f, n_chars > 1500 AS ok FROM labels JOIN documents USING (doc_id))""")
def pass_rate(spark, sf_dir):
    flags = F.filter(F.array(F.when(F.col("quality") == 0, "poor"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull())
    return V.pass_rate(table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(flags.alias("flags"), (F.col("n_chars") > 1500).alias("correct")))


@query("SELECT d.doc_id, min(p.doc_id) AS math_source_id FROM (SELECT doc_id, source AS t FROM documents WHERE lang <> 'en') d JOIN (SELECT doc_id, source AS t FROM documents WHERE lang = 'en') p USING (t) GROUP BY d.doc_id")
def paper_links(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("point_id"), F.array("source").alias("math_terms"), "lang", F.lit("coarse").alias("granularity"))
    return enrich.paper_links(docs.filter("lang <> 'en'"), docs.filter("lang = 'en'")).select(F.col("point_id").alias("doc_id"), "math_source_id")


@query("SELECT CAST(label AS VARCHAR) AS space, count(*) AS populated, count(*) / CAST((SELECT count(*) FROM embeddings) AS DOUBLE) AS rate FROM embeddings GROUP BY label")
def population_rate(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return V.population(v.withColumn("space", F.col("label").cast("string")), v.count())


# Python code: a small tree of sources from the rows of `part`.


def _files(spark, sf_dir) -> DataFrame:
    body = F.concat(F.lit('"""Parts named '), "p_name", F.lit('."""\nimport math\nfrom os import path as p\n\n@njit\ndef price_'), F.col("p_partkey").cast("string"), F.lit("(x):\n    # the price\n    y = math.floor(x)\n    z = y + 1\n    if z:\n        y = size_of(\n            z\n        )\n    return y\n\nclass Part"), F.col("p_partkey").cast("string"), F.lit(":\n    kind = 1\n\n    def size_of(self):\n        return p.join('a')  # joined\n"))
    return sparse.spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select(F.concat(F.lit("/home/src/shop/mod"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), body.alias("source"))


@query()
def code_chunks(spark, sf_dir):
    return chunking.code_chunks(_files(spark, sf_dir), "shop")


@query()
def fine_chunks(spark, sf_dir):
    return chunking.fine_chunks(chunking.code_chunks(_files(spark, sf_dir), "shop"))


@query()
def function_chunks(spark, sf_dir):
    return chunking.code_chunks(_files(spark, sf_dir), "shop", functions_only=True)


@query()
def context_headers(spark, sf_dir):
    sources = _files(spark, sf_dir)
    return enrich.context_headers(chunking.code_chunks(sources, "shop"), sources).select("source_file", "qualname", "context_header")


@query()
def representations(spark, sf_dir):
    chunks = chunking.code_chunks(_files(spark, sf_dir), "shop")
    return chunks.select("source_file", "qualname", *[represent.representation(k, F.col("text")).alias(k) for k in ("code", "codecom", "com")])


@query()
def symbol_refs(spark, sf_dir):
    """Numba flags and cross references by the names that each chunk calls."""
    chunks = chunking.code_chunks(_files(spark, sf_dir), "shop")
    symbols = enrich.symbol_table(chunks).filter(F.endswith("qualname", F.lit("size_of")))
    calls = enrich.code_facts(chunks).withColumn("point_id", T.coarse_id(F.col("source_file"), F.col("module"), F.col("qualname")))
    names = calls.select("source_file", "qualname", "has_numba", F.explode_outer("calls").alias("last_segment"))
    known = symbols.select("last_segment").distinct().withColumn("known", F.lit(True))
    return names.join(known, "last_segment", "left").groupBy("source_file", "qualname", "has_numba").agg(F.count_if("known").alias("known_calls"))



# Ingest, drivers and the rest of the surface.


def _tree(spark, sf_dir, changed: bool = False) -> DataFrame:
    """A source tree of four kinds of files by the part's key; in its changed state every fifth file has another function and every seventh is gone."""
    key = F.col("p_partkey").cast("string")
    place = lambda name: F.concat(F.lit("/home/src/shop/p"), key, F.lit("/"), F.lit(name))
    both = F.concat(F.lit('"""Parts named '), "p_name", F.lit('."""\n\ndef price_'), key, F.lit("(x):\n    return size_of(x)\n\nclass Part:\n    kind = 1\n\n    def size(self):\n        return 2\n"))
    two = F.concat(F.lit("class A"), key, F.lit(":\n    def a(self):\n        return 1\n\n    def b(self):\n        return 2\n"))
    kind = F.col("p_partkey") % 4
    path = F.when(kind == 3, place("__init__.py")).otherwise(place("mod.py"))
    source = F.when(kind == 0, both).when(kind == 1, two).when(kind == 2, F.lit("def broken(:\n")).otherwise(F.concat(F.lit("from .mod import x"), key, F.lit("\n")))
    tree = sparse.spread(table(spark, sf_dir, "part").select("p_partkey", "p_name")).select("p_partkey", path.alias("path"), source.alias("source"))
    if changed:
        tree = tree.filter("p_partkey % 7 <> 0").withColumn("source", F.when((F.col("p_partkey") % 5 == 0) & kind.isin(0, 1), F.concat("source", F.lit("\ndef added():\n    return 3\n"))).otherwise(F.col("source")))
    return tree.select("path", "source")


_KINDS = "(SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 0 ELSE 1 END AS coarse, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 0 END AS fine, CASE WHEN p_partkey % 5 = 0 AND p_partkey % 4 IN (0, 1) THEN 1 ELSE 0 END AS added FROM part)"


@query(f"""SELECT 1 AS run, CAST(sum(coarse) AS BIGINT) AS seen, CAST(0 AS BIGINT) AS skipped, CAST(sum(coarse) AS BIGINT) AS embedded, CAST(0 AS BIGINT) AS pruned, CAST(sum(coarse + fine) AS BIGINT) AS points, CAST(sum(coarse + fine) AS BIGINT) AS vectors FROM {_KINDS}
UNION ALL SELECT 2, CAST(sum(coarse + added) FILTER (k % 7 <> 0) AS BIGINT), CAST(sum(coarse) FILTER (k % 7 <> 0) AS BIGINT), CAST(sum(added) FILTER (k % 7 <> 0) AS BIGINT), CAST(coalesce(sum(coarse + fine) FILTER (k % 7 = 0), 0) AS BIGINT),
CAST(sum(coarse + fine + 2 * added) FILTER (k % 7 <> 0) AS BIGINT), CAST(sum(coarse + fine + 2 * added) FILTER (k % 7 <> 0) AS BIGINT) FROM {_KINDS}""")
def ingest_tree(spark, sf_dir):
    """Two runs over a tree into a new store: the second, after changes, works on what is new and prunes what is gone."""
    own = store.Store(spark, store.scratch(spark, "tree"))
    lexicon = spark.createDataFrame([("kind",)], "term string")
    out = []
    for run in (1, 2):
        r = ingest.ingest(own, _tree(spark, sf_dir, run == 2), "shop", lexicon).first()
        out.append((run, r["seen"], r["skipped"], r["embedded"], r["pruned"], own.read("points").count(), own.read("vectors").count()))
    return spark.createDataFrame(out, "run int, seen long, skipped long, embedded long, pruned long, points long, vectors long")


_CHUNK_ROWS = """
kind0 AS (SELECT * FROM part WHERE p_partkey % 4 = 0), kind1 AS (SELECT * FROM part WHERE p_partkey % 4 = 1),
chunk AS (
  SELECT p_partkey, 'mod.py' AS file, concat('shop.p', p_partkey, '.mod') AS qualname, 'module_docstring' AS chunk_type, 1 AS line_start, 1 AS line_end, concat(repeat('"', 3), 'Parts named ', p_name, '.', repeat('"', 3)) AS text FROM kind0
  UNION ALL SELECT p_partkey, 'mod.py', concat('price_', p_partkey), 'function', 3, 4, concat('def price_', p_partkey, '(x):', chr(10), '    return size_of(x)') FROM kind0
  UNION ALL SELECT p_partkey, 'mod.py', 'Part', 'class_header', 6, 10, concat('class Part:', chr(10), '    kind = 1') FROM kind0
  UNION ALL SELECT p_partkey, 'mod.py', 'Part.size', 'method', 9, 10, concat('    def size(self):', chr(10), '        return 2') FROM kind0
  UNION ALL SELECT p_partkey, 'mod.py', concat('A', p_partkey), 'class_header', 1, 6, concat('class A', p_partkey, ':') FROM kind1
  UNION ALL SELECT p_partkey, 'mod.py', concat('A', p_partkey, '.a'), 'method', 2, 3, concat('    def a(self):', chr(10), '        return 1') FROM kind1
  UNION ALL SELECT p_partkey, 'mod.py', concat('A', p_partkey, '.b'), 'method', 5, 6, concat('    def b(self):', chr(10), '        return 2') FROM kind1
  UNION ALL SELECT p_partkey, '__init__.py', concat('shop.p', p_partkey, '.__init__'), 'module_exports', 1, 1, concat('from .mod import x', p_partkey) FROM part WHERE p_partkey % 4 = 3)"""


@query(f"WITH {_CHUNK_ROWS} SELECT concat('/home/src/shop/p', p_partkey, '/', file) AS source_file, qualname, chunk_type, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, trim(text, chr(10)) AS text FROM chunk")
def tree_chunks(spark, sf_dir):
    return chunking.code_chunks(_tree(spark, sf_dir), "shop").select("source_file", "qualname", "chunk_type", "line_start", "line_end", F.regexp_replace("text", "^\n+|\n+$", "").alias("text"))


@query(f"WITH {_CHUNK_ROWS} SELECT concat('/home/src/shop/p', p_partkey, '/', file) AS source_file, qualname, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end FROM chunk WHERE chunk_type IN ('function', 'method')")
def tree_functions(spark, sf_dir):
    return chunking.code_chunks(_tree(spark, sf_dir), "shop", functions_only=True).select("source_file", "qualname", "line_start", "line_end")


@query(f"WITH {_CHUNK_ROWS} SELECT concat('/home/src/shop/p', p_partkey, '/', file) AS source_file, qualname, CAST(0 AS INTEGER) AS window_idx, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end FROM chunk WHERE chunk_type IN ('function', 'method')")
def tree_windows(spark, sf_dir):
    return chunking.fine_chunks(chunking.code_chunks(_tree(spark, sf_dir), "shop")).select("source_file", "qualname", "window_idx", "line_start", "line_end")


@query(f"""WITH {_CHUNK_ROWS}, f AS (SELECT *, concat('/home/src/shop/p', p_partkey, '/', file) AS source_file, trim(regexp_extract(text, '(?m)^\\s*(def\\b.*)$', 1)) AS sig FROM chunk)
SELECT source_file, qualname, array_to_string(list_filter([CASE WHEN chunk_type = 'method' THEN concat('# class: ', split_part(qualname, '.', 1)) WHEN chunk_type = 'module_exports' THEN concat('# ', text) END,
  concat('# above: ', last_value(CASE WHEN chunk_type IN ('function', 'method') THEN sig END IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY line_start RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  concat('# below: ', first_value(CASE WHEN chunk_type IN ('function', 'method') THEN sig END IGNORE NULLS) OVER (PARTITION BY source_file ORDER BY line_start RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))], lambda x: x IS NOT NULL AND x NOT IN ('# above: ', '# below: ')), chr(10)) AS context_header FROM f""")
def tree_headers(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    return enrich.context_headers(chunking.code_chunks(tree, "shop"), tree).select("source_file", "qualname", "context_header")


@query(f"WITH {_CHUNK_ROWS} SELECT concat('shop.p', p_partkey, '.mod.', qualname) AS qualname, split_part(qualname, '.', -1) AS last_segment FROM chunk WHERE chunk_type IN ('function', 'method', 'class_header')")
def tree_symbols(spark, sf_dir):
    return enrich.symbol_table(chunking.code_chunks(_tree(spark, sf_dir), "shop")).select("qualname", "last_segment")


@query(f"WITH {_CHUNK_ROWS} SELECT concat('/home/src/shop/p', p_partkey, '/', file) AS source_file, qualname, CASE WHEN chunk_type = 'function' THEN ['size_of'] ELSE [] END AS calls, false AS has_numba FROM chunk")
def tree_calls(spark, sf_dir):
    return enrich.code_facts(chunking.code_chunks(_tree(spark, sf_dir), "shop")).select("source_file", "qualname", "calls", "has_numba")


@query(f"WITH {_CHUNK_ROWS} SELECT concat('/home/src/shop/p', p_partkey, '/', file) AS source_file, qualname, CASE WHEN chunk_type = 'module_docstring' THEN trim(text) ELSE trim(text) END AS code, CASE WHEN chunk_type = 'module_docstring' THEN concat('Parts named ', p_name, '.') END AS com FROM chunk JOIN part USING (p_partkey)")
def tree_representations(spark, sf_dir):
    """A chunk that is all docstring keeps its text as code."""
    chunks = chunking.code_chunks(_tree(spark, sf_dir), "shop")
    return chunks.select("source_file", "qualname", F.trim(F.regexp_replace(represent.representation("code", F.col("text")), r"^\s+|\s+$", "")).alias("code"), represent.representation("com", F.col("text")).alias("com"))


@query("""SELECT o_orderkey AS id, o_orderstatus AS difficulty, CASE WHEN o_orderkey % 3 = 0 THEN 'none' WHEN o_orderkey % 3 = 1 THEN 'full' ELSE 'partial' END AS indexed FROM orders""")
def indexability(spark, sf_dir):
    refs = F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("b.py:3"))).when(F.col("o_orderkey") % 3 == 1, F.array(F.lit("a.py:1-2"), F.lit("README.md"))).otherwise(F.array(F.lit("a.py"), F.lit("b.py")))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("difficulty"), V.indexability(refs, ["a.py"]).alias("indexed"))


@query(f"""WITH {DOC}, {ASK}, {_tfidf()}, {OKAPI}, a AS (SELECT * FROM {_TF} WHERE fused_rank < 10), b AS (SELECT * FROM {_BM} WHERE fused_rank < 10)
SELECT k, count(*) AS queries, count(*) FILTER (lowest IS NULL OR lowest >= k) AS equal FROM (SELECT query_id, min(CASE WHEN a.doc_id IS DISTINCT FROM b.doc_id THEN fused_rank END) AS lowest FROM a FULL JOIN b USING (query_id, fused_rank) GROUP BY query_id) CROSS JOIN (VALUES (3), (5), (10)) v(k) GROUP BY k""")
def rank_parities(spark, sf_dir):
    a, b = _sparse_found(spark, sf_dir, R.sparse_leg, R.okapi_leg)
    return V.parities(a, b)


@query(f"""WITH {DOC}, {ASK}, {_tfidf()}, {OKAPI}, a AS (SELECT * FROM {_TF} WHERE fused_rank < 10), b AS (SELECT * FROM {_BM} WHERE fused_rank < 10)
SELECT query_id, CAST(fused_rank AS INTEGER) AS fused_rank, a.doc_id AS left_id, b.doc_id AS right_id, a.doc_id IS NOT DISTINCT FROM b.doc_id AS same FROM a FULL JOIN b USING (query_id, fused_rank)""")
def rank_diff(spark, sf_dir):
    a, b = _sparse_found(spark, sf_dir, R.sparse_leg, R.okapi_leg)
    return V.rank_rows(a, b, 10)


@query(f"""WITH {DOC}, {ASK}, {_tfidf()}, {OKAPI}, a AS (SELECT * FROM {_TF} WHERE fused_rank < 10), b AS (SELECT * FROM {_BM} WHERE fused_rank < 10), x AS (SELECT DISTINCT doc_id FROM a), y AS (SELECT DISTINCT doc_id FROM b)
SELECT count(*) FILTER (x.doc_id IS NOT NULL AND y.doc_id IS NOT NULL) AS both, count(*) FILTER (y.doc_id IS NULL) AS left_only, count(*) FILTER (x.doc_id IS NULL) AS right_only, count(*) FILTER (y.doc_id IS NULL OR x.doc_id IS NULL) = 0 AS equal FROM x FULL JOIN y USING (doc_id)""")
def found_sets(spark, sf_dir):
    a, b = (found.filter("fused_rank < 10") for found in _sparse_found(spark, sf_dir, R.sparse_leg, R.okapi_leg))
    return V.set_comparison(a, b, "doc_id")


@query("SELECT count(text) - count(DISTINCT text) AS n FROM documents")
def collisions(spark, sf_dir):
    return V.collisions(table(spark, sf_dir, "documents"), "text")


@query("SELECT o_orderpriority AS difficulty, count(*) FILTER (o_totalprice > 100000) AS passed, count(*) AS total FROM orders GROUP BY o_orderpriority")
def validation_counts(spark, sf_dir):
    return V.validation_counts(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("difficulty"), (F.col("o_totalprice") > 100000).alias("passed")))


@query("SELECT flag, count(*) AS n FROM (SELECT unnest(CASE WHEN quality = 0 AND toxic = 1 THEN ['poor', 'toxic'] WHEN quality = 0 THEN ['poor'] WHEN toxic = 1 THEN ['toxic'] ELSE [] END) AS flag FROM labels) GROUP BY flag")
def flag_counts(spark, sf_dir):
    flags = F.filter(F.array(F.when(F.col("quality") == 0, "poor"), F.when(F.col("toxic") == 1, "toxic")), lambda x: x.isNotNull())
    return V.flag_counts(table(spark, sf_dir, "labels").select(flags.alias("flags")))


@query(f"""WITH {DOC}, {ASK}, {_tfidf()}, ranked AS ({TOPK.format(scores='tfidf', k=K)}) SELECT query_id, doc_id, rank AS fused_rank, round(1.0 / (61 + rank), 6) AS fused_score FROM ranked""")
def single_leg(spark, sf_dir):
    return R.single_leg(R.sparse_leg(_index(spark, sf_dir), items(spark, sf_dir), K), "sparse", K).select(*LONG)


def _pooled_sql(pool: int, k: int) -> str:
    part = lambda name, scores: f"{name} AS (SELECT query_id, doc_id, CAST(1 AS DOUBLE) / (59 + r) AS part FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM {scores}) WHERE r <= {pool})"
    return f"WITH {HYBRID}, {OKAPI}, {part('b1', 'near_all')}, {part('b2', 'okapi')}, {_fused(['b1', 'b2'], k)} SELECT * FROM fused"


@query(_pooled_sql(10, 10))
def pooled_hybrid(spark, sf_dir):
    return R.pooled_hybrid(_index(spark, sf_dir), items(spark, sf_dir), K).select(*LONG)


@query(_pooled_sql(50, 50))
def wide_hybrid(spark, sf_dir):
    return R.pooled_hybrid(_index(spark, sf_dir), items(spark, sf_dir), 50, pool=50).select(*LONG)


@query(f"WITH {HYBRID}, {_fused(['l1', 'l2'])} SELECT query_id, list(doc_id ORDER BY fused_rank) AS top FROM fused WHERE fused_rank < 5 GROUP BY query_id")
def top_five(spark, sf_dir):
    return V.top_each(R.hybrid(_index(spark, sf_dir), items(spark, sf_dir), K))


@query(f"WITH {HYBRID}, {_fused(['l1', 'l2'])} SELECT * FROM fused")
def stored_hybrid(spark, sf_dir):
    """The same from a store: points, postings and vectors are written once and read back."""
    index = R.build_index(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    own = store.Store(spark, store.scratch(spark, "index"))
    for name, df in (("points", index.points), ("postings", index.postings), ("vectors", index.vectors)):
        own.load(name, df.withColumnRenamed("doc_id", "point_id"))
    return R.hybrid(R.open_index(own), items(spark, sf_dir), K).select(*LONG)


@query(f"""WITH {HYBRID}, {_fused(['l1', 'l2'], 3)}, e AS (SELECT f.query_id, min(d2.doc_id) AS x FROM fused f JOIN documents d ON d.doc_id = f.doc_id JOIN documents d2 ON d2.doc_id = f.doc_id + 1 GROUP BY f.query_id, f.doc_id),
added AS (SELECT DISTINCT query_id, x AS doc_id FROM e WHERE NOT EXISTS (SELECT 1 FROM fused f WHERE f.query_id = e.query_id AND f.doc_id = e.x)), n AS (SELECT query_id, max(fused_rank) + 1 AS n FROM fused GROUP BY query_id)
SELECT query_id, doc_id, fused_rank, fused_score, false AS expansion FROM fused UNION ALL SELECT query_id, doc_id, CAST(n + row_number() OVER (PARTITION BY query_id ORDER BY doc_id) - 1 AS INTEGER), 0.0, true FROM added JOIN n USING (query_id)""")
def expanded_candidates(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    edges = docs.select(F.col("doc_id").alias("src"), (F.col("doc_id") + 1).alias("dst"))
    return R.expand_candidates(R.hybrid(_index(spark, sf_dir), items(spark, sf_dir), 3).select(*LONG), edges, docs, 1)


@query("SELECT event_id FROM events WHERE event_id % 7 <> 3")
def existing_ids(spark, sf_dir):
    """Ids asked for in any number, some unknown and some null, against those that are there."""
    events = table(spark, sf_dir, "events")
    asked = events.select((F.when(F.col("event_id") % 7 != 3, F.col("event_id"))).alias("event_id")).unionByName(events.select((-F.col("event_id") - 1).alias("event_id"))).unionByName(events.filter("event_id % 7 <> 3").select("event_id"))
    return store.existing(events, asked, "event_id")


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE lang = 'en' AND n_chars > 100")
def existing_hashes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    points = docs.select(F.col("doc_id").alias("point_id"), F.when(F.col("lang") == "en", "coarse").otherwise("fine").alias("granularity"), F.when(F.col("n_chars") > 100, T.content_hash(F.col("text"))).alias("content_hash"))
    return store.existing_hashes(points).withColumnRenamed("point_id", "doc_id")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def last_write_wins(spark, sf_dir):
    own = store.Store(spark, store.scratch(spark, "last"))
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    own.upsert("state", rows, ("user_id",), order=("ts", "event_id"))
    return own.read("state").select("user_id", "event_type", "value")


@query("SELECT doc_id, CASE WHEN quality IS NULL THEN '' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS summary FROM documents LEFT JOIN labels USING (doc_id)")
def keyed_summaries(spark, sf_dir):
    """A left join on function and class; null classes match."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("function_name"), F.lit(None).cast("string").alias("class_name"))
    summaries = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("function_name"), F.lit("").alias("class_name"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("summary"))
    return files.with_summaries(docs, summaries).select("doc_id", "summary")


@query("SELECT p_partkey, round(p_retailprice, 4) AS ctx FROM part")
def rounded_scores(spark, sf_dir):
    scores = table(spark, sf_dir, "part").select("p_partkey", T.rounded_scores(F.create_map(F.lit("ctx"), F.col("p_retailprice").cast("double") + 0.00001)).alias("m"))
    return scores.select("p_partkey", F.round(F.element_at("m", "ctx"), 2).alias("ctx"))


@query(r"""SELECT conv_id, turn, CASE WHEN turn % 4 = 0 THEN 'A' WHEN turn % 4 = 1 THEN 'D' WHEN turn % 4 = 2 THEN 'X' ELSE 'X' END AS letter FROM conversations""")
def answer_letters(spark, sf_dir):
    answer = F.when(F.col("turn") % 4 == 0, '{"answer": "a"}').when(F.col("turn") % 4 == 1, '```json\n{"answer": " D "}\n```').when(F.col("turn") % 4 == 2, '{"answer": "E"}').otherwise("no")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.answer_letter(answer).alias("letter"))


@query("SELECT p_partkey, concat(p_name, chr(10), 'A. ', p_type, chr(10), 'B. ', p_brand) AS question FROM part")
def question_texts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.question_text(F.col("p_name"), F.array("p_type", "p_brand")).alias("question"))


@query("SELECT c_custkey, c_mktsegment = 'BUILDING' AND c_nationkey % 2 = 0 AS strict, c_mktsegment = 'BUILDING' AS loose FROM customer")
def symbol_matches(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("cls"), F.when(F.col("c_nationkey") % 2 == 0, "run").otherwise("walk").alias("f"))
    return own.select("c_custkey", T.symbol_matches(F.lit("BUILDING.run"), F.col("cls"), F.col("f")).alias("strict"), T.symbol_matches(F.concat(F.lit("BUILDING."), "f"), F.col("cls"), F.col("f"), strict=False).alias("loose"))


@query("SELECT o_orderstatus, concat(count(*) FILTER (o_totalprice > 100000), '/', count(*), ' (', CAST(round(100.0 * count(*) FILTER (o_totalprice > 100000) / count(*)) AS INTEGER), '%)') AS shown FROM orders GROUP BY o_orderstatus")
def fractions(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(T.fraction(F.count_if(F.col("o_totalprice") > 100000), F.count(F.lit(1))).alias("shown"))


@query("SELECT event_id, strftime(ts - INTERVAL 5 HOUR, '%m-%d_%H%M') AS stamp FROM events")
def local_stamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.local_stamp(F.col("ts"), "-05:00").alias("stamp"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat('p', p_partkey, '.py:', p_brand) ELSE concat('p', p_partkey, '.py') END AS label, CASE WHEN p_partkey % 3 = 0 THEN p_brand WHEN p_partkey % 3 = 1 THEN p_name ELSE '?' END AS shown FROM part")
def source_labels(spark, sf_dir):
    part, third = table(spark, sf_dir, "part"), F.col("p_partkey") % 3
    function = F.when(third == 0, F.col("p_brand")).otherwise(F.lit(""))
    path = F.concat(F.lit("/src/p"), F.col("p_partkey").cast("string"), F.lit(".py"))
    return part.select("p_partkey", T.source_label(path, function, "/src/").alias("label"), T.display_name(function, F.when(third == 1, F.col("p_name")).otherwise(F.lit(""))).alias("shown"))


_SESSION = f"WITH g AS (SELECT event_id, ts, CAST(sum(s) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS session_id FROM (SELECT event_id, ts, CASE WHEN lag(ts) OVER (ORDER BY ts, event_id) IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER (ORDER BY ts, event_id)) > 60000000 THEN 1 ELSE 0 END AS s FROM events))"


@query(_SESSION + " SELECT session_id, arg_min(event_id, (ts, event_id)) AS session_key, concat('q-', arg_min(event_id, (ts, event_id)), '_', strftime(min(ts), '%m-%d_%H%M')) AS label, arg_min(event_id, (ts, event_id)) % 2 = 1 AS is_new FROM g GROUP BY session_id HAVING arg_min(event_id, (ts, event_id)) % 2 = 1 UNION ALL SELECT session_id, arg_min(event_id, (ts, event_id)), 'kept', false FROM g GROUP BY session_id HAVING arg_min(event_id, (ts, event_id)) % 2 = 0")
def session_labels(spark, sf_dir):
    """Labels of sessions; those whose first event has an even id are in the registry already."""
    events = table(spark, sf_dir, "events").select(F.col("event_id").alias("query_id"), F.concat(F.lit("Q "), F.col("event_id").cast("string")).alias("query_text"), "ts")
    firsts = E.first_events(E.sessions(events, 60, tie="query_id"))
    registry = table(spark, sf_dir, "events").filter("event_id % 2 = 0").select(F.col("event_id").alias("session_key"), F.lit("kept").alias("label"))
    return E.labels(firsts, registry).join(firsts.select("session_id", "session_key"), "session_key").select("session_id", "session_key", "label", "is_new")


@query("SELECT count(*) FILTER (doc_id % 10 = 0) AS missing, count(*) FILTER (doc_id % 10 = 1) AS changed_text, count(*) FILTER (doc_id % 10 = 2) AS off FROM documents")
def vector_parity(spark, sf_dir):
    docs, tenth = table(spark, sf_dir, "documents"), F.col("doc_id") % 10
    old = docs.select(F.col("doc_id").alias("point_id"), "text", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    new = docs.filter(tenth != 0).select(F.col("doc_id").alias("point_id"), F.when(tenth == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), F.array(F.lit(1.0), F.when(tenth == 2, 0.001).otherwise(0.0)).alias("embedding"))
    return V.vector_parity(old, new)


@query(f"WITH {DOC}, n AS (SELECT doc_id, count(*) AS n FROM doc GROUP BY doc_id) SELECT doc_id, n FROM n")
def with_tokens(spark, sf_dir):
    """Rows without tokens are left out."""
    docs = texts(spark, sf_dir)
    return embed.point_postings(docs.withColumnRenamed("doc_id", "point_id")).groupBy(F.col("point_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, space FROM documents JOIN (VALUES ('ctx__hashed'), ('code__hashed')) s(space) ON space = 'ctx__hashed' OR lang = 'en' WHERE regexp_matches(text, '[A-Za-z0-9_]')")
def multi_space(spark, sf_dir):
    """Which spaces a point has vectors in: fine points only in those meant for them."""
    docs = table(spark, sf_dir, "documents")
    points = docs.select(F.col("doc_id").alias("point_id"), F.concat(F.lit("!("), "text").alias("text"), F.when(F.col("lang") == "en", "coarse").otherwise("fine").alias("granularity"))
    return embed.embed_spaces(points, ["ctx__hashed", "code__hashed"], embed.Registry(embed.HASHED)).select(F.col("point_id").alias("doc_id"), "space")


@query("SELECT lang AS retriever, count(*) AS queries, avg(CASE WHEN n_chars % 20 < 3 THEN 1.0 ELSE 0.0 END) AS recall_at_3, avg(CASE WHEN n_chars % 20 < 5 THEN 1.0 ELSE 0.0 END) AS recall_at_5, avg(CASE WHEN n_chars % 20 < 10 THEN 1.0 ELSE 0.0 END) AS recall_at_10 FROM (SELECT 'en' AS lang, n_chars FROM documents UNION ALL SELECT 'other', n_chars + 7 FROM documents) GROUP BY lang")
def retriever_table(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "doc_id", "n_chars")
    found = lambda shift: docs.select("query_id", "doc_id", ((F.col("n_chars") + shift) % 20).cast("int").alias("fused_rank"))
    return drivers.compare_retrievers({"en": found(0), "other": found(7)}, docs.select("query_id", "doc_id"))
