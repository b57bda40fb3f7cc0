"""Queries over tokens, ranks and text functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainery.functions import text as T
from grainery.operators import search as S

TOK = "tok AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '([A-Z]?[a-z]+|[A-Z]+|[0-9]+)', 1))) AS term FROM documents)"
ASKED = "asked AS (SELECT DISTINCT item_id AS qid, lower(unnest(regexp_extract_all(text, '([A-Z]?[a-z]+|[A-Z]+|[0-9]+)', 1))) AS term FROM benchmark)"
BM25 = f"""{TOK}, {ASKED},
dl AS (SELECT doc_id, len(regexp_extract_all(text, '([A-Z]?[a-z]+|[A-Z]+|[0-9]+)', 1)) AS dl FROM documents),
tf AS (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
bms AS (SELECT qid, doc_id AS key, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM asked JOIN df USING (term) JOIN tf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, key) AS rank FROM bms)"""
COS = """cs AS (SELECT a.vec_id AS qid, b.vec_id AS key, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
cr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, key) AS rank FROM cs)"""


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


def bm25_hits(spark: SparkSession, d: str, k: int = 30) -> DataFrame:
    return S.bm25(read(spark, d, "documents"), _asked(spark, d), k, "doc_id", "text")


def knn_hits(spark: SparkSession, d: str, k: int = 30, metric: str = "cosine") -> DataFrame:
    rows = read(spark, d, "embeddings")
    return S.knn(rows, rows.where("vec_id % 100 = 0"), k, "vec_id", "embedding", metric)


def _out(df: DataFrame, *more: str) -> DataFrame:
    return df.select("qid", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), *more)


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return _out(S.rrf({"fts": bm25_hits(spark, d), "vector": knn_hits(spark, d)}, 10), "why")


def tokenize_code(spark, d):
    tokens = T.code_tokens(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.array_join(tokens, " ").alias("tokens"), F.size(tokens).cast("long").alias("n_tokens"))


def term_df(spark, d):
    return S.postings(read(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def rrf_weighted_refuse(spark, d):
    return _out(S.refuse(knn_hits(spark, d, 20), knn_hits(spark, d, 30, "l2sq"), 0.2))


def _weights(rows: DataFrame, key: str, text: str) -> DataFrame:
    return S.postings(rows, key, text).select("key", F.col("term").alias("token"), F.col("tf").cast("double").alias("weight"))


def sparse_dot_topk(spark, d):
    asked = _weights(read(spark, d, "benchmark"), "item_id", "text").withColumnRenamed("key", "qid")
    return _out(S.sparse_dot(_weights(read(spark, d, "documents"), "doc_id", "text"), asked, 10))


def _names(spark, d):
    parts = read(spark, d, "part")
    return parts.select(F.concat_ws("_", F.replace(F.initcap("p_name"), F.lit(" "), F.lit("")), "p_type").alias("name")).unionByName(spark.createDataFrame([("parseHTTPResponse_json",), ("MyStruct",), ("foo_bar_baz",)], "name string")).distinct()


NAMES_SQL = """names AS (SELECT DISTINCT name FROM (
  SELECT concat_ws('_', replace(array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: upper(w[1]) || w[2:]), ' '), ' ', ''), p_type) AS name FROM part
  UNION ALL SELECT * FROM (VALUES ('parseHTTPResponse_json'), ('MyStruct'), ('foo_bar_baz'))))"""
PARTS_SQL = r"list_filter(string_split_regex(regexp_replace(regexp_replace(name, '([A-Z]+)([A-Z][a-z])', '\1 \2', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '[^\pL\pN]+'), lambda s: s <> '')"


def normalize_identifier(spark, d):
    return _names(spark, d).select("name", T.normalize_identifier(F.col("name")).alias("normalized"))


def camel_split(spark, d):
    return _names(spark, d).select("name", F.array_join(T.camel_split(F.col("name")), " ").alias("parts"))


def _said(spark, d):
    return read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))


SAID_SQL = "said AS (SELECT conv_id, turn, text AS query FROM conversations WHERE role = 'user')"
WORDS_SQL = r"list_filter(string_split_regex(query, '\s+'), lambda w: w <> '')"


def sanitize_query(spark, d):
    return _said(spark, d).select("conv_id", "turn", T.sanitize_query(F.col("query")).alias("clean"))


def expand_query(spark, d):
    return _said(spark, d).select("conv_id", "turn", T.expand_query(F.col("query")).alias("expanded"))


def route_query(spark, d):
    return _said(spark, d).select("conv_id", "turn", T.route_query(F.col("query")).alias("strategy"))


ROUTES = ["ConnectionPool retry", "hello world", "EmbedProvider", "src/auth.rs", "how does src/auth.rs work", "snake_case", "ABC", "a|b", "", "plain"]
PATHS = ["src/lib.rs", "tests/it.rs", "pkg/foo_test.go", "README.md", "docs/intro.md", "a/docs/content/x.adoc", "web/index.ts", "LICENSE", "Makefile", "x/History", "lib/Foo.spec.ts", "b/notes.txt", ".env", "bin/tool", "K.KTS", "a/test.py"]
ASKS = ["how do tests work", "docs for setup", "entry point of the module", "parse json"]


def route_literals(spark, d):
    return spark.createDataFrame([(q,) for q in ROUTES], "query string").select("query", T.route_query(F.col("query")).alias("strategy"))


def _paths(spark, d):
    pages = read(spark, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"))
    return pages.unionByName(spark.createDataFrame([(p,) for p in PATHS], "path string")).distinct()


PATHS_SQL = "paths AS (SELECT DISTINCT path FROM (SELECT regexp_replace(url, '^https?://', '') AS path FROM pages UNION ALL SELECT unnest([" + ", ".join(f"'{p}'" for p in PATHS) + "])))"


def _list(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


P, NAME = "lower(path)", "regexp_extract(lower(path), '[^/]*$')"
TEST_SQL = f"(regexp_matches({P}, '(^|/)({'|'.join(t for t in T.TEST_DIRS)})') OR {NAME} IN {_list(T.TEST_NAMES)} OR regexp_matches(regexp_replace({NAME}, '\\.[^.]*$', ''), '(\\.test|\\.spec|_test|_spec)$'))"
META_SQL = f"({NAME} IN {_list(T.META_NAMES)})"
DOC_SQL = f"(regexp_matches({P}, '\\.({'|'.join(T.DOC_EXTENSIONS)})$') OR {NAME} IN {_list(T.DOC_NAMES)})"
DOCDIR_SQL = f"(regexp_matches({P}, '^(docs|doc|documentation)/|/docs/content/|/docs-v|/documentation/'))"
BARREL_SQL = f"({NAME} IN {_list(T.BARREL_NAMES)})"


def _asks_sql(phrases) -> str:
    return "(" + " OR ".join(f"contains(lower(query), '{p}')" for p in phrases) + ")"


def path_flags(spark, d):
    p = F.col("path")
    return _paths(spark, d).select("path", T.is_test_path(p).alias("is_test"), T.is_meta_path(p).alias("is_meta"), T.is_doc_path(p).alias("is_doc"), T.is_docs_dir(p).alias("in_docs"), T.is_barrel_path(p).alias("is_barrel"))


def path_multiplier(spark, d):
    asked = F.explode(F.array(*[F.lit(a) for a in ASKS])).alias("query")
    return _paths(spark, d).select("path", asked).select("path", "query", T.path_multiplier(F.col("path"), F.col("query")).alias("factor"))


def query_intent_flags(spark, d):
    q = F.col("text")
    return read(spark, d, "conversations").select("conv_id", "turn", T.asks(q, T.ENTRY_PHRASES).alias("entry"), T.asks(q, T.TEST_PHRASES).alias("testing"), T.asks(q, T.DOC_PHRASES).alias("docs"))


def language_from_ext(spark, d):
    return _paths(spark, d).select("path", T.language(F.col("path")).alias("language"))


def ext_allowlist(spark, d):
    return _paths(spark, d).select("path", T.is_indexed_path(F.col("path")).alias("indexed"))


EXT_SQL = r"regexp_extract(regexp_extract(path, '[^/]*$'), '[^.]\.([^.]+)$', 1)"
LANG_SQL = "CASE " + " ".join(f"WHEN ext = '{e}' THEN '{n}'" for e, n in T.LANGUAGES.items()) + " WHEN ext = '' THEN 'unknown' ELSE ext END"


def quality_labels(spark, d):
    return S.quality_labels(bm25_hits(spark, d)).select("qid", "key", "match_quality")


def token_budget(spark, d):
    hits = bm25_hits(spark, d).join(read(spark, d, "documents").select(F.col("doc_id").alias("key"), "text"), "key")
    return S.token_budget(hits, "text", 2048).select("qid", "key", F.col("used").cast("long").alias("used"))


def rerank_blend(spark, d):
    return _out(S.rerank_blend(knn_hits(spark, d), F.pmod(F.col("key") * 7919, F.lit(101)) / 101.0))


def strong_signal(spark, d):
    fused = S.rrf({"fts": bm25_hits(spark, d), "vector": knn_hits(spark, d)}, 10)
    return S.strong_signal(fused)


def graph_cap(spark, d):
    hits = knn_hits(spark, d, 80).withColumn("origin", F.when(F.col("key") % 2 == 0, "graph").otherwise("vector"))
    return S.cap_by_origin(hits, "origin", "graph").select("qid", "key", "origin")


def mmr_rerank(spark, d):
    rows = read(spark, d, "embeddings")
    hits = knn_hits(spark, d).join(rows.select(F.col("vec_id").alias("key"), F.col("embedding").alias("v")), "key")
    return S.mmr(hits.select("qid", "key", "rank", "v"), rows.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv")))


QUERIES = {f.__name__: f for f in (hybrid_topk, tokenize_code, term_df, rrf_weighted_refuse, sparse_dot_topk, normalize_identifier, camel_split, sanitize_query, expand_query, route_query, route_literals, path_flags, path_multiplier, query_intent_flags, language_from_ext, ext_allowlist, quality_labels, token_budget, rerank_blend, strong_signal, graph_cap, mmr_rerank)}
QUERIES["bm25_topk"] = lambda spark, d: _out(bm25_hits(spark, d, 10))
QUERIES["knn_topk"] = lambda spark, d: _out(knn_hits(spark, d, 10))
QUERIES["knn_l2"] = lambda spark, d: _out(knn_hits(spark, d, 10, "l2sq"))

FUSED = f"""{BM25}, {COS},
legs AS (SELECT qid, key, rank, 'fts' AS leg FROM bmr WHERE rank <= 30 UNION ALL SELECT qid, key, rank, 'vector' FROM cr WHERE rank <= 30),
fs AS (SELECT qid, key, sum(1::DOUBLE / (60 + rank)) AS score, CASE WHEN count(*) > 1 THEN 'hybrid' ELSE min(leg) END AS why FROM legs GROUP BY ALL),
fr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, key) AS rank FROM fs)"""
L2 = """ls AS (SELECT a.vec_id AS qid, b.vec_id AS key, -list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS score
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
lr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, key) AS rank FROM ls)"""
MIXED = r"(regexp_matches(w, '\p{Lu}') AND regexp_matches(w, '\p{Ll}'))"
MIXED_ONE = MIXED.replace("(w,", "(ws[1],")
ROUTE = rf"""CASE WHEN q = '' THEN 'semantic' WHEN regexp_matches(q, '[\\\[^$+|]') THEN 'grep'
  WHEN len(ws) >= 3 AND contains(q, '/') AND contains(q, '.') THEN 'semantic'
  WHEN contains(q, '/') OR regexp_matches(q, '\.(rs|py|ts|js|go|java)$') THEN 'grep'
  WHEN len(ws) = 1 AND (contains(ws[1], '_') OR {MIXED_ONE} OR (strlen(ws[1]) > 2 AND regexp_matches(ws[1], '^\p{{Lu}}+$'))) THEN 'grep'
  WHEN len(ws) = 2 AND len(list_filter(ws, lambda w: contains(w, '_') OR {MIXED})) > 0 THEN 'semantic'
  WHEN len(ws) >= 3 THEN 'semantic' ELSE 'grep' END AS strategy"""
STOP = _list(T.STOP_WORDS)
SPLIT_W = PARTS_SQL.replace("name", "w")

SQL = {
    "hybrid_topk": f"WITH {FUSED} SELECT qid, key, round(score, 6) AS score, rank, why FROM fr WHERE rank <= 10",
    "tokenize_code": "SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '([A-Z]?[a-z]+|[A-Z]+|[0-9]+)', 1), lambda x: lower(x)), ' ') AS tokens, len(regexp_extract_all(text, '([A-Z]?[a-z]+|[A-Z]+|[0-9]+)', 1)) AS n_tokens FROM documents",
    "term_df": f"WITH {TOK} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM tok GROUP BY 1",
    "bm25_topk": f"WITH {BM25} SELECT qid, key, round(score, 6) AS score, rank FROM bmr WHERE rank <= 10",
    "knn_topk": f"WITH {COS} SELECT qid, key, round(score, 6) AS score, rank FROM cr WHERE rank <= 10",
    "knn_l2": f"WITH {L2} SELECT qid, key, round(score, 6) AS score, rank FROM lr WHERE rank <= 10",
    "rrf_weighted_refuse": f"WITH {COS}, {L2}, j AS (SELECT cr.qid, cr.key, 0.8::DOUBLE / (60 + cr.rank) + 0.2::DOUBLE / (60 + coalesce(lr.rank, 1000)) AS score FROM cr LEFT JOIN (SELECT * FROM lr WHERE rank <= 30) lr USING (qid, key) WHERE cr.rank <= 20) SELECT qid, key, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, key) AS rank FROM j",
    "sparse_dot_topk": f"WITH {TOK}, a AS (SELECT item_id AS qid, term, count(*) AS q FROM (SELECT item_id, lower(unnest(regexp_extract_all(text, '([A-Z]?[a-z]+|[A-Z]+|[0-9]+)', 1))) AS term FROM benchmark) GROUP BY ALL), t AS (SELECT doc_id AS key, term, count(*) AS w FROM tok GROUP BY ALL), s AS (SELECT qid, key, CAST(sum(q * w) AS DOUBLE) AS score FROM a JOIN t USING (term) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM s) SELECT * FROM r WHERE rank <= 10",
    "normalize_identifier": f"WITH {NAMES_SQL}, p AS (SELECT name, list_transform({PARTS_SQL}, lambda x: lower(x)) AS ps FROM names) SELECT name, array_to_string(ps || list_transform(range(1, len(ps)), lambda i: ps[i] || ps[i + 1]), ' ') AS normalized FROM p",
    "camel_split": f"WITH {NAMES_SQL}, p AS (SELECT name, {PARTS_SQL} AS ps FROM names) SELECT name, CASE WHEN len(ps) > 1 THEN array_to_string([name] || list_filter(ps, lambda x: length(x) > 1), ' ') ELSE name END AS parts FROM p",
    "sanitize_query": rf"WITH {SAID_SQL} SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(regexp_replace(query, '[^\pL\pN\s]', ' ', 'g'), '\s+'), lambda w: strlen(w) > 1 AND lower(w) NOT IN ('and', 'or', 'not', 'near')), ' ') AS clean FROM said",
    "expand_query": f"WITH {SAID_SQL}, u AS (SELECT *, {WORDS_SQL} AS ws FROM said), k AS (SELECT *, list_filter(ws, lambda w: length(w) > 2 AND lower(w) NOT IN {STOP}) AS us FROM u), s AS (SELECT *, flatten(list_transform(us, lambda w: CASE WHEN len({SPLIT_W}) > 1 THEN [w] || list_filter({SPLIT_W}, lambda x: length(x) > 1) ELSE [w] END)) AS al FROM k), ds AS (SELECT *, list_filter(al, lambda x, i: list_position(al, x) = i) AS ps FROM s) SELECT conv_id, turn, CASE WHEN len(ps) = 0 OR len(ps) = len(ws) THEN query ELSE query || ' ' || array_to_string(ps, ' ') END AS expanded FROM ds",
    "route_query": f"WITH {SAID_SQL}, t AS (SELECT conv_id, turn, trim(query) AS q, {WORDS_SQL} AS ws FROM said) SELECT conv_id, turn, {ROUTE} FROM t",
    "route_literals": f"WITH s AS (SELECT unnest([{', '.join(repr(q) for q in ROUTES)}]) AS query), t AS (SELECT query, trim(query) AS q, {WORDS_SQL} AS ws FROM s) SELECT query, {ROUTE} FROM t",
    "path_flags": f"WITH {PATHS_SQL} SELECT path, {TEST_SQL} AS is_test, {META_SQL} AS is_meta, {DOC_SQL} AS is_doc, {DOCDIR_SQL} AS in_docs, {BARREL_SQL} AS is_barrel FROM paths",
    "path_multiplier": f"WITH {PATHS_SQL}, q AS (SELECT unnest([{', '.join(repr(a) for a in ASKS)}]) AS query) SELECT path, query, CAST(CASE WHEN {TEST_SQL} THEN CASE WHEN {_asks_sql(T.TEST_PHRASES)} THEN 0.85 ELSE 0.15 END WHEN {META_SQL} THEN CASE WHEN {_asks_sql(T.DOC_PHRASES)} THEN 0.7 ELSE 0.1 END WHEN {DOC_SQL} THEN CASE WHEN {_asks_sql(T.DOC_PHRASES)} THEN 0.7 WHEN {DOCDIR_SQL} THEN 0.05 ELSE 0.15 END WHEN {BARREL_SQL} THEN CASE WHEN {_asks_sql(T.ENTRY_PHRASES)} THEN 1.0 ELSE 0.4 END ELSE 1.0 END AS DOUBLE) AS factor FROM paths, q",
    "query_intent_flags": f"SELECT conv_id, turn, {_asks_sql(T.ENTRY_PHRASES)} AS entry, {_asks_sql(T.TEST_PHRASES)} AS testing, {_asks_sql(T.DOC_PHRASES)} AS docs FROM (SELECT *, text AS query FROM conversations)",
    "language_from_ext": f"WITH {PATHS_SQL}, e AS (SELECT path, {EXT_SQL} AS ext FROM paths) SELECT path, {LANG_SQL} AS language FROM e",
    "ext_allowlist": f"WITH {PATHS_SQL}, e AS (SELECT path, lower({EXT_SQL}) AS ext FROM paths) SELECT path, CASE WHEN ext = '' THEN regexp_extract(path, '[^/]*$') IN {_list(T.BARE_NAMES)} ELSE ext IN {_list(T.EXTENSIONS)} END AS indexed FROM e",
    "quality_labels": f"WITH {BM25}, m AS (SELECT *, score / max(score) OVER (PARTITION BY qid) AS share FROM bmr WHERE rank <= 30) SELECT qid, key, CASE WHEN share >= 0.8 THEN 'high' WHEN share >= 0.5 THEN 'moderate' ELSE 'low' END AS match_quality FROM m",
    "token_budget": f"WITH {BM25}, u AS (SELECT qid, key, rank, CAST(sum(strlen(text) // 4) OVER (PARTITION BY qid ORDER BY rank) AS BIGINT) AS used FROM bmr JOIN documents ON key = doc_id WHERE rank <= 30) SELECT qid, key, used FROM u WHERE rank = 1 OR used <= 2048",
    "rerank_blend": f"WITH {COS}, a AS (SELECT qid, key, score, CAST((key * 7919) % 101 AS DOUBLE) / 101 AS rr FROM cr WHERE rank <= 30), b AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(rr, 9) DESC, key) AS place FROM a), c AS (SELECT qid, key, rr, score, CAST(CASE WHEN place <= 3 THEN 0.25 WHEN place <= 10 THEN 0.4 ELSE 0.6 END AS DOUBLE) AS w FROM b), e AS (SELECT qid, key, w * score + (1 - w) * rr AS score FROM c) SELECT qid, key, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, key) AS rank FROM e",
    "strong_signal": f"WITH {FUSED}, w AS (SELECT *, lead(score) OVER (PARTITION BY qid ORDER BY rank) AS second FROM fr WHERE rank <= 10) SELECT qid, score >= 0.016 AND (second IS NULL OR score - second >= 0.003) AS strong FROM w WHERE rank = 1",
    "graph_cap": f"WITH {COS}, a AS (SELECT *, CASE WHEN key % 2 = 0 THEN 'graph' ELSE 'vector' END AS origin FROM cr WHERE rank <= 80), b AS (SELECT *, row_number() OVER (PARTITION BY qid, origin ORDER BY round(score, 9) DESC, key) AS place FROM a) SELECT qid, key, origin FROM b WHERE origin <> 'graph' OR place <= 30",
}
