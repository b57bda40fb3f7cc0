"""Queries over what ranked search adds and cuts, over lookups, reports and streams, with their SQL."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainery.functions import models as M
from grainery.operators import augment as A
from grainery.operators import graph as G
from grainery.operators import search as S
from grainery.streaming import events as E
from grainery.streaming import state as R

from .search_queries import BM25, COS, TOK, bm25_hits, knn_hits, read

# ---- hits are nearest vectors, a label is a file, a file imports the next two ----


def _chunks(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.concat(F.lit("f"), "label").alias("file"), F.col("embedding").alias("v"))


def _edges(spark, d):
    label = read(spark, d, "embeddings").select("label").distinct()
    return label.select(F.concat(F.lit("f"), "label").alias("src"), F.explode(F.array(F.col("label") + 1, F.col("label") + 2)).alias("n")).select("src", F.concat(F.lit("f"), "n").alias("dst"))


def _hits(spark, d, k):
    return knn_hits(spark, d, k).join(_chunks(spark, d).select("key", "file"), "key")


FILES = f"""{COS}, ch AS (SELECT vec_id AS key, 'f' || label AS file, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ed AS (SELECT DISTINCT 'f' || label AS src, 'f' || (label + k) AS dst FROM embeddings, (SELECT unnest([1, 2]) AS k)),
hits AS (SELECT qid, cr.key, score, rank, file FROM cr JOIN ch USING (key))"""
SIM = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), ch.v)"


def graph_augment(spark, d):
    """The first five hits, what imports reach within two steps, and vectors near the hits."""
    G.ensure_checkpoint_dir(spark)
    hits, chunks = _hits(spark, d, 5).checkpoint(), _chunks(spark, d)
    seeds = hits.select("key").distinct()
    vectors = read(spark, d, "embeddings")
    near = S.knn(vectors, vectors.join(seeds, vectors["vec_id"] == seeds["key"], "left_semi"), 20, "vec_id", "embedding").select(F.col("qid").alias("seed"), "key", (1 - F.col("score")).alias("dist"))
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qv"))
    out = A.along_imports(hits, _edges(spark, d), chunks, asked, 2, A.near_seeds(hits, near, 0.9))
    return out.select("qid", "key", "file", F.round("score", 6).alias("score"), "why")


def unified_topk(spark, d):
    return A.unified(_hits(spark, d, 8), _edges(spark, d), _chunks(spark, d), 30).select("qid", "key", F.round("score", 6).alias("score"), "why", F.col("rank").cast("long").alias("rank"))


def knn_neighbors_seed(spark, d):
    hits = knn_hits(spark, d, 20)
    near = hits.select(F.col("qid").alias("seed"), "key", (1 - F.col("score")).alias("dist"))
    seeds = hits.where("rank = 1").select((F.col("qid") % 200).alias("qid"), F.col("qid").alias("key"), F.lit(1).alias("rank"))
    return A.near_seeds(seeds, near, 0.95, 15).select("qid", "key", F.round("dist", 6).alias("dist"))


def sparse_promote(spark, d):
    hits = knn_hits(spark, d, 10)
    return A.promoted(hits, knn_hits(spark, d, 15, "l2").where("key % 2 = 0"), 0.2).select("qid", "key", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"), "why")


def union_first_seen(spark, d):
    return A.first_seen([knn_hits(spark, d, 5), knn_hits(spark, d, 9)]).select("qid", "key", F.round("score", 6).alias("score"), "leg")


def first_files(spark, d):
    return A.first_files(_hits(spark, d, 30), 3).select("qid", "file", F.col("place").cast("long").alias("place"))


def overlap_rerank(spark, d):
    """Keyword hits by the share of the query's terms that they have."""
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    texts = read(spark, d, "documents").select(F.col("doc_id").alias("key"), "text")
    hits = bm25_hits(spark, d, 20).join(asked, "qid").join(texts, "key")
    return hits.select("qid", "key", F.round(M.overlap_score(F.col("query"), F.col("text")), 6).alias("overlap"), M.order_score(F.col("query"), F.col("text")).alias("none"))


def sparse_weights(spark, d):
    return M.sparse_weights(read(spark, d, "documents"), "doc_id", "text").withColumn("weight", F.round("weight", 6))


def hash_embeddings(spark, d):
    """Unit vectors of all texts by the default embedder."""
    return read(spark, d, "documents").select("doc_id", M.HashEmbedder(64).column(F.col("text")).alias("v"))


# ---- lookups and scopes ----


def point_lookup(spark, d):
    return read(spark, d, "orders").where("o_custkey = 7").select("o_orderkey", "o_orderstatus")


def in_lookup(spark, d):
    asked = read(spark, d, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return read(spark, d, "orders").select("o_orderkey", "o_custkey").join(asked, "o_custkey", "left_semi")


def _paths(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))


PATHS = "paths AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages)"


def scope_filter(spark, d):
    """Pages below the folder of the first page."""
    paths = _paths(spark, d)
    scope = paths.orderBy("page_id").limit(1).select(F.substring_index("path", "/", 1).alias("scope"))
    return paths.join(F.broadcast(scope)).where((F.col("path") == F.col("scope")) | F.startswith("path", F.concat("scope", F.lit("/")))).select("page_id", "path")


def branch_scope(spark, d):
    """Pages whose path ends with what the tenth of all pages have after their host."""
    paths = _paths(spark, d)
    changed = paths.where("page_id % 10 = 3").select(F.regexp_replace("path", "^[^/]*/", "").alias("path"))
    return A.in_branch(paths, changed, "path")


def common_folder(spark, d):
    return A.common_folder(read(spark, d, "nation").select(F.concat(F.lit("src/world/"), "n_regionkey", F.lit("/"), "n_name").alias("path")))


def freshness_state(spark, d):
    n = F.col("n_nationkey")
    return read(spark, d, "nation").select("n_nationkey", A.freshness(n % 3, F.when(n % 5 == 0, F.lit("unreadable")), n % 7 == 0).alias("state"))


def embed_text(spark, d):
    docs = read(spark, d, "documents")
    describe = F.when(F.col("doc_id") % 4 == 0, F.lit("a description"))
    scope = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("")
    return docs.select("doc_id", F.length(M.embed_text(F.col("source"), F.lit("text"), F.col("text"), describe)).cast("long").alias("plain"), F.length(M.embed_text(F.col("source"), F.lit("text"), F.col("text"), describe, scope)).cast("long").alias("scoped"))


def score_heads(spark, d):
    a, b = F.col("c_acctbal") / 1000, F.col("c_nationkey") / 5
    return read(spark, d, "customer").select("c_custkey", F.round(M.sigmoid_head(a), 6).alias("sigmoid"), F.round(M.softmax_head(b, a), 6).alias("softmax"))


def service_results(spark, d):
    body = F.to_json(F.struct(F.array(F.struct(F.lit(0).alias("index"), F.round(F.col("c_acctbal") / 10000, 4).alias("relevance_score")), F.struct(F.lit(1).alias("index"), F.when(F.col("c_custkey") % 2 == 0, 0.5).alias("relevance_score"))).alias("results")))
    return M.service_results(read(spark, d, "customer").select("c_custkey", body.alias("body")), "c_custkey", "body", "jina")


# ---- reports ----


def upper_median(spark, d):
    """The element [n / 2] of the sorted positive balances of a nation's customers, by place instead of a gathered list."""
    rows = read(spark, d, "customer").where("c_acctbal > 0")
    by = Window.partitionBy("c_nationkey")
    placed = rows.withColumn("place", F.row_number().over(by.orderBy("c_acctbal", "c_custkey"))).withColumn("n", F.count("*").over(by))
    return placed.where("place = floor(n / 2) + 1").select("c_nationkey", F.round("c_acctbal", 2).alias("median"))


def best_per_group(spark, d):
    runs = read(spark, d, "supplier")
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey"))
    return runs.withColumn("place", place).where("place = 1").select("s_nationkey", "s_suppkey", "s_acctbal")


def limit_per_group(spark, d):
    """The first three documents of every language in the order of input."""
    place = F.row_number().over(Window.partitionBy("lang").orderBy("doc_id"))
    return read(spark, d, "documents").select("doc_id", "lang", place.alias("place")).where("place <= 3").select("doc_id", "lang")


def numbered_names(spark, d):
    """Names made unique: the second of equal ones gets _1, the third _2."""
    n = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey")) - 1
    return read(spark, d, "part").select("p_partkey", F.when(n > 0, F.concat("p_name", F.lit("_"), n.cast("string"))).otherwise(F.col("p_name")).alias("name"))


def max_per_doc(spark, d):
    hits = _hits(spark, d, 30)
    return hits.groupBy("qid", "file").agg(F.round(F.max("score"), 6).alias("score"))


def distinct_counts(spark, d):
    return read(spark, d, "events").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types"), F.count("*").alias("n"))


def truncated_lists(spark, d):
    """A customer's orders, the first five, with how many there are and whether some are missing."""
    orders = read(spark, d, "orders").select("o_custkey", "o_orderkey")
    n = orders.groupBy("o_custkey").agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    first = orders.withColumn("place", place).where("place <= 5").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_list("o_orderkey")).cast("array<string>"), ",").alias("orders"))
    return n.join(first, "o_custkey").select("o_custkey", "n", "orders", (F.col("n") > 5).alias("truncated"))


def judge_share(spark, d):
    """Answers that hold all (1), some (0.5) or none of what is expected, averaged by label."""
    hits = knn_hits(spark, d, 10).join(_chunks(spark, d).select("key", "file"), "key")
    own = read(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), F.concat(F.lit("f"), "label").alias("own"))
    n = hits.join(own, "qid").groupBy("qid", "own").agg(F.count_if(F.col("file") == F.col("own")).alias("good"))
    return n.groupBy("own").agg(F.round(F.avg(F.when(F.col("good") >= 5, 1.0).when(F.col("good") > 0, 0.5).otherwise(0.0)), 6).alias("share"), F.count_if(F.expr("good = 0")).alias("missed"))


def audit_counters(spark, d):
    """Hits outside the expected file in the first five: how many, and how many a label confirms."""
    marked = read(spark, d, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    hits = bm25_hits(spark, d, 5).select("qid", F.col("key").alias("doc_id"))
    return hits.join(marked, "doc_id", "left").groupBy("qid").agg(F.count("*").alias("n"), F.count_if(F.expr("quality = 1")).alias("relevant"), F.count_if(F.expr("quality = 0")).alias("irrelevant"), F.count_if(F.expr("quality IS NULL")).alias("open"))


def debounce_2s(spark, d):
    """Bursts of events with no pause of two seconds."""
    events = read(spark, d, "events").select(F.lit("all").alias("root"), F.col("ts").cast("timestamp").alias("ts"))
    bursts = events.groupBy(F.session_window("ts", "2 seconds").alias("w"), "root").agg(F.count("*").alias("n"))
    return bursts.select(F.unix_micros("w.start").alias("start"), "n")


# ---- streams ----


def _stream(spark: SparkSession, out: DataFrame, mode: str = "append") -> DataFrame:
    """The rows that a stream gives once it has read all there is. Its state is where the cluster's checkpoints are; a folder of its own only where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="grainery-stream-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    where = f"{base}/stream-{uuid.uuid4().hex}"
    query = out.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{where}/out")


def _live(spark: SparkSession, d: str) -> DataFrame:
    return E.read_events(spark, f"{d}/events.parquet*", spark.read.parquet(f"{d}/events.parquet").schema)


def stream_ingest(spark, d):
    """All events through a stream."""
    return _stream(spark, _live(spark, d).select("event_id", "user_id", F.unix_micros("ts").alias("at")))


def single_flight(spark, d):
    """Each user is a project; views are changes, purchases ends of refreshes."""
    kind = F.when(F.col("event_type") == "purchase", "finished").otherwise("change")
    return _stream(spark, R.single_flight(_live(spark, d).select(F.col("user_id").alias("project"), F.col("event_id").alias("seq"), kind.alias("kind"))))


def lease_stream(spark, d):
    return _stream(spark, R.lease_stream(_live(spark, d).select(F.col("user_id").alias("client"), "ts")))


QUERIES = {f.__name__: f for f in (graph_augment, unified_topk, knn_neighbors_seed, sparse_promote, union_first_seen, first_files, overlap_rerank, sparse_weights, hash_embeddings, point_lookup, in_lookup, scope_filter, branch_scope, common_folder, freshness_state, embed_text, score_heads, service_results, upper_median, best_per_group, limit_per_group, numbered_names, max_per_doc, distinct_counts, truncated_lists, judge_share, audit_counters, debounce_2s, stream_ingest, single_flight, lease_stream)}

L2 = "la AS (SELECT a.vec_id AS qid, b.vec_id AS key, -list_sum(list_transform(list_zip(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), lambda p: (p[1] - p[2]) ** 2)) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), lr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, key) AS rank FROM la)"

SQL = {
    "graph_augment": f"""WITH {FILES}, h AS (SELECT * FROM hits WHERE rank <= 5), bt AS (SELECT qid, max(score) AS best FROM h GROUP BY 1),
r1 AS (SELECT DISTINCT qid, file AS seed, dst AS t, 1 AS depth FROM h JOIN ed ON src = file), r2 AS (SELECT DISTINCT qid, seed, dst AS t, 2 AS depth FROM r1 JOIN ed ON src = t),
dp AS (SELECT qid, t AS file, min(depth) AS depth FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2) WHERE t <> seed GROUP BY ALL),
g AS (SELECT dp.qid, ch.key, ch.file, best * {SIM} * power(0.3, depth) AS score, 'graph' AS why FROM dp JOIN ch USING (file) JOIN bt ON bt.qid = dp.qid JOIN embeddings q ON q.vec_id = dp.qid WHERE {SIM} >= 0.25 AND NOT EXISTS (SELECT 1 FROM h WHERE h.qid = dp.qid AND h.key = ch.key)),
nb AS (SELECT s.vec_id AS seed, c.vec_id AS key, list_cosine_similarity(CAST(s.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score FROM embeddings s JOIN embeddings c ON s.vec_id <> c.vec_id WHERE s.vec_id IN (SELECT key FROM h)),
nr AS (SELECT seed, key, 1 - score AS dist FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(score, 9) DESC, key) AS rn FROM nb) WHERE rn <= 20 AND 1 - score <= 0.9),
ns AS (SELECT h.qid, nr.key, min(dist) AS dist FROM h JOIN nr ON nr.seed = h.key GROUP BY ALL), nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), key) AS rn FROM ns) WHERE rn <= 50),
x AS (SELECT nn.qid, ch.key, ch.file, best * 0.4 * greatest(0, 1 - dist) AS score, 'proximity' AS why FROM nn JOIN ch USING (key) JOIN bt ON bt.qid = nn.qid JOIN embeddings q ON q.vec_id = nn.qid WHERE {SIM} >= 0.25 AND NOT EXISTS (SELECT 1 FROM h WHERE h.qid = nn.qid AND h.key = ch.key) AND NOT EXISTS (SELECT 1 FROM dp WHERE dp.qid = nn.qid AND dp.file = ch.file)),
a AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, key) AS rn FROM (SELECT * FROM g UNION ALL SELECT * FROM x))
SELECT qid, key, file, round(score, 6) AS score, why FROM a WHERE rn <= 30 UNION ALL SELECT qid, key, file, round(score, 6), 'primary' FROM h""",
    "unified_topk": f"""WITH {FILES}, h AS (SELECT * FROM hits WHERE rank <= 8), bt AS (SELECT qid, max(score) AS best FROM h GROUP BY 1),
im AS (SELECT DISTINCT h.qid, src AS file FROM h JOIN ed ON dst = h.file WHERE NOT EXISTS (SELECT 1 FROM h x WHERE x.qid = h.qid AND x.file = src)),
al AS (SELECT qid, key, score, 'hybrid' AS why, 0 AS part FROM h UNION ALL SELECT im.qid, ch.key, best * 0.5, 'graph', 1 FROM im JOIN ch USING (file) JOIN bt ON bt.qid = im.qid),
rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY part, round(score, 9) DESC, key) AS rank FROM al) SELECT qid, key, round(score, 6) AS score, why, rank FROM rk WHERE rank <= 30""",
    "knn_neighbors_seed": f"WITH {COS}, n AS (SELECT qid % 200 AS qid, key, min(1 - score) AS dist FROM cr WHERE rank <= 20 AND 1 - score <= 0.95 GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(dist, 9), key) AS rn FROM n) SELECT qid, key, round(dist, 6) AS dist FROM r WHERE rn <= 15",
    "sparse_promote": f"""WITH {COS}, {L2}, h AS (SELECT qid, key, rank FROM cr WHERE rank <= 10), o AS (SELECT qid, key, rank FROM lr WHERE rank <= 15 AND key % 2 = 0),
n AS (SELECT qid, key, 10 + row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM o WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.qid = o.qid AND h.key = o.key)),
b AS (SELECT *, 'primary' AS why FROM h UNION ALL SELECT *, 'sparse' FROM n), s AS (SELECT b.qid, b.key, why, 0.8::DOUBLE / (60 + b.rank) + 0.2::DOUBLE / (60 + coalesce(o.rank, 1000)) AS score FROM b LEFT JOIN o ON o.qid = b.qid AND o.key = b.key)
SELECT qid, key, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, key) AS rank, why FROM s""",
    "union_first_seen": f"WITH {COS} SELECT qid, key, round(score, 6) AS score, CASE WHEN rank <= 5 THEN 0 ELSE 1 END AS leg FROM cr WHERE rank <= 9",
    "first_files": f"WITH {FILES}, f AS (SELECT qid, file, min(rank) AS r0 FROM hits WHERE rank <= 30 GROUP BY ALL), p AS (SELECT qid, file, row_number() OVER (PARTITION BY qid ORDER BY r0) AS place FROM f) SELECT * FROM p WHERE place <= 3",
    "overlap_rerank": f"WITH {BM25}, h AS (SELECT qid, key, rank FROM bmr WHERE rank <= 20), g AS (SELECT DISTINCT doc_id, term FROM tok), c AS (SELECT qid, count(*) AS n FROM asked GROUP BY 1), o AS (SELECT h.qid, key, count(*) AS k FROM h JOIN asked USING (qid) JOIN g ON g.doc_id = key AND g.term = asked.term GROUP BY ALL) SELECT h.qid, h.key, round(coalesce(k, 0) / CAST(n AS DOUBLE), 6) AS overlap, CAST(count(*) OVER (PARTITION BY h.qid) - rank + 1 AS DOUBLE) AS none FROM h JOIN c USING (qid) LEFT JOIN o ON o.qid = h.qid AND o.key = h.key",
    "sparse_weights": f"WITH {TOK} SELECT doc_id AS key, term AS token, round(ln(1 + count(*)), 6) AS weight FROM tok GROUP BY ALL",
    "point_lookup": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7",
    "in_lookup": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)",
    "scope_filter": f"WITH {PATHS}, s AS (SELECT string_split(path, '/')[1] AS scope FROM paths ORDER BY page_id LIMIT 1) SELECT page_id, path FROM paths, s WHERE path = scope OR starts_with(path, scope || '/')",
    "branch_scope": f"WITH {PATHS}, c AS (SELECT DISTINCT regexp_replace(path, '^[^/]*/', '') AS c FROM paths WHERE page_id % 10 = 3) SELECT page_id, path FROM paths WHERE EXISTS (SELECT 1 FROM c WHERE c.c <> '' AND (ends_with(path, c.c) OR ends_with(c.c, path)))",
    "common_folder": "SELECT 'src/world' AS folder",
    "freshness_state": "SELECT n_nationkey, CASE WHEN n_nationkey % 7 = 0 THEN 'refreshing' WHEN n_nationkey % 5 = 0 THEN 'unknown' WHEN n_nationkey % 3 > 0 THEN 'stale' ELSE 'fresh' END AS state FROM nation",
    "embed_text": "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 13 ELSE length(source || ' text' || chr(10) || text) END AS plain, CASE WHEN doc_id % 4 = 0 THEN 13 ELSE length('File: ' || source || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'Scope: ' || lang || chr(10) ELSE '' END || 'Type: text' || chr(10) || chr(10) || text) END AS scoped FROM documents",
    "score_heads": "SELECT c_custkey, round(1 / (1 + exp(-(c_acctbal / 1000))), 6) AS sigmoid, round(1 / (1 + exp(c_nationkey / 5.0::DOUBLE - c_acctbal / 1000)), 6) AS softmax FROM customer",
    "service_results": "SELECT c_custkey AS key, 0::BIGINT AS index, round(c_acctbal / 10000, 4) AS score FROM customer UNION ALL SELECT c_custkey, 1, 0.5 FROM customer WHERE c_custkey % 2 = 0",
    "upper_median": "WITH p AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS place, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer WHERE c_acctbal > 0) SELECT c_nationkey, round(c_acctbal, 2) AS median FROM p WHERE place = n // 2 + 1",
    "best_per_group": "SELECT s_nationkey, s_suppkey, s_acctbal FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) = 1",
    "limit_per_group": "SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 3",
    "numbered_names": "WITH n AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS n FROM part) SELECT p_partkey, CASE WHEN n > 0 THEN p_name || '_' || n ELSE p_name END AS name FROM n",
    "max_per_doc": f"WITH {FILES} SELECT qid, file, round(max(score), 6) AS score FROM hits WHERE rank <= 30 GROUP BY ALL",
    "distinct_counts": "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types, count(*) AS n FROM events",
    "truncated_lists": "WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders) SELECT o_custkey, count(*) AS n, string_agg(o_orderkey, ',' ORDER BY o_orderkey) FILTER (p <= 5) AS orders, count(*) > 5 AS truncated FROM o GROUP BY 1",
    "judge_share": f"WITH {FILES}, n AS (SELECT qid, 'f' || label AS own, count(*) FILTER (file = 'f' || label) AS good FROM hits JOIN embeddings ON vec_id = qid WHERE rank <= 10 GROUP BY ALL) SELECT own, round(avg(CASE WHEN good >= 5 THEN 1.0::DOUBLE WHEN good > 0 THEN 0.5::DOUBLE ELSE 0 END), 6) AS share, count(*) FILTER (good = 0) AS missed FROM n GROUP BY 1",
    "audit_counters": f"WITH {BM25}, m AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY 1) SELECT qid, count(*) AS n, count(*) FILTER (q = 1) AS relevant, count(*) FILTER (q = 0) AS irrelevant, count(*) FILTER (q IS NULL) AS open FROM bmr LEFT JOIN m ON m.doc_id = key WHERE rank <= 5 GROUP BY 1",
    "debounce_2s": "WITH a AS (SELECT ts, CASE WHEN ts - lag(ts) OVER (ORDER BY ts) <= INTERVAL 2 SECOND THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT ts, sum(new) OVER (ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM a) SELECT epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY k",
    "stream_ingest": "SELECT event_id, user_id, epoch_us(ts) AS at FROM events",
}
