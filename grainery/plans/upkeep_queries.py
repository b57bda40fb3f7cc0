"""Queries over import aliases, states of the index, watched paths and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainery.functions import text as T
from grainery.operators import augment as A
from grainery.operators import imports as M
from grainery.operators import search as S
from grainery.streaming import events as E

from .search_queries import read

ALIASED = {
    "py": "import os.path as p{}, json\nfrom m{} import (\n  a as b,\n  c,\n  d as _\n)\n",
    "ts": "import D, { a as b{}, c } from 'react';\nimport * as ns from './lib/utils{}.js'\n",
    "rs": "pub(crate) use crate::schema{} as s;\nuse std::{fmt, io as i{}};\n",
    "go": "import x as y\n",
}


def import_aliases(spark, d):
    """Every part is a file of one of four kinds."""
    at = (F.col("p_partkey") % len(ALIASED) + 1).cast("int")
    ext, said = (F.element_at(F.array(*[F.lit(v) for v in some]), at) for some in (ALIASED, ALIASED.values()))
    files = read(spark, d, "part").select(F.concat(F.lit("f"), "p_partkey", F.lit("."), ext).alias("path"), F.replace(said, F.lit("{}"), F.col("p_size").cast("string")).alias("text"))
    return M.aliases(files)


def stale_notices(spark, d):
    n = F.col("n_nationkey")
    error = F.when(n % 5 == 0, F.lit("unreadable"))
    return read(spark, d, "nation").select("n_nationkey", A.stale_notice(A.freshness(n % 3, error, n % 7 == 0), n % 3, error).alias("notice"))


def startup_actions(spark, d):
    n = F.col("n_nationkey")
    state = F.when(n % 3 == 0, "stale").otherwise("fresh")
    return read(spark, d, "nation").select("n_nationkey", A.startup_action(n % 4, state, n % 5 == 0, n % 7 == 0).alias("action"))


def watched_events(spark, d):
    """The events whose paths are watched; one in five events is the index's own, one in seven the version control's."""
    n = F.col("event_id")
    path = F.when(n % 5 == 0, ".grainery/chunks").when(n % 7 == 0, ".git/index").otherwise(F.concat(F.lit(".github/f"), n))
    return read(spark, d, "events").select("event_id", path.alias("path")).where(E.watched(F.col("path")))


def report_figures(spark, d):
    rows = read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.avg(F.col("l_discount").cast("double")).alias("m"), (F.count("*") - 30000).cast("double").alias("n"))
    return rows.select("l_returnflag", T.percent(F.col("m")).alias("share"), T.signed(F.col("n"), 1).alias("change"))


def _doc_vectors(spark, d):
    at = read(spark, d, "embeddings").where("embedding IS NOT NULL").select((F.col("vec_id") % 97).alias("doc"), F.posexplode("embedding").alias("i", "x"))
    mean = at.groupBy("doc", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
    return mean.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))


def doc_knn(spark, d):
    """The five nearest documents of each document, whose vectors are the means of their chunks' vectors."""
    docs = _doc_vectors(spark, d)
    return S.knn(docs, docs, 5, "doc", "vector").select("qid", "key", F.round("score", 6).alias("score"), "rank")


QUERIES = {f.__name__: f for f in (import_aliases, stale_notices, startup_actions, watched_events, report_figures, doc_knn)}

SQL = {
    "import_aliases": "WITH p AS (SELECT p_partkey, p_size, p_partkey % 4 AS k FROM part) SELECT 'f' || p_partkey || '.py' AS file, 'p' || p_size AS alias, 'path' AS original, NULL AS source FROM p WHERE k = 0 UNION ALL SELECT 'f' || p_partkey || '.py', 'b', 'a', 'm' || p_size FROM p WHERE k = 0 UNION ALL SELECT 'f' || p_partkey || '.ts', 'b' || p_size, 'a', 'react' FROM p WHERE k = 1 UNION ALL SELECT 'f' || p_partkey || '.ts', 'ns', 'utils' || p_size, './lib/utils' || p_size || '.js' FROM p WHERE k = 1 UNION ALL SELECT 'f' || p_partkey || '.rs', 's', 'schema' || p_size, NULL FROM p WHERE k = 2 UNION ALL SELECT 'f' || p_partkey || '.rs', 'i' || p_size, 'io', NULL FROM p WHERE k = 2",
    "stale_notices": f"SELECT n_nationkey, CASE WHEN n_nationkey % 7 = 0 THEN '{A.NOTICE_REFRESHING}' WHEN n_nationkey % 5 = 0 THEN '{A.NOTICE_UNKNOWN.format(' (unreadable)')}' WHEN n_nationkey % 3 > 0 THEN replace('{A.NOTICE_STALE}', '{{}}', CAST(n_nationkey % 3 AS VARCHAR)) END AS notice FROM nation",
    "startup_actions": "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 OR n_nationkey % 7 = 0 THEN NULL WHEN n_nationkey % 4 = 0 THEN 'build' WHEN n_nationkey % 3 = 0 THEN 'refresh' END AS action FROM nation",
    "watched_events": "SELECT event_id, '.github/f' || event_id AS path FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0",
    "report_figures": "SELECT l_returnflag, printf('%.2f%%', avg(CAST(l_discount AS DOUBLE)) * 100) AS share, printf('%+.1f', CAST(count(*) - 30000 AS DOUBLE)) AS change FROM lineitem GROUP BY 1",
    "doc_knn": "WITH c AS (SELECT vec_id % 97 AS doc, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT doc, i, round(avg(CAST(x AS DOUBLE)), 9) AS x FROM c GROUP BY 1, 2), v AS (SELECT doc, list(x ORDER BY i) AS v FROM m GROUP BY 1), s AS (SELECT a.doc AS qid, b.doc AS key, list_cosine_similarity(a.v, b.v) AS s FROM v a JOIN v b ON a.doc <> b.doc), r AS (SELECT qid, key, s, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, key) AS rank FROM s) SELECT qid, key, round(s, 6) AS score, rank FROM r WHERE rank <= 5",
}
