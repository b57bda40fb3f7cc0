"""Queries over graphs, intervals, history, chunks, tables and metrics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainery.operators import chunks as C
from grainery.operators import evaluate as V
from grainery.operators import graph as G
from grainery.operators import history as H
from grainery.operators import intervals as I
from grainery.operators import search as S
from grainery.operators import store as D

from .search_queries import COS, knn_hits, read

# ---- graph: part -> supplier -> nation -> region ----


def _edges(spark, d):
    item = read(spark, d, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"))
    supplier = read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"))
    nation = read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    return G.dedup_edges(item.unionByName(supplier).unionByName(nation))


EDGES = """edges AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""
ROLE = "CASE WHEN incoming >= 3 AND outgoing <= 1 THEN 'entry' WHEN incoming >= 2 AND outgoing >= 2 THEN 'core' WHEN incoming <= 1 AND outgoing >= 2 THEN 'utility' WHEN outgoing = 0 THEN 'leaf' ELSE 'internal' END"
WALK = EDGES + """, walk AS (SELECT 'r' || r_regionkey AS seed, 'r' || r_regionkey AS node, 0 AS depth FROM region UNION SELECT seed, src, depth + 1 FROM walk JOIN edges ON dst = node WHERE depth < 3),
least AS (SELECT seed, node, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY ALL HAVING min(depth) > 0)"""


def edges_build(spark, d):
    return _edges(spark, d)


def _regions(spark, d, name="seed"):
    return read(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias(name))


def neighbors(spark, d):
    nations = read(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node"))
    return G.neighbours(_edges(spark, d), nations)


def bfs_depths(spark, d):
    return G.traverse(_edges(spark, d), _regions(spark, d), 3, reverse=True)


def impact_set(spark, d):
    return G.impact(_edges(spark, d), _regions(spark, d)).groupBy("seed", "kind").agg(F.count("*").alias("n"))


def degree_roles(spark, d):
    return G.roles(_edges(spark, d)).select("node", F.col("incoming").cast("long").alias("incoming"), F.col("outgoing").cast("long").alias("outgoing"), "role")


def pagerank_k5(spark, d):
    return G.pagerank(_edges(spark, d), 5).select("node", F.round("score", 9).alias("score"))


def _pagerank_sql(rounds: int) -> str:
    out = [EDGES, "outs AS (SELECT src AS node, count(*) AS o FROM edges GROUP BY 1)", "nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)", "sz AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM nodes)", "r0 AS (SELECT node, o, 1 / n AS r FROM nodes LEFT JOIN outs USING (node), sz)"]
    for k in range(rounds):
        out += [
            f"g{k} AS MATERIALIZED (SELECT dst AS node, sum(0.85::DOUBLE * r / o - 0.15::DOUBLE * r / n) AS got FROM edges JOIN r{k} ON src = node, sz GROUP BY 1)",
            f"b{k} AS MATERIALIZED (SELECT sum(CASE WHEN o IS NULL THEN 0.85::DOUBLE * r ELSE 0.15::DOUBLE * r END) AS base FROM r{k})",
            f"u{k} AS MATERIALIZED (SELECT node, o, coalesce(got, 0) + base / n AS r FROM r{k} LEFT JOIN g{k} USING (node), b{k}, sz)",
            f"r{k + 1} AS MATERIALIZED (SELECT node, o, r / sum(r) OVER () AS r FROM u{k})",
        ]
    return ", ".join(out)


def pagerank_boost(spark, d):
    ranks = G.pagerank(_edges(spark, d), 5)
    suppliers = read(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("qid"), F.concat(F.lit("s"), "s_suppkey").alias("key"), F.col("s_acctbal").alias("score"))
    return G.rank_boost(suppliers, ranks).select("qid", "key", F.round("score", 4).alias("score"))


# ---- intervals: an order is a file, its lines are symbols ----


def _named_lines(spark, d):
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_partkey").cast("string").alias("name"), F.col("l_linenumber").cast("long").alias("start"), (F.col("l_linenumber") + F.col("l_quantity").cast("long")).cast("long").alias("end"))


def _symbols(spark, d):
    return _named_lines(spark, d).distinct()


def _chunks(spark, d):
    files = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("file")).distinct()
    return files.select("file", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("idx")).select("file", "idx", (F.col("idx") * 10 + 1).cast("long").alias("first"), (F.col("idx") * 10 + 10).cast("long").alias("last"))


SYMBOLS = """symbols AS (SELECT DISTINCT l_orderkey AS file, CAST(l_partkey AS VARCHAR) AS name, CAST(l_linenumber AS BIGINT) AS s, l_linenumber + CAST(l_quantity AS BIGINT) AS e FROM lineitem),
chunks AS (SELECT file, CAST(idx AS INTEGER) AS idx, idx * 10 + 1 AS f, idx * 10 + 10 AS l FROM (SELECT DISTINCT file FROM symbols), range(0, 6) t(idx))"""


def symbol_overlap(spark, d):
    return I.symbol_overlap(_chunks(spark, d), _symbols(spark, d))


def scope_chain(spark, d):
    return I.scope_chain(_chunks(spark, d), _symbols(spark, d))


def enclosing_symbol(spark, d):
    calls = _chunks(spark, d).select("file", F.col("last").alias("line"))
    return I.enclosing_symbol(calls, _named_lines(spark, d))  # equal rows change nothing


def chunk_of_symbol(spark, d):
    return I.chunk_of_symbol(_named_lines(spark, d), _chunks(spark, d))


def call_resolution(spark, d):
    """Suppliers are files that define the parts they ship; orders' customers' nations call parts."""
    item = read(spark, d, "lineitem")
    supplier = read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    nation = read(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    symbols = item.where("l_linenumber = 1").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("name")).distinct().join(supplier, "s_suppkey").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("file"), F.col("s_nationkey").alias("dir"), F.col("n_regionkey").alias("parent"), "name")
    calls = item.select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("callee"))
    imports = read(spark, d, "supplier").select(F.col("s_suppkey").alias("file"), (F.col("s_suppkey") % 7 + 1).alias("target"))
    return I.resolve_calls(calls, symbols, imports)


# ---- history: hours are commits, users are files ----


def _pairs(spark, d):
    events = read(spark, d, "events").select(F.date_trunc("hour", "ts").alias("commit"), F.col("user_id").alias("file"), F.col("event_id").alias("seq"))
    return H.cochange(events)


COCHANGE = """t AS (SELECT date_trunc('hour', ts) AS c, user_id AS file, min(event_id) AS seq FROM events GROUP BY ALL),
k AS (SELECT c, file FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY seq, file) AS rn FROM t) WHERE rn <= 20),
n AS (SELECT file, count(*) AS n FROM k GROUP BY 1),
pp AS (SELECT a.file AS file_a, b.file AS file_b, count(*) AS together FROM k a JOIN k b ON a.c = b.c AND a.file < b.file GROUP BY ALL HAVING count(*) >= 3),
pairs AS (SELECT file_a, file_b, together, together / CAST(x.n + y.n - together AS DOUBLE) AS jaccard FROM pp JOIN n x ON x.file = file_a JOIN n y ON y.file = file_b WHERE together / CAST(x.n + y.n - together AS DOUBLE) >= 0.1)"""


def cochange_pairs(spark, d):
    return _pairs(spark, d).withColumn("jaccard", F.round("jaccard", 6))


def cochange_neighbors(spark, d):
    return H.cochange_neighbours(_pairs(spark, d)).withColumn("jaccard", F.round("jaccard", 6))


def cochange_boost(spark, d):
    hits = knn_hits(spark, d).withColumn("file", F.col("key") % 150)
    return H.cochange_boost(hits, _pairs(spark, d)).select("qid", "key", F.round("score", 6).alias("score"))


# ---- chunks ----


def chunk_windows(spark, d):
    return C.window_chunks(read(spark, d, "documents"), "doc_id", "text").select("doc_id", "chunk_idx", "start_line", "end_line", F.length("content").cast("long").alias("chars"))


def merge_tiny_chunks(spark, d):
    return C.merge_tiny(read(spark, d, "documents"), "doc_id", "text")


def grep_lines(spark, d):
    return C.grep(read(spark, d, "documents"), "doc_id", "text", "licen[sc]e", ignore_case=True)


def exact_dedup(spark, d):
    return C.exact_duplicates(read(spark, d, "documents"), "doc_id", "text", "source")


LINES = "ls AS (SELECT doc_id, string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\\n\\z', ''), chr(10)) AS lines FROM documents)"

# ---- tables ----


def _manifest(spark, d):
    rows = read(spark, d, "documents")
    scan = rows.where("doc_id % 11 <> 0").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("mtime"), F.col("n_chars").alias("size"))
    known = rows.where("doc_id % 13 <> 0").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("mtime"), F.col("n_chars").alias("size"))
    return scan, known


MANIFEST = "scan AS (SELECT doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS mtime, n_chars AS size FROM documents WHERE doc_id % 11 <> 0), known AS (SELECT doc_id AS path, n_chars AS mtime, n_chars AS size FROM documents WHERE doc_id % 13 <> 0)"


def manifest_diff(spark, d):
    return D.changed(*_manifest(spark, d))


def stale_count(spark, d):
    return D.stale(*_manifest(spark, d))


def reconcile_deleted(spark, d):
    return D.vanished(*_manifest(spark, d))


def upsert_merge(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("o_totalprice"))
    new = rows.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.lit("X"))
    return D.upsert(rows.where("o_orderkey % 2 = 0"), new, ["o_orderkey"])


def delete_anti(spark, d):
    rows = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    return D.delete_where_in(rows, read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"])


def cache_hit_miss(spark, d):
    rows = read(spark, d, "documents").select(F.sha2("text", 256).alias("hash"), "doc_id")
    cache = rows.where("doc_id % 2 = 0").select("hash", (F.col("doc_id") % 3).alias("dim"))
    return D.cache_lookup(rows, cache, 0).groupBy("hit").agg(F.count("*").alias("n"))


def ordered_fetch(spark, d):
    keys = read(spark, d, "documents").select(F.col("doc_id").alias("pos"), (F.col("doc_id") * 3).alias("key"))
    return D.ordered_fetch(keys, read(spark, d, "embeddings"), "vec_id", "embedding", 64).select("pos", "key", F.round(F.element_at("v", 1).cast("double"), 6).alias("x0"), F.size("v").cast("long").alias("dim"))


# ---- metrics: results are nearest neighbours, expected are vectors with the query's label among the first 40 ids past it ----


def _expected(spark, d):
    rows = read(spark, d, "embeddings")
    q = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "label")
    return rows.select(F.col("vec_id").alias("item"), "label").join(q, "label").where("item > qid AND item <= qid + 40").select("qid", "item")


EXPECTED = "expected AS (SELECT a.vec_id AS qid, b.vec_id AS item FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id > a.vec_id AND b.vec_id <= a.vec_id + 40 WHERE a.vec_id % 100 = 0)"


def _metric_cte(k: int, name: str) -> str:
    return f"""w{name} AS (SELECT qid, count(*) AS want FROM expected GROUP BY 1), g{name} AS (SELECT cr.qid, count(*) AS returned, count(e.item) AS found, max(CASE WHEN e.item IS NOT NULL THEN 1::DOUBLE / rank END) AS rr FROM cr LEFT JOIN expected e ON e.qid = cr.qid AND e.item = cr.key WHERE rank <= {k} GROUP BY 1),
{name} AS (SELECT qid, CASE WHEN coalesce(want, 0) = 0 THEN 1 ELSE coalesce(found, 0) / CAST(want AS DOUBLE) END AS recall, CASE WHEN coalesce(returned, 0) = 0 THEN 0 ELSE coalesce(found, 0) / CAST(returned AS DOUBLE) END AS "precision", coalesce(rr, 0) AS rr, coalesce(found, 0) = coalesce(want, 0) AS all_found FROM w{name} FULL JOIN g{name} USING (qid))"""


def _results(spark, d, k=50):
    return knn_hits(spark, d, k).withColumnRenamed("key", "item")


def recall_precision_mrr(spark, d):
    m = V.metrics(_results(spark, d), _expected(spark, d), 10)
    return m.select("qid", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "rr")], "all_found")


def ndcg10(spark, d):
    return V.ndcg(_results(spark, d), _expected(spark, d)).select("qid", F.round("ndcg", 6).alias("ndcg"))


def file_f1(spark, d):
    predicted = _results(spark, d, 10).select("qid", "item")
    return V.f1(_expected(spark, d), predicted, "qid", ["item"]).select("qid", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def compare_runs(spark, d):
    results, expected = _results(spark, d), _expected(spark, d)
    return V.compare(V.metrics(results, expected, 5).where("qid % 300 <> 0"), V.metrics(results, expected, 50).where("qid % 200 = 0 OR qid % 300 = 0"))


def report_by_group(spark, d):
    label = read(spark, d, "embeddings").select(F.col("vec_id").alias("qid"), "label")
    m = V.metrics(_results(spark, d), _expected(spark, d), 10).join(label, "qid")
    return m.groupBy("label").agg(F.round(F.avg("recall"), 6).alias("recall"), F.round(F.avg("rr"), 6).alias("mrr"), F.count("*").alias("n"))


# ---- roll-ups, events, sessions ----


def stats_rollup(spark, d):
    return read(spark, d, "documents").rollup("lang", "source").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


def dir_rollup(spark, d):
    parts = F.split(F.regexp_replace("url", "^https?://", ""), "/")
    pages = read(spark, d, "pages").select(parts.alias("p"))
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("p") - 1)), lambda n: F.array_join(F.slice("p", F.lit(1), n), "/"))
    return pages.select(F.explode(prefixes).alias("dir")).groupBy("dir").agg(F.count("*").alias("files"))


def repo_map(spark, d):
    """Nations as files with their suppliers as symbols and the role of each in the graph; the first 15 symbols."""
    roles = G.roles(_edges(spark, d)).select(F.col("node"), "role")
    nation = read(spark, d, "nation").select("n_nationkey", F.concat(F.lit("n"), "n_nationkey").alias("node"), F.col("n_name").alias("path"))
    symbols = read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.sort_array(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("all"))
    j = nation.join(roles, "node", "left").join(symbols, "n_nationkey", "left")
    return j.select("path", F.coalesce("role", F.lit("internal")).alias("role"), F.coalesce(F.array_join(F.transform(F.slice("all", 1, 15), lambda s: s["s_name"]), ","), F.lit("")).alias("symbols"), F.coalesce(F.size("all") > 15, F.lit(False)).alias("truncated"))


def _events(spark, d):
    return read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_events(spark, d):
    w = _events(spark, d).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.unix_timestamp("window.start").alias("start"), "event_type", "n", "total")


def session_events(spark, d):
    s = _events(spark, d).groupBy(F.session_window("ts", "30 minutes"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.unix_micros("session_window.start").alias("start"), "n")


def session_seen(spark, d):
    """Turns of a conversation that say what an earlier turn said go last; others keep their order."""
    from pyspark.sql import Window

    turns = read(spark, d, "conversations").select("conv_id", "turn", "text")
    seen = F.row_number().over(Window.partitionBy("conv_id", "text").orderBy("turn")) > 1
    flagged = turns.withColumn("seen", seen)
    return flagged.select("conv_id", "turn", "seen", F.row_number().over(Window.partitionBy("conv_id").orderBy("seen", "turn")).cast("long").alias("place"))


def tier_dedup(spark, d):
    rows = read(spark, d, "lineitem").select((F.col("l_orderkey") % 100).alias("qid"), F.col("l_orderkey").alias("file"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), (F.col("l_linenumber") % 2 + 1).cast("int").alias("tier"), F.col("l_extendedprice").alias("score"), F.col("l_linenumber").cast("long").alias("start_line"), (F.col("l_linenumber") + F.col("l_quantity") / 10).cast("long").alias("end_line"))
    return S.tier_dedup(rows).select("qid", "file", "key", "tier", "start_line", "end_line")


QUERIES = {f.__name__: f for f in (edges_build, neighbors, bfs_depths, impact_set, degree_roles, pagerank_k5, pagerank_boost, symbol_overlap, scope_chain, enclosing_symbol, chunk_of_symbol, call_resolution, cochange_pairs, cochange_neighbors, cochange_boost, chunk_windows, merge_tiny_chunks, grep_lines, exact_dedup, manifest_diff, stale_count, reconcile_deleted, upsert_merge, delete_anti, cache_hit_miss, ordered_fetch, recall_precision_mrr, ndcg10, file_f1, compare_runs, report_by_group, stats_rollup, dir_rollup, repo_map, tumbling_events, session_events, session_seen, tier_dedup)}

SQL = {
    "edges_build": f"WITH {EDGES} SELECT * FROM edges",
    "neighbors": f"WITH {EDGES} SELECT src AS node, dst AS neighbour, 'imports' AS direction FROM edges WHERE src LIKE 'n%' UNION ALL SELECT dst, src, 'importers' FROM edges WHERE dst LIKE 'n%'",
    "bfs_depths": f"WITH RECURSIVE {WALK} SELECT * FROM least",
    "impact_set": f"WITH RECURSIVE {WALK} SELECT seed, CASE WHEN depth = 1 THEN 'direct' ELSE 'transitive' END AS kind, count(*) AS n FROM least GROUP BY ALL",
    "degree_roles": f"WITH {EDGES}, i AS (SELECT dst AS node, count(*) AS c FROM edges GROUP BY 1), o AS (SELECT src AS node, count(*) AS c FROM edges GROUP BY 1), b AS (SELECT node, coalesce(i.c, 0) AS incoming, coalesce(o.c, 0) AS outgoing FROM i FULL JOIN o USING (node)) SELECT node, incoming, outgoing, {ROLE} AS role FROM b",
    "pagerank_k5": f"WITH {_pagerank_sql(5)} SELECT node, round(r, 9) AS score FROM r5",
    "pagerank_boost": f"WITH {_pagerank_sql(5)}, j AS (SELECT CAST(s_nationkey AS BIGINT) AS qid, 's' || s_suppkey AS key, s_acctbal AS score, r AS pr FROM supplier LEFT JOIN r5 ON node = 's' || s_suppkey), m AS (SELECT qid, list_sort(list(pr) FILTER (pr > 0)) AS l FROM j GROUP BY 1) SELECT qid, key, round(score * coalesce(1 + 0.3::DOUBLE * ln(1 + pr / l[len(l) // 2 + 1]), 1), 4) AS score FROM j JOIN m USING (qid)",
    "symbol_overlap": f"WITH {SYMBOLS} SELECT c.file, idx, string_agg(name, ' ' ORDER BY s, name) AS names, count(*) AS n FROM chunks c JOIN symbols y ON c.file = y.file AND s <= l AND e >= f GROUP BY ALL",
    "scope_chain": f"WITH {SYMBOLS} SELECT c.file, idx, string_agg(name, ' > ' ORDER BY s - e, s, name) AS scope FROM chunks c JOIN symbols y ON c.file = y.file AND s <= f AND e >= l GROUP BY ALL",
    "enclosing_symbol": f"WITH {SYMBOLS}, p AS (SELECT c.file, l AS line, name, CASE WHEN e >= l THEN 0 ELSE 1 END AS kind, CASE WHEN e >= l THEN e - s ELSE -s END AS b FROM chunks c JOIN symbols y ON c.file = y.file AND s <= l), r AS (SELECT *, row_number() OVER (PARTITION BY file, line ORDER BY kind, b, name) AS rn FROM p) SELECT file, line, name, kind = 0 AS encloses FROM r WHERE rn = 1",
    "chunk_of_symbol": f"WITH {SYMBOLS} SELECT y.file, name, s AS start, min(idx) AS idx FROM symbols y JOIN chunks c ON c.file = y.file AND f <= s AND s <= l GROUP BY ALL",
    "call_resolution": "WITH sy AS (SELECT DISTINCT l_suppkey AS file, s_nationkey AS dir, n_regionkey AS parent, l_partkey AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_linenumber = 1), ca AS (SELECT DISTINCT l_suppkey AS file, l_partkey AS callee FROM lineitem), im AS (SELECT s_suppkey AS file, s_suppkey % 7 + 1 AS target FROM supplier), vi AS (SELECT im.file, sy.name AS callee, min(target) AS via FROM im JOIN sy ON sy.file = target GROUP BY ALL), fi AS (SELECT name AS callee, min(file) AS gf FROM sy GROUP BY 1), pl AS (SELECT DISTINCT file, dir, parent FROM sy) SELECT ca.file, ca.callee, coalesce(o.file, via, gf) AS target, CAST(CASE WHEN o.file IS NOT NULL OR via IS NOT NULL THEN 1.0 WHEN gf IS NULL THEN 0.0 WHEN g.dir = pl.dir THEN 0.7 WHEN g.parent = pl.parent THEN 0.5 ELSE 0.3 END AS DOUBLE) AS confidence FROM ca LEFT JOIN sy o ON o.file = ca.file AND o.name = ca.callee LEFT JOIN vi ON vi.file = ca.file AND vi.callee = ca.callee LEFT JOIN fi ON fi.callee = ca.callee LEFT JOIN pl ON pl.file = ca.file LEFT JOIN pl g ON g.file = gf",
    "cochange_pairs": f"WITH {COCHANGE} SELECT file_a, file_b, together, round(jaccard, 6) AS jaccard FROM pairs",
    "cochange_neighbors": f"WITH {COCHANGE} SELECT file_a AS file, file_b AS neighbour, round(jaccard, 6) AS jaccard FROM pairs UNION ALL SELECT file_b, file_a, round(jaccard, 6) FROM pairs",
    "cochange_boost": f"WITH {COCHANGE}, {COS}, h AS (SELECT qid, key, score, rank, key % 150 AS file FROM cr WHERE rank <= 30), f AS (SELECT qid, file, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS k FROM h GROUP BY qid, file), nb AS (SELECT file_a AS file, file_b AS nb, jaccard FROM pairs UNION ALL SELECT file_b, file_a, jaccard FROM pairs), j AS (SELECT qid, nb AS file, max(jaccard) AS j FROM f JOIN nb USING (file) WHERE k <= 3 GROUP BY ALL) SELECT qid, key, round(score + 0.1::DOUBLE * coalesce(j, 0), 6) AS score FROM h LEFT JOIN j USING (qid, file)",
    "chunk_windows": f"WITH {LINES}, w AS (SELECT doc_id, lines, CAST(unnest(range(0, CAST(greatest(0, ceil((len(lines) - 50) / 45.0)) AS BIGINT) + 1)) AS INTEGER) AS chunk_idx FROM ls) SELECT doc_id, chunk_idx, chunk_idx * 45 + 1 AS start_line, CAST(least(chunk_idx * 45 + 50, len(lines)) AS INTEGER) AS end_line, length(array_to_string(lines[chunk_idx * 45 + 1 : least(chunk_idx * 45 + 50, len(lines))], chr(10))) AS chars FROM w",
    "merge_tiny_chunks": f"WITH {LINES}, e AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM ls), g AS (SELECT doc_id, pos, sum(CASE WHEN strlen(trim(line)) < 40 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM e), m AS (SELECT doc_id, g, min(pos) AS lo, max(pos) AS hi, count(*) AS n, max(g) OVER (PARTITION BY doc_id) AS most FROM g GROUP BY doc_id, g), v AS (SELECT doc_id, CASE WHEN g = 0 AND n = 1 AND most >= 1 THEN 1 ELSE g END AS g, lo, hi FROM m), f AS (SELECT doc_id, g, min(lo) AS lo, max(hi) AS hi FROM v GROUP BY ALL) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY lo) - 1 AS INTEGER) AS chunk_idx, CAST(lo + 1 AS INTEGER) AS start_line, CAST(hi + 1 AS INTEGER) AS end_line FROM f",
    "grep_lines": f"WITH {LINES}, e AS (SELECT doc_id, unnest(lines) AS line, CAST(generate_subscripts(lines, 1) AS INTEGER) AS line_number FROM ls) SELECT doc_id, line_number, line FROM e WHERE regexp_matches(line, '(?i)licen[sc]e')",
    "exact_dedup": "WITH g AS (SELECT text, min(doc_id) AS kept FROM documents GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT source) > 1) SELECT doc_id, kept FROM documents JOIN g USING (text) WHERE doc_id <> kept",
    "manifest_diff": f"WITH {MANIFEST} SELECT * FROM scan EXCEPT SELECT * FROM known",
    "stale_count": f"WITH {MANIFEST} SELECT count(*) FILTER (scan.mtime IS NULL OR scan.mtime <> known.mtime) AS stale FROM known LEFT JOIN scan USING (path)",
    "reconcile_deleted": f"WITH {MANIFEST} SELECT path FROM known WHERE path NOT IN (SELECT path FROM scan)",
    "upsert_merge": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0",
    "delete_anti": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "cache_hit_miss": "WITH c AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 = 0) SELECT text IN (SELECT text FROM c) AS hit, count(*) AS n FROM documents GROUP BY 1",
    "ordered_fetch": "SELECT doc_id AS pos, doc_id * 3 AS key, round(CAST(coalesce(embedding[1], 0) AS DOUBLE), 6) AS x0, coalesce(len(embedding), 64) AS dim FROM documents LEFT JOIN embeddings ON vec_id = doc_id * 3",
    "recall_precision_mrr": f"WITH {COS}, {EXPECTED}, {_metric_cte(10, 'm')} SELECT qid, round(recall, 6) AS recall, round(\"precision\", 6) AS \"precision\", round(rr, 6) AS rr, all_found FROM m",
    "ndcg10": f"WITH {COS}, {EXPECTED}, g AS (SELECT qid, sum(1 / log2(rank + 1)) AS gain FROM cr JOIN expected e USING (qid) WHERE e.item = key AND rank <= 10 GROUP BY 1), b AS (SELECT qid, list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1 / log2(i + 1))) AS ideal FROM expected GROUP BY 1) SELECT qid, round(coalesce(gain, 0) / ideal, 6) AS ndcg FROM b LEFT JOIN g USING (qid)",
    "file_f1": f"WITH {COS}, {EXPECTED}, n AS (SELECT coalesce(e.qid, p.qid) AS qid, count(e.item) AS e, count(p.key) AS p, count(*) FILTER (e.item IS NOT NULL AND p.key IS NOT NULL) AS b FROM expected e FULL JOIN (SELECT qid, key FROM cr WHERE rank <= 10) p ON e.qid = p.qid AND e.item = p.key GROUP BY 1), m AS (SELECT qid, CASE WHEN p > 0 THEN b / CAST(p AS DOUBLE) ELSE 0 END AS pr, CASE WHEN e > 0 THEN b / CAST(e AS DOUBLE) ELSE 0 END AS re FROM n) SELECT qid, round(pr, 6) AS \"precision\", round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END, 6) AS f1 FROM m",
    "compare_runs": f"WITH {COS}, {EXPECTED}, {_metric_cte(5, 'a')}, {_metric_cte(50, 'b')}, j AS (SELECT coalesce(x.qid, y.qid) AS qid, x.rr AS ra, y.rr AS rb, x.recall AS ca, y.recall AS cb FROM (SELECT * FROM a WHERE qid % 300 <> 0) x FULL JOIN (SELECT * FROM b WHERE qid % 200 = 0 OR qid % 300 = 0) y ON x.qid = y.qid) SELECT qid, CASE WHEN ra IS NULL THEN 'added' WHEN rb IS NULL THEN 'removed' WHEN rb - ra > 1e-9 THEN 'improved' WHEN rb - ra < -1e-9 THEN 'regressed' WHEN cb - ca > 1e-9 THEN 'improved' WHEN cb - ca < -1e-9 THEN 'regressed' ELSE 'unchanged' END AS verdict, round(rb - ra, 6) AS rr_delta FROM j",
    "report_by_group": f"WITH {COS}, {EXPECTED}, {_metric_cte(10, 'm')} SELECT label, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, count(*) AS n FROM m JOIN embeddings ON vec_id = qid GROUP BY 1",
    "stats_rollup": "SELECT lang, source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)",
    "dir_rollup": "WITH p AS (SELECT string_split(regexp_replace(url, '^https?://', ''), '/') AS p FROM pages), x AS (SELECT p, unnest(range(1, greatest(1, len(p) - 1) + 1)) AS n FROM p) SELECT array_to_string(p[1:n], '/') AS dir, count(*) AS files FROM x GROUP BY 1",
    "repo_map": f"WITH {EDGES}, i AS (SELECT dst AS node, count(*) AS c FROM edges GROUP BY 1), o AS (SELECT src AS node, count(*) AS c FROM edges GROUP BY 1), b AS (SELECT node, coalesce(i.c, 0) AS incoming, coalesce(o.c, 0) AS outgoing FROM i FULL JOIN o USING (node)), r AS (SELECT node, {ROLE} AS role FROM b), s AS (SELECT s_nationkey, list(s_name ORDER BY s_suppkey) AS l FROM supplier GROUP BY 1) SELECT n_name AS path, coalesce(role, 'internal') AS role, coalesce(array_to_string(l[1:15], ','), '') AS symbols, coalesce(len(l) > 15, false) AS truncated FROM nation LEFT JOIN r ON node = 'n' || n_nationkey LEFT JOIN s ON s_nationkey = n_nationkey",
    "tumbling_events": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "session_events": "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM b GROUP BY user_id, s",
    "session_seen": "WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) > 1 AS seen FROM conversations) SELECT conv_id, turn, seen, row_number() OVER (PARTITION BY conv_id ORDER BY seen, turn) AS place FROM s",
}
