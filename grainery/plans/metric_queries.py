"""Queries over evaluation sets, runs, regions and names, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from grainery.functions import text as T
from grainery.operators import evaluate as V
from grainery.operators import goldset as Q
from grainery.sources import records as R

from .search_queries import read


def doc_len(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(T.code_tokens(F.col("text"))).cast("long").alias("length"))


def line_ranges(spark, d):
    """The lines of the middle third of every text."""
    n = F.length("text")
    r = T.line_range(F.col("text"), F.floor(n / 3).cast("int"), F.floor(2 * n / 3).cast("int"))
    return read(spark, d, "documents").select("doc_id", r.alias("r")).select("doc_id", F.col("r.first").cast("long").alias("first"), F.col("r.last").cast("long").alias("last"))


def _dear_orders(spark, d):
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return read(spark, d, "orders").select(F.col("o_custkey").alias("qid"), F.col("o_orderkey").alias("item"), rank.alias("rank"), "o_orderstatus")


def acc_at_k(spark, d):
    """A customer's orders by price; gold are those of one status."""
    rows = _dear_orders(spark, d)
    return V.strict_accuracy(rows.select("qid", "item", "rank"), rows.where("o_orderstatus = 'F'").select("qid", "item"), 5)


def region_overlap(spark, d):
    """Lines of a tenth of the orders are chunks, those of another tenth gold regions; suppliers are files."""
    item = read(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("qid"), F.col("l_suppkey").alias("file"), (F.col("l_linenumber") * 10).cast("long").alias("first"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).cast("long").alias("last"), (F.col("l_orderkey") % 7).alias("part"))
    got = Q.region_overlap(item.where("part < 5").drop("part"), item.where("part >= 5").drop("part"))
    return got.select("qid", F.round("overlap", 6).alias("overlap"))


def gold_regions(spark, d):
    """Regions read from JSON text; every other file lies in a workspace, every fifth entry has no lines."""
    file = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "/workspace/repo/").otherwise(""), F.lit("src/f"), "o_custkey")
    line = F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderkey"))
    text = F.to_json(F.array(F.struct(file.alias("file"), line.alias("start_line"), (line + 3).alias("end_line"))))
    return Q.gold_regions(read(spark, d, "orders").select("o_orderkey", text.alias("gold")), "gold", "o_orderkey")


def numstat(spark, d):
    """Lines `added TAB deleted TAB path` made of order lines; some are binary, some are renames."""
    added = F.when(F.col("l_linenumber") == 3, "-").otherwise(F.col("l_quantity").cast("int").cast("string"))
    path = F.concat(F.lit("src/"), F.when(F.col("l_linenumber") == 2, "{a => b}/").otherwise(""), F.lit("f"), "l_partkey")
    lines = read(spark, d, "lineitem").select("l_orderkey", F.concat_ws("\t", added, F.col("l_linenumber").cast("string"), path).alias("line"))
    return Q.numstat(lines).select("l_orderkey", "added", "deleted", "path")


def gold_priority(spark, d):
    """Orders as cases, a customer's being one case told by several commits."""
    n = F.col("o_orderkey") % 9 + 1
    rows = read(spark, d, "orders").select(F.col("o_custkey").alias("id"), Q.complexity(n).alias("complexity"), F.col("o_orderkey").alias("seq"))
    return Q.prioritised(rows, 60).select("id", "complexity", "seq", F.col("place").cast("long").alias("place"))


def sweep_summary(spark, d):
    got = V.sweep_summary(read(spark, d, "customer"), "c_mktsegment", "c_acctbal", "c_nationkey")
    return got.select("c_mktsegment", "runs", F.round("c_acctbal", 4).alias("recall"), F.round("c_nationkey", 4).alias("mrr"))


KIND_NAMES = [*T.KINDS, "function", "method", "module", "struct", "odd_node"]
EVAL_PATHS = ["benchmarks/cases/rust/hyperfine.json", "x\\cases\\go\\cobra.json", "cases/zig/a.json", "a/b.toml", ".env", "/cases/c/../x.tar.gz"]


def kind_names(spark, d):
    return spark.createDataFrame([(k,) for k in KIND_NAMES], "node string").select("node", T.normal_kind(F.col("node")).alias("kind"), T.short_kind(T.normal_kind(F.col("node"))).alias("short"))


def eval_paths(spark, d):
    return spark.createDataFrame([(p,) for p in EVAL_PATHS], "path string").select("path", T.eval_language(F.col("path")).alias("language"), T.profile_name(F.col("path")).alias("profile"))


def anchor_words(spark, d):
    return read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.anchors(F.col("text")).cast("long").alias("anchors"))


def role_from_lists(spark, d):
    """Roles of suppliers inferred from lists of at most 20 neighbours."""
    few = lambda c: F.least(F.count_distinct(c), F.lit(20))
    n = read(spark, d, "lineitem").groupBy("l_suppkey").agg(few("l_partkey").alias("incoming"), few(F.when(F.col("l_suppkey") % 3 == 0, F.col("l_linenumber")).when(F.col("l_suppkey") % 3 == 1, 1)).alias("outgoing"))
    return n.select("l_suppkey", T.role(F.col("incoming"), F.col("outgoing")).alias("role"))


def event_dates(spark, d):
    return read(spark, d, "events").select("event_id", T.rfc3339(F.floor(F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")) / 1_000_000)).alias("date"))


def metadata_latest(spark, d):
    """Order prices as an append-only table of entries, some of them removals."""
    value = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderstatus"))
    return R.latest(read(spark, d, "orders").select(F.col("o_custkey").alias("key"), value.alias("value"), F.col("o_orderkey").alias("seq")))


def incomplete_batches(spark, d):
    """Users' events as marks of batches: views begin, purchases complete, others delete."""
    event = F.when(F.col("event_type") == "view", "begin").when(F.col("event_type") == "purchase", "complete").otherwise("delete")
    return R.incomplete(read(spark, d, "events").select(F.col("user_id").alias("batch"), event.alias("event"), F.col("event_id").alias("seq"), F.col("event_id").alias("files")))


QUERIES = {f.__name__: f for f in (doc_len, line_ranges, acc_at_k, region_overlap, gold_regions, numstat, gold_priority, sweep_summary, kind_names, eval_paths, anchor_words, role_from_lists, event_dates, metadata_latest, incomplete_batches)}

ITEM = "item AS (SELECT l_orderkey % 50 AS qid, l_suppkey AS file, l_linenumber * 10 AS a, l_linenumber * 10 + CAST(floor(l_quantity) AS BIGINT) AS z, l_orderkey % 7 AS part FROM lineitem)"

SQL = {
    "doc_len": "SELECT doc_id, len(regexp_extract_all(text, '([A-Z]?[a-z]+|[A-Z]+|[0-9]+)', 1)) AS length FROM documents",
    "line_ranges": "WITH r AS (SELECT doc_id, text, CAST(floor(length(text) / 3) AS BIGINT) AS a, CAST(floor(2 * length(text) / 3) AS BIGINT) AS z FROM documents) SELECT doc_id, len(string_split(substring(text, 1, a), chr(10))) AS first, len(string_split(substring(text, 1, greatest(a, z - 1)), chr(10))) AS last FROM r",
    "acc_at_k": "WITH r AS (SELECT o_custkey AS qid, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) SELECT qid, CASE WHEN max(rank) <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS accurate FROM r WHERE o_orderstatus = 'F' GROUP BY 1",
    "region_overlap": f"WITH {ITEM}, g AS (SELECT DISTINCT qid, file, a, z FROM item WHERE part >= 5) SELECT qid, round(avg(CASE WHEN EXISTS (SELECT 1 FROM item c WHERE c.part < 5 AND c.qid = g.qid AND c.file = g.file AND c.a <= g.z AND c.z >= g.a) THEN 1.0::DOUBLE ELSE 0 END), 6) AS overlap FROM g GROUP BY 1",
    "gold_regions": "SELECT o_orderkey, 'src/f' || o_custkey AS file, o_orderkey AS first, o_orderkey + 3 AS last FROM orders WHERE o_orderkey % 5 > 0",
    "numstat": "SELECT l_orderkey, CAST(floor(l_quantity) AS BIGINT) AS added, CAST(l_linenumber AS BIGINT) AS deleted, 'src/' || CASE WHEN l_linenumber = 2 THEN 'b/' ELSE '' END || 'f' || l_partkey AS path FROM lineitem WHERE l_linenumber <> 3",
    "gold_priority": "WITH c AS (SELECT o_custkey AS id, o_orderkey AS seq, CASE WHEN o_orderkey % 9 + 1 = 1 THEN 'low' WHEN o_orderkey % 9 + 1 <= 5 THEN 'medium' ELSE 'high' END AS complexity FROM orders), p AS (SELECT *, CASE complexity WHEN 'medium' THEN 0 WHEN 'low' THEN 1 ELSE 2 END AS p FROM c), f AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY p, seq) = 1) SELECT id, complexity, seq, row_number() OVER (ORDER BY p, seq) AS place FROM f QUALIFY place <= 60",
    "sweep_summary": "SELECT c_mktsegment, count(*) AS runs, round(avg(c_acctbal), 4) AS recall, round(avg(c_nationkey), 4) AS mrr FROM customer WHERE c_acctbal > 0 GROUP BY 1",
    "kind_names": "WITH n AS (SELECT unnest([" + ", ".join(f"'{k}'" for k in KIND_NAMES) + "]) AS node), k AS (SELECT node, CASE WHEN node LIKE 'function%' THEN 'function' WHEN node LIKE 'method%' THEN 'method' WHEN node LIKE 'class%' THEN 'class' WHEN node LIKE '%_item' OR node LIKE '%_declaration' THEN string_split(node, '_')[1] ELSE node END AS kind FROM n) SELECT node, kind, CASE kind WHEN 'function' THEN 'fn' WHEN 'module' THEN 'mod' ELSE kind END AS short FROM k",
    "eval_paths": r"SELECT * FROM (VALUES ('benchmarks/cases/rust/hyperfine.json', 'rust', 'hyperfine'), ('x\cases\go\cobra.json', 'go', 'x\cases\go\cobra'), ('cases/zig/a.json', 'unknown', 'a'), ('a/b.toml', 'unknown', 'b'), ('.env', 'unknown', '.env'), ('/cases/c/../x.tar.gz', 'c', 'x.tar')) AS t(path, language, profile)",
    "anchor_words": r"SELECT conv_id, turn, len(list_filter(string_split_regex(text, '\s+'), lambda w: regexp_matches(w, '[/._]') OR (regexp_matches(w, '\p{Lu}') AND regexp_matches(w, '\p{Ll}')))) AS anchors FROM conversations WHERE role = 'user'",
    "role_from_lists": "WITH n AS (SELECT l_suppkey, least(count(DISTINCT l_partkey), 20) AS i, CASE l_suppkey % 3 WHEN 0 THEN least(count(DISTINCT l_linenumber), 20) WHEN 1 THEN 1 ELSE 0 END AS o FROM lineitem GROUP BY 1) SELECT l_suppkey, CASE WHEN i >= 3 AND o <= 1 THEN 'entry' WHEN i >= 2 AND o >= 2 THEN 'core' WHEN i <= 1 AND o >= 2 THEN 'utility' WHEN o = 0 THEN 'leaf' ELSE 'internal' END AS role FROM n",
    "event_dates": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS date FROM events",
    "metadata_latest": "WITH l AS (SELECT o_custkey AS key, CASE WHEN o_orderkey % 4 > 0 THEN o_orderstatus END AS value FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1) SELECT * FROM l WHERE value IS NOT NULL",
    "incomplete_batches": "WITH l AS (SELECT user_id AS batch, max_by(event_type, event_id) AS t, max(event_id) FILTER (event_type = 'view') AS files FROM events GROUP BY 1) SELECT batch, files FROM l WHERE t = 'view'",
}
