"""Queries over imports, calls and gold sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainery.functions import text as T
from grainery.operators import evaluate as V
from grainery.operators import goldset as H
from grainery.operators import imports as M
from grainery.operators import symbols as Y
from grainery.streaming import events as E

from .search_queries import PATHS_SQL, _list, _paths, read
from .structure_queries import EDGES, _edges

KINDS = ["fix(core): handle ", "feat: add ", "Merge #12 ", "docs: update ", "GH-7 improve ", ""]


def _subjects(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.col("p_partkey") % len(KINDS) + 1).cast("int"))
    return read(spark, d, "part").select(F.col("p_partkey").alias("commit"), F.concat(kind, F.lower("p_name"), F.lit("  part (#"), "p_size", F.lit(")..")).alias("subject"))


SUBJECTS = f"""subjects AS (SELECT p_partkey AS "commit", [{', '.join(f"'{k}'" for k in KINDS)}][p_partkey % {len(KINDS)} + 1] || lower(p_name) || '  part (#' || p_size || ')..' AS subject FROM part)"""


def _touched(spark, d):
    path = F.concat(F.element_at(F.array(*[F.lit(x) for x in ("src/", "tests/", "docs/a.md/", "lib/benches/")]), (F.col("l_linenumber") % 4 + 1).cast("int")), "l_suppkey", F.lit(".rs"))
    return read(spark, d, "lineitem").select(F.col("l_partkey").alias("commit"), path.alias("path"), (F.col("l_quantity") % 3).cast("int").alias("added")).distinct()


TOUCHED = """touched AS (SELECT DISTINCT l_partkey AS "commit", ['src/', 'tests/', 'docs/a.md/', 'lib/benches/'][l_linenumber % 4 + 1] || l_suppkey || '.rs' AS path, CAST(l_quantity % 3 AS INTEGER) AS added FROM lineitem)"""
QUERY_SQL = rf"""q AS (SELECT "commit", subject, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(subject, '{H.PREFIX}', '', 'i'), '{H.TICKET}', '', 'gi'), '\.+$', ''), '\s+', ' ', 'g')) AS t FROM subjects),
asked AS (SELECT "commit", subject, CASE WHEN len(string_split(t, ' ')) >= 3 AND NOT regexp_matches(t, '{H.GENERIC}', 'i') THEN t END AS query FROM q)"""


def transform_query(spark, d):
    return _subjects(spark, d).select("commit", H.subject_query(F.col("subject")).alias("query"))


def gold_commit_filter(spark, d):
    return H.cases(_subjects(spark, d), _touched(spark, d)).select("commit", "query", F.array_join("files", ",").alias("files"), "category", "complexity")


def test_file_flags(spark, d):
    return _paths(spark, d).select("path", T.is_test_file(F.col("path")).alias("is_test_file"), H.is_side_path(F.col("path")).alias("is_side_path"))


RAW = {"rs": "pub(crate) use crate::{}::*;", "java": "import static org.{}.Use;", "h": '#include "{}.h"', "cs": "using static {} ;", "php": "use App\\{};", "swift": "import {}", "py": " {} "}


def import_paths(spark, d):
    ext = F.element_at(F.array(*[F.lit(e) for e in RAW]), (F.col("p_partkey") % len(RAW) + 1).cast("int"))
    raw = F.element_at(F.array(*[F.lit(r) for r in RAW.values()]), (F.col("p_partkey") % len(RAW) + 1).cast("int"))
    rows = read(spark, d, "part").select("p_partkey", ext.alias("ext"), F.replace(raw, F.lit("{}"), F.concat(F.lit("m"), "p_size")).alias("raw"))
    return rows.select("p_partkey", M.import_path(F.col("raw"), F.col("ext")).alias("name"))


def _modules(spark, d):
    part = read(spark, d, "part")
    base = F.concat(F.when(F.col("p_partkey") % 3 == 0, "src/").otherwise(""), F.lit("b"), F.col("p_partkey") % 50, F.lit("/m"), "p_partkey")
    return part.select(F.concat(base, F.when(F.col("p_partkey") % 2 == 0, ".py").otherwise("/__init__.py")).alias("path"))


def python_imports(spark, d):
    """Orders' lines import modules named by part, some of them by an item in the module."""
    raw = F.concat(F.lit("b"), F.col("l_partkey") % 50, F.lit(".m"), F.col("l_partkey") + F.when(F.col("l_linenumber") == 5, 50000).otherwise(0), F.when(F.col("l_linenumber") % 2 == 0, ".item").otherwise(""))
    rows = read(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey") % 1000, F.lit(".py")).alias("file"), raw.alias("raw"), F.lit("py").alias("ext"))  # resolve makes its rows distinct
    return M.resolve(rows, _modules(spark, d)).groupBy("dst").agg(F.count("*").alias("n"))


def call_trace(spark, d):
    return Y.call_trace(_edges(spark, d), "p1", "n1", 5).unionByName(Y.call_trace(_edges(spark, d), "s1", "r1", 5))


def line_set_f1(spark, d):
    """The lines of a part's shipments against the lines that their discounts predict, by ship mode of the line number."""
    item = read(spark, d, "lineitem").select((F.col("l_linenumber") % 3).cast("int").alias("by"), F.col("l_suppkey").alias("file"), F.col("l_quantity").cast("int").alias("first"), (F.col("l_discount") * 100).cast("int").alias("w"))
    want = H.line_set(item.select("by", "file", "first", (F.col("first") + 2).alias("last")))
    got = H.line_set(item.select("by", "file", (F.col("first") + F.col("w")).alias("first"), (F.col("first") + F.col("w") + 1).alias("last")))
    return V.f1(want, got, "by", ["file", "line"]).select("by", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), F.round("f1", 9).alias("f1"))


def lease_spans(spark, d):
    events = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.leases(events, "user_id", "2 hours").select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("expires").alias("expires"), "beats")


QUERIES = {f.__name__: f for f in (lease_spans, transform_query, gold_commit_filter, test_file_flags, import_paths, python_imports, call_trace, line_set_f1)}
SQL = {
    "lease_spans": "WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOURS THEN 0 ELSE 1 END AS new FROM events), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM a) SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 7200000000 AS expires, count(*) AS beats FROM b GROUP BY user_id, s",
    "transform_query": f'WITH {SUBJECTS}, {QUERY_SQL} SELECT "commit", query FROM asked',
    "gold_commit_filter": rf"""WITH {SUBJECTS}, {TOUCHED}, {QUERY_SQL},
f AS (SELECT "commit", count(*) AS n, string_agg(DISTINCT path, ',' ORDER BY path) AS files FROM touched WHERE added > 0 AND NOT regexp_matches(path, '{H.SIDE_PATHS}', 'i') GROUP BY 1 HAVING count(*) <= {H.MOST_FILES})
SELECT "commit", query, files, CASE WHEN n > 1 THEN 'cross_file' WHEN regexp_matches(lower(query), '\b(where|find|locate)\b') THEN 'symbol' WHEN regexp_matches(lower(query), '\b(how|why|explain|what)\b') THEN 'conceptual' ELSE 'keyword_code' END AS category,
CASE WHEN n = 1 THEN 'low' WHEN n <= 5 THEN 'medium' ELSE 'high' END AS complexity
FROM asked JOIN f USING ("commit") WHERE query IS NOT NULL AND NOT regexp_matches(subject, '\b({H.SKIP_WORDS})\b', 'i') AND regexp_matches(subject, '\b({H.KEEP_WORDS})\b', 'i')""",
    "test_file_flags": f"WITH {PATHS_SQL} SELECT path, list_bool_or([contains(lower(path), '/' || x || '/') FOR x IN {_list(T.TEST_FOLDERS).replace('(', '[').replace(')', ']')}]) OR list_bool_or([ends_with(lower(path), x) FOR x IN {_list(T.TEST_ENDINGS).replace('(', '[').replace(')', ']')}]) OR regexp_matches(lower(path), '(^|/)test_[^/]*\\.py$') AS is_test_file, regexp_matches(path, '{H.SIDE_PATHS}', 'i') AS is_side_path FROM paths",
    "import_paths": f"SELECT p_partkey, replace([{', '.join(repr(x) for x in ('crate::{}', 'org.{}.Use', '{}.h', '{}', 'App' + chr(92) + '{}', '{}', '{}')).replace(chr(92) * 2, chr(92))}][p_partkey % {len(RAW)} + 1], '{{}}', 'm' || p_size) AS name FROM part",
    "python_imports": """WITH m AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'src/' ELSE '' END || 'b' || p_partkey % 50 || '/m' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '.py' ELSE '/__init__.py' END AS path FROM part),
r AS (SELECT DISTINCT l_orderkey % 1000 AS file, 'b' || l_partkey % 50 || '/m' || (l_partkey + CASE WHEN l_linenumber = 5 THEN 50000 ELSE 0 END) AS base, l_linenumber % 2 = 0 AS item FROM lineitem),
c AS (SELECT r.*, u.pos, u.path FROM r, (SELECT 0) z, LATERAL (SELECT unnest([1, 2, 3, 4]) AS pos, unnest([base || '.py', base || '/__init__.py', 'src/' || base || '.py', 'src/' || base || '/__init__.py']) AS path) u)
SELECT dst, count(*) AS n FROM (SELECT file, base, item, arg_min(c.path, pos) AS dst FROM c JOIN m USING (path) GROUP BY ALL) GROUP BY dst""",
    "call_trace": f"""WITH {EDGES}, t AS (SELECT * FROM (VALUES ('p1', 'n1'), ('s1', 'r1')) v(a, b)),
d AS (SELECT a, b FROM t JOIN edges ON src = a AND dst = b),
v AS (SELECT t.a, t.b, x.dst AS via, row_number() OVER (PARTITION BY t.a, t.b ORDER BY x.dst) AS k FROM t JOIN edges x ON x.src = t.a JOIN edges y ON y.src = x.dst AND y.dst = t.b WHERE (t.a, t.b) NOT IN (SELECT (a, b) FROM d))
SELECT CAST(NULL AS VARCHAR) AS via FROM d UNION ALL SELECT via FROM v WHERE k <= 5""",
    "line_set_f1": """WITH i AS (SELECT CAST(l_linenumber % 3 AS INTEGER) AS k, l_suppkey AS file, CAST(l_quantity AS INTEGER) AS a, CAST(trunc(l_discount * 100) AS INTEGER) AS w FROM lineitem),
e AS (SELECT DISTINCT k, file, unnest(range(a, a + 3)) AS line FROM i), p AS (SELECT DISTINCT k, file, unnest(range(a + w, a + w + 2)) AS line FROM i),
n AS (SELECT k, (SELECT count(*) FROM e WHERE e.k = g.k) AS e, (SELECT count(*) FROM p WHERE p.k = g.k) AS p, (SELECT count(*) FROM e JOIN p USING (k, file, line) WHERE e.k = g.k) AS b FROM (SELECT DISTINCT k FROM i) g)
SELECT k AS "by", round(b / p, 9) AS precision, round(b / e, 9) AS recall, round(2 * (b / p) * (b / e) / (b / p + b / e), 9) AS f1 FROM n""",
}
