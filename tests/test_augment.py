import math

import pytest
from pyspark.sql import functions as F

from grainery.functions import models as M
from grainery.operators import augment as A
from grainery.streaming import state as R


def one(spark, f, *values):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, s string").select("i", f(F.col("s")).alias("v"))
    return [r["v"] for r in rows.orderBy("i").collect()]


def test_doc_comment(spark):
    cases = [
        ('  """Reads a whole table.\n"""\ndef f(): pass', "Reads a whole table."),
        ("'''short'''\nx = 1", None),
        ("/** Walks the tree.\n * Then stops.\n */\nfn f() {}", "Walks the tree. Then stops."),
        ("/// Adds one number\n// to another\nfn f() {}\n/// not this", "Adds one number to another"),
        ("//! Module of many things\n", "Module of many things"),
        ("// plain words here\n// and more\nlet x", "plain words here and more"),
        ("let x = 1;\n/// too late to count", None),
        ("", None),
        (None, None),
    ]
    assert one(spark, A.doc_comment, *[c for c, _ in cases]) == [w for _, w in cases]


def test_hash_embedder(spark):
    a, b, c, none, empty = one(spark, M.HashEmbedder(64).column, "parse the tokens", "tokens, the parse", "quite other words", None, "")
    assert a == b and math.isclose(sum(x * x for x in a), 1, rel_tol=1e-5) and sum(x * y for x, y in zip(a, c, strict=True)) < 0.7
    assert none == empty == [0.0] * 64


def test_models_by_name():
    assert M.model("embedder", "hash")().dim == 256
    for kind in ("embedder", "reranker", "expander", "summarizer"):
        with pytest.raises(ValueError):
            M.model(kind, "missing")
    M.register("expander", "twice", lambda q: [q, q])
    assert M.model("expander", "twice")("a") == ["a", "a"]


def test_new_keywords(spark):
    words = F.array(*[F.lit(w) for w in ("parser", "load_all", "unrelated", "Walk")])
    assert one(spark, lambda q: M.new_keywords(q, words), "parse it") == [["parser", "load_all", "Walk"]]


def test_along_imports(spark):
    hits = spark.createDataFrame([(0, "a:0", "a", 1.0, 1)], "qid int, key string, file string, score double, rank int")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    chunks = spark.createDataFrame([("a:0", "a", [1.0, 0.0]), ("a:1", "a", [1.0, 0.0]), ("b:0", "b", [1.0, 0.0]), ("b:1", "b", [0.0, 1.0]), ("c:0", "c", [1.0, 1.0]), ("d:0", "d", [1.0, 0.0]), ("b:2", "b", None)], "key string, file string, v array<double>")
    asked = spark.createDataFrame([(0, [2.0, 0.0])], "qid int, qv array<double>")
    near = spark.createDataFrame([(0, "d:0", 0.2), (0, "b:1", 0.1)], "qid int, key string, dist double")
    got = {r["key"]: (round(r["score"], 6), r["why"]) for r in A.along_imports(hits, edges, chunks, asked, 2, near).collect()}
    assert got == {"a:0": (1.0, "primary"), "b:0": (0.3, "graph"), "c:0": (round(0.09 / math.sqrt(2), 6), "graph"), "d:0": (0.32, "proximity")}


def test_branch_and_folder(spark):
    hits = spark.createDataFrame([("src/a.py",), ("a.py",), ("b.py",), (None,)], "file string")
    files = lambda *c: sorted(r["file"] or "" for r in A.in_branch(hits, spark.createDataFrame([(x,) for x in c], "path string")).collect())
    assert files("src/a.py") == ["a.py", "src/a.py"] and files("a.py") == ["a.py", "src/a.py"] and files("z") == [] and len(files()) == 4 and len(files(None, "")) == 4
    folder = lambda *p: A.common_folder(spark.createDataFrame([(x,) for x in p], "path string")).first()["folder"]
    assert folder("a/b/c.py", "a/bc/d.py") == "a" and folder("a/b/c.py", "a/b/d/e.py") == "a/b" and folder("x.py", "a/y.py") == "" and folder() == ""


def run(stream, tmp_path, name):
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start().awaitTermination()


def test_single_flight_over_batches(spark, tmp_path):
    schema = "project string, seq bigint, kind string"
    want = []
    for rows, actions in (([(1, "change"), (2, "change"), (3, "change")], ["start", "queue", "queue"]), ([(4, "finished"), (5, "finished"), (6, "finished"), (7, "other"), (8, "change")], ["follow_up", "idle", "idle", "start"])):
        spark.createDataFrame([("p", s, k) for s, k in rows], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(R.single_flight(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), tmp_path, "out")
        want += actions
    assert [r["action"] for r in spark.read.parquet(f"{tmp_path}/out").orderBy("seq").collect()] == want


def test_lease_expires(spark, tmp_path):
    beat = lambda rows: spark.createDataFrame(rows, "client string, s bigint").select("client", F.timestamp_seconds("s").alias("ts"))
    schema = beat([("a", 1)]).schema
    for rows in ([("a", 100), ("a", 130), ("b", 100)], [("b", 5000)], [("b", 5001)]):
        beat(rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(R.lease_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 90, "1 minute"), tmp_path, "out")
    got = {(r["client"], r["state"], r["at"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert {("a", "held", 100_000), ("b", "held", 100_000), ("a", "expired", 220_000), ("b", "expired", 190_000), ("b", "held", 5000_000)} <= got


def test_along_imports_of_many_queries_in_blocks(spark, monkeypatch):
    """Every query reaches most chunks, so pairs of them must not be rows of a join; the result equals brute force."""
    import numpy as np

    from grainery.operators import search as S

    for name, value in (("QUERY_BLOCK", 3), ("ROW_BLOCK", 5), ("QUERY_BATCH", 4)):
        monkeypatch.setattr(S, name, value)
    rng = np.random.default_rng(6)
    v, q = rng.normal(size=(300, 3)), rng.normal(size=(9, 3))
    file = [f"f{i % 7}" for i in range(300)]
    chunks = spark.createDataFrame([(i, file[i], v[i].tolist()) for i in range(300)] + [(300, "f1", None), (301, None, [1.0, 1.0, 1.0])], "key long, file string, v array<double>").repartition(4)
    edges = spark.createDataFrame([(f"f{i}", f"f{(i + 1) % 7}") for i in range(7)], "src string, dst string")
    hits = [(a, a * 11 + b, file[a * 11 + b], 1.0 - b / 10, b + 1) for a in range(9) for b in range(2)]
    asked = spark.createDataFrame([(a, q[a].tolist()) for a in range(9)], "qid int, qv array<double>")
    found = A.along_imports(spark.createDataFrame(hits, "qid int, key long, file string, score double, rank int"), edges, chunks, asked, 2)
    got = {(r["qid"], r["key"], r["file"], round(r["score"], 9)) for r in found.where("why = 'graph'").collect()}
    want, own = set(), {(h[0], h[1]) for h in hits}
    for a in range(9):
        depth = {}
        for h in hits:
            if h[0] == a:
                for d in (1, 2):
                    f = f"f{(int(h[2][1:]) + d) % 7}"
                    depth[f] = min(d, depth.get(f, 9))
        sim = v @ q[a] / np.linalg.norm(v, axis=1) / np.linalg.norm(q[a])
        rows = [(-round(sim[i] * 0.3 ** depth[file[i]], 9), i) for i in range(300) if file[i] in depth and sim[i] >= 0.25 and (a, i) not in own]
        want |= {(a, i, file[i], -s) for s, i in sorted(rows)[:30]}
    assert got == want and len(want) > 100
    plan = A.reached(asked.withColumn("best", F.lit(1.0)), spark.createDataFrame([(1, "f1", 1)], "qid int, file string, depth long"), chunks, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
