import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from grainery.operators import store
from grainery.plans import registry
from grainery.sources import files
from grainery.streaming import events

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.execute(registry.SQL[name])
    names = [c[0] for c in result.description]
    assert sorted(names) == columns
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=repr)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_generations(spark, tmp_path):
    store.publish(spark.range(3), str(tmp_path))
    store.publish(spark.range(5), str(tmp_path))
    assert store.current(spark, str(tmp_path)).count() == 5


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x = 1\n")
    (tmp_path / "src" / "b.bin").write_text("no")
    (tmp_path / "Makefile").write_bytes(b"a\0b")
    assert [(r.path, r.language, r.text) for r in files.tree(spark, str(tmp_path)).collect()] == [("src/a.py", "python", "x = 1\n")]
    lines = spark.createDataFrame(list(enumerate(["a" * 40, "", "f.py", "g.py", "b" * 40, "f.py"])), "n int, line string")
    assert [(r.commit[0], r.file) for r in files.commit_log(lines).orderBy("seq").collect()] == [("a", "f.py"), ("a", "g.py"), ("b", "f.py")]


def test_stream(spark, tmp_path):
    table = spark.read.parquet(f"{SF}/events.parquet")
    table.write.parquet(f"{tmp_path}/in")
    seen = []
    events.incremental(events.read_events(spark, f"{tmp_path}/in", table.schema), lambda df, k: seen.append(df.count()), f"{tmp_path}/cp").awaitTermination()
    assert sum(seen) == table.count()
    assert events.debounced(table.withColumn("ts", table["ts"].cast("timestamp")), "user_id").count() > 0
