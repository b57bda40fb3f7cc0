import json

import pytest
from pyspark.sql import functions as F

from grainery.functions import text as T
from grainery.operators import goldset as Q
from grainery.plans import metric_queries as M
from grainery.sources import files, ignore, records


def test_settings(tmp_path):
    defaults = {"index": {"lines": 50, "overlap": 5}, "name": "x"}
    path = str(tmp_path / "own.toml")
    assert records.settings(path, defaults) == defaults
    (tmp_path / "own.toml").write_text('name = "y"\nodd = 1\n[index]\nlines = 20\nmore = 2\n')
    assert records.settings(path, defaults) == {"index": {"lines": 20, "overlap": 5}, "name": "y"}
    for bad in ("name = ", 'index = "no table"', "[name]\na = 1"):
        (tmp_path / "own.toml").write_text(bad)
        with pytest.raises(ValueError):
            records.settings(path, defaults)


def test_evaluations(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"query": "where is it", "expected_files": ["a.py"], "other": 1}, {"expected_files": []}]))
    rows = records.eval_sets(spark, str(tmp_path / "a.json")).collect()
    assert [(r.query, r.expected_files, r.category) for r in rows] == [("where is it", ["a.py"], None)]
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs/good.json").write_text(json.dumps({f: 1 for f in records.RUN_FIELDS}))
    (tmp_path / "runs/bad.json").write_text(json.dumps({f: 1 for f in records.RUN_FIELDS if f not in ("tool", "cases")}))
    good, bad = records.runs(spark, str(tmp_path / "runs"))
    assert good.count() == 1 and [r.lacking for r in bad.collect()] == [["tool", "cases"]]


@pytest.mark.parametrize(
    "lines,path,folder,out",
    [
        ("*.log", "a/b.log", False, True),
        ("*.log\n!keep.log", "a/keep.log", False, False),
        ("/build", "build", True, True),
        ("/build", "x/build", True, False),
        ("build/", "x/build", True, True),
        ("build/", "x/build", False, False),
        ("a/*.txt", "a/b.txt", False, True),
        ("a/*.txt", "a/c/b.txt", False, False),
        ("a/**/b", "a/b", False, True),
        ("a/**/b", "a/x/y/b", False, True),
        ("**/gen", "p/q/gen", True, True),
        ("a/**", "a/b/c", False, True),
        ("file[0-9].py", "file7.py", False, True),
        ("file[!0-9].py", "file7.py", False, False),
        ("\\#x", "#x", False, True),
        ("# x\n\n", "x", False, False),
        ("na?e ", "d/name", False, True),
    ],
)
def test_ignore_rules(lines, path, folder, out):
    assert ignore.ignored(path, folder, ignore.rules(lines)) == out


def test_listing_heeds_ignore_files(spark, tmp_path):
    for p in ("keep.py", "out.log", "a/x.py", "a/gen/y.py", "a/b/z.log", "a/b/z.py", "b/gen/y.py", ".hidden/q.py", "skip/me.py"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("x")
    (tmp_path / ".gitignore").write_text("*.log\n/skip\n")
    (tmp_path / "a/.gitignore").write_text("gen/\n!z.log\n")
    got = lambda *e: sorted(r.path for r in files.listing(spark, str(tmp_path), *e).collect())
    assert got() == ["a/b/z.log", "a/b/z.py", "a/x.py", "b/gen/y.py", "keep.py"]
    assert got(("b/", "*.log")) == ["a/x.py", "keep.py"]


def test_line_range_and_dates(spark):
    df = spark.createDataFrame([("a\nbc\n\nd",)], "t string")
    row = df.select(*[T.line_range(F.col("t"), F.lit(a), F.lit(z)).alias(f"r{k}") for k, (a, z) in enumerate([(0, 1), (0, 3), (2, 4), (5, 7), (3, 3)])], T.rfc3339(F.lit(86399)).alias("d")).first()
    assert [tuple(row[f"r{k}"]) for k in range(5)] == [(1, 1), (1, 2), (2, 2), (3, 4), (2, 2)] and row.d == "1970-01-01T23:59:59Z"


def test_gold_regions_of_odd_json(spark):
    rows = [(1, '[{"file": "/workspace/r/a/b.py", "start_line": 1, "end_line": 2}, {"file": "x"}]'), (2, "not json"), (3, None), (4, "[]")]
    got = Q.gold_regions(spark.createDataFrame(rows, "id int, gold string"), "gold", "id").collect()
    assert [tuple(r) for r in got] == [(1, "a/b.py", 1, 2)]


def test_queries_have_sql():
    assert set(M.QUERIES) == set(M.SQL)
