import subprocess

from grainery.operators import imports as M
from grainery.sources import files, records


def test_changed_on_branch(spark, tmp_path, monkeypatch):
    def git(*words):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b.c", *words], check=True, capture_output=True)

    git("init", "-b", "trunk")
    (tmp_path / "a.py").write_text("1")
    git("add", ".")
    git("commit", "-m", "one")
    assert files.changed_on_branch(spark, str(tmp_path)).count() == 0
    git("branch", "master")
    git("checkout", "-b", "work")
    (tmp_path / "b \u00e9.py").write_text("2")
    git("add", ".")
    git("commit", "-m", "two")
    assert [r.path for r in files.changed_on_branch(spark, str(tmp_path)).collect()] == ["b \u00e9.py"]
    assert files.project_key(str(tmp_path / "." / "..") + "/" + tmp_path.name, "x") == str(tmp_path.resolve()) + "#x"
    monkeypatch.setattr(files, "PROJECT_MARKS", ("sources",))
    assert files.looks_like_project(files.__file__.rsplit("/", 2)[0]) and not files.looks_like_project("/tmp") and not files.looks_like_project("/")


def test_cached(spark, tmp_path):
    calls = []

    def fetch():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert records.cached(spark, str(tmp_path / "t"), fetch).count() == 3
    assert len(calls) == 1


def test_writer_lease(tmp_path):
    one, two = records.WriterLease(str(tmp_path)), records.WriterLease(str(tmp_path))
    assert one.status() is None
    assert one.acquire(phase="index") and one.acquire() and not two.acquire()
    assert two.status()["phase"] == "index" and one.status()["phase"] == "index"
    one.release()
    (tmp_path / "writer.json").write_text("{}")  # left by a writer that died
    assert two.status() is None and not (tmp_path / "writer.json").exists()
    assert two.acquire() and not one.acquire()
    two.release()


def test_aliases(spark):
    rows = [("a.py", "import json as j\nx = 1  # import a as b\n"), ("b.tsx", "import type { A as B } from \"./t\""), ("c.rs", "use a::{b as _, c as d};"), ("d.py", ""), ("e.py", None), ("f", "import a as b")]
    found = M.aliases(spark.createDataFrame(rows, "path string, text string")).collect()
    assert sorted(tuple(r) for r in found) == [("a.py", "j", "json", None), ("b.tsx", "B", "A", "./t"), ("c.rs", "d", "c", None)]


def test_resolve_forms_candidates_once_for_each_name(spark):
    """Every statement was multiplied by its candidates before the join with the files."""
    found = [(f"p{i}/m.py", f"a.b{' ' * (i % 3)}", "py") for i in range(300)] + [("x/a.ts", "./b", "ts"), ("y/a.ts", "./b", "ts"), ("x/a.ts", "./b", "ts")]
    rows = spark.createDataFrame(found, "file string, raw string, ext string")
    files_ = spark.createDataFrame([("src/a/b.py",), ("a/b/__init__.py",), ("x/b.ts",), ("y/b/index.ts",)], "path string")
    out = M.resolve(rows, files_)
    got = sorted(tuple(r) for r in out.collect())
    assert len(got) == 302 and {r[1] for r in got if r[0].startswith("p")} == {"a/b/__init__.py"}
    assert [r[:2] for r in got if r[0][0] in "xy"] == [("x/a.ts", "x/b.ts"), ("y/a.ts", "y/b/index.ts")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan[plan.index("Generate posexplode") :]
