import pytest
from pyspark.sql import functions as F

from grainery.engine import Engine
from grainery.functions import text as T
from grainery.operators import goldset, imports, symbols
from grainery.streaming import events

FILES = {
    "src/lib.rs": "mod util;\nuse crate::util::helper;\n\npub fn add(a: i32) -> i32 {\n    helper(a)\n}\n\npub struct Registry {\n    n: i32,\n}\n",
    "src/util.rs": "pub fn helper(a: i32) -> i32 {\n    a\n}\n",
    "src/net/mod.rs": "use super::util::helper;\nuse crate::{a, b};\nfn run() {\n    helper(1);\n}\n",
    "app/main.py": "import app.core.parse\nfrom app.tools import x\n\nclass Walk:\n    def step(self):\n        return parse_all(1)\n\n    def stop(self):\n        pass\n\ndef parse_all(n):\n    return n\n",
    "app/core/parse.py": "def parse_tokens(text):\n    return text\n",
    "app/tools/__init__.py": "x = 1\n",
    "app/tests/test_parse.py": "import app.core.parse\n\ndef test_it():\n    pass\n",
    "web/a.ts": "import { b } from './lib/b.js'\nimport c from '../app'\nimport d from './lib'\n",
    "web/lib/b.ts": "export function retry(n) {\n  return n\n}\n",
    "web/lib/index.ts": "export const d = 1\n",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in FILES.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return root


@pytest.fixture(scope="module")
def engine(spark, tree, tmp_path_factory):
    e = Engine(spark, str(tree), str(tmp_path_factory.mktemp("store")))
    e.index()
    return e


def test_import_paths(spark):
    cases = [
        ("pub(crate) use a::b::*;", "rs", "a::b"), ("use crate::{a, b};", "rs", None), ("import static a.b.C;", "java", "a.b.C"), ("# include <x/y.h>", "h", "x/y.h"),
        ('#include "z.h"', "cpp", "z.h"), ("use A\\B;", "php", "A\\B"), ("using static System.Math;", "cs", "System.Math"), ("import UIKit", "swift", "UIKit"), (" x.y ", "py", "x.y"), ("  ", "py", None), ("int x", "c", None),
    ]
    got = spark.createDataFrame([(i, r, e) for i, (r, e, _) in enumerate(cases)], "i int, raw string, ext string").select("i", imports.import_path(F.col("raw"), F.col("ext"))).collect()
    assert [v for _, v in sorted(got)] == [want for *_, want in cases]


def test_edges(engine):
    got = {tuple(r) for r in engine.table("edges").select("src", "dst").collect()}
    assert got == {
        ("src/lib.rs", "src/util.rs"), ("src/net/mod.rs", "src/util.rs"), ("app/main.py", "app/core/parse.py"), ("app/main.py", "app/tools/__init__.py"),
        ("app/tests/test_parse.py", "app/core/parse.py"), ("web/a.ts", "web/lib/b.ts"), ("web/a.ts", "web/lib/index.ts"),
    }


def test_go_packages(spark):
    paths = spark.createDataFrame([("pkg/a/y.go",), ("pkg/a/x.go",), ("pkg/a/deep/a.go",)], "path string")
    found = spark.createDataFrame([("main.go", "ex.org/m/pkg/a", "go"), ("main.go", "fmt", "go"), ("main.go", "ex.org/m", "go")], "file string, raw string, ext string")
    assert [tuple(r) for r in imports.resolve(found, paths, "ex.org/m").collect()] == [("main.go", "pkg/a/x.go", "ex.org/m/pkg/a")]


def test_symbols(engine):
    got = {tuple(r) for r in engine.table("symbols").where("file LIKE 'app/main%' OR file = 'src/lib.rs'").select("name", "kind", "start", "end").collect()}
    assert got == {("Walk", "class", 4, 10), ("step", "function", 5, 7), ("stop", "function", 8, 10), ("parse_all", "function", 11, 13), ("add", "function", 4, 7), ("Registry", "struct", 8, 11)}
    info = {tuple(r) for r in engine.get_symbol_info("helper").collect()}
    assert info == {("definition", "src/util.rs", 1, "helper"), ("caller", "src/lib.rs", 5, "add"), ("caller", "src/net/mod.rs", 4, "run")}
    assert engine.find_symbol("helper", "struct").count() == 0


def test_search_and_structure(engine):
    best = engine.search("how does parse tokens work", 3).collect()
    assert best[0]["file"] == "app/core/parse.py" and best[0]["match_quality"] == "high"
    assert {r["file"] for r in engine.search("parse tokens", 5, scope="web", legs=("fts",)).collect()} == set()
    assert {r["file"].split("/")[0] for r in engine.search("parse tokens", 5, scope="app").collect()} == {"app"}
    assert [(r["file"], r["line_number"]) for r in engine.grep("struct Reg").collect()] == [("src/lib.rs", 8)]
    assert engine.smart_search("retry").first()["file"] == "web/lib/b.ts"
    assert {(r["file"], r["kind"]) for r in engine.find_dependents("src/util.rs").collect()} == {("src/lib.rs", "direct"), ("src/net/mod.rs", "direct")}
    assert {tuple(r) for r in engine.find_tests("app/core/parse.py").collect()} == {("app/tests/test_parse.py", "importer")}
    assert {tuple(r) for r in engine.context("src/util.rs").collect()} == {("imported_by", "src/lib.rs"), ("imported_by", "src/net/mod.rs")}
    assert [r["via"] for r in engine.smart_search("add -> helper", "trace").collect()] == [None]
    text = engine.get_repo_map()
    assert "src/\n  lib.rs [" in text and "add, Registry" in text and len(engine.get_repo_map(10)) <= 40
    cases = engine.spark.createDataFrame([(1, "parse tokens", ["app/core/parse.py"]), (2, "nothing at all here", ["src/lib.rs"])], "qid int, query string, expected_files array<string>")
    assert {r["qid"]: r["recall"] for r in engine.evaluate(cases).collect()} == {1: 1.0, 2: 0.0}
    with pytest.raises(ValueError):
        engine.smart_search("x", "guess")


def test_search_steps(spark, engine):
    base = engine.search("add helper", 3, legs=("fts",), depth=0, cochange_boost=0).collect()
    grown = engine.search("add helper", 3, legs=("fts",), depth=2).collect()
    assert {r["file"] for r in base} <= {r["file"] for r in grown} and {r["why"] for r in base} == {"fts"}
    files = {r["file"] for r in engine.search("parse tokens", 4, sparse_weight=0.2, diversity=0.4, reranker="overlap").collect()}
    assert "app/core/parse.py" in files
    few = engine.search("parse tokens", 4, changed=spark.createDataFrame([("core/parse.py",)], "path string")).collect()
    assert {r["file"] for r in few} == {"app/core/parse.py"}
    assert engine.search("parse tokens", 4, max_tokens=1).count() == 1
    assert engine.search("", 4).count() == 0
    for wrong in ({"legs": ("x",)}, {"legs": ()}, {"reranker": "x"}):
        with pytest.raises(ValueError):
            engine.search("parse", **wrong)


def test_trace(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("d", "c")], "src string, dst string")
    assert [r.via for r in symbols.call_trace(edges, "a", "c").collect()] == ["b", "d"]
    assert [r.via for r in symbols.call_trace(edges, "c", "a").collect()] == []


def test_reindex(spark, engine, tree):
    assert engine.status().first().asDict() == {"files": 10, "chunks": 10, "symbols": engine.table("symbols").count(), "edges": 7, "stale": 0, "state": "fresh"}
    (tree / "src/net/mod.rs").unlink()
    (tree / "app/more.py").write_text("def later():\n    pass\n")
    assert engine.status().first()["stale"] == 2
    engine.index()
    assert engine.status().first()["state"] == "fresh"
    assert engine.symbol("later").count() == 1 and engine.symbol("run").count() == 0 and engine.table("edges").count() == 6
    assert len(engine.gc()) == 1 and engine.symbol("later").count() == 1
    engine.clear()
    assert engine.status().first()["state"] == "empty"


def test_gold_columns(spark):
    one = lambda f, *rows: [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string").orderBy("i").select(f(F.col("s"))).collect()]
    assert one(goldset.renamed, "src/{foo => bar}/f.rs", "old/p => new/p", "a/{ => b}/c", "a/{b => }/c", "plain") == ["src/bar/f.rs", "new/p", "a/b/c", "a/c", "plain"]
    assert [r and tuple(r) for r in one(goldset.hunk_lines, "@@ -1,2 +10,3 @@ fn", "@@ -1 +7 @@", "@@ -1,2 +3,0 @@", "x")] == [(10, 12), (7, 7), None, None]
    assert one(goldset.subject_query, "fix(parser)!: handle empty  input (#12).", "update", "feat: add it") == ["handle empty input", None, None]
    assert one(goldset.patched_files, "diff --git a/x.py b/y.py\n--- a\ndiff --git a/b.c b/a.c\n") == [["a.c", "y.py"]]
    commits = spark.createDataFrame([(1, "fix: handle empty input well"), (2, "bump version of things"), (3, "add support for many files")], "commit int, subject string")
    touched = spark.createDataFrame([(1, "a.py", 1), (1, "tests/a.py", 3), (1, "b.py", 0), *[(3, f"f{i}.py", 1) for i in range(21)]], "commit int, path string, added int")
    assert [tuple(r) for r in goldset.cases(commits, touched).collect()] == [(1, "handle empty input well", ["a.py"], "keyword_code", "low")]


def test_issue_query(spark):
    block = "```\nx = hidden(1)\n```"
    many = "\n".join(["word " * 30 + f"line{i}" for i in range(5)])
    cases = [
        (f"# Title\nThe `parse_all` call fails in src/a.py:12\n{block}\n- [x] I agree\nSteps to reproduce: none\nhttps://x.org", "The `parse_all` call fails in src/a.py:12"),
        ("", ""),
        ("see `a b`\nand `a b`", "see `a b` and `a b`"),
        (many + "\nuse `retry` in lib/net.rs", " ".join(("word " * 30 + f"line{i}") for i in range(3)) + " retry lib/net.rs"),
        ("open ``` in the middle\n```rust\nkept?\n", "open ``` in the middle"),
        ("word " * 101, "word " * 101),
    ]
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").select("i", T.issue_query(F.col("t")))
    assert [v for _, v in sorted(rows.collect())] == [w for _, w in cases]


def test_lease_stream(spark, tmp_path):
    beats = spark.createDataFrame([("a", 0), ("a", 60), ("a", 151), ("b", 10), ("b", 190), ("b", 100), ("b", 5000)], "client string, s int").select("client", F.timestamp_seconds("s").alias("ts"))
    want = {("a", 0, 150, 2), ("a", 151, 241, 1), ("b", 10, 280, 3), ("b", 5000, 5090, 1)}
    assert {(r.client, int(r.start.timestamp()), int(r.expires.timestamp()), r.beats) for r in events.leases(beats, "client").collect()} == want
    beats.coalesce(1).write.parquet(f"{tmp_path}/in")
    held = events.leases(spark.readStream.schema(beats.schema).parquet(f"{tmp_path}/in"), "client")
    held.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    out = {(r.client, int(r.start.timestamp())) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert out == {("a", 0), ("a", 151), ("b", 10)}  # the last lease is open until a later beat moves the watermark
