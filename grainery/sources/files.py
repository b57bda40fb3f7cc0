"""Sources: source trees and commit logs as tables."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainery.functions.text import is_indexed_path, language
from grainery.sources.ignore import Rule, ignored, rules


LISTED = "path string, mtime timestamp, size bigint"


#: Files of ignore rules, later ones first to decide.
IGNORE_FILES = (".gitignore", ".ignore")


def _own_rules(root: str, folder: str) -> list[Rule]:
    found = []
    for name in IGNORE_FILES:
        path = os.path.join(root, folder, name)
        if os.path.isfile(path):
            with open(path, encoding="utf-8", errors="replace") as f:
                found += rules(f.read(), folder)
    return found


def listing(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(path, mtime, size) of all files below a folder that every executor sees, apart from names that begin with a point and what the
    ignore files of a folder or its parents leave out. exclude: patterns of the same kind, which nothing takes back in.

    The driver lists the first level only; each folder of it is walked by a task.
    """
    top_rules, barred = _own_rules(root, ""), rules(exclude)

    def out(path: str, folder: bool, some: list[Rule]) -> bool:
        return path.rsplit("/", 1)[-1].startswith(".") or ignored(path, folder, some) or ignored(path, folder, barred)

    tops = sorted(e.name for e in os.scandir(root) if e.is_dir(follow_symlinks=False) and not out(e.name, True, top_rules))
    seeds = spark.createDataFrame([("",), *[(t,) for t in tops]], "top string").repartition(max(1, min(len(tops) + 1, 4 * spark.sparkContext.defaultParallelism)))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top in batch.column("top").to_pylist():
                held = {"": top_rules}
                for folder, folders, names in os.walk(os.path.join(root, top)):
                    at = os.path.relpath(folder, root)
                    at = "" if at == "." else at
                    some = held.get(at) or (held.get(os.path.dirname(at), top_rules) + _own_rules(root, at))
                    held[at] = some
                    full = lambda n, at=at: f"{at}/{n}" if at else n
                    folders[:] = sorted(f for f in folders if not out(full(f), True, some)) if top else []
                    paths = [full(n) for n in sorted(names) if not out(full(n), False, some)]
                    rows = [(p, os.stat(os.path.join(root, p))) for p in paths if os.path.isfile(os.path.join(root, p))]
                    columns = [[r for r, _ in rows], [s.st_mtime_ns // 1000 for _, s in rows], [s.st_size for _, s in rows]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.timestamp("us", "UTC"), pa.int64()), strict=True)], ["path", "mtime", "size"])

    return seeds.mapInArrow(walk, LISTED)


def read_texts(rows: DataFrame, root: str) -> DataFrame:
    """rows (path, mtime, size) with their texts, lossily decoded; files with a zero byte among their first 8192 are left out, as are those that have gone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    with open(os.path.join(root, row["path"]), "rb") as f:
                        data = f.read()
                except FileNotFoundError:
                    continue
                if b"\0" not in data[:8192]:
                    yield pa.RecordBatch.from_pylist([{**row, "text": data.decode("utf-8", "replace")}], pa.schema([*batch.schema, pa.field("text", pa.string())]))

    return rows.select("path", "mtime", "size").mapInArrow(read, LISTED + ", text string")


def tree(spark: SparkSession, root: str, all_files: bool = False) -> DataFrame:
    """(path, mtime, size, language, text) of the text files below a folder that are indexed.

    Folders behind a URI scheme are read by the engine's own file source, which leaves out names that begin with `_`.
    """
    if "://" in root:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        path = F.substring_index("path", root.rstrip("/") + "/", -1)
        rows = files.select(path.alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")
        rows = rows.where(~F.hex(F.substring("content", 1, 8192)).rlike("^(..)*?00")).select("path", "mtime", "size", F.make_valid_utf8("content").alias("text"))
        kept = rows if all_files else rows.where(is_indexed_path(F.col("path")))
    else:
        rows = listing(spark, root)
        kept = read_texts(rows if all_files else rows.where(is_indexed_path(F.col("path"))), root)
    return kept.select("path", "mtime", "size", language(F.col("path")).alias("language"), "text")


def commit_log(lines: DataFrame) -> DataFrame:
    """(commit, file, seq) of numbered lines (n, line) of a log that names a commit and then its files. One log is one ordered stream."""
    sha = F.when(F.col("line").rlike("^[0-9a-f]{40}$"), F.col("line"))
    commit = F.last(sha, ignorenulls=True).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0))
    return lines.select("n", "line", commit.alias("commit")).where("line <> '' AND commit IS NOT NULL AND line <> commit").select("commit", F.col("line").alias("file"), F.col("n").alias("seq"))


# The entries that mark the root of a project.
PROJECT_MARKS = (".git", ".grainery.toml", "Cargo.toml", "package.json", "go.mod", "pyproject.toml", "setup.py", "pom.xml", "build.gradle", "CMakeLists.txt", "Makefile", "requirements.txt", ".hg", ".svn")


def looks_like_project(folder: str) -> bool:
    """Whether a folder holds a mark of a project; the root of the file system and temporary folders never count."""
    if folder == "/" or folder.startswith(("/tmp", "/var/tmp")):
        return False
    return any(os.path.exists(os.path.join(folder, mark)) for mark in PROJECT_MARKS)


def project_key(root: str, name: str | None = None) -> str:
    """One stable string per source tree: its real path, and a logical name where one tree holds several projects."""
    return os.path.realpath(root) + (f"#{name}" if name else "")


def changed_on_branch(spark: SparkSession, root: str) -> DataFrame:
    """(path): what the branch of a checkout changed since it left main, or else master; empty where there is neither, or nothing in common."""

    def git(*words: str) -> str | None:
        done = subprocess.run(["git", "-C", root, *words], capture_output=True, text=True, check=False)
        return done.stdout.strip() if done.returncode == 0 else None

    main = next((b for b in ("main", "master") if git("rev-parse", "--verify", "--quiet", f"refs/heads/{b}") is not None), None)
    base = git("merge-base", "HEAD", main) if main else None
    listed = git("-c", "core.quotePath=false", "diff", "--name-only", f"{base}...HEAD") if base else None
    return spark.createDataFrame([(p,) for p in (listed or "").splitlines() if p], "path string")
