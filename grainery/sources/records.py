"""Sources of settings and evaluations: a TOML file, evaluation sets, benchmark runs, a table of metadata, a cache of fetched tables; the lease of a store's writer."""

from __future__ import annotations

import fcntl
import json
import os
import tomllib
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CASES = "query string, expected_files array<string>, category string, notes string"
RUN_FIELDS = ("tool", "repo_id", "profile", "eval_set", "started_at", "duration_ms", "aggregate", "cases")


def settings(path: str, defaults: dict[str, Any]) -> dict[str, Any]:
    """Defaults overlaid by a TOML file. A missing file leaves them; a bad one is an error; keys that no default has are ignored."""
    if not os.path.exists(path):
        return defaults
    with open(path, "rb") as f:
        given = tomllib.load(f)

    def over(base: dict[str, Any], more: dict[str, Any], at: str) -> dict[str, Any]:
        out = dict(base)
        for key, value in base.items():
            if key not in more:
                continue
            if isinstance(value, dict) != isinstance(more[key], dict):
                raise ValueError(f"{path}: {at}{key} must {'' if isinstance(value, dict) else 'not '}be a table")
            out[key] = over(value, more[key], f"{at}{key}.") if isinstance(value, dict) else more[key]
        return out

    return over(defaults, given, "")


def eval_sets(spark: SparkSession, path: str) -> DataFrame:
    """(query, expected_files, category, notes, path) of JSON lists of cases."""
    rows = spark.read.schema(CASES).option("multiLine", True).json(path)
    return rows.select("*", F.col("_metadata.file_path").alias("path")).where("query IS NOT NULL")


def runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark runs of a folder of JSON files, one object each: (those with all required fields: path and run as text, the others: path and what they lack)."""
    text = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("run"))
    lacking: Column = F.array_compact(F.array(*[F.when(F.get_json_object("run", f"$.{f}").isNull(), F.lit(f)) for f in RUN_FIELDS]))
    rows = text.withColumn("lacking", lacking)
    return rows.where(F.size("lacking") == 0).drop("lacking"), rows.where(F.size("lacking") > 0).select("path", "lacking")


def latest(entries: DataFrame) -> DataFrame:
    """(key, value) of an append-only table of metadata (key, value, seq): the last value of every key; null values are removals."""
    return entries.groupBy("key").agg(F.max_by("value", "seq").alias("value")).where("value IS NOT NULL")


def incomplete(marks: DataFrame) -> DataFrame:
    """Batches that began and neither ended nor were deleted, of marks (batch, event, seq, files); events are begin, complete and delete."""
    last = marks.groupBy("batch").agg(F.max_by("event", "seq").alias("event"), F.max_by("files", F.when(F.col("event") == "begin", F.col("seq"))).alias("files"))
    return last.where("event = 'begin'").select("batch", "files")


def cached(spark: SparkSession, path: str, fetch: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, which is fetched and written there if no complete one is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(spark._jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")):
        fetch().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class WriterLease:
    """The one writer of a store: an exclusive lock on its lease file, and a status file beside it while the lease is held.

    A status without a lock is of a writer that died: `status` removes it and gives None.
    """

    def __init__(self, folder: str):
        os.makedirs(folder, exist_ok=True)
        self.lock_path, self.status_path = (os.path.join(folder, n) for n in ("writer.lock", "writer.json"))
        self._held = None

    def acquire(self, **status: Any) -> bool:
        """Whether the lease is ours now; another holder's lease is left alone."""
        if self._held:
            return True
        handle = open(self.lock_path, "a")
        try:
            fcntl.flock(handle, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            handle.close()
            return False
        self._held = handle
        fresh = f"{self.status_path}.{os.getpid()}"
        with open(fresh, "w") as f:
            json.dump({"pid": os.getpid(), **status}, f)
        os.replace(fresh, self.status_path)
        return True

    def release(self) -> None:
        if self._held:
            if os.path.exists(self.status_path):
                os.remove(self.status_path)
            self._held.close()
            self._held = None

    def status(self) -> dict[str, Any] | None:
        """What the present writer said of itself, or None."""
        if not self._held:
            with open(self.lock_path, "a") as probe:
                try:
                    fcntl.flock(probe, fcntl.LOCK_EX | fcntl.LOCK_NB)
                except BlockingIOError:
                    pass
                else:
                    if os.path.exists(self.status_path):
                        os.remove(self.status_path)
                    return None
        if not os.path.exists(self.status_path):
            return None
        with open(self.status_path) as f:
            return json.load(f)
