"""Tables of an index: upserts, deletes, change detection, caches and generations, all as joins that write new data."""

from __future__ import annotations

import json
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not in the new ones, and the new ones (the last of equal keys is undefined; give distinct keys)."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def delete_where_in(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def changed(scan: DataFrame, manifest: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """Scanned files (path, mtime, size) that the manifest does not have with the same time and size, and those forced."""
    new = scan.join(manifest.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")
    return new if forced is None else new.unionByName(scan.join(forced.select("path"), "path", "left_semi")).distinct()


def stale(scan: DataFrame, manifest: DataFrame) -> DataFrame:
    """(stale): files of the manifest that changed or are missing."""
    j = manifest.select("path", F.col("mtime").alias("then")).join(scan.select("path", F.col("mtime").alias("now")), "path", "left")
    return j.agg(F.count_if(F.col("now").isNull() | (F.col("now") != F.col("then"))).alias("stale"))


def vanished(scan: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.join(scan.select("path"), "path", "left_anti").select("path")


def cache_lookup(rows: DataFrame, cache: DataFrame, dim: int) -> DataFrame:
    """rows (hash, ...) with `hit`: whether the cache has a vector of this length for the hash."""
    good = cache.where(F.col("dim") == dim).select("hash", F.lit(True).alias("found")).distinct()
    return rows.join(good, "hash", "left").withColumn("hit", F.coalesce("found", F.lit(False))).drop("found")


def ordered_fetch(keys: DataFrame, table: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """The vectors of keys (pos, key) in their order; zeros where the table has none."""
    zero = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return keys.join(table.select(F.col(key).alias("key"), F.col(vector).alias("v")), "key", "left").select("pos", "key", F.coalesce("v", zero).alias("v"))


def publish(df: DataFrame, root: str) -> str:
    """Writes a generation beside the others and then points to it; a reader sees the old or the new one whole. root: a folder of this machine."""
    return publish_all({"": df}, root)


def publish_all(tables: dict[str, DataFrame], root: str) -> str:
    """The same for several tables at once; a generation that fails is taken away and the one before stays."""
    name = f"gen-{uuid.uuid4().hex}"
    try:
        for table, df in tables.items():
            df.write.parquet(os.path.join(root, name, table).rstrip("/"))
    except BaseException:
        shutil.rmtree(os.path.join(root, name), ignore_errors=True)
        raise
    staged = f"{root}/.current-{name}"
    with open(staged, "w") as f:
        json.dump({"generation": name}, f)
    os.replace(staged, f"{root}/CURRENT")
    return name


def current(spark: SparkSession, root: str, table: str = "") -> DataFrame:
    with open(f"{root}/CURRENT") as f:
        return spark.read.parquet(os.path.join(root, json.load(f)["generation"], table).rstrip("/"))
