"""Chunks of texts by lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW_LINES, OVERLAP = 50, 5
TINY_BYTES = 40


def lines_of(text: Column) -> Column:
    """Lines without a trailing carriage return; a final line break makes no empty line."""
    return F.split(F.regexp_replace(F.regexp_replace(text, r"\r\n", "\n"), r"\n\z", ""), "\n")


def window_chunks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk_idx, start_line, end_line, content): windows of 50 lines that overlap by 5."""
    step = WINDOW_LINES - OVERLAP
    lines = rows.select(F.col(key), lines_of(F.col(text)).alias("lines"))
    last = F.greatest(F.lit(0), F.ceil((F.size("lines") - WINDOW_LINES) / step)).cast("int")
    each = lines.select(key, "lines", F.explode(F.sequence(F.lit(0), last)).alias("chunk_idx"))
    start = F.col("chunk_idx") * step
    end = F.least(start + WINDOW_LINES, F.size("lines"))
    return each.select(key, "chunk_idx", (start + 1).alias("start_line"), end.alias("end_line"), F.array_join(F.slice("lines", start + 1, end - start), "\n").alias("content"))


def merge_tiny(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk_idx, start_line, end_line): lines as chunks; tiny ones join the chunk before, a lone tiny first one the chunk after."""
    each = rows.select(F.col(key), F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
    tiny = F.octet_length(F.trim("line")) < TINY_BYTES
    order = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    grouped = each.withColumn("g", F.sum((~tiny).cast("int")).over(order))
    merged = grouped.groupBy(key, "g").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.count("*").alias("n"))
    most = F.max("g").over(Window.partitionBy(key))
    moved = merged.withColumn("g", F.when((F.col("g") == 0) & (F.col("n") == 1) & (most >= 1), 1).otherwise(F.col("g")))
    final = moved.groupBy(key, "g").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    idx = F.row_number().over(Window.partitionBy(key).orderBy("lo")) - 1
    return final.select(key, idx.alias("chunk_idx"), (F.col("lo") + 1).alias("start_line"), (F.col("hi") + 1).alias("end_line"))


def grep(rows: DataFrame, key: str, text: str, pattern: str, ignore_case: bool = False, most: int | None = None) -> DataFrame:
    """(key, line_number, line) of the lines that match."""
    each = rows.select(F.col(key), F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
    found = each.where(F.col("line").rlike(("(?i)" if ignore_case else "") + pattern)).select(key, (F.col("pos") + 1).alias("line_number"), "line")
    return found if most is None else found.orderBy(key, "line_number").limit(most)


def exact_duplicates(rows: DataFrame, key: str, text: str, file: str) -> DataFrame:
    """(key, kept): rows whose text also stands in another file, apart from the least such key. Texts are pre-aggregated, so that many copies do not meet in one task."""
    groups = rows.groupBy(text).agg(F.min(key).alias("kept"), F.min(file).alias("f0"), F.max(file).alias("f1"), F.count("*").alias("n")).where("n > 1 AND f0 <> f1").select(text, "kept")
    return rows.join(groups, text).where(F.col(key) != F.col("kept")).select(key, "kept")
