"""Interval joins on a shared file: overlap, containment, point lookups and as-of, each an equi-join on the file with a residual."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def symbol_overlap(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Chunks (file, idx, first, last) with the names of the symbols (file, name, start, end) that share a line with them."""
    pairs = chunks.join(symbols, "file").where("start <= last AND end >= first")
    return pairs.groupBy("file", "idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "name"))), lambda s: s["name"]), " ").alias("names"), F.count("*").alias("n"))


def scope_chain(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """The symbols that enclose a chunk whole, widest first."""
    pairs = chunks.join(symbols, "file").where("start <= first AND end >= last")
    order = F.sort_array(F.collect_list(F.struct((F.col("start") - F.col("end")).alias("width"), "start", "name")))
    return pairs.groupBy("file", "idx").agg(F.array_join(F.transform(order, lambda s: s["name"]), " > ").alias("scope"))


def _by_file(rows: DataFrame, gathered, name: str) -> DataFrame:
    """A row for each file with a list of what it holds. Rows are dealt by file first, so that lists are not begun on whole parts of the input."""
    return rows.repartition("file").groupBy("file").agg(gathered.alias(name))


def enclosing_symbol(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """For calls (file, line): the narrowest symbol around the line, else the last that starts before it.

    A file's lines meet the list of its symbols, so that pairs of both are never rows that are sorted.
    """
    lists = _by_file(symbols.where("file IS NOT NULL AND start IS NOT NULL"), F.collect_list(F.struct("start", "end", "name")), "symbols")
    lines = _by_file(calls.where("file IS NOT NULL AND line IS NOT NULL"), F.collect_set("line"), "lines")
    each = lines.join(lists, "file").select("file", "symbols", F.explode("lines").alias("line"))

    def order(s):
        inside = s["end"] >= F.col("line")
        return F.struct(F.when(inside, 0).otherwise(1).alias("kind"), F.when(inside, s["end"] - s["start"]).otherwise(-s["start"]).alias("by"), s["name"].alias("name"))

    best = F.array_min(F.transform(F.filter("symbols", lambda s: s["start"] <= F.col("line")), order))
    return each.select("file", "line", best.alias("b")).where("b IS NOT NULL").select("file", "line", F.col("b.name").alias("name"), (F.col("b.kind") == 0).alias("encloses"))


def chunk_of_symbol(symbols: DataFrame, chunks: DataFrame) -> DataFrame:
    """The first chunk that holds a symbol's first line. A file's symbols meet the list of its chunks."""
    lists = _by_file(chunks.where("file IS NOT NULL"), F.collect_list(F.struct("idx", "first", "last")), "chunks")
    named = _by_file(symbols.where("file IS NOT NULL AND start IS NOT NULL"), F.collect_set(F.struct("name", "start")), "symbols")
    each = named.join(lists, "file").select("file", "chunks", F.explode("symbols").alias("s")).select("file", "s.name", "s.start", "chunks")
    around = F.filter("chunks", lambda c: (c["first"] <= F.col("start")) & (F.col("start") <= c["last"]))
    return each.where(F.exists("chunks", lambda c: (c["first"] <= F.col("start")) & (F.col("start") <= c["last"]))).select("file", "name", "start", F.array_min(F.transform(around, lambda c: c["idx"])).alias("idx"))


def resolve_calls(calls: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Calls (file, callee) resolved in the same file (1.0), an imported file that has the symbol (1.0), any file (0.7, 0.5 or 0.3 by
    how near its directory is), or not at all (0). imports: (file, target). symbols: (file, dir, parent, name)."""
    calls = calls.distinct()
    own = symbols.select("file", F.col("name").alias("callee"), F.col("file").alias("own")).distinct()
    via = imports.join(symbols.select(F.col("file").alias("target"), F.col("name").alias("callee")).distinct(), "target").groupBy("file", "callee").agg(F.min("target").alias("via"))
    first = symbols.groupBy(F.col("name").alias("callee")).agg(F.min(F.struct("file", "dir", "parent")).alias("g"))
    places = symbols.select("file", F.col("dir").alias("my_dir"), F.col("parent").alias("my_parent")).distinct()
    j = calls.join(own, ["file", "callee"], "left").join(via, ["file", "callee"], "left").join(first, "callee", "left").join(places, "file", "left")
    near = F.when(F.col("g").isNull(), 0.0).when(F.col("g.dir") == F.col("my_dir"), 0.7).when(F.col("g.parent") == F.col("my_parent"), 0.5).otherwise(0.3)
    return j.select("file", "callee", F.coalesce("own", "via", "g.file").alias("target"), F.when(F.col("own").isNotNull() | F.col("via").isNotNull(), 1.0).otherwise(near).alias("confidence"))
