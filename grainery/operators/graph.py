"""Directed graphs over files as edge tables (src, dst): neighbours, bounded traversal, PageRank, roles."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainery.functions.text import role


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keeps the cluster's checkpoint folder; a temporary one is set only where there is none (tests)."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            where = tempfile.mkdtemp(prefix="grainery-graph-")
            atexit.register(shutil.rmtree, where, ignore_errors=True)
        context.setCheckpointDir(where)


def dedup_edges(edges: DataFrame) -> DataFrame:
    return edges.dropDuplicates(["src", "dst", "label"]) if "label" in edges.columns else edges.dropDuplicates(["src", "dst"])


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, neighbour, direction) of the given nodes (column node)."""
    out = edges.join(nodes, edges["src"] == nodes["node"], "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("neighbour"), F.lit("imports").alias("direction"))
    back = edges.join(nodes, edges["dst"] == nodes["node"], "left_semi").select(F.col("dst").alias("node"), F.col("src").alias("neighbour"), F.lit("importers").alias("direction"))
    return out.unionByName(back)


def traverse(edges: DataFrame, seeds: DataFrame, depth: int, reverse: bool = False) -> DataFrame:
    """(seed, node, depth): every node within `depth` edges of a seed (column seed), at its least depth; the seed itself left out.

    A join and an anti-join a level: nodes reached once are not walked again, so cycles end.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    step = edges.select(F.col("dst").alias("here"), F.col("src").alias("there")) if reverse else edges.select(F.col("src").alias("here"), F.col("dst").alias("there"))
    step = step.distinct()
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).cast("long").alias("depth")).distinct()
    front = seen
    for level in range(1, depth + 1):
        reached = front.join(step, front["node"] == step["here"]).select("seed", F.col("there").alias("node")).distinct()
        front = reached.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(level).cast("long"))
        if level > 1 and level % 3 == 0:
            front, seen = front.checkpoint(), seen.checkpoint()
        seen = seen.unionByName(front)
    return seen.where("depth > 0")


def pagerank(edges: DataFrame, rounds: int = 100, damping: float = 0.85) -> DataFrame:
    """(node, score), summing to 1. A node gets d * r / out from every node that links to it, an equal share of d * r from nodes without
    links, and an equal share of (1 - d) * r from nodes that do not link to it; parallel labels count in `out` alone.

    Each round reads the ranks several times, so every round ends in a checkpoint; the links are one too.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    out = edges.groupBy("src").agg(F.count("*").alias("out"))
    links = edges.select("src", "dst").distinct().join(out, "src").checkpoint()
    nodes = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct().join(out.withColumnRenamed("src", "node"), "node", "left")
    n = nodes.count()
    r = nodes.select("node", "out", F.lit(1.0 / max(1, n)).alias("r")).checkpoint()
    for _ in range(rounds):
        given = links.join(r.select(F.col("node").alias("src"), "r"), "src").groupBy("dst").agg(F.sum(damping * F.col("r") / F.col("out") - (1 - damping) * F.col("r") / n).alias("got"))
        base = r.agg(F.sum(F.when(F.col("out").isNull(), damping * F.col("r")).otherwise((1 - damping) * F.col("r"))).alias("base"))
        new = r.join(given, r["node"] == given["dst"], "left").join(F.broadcast(base)).select("node", "out", (F.coalesce("got", F.lit(0.0)) + F.col("base") / n).alias("r"))
        new = new.checkpoint()
        total = new.agg(F.sum("r")).first()[0] or 1.0
        r = new.select("node", "out", (F.col("r") / F.lit(total)).alias("r"))
    return r.select("node", F.col("r").alias("score"))


def roles(edges: DataFrame) -> DataFrame:
    incoming = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("incoming"))
    outgoing = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outgoing"))
    both = incoming.join(outgoing, "node", "full").select("node", F.coalesce("incoming", F.lit(0)).alias("incoming"), F.coalesce("outgoing", F.lit(0)).alias("outgoing"))
    return both.withColumn("role", role(F.col("incoming"), F.col("outgoing")))


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 3) -> DataFrame:
    """Importers up to `depth` (5 at most): direct at depth 1, transitive beyond."""
    return traverse(edges, seeds, min(depth, 5), reverse=True).withColumn("kind", F.when(F.col("depth") == 1, "direct").otherwise("transitive"))


def rank_boost(hits: DataFrame, ranks: DataFrame, factor: float = 0.3) -> DataFrame:
    """Scores times 1 + factor * ln(1 + rank / median), by the upper median of the positive ranks of the hits."""
    joined = hits.join(ranks.select(F.col("node").alias("key"), F.col("score").alias("pr")), "key", "left")
    positive = F.sort_array(F.collect_list(F.when(F.col("pr") > 0, F.col("pr"))))
    median = joined.groupBy("qid").agg(positive.alias("all")).select("qid", F.when(F.size("all") > 0, F.element_at("all", (F.size("all") / 2).cast("int") + 1)).alias("median"))
    boosted = joined.join(median, "qid", "left")
    return boosted.withColumn("score", F.col("score") * F.coalesce(1 + factor * F.log(1 + F.col("pr") / F.col("median")), F.lit(1.0))).drop("pr", "median")
