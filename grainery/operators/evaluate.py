"""Retrieval metrics over (qid, item, rank) results and (qid, item) expectations, and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metrics(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Per query recall@k, precision@k, reciprocal rank and whether all expected items are in the first k."""
    want = expected.groupBy("qid").agg(F.count("*").alias("want"))
    marked = results.where(F.col("rank") <= k).join(expected.select("qid", "item", F.lit(1).alias("ok")), ["qid", "item"], "left")
    got = marked.groupBy("qid").agg(F.count("*").alias("returned"), F.count("ok").alias("found"), F.max(F.when(F.col("ok") == 1, 1 / F.col("rank"))).alias("rr"))
    j = want.join(got, "qid", "full")
    found = F.coalesce("found", F.lit(0))
    return j.select(
        "qid",
        F.when(F.coalesce("want", F.lit(0)) == 0, 1.0).otherwise(found / F.col("want")).alias("recall"),
        F.when(F.coalesce("returned", F.lit(0)) == 0, 0.0).otherwise(found / F.col("returned")).alias("precision"),
        F.coalesce("rr", F.lit(0.0)).alias("rr"),
        (found == F.coalesce("want", F.lit(0))).alias("all_found"),
    )


def ndcg(results: DataFrame, expected: DataFrame, k: int = 10) -> DataFrame:
    """Per query the gain sum(1 / log2(rank + 1)) of found items over the best possible."""
    gain = results.where(F.col("rank") <= k).join(expected, ["qid", "item"], "left_semi").groupBy("qid").agg(F.sum(1 / F.log2(F.col("rank") + 1)).alias("gain"))
    best = expected.groupBy("qid").agg(F.least(F.count("*"), F.lit(k)).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.col("n").cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return best.join(gain, "qid", "left").select("qid", (F.coalesce("gain", F.lit(0.0)) / ideal).alias("ndcg"))


def f1(expected: DataFrame, predicted: DataFrame, by: str, item: list[str]) -> DataFrame:
    """Precision, recall and F1 of two sets of items per group."""
    a = expected.select(by, *item).distinct().withColumn("e", F.lit(1))
    b = predicted.select(by, *item).distinct().withColumn("p", F.lit(1))
    n = a.join(b, [by, *item], "full").groupBy(by).agg(F.count("e").alias("e"), F.count("p").alias("p"), F.count(F.when(F.col("e").isNotNull() & F.col("p").isNotNull(), 1)).alias("both"))
    precision, recall = F.when(F.col("p") > 0, F.col("both") / F.col("p")).otherwise(0.0), F.when(F.col("e") > 0, F.col("both") / F.col("e")).otherwise(0.0)
    return n.select(by, precision.alias("precision"), recall.alias("recall")).withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """Two runs by query: improved, regressed, unchanged (by reciprocal rank, then recall), added or removed."""
    a = before.select("qid", F.col("rr").alias("rr_a"), F.col("recall").alias("recall_a"))
    b = after.select("qid", F.col("rr").alias("rr_b"), F.col("recall").alias("recall_b"))
    d, e = F.col("rr_b") - F.col("rr_a"), F.col("recall_b") - F.col("recall_a")
    kind = F.when(F.col("rr_a").isNull(), "added").when(F.col("rr_b").isNull(), "removed").when(d > 1e-9, "improved").when(d < -1e-9, "regressed").when(e > 1e-9, "improved").when(e < -1e-9, "regressed").otherwise("unchanged")
    return a.join(b, "qid", "full").select("qid", kind.alias("verdict"), F.round(d, 6).alias("rr_delta"))


def strict_accuracy(results: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """(qid, accurate): 1 if all gold items (qid, item) are among a query's first k results (qid, item, rank), else 0. Queries without gold are left out."""
    missed = gold.distinct().join(results.where(F.col("rank") <= k), ["qid", "item"], "left_anti").select("qid").distinct().withColumn("missed", F.lit(1))
    return gold.select("qid").distinct().join(missed, "qid", "left").select("qid", F.when(F.col("missed").isNull(), 1.0).otherwise(0.0).alias("accurate"))


def sweep_summary(runs: DataFrame, tag: str, recall: str, *others: str) -> DataFrame:
    """Means per tag over the runs that found something (recall above 0)."""
    return runs.where(F.col(recall) > 0).groupBy(tag).agg(F.count("*").alias("runs"), *[F.avg(c).alias(c) for c in (recall, *others)])
