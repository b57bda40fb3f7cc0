"""The corpus pipeline: quality classifier, quality rules, near-dedup, suffix-array dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. The first four return the columns of
documents; the last returns the pieces of packed sequences. Models are fitted on the labelled rows of the tables in
sf_dir. ORACLE_SQL is None: no SQL expresses the trained stages; tests hold each stage against its operator's
brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainery.llm import neardup, packing, quality, repeats, rules
from grainery.llm.common import crc_mod, table, written

ORACLE_SQL = None
#: Least similarity of near duplicates, in hundredths.
SIMILARITY = 80
#: Bytes of the strings that suffix_dedup cuts: passages of 50 words have 248 at the least in the given tables.
PASSAGE = 240


def _whole(docs: DataFrame) -> DataFrame:
    """doc_id and text, and the row's other columns in a struct beside them, so that no column's name can clash."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))


def _columns(whole: DataFrame, columns: list[str], **new) -> DataFrame:
    """The columns of documents again, from what _whole made, with those of `new` in place of the old ones."""
    new = {"text": F.col("text")} | new
    return whole.select(*[new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that nearest-neighbour voting holds for good ones."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return _columns(quality.classify(_whole(docs), model, carry=("text", "row")).where("predicted = 1"), docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that pass the base rules and are content for the most part."""
    weights = rules.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _columns(rules.judge(_whole(docs), weights, carry=("text", "row")).where("kept"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of every group of near duplicates: that of the least id, or of none if all ids are null.

    Rows are numbered, so that null or repeated ids link nothing. Texts without words are in no group and all stay.
    """
    rows = written(docs.select(F.monotonically_increasing_id().alias("number"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), "numbered")
    found = neardup.near_duplicates(rows.select("number", "row.text"), id="number", percent=SIMILARITY).select(F.col("doc_id").alias("number"), "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "number"))
    kept = found.join(rows.select("number", "row.doc_id"), "number").groupBy("component_id").agg(first.alias("first")).select("first.number")
    return rows.join(kept.hint("shuffle_hash"), "number", "left_semi").select("row.*")  # they grow with the input, so they are never broadcast


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated passages, strings of PASSAGE bytes, out of every text; n_chars follows the text."""
    whole = repeats.remove_repeats(_whole(docs), carry=("row",), emit_text=True, length=PASSAGE)
    return _columns(whole, docs.columns, text=F.col("kept_text"), n_chars=F.length("kept_text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into windows of tokens."""
    return packing.pack(docs)


STAGES = [("quality_classifier", quality_classifier), ("quality_rules", quality_rules), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
