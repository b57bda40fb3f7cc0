"""Chat formatting by prefix-target expansion, in SQL functions only.

Every assistant turn becomes an example of its own: all turns before it are context and only its reply is trainable.
Turns after the last reply (or all turns, if there is none) form one more example without a trainable part, so that
the output holds every turn. A conversation is one row while it is formatted, so it must fit into a row.

The template writes a turn as <|im_start|> role <|im_sep|> text <|im_end|>. Inside roles and texts backslashes are
doubled, and a backslash after its first character breaks every control string; `unescape` undoes both.

Null texts and roles count as empty. Turns go by turn (null first), then role, then text; repeated rows are repeated
turns. Rows whose conversation id is null form one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The markers of a turn, and the openings of control strings that are broken inside texts.
START, SEP, STOP = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
CONTROL = r"(<(?=\||<|/?s>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def expand(df: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", reply_role: str = "assistant") -> DataFrame:
    """One row per example: id, example (the place of its last turn, from 1), text, loss_start and loss_length (code points of the trainable part within text; length -1 where nothing is trainable)."""
    rows = df.select(F.col(f"`{id}`").alias("conv_id"), F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(f"`{role}`", F.lit("")).alias("role"), F.coalesce(f"`{text}`", F.lit("")).alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    parts = turns.select(
        "conv_id",
        F.transform("turns", lambda t: t["role"] == reply_role).alias("replies"),
        F.transform("turns", lambda t: F.length(escape(t["text"]))).alias("sizes"),
        F.transform("turns", lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(SEP), escape(t["text"]), F.lit(STOP))).alias("parts"),
    )
    n = F.size("parts")
    each = parts.select("conv_id", "replies", "sizes", "parts", F.explode(F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("replies", i) | (i == n))).alias("example"))
    body = each.select("conv_id", "example", F.element_at("replies", F.col("example")).alias("trains"), F.element_at("sizes", F.col("example")).alias("size"), F.array_join(F.slice("parts", F.lit(1), F.col("example")), "").alias("text"))
    return body.select(
        "conv_id",
        "example",
        "text",
        F.when(F.col("trains"), F.length("text") - len(STOP) - F.col("size")).otherwise(0).alias("loss_start"),
        F.when(F.col("trains"), F.col("size")).otherwise(-1).alias("loss_length"),
    )


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation what its examples say: the turns of the longest one, and all text under the loss mask in order."""
    reply = F.when(F.col("loss_length") >= 0, unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_length"))))
    whole = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("longest"),
        F.sort_array(F.collect_list(F.when(F.col("loss_length") >= 0, F.struct("example", reply.alias("reply"))))).alias("replies"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    split = F.split("longest", r"<\|im_start\|>")
    pieces = F.slice(split, F.lit(2), F.size(split))
    turns = F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(p, SEP, 1)).alias("role"), unescape(F.substring_index(F.substring_index(p, SEP, -1), STOP, 1)).alias("text")))
    return whole.select("conv_id", turns.alias("turns"), F.array_join(F.transform("replies", lambda r: r["reply"]), "").alias("loss"), "formatted_chars")


def digests(read: DataFrame) -> DataFrame:
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )
