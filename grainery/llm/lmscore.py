"""Cross-entropy difference: matched target and background models over one shared vocabulary score each document by the
mean, over its words, of the difference of the two losses.

The vocabulary is every word of target and background together. Both models are interpolated Witten-Bell bigrams of all
its words with add-one unigrams, the same start symbol and one unseen word; all pairs are counted (see bigrams).

With a size, the models are smaller ones of classes: the `size` most frequent words are a class each and all other words
are one more; P(word | word before) = P(class | class before) * P(word | class). Both are then interpolated
Witten-Bell bigrams of classes with the same start symbol, and within the class of other words interpolated Witten-Bell
unigrams of the words themselves. All counts cover every text and are added up by key. The table of class losses, whose
size is fixed (its square), is what every task gets; the losses of other words grow with the input, so they are
never gathered but joined by word with the distinct words of groups of GROUP_BYTES of text. Words are compared by 64-bit
hashes.

Null and empty texts have no words and get null losses. Repeated rows count as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bigrams
from .common import passes, text_bytes, word_hashes, written

GROUP_BYTES = 16 << 20
#: Distinct words that a task holds before it passes them on.
HELD = 1 << 20


class Model(NamedTuple):
    """Sorted hashes of the frequent words; the class losses of target and background; (word, target_loss, background_loss)
    of the other words; and the two losses of a word that neither has."""

    known: np.ndarray
    target: np.ndarray
    background: np.ndarray
    others: DataFrame
    unseen: tuple[float, float]


class Whole(NamedTuple):
    """The texts of a model of all words, which are counted together with the texts to score."""

    target: DataFrame
    background: DataFrame
    text: str


def _words(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(column))
        for i, j in passes(offsets):
            words, at = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            yield batch, i, j, words.view(np.int64), at


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """(word, n): how often each hashed word occurs, added up within each task only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held = []
        for *_, words, _ in _words(batches, "text"):
            held.append(np.unique(words, return_counts=True))
            if sum(len(k) for k, _ in held) > HELD:
                held = [_added([(keys, counts), *held])]
                keys, counts = held.pop()
        keys, counts = _added([(keys, counts), *held])
        for low in range(0, len(keys), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(keys[low : low + (1 << 17)]), pa.array(counts[low : low + (1 << 17)])], ["word", "n"])

    return df.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "word bigint, n bigint")


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, inverse = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(inverse, np.concatenate([c for _, c in parts]), len(keys)).astype(np.int64)


def _pairs(words: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place in the table of (word before, word) for every word: classes 0.. are the vocabulary, then other, then start."""
    v = len(known)
    place = np.searchsorted(known, words)
    ids = np.where((place < v) & (known[np.minimum(place, max(0, v - 1))] == words) if v else False, place, v)
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[at[:-1][np.diff(at) > 0]] = v + 1
    return before * (v + 1) + ids


def pair_counts(df: DataFrame, text: str, known: np.ndarray) -> np.ndarray:
    """Counts of (word before, word) over all texts, as a table."""
    v = len(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((v + 2) * (v + 1), np.int64)
        for *_, words, at in _words(batches, "text"):
            if len(words):
                table += np.bincount(_pairs(words, at, known), minlength=len(table))
        cells = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(table[cells])], ["cell", "n"])

    rows = df.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((v + 2) * (v + 1), np.int64)
    table[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return table.reshape(v + 2, v + 1)


def losses(table: np.ndarray) -> np.ndarray:
    """-log P(word | word before) by Witten-Bell interpolation with add-one unigrams."""
    one = table.sum(0) + 1.0
    one /= one.sum()
    total, kinds = table.sum(1, keepdims=True).astype(float), (table > 0).sum(1, keepdims=True).astype(float)
    weight = np.where(total > 0, kinds / np.maximum(1, total + kinds), 1.0)
    return -np.log((1 - weight) * table / np.maximum(1, total) + weight * one)


def train(target: DataFrame, background: DataFrame, text: str = "text", size: int | None = None) -> Model | Whole:
    """A model of all words, or one of classes where a size is given."""
    if size is None:
        return Whole(target, background, text)
    zero = F.lit(0).cast("long")
    both = word_counts(target, text).select("word", F.col("n").alias("t"), zero.alias("b")).unionByName(word_counts(background, text).select("word", zero.alias("t"), F.col("n").alias("b")))
    counts = written(both.groupBy("word").agg(F.sum("t").alias("t"), F.sum("b").alias("b")), "lmscore-words")
    n = F.col("t") + F.col("b")
    first = counts.select("word", n.alias("n")).orderBy(F.desc("n"), "word").limit(size).collect()
    known = np.sort(np.array([r["word"] for r in first], np.int64))
    others = counts
    if first:
        last = first[-1]
        others = counts.where((n < last["n"]) | ((n == last["n"]) & (F.col("word") > last["word"])))
    sums = others.agg(F.count("*").alias("words"), *[e for c in "tb" for e in (F.sum(c).alias(c), F.count_if(F.col(c) > 0).alias(f"kinds_{c}"))]).first()

    def loss(c: str):
        """-log P(word | other): the mass of new words is shared by all other words of both sides and one unseen word."""
        total, kinds = sums[c] or 0, sums[f"kinds_{c}"]
        even = 1 / (sums["words"] + 1)
        return (lambda k: (k + kinds * even) / (total + kinds)) if total else (lambda k: k * 0 + even)

    of = {c: loss(c) for c in "tb"}
    others = others.select("word", *[(-F.log(of[c](F.col(c).cast("double")))).alias(name) for c, name in (("t", "target_loss"), ("b", "background_loss"))])
    return Model(known, losses(pair_counts(target, text, known)), losses(pair_counts(background, text, known)), others, tuple(-float(np.log(of[c](0.0))) for c in "tb"))


def _rare(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.ones(len(words), bool)
    return known[np.minimum(np.searchsorted(known, words), len(known) - 1)] != words


def score(df: DataFrame, model: Model | Whole, id: str = "doc_id", text: str = "text", group_bytes: int = GROUP_BYTES) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, difference) per row; a lower difference is more like the target.

    Rows are dealt to groups by their hash and the task they come from, so that equal rows do not all meet in one group.
    """
    if isinstance(model, Whole):
        return bigrams.score(df, model.target, model.background, id, text, model.text, group_bytes)
    source = df.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    group = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(1 + size // group_bytes)).alias("g")
    grouped = source.select("doc_id", "text", group).repartition("g")
    shared = df.sparkSession.sparkContext.broadcast((model.known, model.target.astype(np.float32).ravel(), model.background.astype(np.float32).ravel()))
    unseen = model.unseen

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The distinct rare words of each group; groups come one after the other."""
        known = shared.value[0]
        held: list[np.ndarray] = []
        now = -1

        def distinct() -> pa.RecordBatch:
            words = np.unique(np.concatenate(held)) if held else np.zeros(0, np.int64)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(words), now, np.int64)), pa.array(words)], ["g", "word"])

        for batch, i, j, words, at in _words(batches, "text"):
            g = batch.column("g").to_numpy()[i:j]
            runs = np.flatnonzero(np.diff(g, prepend=-1))
            for low, high in zip(runs, np.append(runs[1:], j - i), strict=True):
                if g[low] != now or sum(map(len, held)) > HELD:
                    yield distinct()
                    now = int(g[low])
                some = words[at[low] : at[high]]
                held.append(np.unique(some[_rare(some, known)]))
        yield distinct()

    def scored(docs: pa.Table, lexicon: pa.Table) -> pa.Table:
        known, *tables = shared.value
        other = lexicon.column("word").to_numpy()
        other, first = np.unique(other, return_index=True)
        own = [np.append(lexicon.column(c).to_numpy()[first], u) for c, u in zip(("target_loss", "background_loss"), unseen, strict=True)]
        parts = []
        for batch, i, j, words, at in _words(iter(docs.to_batches()), "text"):
            n = np.diff(at)
            cells = _pairs(words, at, known) if len(words) else np.zeros(0, np.int64)
            rare = np.flatnonzero(_rare(words, known))
            place = np.searchsorted(other, words[rare])
            place[np.append(other, 0)[place] != words[rare]] = len(other)
            means = []
            for table, extra in zip(tables, own, strict=True):
                loss = table[cells].astype(float)
                loss[rare] += extra[place]
                sums = np.zeros(len(cells) + 1)
                np.cumsum(loss, out=sums[1:])
                means.append((sums[at[1:]] - sums[at[:-1]]) / np.maximum(1, n))
            out = [pa.array(m, mask=n == 0) for m in (*means, means[0] - means[1])]
            parts.append(pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(n.astype(np.int64)), *out], ["doc_id", "n_words", "target_loss", "background_loss", "difference"]))
        return pa.Table.from_batches(parts)

    lexicon = grouped.sortWithinPartitions("g").mapInArrow(asked, "g bigint, word bigint").join(model.others, "word").select("g", "word", "target_loss", "background_loss")
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words bigint, target_loss double, background_loss double, difference double"
    return grouped.groupBy("g").cogroup(lexicon.groupBy("g")).applyInArrow(scored, schema)
