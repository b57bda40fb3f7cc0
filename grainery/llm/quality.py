"""Quality classifier by nearest-neighbour voting on latent-semantic vectors.

Terms of a document are the runs of three byte classes in it, the lengths of its words, and its repetitions (words like the
word before, words in repeated 3-word windows, repeated lines). Term weights are Hellinger frequencies times inverse
document frequency; the right singular vectors of a bounded labelled sample (SAMPLE rows, whole texts) give the latent space. The
sample's latent vectors with their labels, of a size fixed by SAMPLE and LATENT, are broadcast; every document's
cosine to all of them is computed in exact blocks, and the labels of the K nearest are weighted by similarity.

Null texts count as empty; a text without terms gets the sample's share of label 1. Repeated rows give repeated
results; columns other than id and text never enter a score. A map over partitions without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, WHITE, Rolling, grams, inside, mix, passes, text_bytes, word_spans

SAMPLE, LATENT, NEIGHBOURS, SHARPNESS = 6000, 48, 25, 8.0
ROWS = 512


def _classes() -> np.ndarray:
    b = np.arange(256)
    out = np.full(256, 9, np.int32)
    for k, members in enumerate((b" ", b"\n\r\t\v\f", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".", b",", b"!?", b"#*$%&|<>")):
        out[np.frombuffer(members, np.uint8)] = k
    out[b >= 128] = 10
    out[(b < 32) & ~WHITE] = 11
    return out


CLASS = _classes()
N = 12
LENGTHS = 16
TERMS = N**3 + LENGTHS + 3


def terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of the terms of each document: (documents, TERMS)."""
    n = len(offsets) - 1
    code = CLASS[data]
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    tri = (code[:-2] * N + code[1:-1]) * N + code[2:] if len(code) > 2 else np.zeros(0, np.int64)
    within = owner[2:] == owner[:-2]
    out = np.zeros((n, TERMS), np.float32)
    out[:, : N**3] = np.bincount((owner[2:] * N**3 + tri)[within], minlength=n * N**3).reshape(n, N**3)
    starts, ends, at = word_spans(data, offsets)
    size = np.minimum(ends - starts, LENGTHS) - 1
    by = np.repeat(np.arange(n), np.diff(at))
    out[:, N**3 : N**3 + LENGTHS] = np.bincount(by * LENGTHS + size, minlength=n * LENGTHS).reshape(n, LENGTHS)
    rolling = Rolling(data)
    words = rolling.of(starts, ends)
    like = (words[1:] == words[:-1]) & (by[1:] == by[:-1])
    out[:, -3] = 4 * np.bincount(by[1:][like], minlength=n)
    if len(words) >= 3:
        ok, who = inside(at, 3, len(words))
        out[:, -2] = 4 * _again(mix(grams(words, 3) + who.astype(U64) * U64(0xC2B2AE3D27D4EB4F))[ok], who[ok], n)
    begin = np.union1d(offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(data == 10) + 1)
    begin = begin[begin < len(data)]
    if len(begin):
        who = np.searchsorted(offsets, begin, "right") - 1
        end = np.minimum(np.append(begin[1:], len(data)), offsets[who + 1])
        long = end - begin > 8
        begin, end, who = begin[long], end[long], who[long]
        out[:, -1] = _again(mix(rolling.of(begin, end) + who.astype(U64) * U64(0xC2B2AE3D27D4EB4F)), who, n, end - begin)
    return out


def _again(key: np.ndarray, owner: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Per owner, how many (or what weight of) keys repeat an earlier one."""
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    return np.bincount(owner[again], None if weight is None else weight[again], minlength=n)


class Model:
    """The latent space and the labelled vectors in it."""

    def __init__(self, counts: np.ndarray, labels: np.ndarray, latent: int = LATENT):
        seen = (counts > 0).sum(0)
        self.idf = (np.log((1 + len(counts)) / (1 + seen)) + 1).astype(np.float32)
        self.idf[seen == 0] = 0
        x = self._weigh(counts)
        values, vectors = np.linalg.eigh(x.T @ x) if len(x) else (np.zeros(TERMS), np.eye(TERMS, dtype=np.float32))
        self.space = vectors[:, np.argsort(-values)[:latent]].astype(np.float32)
        self.vectors = self._unit(x @ self.space)
        self.labels = labels.astype(np.float32)
        self.prior = float(labels.mean()) if len(labels) else 0.5

    def _weigh(self, counts: np.ndarray) -> np.ndarray:
        return np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True))).astype(np.float32) * self.idf

    @staticmethod
    def _unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))

    def score(self, counts: np.ndarray, k: int = NEIGHBOURS) -> np.ndarray:
        out = np.full(len(counts), self.prior)
        some = np.flatnonzero(counts.any(1))
        k = min(k, len(self.labels))
        if not k or not len(some):
            return out
        cosine = self._unit(self._weigh(counts[some]) @ self.space) @ self.vectors.T
        near = np.argpartition(-cosine, k - 1, 1)[:, :k]
        weight = np.clip(np.take_along_axis(cosine, near, 1), 1e-3, 1) ** SHARPNESS
        out[some] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return np.clip(out, 0, 1)


def _each(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray]]:
    data, offsets = text_bytes(batch.column(column))
    for i, j in passes(offsets):
        for a in range(i, j, ROWS):
            b = min(j, a + ROWS)
            yield a, b, terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def train(documents: DataFrame, labels: DataFrame, learn=None, n: int = SAMPLE) -> Model:
    """A model of at most n labelled documents, taken by a hash of their id. learn: which ids (a Column over doc_id) may be used."""
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    if learn is not None:
        marked = marked.where(learn)
    some = marked.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    found = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    texts = found.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, counts in _each(batch, "text"):
                packed = []
                for row in counts:
                    at = np.flatnonzero(row)
                    packed.append(at.astype("<i4").tobytes() + row[at].astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(packed, pa.binary()), batch.column(2).slice(i, j - i)], ["doc_id", "packed", "quality"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = sorted(tuple(r) for r in texts.mapInArrow(run, f"doc_id {kind}, packed binary, quality int").collect())
    counts = np.zeros((len(rows), TERMS), np.float32)
    for k, (_, packed, _) in enumerate(rows):
        m = len(packed) // 8
        counts[k, np.frombuffer(packed, "<i4", m)] = np.frombuffer(packed, "<f4", m, 4 * m)
    return Model(counts, np.array([int(q != 0) for *_, q in rows]))


def classify(df: DataFrame, model: Model, id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, score, predicted, and the carried columns) per row of df."""
    source = df.select(df[f"`{id}`"].alias("doc_id"), df[f"`{text}`"].alias("__text"), *[df[f"`{c}`"] for c in carry if c != text])
    held = ["__text" if c == text else c for c in carry]  # the text is sent to Python once
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, counts in _each(batch, "__text"):
                score = shared.value.score(counts)
                out = [batch.column("doc_id").slice(i, j - i), pa.array(score), pa.array((score >= 0.5).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([*out, *(batch.column(c).slice(i, j - i) for c in held)], ["doc_id", "score", "predicted", *carry])

    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    return source.mapInArrow(run, f"doc_id {kinds['doc_id']}, score double, predicted int" + "".join(f", `{c}` {kinds[h]}" for c, h in zip(carry, held, strict=True)))
