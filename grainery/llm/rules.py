"""Quality rules by line sequence labelling: a linear-chain conditional random field marks each line of a document as
content or boilerplate by Viterbi decoding, and the share of its characters on content lines decides retention.

The field has one weight per bin of each line feature, a 2x2 transition table and start weights. Labels are known of documents
only, so those of their lines are latent: a line is content if its bins are likelier among the lines of good documents than
among those of bad ones, but a good document keeps at least KEEP_SHARE of its characters on content lines and a bad one less, by
changing its least certain lines first. So a bad document may hold lines of content and a good one boilerplate, and the transitions
are learned from changes within documents. The field is fitted to these labels by gradient ascent on their conditional
likelihood. (Labelling anew by the fitted field, once or twice, let whole documents take one label and kept more bad ones on held-out labels.)
It learns from a bounded sample: SAMPLE labelled ids, each with one text (the least, if an id is repeated), of which the middle
SAMPLE_LINES lines are fitted if it has more. Counting and decoding cover all text of all documents.

Null and empty texts have no words and fail the base rules. Repeated rows give repeated results. Columns of the input other
than id and text are ignored. A map over partitions without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Rolling, grams, inside, mix, passes, text_bytes, word_spans

SAMPLE, SAMPLE_LINES = 2000, 400
KEEP_SHARE = 0.5
LEAST_WORDS = 50

_CONTINUED = (np.arange(256) & 0xC0) == 0x80
_SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LOWER = (np.arange(256) >= 97) & (np.arange(256) <= 122)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_LOUD = np.isin(np.arange(256), np.frombuffer(b"!?{}[]()=~^_/\\@+", np.uint8))
#: Upper edges of the bins of each feature of a line.
EDGES = [
    np.array([20, 60, 200, 600.0]),  # bytes
    np.array([0.05, 0.15, 0.3, 0.6]),  # capitals among letters
    np.array([0.05, 0.2, 0.5, 1.0]),  # symbols a word
    np.array([0.05, 0.2, 0.5, 1.0]),  # loud marks a word
    np.array([0.02, 0.1, 0.3]),  # digits among bytes
    np.array([0.01, 0.05, 0.2, 0.5]),  # words that repeat the word before
    np.array([0.01, 0.1, 0.3, 0.6]),  # words in repeated 3-word windows
    np.array([2.0, 4.0, 7.0, 12.0]),  # bytes a word
    np.array([0.5]),  # equal to an earlier line
    np.array([0.5]),  # ends a sentence
]
FIRST = np.cumsum([0] + [len(e) + 1 for e in EDGES])
N_WEIGHTS = int(FIRST[-1])


class Lines:
    """Counts of the documents of a pass, and the bins of the features of their lines that hold a word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n_docs = len(offsets) - 1
        starts, ends, at = word_spans(data, offsets)
        rolling = Rolling(data)
        words = rolling.of(starts, ends)
        n_words = np.diff(at)

        def upto(flags: np.ndarray) -> np.ndarray:
            out = np.zeros(len(flags) + 1, np.int64)
            np.cumsum(flags, out=out[1:])
            return out

        def by(sums: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            return sums[b] - sums[a]

        low, high = offsets[:-1], offsets[1:]
        heads = upto(~_CONTINUED[data])
        white = np.zeros(len(data), bool)
        white[:] = True
        if len(starts):
            edge = np.zeros(len(data) + 1, np.int8)
            edge[starts] += 1
            edge[ends] -= 1
            white = np.cumsum(edge[:-1]) == 0
        self.word_chars = by(upto(~_CONTINUED[data] & ~white), low, high)
        symbols = upto(_SYMBOL[data])
        self.n_symbols = by(symbols, low, high)
        self.n_words = n_words
        # words in 3-word windows that the document holds twice or more
        repeated = np.zeros(len(words), bool)
        if len(words) >= 3:
            ok, owner = inside(at, 3, len(words))
            key = mix(grams(words, 3) + owner.astype(U64) * U64(0xC2B2AE3D27D4EB4F))
            place = np.flatnonzero(ok)
            order = place[np.argsort(key[place], kind="stable")]
            same = key[order[1:]] == key[order[:-1]]
            twice = np.zeros(len(words), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            repeated = twice.copy()
            repeated[1:] |= twice[:-1]
            repeated[2:] |= twice[:-2]
        repeats = upto(repeated)
        self.n_repeat_words = by(repeats, at[:-1], at[1:])
        # lines with a word
        breaks = np.flatnonzero(data == 10)
        begin = np.union1d(low[high > low], breaks + 1)
        owner = np.searchsorted(offsets, begin, "right") - 1
        keep = begin < len(data)
        begin, owner = begin[keep], owner[keep]
        end = np.minimum(np.append(begin[1:], len(data)), offsets[owner + 1])
        end = end - (data[np.maximum(end - 1, 0)] == 10)
        w0, w1 = np.searchsorted(starts, begin), np.searchsorted(starts, end)
        full = (w1 > w0) & (end > begin)
        begin, end, owner, w0, w1 = begin[full], end[full], owner[full], w0[full], w1[full]
        key = mix(rolling.of(begin, end) + owner.astype(U64) * U64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        self.n_dup_lines = np.bincount(owner, again, n_docs).astype(np.int64)
        letters, capitals = upto(_UPPER[data] | _LOWER[data]), upto(_UPPER[data])
        like_last = np.zeros(len(words), bool)
        like_last[1:] = words[1:] == words[:-1]
        k = (w1 - w0).astype(float)
        size = (end - begin).astype(float)
        last = np.isin(data[np.maximum(ends[np.maximum(w1 - 1, 0)] - 1, 0)] if len(ends) else np.zeros(0, np.uint8), np.frombuffer(b".?!:;\"')", np.uint8))
        values = [
            size,
            by(capitals, begin, end) / np.maximum(1, by(letters, begin, end)),
            by(symbols, begin, end) / k,
            by(upto(_LOUD[data]), begin, end) / k,
            by(upto(_DIGIT[data]), begin, end) / size,
            by(upto(like_last), w0, w1) / k,
            by(repeats, w0, w1) / k,
            by(heads, begin, end) / k,
            again.astype(float),
            last.astype(float),
        ]
        self.bins = np.stack([np.searchsorted(e, v, "right") for e, v in zip(EDGES, values, strict=True)], 1).astype(np.uint8) if len(k) else np.zeros((0, len(EDGES)), np.uint8)
        self.chars = by(heads, begin, end)
        self.at = np.searchsorted(owner, np.arange(n_docs + 1))


class Field:
    """Weights of a two-label linear chain; label 1 is content."""

    def __init__(self, weights: np.ndarray):
        self.emit, self.move, self.start = weights[:N_WEIGHTS], weights[N_WEIGHTS : N_WEIGHTS + 4].reshape(2, 2), weights[N_WEIGHTS + 4 :]

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.emit[bins.astype(np.int64) + FIRST[:-1]].sum(1)

    def sums(self, bins: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """(score, forward and backward logarithms, log partition of the document) of each line; documents come longest first."""
        score, total, steps = self.scores(bins), len(bins), int(length[0])
        active = np.searchsorted(-length, -np.arange(steps), "left")
        alpha, beta = np.zeros((total, 2)), np.zeros((total, 2))
        alpha[first, 0], alpha[first, 1] = self.start[0], self.start[1] + score[first]
        for t in range(1, steps):
            here = first[: active[t]] + t
            for y in (0, 1):
                alpha[here, y] = np.logaddexp(alpha[here - 1, 0] + self.move[0, y], alpha[here - 1, 1] + self.move[1, y]) + (score[here] if y else 0)
        for t in range(steps - 2, -1, -1):
            here = first[: active[t + 1]] + t
            for y in (0, 1):
                beta[here, y] = np.logaddexp(self.move[y, 0] + beta[here + 1, 0], self.move[y, 1] + score[here + 1] + beta[here + 1, 1])
        return score, alpha, beta, np.repeat(np.logaddexp(*(alpha[first + length - 1].T)), length)

    def viterbi(self, bins: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The best labels of the lines of documents whose lines begin at `at`, all documents a step at a time."""
        score = self.scores(bins)
        length = np.diff(at)
        order = np.argsort(-length, kind="stable")
        first, length = at[:-1][order], length[order]
        labels = np.zeros(len(score), np.int8)
        steps = int(length[0]) if len(length) else 0
        if not steps:
            return labels
        active = np.searchsorted(-length, -np.arange(steps), "left")
        n = int(active[0])
        v0, v1 = np.full(n, self.start[0]), self.start[1] + score[first[:n]]
        back = np.zeros((len(score), 2), np.int8)
        for t in range(1, steps):
            m = int(active[t])
            place = first[:m] + t
            a0, a1 = v0[:m], v1[:m]
            s0, s1 = a1 + self.move[1, 0] > a0 + self.move[0, 0], a1 + self.move[1, 1] > a0 + self.move[0, 1]
            back[place, 0], back[place, 1] = s0, s1
            n0 = np.where(s0, a1 + self.move[1, 0], a0 + self.move[0, 0])
            v1[:m] = np.where(s1, a1 + self.move[1, 1], a0 + self.move[0, 1]) + score[place]
            v0[:m] = n0
        now = np.zeros(n, np.int8)
        for t in range(steps - 1, -1, -1):
            m = int(active[t])
            ended = length[:m] == t + 1
            now[:m][ended] = (v1[:m] > v0[:m])[ended]
            place = first[:m] + t
            labels[place] = now[:m]
            now[:m] = back[place, now[:m]]
        return labels


def fit(sequences: list[np.ndarray], labels: list[np.ndarray], rounds: int = 150, rate: float = 0.1, decay: tuple[float, float] = (1e-5, 1e-2)) -> np.ndarray:
    """Weights of the field from documents (bins of their lines) and the labels of their lines."""
    keep = [k for k, s in enumerate(sequences) if len(s)]
    keep.sort(key=lambda k: -len(sequences[k]))
    weights = np.zeros(N_WEIGHTS + 6)
    if not keep:
        return weights
    bins = np.concatenate([sequences[k] for k in keep])
    length = np.array([len(sequences[k]) for k in keep])
    gold_line = np.concatenate([labels[k] for k in keep]).astype(float)
    place = bins.astype(np.int64) + FIRST[:-1]
    first = np.cumsum(length) - length
    total = len(bins)
    held = np.repeat(decay, (N_WEIGHTS, 6))  # where few lines differ from the one before, free transitions would drown the features
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        field = Field(weights)
        score, alpha, beta, z = field.sums(bins, first, length)
        p = np.exp(alpha[:, 1] + beta[:, 1] - z)
        grad = np.zeros_like(weights)
        miss = gold_line - p
        for c in range(place.shape[1]):
            grad[:N_WEIGHTS] += np.bincount(place[:, c], miss, N_WEIGHTS)
        inner = np.ones(total, bool)
        inner[first] = False
        j = np.flatnonzero(inner)
        for a in (0, 1):
            for b in (0, 1):
                expected = np.exp(alpha[j - 1, a] + field.move[a, b] + (score[j] if b else 0) + beta[j, b] - z[j]).sum()
                grad[N_WEIGHTS + 2 * a + b] = ((gold_line[j] == a) & (gold_line[j] == b)).sum() - expected
        grad[N_WEIGHTS + 5] = (gold_line[first] - p[first]).sum()
        grad[N_WEIGHTS + 4] = -grad[N_WEIGHTS + 5]
        grad = grad / total - held * weights
        mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
        weights = weights + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    return weights


def line_labels(margin: np.ndarray, chars: np.ndarray, good: bool, keep_share: float = KEEP_SHARE) -> np.ndarray:
    """Labels of a document's lines by the sign of their margins, the least certain changed until the document's label holds."""
    out = margin > 0
    need = keep_share * chars.sum()
    wrong = (need - chars[out].sum()) if good else (chars[out].sum() - need)
    if wrong > 0 or not good and wrong == 0:
        at = np.flatnonzero(out != good)
        at = at[np.argsort(np.abs(margin[at]), kind="stable")]
        upto = np.cumsum(chars[at])
        enough = np.searchsorted(upto, wrong, "left" if good else "right")
        out[at[: enough + 1]] = good
    return out


def learn(sequences: list[np.ndarray], chars: list[np.ndarray], quality: list[int]) -> np.ndarray:
    """Weights of the field from documents (bins and characters of their lines) of which only the documents' labels are known."""
    keep = [k for k, s in enumerate(sequences) if len(s)]
    if not keep:
        return np.zeros(N_WEIGHTS + 6)
    length = np.array([len(sequences[k]) for k in keep])
    place = np.concatenate([sequences[k] for k in keep]).astype(np.int64) + FIRST[:-1]
    of = np.repeat([quality[k] != 0 for k in keep], length)
    odds = np.zeros(N_WEIGHTS)
    for y, sign in ((True, 1), (False, -1)):
        count = np.bincount(place[of == y].ravel(), minlength=N_WEIGHTS) + 1.0
        for a, b in zip(FIRST[:-1], FIRST[1:], strict=True):
            odds[a:b] += sign * np.log(count[a:b] / count[a:b].sum())
    margins = np.split(odds[place].sum(1), np.cumsum(length)[:-1])
    return fit([sequences[k] for k in keep], [line_labels(m, chars[k], quality[k] != 0) for m, k in zip(margins, keep, strict=True)])


def _each_pass(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, Lines]]:
    data, offsets = text_bytes(batch.column(column))
    for i, j in passes(offsets):
        yield i, j, Lines(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def sample(documents: DataFrame, labels: DataFrame, n: int = SAMPLE) -> DataFrame:
    """At most n labelled ids, by a hash of the id, each with one text and one label: (text, quality)."""
    marked = labels.select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isNotNull())
    some = marked.groupBy("__id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("__id"), "__id").limit(n)
    found = documents.select(F.col("doc_id").alias("__id"), "text").join(F.broadcast(some), "__id")
    return found.groupBy("__id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")).select("text", "quality")


def train(documents: DataFrame, labels: DataFrame, n: int = SAMPLE) -> np.ndarray:
    """Weights fitted on a bounded sample; documents may be any set that labels cover in part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            quality = batch.column(1)
            for i, j, lines in _each_pass(batch, "text"):
                bins, chars = [], []
                for a, b in zip(lines.at[:-1], lines.at[1:], strict=True):
                    skip = max(0, b - a - SAMPLE_LINES)
                    a, b = a + skip // 2, b - (skip - skip // 2)
                    bins.append(lines.bins[a:b].tobytes())
                    chars.append(lines.chars[a:b].astype("<i8").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(bins, pa.binary()), pa.array(chars, pa.binary()), quality.slice(i, j - i)], ["bins", "chars", "quality"])

    rows = sorted((bytes(r[0]), bytes(r[1]), r[2]) for r in sample(documents, labels, n).mapInArrow(run, "bins binary, chars binary, quality int").collect())
    return learn([np.frombuffer(b, np.uint8).reshape(-1, len(EDGES)) for b, *_ in rows], [np.frombuffer(c, "<i8") for _, c, _ in rows], [int(q != 0) for *_, q in rows])


SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, content_share double, kept boolean"


def judge(df: DataFrame, weights: np.ndarray, id: str = "doc_id", text: str = "text", keep_share: float = KEEP_SHARE, carry: tuple[str, ...] = (), line_labels: bool = False) -> DataFrame:
    """Per document its counts, whether the base rules failed it, the share of content and whether it is kept.

    carry: columns of df to return along with it. line_labels: also the labels of its lines with a word (1: content).
    """
    source = df.select(df[f"`{id}`"].alias("doc_id"), df[f"`{text}`"].alias("__text"), *[df[f"`{c}`"] for c in carry if c != text])
    held = ["__text" if c == text else c for c in carry]  # the text is sent to Python once
    field = Field(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x in _each_pass(batch, "__text"):
                labels = field.viterbi(x.bins, x.at)
                sums = np.zeros((2, len(x.chars) + 1), np.int64)
                np.cumsum(x.chars, out=sums[0, 1:])
                np.cumsum(x.chars * labels, out=sums[1, 1:])
                total, good = sums[:, x.at[1:]] - sums[:, x.at[:-1]]
                share = good / np.maximum(1, total)
                failed = (x.n_words < LEAST_WORDS) | (100 * x.n_repeat_words > 50 * x.n_words)
                out = [batch.column("doc_id").slice(i, j - i)]
                out += [pa.array(v.astype(np.int64)) for v in (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words)]
                out += [pa.array(failed), pa.array(share), pa.array(~failed & (share >= keep_share))]
                out += [batch.column(c).slice(i, j - i) for c in held]
                if line_labels:
                    out.append(pa.ListArray.from_arrays(pa.array(x.at, pa.int32()), pa.array(labels)))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", *(c.split()[0] for c in SCHEMA.split(", ")), *carry, *(["line_labels"] if line_labels else [])])

    kinds = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    more = "".join(f", `{c}` {kinds[h]}" for c, h in zip(carry, held, strict=True)) + (", line_labels array<tinyint>" if line_labels else "")
    return source.mapInArrow(run, f"doc_id {kinds['doc_id']}, {SCHEMA}{more}")
