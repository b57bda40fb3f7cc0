"""Language identification by interpolated Kneser-Ney character models, one per language.

Texts become streams of lower-case letters in which every run of other characters is one space. A model's
probabilities of all n-grams up to ORDER that any language's sample holds lie in one sorted array of hashes per order, with a row
of log probabilities (one per language) beside each hash; contexts likewise hold back-off weights. A directory over
the upper bits of the hashes leads to the few entries that a lookup has to look at. A document's language is the one with the
lowest cross-entropy per character; a text is marked rejected if even that exceeds the calibrated quantile of the
losses of held-back sample texts.

The models learn from a bounded sample (SAMPLE whole texts per language, by a hash of their id; of a repeated id one text, the least).
Executors count its n-grams and compute the losses of the texts held back, so that the driver gets counts and losses but no text; the
smallest hashes are picked within SALTS parts of a language first, so that no task meets a whole language. Every text is scored whole.
Null texts and texts without a letter give `und` with score 0. Ties go to the language that sorts first.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix, passes, text_bytes, written

SAMPLE, ORDER, DISCOUNT, SALTS = 400, 4, 0.75, 256
#: Share of held-back sample texts in their own language that rejection may mark.
REJECTED = 0.002
UNKNOWN = "und"
U64 = np.uint64

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point its lower-case letter, folded to 16 bits, or 0 for what is no letter."""
    if not _letters:
        out = np.zeros(sys.maxunicode + 2, np.uint16)
        for c in range(0x33480):  # beyond it no letters are assigned
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = (ord(low[0]) if len(low) == 1 else c) % 65535 + 1
        _letters.append(out)
    return _letters[0]


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, where each document's symbols begin): each document starts with a space; runs of other characters are one."""
    n = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    at = heads[offsets]
    symbols = np.insert(letters()[points], at[:-1], 0)
    first = at[:-1] + np.arange(n)
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0)
    keep[first] = True
    count = np.zeros(len(symbols) + 1, np.int64)
    np.cumsum(keep, out=count[1:])
    return symbols[keep], count[np.append(first, len(symbols))]


def packed(symbols: np.ndarray, n: int) -> np.ndarray:
    """The n symbols that end at each place, 16 bits each, as one number (places before the first n-1 hold what there is)."""
    out = symbols.astype(U64)
    for k in range(1, n):
        out[k:] |= symbols[:-k].astype(U64) << U64(16 * k)
    return out


class HashArray:
    """Sorted hashes with a directory over their upper bits."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        h = mix(keys.copy())
        order = np.argsort(h)
        self.hashes, self.rows = h[order], np.vstack([rows[order], np.zeros((1, rows.shape[1]), np.float32)]).astype(np.float32)
        self.bits = max(1, int(len(h)).bit_length())
        starts = np.searchsorted(self.hashes >> U64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=U64))
        self.first = starts[:-1].astype(np.int32)
        self.reach = int(np.diff(starts).max(initial=0))
        self.padded = np.append(self.hashes, np.full(self.reach + 1, U64(2**64 - 1)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        h = mix(keys.copy())
        at = self.first[(h >> U64(64 - self.bits)).astype(np.int64)]
        out = np.full(len(h), -1, np.int32)
        todo = np.arange(len(h))
        for _ in range(self.reach):
            got = self.padded[at]
            hit = got == h
            out[todo[hit]] = at[hit]
            on = got < h
            if not on.any():
                break
            todo, at, h = todo[on], at[on] + 1, h[on]
        return out


def _counts(symbols: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    keys = packed(symbols, n)
    place = np.arange(len(symbols)) - np.repeat(at[:-1], np.diff(at))
    return np.unique(keys[place >= n - 1], return_counts=True)


class Model:
    def __init__(self, languages: list[str], counts: list[list[tuple[np.ndarray, np.ndarray]]], order: int = ORDER, discount: float = DISCOUNT):
        """counts: per language and order the sorted n-grams and how often each occurs."""
        self.languages, self.order = languages, order
        union = [np.unique(np.concatenate([c[n][0] for c in counts])) if counts else np.zeros(0, U64) for n in range(order)]
        self.floor = -np.log(2.0 + len(union[0]))
        p = np.full((len(union[0]), len(languages)), 1.0 / (2 + len(union[0])))
        self.grams, self.contexts = [], []
        below = None
        for n in range(order):
            prob, weights, context_keys = np.zeros((len(union[n]), len(languages))), [], []
            for k in range(len(languages)):
                keys, c = counts[k][n]
                if n + 1 < order:  # how many different symbols come before: lower orders count these
                    longer = counts[k][n + 1][0]
                    keys, c = np.unique(longer & U64((1 << 16 * (n + 1)) - 1), return_counts=True)
                context = keys >> U64(16)
                ctx, inverse = np.unique(context, return_inverse=True)
                total, kinds = np.bincount(inverse, c), np.bincount(inverse)
                back = discount * kinds / total
                if n == 0:
                    lower = p[:, k]
                    lam = back[0] if len(back) else 1.0
                    prob[:, k] = lam * lower
                else:
                    shorter = np.searchsorted(union[n - 1], union[n] & U64((1 << 16 * n) - 1))
                    lower = below[shorter, k]
                    at = np.searchsorted(ctx, union[n] >> U64(16))
                    known = (at < len(ctx)) & (ctx[np.minimum(at, max(0, len(ctx) - 1))] == union[n] >> U64(16)) if len(ctx) else np.zeros(len(union[n]), bool)
                    lam = np.where(known, back[np.minimum(at, max(0, len(ctx) - 1))] if len(ctx) else 1.0, 1.0)
                    prob[:, k] = lam * lower
                prob[np.searchsorted(union[n], keys), k] += (c - discount) / total[inverse]
                context_keys.append(ctx)
                weights.append(np.log(back))
            below = prob
            self.grams.append(HashArray(union[n], np.log(prob)))
            if n:
                all_contexts = np.unique(np.concatenate(context_keys)) if context_keys else np.zeros(0, U64)
                table = np.zeros((len(all_contexts), len(languages)))
                for k, (ctx, w) in enumerate(zip(context_keys, weights, strict=True)):
                    table[np.searchsorted(all_contexts, ctx), k] = w
                self.contexts.append(HashArray(all_contexts, table))
        self.sharpness, self.limit = 1.0, np.inf

    def losses(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(per document and language the loss per character, letters of each document)."""
        symbols, at = stream(data, offsets)
        n, total = len(symbols), np.zeros((len(offsets) - 1, len(self.languages)))
        size = np.diff(at)
        place = np.arange(n) - np.repeat(at[:-1], size)
        score = np.zeros((n, len(self.languages)), np.float32)
        todo = np.flatnonzero(place > 0)
        extra: list[tuple[np.ndarray, np.ndarray]] = []
        full = packed(symbols, self.order)
        for order in range(self.order, 0, -1):
            mask = U64((1 << 16 * order) - 1)
            ready = place[todo] >= order - 1
            now, wait = todo[ready], todo[~ready]
            row = self.grams[order - 1].find(full[now] & mask)
            hit = row >= 0
            score[now[hit]] = self.grams[order - 1].rows[row[hit]]
            missed = now[~hit]
            if order > 1:
                context = self.contexts[order - 2]
                extra.append((missed, context.find((full[missed] & mask) >> U64(16))))
                todo = np.concatenate([missed, wait])
            else:
                score[missed] = self.floor
        for k, (missed, row) in enumerate(extra):
            score[missed] += self.contexts[self.order - 2 - k].rows[row]
        sums = np.zeros((n + 1, len(self.languages)))
        np.cumsum(score, axis=0, out=sums[1:])
        total = -(sums[at[1:]] - sums[at[:-1]])
        is_letter = np.zeros(n + 1, np.int64)
        np.cumsum(symbols != 0, out=is_letter[1:])
        return total / np.maximum(1, size - 1)[:, None], is_letter[at[1:]] - is_letter[at[:-1]]

    def posterior(self, losses: np.ndarray) -> np.ndarray:
        z = -self.sharpness * losses
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def calibrate(self, losses: np.ndarray, gold: np.ndarray, share: float = REJECTED) -> None:
        """The sharpness of the posterior with the least log loss, and the limit of rejection."""
        if not len(gold):
            return

        def miss(s: float) -> float:
            self.sharpness = s
            return float(-np.log(np.maximum(1e-9, self.posterior(losses)[np.arange(len(gold)), gold])).mean())

        self.sharpness = min((2.0**k for k in range(0, 8)), key=miss)
        self.limit = float(np.quantile(losses[np.arange(len(gold)), gold], 1 - share)) * 1.05


def sample(documents: DataFrame, learn=None, n: int = SAMPLE) -> DataFrame:
    """(lang, k, text): at most n ids per language, numbered from 1 by a hash, each with one text."""
    rows = documents.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    if learn is not None:
        rows = rows.where(learn)
    # ids first, texts only of those picked
    ranked = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    part = Window.partitionBy("lang", F.pmod("h", F.lit(SALTS))).orderBy("h", "doc_id")
    few = ranked.withColumn("j", F.dense_rank().over(part)).where(F.col("j") <= n).select("lang", "h", "doc_id").distinct()
    picked = few.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("k") <= n)
    found = rows.join(F.broadcast(picked.select("doc_id", "lang", "k")), ["doc_id", "lang"])
    return found.groupBy("lang", "k").agg(F.min("text").alias("text"))


def train(documents: DataFrame, learn=None, n: int = SAMPLE) -> Model:
    """Models of every language in `lang`, from at most n texts each. learn: which ids (a Column over doc_id) may be used."""
    picked = written(sample(documents, learn, n), "languages")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column("lang").to_pylist(), object)
            for lang in sorted(set(names)):
                symbols, at = stream(*text_bytes(batch.column("text").filter(pa.array(names == lang))))
                for order in range(1, ORDER + 1):
                    keys, c = _counts(symbols, at, order)
                    m = len(keys)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * m, pa.string()), pa.array(np.full(m, order, np.int32)), pa.array(keys.view(np.int64)), pa.array(c.astype(np.int64))], ["lang", "n", "key", "c"])

    counted = picked.where("k % 5 <> 0").select("lang", "text").mapInArrow(count, "lang string, n int, key bigint, c bigint")
    got = counted.groupBy("lang", "n", "key").agg(F.sum("c").alias("c")).toArrow()
    named, order = got.column("lang").to_numpy(), got.column("n").to_numpy()
    keys, c = got.column("key").to_numpy().view(U64), got.column("c").to_numpy()
    languages = sorted(set(named))

    def of(lang: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        mine = np.flatnonzero((named == lang) & (order == n))
        mine = mine[np.argsort(keys[mine])]
        return keys[mine], c[mine]

    model = Model(languages, [[of(lang, n) for n in range(1, ORDER + 1)] for lang in languages])
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def lose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            losses, size = shared.value.losses(*text_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("k"), pa.array(list(losses), pa.list_(pa.float64())), pa.array(size)], ["lang", "k", "losses", "size"])

    held = picked.where("k % 5 = 0").mapInArrow(lose, "lang string, k int, losses array<double>, size bigint")
    rows = sorted(tuple(r) for r in held.where("size >= 20").collect() if r.lang in languages) if languages else []
    if rows:
        model.calibrate(np.array([r[2] for r in rows]), np.array([languages.index(r[0]) for r in rows]))
    return model


def identify(df: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, loss, rejected): the likeliest language, its calibrated posterior, its loss per character."""
    source = df.select(df[f"`{id}`"].alias("doc_id"), df[f"`{text}`"].alias("__text"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array([*own.languages, UNKNOWN], object)
        for batch in batches:
            data, offsets = text_bytes(batch.column("__text"))
            for i, j in passes(offsets):
                if own.languages:
                    losses, size = own.losses(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                    best = losses.argmin(1)
                    loss, score = losses[np.arange(j - i), best], own.posterior(losses)[np.arange(j - i), best]
                    none = size == 0
                    best = np.where(none, len(own.languages), best)
                    loss, score = np.where(none, 0.0, loss), np.where(none, 0.0, score)
                else:
                    best, loss, score, none = np.zeros(j - i, int), np.zeros(j - i), np.zeros(j - i), np.ones(j - i, bool)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(names[best], pa.string()), pa.array(score), pa.array(loss), pa.array(none | (loss > own.limit))], ["doc_id", "lang_pred", "score", "loss", "rejected"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, loss double, rejected boolean")
