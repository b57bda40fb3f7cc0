"""Scores by Witten-Bell bigrams of all words, without gathering any table.

Texts lie in groups of bounded size. A group sends its distinct pairs (word before, word) to buckets of hash values, in
sorted order, and each bucket sends back their counts over all texts in the same order, so that no key travels twice;
then words go the same way with their counts and with the numbers of kinds that follow them. One group is the owner of
every pair and counts it as a kind. A common word or pair is one entry in each group. Pairs are compared by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, passes, text_bytes, word_hashes

START, _ODD = U64(0x6A09E667F3BCC909), U64(0x9E3779B97F4A7C15)
TARGET, BACKGROUND, ASKED = 0, 1, 2
_SENT = "g bigint, k bigint, size bigint, words bigint, t bigint, b bigint, phase int, data binary"
NAMES = ["doc_id", "n_words", "target_loss", "background_loss", "difference"]
_NAMES = ["g", "k", "size", "words", "t", "b", "phase", "data"]


def _planes(*columns: np.ndarray) -> bytes:
    """Unsigned columns in the narrowest type, byte by byte, so that zero bytes lie together for compression."""
    out = []
    for c in columns:
        c = c.astype(np.min_scalar_type(int(c.max(initial=0))))
        out += [bytes([c.itemsize]), np.ascontiguousarray(c.view(np.uint8).reshape(-1, c.itemsize).T).tobytes()]
    return b"".join(out)


def _columns(data: bytes, size: int) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        width = data[at]
        planes = np.frombuffer(data, np.uint8, width * size, at + 1).reshape(width, size)
        out.append(np.ascontiguousarray(planes.T).view(f"<u{width}").ravel())
        at += 1 + width * size
    return out


def _batch(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_NAMES)
    types = [pa.int64()] * 6 + [pa.int32(), pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=_NAMES)


def _read(docs: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct words and the start symbol, place of every word among them, place of the word before, words of each text)."""
    words, counts = [np.array([START])], []
    for batch in docs.to_batches():
        data, offsets = text_bytes(batch.column("text"))
        for i, j in passes(offsets):
            w, at = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            words.append(w)
            counts.append(np.diff(at))
    keys, place = np.unique(np.concatenate(words), return_inverse=True)
    place = place.astype(np.int32)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    ahead = place[:-1].copy()
    ahead[(np.cumsum(n) - n)[n > 0]] = place[0]
    return keys, place[1:], ahead, n


def _sent(g: int, phase: int, buckets: int, keys: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """A row for every bucket, empty ones too, with its part of the sorted keys as differences."""
    edges = [0, *np.searchsorted(keys, np.arange(1, buckets).astype(U64) << U64(65 - buckets.bit_length())).tolist(), len(keys)]
    return _batch([(g, k, j - i, 0, 0, 0, phase, _planes(np.diff(keys[i:j], prepend=U64(0)), *[c[i:j] for c in columns])) for k, (i, j) in enumerate(zip(edges[:-1], edges[1:], strict=True))])


def _met(rows: pa.Table) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The rows of a bucket in order of their groups: (their numbers; role, place and owner of each entry; number of keys; columns)."""
    order = sorted(zip(*(rows.column(c).to_pylist() for c in ("g", "k", "size", "data")), strict=True))
    parts = [_columns(data, size) for *_, size, data in order]
    columns = [np.concatenate(c) for c in list(zip(*parts, strict=True))[1:]]
    keys = np.concatenate([np.cumsum(p[0], dtype=U64) for p in parts])
    del parts
    unique, first, place = np.unique(keys, return_index=True, return_inverse=True)
    own = np.zeros(len(keys), bool)
    own[first] = True
    return [r[:3] for r in order], np.repeat([r[0] % 3 for r in order], [r[2] for r in order]), place, own, len(unique), columns


def _total(place: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(place, values, n).astype(np.int64)


def _back(rows: list[tuple], phase: int, stats: tuple[int, int, int], *columns: np.ndarray) -> pa.Table:
    ends = np.cumsum([size for *_, size in rows]).tolist()
    return _batch([(g, k, size, *stats, phase, _planes(*[c[end - size : end] for c in columns])) for (g, k, size), end in zip(rows, ends, strict=True)])


def _count_pairs(rows: pa.Table) -> pa.Table:
    order, role, place, own, n, (count,) = _met(rows)
    t, b = (_total(place, count * (role == r), n)[place] for r in (TARGET, BACKGROUND))
    return _back(order, 1, (0, 0, 0), t, b, own)


def _count_words(rows: pa.Table) -> pa.Table:
    order, role, place, own, n, (seen, led, kinds_t, kinds_b) = _met(rows)
    t, b, after_t, after_b = (_total(place, c * (role == r), n) for c in (seen, led) for r in (TARGET, BACKGROUND))
    kinds_t, kinds_b = (_total(place, c, n) for c in (kinds_t, kinds_b))
    stats = (int(((t + b) > 0).sum()), int(t.sum()), int(b.sum()))
    return _back(order, 2, stats, *[c[place] for c in (t, b, after_t, after_b, kinds_t, kinds_b)])


def _answers(returned: pa.Table, phase: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns that all buckets sent back, in the order of the keys, and the sums of what the buckets hold."""
    rows = sorted(r for r in zip(*(returned.column(c).to_pylist() for c in ("phase", "k", "size", "words", "t", "b", "data")), strict=True) if r[0] == phase)
    parts = [_columns(r[-1], r[2]) for r in rows]
    return [np.concatenate(c) for c in zip(*parts, strict=True)], np.sum([r[3:6] for r in rows], axis=0)


def _pair_keys(keys: np.ndarray, word: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    out = keys[ahead]
    out *= _ODD
    out += keys[word]
    return mix(out)


def score(df: DataFrame, target: DataFrame, background: DataFrame, id: str, text: str, train_text: str, group_bytes: int) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, difference) per row of df, which is often the background itself."""
    same = df is background and text == train_text
    kind = df.schema[id].dataType
    scored_role = BACKGROUND if same else ASKED
    parts, total = [], 0
    for some, column, role in ((target, train_text, TARGET), (background, train_text, BACKGROUND), (df, text, ASKED)):
        if role == ASKED and same:
            continue
        name = F.col(f"`{id}`") if role == scored_role else F.lit(None)
        rows = some.select(name.cast(kind).alias("doc_id"), F.col(f"`{column}`").alias("text"))
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        total += size
        number = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(1 + size // group_bytes))
        parts.append(rows.select("doc_id", "text", (number * 3 + role).alias("g")))
    buckets = 1 << (total // group_bytes).bit_length()
    docs = parts[0]
    for p in parts[1:]:
        docs = docs.unionByName(p)
    docs = docs.repartition("g")

    def pairs(rows: pa.Table) -> pa.Table:
        keys, word, ahead, _ = _read(rows)
        return _sent(rows.column("g")[0].as_py(), 1, buckets, *np.unique(_pair_keys(keys, word, ahead), return_counts=True))

    def words_of(rows: pa.Table, returned: pa.Table) -> pa.Table:
        keys, word, ahead, _ = _read(rows)
        _, first = np.unique(_pair_keys(keys, word, ahead), return_index=True)
        (t, b, own), _ = _answers(returned, 1)
        m, leader = len(keys), ahead[first]
        seen, led = np.bincount(word, minlength=m), np.bincount(ahead, minlength=m)
        kinds = [np.bincount(leader[(own > 0) & (c > 0)], minlength=m) for c in (t, b)]
        return _sent(rows.column("g")[0].as_py(), 2, buckets, keys, seen, led, *kinds)

    def scored(rows: pa.Table, returned: pa.Table) -> pa.Table:
        if not rows.num_rows or rows.column("g")[0].as_py() % 3 != scored_role:
            none = pa.array([], pa.float64())
            return pa.table([rows.column("doc_id").slice(0, 0), pa.array([], pa.int64()), none, none, none], names=NAMES)
        keys, word, ahead, n = _read(rows)
        _, pair = np.unique(_pair_keys(keys, word, ahead), return_inverse=True)
        (pair_t, pair_b, _), _ = _answers(returned, 1)
        (t, b, after_t, after_b, kinds_t, kinds_b), (known, all_t, all_b) = _answers(returned, 2)
        at = np.cumsum(np.append(0, n))
        means = []
        for both, one, after, kinds, every in ((pair_t, t, after_t, kinds_t, all_t), (pair_b, b, after_b, kinds_b, all_b)):
            even = (one[word] + 1.0) / (every + known + 1)
            k, a = kinds[ahead].astype(float), after[ahead].astype(float)
            loss = -np.log(np.where(a > 0, (both[pair] + k * even) / np.maximum(1, a + k), even))
            sums = np.append(0, np.cumsum(loss))
            means.append((sums[at[1:]] - sums[at[:-1]]) / np.maximum(1, n))
        out = [pa.array(m, mask=n == 0) for m in (*means, means[0] - means[1])]
        return pa.table([rows.column("doc_id"), pa.array(n.astype(np.int64)), *out], names=NAMES)

    by_g = docs.groupBy("g")
    one = by_g.applyInArrow(pairs, _SENT).groupBy("k").applyInArrow(_count_pairs, _SENT).repartition("g")
    two = by_g.cogroup(one.groupBy("g")).applyInArrow(words_of, _SENT).groupBy("k").applyInArrow(_count_words, _SENT)
    schema = f"doc_id {kind.simpleString()}, n_words bigint, target_loss double, background_loss double, difference double"
    return by_g.cogroup(one.unionByName(two).groupBy("g")).applyInArrow(scored, schema)
