"""Byte-level BPE encoding and decoding on length-bucketed padded numpy matrices.

Texts are split by the pattern of the vocabulary; each distinct piece is encoded once a batch and then kept
in a bounded cache. Pieces of like length fill one matrix of token ids, a piece per row. In each round every
row finds its leftmost pair of least rank, merges it, and moves the rest of the row one place to the left;
rows without a known pair are done and leave the matrix. Ranks of pairs come from an open-addressing hash
table in numpy arrays. Pieces longer than LONG bytes, on which rounds as many as their length would be
quadratic, are merged through a heap in the same order.

Null text counts as empty: no ids, no bytes. Rows keep every other column and are never dropped.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame

#: Longest piece in bytes that goes through the matrices.
LONG = 256
#: Pieces that a worker keeps between batches.
CACHE = 600_000
#: Rows of a matrix at most, so that its scratch space stays small.
ROWS = 32_768
NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Ranks, the pair table and the bytes of every token. A rank is also the token's id."""

    def __init__(self, path: str):
        ranks = {}
        with open(path, "rb") as lines:
            for line in lines:
                if line.strip():
                    token, rank = line.split()
                    ranks[base64.b64decode(token)] = int(rank)
        self.ranks = ranks
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, merged = [], [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a = ranks.get(token[:cut])
                if a is not None and (b := ranks.get(token[cut:])) is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.pairs = dict(zip(zip(left, right, strict=True), merged, strict=True))
        self._build(np.array(left, np.int64), np.array(right, np.int64), np.array(merged, np.int32))
        top = max(ranks.values()) + 1
        by_id = [b""] * top
        for token, rank in ranks.items():
            by_id[rank] = token
        self.flat = np.frombuffer(b"".join(by_id), np.uint8)
        self.lengths = np.array([len(t) for t in by_id], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def _build(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray) -> None:
        key = (left << 32 | right).astype(np.uint64)
        self.bits = max(4, int(len(key) * 4 - 1).bit_length())
        self.keys = np.full(1 << self.bits, np.uint64(2**64 - 1))
        self.values = np.full(1 << self.bits, NONE, np.int32)
        todo, step = np.arange(len(key)), 0
        self.reach = 0
        while len(todo):
            slot = (self._home(key[todo]) + step) & (len(self.keys) - 1)
            free = self.keys[slot] == np.uint64(2**64 - 1)
            _, first = np.unique(slot, return_index=True)
            wins = np.zeros(len(todo), bool)
            wins[first] = True
            wins &= free
            self.keys[slot[wins]], self.values[slot[wins]] = key[todo[wins]], merged[todo[wins]]
            todo, step = todo[~wins], step + 1
        self.reach = step

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where the vocabulary has no such token. Negative ids are padding."""
        shape = a.shape
        key = (a.astype(np.int64) << 32 | (b.astype(np.int64) & 0xFFFFFFFF)).astype(np.uint64).ravel()
        out = np.full(len(key), NONE, np.int32)
        todo, slot = np.arange(len(key)), self._home(key)
        for _ in range(self.reach):
            found = self.keys[slot]
            hit = found == key[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (found != np.uint64(2**64 - 1))
            if not on.any():
                break
            todo, slot = todo[on], (slot[on] + 1) & (len(self.keys) - 1)
        out = out.reshape(shape)
        out[(a < 0) | (b < 0)] = NONE
        return out

    def merge_rows(self, ids: np.ndarray) -> list[np.ndarray]:
        """Encodes the rows of a matrix that is padded with -1 on the right."""
        out: list[np.ndarray | None] = [None] * len(ids)
        row = np.arange(len(ids))
        ranks = self.rank(ids[:, :-1], ids[:, 1:])
        while len(row):
            if ids.shape[1] < 2:
                best = np.full(len(row), NONE)
            else:
                at = ranks.argmin(1)
                best = ranks[np.arange(len(row)), at]
            done = best == NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[row[k]] = ids[k][ids[k] >= 0]
                on = ~done
                row, ids = row[on], ids[on]
                if not len(row):
                    break
                ranks, at, best = ranks[on], at[on], best[on]
            here = np.arange(len(row))
            ids[here, at] = best
            ids = np.where(np.arange(ids.shape[1] - 1) <= at[:, None], ids[:, :-1], ids[:, 1:])
            if ids.shape[1] < 2:
                continue
            ranks = np.where(np.arange(ranks.shape[1] - 1) < at[:, None], ranks[:, :-1], ranks[:, 1:])
            for k in (at - 1, at):
                ok = (k >= 0) & (k < ids.shape[1] - 1)
                ranks[here[ok], k[ok]] = self.rank(ids[here[ok], k[ok]], ids[here[ok], k[ok] + 1])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, through a heap over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.pairs.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[j] < n:
                before[after[j]] = i
                if (s := self.pairs.get((r, ids[after[j]]))) is not None:
                    heapq.heappush(heap, (s, i, r, ids[after[j]]))
            if (p := before[i]) >= 0 and (s := self.pairs.get((ids[p], r))) is not None:
                heapq.heappush(heap, (s, p, ids[p], r))
        return np.array([t for t, ok in zip(ids, alive, strict=True) if ok], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            n = len(p)
            if n > LONG:
                out[k] = self.merge_long(p).astype("<u4").tobytes()
            elif n:
                by_width.setdefault(n if n <= 16 else (n + 7) // 8 * 8, []).append(k)
        for width, members in by_width.items():
            for low in range(0, len(members), ROWS):
                some = members[low : low + ROWS]
                raw = np.frombuffer(b"".join(pieces[k].ljust(width, b"\0") for k in some), np.uint8).reshape(len(some), width)
                ids = self.byte_ids[raw]
                size = np.array([len(pieces[k]) for k in some])
                ids[np.arange(width) >= size[:, None]] = -1
                for k, got in zip(some, self.merge_rows(ids), strict=True):
                    out[k] = got.astype("<u4").tobytes()
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one after the other."""
        n = self.lengths[ids]
        end = np.cumsum(n)
        return self.flat[np.repeat(self.starts[ids] - (end - n), n) + np.arange(int(end[-1]) if len(end) else 0)]


class Encoder:
    """A vocabulary with its pattern and the cache of pieces."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary, self.find = Vocabulary(path), regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.find(t) if t else [] for t in texts]
        new = set().union(*split) if split else set()
        if len(self.cache) + len(new) > CACHE:
            self.cache = {}
        new = [p for p in new if p not in self.cache]
        self.cache.update(zip(new, self.vocabulary.encode_pieces([p.encode() for p in new]), strict=True))
        get = self.cache.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def vocabulary_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch of about `most` characters each, with their texts."""
    texts = [t or "" for t in batch.column(column).to_pylist()]
    low = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield batch.slice(low, k - low), texts[low:k]
            low, size = k, 0
        size += len(t)
    if low < len(texts):
        yield batch.slice(low), texts[low:]


EMITS = {"ids": "array<int>", "decoded": "binary", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(df: DataFrame, text: str = "text", emit: tuple[str, ...] = ("ids",), path: str | None = None, pattern: str | None = None, keep: tuple[str, ...] | None = None) -> DataFrame:
    """df with the columns of `emit`: ids, decoded (the bytes that the ids stand for), n_tokens, or digests of the two.

    keep: the columns of df to carry along (all by default; those that clash with `emit` are replaced).
    A map over partitions: no shuffle, and a lost task is simply done again.
    """
    path, pattern = path or vocabulary_path(), pattern or public_tokenizers.PATTERN
    kept = [c for c in (keep if keep is not None else df.columns) if c not in emit]
    source = df.select(*[df[f"`{c}`"] for c in kept], df[f"`{text}`"].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            for part, texts in _slices(batch, "__text", 4 << 20):
                got = own.encode(texts)
                columns = [part.column(c) for c in kept]
                ids = np.frombuffer(b"".join(got), "<u4")
                at = np.cumsum([0] + [len(g) // 4 for g in got])
                back, back_at = None, None
                if "decoded" in emit or "decoded_sha256" in emit:
                    back = own.vocabulary.decode(ids).tobytes()
                    back_at = np.concatenate([[0], np.cumsum(own.vocabulary.lengths[ids])])[at]
                for e in emit:
                    if e == "ids":
                        columns.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))))
                    elif e == "n_tokens":
                        columns.append(pa.array(np.diff(at), pa.int64()))
                    elif e == "ids_sha256":
                        columns.append(pa.array([hashlib.sha256(g).hexdigest() for g in got]))
                    else:
                        views = [back[a:b] for a, b in zip(back_at[:-1], back_at[1:], strict=True)]
                        columns.append(pa.array(views, pa.binary()) if e == "decoded" else pa.array([hashlib.sha256(v).hexdigest() for v in views]))
                yield pa.RecordBatch.from_arrays(columns, [*kept, *emit])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "__text"]
    return source.mapInArrow(run, ", ".join([*fields, *(f"`{e}` {EMITS[e]}" for e in emit)]))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """df with the bytes of the token ids in `ids`; null ids give empty bytes."""
    path = path or vocabulary_path()
    kept = [c for c in df.columns if c not in (ids, out)]
    source = df.select(*[df[f"`{c}`"] for c in kept], df[f"`{ids}`"].alias("__ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder(path, public_tokenizers.PATTERN).vocabulary
        for batch in batches:
            got = [words.decode(np.array(x or [], np.int64)).tobytes() for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(got, pa.binary())], [*kept, out])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields if f.name != "__ids"]
    return source.mapInArrow(run, ", ".join([*fields, f"`{out}` binary"]))
