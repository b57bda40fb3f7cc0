"""Shared helpers of the training-data operators: reading, scratch tables, and numpy views of text columns."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass looks at; one longer document makes a pass of its own.
PASS_BYTES = 2 << 20

U64 = np.uint64
_ODD = 0x9E3779B97F4A7C15
_BASE = 0xD6E8FEB86659FD93
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

#: The white space of the contracts: space and \t \n \v \f \r.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_AS_IS = np.arange(256, dtype=np.uint8)
LOWER = _AS_IS.copy()
LOWER[ord("A") : ord("Z") + 1] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, on a local master alone, a temporary one, which is then set."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            return made.get()
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="grainery-")
        atexit.register(shutil.rmtree, where, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(where)
        return spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return where


def written(df: DataFrame, name: str) -> DataFrame:
    """df, computed once and read again from a Parquet table in the shared scratch folder, so that its lineage ends there."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def narrow(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra ones, whatever their names, never reach an operator."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


# ---- numpy views of Arrow text ----


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column as one buffer; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def passes(offsets: np.ndarray, most: int = PASS_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """(B^i, B^-i) modulo 2^64 for i below n at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            step = np.full(n, base, U64)
            step[0] = 1
            _powers[k] = np.multiply.accumulate(step)
    return _powers[0], _powers[1]


def byte_values(seed: int) -> np.ndarray:
    """256 random odd 64-bit values, the same everywhere."""
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


VALUES = byte_values(7)
VALUES_2 = byte_values(11)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (in place)."""
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(_ODD)
    h ^= h >> U64(32)
    return h


class Rolling:
    """Hashes of any substring of a byte buffer from one cumulative sum."""

    def __init__(self, data: np.ndarray, values: np.ndarray = VALUES):
        n = len(data)
        self.up, down = powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values[data] * down[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = self.sums[end] - self.sums[start]
        h *= self.up[start]
        h += (end - start).astype(U64) * U64(_ODD)
        return mix(h)

    def windows(self, k: int) -> np.ndarray:
        """The hash of every k bytes, by start."""
        h = self.sums[k:] - self.sums[:-k]
        h *= self.up[: len(h)]
        h += U64(k * _ODD & (1 << 64) - 1)
        return mix(h)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in a buffer of documents, and where each document's words begin among them."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = ~WHITE[data]
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    first = offsets[:-1][np.diff(offsets) > 0]
    before[first] = False
    after[first[first > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word, and where each document's words begin."""
    starts, ends, at = word_spans(data, offsets)
    return Rolling(LOWER[data] if lower else data).of(starts, ends), at


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n successive values (windows may cross documents; the caller leaves those out)."""
    if len(h) < n:
        return np.zeros(0, U64)
    m = len(h) - n + 1
    out = h[:m].copy()
    for k in range(1, n):
        out *= U64(_ODD)
        out ^= out >> U64(31)
        out += h[k : k + m]
    return mix(out)


def inside(at: np.ndarray, n: int, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of n of `total` values: which stay within a document, and that document."""
    m = max(0, total - n + 1)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))[:m]
    ok = np.arange(m) + n <= at[1:][owner]
    return ok, owner
