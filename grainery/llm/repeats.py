"""Removal of repeated substrings by bucket-pointer refinement over sampled suffixes.

A byte is removed if a string of `length` bytes that covers it also starts anywhere else. A second, shorter length may be
judged along with it. The starts that matter are found without sorting every suffix:

1. Every start i owns the bytes after it, as many as the shortest length has. Of the q-grams in them the one with the least
   hash (the first, among equals) is its anchor, which depends on these bytes alone, so equal strings have equal anchors at
   equal offsets. Successive starts with one anchor form a unit. The anchor's q-gram is the unit's initial bucket.
2. Buckets with one occurrence are done. Units that are equal as a whole to another unit repeat at all of their starts, and
   only one of them goes on, with their number as its weight.
3. Buckets of unequal units are refined, some whole buckets at a time: every position of their bytes begins in the bucket of
   its q-gram; sorting on (own bucket, bucket at a later offset), the offset as long as what a bucket stands for, gives buckets of
   twice the length, which take the place of the old ones and are the pointers that the next round reads. A position
   alone in its bucket drops out, and with it all that point at it. Starts that are still together when buckets stand for a
   judged length repeat at that length; the buckets of the shorter length are those that the longer one is refined from.
4. Buckets of more than LIMIT different units are first split, in as many rounds as it takes, by the
   identifiers of the bytes that all starts in a block of offsets have in common (down to blocks of one start, where the
   bucket is the string itself), so that no task holds an unbounded group.

Buckets are dealt by 64-bit hashes of q-grams, and whole units compared by such hashes combined with the anchor's. Null texts count
as empty; texts shorter than the shortest length are kept whole; repeated rows remove each other; rows are told apart by id
and text, null ids included. Texts are UTF-8 bytes, and what is left of one may end inside a character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PASS_BYTES, U64, VALUES_2, Rolling, mix, passes, text_bytes, written

LENGTH = 400
#: Different units of a bucket that one task refines at most, and the blocks of starts that larger ones are split into.
LIMIT, BLOCKS = 2048, (128, 16, 1)
#: Units with more copies than HOT, and than a thousandth of all rows (so under a thousand units), are joined in SALTS parts.
HOT, SALTS = 1000, 64
_PLACE = 26
_A, _B = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)
_ALL = 2**64 - 1
NO_ID = -(2**63)


def least_in_windows(h: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every `width` successive values."""
    n = len(h)
    if n < width:
        return np.zeros(0, h.dtype)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(h.dtype).max, h.dtype)
    padded[:n] = h
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def gram(lengths: tuple[int, ...]) -> int:
    """Bytes of an anchor."""
    return max(1, min(lengths) // 5)


def units(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...] = (LENGTH,), most: int | None = None) -> tuple[np.ndarray, ...]:
    """(document, lo, hi, stop, anchor, bucket, whole) of the units of documents in one buffer, of each document's first `most` starts.

    Places count from each document's start; the strings of a unit's starts end at stop at the latest.
    """
    shortest, longest, q = min(lengths), max(lengths), gram(lengths)
    if len(data) < shortest:
        return tuple(np.zeros(0, np.int64) for _ in range(5)) + (np.zeros(0, U64), np.zeros(0, U64))
    grams = Rolling(data).windows(q)
    bits = max(_PLACE, int(len(grams)).bit_length())
    keyed = (grams >> U64(bits) << U64(bits)) | np.arange(len(grams), dtype=U64)
    anchor = (least_in_windows(keyed, shortest - q + 1) & U64((1 << bits) - 1)).astype(np.int64)
    many = np.maximum(0, np.diff(offsets) - shortest + 1)
    if most is not None:
        many = np.minimum(many, most)
    owner = np.repeat(np.arange(len(many)), many)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + offsets[:-1][owner]
    at = anchor[start]
    cut = np.ones(len(start), bool)
    cut[1:] = (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(start)) - 1
    lo, hi, p, doc = start[first], start[last], at[first], owner[first]
    stop = np.minimum(hi + longest, offsets[1:][doc])
    whole = Rolling(data, VALUES_2).of(lo, stop)
    whole = mix(whole + (p - lo).astype(U64) * _A)
    base = offsets[:-1][doc]
    return doc, lo - base, hi - base, stop - base, p - base, grams[p], whole


def _segments(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> Iterator[tuple[int, int, tuple[np.ndarray, ...]]]:
    """(first row, place in it, units): rows in passes, and a long row in overlapping segments (units may be cut anywhere)."""
    for i, j in passes(offsets):
        if j == i + 1 and offsets[j] - offsets[i] > 2 * PASS_BYTES:
            size = int(offsets[j] - offsets[i])
            for low in range(0, size - min(lengths) + 1, PASS_BYTES):
                part = data[offsets[i] + low : offsets[i] + min(size, low + PASS_BYTES + max(lengths) - 1)]
                yield i, low, units(part, np.array([0, len(part)]), lengths, PASS_BYTES)
        else:
            yield i, 0, units(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lengths)


def _keyed(df: DataFrame, id: str, text: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(did, th, text, carried): rows are told apart by a number for the id and a hash of the text."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(F.coalesce(F.col(f"`{id}`").cast("long"), F.lit(NO_ID)).alias("did"), F.xxhash64(body).alias("th"), body.alias("text"), *[F.col(f"`{c}`").alias(f"carry_{c}") for c in carry])


UNIT = "did bigint, th bigint, lo int, hi int, stop int, p int, bucket bigint, whole bigint"
RUN = "did bigint, th bigint, lo int, hi int, length int"


def all_units(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = (batch.column(c).to_numpy() for c in ("did", "th"))
            data, offsets = text_bytes(batch.column("text"))
            for i, low, (doc, *places, bucket, whole) in _segments(data, offsets, lengths):
                if len(doc):
                    columns = [did[i + doc], th[i + doc], *((x + low).astype(np.int32) for x in places), bucket.view(np.int64), whole.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in UNIT.split(", ")])

    return rows.select("did", "th", "text").mapInArrow(run, UNIT)


def ladder(lengths: tuple[int, ...]) -> list[int]:
    """What buckets stand for, round by round: each at most twice the one before, and every judged length among them."""
    out = [min(lengths)]
    while out[0] > 32:
        out.insert(0, -(-out[0] // 2))
    for n in sorted(lengths):
        while 2 * out[-1] < n:
            out.append(2 * out[-1])
        if n > out[-1]:
            out.append(n)
    return out


def _named(keys: np.ndarray) -> np.ndarray:
    """A number for each key that occurs twice or more, and -1 for the others."""
    _, name, count = np.unique(keys, return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    number[count == 1] = -1
    return number[name]


def _refine(rows: list[tuple[int, int, int, int, int, int, bytes]], lengths: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Of units (bucket, did, th, lo, hi, weight, bytes): (did, th, lo, hi, length) of the runs of starts that repeat, for units of weight 1."""
    text = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
    span = np.array([len(r[6]) for r in rows])
    end = np.cumsum(span)
    room = np.repeat(end, span) - np.arange(len(text))  # bytes of its own unit from each position on
    size = np.array([r[4] - r[3] + 1 for r in rows])
    unit = np.repeat(np.arange(len(rows)), size)
    start = np.arange(len(unit)) - np.repeat(np.cumsum(size) - size, size)
    place = (end - span)[unit] + start
    weight = np.array([min(2, r[5]) for r in rows])
    out: list[list[np.ndarray]] = [[] for _ in range(5)]
    bucket, held = np.full(len(text), -1), 0
    for n in ladder(lengths):
        if held:  # the pointer to the bucket of the later part decides among those of one bucket
            on = np.flatnonzero((bucket >= 0) & (room >= n))
            later = bucket[on + n - held]
            on, later = on[later >= 0], later[later >= 0]
            keys = bucket[on] * (1 + int(bucket.max(initial=0))) + later
        else:
            on = np.flatnonzero(room >= n)
            keys = Rolling(text, VALUES_2).windows(n)[on]
        refined = np.full(len(text), -1)
        refined[on] = _named(keys)
        bucket, held = refined, n
        if n in lengths:
            mine = bucket[place]
            some = np.flatnonzero(mine >= 0)
            together = np.bincount(mine[some], weight[unit[some]]) >= 2
            on = some[together[mine[some]] & (weight[unit[some]] == 1)]
            cut = np.ones(len(on), bool)
            cut[1:] = (on[1:] != on[:-1] + 1) | (unit[on[1:]] != unit[on[:-1]])
            first = np.flatnonzero(cut)
            last = np.append(first[1:], len(on)) - 1 if len(on) else first
            u = unit[on[first]]
            lo = np.array([r[3] for r in rows])[u]
            for k, x in enumerate((np.array([r[1] for r in rows], np.int64)[u], np.array([r[2] for r in rows], np.int64)[u], lo + start[on[first]], lo + start[on[last]], np.full(len(u), n))):
                out[k].append(x)
        if not (bucket >= 0).any():
            break
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def refined(contexts: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(did, th, lo, hi, length): repeating starts of units (bucket, did, th, lo, hi, weight, bytes, ...) whose buckets are bounded."""
    names = ("bucket", "did", "th", "lo", "hi", "weight", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        bytes_held = 0

        def close(rows: list[tuple]) -> pa.RecordBatch:
            did, th, lo, hi, length = _refine(rows, lengths) if rows else (np.zeros(0, np.int64),) * 5
            return pa.RecordBatch.from_arrays([pa.array(did), pa.array(th), *(pa.array(x.astype(np.int32)) for x in (lo, hi, length))], [c.split()[0] for c in RUN.split(", ")])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if bytes_held > PASS_BYTES and row[0] != held[-1][0]:
                    yield close(held)
                    held, bytes_held = [], 0
                held.append(row)
                bytes_held += len(row[6])
        yield close(held)

    return contexts.select(*names).repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, RUN)


def split(contexts: DataFrame, block: int, lengths: tuple[int, ...]) -> DataFrame:
    """The same units cut into blocks of starts; a block's bucket also has the bytes that all its starts have in common."""
    shortest, longest = min(lengths), max(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for bucket, did, th, lo, hi, stop, p, weight, body in zip(*(batch.column(c).to_pylist() for c in ("bucket", "did", "th", "lo", "hi", "stop", "p", "weight", "bytes")), strict=True):
                names, other = Rolling(np.frombuffer(body, np.uint8)), Rolling(np.frombuffer(body, np.uint8), VALUES_2)
                for b in range((p - hi) // block, (p - lo) // block + 1):
                    far, near = (b + 1) * block - 1, b * block
                    a, z = max(lo, p - far), min(hi, p - near)
                    y = min(z + longest, stop)
                    common = names.of(np.array([p - near - lo]), np.array([p - far + shortest - lo]))
                    inner = mix(common + np.array([bucket], np.int64).view(U64) * _A + U64(b * int(_B) & _ALL))
                    whole = mix(other.of(np.array([a - lo]), np.array([y - lo])) + U64((p - a) * int(_A) & _ALL))
                    out.append((did, th, a, z, y, p, int(inner.view(np.int64)[0]), int(whole.view(np.int64)[0]), weight, body[a - lo : y - lo]))
            columns = list(zip(*out, strict=True)) if out else [[]] * 10
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, *[pa.int64()] * 3, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*(c.split()[0] for c in UNIT.split(", ")), "weight", "bytes"])

    return contexts.mapInArrow(run, f"{UNIT}, weight bigint, bytes binary")


def _runs(rows: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """(did, th, lo, hi, length): of units, the starts whose strings of each length lie within them."""
    each = F.array(*[F.struct(F.least("hi", F.col("stop") - n).alias("hi"), F.lit(n).alias("length")) for n in lengths])
    return rows.select("did", "th", "lo", F.explode(each).alias("r")).select("did", "th", "lo", "r.hi", "r.length").where("hi >= lo")


def _level(rows: DataFrame, lengths: tuple[int, ...], extra: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of units (bucket, whole, weight, ...): (those in a bucket that occurs twice or more, those equal to another as a whole, one of each
    different unit with the summed weight and `units`, the number of different units in its bucket, where that is above 1)."""
    # written, as a join splits a hot bucket only where both of its sides come straight from an exchange
    busy = written(rows.groupBy("bucket").agg(F.sum("weight").alias("occurrences")).where("occurrences > 1").select("bucket"), "busy")
    rows = written(rows.join(busy, "bucket"), "units")
    firsts = [F.first(c).alias(c) for c in ["did", "th", "lo", "hi", "stop", "p", *extra]]
    each = written(rows.groupBy("bucket", "whole").agg(F.sum("weight").alias("total"), F.count("*").alias("copies"), *firsts), "each")
    hot = max(HOT, rows.count() // 1000)
    several = each.where("total > 1")
    common = F.broadcast(several.where(F.col("copies") > hot).select("bucket", "whole", F.lit(SALTS).alias("salts")))  # under a thousand, by the choice of hot
    salt = F.coalesce(F.pmod(F.xxhash64("did", "th", "lo"), F.col("salts")).cast("int"), F.lit(0))
    salted = rows.where("weight = 1").join(common, ["bucket", "whole"], "left").withColumn("salt", salt)
    keys = several.select("bucket", "whole", F.explode(F.sequence(F.lit(0), F.when(F.col("copies") > hot, SALTS - 1).otherwise(0))).alias("salt"))
    whole = _runs(salted.join(keys, ["bucket", "whole", "salt"]), lengths)
    mixed = written(each.groupBy("bucket").agg(F.count("*").alias("units")).where("units > 1"), "mixed")
    one = each.drop("copies").withColumnRenamed("total", "weight").join(mixed, "bucket")
    return rows, whole, one


def repeated_starts(df: DataFrame, id: str = "doc_id", text: str = "text", lengths: tuple[int, ...] = (LENGTH,)) -> DataFrame:
    """(did, th, lo, hi, length): runs of starts (first and last, in bytes) of strings of each length that also start elsewhere."""
    rows = _keyed(df, id, text)
    everything = written(all_units(rows, lengths), "anchors").withColumn("weight", F.lit(1).cast("long"))
    _, found, one = _level(everything, lengths, [])
    need = one.groupBy("did", "th").agg(F.collect_list(F.struct("bucket", "lo", "hi", "stop", "p", "weight", "units")).alias("parts"))
    # rows that repeat as a whole have the same units: any one of them serves
    with_text = rows.select("did", "th", F.col("text").cast("binary").alias("body")).join(need.hint("shuffle_hash"), ["did", "th"])
    parts = with_text.select("did", "th", "body", F.explode("parts").alias("u")).select("did", "th", F.col("u.*"), F.substring("body", F.col("u.lo") + 1, F.col("u.stop") - F.col("u.lo")).alias("bytes"))
    contexts = written(parts, "contexts")
    for block in [b for b in BLOCKS if b < min(lengths)]:
        found = found.unionByName(refined(contexts.where(F.col("units") <= LIMIT), lengths))
        large = contexts.where(F.col("units") > LIMIT)
        if not large.limit(1).count():
            return found
        rows, whole, one = _level(split(large, block, lengths), lengths, ["bytes"])
        found = found.unionByName(whole)
        if block > 1:
            contexts = written(one, "contexts")
    # a bucket of one start is the string of the shortest length; of the longer one, whole units have told
    return found.unionByName(_runs(rows.where("weight = 1"), lengths[:1]))


def _spans(lo: np.ndarray, end: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the union of the spans."""
    order = np.argsort(lo, kind="stable")
    lo, reach = lo[order], np.maximum.accumulate(end[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    return lo[heads].tolist(), (reach[np.append(heads[1:], len(lo)) - 1] if len(lo) else reach).tolist()


def remove_repeats(df: DataFrame, id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = (), emit_text: bool = False, length: int = LENGTH, passage: int | None = None) -> DataFrame:
    """Per row (doc_id, n_bytes, n_removed, n_spans, kept_sha256, then if asked for n_passage_bytes, the carried columns and kept_text).

    length: bytes of the strings that are removed. passage: a shorter length; n_passage_bytes counts the bytes that a string of so
    many bytes covers which also starts elsewhere. kept_text leaves out characters that were cut.
    """
    lengths = (length,) if passage is None else (passage, length)
    if passage is not None and not 0 < passage < length:
        raise ValueError("passage must be positive and below length")
    starts = repeated_starts(df, id, text, lengths)
    spans = starts.groupBy("did", "th").agg(F.collect_set(F.struct("lo", "hi", "length")).alias("spans"))
    joined = _keyed(df, id, text, carry).join(spans.hint("shuffle_hash"), ["did", "th"], "left").drop("th")
    kinds = {f.name: f.dataType.simpleString() for f in joined.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for body, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                body = body.as_buffer().to_pybytes()
                kept, n_spans, at, n_passage = [], 0, 0, 0
                if spans.is_valid:
                    lo, hi, judged = (spans.values.field(k).to_numpy() for k in range(3))
                    for n in lengths:
                        heads, ends = _spans(lo[judged == n], hi[judged == n] + n)
                        if n < length:
                            n_passage = sum(ends) - sum(heads)
                            continue
                        for a, b in zip(heads, ends, strict=True):
                            kept.append(body[at:a])
                            at, n_spans = b, n_spans + 1
                kept.append(body[at:])
                left = b"".join(kept)
                rows.append((len(body), len(body) - len(left), n_spans, hashlib.sha256(left).hexdigest(), n_passage, left.decode("utf-8", "ignore") if emit_text else None))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            did = batch.column("did").to_numpy()
            out = [pa.array(did, mask=did == NO_ID), *(pa.array(columns[k], pa.int64()) for k in range(3)), pa.array(columns[3], pa.string())]
            out += [pa.array(columns[4], pa.int64())] if passage is not None else []
            out += [batch.column(f"carry_{c}") for c in carry] + ([pa.array(columns[5], pa.string())] if emit_text else [])
            yield pa.RecordBatch.from_arrays(out, [c.split()[0] for c in schema.replace("`", "").split(", ")[: 5 + (passage is not None)]] + [*carry, *(["kept_text"] if emit_text else [])])

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + (", n_passage_bytes bigint" if passage is not None else "")
    more = "".join(f", `{c}` {kinds[f'carry_{c}']}" for c in carry) + (", kept_text string" if emit_text else "")
    return joined.mapInArrow(run, schema + more)
