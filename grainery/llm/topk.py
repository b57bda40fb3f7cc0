"""Exact top-k search by Fagin's threshold algorithm over sorted per-dimension lists.

Candidates are dealt into blocks by a hash of their id, queries into blocks likewise, and each pair of blocks meets in
one task (an equi-join on the two block numbers; each side is sent once per block of the other, packed as bytes).
A block keeps one list of its candidates per dimension, sorted by value. For a query the lists are read from the end that its
sign makes best, in stretches that grow by half each round: a round reads on in those lists whose next stretch lowers the bound most,
looks up the candidates met for the first time and scores them whole. The bound is the sum of the values at which the lists stand; no candidate
not yet met can exceed it. The search of a block stops as soon as the bound is below the kth score, of this block or of one that the
same task has searched before for this query. A block's kth score only bounds what can be among the k best of all, so the union
of the blocks' answers holds these, and a per-query rank takes them. Where an eighth of a block or less is not yet met, it is scored without reading on.

Components become floor(scale * x), held as doubles (exact: whatever is too large for a fraction is whole). Scores are exact: in
floating point where dims * max|q| * max|x| allows it, otherwise in Python's integers; a score beyond 64 bits is given as the nearest
64-bit number. Vectors that are null, or hold null or non-finite components (also after scaling), take no part; an empty vector scores 0.
Vectors shorter than others count as padded by zeros. A row is a query's own if it has the query's id, so repeats of one id do not
answer for it, and each of them is a candidate of its own for other queries. Equal query rows are one query; different vectors under
one id are queries of their own, each with its k best. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import narrow

#: Rows of a block of candidates, and of queries, at most about.
CANDIDATES, QUERIES = 8192, 4096
SCALE = 64


def quantised(df: DataFrame, id: str, vector: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, q array<double>) of the rows that take part."""
    scaled = lambda c: F.lit(float(scale)) * c.cast("double")
    x = F.transform("vector", lambda c: F.when(F.abs(scaled(c)) < 2.0**52, F.floor(scaled(c)).cast("double")).otherwise(scaled(c)))
    ok = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(scaled(c)) < float("inf")))
    return df.select(F.col(f"`{id}`").alias("vec_id"), F.col(f"`{vector}`").alias("vector")).where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ok).select("vec_id", x.alias("q"))


def blocks(df: DataFrame, n: int, name: str) -> DataFrame:
    """Rows (block, ids, keys, width, values) with a block's vectors as bytes: one row per block. keys tell vectors under one id apart."""
    dealt = df.withColumn("key", F.xxhash64("q")).withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))

    def gather(key, part):
        part = part.combine_chunks().sort_by("vec_id") if len(part) else part
        vectors = part.column("q").combine_chunks()
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        size = np.diff(vectors.offsets.to_numpy())
        width = int(size.max()) if len(size) else 0
        out = np.zeros((len(size), width), "<f8")
        out[np.arange(width) < size[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
        ids, keys = (part.column(c).to_numpy().astype("<i8").tobytes() for c in ("vec_id", "key"))
        return pa.table({name: pa.array([key[0].as_py()], pa.int32()), "ids": [ids], "keys": [keys], "width": pa.array([width], pa.int32()), "values": [out.tobytes()]})

    return dealt.groupBy(name).applyInArrow(gather, f"{name} int, ids binary, keys binary, width int, values binary")


def whole_numbers(x: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def search_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query place, candidate place, score) of the k best candidates of one block for every query, and how many were scored for each.

    floor: for every query a score that the kth of all has at least; it is raised by what this block shows.
    """
    n, dims = x.shape
    reach = float(dims) * max(1.0, float(np.abs(q).max(initial=1))) * max(1.0, float(np.abs(x).max(initial=1)))
    kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else object
    q, x = (whole_numbers(q), whole_numbers(x)) if kind is object else (q.astype(kind), x.astype(kind))
    floor = np.full(len(q), -np.inf, object if kind is object else np.float64) if floor is None else floor
    kth = (lambda v: sorted(v)[n - k]) if kind is object else (lambda v: np.partition(v, n - k)[n - k])
    order = np.argsort(-x, axis=0, kind="stable").T.copy()
    listed = np.take_along_axis(x, order.T, 0).T.copy()
    stretch = max(16, n // 128)
    marks = np.minimum(np.arange(0, n + stretch, stretch), n - 1)  # where the lists may stand
    found: list[list[np.ndarray]] = [[], [], []]
    scored = np.zeros(len(q), np.int64)
    for i in range(len(q)):
        dim = np.flatnonzero(q[i])
        w, up = q[i, dim], q[i, dim] > 0
        seen, scores = np.zeros(n, bool), np.full(n, -np.inf, kind)
        if len(dim):
            stands = w[:, None] * np.where(up[:, None], listed[np.ix_(dim, marks)], listed[np.ix_(dim, n - 1 - marks)])
            depth, every, at_once = np.zeros(len(dim), np.int64), np.arange(len(dim)), min(len(dim), max(4, len(dim) // 4))
            last, step = len(marks) - 1, 1.0
        own = slice(*np.searchsorted(x_ids, q_ids[i], "left").reshape(1), np.searchsorted(x_ids, q_ids[i], "right"))
        n_seen = 0
        while n_seen < n:
            if len(dim) and 8 * n_seen <= 7 * n:
                later = np.minimum(depth + int(step), last)
                some = np.argsort(stands[every, later] - stands[every, depth], kind="stable")[:at_once]
                some, step = some[depth[some] < last], step * 1.5
                if not len(some):  # what these lists had is read
                    fresh = ~seen
                else:
                    fresh = np.zeros(n, bool)
                    for d in some.tolist():
                        low, high = depth[d] * stretch, min(n, later[d] * stretch)
                        fresh[order[dim[d], low:high] if up[d] else order[dim[d], n - high : n - low]] = True
                    depth[some] = later[some]
                    fresh &= ~seen
            else:
                fresh = ~seen
            new = np.flatnonzero(fresh)
            seen |= fresh
            n_seen += len(new)
            scores[new] = x[new] @ q[i] if 4 * len(new) < n else (x @ q[i])[new]  # a product of all is cheaper than a copy of many
            scores[own] = -np.inf
            if n_seen > k and n_seen < n:
                floor[i] = max(floor[i], kth(scores))
            if n_seen < n and len(dim) and stands[every, depth].sum() < floor[i]:
                break
        scored[i] = n_seen
        if n > k:
            floor[i] = max(floor[i], kth(scores))
        best = np.flatnonzero(seen & (scores >= floor[i]) & (x_ids != q_ids[i]))
        best = best[np.lexsort((x_ids[best], -scores[best]))][:k]
        for part, v in zip(found, (np.full(len(best), i), best, scores[best]), strict=True):
            part.append(v)
    at, best, score = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in found)
    if kind is object:
        score = np.array([max(-(2**63), min(2**63 - 1, v)) for v in score], np.int64)
    return at, best, score.astype(np.int64), scored


def search(candidates: DataFrame, queries: DataFrame, k: int = 20, id: str = "vec_id", vector: str = "embedding", scale: int = SCALE, block_rows: tuple[int, int] = (CANDIDATES, QUERIES)) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k best candidates. Both frames hold `id` (a long) and `vector`."""
    some, asked = quantised(narrow(candidates, id, vector), id, vector, scale), quantised(narrow(queries, id, vector), id, vector, scale)
    n_x = max(1, -(-candidates.count() // block_rows[0]))
    n_q = max(1, -(-queries.count() // block_rows[1]))
    asked = asked.dropDuplicates(["vec_id", "q"])
    left = blocks(some, n_x, "bx").withColumn("bq", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    right = blocks(asked, n_q, "bq").select("bq", F.col("ids").alias("q_ids"), F.col("keys").alias("q_keys"), F.col("width").alias("q_width"), F.col("values").alias("q_values")).withColumn("bx", F.explode(F.sequence(F.lit(0), F.lit(n_x - 1))))
    pairs = left.join(right.hint("shuffle_merge"), ["bx", "bq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[int, np.ndarray] = {}  # of the queries of a block, over the candidates that this task has searched
        for batch in batches:
            for row in batch.to_pylist():
                x_ids, q_ids, q_keys = (np.frombuffer(row[c], "<i8") for c in ("ids", "q_ids", "q_keys"))
                width = max(row["width"], row["q_width"])
                x, q = np.zeros((len(x_ids), width)), np.zeros((len(q_ids), width))
                x[:, : row["width"]] = np.frombuffer(row["values"], "<f8").reshape(len(x_ids), row["width"])
                q[:, : row["q_width"]] = np.frombuffer(row["q_values"], "<f8").reshape(len(q_ids), row["q_width"])
                floor = floors.setdefault(row["bq"], np.full(len(q), -np.inf, object))
                for low in range(0, len(q), 512):
                    at, best, score, _ = search_block(q[low : low + 512], q_ids[low : low + 512], x, x_ids, k, floor[low : low + 512])
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[low + at]), pa.array(q_keys[low + at]), pa.array(x_ids[best]), pa.array(score)], ["query_id", "key", "vec_id", "score"])

    found = pairs.select("bq", "ids", "width", "values", "q_ids", "q_keys", "q_width", "q_values").mapInArrow(run, "query_id bigint, key bigint, vec_id bigint, score bigint")
    by = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
