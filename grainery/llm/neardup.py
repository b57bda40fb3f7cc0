"""MinHash near-duplicate detection with tensored banding and exact verification.

Documents are sets of 5-word shingles. Equal sets are one node. Each node gets two small collections of HALVES half
keys, every one made of WIDTH minhashes; a table key is a pair of half keys, one of either collection, so that h half keys
on each side make h^2 tables from only 2 * h * WIDTH minhashes. Half keys that no second node has are dropped before pairs are formed.
At the similarity s of the threshold a pair of texts shares a table with probability (1 - (1 - s^WIDTH)^h)^2, and more above;
h is the least number that lifts it over RECALL (10 at 0.85, 13 at 0.80).

Each table entry is linked to the least node of its table; the components of these tentative links are candidate groups. Groups
are cut into blocks of bounded size, every pair of blocks of a group meets in one task, and there all links between their
whole shingle sets are decided exactly (an inverted index counts intersections); a task returns a spanning forest of the links
it found. Components of these are the result. No table or group is capped, sampled or expanded into pairs of rows.

Null or empty texts have empty sets and are linked with nothing. Rows with equal texts are linked. Rows that share an id
are one vertex. Rows with a null id are linked like others but never name a component: theirs is the least id that they
reach, or null, and where it is null they all stay. Shingles are compared by 64-bit hashes, whole sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, byte_values, grams, mix, passes, text_bytes, word_hashes, written
from .graph import components

SHINGLE, PERCENT = 5, 85
WIDTH, RECALL = 3, 0.9997
#: Nodes and shingles of a block at most about.
BLOCK, BLOCK_SHINGLES = 1024, 2_000_000

_FLIP, _TIMES = byte_values(101), byte_values(103)
#: Nodes of rows that have no id are numbered from here by their prints.
NO_ID = 2**62


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each document one after the other, where each document's begin)."""
    words, at = word_hashes(data, offsets, lower=True)
    h = grams(words, n)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(h[a : b - n + 1]))
        elif b > a:
            out.append(mix(grams(words[a:b], b - a) + U64(b - a)))
        else:
            out.append(np.zeros(0, U64))
    return np.concatenate(out) if out else np.zeros(0, U64), np.cumsum([0] + [len(x) for x in out])


def halves_at(percent: int, width: int = WIDTH) -> int:
    """Half keys of each of the two collections."""
    miss = 1 - (percent / 100) ** width
    return next(h for h in range(1, 1000) if (1 - miss**h) ** 2 >= RECALL)


def half_keys(sets: np.ndarray, at: np.ndarray, halves: int, width: int = WIDTH) -> np.ndarray:
    """(documents with a shingle, 2 * halves): each of `width` minhashes, different for every place."""
    starts = at[:-1][np.diff(at) > 0]
    out = np.zeros((len(starts), 2 * halves), U64)
    if not len(starts):
        return out
    for k in range(2 * halves):
        key = np.full(len(starts), U64(k + 1))
        for w in range(width):
            f = k * width + w
            key = mix(key + np.minimum.reduceat((sets ^ _FLIP[f]) * _TIMES[f], starts))
        out[:, k] = key
    return out


def signatures(df: DataFrame, id: str, text: str, halves: int) -> DataFrame:
    """(doc_id, th, n_shingles, fp1, fp2, halves) per row; the last three null where there is no word. th: a hash of the text."""
    source = df.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.xxhash64(f"`{text}`").alias("th"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in passes(offsets):
                sets, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                size = np.diff(at)
                some = np.flatnonzero(size)
                prints = np.zeros((2, j - i), np.int64)
                for k in some:
                    high = xxhash.xxh3_128_intdigest(sets[at[k] : at[k + 1]].tobytes())
                    prints[:, k] = np.array([high >> 64, high & 2**64 - 1], U64).view(np.int64)
                own: list[np.ndarray | None] = [None] * (j - i)
                for k, row in zip(some, half_keys(sets, at, halves).view(np.int64), strict=True):
                    own[k] = row
                none = size == 0
                ids = [batch.column(c).slice(i, j - i) for c in ("doc_id", "th")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(size), pa.array(prints[0], mask=none), pa.array(prints[1], mask=none), pa.array(own, pa.list_(pa.int64()))], ["doc_id", "th", "n_shingles", "fp1", "fp2", "halves"])

    return source.mapInArrow(run, "doc_id bigint, th bigint, n_shingles bigint, fp1 bigint, fp2 bigint, halves array<bigint>")


def candidate_edges(nodes: DataFrame, halves: int) -> DataFrame:
    """(u, v): every entry of a table with the least node of that table."""
    entries = nodes.select("node", F.posexplode("halves").alias("place", "half"))
    shared = entries.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    mine = entries.join(shared, "half").groupBy("node").agg(F.collect_list(F.when(F.col("place") < halves, F.col("half"))).alias("a"), F.collect_list(F.when(F.col("place") >= halves, F.col("half"))).alias("b"))
    tables = mine.select("node", "b", F.explode("a").alias("a")).select("node", "a", F.explode("b").alias("b")).select("node", F.xxhash64("a", "b").alias("key"))
    least = tables.groupBy("key").agg(F.min("node").alias("v"), F.max("node").alias("most")).where("v < most").select("key", "v")
    return tables.join(least, "key").where("node != v").select(F.col("node").alias("u"), "v").distinct()


def links(sets: list[np.ndarray], side: np.ndarray, node: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the sets of one block, or between the sets of two (side 0 and 1)."""
    parent = list(range(len(sets)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size = np.array([len(s) for s in sets])
    cross = bool(side.any()) and not side.all()
    found = []

    def link(x: int, y: int) -> None:
        a, b = root(x), root(y)
        if a != b:
            parent[b] = a
            found.append((int(node[x]), int(node[y])))

    if len(sets) <= 6:
        for x in range(len(sets)):
            for y in range(x + 1, len(sets)):
                if (not cross or side[x] != side[y]) and 100 * min(size[x], size[y]) >= percent * max(size[x], size[y]) and root(x) != root(y):
                    both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                    if 100 * both >= percent * (size[x] + size[y] - both):
                        link(x, y)
        return found
    values, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(token, kind="stable")
    posted = owner[order]
    count = np.bincount(token, minlength=len(values))
    begin = np.cumsum(count) - count
    first = np.cumsum(size) - size
    for x in range(len(sets)):
        if cross and side[x]:
            continue
        mine = token[first[x] : first[x] + size[x]]
        mine = mine[count[mine] > 1]
        if 100 * len(mine) < percent * size[x]:
            continue
        n = count[mine]
        both = np.bincount(posted[np.repeat(begin[mine] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))], minlength=len(sets))
        ok = 100 * both >= percent * (size + size[x] - both)
        ok[x] = False
        if cross:
            ok &= side == 1
        for y in np.flatnonzero(ok):
            link(x, int(y))
    return found


def verified(documents: DataFrame, groups: DataFrame, id: str, text: str, percent: int) -> DataFrame:
    """(u, v): links that hold between the whole sets of nodes of the same group. groups: (node, th, root, n_shingles)."""
    sizes = groups.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = groups.join(sizes, "root").select("node", "th", "root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"))
    every = documents.select(F.col(f"`{id}`").cast("long").alias("node"), F.col(f"`{text}`").alias("text"))
    nameless = every.where("node IS NULL").groupBy(F.xxhash64("text").alias("th")).agg(F.first("text").alias("text"))
    texts = every.join(placed.where(F.col("node") < NO_ID).drop("th"), "node").unionByName(nameless.join(placed.where(F.col("node") >= NO_ID), "th").drop("th"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            for i, j in passes(offsets):
                sets, at = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                packed = [sets[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("node", "root", "blocks", "own")), pa.array(packed, pa.binary())], ["node", "root", "blocks", "own", "set"])

    packed = texts.select("text", "node", "root", "blocks", "own").mapInArrow(run, "node bigint, root bigint, blocks int, own int, set binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    meet = packed.withColumn("other", other).select("node", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, sets, own, node = None, [], [], []
        out: list[tuple[int, int]] = []

        def close() -> None:
            if len(sets) > 1:
                out.extend(links(sets, np.array(own) != group[1] if group[1] != group[2] else np.zeros(len(sets), bool), np.array(node), percent))

        for batch in batches:
            for r, i, j, o, n, s in zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", "own", "node", "set")), strict=True):
                if (r, i, j) != group:
                    close()
                    group, sets, own, node = (r, i, j), [], [], []
                sets.append(np.frombuffer(s, U64))
                own.append(o)
                node.append(n)
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["u", "v"])
                out.clear()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["u", "v"])

    return meet.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "node").mapInArrow(decide, "u bigint, v bigint")


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of df. percent: the least similarity of a link."""
    halves = halves_at(percent)
    rows = written(signatures(df, id, text, halves), "signatures")
    named = F.min(F.coalesce("doc_id", F.lit(NO_ID) + F.shiftrightunsigned("fp1", 2)))
    nodes = written(rows.where("n_shingles > 0").groupBy("fp1", "fp2").agg(named.alias("node"), F.min("th").alias("th"), F.first("halves").alias("halves"), F.first("n_shingles").alias("n_shingles")), "nodes")
    groups = components(candidate_edges(nodes, halves))
    groups = groups.join(nodes.select("node", "th", "n_shingles"), "node")
    roots = components(verified(df, groups, id, text, percent))
    found = nodes.select("fp1", "fp2", "node").join(roots, "node", "left").select("fp1", "fp2", F.coalesce("root", "node").alias("root"))
    all_rows = rows.select("doc_id", "n_shingles", "fp1", "fp2").join(found, ["fp1", "fp2"], "left")
    component = F.coalesce(F.when(F.col("root") < NO_ID, F.col("root")), F.col("doc_id"))
    return all_rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
