"""Ranked retrieval: BM25 postings, exact nearest neighbours, rank fusion and the steps after it.

All functions take frames with a query key (`qid`) and a result key (`key`), so that any number of queries run as one job. Ranks
order by score rounded to nine places, then by key.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainery.functions.text import code_tokens

K1, B = 1.2, 0.75
#: Query vectors that one pass over the candidates compares at most (they are broadcast).
QUERY_BATCH = 16_384
#: Queries and candidates of one matrix of scores, and found pairs that a task gathers before it cuts them to the best.
QUERY_BLOCK, ROW_BLOCK, GATHERED = 512, 2048, 1 << 20


def ranked(df: DataFrame, score: str = "score", by: str = "qid", key: str = "key") -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round(score, 9)), key)))


def top(df: DataFrame, k: int, score: str = "score", by: str = "qid", key: str = "key") -> DataFrame:
    return ranked(df, score, by, key).where(F.col("rank") <= k)


def postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(term, key, tf, dl): how often a term occurs in a text, and the text's length in terms."""
    tokens = rows.select(F.col(key).alias("key"), code_tokens(F.col(text)).alias("tokens"))
    return tokens.select("key", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("term", "key").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def text_stats(corpus: DataFrame, text: str) -> DataFrame:
    """(n, avgdl): the number of texts and their mean length in terms."""
    return corpus.select(F.count("*").alias("n"), F.avg(F.size(code_tokens(F.col(text)))).alias("avgdl"))


#: Pairs of query and term that go out to the tasks at most; beyond it the postings of all terms are joined with the asked ones.
ASKED_PAIRS = 200_000
#: Sums of one block of texts and queries.
SUMS = 1 << 21


class Asked:
    """Queries by term: `owners` and `factors` of term c stand from starts[c] to starts[c + 1]; `codes` numbers the terms, `qids` the queries."""

    def __init__(self, qids: pa.Array, terms: list[str], factors: np.ndarray):
        coded = qids.dictionary_encode(null_encoding="encode")
        self.qids, self.codes = coded.dictionary, {t: c for c, t in enumerate(sorted(set(terms)))}
        code = np.array([self.codes[t] for t in terms], np.int64)
        order = np.argsort(code, kind="stable")
        self.owners, self.factors = coded.indices.to_numpy()[order].astype(np.int64), np.asarray(factors, np.float64)[order]
        self.starts = np.searchsorted(code[order], np.arange(len(self.codes) + 1))

    def __len__(self) -> int:
        return len(self.qids)

    def block(self) -> int:
        """Texts whose sums and products stay within SUMS."""
        return max(1, SUMS // max(1, len(self.owners), len(self)))

    def dots(self, text: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """The dot products of every query with each of n texts, given by postings (text, code, weight); -inf where they share no term."""
        many = self.starts[code + 1] - self.starts[code]
        at = np.arange(many.sum()) + np.repeat(self.starts[code] - (np.cumsum(many) - many), many)
        cell = self.owners[at] * n + np.repeat(text, many)
        sums = np.bincount(cell, np.repeat(weight, many) * self.factors[at], minlength=len(self) * n).astype(np.float64)  # whole numbers where it is empty
        sums[np.bincount(cell, minlength=len(self) * n) == 0] = -np.inf
        return sums.reshape(len(self), n)


def _asked(rows: DataFrame) -> Asked | None:
    """Of rows (qid, term, factor); None if they are too many to be sent out."""
    found = rows.limit(ASKED_PAIRS + 1).toArrow().combine_chunks()
    if found.num_rows > ASKED_PAIRS:
        return None
    qid = found.column("qid").combine_chunks()
    return Asked(qid if isinstance(qid, pa.Array) else pa.array([], qid.type), found.column("term").to_pylist(), found.column("factor").to_numpy())


#: Kinds of bytes (1 capital, 2 small, 3 digit, 0 other) and their small forms; bytes of texts that are split at once, at least one text.
KIND, SMALL, SPLIT_BYTES = np.zeros(256, np.int8), np.arange(256, dtype=np.uint64), 1 << 20
KIND[65:91], KIND[97:123], KIND[48:58], SMALL[65:91] = 1, 2, 3, np.arange(97, 123)
#: A factor of sums over bytes modulo 2^64, and its inverse.
FACTOR, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def code_tokens_of(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, hash) of the tokens that code_tokens finds in texts of UTF-8 bytes, which begin at `begins`; the hash is that of the small form.

    Runs of one kind are tokens; a capital by itself goes with the small letters after it.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    kind, edge, border = KIND[data], np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    border[begins] = True
    edge[1:n] = kind[1:] != kind[:-1]
    edge |= border
    start = np.flatnonzero(edge[:n])
    end, kind = np.append(start[1:], n), kind[start]
    joined = np.zeros(len(start) + 1, bool)
    joined[1:-1] = (kind[1:] == 2) & (kind[:-1] == 1) & (end[:-1] - start[:-1] == 1) & ~border[start[1:]]
    end = np.where(joined[1:], np.append(end[1:], n), end)
    own = (kind > 0) & ~joined[:-1]
    start, end = start[own], end[own]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(SMALL[data] * _powers(FACTOR, n), dtype=np.uint64)])
    value = (sums[end] - sums[start]) * _powers(INVERSE, n)[start]
    return start, end, value ^ ((end - start).astype(np.uint64) << np.uint64(48))


def split_texts(batches: Iterator[pa.RecordBatch], codes: dict[str, int], block: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of batches (key, text), at most `block` texts at once: their keys and lengths in terms (-1: no text), and the postings (text, code, tf) of the coded terms.

    Terms are found by hashes of 64 bits.
    """
    terms = np.frombuffer("".join(codes).encode(), np.uint8)
    at = np.cumsum([0] + [len(t) for t in codes])[:-1]
    known = code_tokens_of(terms, at)[2]
    order = np.argsort(known)
    known, numbers = known[order], np.array(list(codes.values()), np.int64)[order]
    for batch in batches:
        text = batch.column("text").cast(pa.binary())
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        low = 0
        while low < len(text):
            high = min(low + block, max(low + 1, int(np.searchsorted(offsets, offsets[low] + SPLIT_BYTES, "right")) - 1))
            begins = offsets[low : high + 1] - offsets[low]
            start, _, value = code_tokens_of(data[offsets[low] : offsets[high]], begins)
            owner = np.searchsorted(begins, start, "right") - 1
            sizes = np.bincount(owner, minlength=high - low)
            sizes[text.slice(low, high - low).is_null().to_numpy(zero_copy_only=False)] = -1
            place = np.minimum(np.searchsorted(known, value), max(0, len(known) - 1))
            hit = known[place] == value if len(known) else np.zeros(len(value), bool)
            cell, tf = np.unique(owner[hit] * max(1, len(codes)) + numbers[place[hit]], return_counts=True)
            yield batch.column("key").slice(low, high - low), sizes, cell // max(1, len(codes)), cell % max(1, len(codes)), tf
            low = high


def bm25(corpus: DataFrame, queries: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """(qid, key, score, rank) of the k best texts of each query (qid, query) by the sum over its distinct terms.

    The texts are read twice, once for the statistics of the asked terms and once for the scores, of which every task keeps its k best a query; no
    postings are shuffled. Where a key has several texts, their postings are joined by key instead.
    """
    spark = corpus.sparkSession
    terms = queries.select("qid", F.explode(F.array_distinct(code_tokens(F.col("query")))).alias("term")).distinct()
    asked = _asked(terms.select("qid", "term", F.lit(1.0).alias("factor")))
    if asked is None or corpus.groupBy(key).count().where("count > 1").limit(1).count():
        return bm25_stored(postings(corpus, key, text), text_stats(corpus, text), queries, k)
    shared = spark.sparkContext.broadcast(asked)
    rows = corpus.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value.codes
        df, n, texts, length = np.zeros(len(codes), np.int64), 0, 0, 0
        for keys, sizes, _, code, _ in split_texts(batches, codes, 1024):
            df += np.bincount(code, minlength=len(codes))
            n, texts, length = n + len(keys), texts + int((sizes >= 0).sum()), length + int(sizes[sizes >= 0].sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1, -2, -3], some]), pa.int32()), pa.array(np.concatenate([[n, texts, length], df[some]]), pa.int64())], ["code", "n"])

    counted = {r["code"]: r["n"] for r in rows.mapInArrow(count, "code int, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow().to_pylist()}
    n, mean = counted.get(-1, 0), counted.get(-3, 0) / max(1, counted.get(-2, 0)) or 1.0
    df = np.array([counted.get(c, 0) for c in range(len(asked.codes))], np.float64)
    idf = spark.sparkContext.broadcast(np.log(1 + (n - df + 0.5) / (df + 0.5)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best, every = Best(len(asked), k), np.arange(len(asked))
        for keys, sizes, doc, code, tf in split_texts(batches, asked.codes, asked.block()):
            weight = idf.value[code] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / mean))
            best.add(every, asked.dots(doc, code, weight, len(keys)), keys)
        yield from best.batches(asked.qids, ["qid", "key", "score"])

    return top(few_parts(rows).mapInArrow(score, f"qid {type_of(queries, 'qid')}, key {type_of(rows, 'key')}, score double"), k)


def type_of(rows: DataFrame, name: str) -> str:
    return rows.schema[name].dataType.simpleString()


def bm25_stored(posted: DataFrame, stats: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The same over stored postings: only those of the asked terms are counted and weighed."""
    asked = queries.select("qid", F.explode(F.array_distinct(code_tokens(F.col("query")))).alias("term"))
    posted = posted.join(asked.select("term").distinct(), "term", "left_semi")
    return _weighed(posted, stats.select("n", "avgdl"), queries, k)


def _weighed(posted: DataFrame, stats: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best by postings of the asked terms (term, key, tf, dl) and statistics (n, avgdl) of one row."""
    asked = queries.select("qid", F.explode(F.array_distinct(code_tokens(F.col("query")))).alias("term"))
    df = posted.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.coalesce(F.nullif("avgdl", F.lit(0.0)), F.lit(1.0))))
    weighted = asked.join(df, "term").select("qid", "term", "df").join(posted, "term").crossJoin(F.broadcast(stats))  # one row
    return top(weighted.groupBy("qid", "key").agg(F.sum(part).alias("score")), k)


class Best:
    """The k best candidates of each of n queries, by score rounded to nine places, then by key; fed with blocks of scores. What it holds follows n * k."""

    def __init__(self, n: int, k: int):
        self.k, self.least, self.parts, self.gathered = k, np.full(n, np.finfo(np.float64).min), [], 0

    def add(self, rows: np.ndarray, score: np.ndarray, keys: pa.Array, tag: int = 0) -> None:
        """rows: query numbers; score: a row for each of them and a column for each key, -inf or nan where there is no pair; tag: a number that stays with the block's pairs."""
        least = self.least[rows]
        first = least == np.finfo(np.float64).min
        if score.shape[1] > self.k and first.any():  # the block's own k-th best is a bound
            some = score[first]
            some[np.isnan(some)] = -np.inf
            least[first] = np.maximum(least[first], np.partition(some, -self.k, axis=1)[:, -self.k] - 2e-9)
            self.least[rows] = least
        q, c = np.nonzero(score >= least[:, None])
        if len(q):
            self.parts.append((rows[q], score[q, c], np.full(len(q), tag, np.int32), keys.take(pa.array(c))))
            self.gathered += len(q)
            if self.gathered > GATHERED:
                self._cut()

    def _cut(self) -> None:
        q, s, tags = (np.concatenate([p[i] for p in self.parts]) for i in (0, 1, 2))
        keys = pa.concat_arrays([p[3] for p in self.parts])
        near = np.round(s, 9)
        if pa.types.is_integer(keys.type) and not keys.null_count:
            order = np.lexsort((keys.to_numpy(), -near, q))
        else:
            order = pc.sort_indices(pa.table({"q": q, "s": near, "k": keys}), sort_keys=[("q", "ascending"), ("s", "descending"), ("k", "ascending")], null_placement="at_start").to_numpy()
        q = q[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        order, q, place = order[place < self.k], q[place < self.k], place[place < self.k]
        full = place == self.k - 1
        self.least[q[full]] = np.maximum(self.least[q[full]], near[order[full]] - 1e-9)
        self.parts, self.gathered = [(q, s[order], tags[order], keys.take(pa.array(order)))], 0

    def batches(self, qids: pa.Array, names: list[str], tagged: pa.Array | None = None) -> Iterator[pa.RecordBatch]:
        """tagged: the values of the tags, as a last column."""
        if self.parts:
            self._cut()
            q, s, tags, keys = self.parts[0]
            more = [] if tagged is None else [tagged.take(pa.array(tags))]
            whole = pa.RecordBatch.from_arrays([qids.take(pa.array(q)), keys, pa.array(s), *more], names)
            for low in range(0, whole.num_rows, 65_536):
                yield whole.slice(low, 65_536)


def vectors(column: pa.Array) -> np.ndarray:
    """A matrix in doubles of vectors of one length; null components are nan."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != sizes[0]).any():
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def few_parts(rows: DataFrame) -> DataFrame:
    """No more parts than the cluster can use: each sends its own best of every query, so that more of them would only add rows to the shuffle."""
    return rows.coalesce(max(32, 2 * rows.sparkSession.sparkContext.defaultParallelism))


def nearest(batches: Iterator[pa.RecordBatch], ids: np.ndarray, q: np.ndarray, k: int, metric: str, skip_self: bool) -> Iterator[pa.RecordBatch]:
    """(qid, key, score): of batches (key, v) the k nearest to each of the query vectors q, by blocks of scores of a fixed size."""
    best, norm, square = Best(len(ids), k), np.linalg.norm(q, axis=1), (q * q).sum(1)
    for batch in batches:
        for low in range(0, batch.num_rows, ROW_BLOCK):
            part = batch.slice(low, ROW_BLOCK)
            x, keys = vectors(part.column("v")), part.column("key").cast(pa.int64())
            own, size = keys.to_numpy(), np.linalg.norm(x, axis=1) if metric == "cosine" else (x * x).sum(1)
            for at in range(0, len(ids), QUERY_BLOCK):
                rows = np.arange(at, min(at + QUERY_BLOCK, len(ids)))
                score = q[rows] @ x.T
                if metric == "cosine":
                    long = norm[rows, None] * size
                    score = np.divide(score, long, out=np.zeros_like(score), where=long > 0)
                else:
                    score = 2 * score - square[rows, None] - size
                if skip_self:
                    score[ids[rows, None] == own] = -np.inf
                best.add(rows, score, keys)
    yield from best.batches(pa.array(ids), ["qid", "key", "score"])


def knn(candidates: DataFrame, queries: DataFrame, k: int, key: str, vector: str, metric: str = "cosine", skip_self: bool = True) -> DataFrame:
    """(qid, key, score, rank) of the k nearest candidates of every query row; score is the cosine or minus the squared distance.

    Query vectors go out in batches of QUERY_BATCH; for each batch every task keeps only its own k best per query, from blocks of scores of a fixed size.
    """
    spark = candidates.sparkSession
    asked = queries.select(F.col(key).alias("key"), F.col(vector).alias("v")).where(F.col("v").isNotNull())
    n = max(1, -(-asked.count() // QUERY_BATCH))
    parts = []
    for b in range(n):
        some = asked.where(F.pmod(F.xxhash64("key"), F.lit(n)) == b).orderBy("key").toArrow().combine_chunks()
        if not some.num_rows:
            continue
        ids = some.column("key").to_numpy().astype(np.int64)
        q = vectors(some.column("v").combine_chunks())
        shared = spark.sparkContext.broadcast((ids, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            yield from nearest(batches, *shared.value, k, metric, skip_self)

        source = candidates.select(F.col(key).alias("key"), F.col(vector).alias("v")).where(F.col("key").isNotNull() & F.col("v").isNotNull())
        parts.append(few_parts(source).mapInArrow(run, "qid bigint, key bigint, score double"))
    if not parts:
        return spark.createDataFrame([], "qid bigint, key bigint, score double, rank int")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return top(found, k)


def rrf(legs: dict[str, DataFrame], k: int) -> DataFrame:
    """Reciprocal-rank fusion: the sum of 1 / (60 + rank) over the legs; `why` names the leg, or hybrid if there were several."""
    frames = [leg.select("qid", "key", (1 / (60 + F.col("rank"))).alias("s"), F.lit(name).alias("leg")) for name, leg in legs.items()]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    fused = rows.groupBy("qid", "key").agg(F.sum("s").alias("score"), F.count("*").alias("n"), F.min("leg").alias("leg"))
    return top(fused.select("qid", "key", "score", F.when(F.col("n") > 1, "hybrid").otherwise(F.col("leg")).alias("why")), k)


def refuse(hits: DataFrame, other: DataFrame, weight: float, missing: int = 1000) -> DataFrame:
    """Hits scored anew from their own rank and the rank in another leg; hits that the leg lacks count as ranked `missing`."""
    joined = hits.select("qid", "key", "rank").join(other.select("qid", "key", F.col("rank").alias("other")), ["qid", "key"], "left")
    return ranked(joined.select("qid", "key", ((1 - weight) / (60 + F.col("rank")) + weight / (60 + F.coalesce("other", F.lit(missing)))).alias("score")))


def sparse_dot(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """index (key, token, weight), queries (qid, token, weight): the k best dot products.

    Only asked tokens of the index go on, gathered by key; the products are summed a key at a time, so that pairs of query and posting are never rows.
    """
    spark = index.sparkSession
    index, queries = index.where("weight IS NOT NULL"), queries.where("token IS NOT NULL AND weight IS NOT NULL")
    asked = _asked(queries.select("qid", F.col("token").alias("term"), F.col("weight").cast("double").alias("factor")))
    if asked is None:
        pairs = queries.select("qid", "token", F.col("weight").alias("q")).join(index, "token")
        return top(pairs.groupBy("qid", "key").agg(F.sum(F.col("q") * F.col("weight")).alias("score")), k)
    shared = spark.sparkContext.broadcast(asked)
    codes = F.broadcast(spark.createDataFrame(list(asked.codes.items()), "token string, code bigint"))
    # the half join is pushed below what forms the index, the other gives the numbers
    few = index.join(codes.select("token"), "token", "left_semi").join(codes, "token").select("key", "code", F.col("weight").cast("double").alias("weight"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        best, every = Best(len(asked), k), np.arange(len(asked))
        for keys, doc, part in by_key(batches, asked.block()):
            code, weight = (part.column(c).to_numpy() for c in ("code", "weight"))
            best.add(every, asked.dots(doc, code, weight, len(keys)), keys)
        yield from best.batches(asked.qids, ["qid", "key", "score"])

    schema = f"qid {type_of(queries, 'qid')}, key {type_of(few, 'key')}, score double"
    return top(few.repartition("key").sortWithinPartitions("key").mapInArrow(score, schema), k)


def by_key(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[pa.Array, np.ndarray, pa.RecordBatch]]:
    """Of batches sorted by `key`, at most `block` whole keys at once: the keys, and the rows with their key's place."""
    held = None
    for batch in chain(batches, [None]):
        if batch is not None and not batch.num_rows:
            continue
        rows = held if batch is None else batch if held is None else pa.concat_batches([held, batch])
        if rows is None:
            return
        key = rows.column("key")
        a, b = key.slice(0, len(key) - 1), key.slice(1)
        new = pc.fill_null(pc.not_equal(a, b), True).to_numpy(zero_copy_only=False) & ~(pc.is_null(a).to_numpy(zero_copy_only=False) & pc.is_null(b).to_numpy(zero_copy_only=False))
        starts = np.concatenate([[0], np.flatnonzero(new) + 1])
        ends = np.append(starts[1:], len(key))
        whole = len(starts) if batch is None else len(starts) - 1  # the last key may go on
        for low in range(0, whole, block):
            first, last = starts[low], ends[min(low + block, whole) - 1]
            at = starts[low : min(low + block, whole)]
            yield key.take(pa.array(at)), np.searchsorted(at, np.arange(first, last), "right") - 1, rows.slice(first, last - first)
        held = None if batch is None else rows.slice(starts[-1])


def quality_labels(hits: DataFrame) -> DataFrame:
    """high from 0.8 of the query's best score, moderate from 0.5, else low."""
    best = F.max("score").over(Window.partitionBy("qid"))
    share = F.when(best > 0, F.col("score") / best).otherwise(0.0)
    return hits.withColumn("match_quality", F.when(share >= 0.8, "high").when(share >= 0.5, "moderate").otherwise("low"))


def token_budget(hits: DataFrame, text: str, budget: int) -> DataFrame:
    """The longest prefix whose bytes / 4 stay within the budget; the first hit always stays."""
    by = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    used = F.sum(F.floor(F.octet_length(text) / 4)).over(by)
    return hits.withColumn("used", used).where((F.col("rank") == 1) | (F.col("used") <= budget))


def rerank_blend(hits: DataFrame, rerank: Column) -> DataFrame:
    """Blend of the fusion score and a reranker's: the fusion score counts .25 for its first three, .40 up to ten, .60 after."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("rerank", 9)), "key"))
    w = F.when(F.col("place") <= 3, 0.25).when(F.col("place") <= 10, 0.40).otherwise(0.60)
    placed = hits.withColumn("rerank", rerank).withColumn("place", place)
    return ranked(placed.select("qid", "key", (w * F.col("score") + (1 - w) * F.col("rerank")).alias("score")))


def strong_signal(hits: DataFrame, least: float = 0.016, gap: float = 0.003) -> DataFrame:
    """(qid, strong): whether the first hit stands out enough to skip reranking."""
    second = F.lead("score").over(Window.partitionBy("qid").orderBy("rank"))
    first = hits.withColumn("second", second).where("rank = 1")
    return first.select("qid", ((F.col("score") >= least) & (F.col("second").isNull() | (F.col("score") - F.col("second") >= gap))).alias("strong"))


def cap_by_origin(hits: DataFrame, origin: str, capped: str, most: int = 30) -> DataFrame:
    """At most `most` hits of one origin per query, the best of them; the others stay."""
    place = F.row_number().over(Window.partitionBy("qid", origin).orderBy(F.desc(F.round("score", 9)), "key"))
    return hits.withColumn("place", place).where((F.col(origin) != capped) | (F.col("place") <= most)).drop("place")


def mmr(hits: DataFrame, query_vectors: DataFrame, diversity: float = 0.3) -> DataFrame:
    """Greedy maximal marginal relevance of each query's hits (qid, key, rank, v); a query's hits are a bounded list.

    query_vectors: (qid, qv). Ties go to the later hit. Returns (qid, key, place).
    """
    lam = 1 - min(1.0, max(0.0, diversity))

    def reorder(rows):
        rows = rows.sort_values("rank").reset_index(drop=True)
        v = np.array(rows["v"].tolist(), np.float64)
        v /= np.maximum(1e-12, np.linalg.norm(v, axis=1, keepdims=True))
        q = np.array(rows["qv"].iloc[0], np.float64)
        near = v @ (q / max(1e-12, np.linalg.norm(q)))
        left, order, worst = list(range(len(rows))), [], np.zeros(len(rows))
        while left:
            value = [round(lam * near[i] - (1 - lam) * worst[i], 9) for i in left]
            pick = left.pop(max(range(len(left)), key=lambda j: (value[j], j)))
            order.append(pick)
            worst = np.maximum(worst, v @ v[pick]) if len(order) > 1 else v @ v[pick]
        out = rows.iloc[order][["qid", "key"]].copy()
        out["place"] = range(1, len(out) + 1)
        return out

    types = {c: hits.schema[c].dataType.simpleString() for c in ("qid", "key")}
    return hits.join(query_vectors, "qid").groupBy("qid").applyInPandas(reorder, f"qid {types['qid']}, key {types['key']}, place int")


def tier_dedup(hits: DataFrame) -> DataFrame:
    """Per query (whose hits are a bounded list) and file, highest tier and score first, drops hits whose lines overlap one already kept; without a second tier all stay."""

    def keep(rows):
        tiers = rows.groupby("file")["tier"].transform("nunique")
        rows = rows.sort_values(["file", "tier", "score", "key"], ascending=[True, False, False, True])
        file, spans, chosen = None, [], []
        for i, (f, n, a, b) in enumerate(zip(rows["file"], tiers[rows.index], rows["start_line"], rows["end_line"], strict=True)):
            if f != file:
                file, spans = f, []
            if n < 2 or all(b < c or a > d for c, d in spans):
                spans.append((a, b))
                chosen.append(i)
        return rows.iloc[chosen]

    return hits.groupBy("qid").applyInPandas(keep, hits.schema)
