import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from grainery.operators import search as S


def _batches(x, size=1000):
    flat = pa.array(x.ravel())
    whole = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))), pa.FixedSizeListArray.from_arrays(flat, x.shape[1]).cast(pa.list_(pa.float64()))], ["key", "v"])
    return iter([whole.slice(low, size) for low in range(0, len(x), size)])


def test_nearest_takes_blocks_of_bounded_size():
    """Scores of 6000 queries against 4000 rows are 192 MB in one matrix and were held several times at once."""
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(4000, 4)), rng.normal(size=(6000, 4))
    tracemalloc.start()
    rows = sum(b.num_rows for b in S.nearest(_batches(x, 4000), np.arange(6000), q, 10, "cosine", True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 60000 and peak < 150e6


def test_nearest_equals_brute_force_with_ties(monkeypatch):
    monkeypatch.setattr(S, "QUERY_BLOCK", 7)
    monkeypatch.setattr(S, "ROW_BLOCK", 50)
    monkeypatch.setattr(S, "GATHERED", 500)
    rng = np.random.default_rng(2)
    x = rng.integers(0, 3, size=(900, 3)).astype(float)  # many equal scores, some vectors without length
    ids = np.arange(0, 900, 11)
    for metric in ("cosine", "l2sq"):
        got = {}
        for b in S.nearest(_batches(x, 130), ids, x[ids], 9, metric, True):
            for q, key in zip(b.column("qid").to_pylist(), b.column("key").to_pylist(), strict=True):
                got.setdefault(q, []).append(key)
        length = np.linalg.norm(x, axis=1)
        for q in ids:
            if metric == "cosine":
                long = length * length[q]
                score = np.divide(x @ x[q], long, out=np.zeros(900), where=long > 0)
            else:
                score = -((x - x[q]) ** 2).sum(1)
            want = sorted((k for k in range(900) if k != q), key=lambda k: (-round(score[k], 9), k))[:9]
            assert got[q] == want


def test_knn_parts_do_not_grow_with_the_table(spark):
    """Every part sends its best of every query, so many parts of many queries would make a shuffle that grows with their product."""
    rows = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("v")).repartition(300)
    asked = rows.where("vec_id % 1000 = 0")
    assert S.few_parts(rows).rdd.getNumPartitions() <= 32
    found = S.knn(rows.unionByName(rows.limit(1).withColumn("vec_id", F.lit(None).cast("long"))), asked, 2, "vec_id", "v").collect()
    assert len(found) == 6 and all(r["key"] is not None for r in found)


TEXTS = ["getUserById aa", "user user ab1", None, "", "XMLHttpé id2 id", "by By BY b", "AAb Ab aB", "zz"]


def _plain(texts):
    import re

    return [None if t is None else [x.lower() for x in re.findall("[A-Z]?[a-z]+|[A-Z]+|[0-9]+", t)] for t in texts]


def test_split_texts_finds_the_tokens_of_code_tokens():
    codes = {t: c for c, t in enumerate(["user", "by", "id", "a", "http", "aa", "2"])}
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(TEXTS))), pa.array(TEXTS)], ["key", "text"])
    got, sizes = {}, {}
    for keys, size, text, code, tf in S.split_texts(iter([batch.slice(0, 3), batch.slice(3)]), codes, 2):
        sizes |= dict(zip(keys.to_pylist(), size.tolist(), strict=True))
        got |= {(keys[int(i)].as_py(), int(c)): int(n) for i, c, n in zip(text, code, tf, strict=True)}
    want = _plain(TEXTS)
    assert sizes == {i: -1 if t is None else len(t) for i, t in enumerate(want)}
    assert got == {(i, codes[x]): t.count(x) for i, t in enumerate(want) if t for x in set(t) if x in codes}


def _frames(spark):
    corpus = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(TEXTS)], "key string, text string").repartition(5)
    asked = spark.createDataFrame([(1, "user by"), (2, "id ID aa"), (3, None), (4, "nothing"), (1, "by id")], "qid int, query string")
    return corpus, asked


def test_bm25_equals_the_join_of_postings(spark):
    """The k best come from each task; pairs of posting and query are no rows of the plan any more."""
    corpus, asked = _frames(spark)
    one = asked.where("qid <> 1 OR query LIKE 'user%'")
    got = S.bm25(corpus, one, 3, "key", "text")
    want = S.bm25_stored(S.postings(corpus, "key", "text"), S.text_stats(corpus, "text"), one, 3)
    rows = lambda df: sorted((r["qid"], r["rank"], r["key"], round(r["score"], 9)) for r in df.collect())
    assert rows(got) == rows(want) and len(rows(got)) == 6
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    twice = corpus.unionByName(corpus.where("key = 'k1'"))
    assert len(rows(S.bm25(twice, one, 3, "key", "text"))) == 6


def test_bm25_of_many_queries_and_none(spark, monkeypatch):
    corpus, asked = _frames(spark)
    assert S.bm25(corpus, asked.where("qid > 2"), 3, "key", "text").count() == 0
    want = sorted(tuple(r) for r in S.bm25(corpus, asked.where("qid = 2"), 3, "key", "text").collect())
    monkeypatch.setattr(S, "ASKED_PAIRS", 0)
    assert sorted(tuple(r)[:2] for r in S.bm25(corpus, asked.where("qid = 2"), 3, "key", "text").collect()) == [w[:2] for w in want]


def test_sparse_dot_sums_a_key_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(S, "SUMS", 5)
    rng = np.random.default_rng(4)
    index = [(None if k == 7 else k, f"t{t}", float(rng.integers(-3, 4))) for k in range(40) for t in range(6) if rng.random() < 0.5] + [(3, "t0", None), (4, None, 1.0)]
    asked = [(q, f"t{t}", float(rng.integers(1, 4))) for q in range(5) for t in range(8) if rng.random() < 0.5]
    got = S.sparse_dot(spark.createDataFrame(index, "key long, token string, weight double").repartition(3), spark.createDataFrame(asked, "qid int, token string, weight double"), 6)
    sums = {}
    for q, t, w in asked:
        for k, u, x in index:
            if t == u and x is not None:
                sums[q, k] = sums.get((q, k), 0) + w * x
    want = []
    for q in range(5):
        best = sorted((-s, -1 if k is None else k) for (p, k), s in sums.items() if p == q)[:6]
        want += [(q, None if k < 0 else k, -s, i + 1) for i, (s, k) in enumerate(best)]
    assert sorted(map(repr, ((r["qid"], r["key"], r["score"] + 0.0, r["rank"]) for r in got.collect()))) == sorted(map(repr, ((q, k, s + 0.0, r) for q, k, s, r in want)))
    assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()
