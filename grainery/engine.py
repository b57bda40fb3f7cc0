"""The entry points of the engine over one source tree: index, search, structure, maintenance. Answers are DataFrames unless said otherwise."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainery.functions import models as N
from grainery.functions import text as T
from grainery.operators import augment as A
from grainery.operators import chunks as C
from grainery.operators import evaluate as V
from grainery.operators import graph as G
from grainery.operators import history as H
from grainery.operators import imports as M
from grainery.operators import intervals as I
from grainery.operators import search as S
from grainery.operators import store as D
from grainery.operators import symbols as Y
from grainery.sources import files

INTENTS = ("auto", "find", "understand", "impact", "trace")
MOST_SYMBOLS = 15


class Engine:
    """store: a folder that driver and executors share. An index is a generation of tables; queries read the one that CURRENT names."""

    def __init__(self, spark: SparkSession, root: str, store: str, go_module: str | None = None, embedder: str = "hash"):
        self.spark, self.root, self.store, self.go_module = spark, root, store, go_module
        self.embedder = N.model("embedder", embedder)()

    def _scan(self) -> DataFrame:
        """The files of the tree that are indexed, without their texts. Those with zero bytes are listed, but have no chunks."""
        return files.listing(self.spark, self.root).where(T.is_indexed_path(F.col("path"))).select("path", "mtime", "size", T.language(F.col("path")).alias("language"))

    def table(self, name: str) -> DataFrame:
        return D.current(self.spark, self.store, name)

    # ---- maintenance ----

    def index(self, log: DataFrame | None = None) -> str:
        """Reads the tree and publishes a new generation; only files whose time or size changed are cut, embedded and parsed again.

        log: numbered lines (n, line) of the tree's history, for files that change together; without it those of the last index stay.
        """
        os.makedirs(self.store, exist_ok=True)
        scan = self._scan()
        old = {n: self.table(n) for n in ("files", "chunks", "symbols", "calls", "statements")} if os.path.exists(f"{self.store}/CURRENT") else {}
        manifest = scan
        fresh = files.read_texts(scan if not old else D.changed(scan.select("path", "mtime", "size"), old["files"]), self.root)
        kept = manifest.join(old["files"].select("path", "mtime", "size"), ["path", "mtime", "size"], "left_semi").select(F.col("path").alias("file")) if old else None
        cut = C.window_chunks(fresh.select(F.col("path").alias("file"), "text"), "file", "text").withColumn("key", F.concat_ws(":", "file", "chunk_idx"))
        new = {
            "chunks": cut.withColumn("v", self.embedder.column(N.embed_text(F.col("file"), F.lit("text"), F.col("content"), F.lit("")))),
            "symbols": Y.definitions(fresh),
            "calls": Y.calls(fresh),
            "statements": M.statements(fresh),
        }
        if old:
            new = {n: old[n].join(kept, "file", "left_semi").select(*df.columns).unionByName(df) for n, df in new.items()}
        name = D.publish_all({"files": manifest, **new}, f"{self.store}/stage")
        read = lambda n: self.spark.read.parquet(f"{self.store}/stage/{name}/{n}")
        edges = M.resolve(read("statements"), read("files"), self.go_module).select("src", "dst").distinct()
        callers = I.enclosing_symbol(read("calls").select("file", "line"), read("symbols")).select("file", "line", F.col("name").alias("caller"))
        derived = {
            **{n: read(n) for n in ("files", "chunks", "symbols", "calls", "statements")},
            "postings": S.postings(read("chunks"), "key", "content").repartition("term").sortWithinPartitions("term"),
            "stats": S.text_stats(read("chunks"), "content"),
            "edges": edges,
            "roles": G.roles(edges),
            "call_edges": read("calls").join(callers, ["file", "line"], "left"),
        }
        if log is not None:
            derived["cochange"] = H.cochange(files.commit_log(log))
        elif old:
            derived["cochange"] = self.table("cochange")
        else:
            derived["cochange"] = self.spark.createDataFrame([], "file_a string, file_b string, together bigint, jaccard double")
        try:
            return D.publish_all(derived, self.store)
        finally:
            shutil.rmtree(f"{self.store}/stage", ignore_errors=True)

    def clear(self) -> None:
        shutil.rmtree(self.store, ignore_errors=True)

    def gc(self) -> list[str]:
        """Takes away generations that CURRENT does not name and returns their names."""
        live = os.path.basename(os.path.dirname(self.table("files").inputFiles()[0]).removesuffix("/files"))
        gone = sorted(n for n in os.listdir(self.store) if n.startswith("gen-") and n != live)
        for n in gone:
            shutil.rmtree(f"{self.store}/{n}")
        return gone

    def status(self) -> DataFrame:
        """One row: files, chunks, symbols, edges, stale and vanished files, and the state they mean."""
        if not os.path.exists(f"{self.store}/CURRENT"):
            return self.spark.sql("SELECT 0L AS files, 0L AS chunks, 0L AS symbols, 0L AS edges, 0L AS stale, 'empty' AS state")
        counts = {n: self.table(n).count() for n in ("files", "chunks", "symbols", "edges")}
        scan = self._scan().select("path", "mtime", "size")
        stale = D.stale(scan, self.table("files")).first()["stale"] + scan.join(self.table("files"), "path", "left_anti").count()
        return self.spark.range(1).select(*[F.lit(v).alias(k) for k, v in counts.items()], F.lit(stale).alias("stale"), F.lit("stale" if stale else "fresh").alias("state"))

    # ---- search ----

    def _legs(self, query: str, most: int, legs: tuple[str, ...], vector: Column) -> dict[str, DataFrame]:
        """The first `most` chunks by keywords and by cosine. Zero vectors are near to nothing."""
        found = {}
        if "fts" in legs:
            words = self._one(T.sanitize_query(F.lit(self._one(T.expand_query(F.lit(query))))))
            found["fts"] = S.bm25_stored(self.table("postings"), self.table("stats"), self.spark.createDataFrame([(0, words)], "qid int, query string"), most)
        if "vector" in legs:
            near = self.table("chunks").select("key", A.cosine(vector, F.col("v")).alias("score")).where("score <> 0")
            found["vector"] = S.ranked(near.orderBy(F.desc(F.round("score", 9)), "key").limit(most).select(F.lit(0).alias("qid"), "key", "score"))
        return found

    def _one(self, value: Column):
        """A constant expression's value. Rules about queries are long, so each is evaluated by itself and the next one gets its value."""
        return self.spark.range(1).select(value).first()[0]

    def _held(self, hits: DataFrame) -> DataFrame:
        """Hits of one query as a local table: top_k of them and at most 30 along imports and max(50, 2 * top_k) of the sparse leg."""
        return self.spark.createDataFrame(hits.toArrow(), hits.schema)

    def search(
        self,
        query: str,
        top_k: int = 5,
        scope: str | None = None,
        max_tokens: int | None = None,
        legs: tuple[str, ...] = ("fts", "vector"),
        depth: int = 1,
        sparse_weight: float = 0.0,
        cochange_boost: float = 0.1,
        diversity: float = 0.0,
        reranker: str | None = None,
        changed: DataFrame | None = None,
    ) -> DataFrame:
        """(rank, file, start_line, end_line, score, match_quality, why, content).

        The first 3 * top_k chunks by BM25 and by cosine are fused by their ranks to top_k; chunks along imports (depth 0: none), those that
        only the sparse leg has and files that change together come beside them, so that there may be more than top_k rows. Then order by
        diversity and a reranker (skipped where the first hit stands out), weights of paths and roles, labels, and a budget of tokens.
        scope: a folder; changed: paths (column path) of a branch.
        """
        unknown = set(legs) - {"fts", "vector"}
        if unknown or not legs:
            raise ValueError(f"unknown legs {sorted(unknown)}; fts, vector or both")
        rerank = None if reranker is None else N.model("reranker", reranker)
        said = self._one(T.issue_query(F.lit(query)))
        asked = self.spark.createDataFrame([(said,)], "query string").select(self.embedder.query(F.col("query")).alias("qv"))
        vector = F.array(*[F.lit(float(x)) for x in asked.first()["qv"]])
        chunks = self.table("chunks")
        within = chunks if scope is None else chunks.where(in_scope(F.col("file"), scope))
        found = self._legs(said, 3 * top_k if scope is None else 6 * top_k, legs, vector)
        fused = S.rrf(found, 6 * top_k) if len(found) > 1 else next(iter(found.values())).select("qid", "key", "score", "rank").withColumn("why", F.lit(legs[0]))
        fused = within.select("key", "file").join(F.broadcast(fused.drop("rank")), "key")
        hits = self._held(S.top(fused, top_k).select("qid", "key", "file", "score", "rank", "why"))
        rows = hits
        if depth > 0:
            more = A.along_imports(hits, self.table("edges"), within.select("key", "file", "v"), self.spark.range(1).select(F.lit(0).alias("qid"), vector.alias("qv")), depth)
            rows = self._held(S.ranked(more.where("why = 'graph'").select("qid", "key", "file", "score", "why").unionByName(hits.drop("rank"))))
        if sparse_weight > 0:
            index = self.table("postings").select("key", F.col("term").alias("token"), F.log1p("tf").alias("weight"))
            words = self.spark.range(1).select(F.lit(0).alias("key"), F.lit(query).alias("text"))
            leg = S.sparse_dot(index, N.sparse_weights(words, "key", "text").withColumnRenamed("key", "qid"), max(50, 2 * top_k))
            known = rows.select("key", F.col("why").alias("was"))
            both = A.promoted(rows.select("qid", "key", "rank"), leg, sparse_weight).join(known, "key", "left").select("qid", "key", "score", "rank", F.coalesce("was", "why").alias("why"))
            rows = self._held(within.select("key", "file").join(F.broadcast(both), "key"))
        if cochange_boost > 0:
            rows = S.ranked(H.cochange_boost(rows, self.table("cochange"), cochange_boost).drop("rank"))
        rows = chunks.drop("file").join(F.broadcast(rows), "key")
        if diversity > 0:
            order = S.mmr(rows.select("qid", "key", "rank", "v"), self.spark.range(1).select(F.lit(0).alias("qid"), vector.alias("qv")), diversity)
            rows = rows.join(order, ["qid", "key"]).drop("rank").withColumnRenamed("place", "rank")
        if rerank is not None:
            rows = self._held(rows)
            strong = S.strong_signal(rows)
            judged = rows.withColumn("rerank", rerank(F.lit(query), F.col("content")))
            blend = S.rerank_blend(judged, F.col("rerank")).select("qid", "key", F.col("score").alias("blended"))
            rows = rows.join(blend, ["qid", "key"]).join(strong, "qid").withColumn("score", F.when(F.col("strong"), F.col("score")).otherwise(F.col("blended")))
        roles = self.table("roles").select(F.col("node").alias("file"), "role")
        weight = F.when(F.col("role") == "entry", 1.1).when(F.col("role") == "core", 1.05).when(F.col("role") == "utility", 0.5).otherwise(1.0)
        rows = rows.join(roles, "file", "left").withColumn("score", F.col("score") * T.path_multiplier(F.col("file"), F.lit(query)) * weight)
        best = S.quality_labels(S.ranked(rows.drop("rank")))
        if max_tokens is not None:
            best = S.token_budget(best, "content", max_tokens)
        if changed is not None:
            best = A.in_branch(best, changed)
        return best.select("rank", "file", "start_line", "end_line", "score", "match_quality", "why", "content").orderBy("rank")

    def grep(self, pattern: str, ignore_case: bool = False, most: int | None = 100) -> DataFrame:
        tree = files.tree(self.spark, self.root).select(F.col("path").alias("file"), "text")
        return C.grep(tree, "file", "text", pattern, ignore_case, most)

    def smart_search(self, query: str, intent: str = "auto", top_k: int = 5) -> DataFrame:
        """auto: a plain word is looked up line by line, a sentence by rank. impact and trace take a file and `start -> end`."""
        if intent not in INTENTS:
            raise ValueError(f"unknown intent {intent!r}; one of {', '.join(INTENTS)}")
        if intent == "impact":
            return self.find_dependents(query)
        if intent == "trace":
            start, arrow, end = (p.strip() for p in query.partition("->"))
            if not arrow:
                raise ValueError("trace needs `start -> end`")
            return Y.call_trace(self.table("call_edges").select(F.col("caller").alias("src"), F.col("callee").alias("dst")).where("src IS NOT NULL"), start, end)
        if intent == "auto":
            kind = self.spark.range(1).select(T.route_query(F.lit(query)).alias("r")).first()["r"]
            if kind == "grep":
                return self.grep(quoted(query), most=top_k)
        return self.search(query, top_k)

    # ---- structure ----

    def symbol(self, name: str, kind: str | None = None) -> DataFrame:
        found = self.table("symbols").where(F.col("name") == name)
        return found if kind is None else found.where(F.col("kind") == kind)

    find_symbol = symbol

    def get_symbol_info(self, name: str, most: int = 20) -> DataFrame:
        """(relation, file, line, symbol): where a symbol is defined, what calls it and what it calls."""
        edges = self.table("call_edges")
        back = edges.where(F.col("callee") == name).select(F.lit("caller").alias("relation"), "file", "line", F.col("caller").alias("symbol"))
        out = edges.where(F.col("caller") == name).select(F.lit("callee").alias("relation"), "file", "line", F.col("callee").alias("symbol"))
        here = self.symbol(name).select(F.lit("definition").alias("relation"), "file", F.col("start").alias("line"), F.col("name").alias("symbol"))
        rows = here.unionByName(back).unionByName(out)
        return rows.withColumn("n", F.row_number().over(Window.partitionBy("relation").orderBy("file", "line", "symbol"))).where(F.col("n") <= most).drop("n")

    def context(self, path: str) -> DataFrame:
        """(relation, file): what a file imports and what imports it."""
        edges = self.table("edges")
        return edges.where(F.col("src") == path).select(F.lit("imports").alias("relation"), F.col("dst").alias("file")).unionByName(edges.where(F.col("dst") == path).select(F.lit("imported_by").alias("relation"), F.col("src").alias("file")))

    def _seed(self, path: str) -> DataFrame:
        return self.spark.createDataFrame([(path,)], "seed string")

    def find_dependents(self, path: str, depth: int = 3) -> DataFrame:
        """(file, depth, kind, is_test) of the files that a change reaches."""
        return G.impact(self.table("edges"), self._seed(path), depth).select(F.col("node").alias("file"), "depth", "kind", T.is_test_file(F.col("node")).alias("is_test"))

    def find_tests(self, path: str) -> DataFrame:
        """(file, why): tests that import a file, then tests beside it or named after it."""
        importers = self.table("edges").where((F.col("dst") == path) & T.is_test_file(F.col("src"))).select(F.col("src").alias("file"), F.lit("importer").alias("why")).distinct()
        folder, name = os.path.split(path)
        stem = name.rsplit(".", 1)[0].lower()
        p, where = F.lower("path"), F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
        beside = self.table("files").where(T.is_test_file(F.col("path")) & ((where == folder) | p.contains(f"/tests/{stem}") | p.contains(f"/__tests__/{stem}")))
        return importers.unionByName(beside.select(F.col("path").alias("file"), F.lit("colocated").alias("why")).join(importers, "file", "left_anti"))

    def get_repo_map(self, max_tokens: int = 4096) -> str:
        """The tree with roles and symbols as text of at most 4 * max_tokens characters. The driver takes no more rows than that can show."""
        names = self.table("symbols").withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("start", "name"))).where(F.col("n") <= MOST_SYMBOLS)
        listed = names.groupBy("file").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "name"))), lambda s: s["name"]), ", ").alias("names"))
        roles = self.table("roles").select(F.col("node").alias("file"), "role")
        rows = self.table("files").select(F.col("path").alias("file")).join(roles, "file", "left").join(listed, "file", "left")
        out, size, folder = [], 0, None
        for r in rows.orderBy(F.regexp_replace("file", "[^/]*$", ""), "file").limit(1 + max_tokens).toLocalIterator():
            where, name = os.path.split(r["file"])
            lines = ([f"{where or '.'}/"] if where != folder else []) + [f"  {name} [{r['role'] or 'internal'}]" + (f": {r['names']}" if r["names"] else "")]
            size += sum(len(x) + 1 for x in lines)
            if size > 4 * max_tokens:
                break
            out, folder = out + lines, where
        return "\n".join(out)

    def evaluate(self, cases: DataFrame, k: int = 5) -> DataFrame:
        """Metrics of cases (qid, query, expected_files): files by their best chunk."""
        asked = cases.select("qid", T.expand_query(T.sanitize_query(F.col("query"))).alias("query"))
        hits = S.bm25_stored(self.table("postings"), self.table("stats"), asked, 6 * k).join(self.table("chunks").select("key", "file"), "key")
        weighed = hits.join(cases.select("qid", F.col("query").alias("said")), "qid").withColumn("score", F.col("score") * T.path_multiplier(F.col("file"), F.col("said")))
        best = S.ranked(weighed.groupBy("qid", F.col("file").alias("item")).agg(F.max("score").alias("score")), key="item")
        return V.metrics(best, cases.select("qid", F.explode("expected_files").alias("item")), k)


def quoted(word: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in word.strip())


def in_scope(path: Column, scope: str) -> Column:
    """The folder itself or anything below it."""
    scope = scope.rstrip("/")
    return (path == scope) | path.startswith(scope + "/")
