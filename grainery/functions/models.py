"""Models by name: embedders, rerankers, query expanders and summarizers. The defaults need no weights and give the same values everywhere.

A model that needs weights or a service is added by register(); the engine asks for models by name only.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainery.functions.text import TOKEN, code_tokens


class HashEmbedder:
    """Tokens hashed into `dim` signed buckets with weight 1 + ln(tf), to unit length; a text without tokens gets zeros."""

    name = "hash"

    def __init__(self, dim: int = 256):
        self.dim = dim

    def column(self, text: Column) -> Column:
        """array<float> of a text column, in Arrow batches."""
        dim, token = self.dim, re.compile(TOKEN)

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            places: dict[str, int] = {}
            for texts in batches:
                out = np.zeros((len(texts), dim), np.float64)
                for row, text in enumerate(texts):
                    counts: dict[str, int] = {}
                    for t in token.findall(text or ""):
                        t = t.lower()
                        counts[t] = counts.get(t, 0) + 1
                    for t, n in counts.items():
                        if t not in places:
                            if len(places) >= 1 << 18:
                                places.clear()
                            places[t] = zlib.crc32(t.encode())
                        h = places[t]
                        out[row, (h >> 1) % dim] += (1.0 if h & 1 else -1.0) * (1 + np.log(n))
                out /= np.maximum(1e-12, np.linalg.norm(out, axis=1, keepdims=True))
                yield pd.Series(list(out.astype(np.float32)))

        return embed(text)

    def query(self, text: Column) -> Column:
        """Queries are embedded as texts are; models with a query prefix differ here."""
        return self.column(text)


def sparse_weights(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, token, weight): ln(1 + tf) of every term of a text."""
    terms = rows.select(F.col(key).alias("key"), F.explode(code_tokens(F.col(text))).alias("token"))
    return terms.groupBy("key", "token").agg(F.log1p(F.count("*")).alias("weight"))


def overlap_score(query: Column, text: Column) -> Column:
    """Reranker `overlap`: the share of the query's distinct terms that a text has; 0 for a query without terms."""
    asked = F.array_distinct(code_tokens(query))
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.size(F.array_intersect(asked, code_tokens(text))) / F.size(asked))


def order_score(query: Column, text: Column) -> Column:
    """Reranker `none`: keeps the order, by the number of candidates less those before (needs qid and rank)."""
    return (F.count("*").over(Window.partitionBy("qid")) - F.col("rank") + 1).cast("double")


def sigmoid_head(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def softmax_head(no: Column, yes: Column) -> Column:
    """The probability of `yes` of two logits; the larger one is taken out first, so that neither overflows."""
    most = F.greatest(no, yes)
    return F.exp(yes - most) / (F.exp(yes - most) + F.exp(no - most))


# The field of a reranking service's answer that holds its results.
RESULT_FIELDS = {"cohere": "results", "jina": "results", "voyage": "data"}


def service_results(answers: DataFrame, key: str, body: str, service: str) -> DataFrame:
    """(key, index, score) of the JSON answers of a reranking service; results without both fields are left out."""
    if service not in RESULT_FIELDS:
        raise ValueError(f"unknown service {service!r}; one of {', '.join(sorted(RESULT_FIELDS))}")
    field = RESULT_FIELDS[service]
    parsed = F.from_json(F.col(body), f"{field} array<struct<index:bigint,relevance_score:double>>")
    each = answers.select(F.col(key).alias("key"), F.explode(parsed[field]).alias("r"))
    return each.select("key", F.col("r.index").alias("index"), F.col("r.relevance_score").alias("score")).where("index >= 0 AND score IS NOT NULL")


def no_keywords(query: str) -> list[str]:
    """Expander `none`."""
    return []


def no_summary(text: Column) -> Column:
    """Summarizer `none`: an empty description, so that texts themselves are embedded."""
    return F.lit("")


def new_keywords(query: Column, keywords: Column) -> Column:
    """Keywords of an expander that share a word with the query, either way round, or look like identifiers."""
    asked = code_tokens(query)
    return F.filter(keywords, lambda w: F.exists(asked, lambda t: F.contains(F.lower(w), t) | F.contains(t, F.lower(w))) | w.contains("_") | w.rlike(r"\p{Lu}"))


def embed_text(path: Column, kind: Column, content: Column, description: Column, scope: Column | None = None) -> Column:
    """What is embedded for a chunk: its description, or its text after its path and kind (and scope, where scopes are used)."""
    plain = F.concat(path, F.lit(" "), kind, F.lit("\n"), content)
    if scope is not None:
        within = F.when(F.coalesce(scope, F.lit("")) == "", "").otherwise(F.concat(F.lit("Scope: "), scope, F.lit("\n")))
        plain = F.concat(F.lit("File: "), path, F.lit("\n"), within, F.lit("Type: "), kind, F.lit("\n\n"), content)
    return F.when(F.coalesce(description, F.lit("")) != "", description).otherwise(plain)


_MODELS: dict[str, dict[str, Callable]] = {
    "embedder": {"hash": HashEmbedder},
    "reranker": {"none": order_score, "overlap": overlap_score},
    "expander": {"none": no_keywords},
    "summarizer": {"none": no_summary},
}


def register(kind: str, name: str, model: Callable) -> None:
    """embedder: a class with dim, column(text) and query(text); reranker: (query, text) -> score; expander: query -> keywords; summarizer: text -> text."""
    _MODELS[kind][name] = model


def model(kind: str, name: str) -> Callable:
    if name not in _MODELS[kind]:
        raise ValueError(f"unknown {kind} {name!r}; one of {', '.join(sorted(_MODELS[kind]))}")
    return _MODELS[kind][name]
