"""Upkeep of stored vectors: what to embed, batches of embedding, reconciling with the index, and scoring many at once.

An encoder is any function from a list of texts to a list of vectors; it runs in Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobquarry.functions import keys, text, vectors
from jobquarry.operators import ordering

#: Rows that one run embeds, at most; the bound is the rule, the rest is embedded on later runs.
BUDGET = 120_000


def row_text(rows: DataFrame) -> Column:
    """What is embedded of a stored row: title, department and the snippet."""
    return text.text_to_embed(F.col("title"), F.col("department"), F.coalesce("snippet", F.lit("")), 10_000)


def embed(rows: DataFrame, encoder: Callable[[list[str]], list[list[float]]], column: str = "text", batch: int = 256) -> DataFrame:
    """Rows with ``embedding``; texts go to the encoder ``batch`` at a time, null texts as empty ones."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            found: list = []
            for k in range(0, len(texts), batch):
                found += [np.asarray(v, np.float32) for v in encoder([t or "" for t in texts[k : k + batch]])]
            yield pd.Series(found, dtype=object)

    return rows.withColumn("embedding", run(F.col(column)))


def shard(rows: DataFrame, nth: int, shards: int) -> DataFrame:
    """The rows of one of several disjoint parts, by SHA-1 of the id; a single part needs no digest."""
    if shards == 1:
        return rows.where(F.col("id").isNotNull() & F.lit(nth == 0))
    return rows.where(keys.sha1_mod(F.col("id"), shards) == nth)


def to_embed(rows: DataFrame, stored: DataFrame, budget: int = BUDGET, nth: int = 0, shards: int = 1) -> DataFrame:
    """``id``, ``text`` and ``sig`` of rows without a vector or with one of another content, by id, at most ``budget``."""
    own = rows.where("status = 'active'").select("id", row_text(rows).alias("text"), F.substring(F.sha1(row_text(rows)), 1, 16).alias("sig"))
    known = stored.select("id", F.col("sig").alias("__sig"))
    missing = own.join(known, "id", "left").where(F.col("__sig").isNull() | (F.col("__sig") != F.col("sig"))).drop("__sig")
    return ordering.head_by(shard(missing, nth, shards), "id", budget)


def reconcile(stored: DataFrame, rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored vectors (``id``, ``sig``, ``embedding``) after a run: those of rows that are gone are dropped, fresh ones replace
    what is there, and vectors of a content that changed stay until they are replaced."""
    alive = rows.where("status = 'active'").select("id").distinct()
    new = fresh.select("id", "sig", "embedding").join(alive, "id", "left_semi")
    return stored.select("id", "sig", "embedding").join(alive, "id", "left_semi").join(new.select("id"), "id", "left_anti").unionByName(new)


def migrate(old: DataFrame, rows: DataFrame) -> DataFrame:
    """Vectors of an older table without signatures (``id``, ``embedding``) with those of the rows that they belong to."""
    own = rows.select("id", F.substring(F.sha1(row_text(rows)), 1, 16).alias("sig"))
    return old.select("id", "embedding").join(own, "id").select("id", "sig", "embedding")


def candidates(stored: DataFrame, ids: DataFrame, query: list[float], limit: int) -> DataFrame:
    """The nearest of the vectors whose ids are listed."""
    own = stored.join(ids.select("id").distinct(), "id", "left_semi")
    score = vectors.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])).alias("score")
    return own.select("id", score).orderBy(F.desc("score"), "id").limit(limit)


def nearest_by_matrix(stored: DataFrame, queries: dict[str, list[float]], limit: int) -> DataFrame:
    """The ``limit`` nearest ids for each of some queries (``query``, ``id``, ``score``): vectors come in Arrow batches that are
    multiplied with all queries at once, and each batch keeps its best only."""
    names, q = list(queries), np.array([queries[n] for n in queries], np.float64)
    lengths = np.linalg.norm(q, axis=1)
    q = q / np.where(lengths > 0, lengths, 1.0)[:, None]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows[rows["embedding"].notna()]
            if not len(rows):
                continue
            x = np.stack(rows["embedding"].to_list()).astype(np.float64)
            size = np.linalg.norm(x, axis=1)
            found = (x / np.where(size > 0, size, 1.0)[:, None]) @ q.T
            ids = rows["id"].to_numpy()
            for k, name in enumerate(names):
                best = np.lexsort((ids, -found[:, k]))[:limit]
                yield pd.DataFrame({"query": name, "id": ids[best], "score": found[best, k]})

    found = stored.select("id", "embedding").mapInPandas(score, f"query string, id {stored.schema['id'].dataType.simpleString()}, score double")
    # Of each query at most ``limit`` rows a batch are left, so the heaps below are small.
    top = found.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("r"))
    return top.select("query", F.explode(F.slice("r", 1, limit)).alias("x")).select("query", "x.id", (-F.col("x.s")).alias("score"))
