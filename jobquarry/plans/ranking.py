"""Ranking: field-weighted BM25, vectors, and their combination."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobquarry.functions import vectors
from jobquarry.plans.search import query_terms

K1, B = 1.5, 0.75
# Weights of the fields.
FIELDS = (("title", 5.0), ("department", 2.0), ("company", 2.0), ("description_text", 1.0))
#: Rows that a reranker sees, and rows without a stored vector that are embedded for a query.
RERANK_TOP = 100
EMBED_CAP = 100


def plain_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def bm25(rows: DataFrame, query: str | None, fields: tuple[tuple[str, float], ...] = FIELDS) -> DataFrame:
    """``rows`` with ``score``: Okapi BM25 per field over the statistics of these rows, added up by weight.

    Terms of the query count once. A field that is empty in all rows adds nothing. The statistics are one row, so the
    second pass over ``rows`` reads them as a broadcast of fixed size.
    """
    terms = sorted(set(query_terms(query)))
    if not terms:
        return rows.withColumn("score", F.lit(0.0))
    held = rows.withColumns({f"__tok_{f}": plain_tokens(F.col(f)) for f, _ in fields})
    stats = []
    for f, _ in fields:
        tok = F.col(f"__tok_{f}")
        stats.append(F.avg(F.when(F.size(tok) > 0, F.size(tok))).alias(f"__avg_{f}"))
        stats += [F.count_if(F.array_contains(tok, t)).alias(f"__df_{f}_{k}") for k, t in enumerate(terms)]
    totals = held.agg(F.count(F.lit(1)).alias("__n"), *stats)
    scored = held.crossJoin(F.broadcast(totals))
    total = F.lit(0.0)
    for f, weight in fields:
        tok, own = F.col(f"__tok_{f}"), F.lit(0.0)
        for k, t in enumerate(terms):
            df, tf = F.col(f"__df_{f}_{k}"), F.size(F.filter(tok, _equals(t)))
            idf = F.log(1.0 + (F.col("__n") - df + 0.5) / (df + 0.5))
            denominator = tf + K1 * (1.0 - B + B * F.greatest(F.size(tok), F.lit(1)) / F.col(f"__avg_{f}"))
            own = own + F.when(tf > 0, idf * (tf * (K1 + 1.0)) / denominator).otherwise(0.0)
        total = total + weight * own
    return scored.withColumn("score", total).drop(*[c for c in scored.columns if c.startswith("__")])


def _equals(term: str):
    return lambda x: x == term


def rank(rows: DataFrame, query: str | None, reranker: Callable[[DataFrame], DataFrame] | None = None, order: str = "ord") -> DataFrame:
    """``rows`` by score, ties in the order of ``order``. A reranker (a function that replaces ``score``) sees the best
    ``RERANK_TOP`` only; the others keep their scores. Without a query the rows come in their own order."""
    if not query_terms(query):
        return rows.orderBy(order)
    scored = bm25(rows, query)
    if reranker is not None:
        # A limit is a top-k per task and a merge; no window over all rows is needed to find the head.
        head = scored.orderBy(F.desc("score"), order).limit(RERANK_TOP)
        scored = reranker(head).unionByName(scored.join(head.select(order), order, "left_anti"))
    return scored.orderBy(F.desc_nulls_last("score"), order)


def vector_search(stored: DataFrame, query: list[float], limit: int, vector: str = "embedding", id_col: str = "id") -> DataFrame:
    """The ids of the ``limit`` vectors nearest to ``query`` by cosine, with ``score``; ids break ties."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = stored.select(id_col, vectors.cosine(F.col(vector), q).alias("score"))
    return scored.orderBy(F.desc("score"), id_col).limit(limit)


def hybrid_rerank(pool: DataFrame, stored: DataFrame, query: list[float], embed: Callable[[DataFrame], DataFrame], want: int | None, order: str = "ord") -> DataFrame:
    """A lexical pool (``id`` and its ``order``) reranked by vectors.

    Rows with a stored vector get their cosine; of the others the first ``EMBED_CAP`` in lexical order are embedded now
    (``embed`` adds ``embedding``) and share the scale; the rest keep lexical order behind them, without a score.
    The pool is a query's candidates, at most a few hundred rows, so ranking it in one task is its proper size.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    held = pool.join(stored.select("id", F.col("embedding").alias("__v")), "id", "left")
    missing = held.where(F.col("__v").isNull())
    now = embed(missing.drop("__v").orderBy(order).limit(EMBED_CAP)).select("id", F.col("embedding").alias("__e"))
    held = held.join(now, "id", "left").withColumn("__v", F.coalesce("__v", "__e"))
    scored = held.withColumn("score", F.when(F.col("__v").isNotNull(), vectors.cosine(F.col("__v"), q))).drop("__v", "__e")
    scored = scored.orderBy(F.desc_nulls_last("score"), order)
    return scored if want is None else scored.limit(want)


def merge_shards(parts: list[DataFrame], limit: int, order: list[Column]) -> DataFrame:
    """Results of several shards as one, in one global order."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.orderBy(*order).limit(limit)

