"""Fusing ranked lists, filters on them, and what follows a search: dedup, floors, reranking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import dot
from corpusloom.operators.similarity import top_k

#: Constant of rank fusion, the grids it is tuned over, the floor's ladder.
RRF_K = 60
K_GRID = (10, 20, 40, 60, 80, 100)
WEIGHT_GRID = ((0.5, 0.5), (0.6, 0.4), (0.7, 0.3), (0.75, 0.25), (0.8, 0.2), (0.3, 0.7))
RETRY_FACTOR, RETRY_FLOOR, LEAST_TOP = 0.7, 0.3, 0.15


def fused(legs: Sequence[DataFrame], k_const: int = RRF_K, weights: Sequence[float] | None = None, top: int | None = None, query_id: str = "query_id", id_col: str = "block_id", digits: int = 9) -> DataFrame:
    """(query_id, id_col, score, rank): sum of weight / (k_const + rank); a leg of weight 0 is left out. Ties by id."""
    if k_const < 1 or (top is not None and top < 1):
        raise ValueError("k_const and top must be >= 1")
    w = list(weights) if weights is not None else [1.0] * len(legs)
    if len(w) != len(legs) or any(x < 0 for x in w):
        raise ValueError("one weight >= 0 for each leg")
    parts = [leg.select(query_id, id_col, (F.lit(float(x)) / (k_const + F.col("rank"))).alias("s")) for leg, x in zip(legs, w) if x > 0]
    total = reduce(DataFrame.unionByName, parts).groupBy(query_id, id_col).agg(F.round(F.sum("s"), digits).alias("score"))
    return top_k(total, [query_id], top or 2**31 - 1, F.desc("score"), F.col(id_col))


def recall(ranked: DataFrame, truth: DataFrame, queries: int, top: int, query_id: str = "query_id", id_col: str = "block_id") -> Column | DataFrame:
    """One row: mean recall at `top`; queries without truth count as 0."""
    sizes = truth.groupBy(query_id).agg(F.count("*").alias("n"))
    hits = ranked.filter(F.col("rank") <= top).join(truth, [query_id, id_col], "left_semi").groupBy(query_id).agg(F.count("*").alias("h"))
    return sizes.join(hits, query_id, "left").agg((F.coalesce(F.sum(F.coalesce("h", F.lit(0)) / F.col("n")), F.lit(0.0)) / queries).alias("recall"))


def tuned_k(legs: Sequence[DataFrame], truth: DataFrame, queries: int, top: int = 10, grid: Sequence[int] = K_GRID, weights: Sequence[float] | None = None) -> DataFrame:
    """(k_const, recall) of every candidate, the best first: highest recall, then the smallest constant."""
    rows = [recall(fused(legs, k, weights, top), truth, queries, top).select(F.lit(k).alias("k_const"), F.round("recall", 9).alias("recall")) for k in grid]
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc("recall"), "k_const")


def tuned_weights(legs: Sequence[DataFrame], truth: DataFrame, queries: int, top: int = 10, grid: Sequence[Sequence[float]] = WEIGHT_GRID) -> DataFrame:
    """(candidate, recall), the best first; of equals the first candidate."""
    rows = [recall(fused(legs, RRF_K, w, top), truth, queries, top).select(F.lit(n).alias("candidate"), F.round("recall", 9).alias("recall")) for n, w in enumerate(grid)]
    return reduce(DataFrame.unionByName, rows).orderBy(F.desc("recall"), "candidate")


def passes(tags: Sequence[str] = (), entities: Sequence[str] = (), languages: Sequence[str] = (), ids: Sequence[str] = (), kb_id: str | None = None) -> Column:
    """Metadata filter: any of the tags, any of the entities by name or alias without case, language, id and kb_id. Nothing set: all pass."""
    c = F.lit(True)
    if tags:
        c = c & F.coalesce(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])), F.lit(False))
    if entities:
        low = [e.lower() for e in entities]
        known = lambda e: F.lower(e["entity_name"]).isin(low) | F.coalesce(F.exists(e["aliases"], lambda a: F.lower(a).isin(low)), F.lit(False))
        c = c & F.coalesce(F.exists("entities", known), F.lit(False))
    if languages:
        c = c & F.coalesce(F.col("language").isin(list(languages)), F.lit(False))
    if ids:
        c = c & F.col("block_id").isin(list(ids))
    if kb_id is not None:
        c = c & F.coalesce(F.col("kb_id") == kb_id, F.lit(False))
    return c


def resolved(ranked: DataFrame, registry: DataFrame, id_col: str = "block_id") -> DataFrame:
    """Ranked ids with their rows; ids that the registry doesn't have are dropped."""
    return ranked.join(registry, id_col)


def reranked(ranked: DataFrame, query_id: str = "query_id") -> DataFrame:
    """The order kept, the score (n - rank) / n with ranks from 0."""
    n = F.count("*").over(Window.partitionBy(query_id))
    return ranked.withColumn("score", (n - (F.col("rank") - 1)) / n)


def distinct_enough(ranked: DataFrame, vectors: DataFrame, threshold: float = 0.9, query_id: str = "query_id", id_col: str = "block_id", vector_col: str = "vector") -> DataFrame:
    """Ranked rows without those too similar to an earlier kept one; rows without a vector stay.

    A query's pool is the bounded result of a search, so it is folded as one array.
    """
    rows = ranked.join(vectors.select(id_col, F.col(vector_col).alias("__v")), id_col, "left")
    pool = rows.groupBy(query_id).agg(F.sort_array(F.collect_list(F.struct("rank", F.col(id_col).alias("id"), "score", "__v"))).alias("pool"))
    similar = lambda x, y: F.coalesce(F.aggregate(F.zip_with(x["__v"], y["__v"], lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, p: s + p) >= threshold, F.lit(False))
    kept = F.aggregate("pool", F.filter("pool", lambda x: F.lit(False)), lambda acc, x: F.when(F.exists(acc, lambda y: similar(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return pool.select(query_id, F.explode(kept).alias("k")).select(query_id, F.col("k.id").alias(id_col), F.col("k.score").alias("score"), F.col("k.rank").alias("rank"))


def floored(ranked: DataFrame, least: float, query_id: str = "query_id") -> DataFrame:
    """Rows at or above the first threshold that any row of the query reaches: least, then x0.7 down to 0.3; else the top row if it has 0.15."""
    ladder, t = [], least
    while t not in ladder:
        ladder.append(t)
        t = max(t * RETRY_FACTOR, RETRY_FLOOR)
    w = Window.partitionBy(query_id)
    top = F.max("score").over(w)
    reached = F.coalesce(*[F.when(top >= x, F.lit(x)) for x in ladder])
    first = F.min("rank").over(w)
    keep = (reached.isNotNull() & (F.col("score") >= reached)) | (reached.isNull() & (F.col("rank") == first) & (F.col("score") >= LEAST_TOP))
    return ranked.withColumn("__keep", keep).filter("__keep").drop("__keep")


def hybrid(dense: DataFrame, lexical: DataFrame, registry: DataFrame, k: int, condition: Column | None = None, weights: Sequence[float] = (1.0, 1.0), vectors: DataFrame | None = None, query_id: str = "query_id", id_col: str = "block_id") -> tuple[DataFrame, DataFrame]:
    """(result, filtered_out): two legs of a pool of max(50, 8k) each, the filter on the pool, fused, resolved, deduplicated, cut to k.

    A query without lexical hits keeps its dense scores. filtered_out counts a query's pool rows that the filter dropped.
    """
    pool = max(50, 8 * k)
    legs = [leg.filter(F.col("rank") <= pool) for leg in (dense, lexical)]
    allowed = registry.filter(condition).select(id_col) if condition is not None else registry.select(id_col)
    kept = [leg.join(allowed, id_col, "left_semi") for leg in legs]
    renumber = Window.partitionBy(query_id).orderBy("rank")
    kept = [leg.withColumn("rank", F.row_number().over(renumber)) for leg in kept]
    lexed = kept[1].select(query_id).distinct()
    both = fused([kept[0].join(lexed, query_id, "left_semi"), kept[1]], RRF_K, weights, pool, query_id, id_col)
    alone = kept[0].join(lexed, query_id, "left_anti").select(query_id, id_col, "score", "rank")
    merged = both.unionByName(alone)
    if vectors is not None:
        merged = distinct_enough(merged, vectors, query_id=query_id, id_col=id_col)
    result = top_k(merged.drop("rank"), [query_id], k, F.desc("score"), F.col(id_col))
    seen = reduce(DataFrame.unionByName, [leg.select(query_id, id_col) for leg in legs]).distinct()
    out = seen.join(allowed, id_col, "left_anti").groupBy(query_id).agg(F.count("*").alias("filtered_out"))
    return result, out


def multi_query(variant_hits: DataFrame, k: int, query_id: str = "query_id", variant: str = "variant", id_col: str = "block_id") -> DataFrame:
    """Hits of a question's variants (query_id, variant, id, rank; depth max(2k, 5)) fused by question."""
    depth = max(2 * k, 5)
    s = variant_hits.filter(F.col("rank") <= depth).groupBy(query_id, id_col).agg(F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 9).alias("score"))
    return top_k(s, [query_id], k, F.desc("score"), F.col(id_col))


def graded(ranked: DataFrame, overlap: Column, query_id: str = "query_id", top: int = 5) -> DataFrame:
    """(query_id, relevance): mean overlap of the first rows, between 0 and 1. Queries without rows aren't here; they are 0."""
    return ranked.filter(F.col("rank") <= top).groupBy(query_id).agg(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg(overlap))), 6).alias("relevance"))


__all__ = ["dot", "fused", "recall", "tuned_k", "tuned_weights", "passes", "resolved", "reranked", "distinct_enough", "floored", "hybrid", "multi_query", "graded"]
