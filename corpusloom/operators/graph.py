"""Clusters of a similarity graph."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.lineage import written


def components(nodes: DataFrame, edges: DataFrame, id_col: str = "block_id") -> DataFrame:
    """(id_col, cluster_id): the least id of each connected component, single nodes included.

    Each round, every edge is replaced by edges from its ends to the least neighbour seen (large star, then small star), so the
    graph becomes stars in about log(longest path) rounds; each round is written to the shared folder. It ends when a round changes nothing.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u != v")
    current = written(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        around = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = around.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.filter("u != v").distinct()
        small_least = low.groupBy("u").agg(F.min("v").alias("m"))
        small = low.join(small_least, "u")
        after = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        after = written(after, "edges")
        same = after.count() == current.count() and after.exceptAll(current).isEmpty()
        current = after
        if same:
            break
    label = current.groupBy("u").agg(F.min("v").alias("cluster_id"))
    return nodes.select(id_col).distinct().join(label.withColumnRenamed("u", id_col), id_col, "left").select(id_col, F.coalesce("cluster_id", id_col).alias("cluster_id"))


def confidence(labels: DataFrame, edges: DataFrame, id_col: str = "block_id", digits: int = 4) -> DataFrame:
    """(cluster_id, size, confidence): mean score of the edges inside, 1 where there are none."""
    a = labels.select(F.col(id_col).alias("a"), "cluster_id")
    inside = edges.join(a, "a").groupBy("cluster_id").agg(F.avg("score").alias("c"))
    sizes = labels.groupBy("cluster_id").agg(F.count("*").alias("size"))
    return sizes.join(inside, "cluster_id", "left").select("cluster_id", "size", F.round(F.coalesce("c", F.lit(1.0)), digits).alias("confidence"))


def louvain(nodes: list, edges: list[tuple], resolution: float = 1.0) -> dict:
    """Community of each node by greedy modularity with aggregation; nodes in sorted order, ties to the least community."""
    index = {n: i for i, n in enumerate(sorted(nodes))}
    weight: dict[int, dict[int, float]] = {i: {} for i in index.values()}
    for a, b, w in edges:
        i, j = index[a], index[b]
        weight[i][j] = weight[i].get(j, 0.0) + w
        weight[j][i] = weight[j].get(i, 0.0) + w
    home = np.arange(len(index))
    while True:
        own = {i: i for i in weight}
        degree = {i: sum(weight[i].values()) + weight[i].get(i, 0.0) for i in weight}
        total = dict(degree)
        m2 = sum(degree.values()) or 1.0
        moved_any, moved = False, True
        while moved:
            moved = False
            for i in weight:
                c = own[i]
                total[c] -= degree[i]
                gain: dict[int, float] = {c: 0.0}
                for j, w in weight[i].items():
                    if j != i:
                        gain[own[j]] = gain.get(own[j], 0.0) + w
                best = min(gain, key=lambda x: (-(gain[x] - resolution * total[x] * degree[i] / m2), x != c, x))
                total[best] += degree[i]
                if best != c:
                    own[i], moved, moved_any = best, True, True
        if not moved_any:
            break
        home = np.array([own[h] for h in home])
        merged: dict[int, dict[int, float]] = {c: {} for c in sorted(set(own.values()))}
        for i, row in weight.items():
            for j, w in row.items():
                merged[own[i]][own[j]] = merged[own[i]].get(own[j], 0.0) + (w / 2 if own[i] == own[j] and i != j else w)
        weight = merged
    names = sorted(nodes)
    least: dict[int, object] = {}
    for n, h in zip(names, home):
        least.setdefault(int(h), n)
    return {n: least[int(h)] for n, h in zip(names, home)}


def communities(labels: DataFrame, edges: DataFrame, id_col: str = "block_id", resolution: float = 1.0) -> DataFrame:
    """(id_col, community): Louvain within each connected component, one task a component."""
    kind = labels.schema[id_col].dataType.simpleString()
    inside = edges.join(labels.select(F.col(id_col).alias("a"), "cluster_id"), "a").select("cluster_id", "a", "b", "score")
    rows = inside.unionByName(labels.select("cluster_id", F.col(id_col).alias("a"), F.lit(None).cast(kind).alias("b"), F.lit(0.0).alias("score")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        e = pdf[pdf.b.notna()]
        found = louvain(list(pdf[pdf.b.isna()].a), list(zip(e.a, e.b.astype(pdf.a.dtype), e.score)), resolution)
        return pd.DataFrame({id_col: list(found), "community": list(found.values())})

    return rows.groupBy("cluster_id").applyInPandas(run, f"{id_col} {kind}, community {kind}")


def strongest_partition(members: list, pairs: list[tuple], groups: int) -> list[list]:
    """At most `groups` groups by joining the strongest edges first; an even slice of the sorted members if edges don't suffice."""
    if not members:
        return []
    want = max(1, min(groups, len(members)))
    parent = {m: m for m in members}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    left = len(members)
    for a, b, _ in sorted((p for p in pairs if p[0] in parent and p[1] in parent), key=lambda p: (-p[2], p[0], p[1])):
        if left <= want:
            break
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            left -= 1
    if left > want:
        s = sorted(members)
        size, more = divmod(len(s), want)
        ends = np.cumsum([0] + [size + (g < more) for g in range(want)])
        return [s[i:j] for i, j in zip(ends, ends[1:])]
    by: dict = {}
    for m in sorted(members):
        by.setdefault(root(m), []).append(m)
    return sorted(by.values(), key=lambda g: g[0])


def partitioned(labels: DataFrame, edges: DataFrame, id_col: str = "block_id", most: int = 20) -> DataFrame:
    """(id_col, cluster_id, part): clusters above `most` members cut into 2*isqrt(n) groups by their strongest edges."""
    kind = labels.schema[id_col].dataType.simpleString()
    inside = edges.join(labels.select(F.col(id_col).alias("a"), "cluster_id"), "a").select("cluster_id", "a", "b", "score")
    rows = inside.unionByName(labels.select("cluster_id", F.col(id_col).alias("a"), F.lit(None).cast(kind).alias("b"), F.lit(0.0).alias("score")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        members = list(pdf[pdf.b.isna()].a)
        e = pdf[pdf.b.notna()]
        parts = [members] if len(members) <= most else strongest_partition(members, list(zip(e.a, e.b.astype(pdf.a.dtype), e.score)), max(2, 2 * math.isqrt(len(members))))
        flat = [(m, pdf.cluster_id.iloc[0], n) for n, p in enumerate(parts) for m in p]
        return pd.DataFrame(flat, columns=[id_col, "cluster_id", "part"])

    return rows.groupBy("cluster_id").applyInPandas(run, f"{id_col} {kind}, cluster_id {kind}, part int")
