"""Problem 3: the k most similar vectors of every vector, by collision counting.

Routes are the centres of a k-means on a bounded sample of vectors (at most SAMPLE rows, ROUTES centres). Every vector is stored in the cell of
its nearest route and asks the PROBES cells of its nearest routes, so that the work grows with the vectors, not with
their square; there is one route for CELL vectors. A cell above CELL_MOST vectors is cut
into blocks by hash, and who asks the cell asks every block: nothing is left out. Its askers are cut into groups of about ASKERS likewise,
and each group meets each block, so no task holds more than about CELL_MOST + ASKERS vectors.

Within a block the vectors are projected on PROJECTIONS random lines; the projections on each line are one sorted array. A query's window
on a line is centred on its own projection. Windows start narrow and widen by RADII (virtual rehashing): a vector that
falls into at least the threshold of the query's windows at some radius is a candidate and is verified by its exact
cosine; a query that has k verified vectors within the radius doesn't go on. Distances are those of unit vectors, so the
nearest are those of the highest cosine; the last radius covers every angle up to about 53 degrees, and a query that is
still short of k after it is compared with the whole of its own cell.

Usable vectors have the given number of numbers (`dimensions`), none of them NaN or infinite and not all zero. Repeated rows count once. Blocks with
equal vectors are one vector in the search, with their members written out afterwards, so no copy hides another
neighbour. Ties: by score, then by block_id. Fewer than k others give fewer rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.plans.lineage import written

DIMENSIONS, PROJECTIONS, PROBES = 96, 32, 4
ROUTES, CELL, CELL_MOST, ASKERS = 16_384, 1000, 8192, 32_768
#: Numbers of one table of hits, of queries and stored vectors.
PRODUCT = 1 << 20
#: The sample that the routes are fitted on: rows in all, rows for each route, rounds.
SAMPLE, SAMPLE_EACH, ROUNDS = 65_536, 150, 8
#: Unit distances at which windows are tried; half-width of a window for each of them, and hits needed of PROJECTIONS.
RADII = (0.3, 0.55, 0.9)
HALF_WIDTH, HITS = 1.1, 0.5


def usable(vectors: DataFrame, id_col: str = "block_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, v): one row for each id; of an id with several vectors the one with the smallest hash."""
    v = F.col(vector_col)
    sound = (F.size(v) == dimensions) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(id_col).isNotNull() & sound).select(F.col(id_col).alias("id"), v.cast("array<float>").alias("v")).groupBy("id").agg(F.min_by("v", F.xxhash64("v")).alias("v"))


def _units(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(max(1, len(column)), -1)[: len(column)].astype(np.float64)
    flat = flat / np.abs(flat).max(axis=1, keepdims=True)
    return (flat / np.linalg.norm(flat, axis=1, keepdims=True)).astype(np.float32)


def _cosines(column: pa.Array, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of pairs of rows, summed in 64 bits and then rounded: vectors of one direction have exactly 1, and tie, on any machine."""
    v = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    out = np.empty(len(a), np.float32)
    for at in range(0, len(a), 20_000):
        x, y = (v[i[at : at + 20_000]].astype(np.float64) for i in (a, b))
        x, y = (m / np.abs(m).max(axis=1, keepdims=True) for m in (x, y))
        out[at : at + 20_000] = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    return np.minimum(out, np.float32(1))


def routes(distinct: DataFrame) -> np.ndarray:
    """At most ROUTES unit vectors, about one for CELL rows: spherical k-means on a bounded sample, the rows of smallest hash."""
    n = distinct.count()
    want = min(ROUTES, max(1, n // CELL))
    column = distinct.select("v").orderBy(F.xxhash64("v", F.lit(11))).limit(min(SAMPLE, SAMPLE_EACH * want)).toArrow().column("v").combine_chunks()
    if not len(column):
        return np.zeros((0, 1), np.float32)
    sample = _units(column)
    centres = sample[:want].copy()
    for _ in range(ROUNDS):
        home = np.concatenate([(sample[at : at + 2000] @ centres.T).argmax(axis=1) for at in range(0, len(sample), 2000)])
        order = np.argsort(home, kind="stable")
        cells, first = np.unique(home[order], return_index=True)
        sums = np.add.reduceat(sample[order], first, axis=0)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres[cells] = np.where(length > 0, sums / np.maximum(length, 1e-12), centres[cells])
    return centres


def _nearest(queries: np.ndarray, data: np.ndarray, same: np.ndarray, home: np.ndarray, lines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices and cosines of the k nearest of data for each query; -1 where there are fewer. same: the query's own place in data, or -1. home: whether the query's own cell is this one."""
    n = len(data)
    take = min(k, n)
    best = np.full((len(queries), k), -1, np.int64)
    score = np.full((len(queries), k), -2, np.float32)
    projected = data @ lines
    order = np.argsort(projected, axis=0)
    arrays = [np.ascontiguousarray(projected[order[:, i], i]) for i in range(PROJECTIONS)]
    # the place of each vector in each sorted array: a window holds the places from its first one on, up to its width
    places = np.empty((PROJECTIONS, n), np.uint16 if n < 1 << 16 else np.uint32)
    for i in range(PROJECTIONS):
        places[i, order[:, i]] = np.arange(n)
    asked = queries @ lines

    def keep(q: np.ndarray, collided: np.ndarray | None) -> None:
        cosine = queries[q] @ data.T
        if collided is not None:
            cosine[~collided] = -2
        own = np.flatnonzero(same[q] >= 0)
        cosine[own, same[q[own]]] = -2
        top = np.argpartition(-cosine, take - 1, axis=1)[:, :take] if n > take else np.tile(np.arange(n), (len(q), 1))
        value = np.take_along_axis(cosine, top, axis=1)
        by = np.argsort(-value, axis=1, kind="stable")
        value = np.take_along_axis(value, by, axis=1)
        best[q, :take] = np.where(value > -2, np.take_along_axis(top, by, axis=1), -1)
        score[q, :take] = value

    step, open_ = max(1, PRODUCT // max(1, n)), np.arange(len(queries))
    for radius in RADII:
        half = HALF_WIDTH * radius
        for at in range(0, len(open_), step):
            q = open_[at : at + step]
            hits = np.zeros((len(q), n), np.uint8)
            for i in range(PROJECTIONS):
                low = np.searchsorted(arrays[i], asked[q, i] - half)
                width = np.searchsorted(arrays[i], asked[q, i] + half, "right") - low
                hits += places[i] - low.astype(places.dtype)[:, None] < width.astype(places.dtype)[:, None]  # unsigned: places before the window are far behind it
            keep(q, hits >= HITS * PROJECTIONS)
        open_ = open_[score[open_, take - 1] < 1 - radius * radius / 2]
        if not len(open_):
            return best, score
    short = open_[home[open_]]
    for at in range(0, len(short), step):
        keep(short[at : at + step], None)
    return best, score


def nearest(vectors: DataFrame, k: int = 5, id_col: str = "block_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, neighbour, score, place) with place from 1 to k."""
    spark = vectors.sparkSession
    singles = usable(vectors, id_col, vector_col, dimensions)
    # equal vectors: the smallest id stands for all
    groups = written(singles.groupBy("v").agg(F.min("id").alias("head"), F.count("*").alias("n")).withColumn("v", F.col("v")), "vectors")
    chosen = routes(groups)
    if not len(chosen):
        return spark.createDataFrame([], "id string, neighbour string, score float, place int")
    shared = spark.sparkContext.broadcast(chosen)
    probes = min(PROBES, len(chosen))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                cosine = _units(part.column(1)) @ shared.value.T
                near = np.argpartition(-cosine, probes - 1, axis=1)[:, :probes] if probes < len(chosen) else np.tile(np.arange(probes), (len(cosine), 1))
                home = cosine.argmax(axis=1)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(home.astype(np.int32)), pa.array(near.astype(np.int32).tolist(), pa.list_(pa.int32()))], names=["head", "v", "home", "near"])

    routed = written(groups.select("head", "v").mapInArrow(route, "head string, v array<float>, home int, near array<int>"), "routed")
    # a cell's blocks of stored vectors and, apart from them, of askers; a table of at most ROUTES rows
    hits = routed.select(F.explode("near").alias("cell")).groupBy("cell").agg(F.count("*").alias("asking"))
    cells = routed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("n")).join(hits, "cell", "left")
    cells = F.broadcast(written(cells.select("cell", F.ceil(F.col("n") / CELL_MOST).cast("int").alias("number"), F.ceil(F.col("asking") / ASKERS).cast("int").alias("groups")), "cells"))
    part = lambda n, seed: F.pmod(F.xxhash64("head", F.lit(seed)), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asks = routed.select("head", "v", F.explode("near").alias("cell"), "home").join(cells, "cell")  # a cell without stored vectors has nothing to ask
    asks = asks.select("head", "v", "cell", each(F.col("number")).alias("block"), part(F.col("groups"), 1).alias("group"), F.lit(False).alias("stored"), (F.col("home") == F.col("cell")).alias("own"))
    stored = routed.select("head", "v", F.col("home").alias("cell")).join(cells.filter("groups is not null"), "cell").withColumn("block", part(F.col("number"), 0))
    stored = stored.select("head", "v", "cell", "block", each(F.col("groups")).alias("group"), F.lit(True).alias("stored"), F.lit(True).alias("own"))
    lines = np.random.RandomState(5).standard_normal((dimensions, PROJECTIONS)).astype(np.float32)

    def search(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_stored = table.column("stored").to_numpy()
        heads = np.array(table.column("head").to_pylist(), object)
        units = _units(table.column("v").combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.float32())))
        data, queries = np.flatnonzero(is_stored), np.flatnonzero(~is_stored)
        empty = pa.table({"head": pa.array([], pa.string()), "near": pa.array([], pa.string()), "score": pa.array([], pa.float32())})
        if not len(data) or not len(queries):
            return empty
        place = {h: i for i, h in enumerate(heads[data])}
        same = np.array([place.get(h, -1) for h in heads[queries]], np.int64)
        best, score = _nearest(units[queries], units[data], same, table.column("own").to_numpy()[queries], lines, k)
        there = best >= 0
        asker, near = queries[np.nonzero(there)[0]], data[best[there]]
        return pa.table({"head": pa.array(heads[asker].tolist(), pa.string()), "near": pa.array(heads[near].tolist(), pa.string()), "score": pa.array(_cosines(table.column("v").combine_chunks(), asker, near))})

    found = stored.unionByName(asks).groupBy("cell", "block", "group").applyInArrow(search, "head string, near string, score float")
    order = Window.partitionBy("head").orderBy(F.desc("score"), "near")
    top = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k).drop("place")
    # members of groups of equal vectors: the k smallest others of the own group first, then the k smallest of each neighbouring group
    by_vector = singles.join(groups.filter("n > 1").select("v", "head"), "v").select("head", "id")
    if by_vector.isEmpty():
        return top.withColumn("place", F.row_number().over(order)).select(F.col("head").alias("id"), F.col("near").alias("neighbour"), "score", "place")
    first = by_vector.withColumn("r", F.row_number().over(Window.partitionBy("head").orderBy("id"))).filter(F.col("r") <= k + 1).groupBy("head").agg(F.sort_array(F.collect_list("id")).alias("first"))
    shown = top.join(first.select(F.col("head").alias("near"), F.col("first").alias("copies")), "near", "left").select("head", F.explode(F.coalesce("copies", F.array("near"))).alias("near"), "score")
    inside = first.select("head", F.explode("first").alias("near"), F.lit(1.0).cast("float").alias("score"))
    ids = groups.select("head", F.col("head").alias("id")).join(first.select("head").withColumn("copied", F.lit(True)), "head", "left").filter("copied is null").select("head", "id").unionByName(by_vector)
    all_pairs = shown.unionByName(inside).join(ids, "head").filter("near != id")
    last = Window.partitionBy("id").orderBy(F.desc("score"), "near")
    return all_pairs.withColumn("place", F.row_number().over(last)).filter(F.col("place") <= k).select("id", F.col("near").alias("neighbour"), "score", "place")
