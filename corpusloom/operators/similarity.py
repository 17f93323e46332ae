"""Vector search and similarity joins: exact by blocks of matrix products, or by random hyperplanes and exact verification."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import dot

#: Query vectors broadcast at once; more are taken in further passes over the data.
QUERY_BYTES = 64 << 20
#: Numbers of one product of queries and rows.
PRODUCT = 4 << 20
#: Rows of a bucket of equal signatures that are compared with one another at once; larger ones are cut into pairs of blocks.
BUCKET = 2048
#: Vectors of a block of the exact join; tables above SPREAD blocks take larger ones, up to WIDE, so that fewer copies are sent.
BLOCK, SPREAD, WIDE = 2048, 8, 8192


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def top_k(scores: DataFrame, group: list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group with their rank from 1; Spark prunes to k before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, data: DataFrame, k: int, query_id: str = "query_id", id_col: str = "block_id", vector_col: str = "vector", digits: int = 6, exclude_self: bool = False, other_than: str | None = None, within: str | None = None) -> DataFrame:
    """Exact: (query_id, id_col, score, rank) of the k rows of highest dot product, ties by id.

    other_than: a column of both sides; rows that have the query's value, and nulls, are left out before the k are taken.
    within: a column of few whole numbers of the data; the k are taken, and ranked, for each of its values, which comes out as well.

    The query set is the stated side: it is sent to the partitions of the data in blocks of bounded size, each task keeps its
    best k for each query, and one window merges them. A product in a task holds at most about PRODUCT numbers.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    spark = data.sparkSession
    q_type, d_type = queries.schema[query_id].dataType.simpleString(), data.schema[id_col].dataType.simpleString()
    schema = f"{query_id} {q_type}, {id_col} {d_type}, score double, band int"
    more = [other_than] if other_than else []
    size = queries.agg(F.count("*").alias("n"), F.max(F.size(vector_col)).alias("d")).first()
    passes = max(1, math.ceil((size.n or 0) * (size.d or 1) * 8 / QUERY_BYTES))
    out = spark.createDataFrame([], schema)
    for p in range(passes):
        rows = queries.filter(F.pmod(F.xxhash64(query_id), F.lit(passes)) == p).select(query_id, vector_col, *more).collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast((pa.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64), [r[2] for r in rows] if more else None))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, q, values = shared.value
            if values:
                number = {x: n for n, x in enumerate({x for x in values if x is not None})}
                taken = np.array([number.get(x, -1) for x in values])
            for batch in batches:
                for low in range(0, batch.num_rows, 4096):
                    whole = batch.slice(low, 4096)
                    bands = whole.column(2).to_numpy(zero_copy_only=False)
                    for band in np.unique(bands):
                        part = whole.take(pa.array(np.flatnonzero(bands == band)))
                        m = _matrix(part.column(1))
                        if m.shape[1] != q.shape[1]:
                            raise ValueError("vectors of different length")
                        take, step = min(k + int(exclude_self), part.num_rows), max(1, PRODUCT // part.num_rows)
                        for first in range(0, len(q), step):
                            s = np.round(q[first : first + step] @ m.T, digits)
                            if values:
                                # -1: null, -2: a value that no query has
                                own = np.array([-1 if x is None else number.get(x, -2) for x in part.column(3).to_pylist()])
                                of = taken[first : first + step, None]
                                s[(of == own) | (of == -1) | (own == -1)] = -np.inf
                            # everything that ties with the last kept one stays, for the window to decide by id
                            least = np.partition(s, -take, axis=1)[:, -take]
                            i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                            yield pa.RecordBatch.from_arrays([names.take(pa.array(i + first)), part.column(0).take(pa.array(j)), pa.array(s[i, j]), pa.array(np.full(len(i), band, np.int32))], names=[query_id, id_col, "score", "band"])

        out = out.unionByName(data.select(id_col, vector_col, (F.col(within) if within else F.lit(0)).cast("int").alias("band"), *more).mapInArrow(run, schema))
    if exclude_self:
        out = out.filter(F.col(query_id) != F.col(id_col))
    if within:
        return top_k(out.withColumnRenamed("band", within), [query_id, within], k, F.desc("score"), F.col(id_col))
    return top_k(out.drop("band"), [query_id], k, F.desc("score"), F.col(id_col))


def pairs_above(vectors: DataFrame, threshold: float, id_col: str = "block_id", vector_col: str = "vector", digits: int = 6, blocks: int | None = None) -> DataFrame:
    """Exact similarity join: (a, b, score) with a < b and dot product >= threshold.

    Vectors are hashed into blocks; each pair of blocks is one group, multiplied at once. A vector is sent to as many groups as
    there are blocks. The work is quadratic by definition: for large tables use candidates() or the neighbour search.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = 0 if blocks else vectors.count()
    n = blocks or max(1, min(math.ceil(rows / BLOCK), max(SPREAD, math.ceil(rows / WIDE))))
    own = F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")
    spread = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), own.alias("own")).select("id", "v", "own", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("other"))
    cells = spread.select("id", "v", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def cell(key: tuple, table: pa.Table) -> pa.Table:
        x, y = key[0].as_py(), key[1].as_py()
        own = table.column("own").to_numpy()
        ids, m = table.column("id").combine_chunks(), _matrix(table.column("v"))
        a, b = np.flatnonzero(own == x), np.flatnonzero(own == y)
        found_a, found_b, found_s = [], [], []
        right = m[b].T
        for at in range(0, len(a), 512):
            s = m[a[at : at + 512]] @ right
            # few pairs are near the threshold, and only those need rounding
            i, j = np.nonzero(s >= threshold - 10.0**-digits)
            near = np.round(s[i, j], digits)
            i, j, s = i[near >= threshold], j[near >= threshold], near[near >= threshold]
            found_a.append(a[at + i])
            found_b.append(b[j])
            found_s.append(s)
        i, j, s = (np.concatenate(f) if f else np.zeros(0, int) for f in (found_a, found_b, found_s))
        return pa.table({"p": ids.take(pa.array(i.astype(np.int64))), "q": ids.take(pa.array(j.astype(np.int64))), "score": pa.array(s.astype(np.float64))})

    found = cells.groupBy("x", "y").applyInArrow(cell, f"p {kind}, q {kind}, score double")
    # within one block each pair comes both ways
    return found.filter("p != q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "score").dropDuplicates(["a", "b"])


def verified(candidates: DataFrame, vectors: DataFrame, threshold: float, id_col: str = "block_id", vector_col: str = "vector", digits: int = 6) -> DataFrame:
    """Candidate pairs once each, without unknown ids, scored exactly."""
    once = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct()
    x = vectors.select(F.col(id_col).alias("a"), F.col(vector_col).alias("va"))
    y = vectors.select(F.col(id_col).alias("b"), F.col(vector_col).alias("vb"))
    return once.join(x, "a").join(y, "b").select("a", "b", F.round(dot(F.col("va"), F.col("vb")), digits).alias("score")).filter(F.col("score") >= threshold)


def hyperplanes(dimension: int, k: int = 6, tables: int = 20, seed: int = 42) -> np.ndarray:
    """(tables, k, dimension) standard normal numbers, drawn table by table, plane by plane."""
    r = random.Random(seed)
    return np.array([[[r.gauss(0.0, 1.0) for _ in range(dimension)] for _ in range(k)] for _ in range(tables)])


def candidates(vectors: DataFrame, dimension: int, k: int = 6, tables: int = 20, seed: int = 42, id_col: str = "block_id", vector_col: str = "vector") -> DataFrame:
    """(a, b) of vectors that share a signature in any table, each pair once: only its lowest common table reports it.

    Rows are partitioned and sorted by (table, signature); within a partition, rows at every distance in the same bucket are
    compared at once. Each row brings its signatures, so no pair needs a shuffle to be told apart from its copies. A bucket above
    BUCKET rows is cut into blocks by hash, and each pair of its blocks is a group of its own, so none is held whole by a task.
    """
    planes = hyperplanes(dimension, k, tables, seed).reshape(tables * k, dimension)
    kind = vectors.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1))
            n = batch.num_rows
            bits = (m @ planes.T > 0).reshape(n, tables, k) if n else np.zeros((0, tables, k), bool)
            s = (bits * (1 << np.arange(k, dtype=np.int64))).sum(axis=2).astype(np.int32)
            rows = np.repeat(np.arange(n), tables)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(s.ravel()), tables).cast(pa.list_(pa.int32())).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(s.ravel()), batch.column(0).take(pa.array(rows)), lists], names=["t", "key", "id", "s"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = [], 0

        def done(whole: pa.Table) -> Iterator[pa.RecordBatch]:
            n = whole.num_rows
            if n < 2:
                return
            t, key = whole.column("t").to_numpy(), whole.column("key").to_numpy()
            s = whole.column("s").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, tables)
            ids = whole.column("id").combine_chunks()
            cell, block = whole.column("cell").to_numpy(), whole.column("block").to_numpy()
            group = t.astype(np.int64) << 32 | key
            fresh = (group[1:] != group[:-1]) | (cell[1:] != cell[:-1])
            starts = np.flatnonzero(np.concatenate([[True], fresh]))
            sizes = np.diff(np.append(starts, n))
            alone = cell == block * (1 + (1 << 31))  # a block with itself
            left = np.repeat(sizes, sizes) - (np.arange(n) - np.repeat(starts, sizes)) - 1
            i, lag = np.flatnonzero(left > 0), 0
            before = np.arange(tables)
            while len(i):
                lag += 1
                for at in range(0, len(i), 100_000):
                    x = i[at : at + 100_000]
                    x = x[alone[x] | (block[x] != block[x + lag])]
                    lowest = ~((s[x] == s[x + lag]) & (before < t[x, None])).any(axis=1)
                    if lowest.any():
                        x = x[lowest]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(x)), ids.take(pa.array(x + lag))], names=["p", "q"])
                i = i[left[i] > lag]

        for batch in batches:
            kept.append(batch)
            rows += batch.num_rows
            if rows < 100_000:
                continue
            whole = pa.Table.from_batches(kept)
            t, key, cell = (whole.column(c).to_numpy() for c in ("t", "key", "cell"))
            last = np.flatnonzero((t != t[-1]) | (key != key[-1]) | (cell != cell[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0
            yield from done(whole.slice(0, cut))
            kept, rows = whole.slice(cut).combine_chunks().to_batches(), whole.num_rows - cut
        if kept:
            yield from done(pa.Table.from_batches(kept))

    signed = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(sign, f"t int, key int, id {kind}, s array<int>")
    hot = signed.groupBy("t", "key").agg(F.ceil(F.count("*") / BUCKET).alias("blocks")).filter("blocks > 1")
    if hot.isEmpty():
        celled = signed.withColumn("block", F.lit(0).cast("bigint")).withColumn("cell", F.lit(0).cast("bigint"))
    else:
        blocks = signed.join(hot, ["t", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        other = blocks.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        celled = other.withColumn("cell", F.least("block", "other") + F.shiftleft(F.greatest("block", "other"), 31)).drop("blocks", "other")
    found = celled.repartition("t", "key", "cell").sortWithinPartitions("t", "key", "cell").mapInArrow(pair, f"p {kind}, q {kind}")
    return found.filter("p != q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def hyperplane_pairs(vectors: DataFrame, dimension: int, threshold: float, recall: float = 0.999, k: int = 6, seed: int = 42, id_col: str = "block_id", vector_col: str = "vector", digits: int = 6) -> DataFrame:
    """(a, b, score) of the pairs >= threshold that share a signature in any table, with as many tables as the recall at the threshold needs.

    The same as verified(candidates(...)), but each bucket is multiplied at once, so that only pairs above the threshold leave it.
    """
    tables = tables_for(threshold, recall, k)
    planes = hyperplanes(dimension, k, tables, seed).reshape(tables * k, dimension)
    kind = vectors.schema[id_col].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                n = part.num_rows
                bits = (_matrix(part.column(1)) @ planes.T > 0).reshape(n, tables, k)
                s = (bits * (1 << np.arange(k, dtype=np.int64))).sum(axis=2).astype(np.int32)
                rows = pa.array(np.repeat(np.arange(n), tables))
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(s.ravel()), part.column(0).take(rows), part.column(1).take(rows)], names=["t", "key", "id", "v"])

    def bucket(table: pa.Table) -> pa.Table:
        ids, m = table.column("id").combine_chunks(), _matrix(table.column("v"))
        found: list[tuple] = []
        for at in range(0, len(m), 512):
            s = m[at : at + 512] @ m[at:].T
            i, j = np.nonzero(s >= threshold - 10.0**-digits)
            near = np.round(s[i, j], digits)
            keep = (near >= threshold) & (i < j)
            found.append((i[keep] + at, j[keep] + at, near[keep]))
        i, j, s = (np.concatenate(f) for f in zip(*found))
        return pa.table({"p": ids.take(pa.array(i)), "q": ids.take(pa.array(j)), "score": pa.array(s)})

    v = vectors.schema[vector_col].dataType.simpleString()
    signed = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(sign, f"t int, key int, id {kind}, v {v}")
    found = signed.groupBy("t", "key").applyInArrow(bucket, f"p {kind}, q {kind}, score double")
    return found.filter("p != q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "score").dropDuplicates(["a", "b"])


def tables_for(cosine: float, recall: float, k: int = 6) -> int:
    """The fewest tables whose theoretical recall at the cosine is at least the given one."""
    missed = 1 - theoretical_recall(cosine, k, 1)
    return 1 if missed <= 0 else max(1, math.ceil(math.log(1 - recall) / math.log(missed)))


def theoretical_recall(cosine: float, k: int = 6, tables: int = 20) -> float:
    angle = math.acos(max(-1.0, min(1.0, cosine)))
    return 1 - (1 - (1 - angle / math.pi) ** k) ** tables


def use_hyperplanes(n: int, least: int = 5000) -> bool:
    return n >= least
