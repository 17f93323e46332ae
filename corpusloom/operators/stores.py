"""Tables that are changed by whole batches: upserts, deletes, cascades, and what a change would do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upserted(current: DataFrame, batch: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The batch's rows in place of the current ones with the same keys; of several in a batch the last in the given order."""
    if order:
        w = Window.partitionBy(*keys).orderBy(*order)
        batch = batch.withColumn("__n", F.row_number().over(w)).filter("__n <= 1").drop("__n")
    return current.join(batch.select(*keys), keys, "left_anti").unionByName(batch)


def deleted(current: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return current.join(gone.select(*keys).distinct(), keys, "left_anti")


def page(df: DataFrame, limit: int, offset: int = 0, *order: Column) -> DataFrame:
    """One page of a listing in a total order."""
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset must be >= 0")
    return df.orderBy(*order).offset(offset).limit(limit)


def has_any(tags: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(F.coalesce(tags, F.array().cast("array<string>")), F.array(*[F.lit(t) for t in wanted])) if wanted else F.lit(True)


def contains_text(needle: str, *columns: Column) -> Column:
    """Case-insensitive substring of any column; a needle's % and _ are themselves."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(c), F.lit(needle.lower())), F.lit(False))
    return hit


def change_kinds(current: DataFrame, batch: DataFrame, key: str, text: str) -> DataFrame:
    """(key, change): created, unchanged or updated, by the hash of the text."""
    old = current.select(key, F.sha2(text, 256).alias("__old"))
    return batch.select(key, F.sha2(text, 256).alias("__new")).join(old, key, "left").select(key, F.when(F.col("__old").isNull(), "created").when(F.col("__old") == F.col("__new"), "unchanged").otherwise("updated").alias("change"))


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children that name a parent that isn't there."""
    return children.filter(F.col(key).isNotNull()).join(parents.select(key).distinct(), key, "left_anti")
