"""Blocks, documents and feedback with each record once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.plans.lineage import written
from corpusloom.sources.tables import table

#: Hashes of repeated keys that may be sent to every executor (8 bytes each).
SENT = 500_000


def latest(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).filter("__n <= 1").drop("__n")


def blocks(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    df = table(spark, folder, "idea_blocks")
    return df.select("block_id", *[c for c in columns if c != "block_id"]).dropDuplicates(["block_id"]) if columns else df.dropDuplicates(["block_id"])


def once(df: DataFrame, key: str) -> DataFrame:
    """Each key once. Rows whose key has a hash of its own stay where they lie; only the others are shuffled, unless these are too many to be told apart so."""
    h = F.xxhash64(key)
    repeated = written(df.groupBy(h.alias("h")).agg(F.count("*").alias("n")).filter("n > 1").select("h"), "repeated")
    if repeated.count() > SENT:
        return df.dropDuplicates([key])
    hashed, repeated = df.withColumn("h", h), F.broadcast(repeated)
    return hashed.join(repeated, "h", "left_anti").unionByName(hashed.join(repeated, "h", "left_semi").dropDuplicates([key])).drop("h")


def docs(spark: SparkSession, folder: str) -> DataFrame:
    return latest(table(spark, folder, "document_record"), ["doc_id"], "arrival_id")


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "feedback").dropDuplicates(["feedback_id"])
