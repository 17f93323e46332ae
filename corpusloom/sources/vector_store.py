"""Vector tables on disk: Parquet with a checked description beside it, and the one-object JSON form."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT, VERSION = "corpusloom-vectors", 1


def save(vectors: DataFrame, folder: str, id_col: str = "block_id", vector_col: str = "vector") -> None:
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    rows.write.parquet(f"{folder}/vectors")
    dimension = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    vectors.sparkSession.createDataFrame([(FORMAT, VERSION, int(dimension))], "format string, version int, dimension int").coalesce(1).write.json(f"{folder}/about")


def load(spark: SparkSession, folder: str) -> DataFrame:
    """(id, vector); another format or version, and vectors of another length than described, are errors."""
    about = spark.read.schema("format string, version int, dimension int").json(f"{folder}/about").first()
    if about is None or about.format != FORMAT:
        raise ValueError("not a vector store")
    if about.version != VERSION:
        raise ValueError(f"version {about.version} can't be read")
    rows = spark.read.parquet(f"{folder}/vectors")
    sound = F.assert_true((F.size("vector") == about.dimension) | F.lit(about.dimension == 0), "vector of another length")
    return rows.filter(sound.isNull())


def parse_json(text: str) -> tuple[int, dict[str, list[float]]]:
    """The JSON form: {"format", "version", "dimension", "vectors": {id: [...]}}."""
    d = json.loads(text)
    if d.get("format") != FORMAT or d.get("version") != VERSION:
        raise ValueError("not a vector store of this version")
    bad = [k for k, v in d["vectors"].items() if len(v) != d["dimension"]]
    if bad:
        raise ValueError(f"{len(bad)} vectors of another length")
    return d["dimension"], d["vectors"]
