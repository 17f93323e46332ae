"""Streams of documents and events into indexes, in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from corpusloom.operators import lexical


def incremental_index(stream: DataFrame, id_col: str, tokens: Column, index: str, checkpoint: str) -> StreamingQuery:
    """Keeps the postings of all rows seen, appended batch by batch; a row that comes again replaces its earlier postings when read.

    Each batch is written under its number, so a batch that is repeated after a failure overwrites itself.
    """

    def batch(rows: DataFrame, number: int) -> None:
        lexical.postings(rows.dropDuplicates([id_col]), id_col, tokens).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{index}/n={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_index(spark: SparkSession, index: str, id_col: str) -> DataFrame:
    """The postings with the last batch of each row."""
    rows = spark.read.parquet(index).drop("n")
    last = rows.groupBy(id_col).agg(F.max("batch").alias("batch"))
    return rows.join(last, [id_col, "batch"], "left_semi").drop("batch")


def windowed_counts(events: DataFrame, time_col: str, size: str, late: str, *by: str, slide: str | None = None) -> DataFrame:
    """Tumbling or sliding counts and sums with a watermark; works on a stream and on a table."""
    w = F.window(time_col, size, slide) if slide else F.window(time_col, size)
    out = events.withWatermark(time_col, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, time_col: str, gap: str, late: str, *by: str) -> DataFrame:
    s = events.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap), *by).agg(F.count("*").alias("n"))
    return s.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *by, "n")


class Progress(StreamingQueryListener):
    """Hands the rows of each micro-batch to a callback, and the end of the query."""

    def __init__(self, tell: Callable[[str, dict], None]):
        self.tell = tell

    def onQueryStarted(self, event):
        self.tell("started", {"id": str(event.id)})

    def onQueryProgress(self, event):
        self.tell("progress", {"batch": event.progress.batchId, "rows": event.progress.numInputRows})

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.tell("error" if event.exception else "done", {"error": event.exception})
