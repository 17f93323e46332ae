from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.catalog.lexical import index_sql
from corpusloom.catalog.text import INDEX
from corpusloom.functions import text as T
from corpusloom.plans.jobs import Jobs
from corpusloom.plans.lineage import shared_folder
from corpusloom.sources.corpus import blocks
from corpusloom.sources.tables import table
from corpusloom.streaming import ingest


@query("op67_job", "select status, count(*) as n from {blocks} group by status")
def op67(spark, folder):
    """The roll-up as a job with phases; its rows come back as the result."""

    def work(job):
        job.phase(0.15)
        rows = blocks(spark, folder, "status").groupBy("status").agg(F.count("*").alias("n")).collect()
        job.phase(0.85)
        return [(r.status, r.n) for r in rows]

    jobs = Jobs(spark)
    job = jobs.submit(work)
    if job.wait(600) != "success":
        raise RuntimeError(job.error)
    return spark.createDataFrame(job.result, "status string, n long")


@query("op140_incremental_ingest", f"select term, count(*) as df, sum(tf)::bigint as occurrences from {index_sql(INDEX.format('text'), '(select doc_id as block_id, text from documents)')} group by 1")
def op140(spark, folder):
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    docs = table(spark, folder, "documents")
    stream = spark.readStream.schema(docs.schema).option("pathGlobFilter", "*").parquet(f"{folder}/documents.parquet*").select(F.col("doc_id").alias("block_id"), "text")
    ingest.incremental_index(stream, "block_id", T.index_tokens(F.col("text")), f"{at}/index", f"{at}/checkpoint").awaitTermination()
    return ingest.read_index(spark, f"{at}/index", "block_id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


@query("op143_tumbling_windows", "select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def op143_tumbling(spark, folder):
    return ingest.windowed_counts(table(spark, folder, "events"), "ts", "1 hour", "10 minutes", "event_type")


@query("op143_sliding_windows", "select time_bucket(interval '30 minutes', ts) - (i * interval '30 minutes') as window_start, count(*) as n, round(sum(value), 4) as total from events, range(0, 2) as r(i) group by all")
def op143_sliding(spark, folder):
    return ingest.windowed_counts(table(spark, folder, "events"), "ts", "1 hour", "10 minutes", slide="30 minutes")


@query(
    "op143_session_windows",
    """with o as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as fresh from events), s as (select user_id, ts, sum(fresh) over (partition by user_id order by ts) as g from o)
    select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as n from s group by user_id, g""",
)
def op143_sessions(spark, folder):
    return ingest.sessions(table(spark, folder, "events"), "ts", "30 minutes", "10 minutes", "user_id")
