from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.catalog.vectors import PAIRS, vectors
from corpusloom.operators import graph, merge, similarity
from corpusloom.plans.lineage import written
from corpusloom.sources.tables import table

LIMIT = 0.4
COMPONENTS = f"""with recursive e as materialized {PAIRS.format(LIMIT)}, both_ways as (select a, b from e union all select b, a from e),
    reach as (select vec_id as n, vec_id as r from embeddings union select both_ways.b, reach.r from reach join both_ways on both_ways.a = reach.n),
    label as (select n as block_id, min(r) as cluster_id from reach group by n)"""


def _edges(spark, folder):
    return written(similarity.pairs_above(vectors(spark, folder), LIMIT), "pairs")


@query("op57_components", f"{COMPONENTS} select block_id, cluster_id from label")
def op57(spark, folder):
    return graph.components(vectors(spark, folder), _edges(spark, folder))


@query("op58_cluster_confidence", f"{COMPONENTS} select cluster_id, size, round(coalesce(c, 1.0), 4) as confidence from (select cluster_id, count(*) as size from label group by 1) s left join (select cluster_id, avg(score) as c from e join label on label.block_id = e.a group by 1) i using (cluster_id)")
def op58(spark, folder):
    edges = _edges(spark, folder)
    return graph.confidence(graph.components(vectors(spark, folder), edges), edges)


@query("op59_louvain")
def op59(spark, folder):
    edges = written(similarity.pairs_above(vectors(spark, folder), 0.3), "pairs")
    return graph.communities(graph.components(vectors(spark, folder), edges), edges)


@query("op61_strongest_partition")
def op61(spark, folder):
    edges = written(similarity.pairs_above(vectors(spark, folder), 0.3), "pairs")
    return graph.partitioned(graph.components(vectors(spark, folder), edges), edges)


@query(
    "op62_fallback_merge",
    """with m as (select distinct on (record_id) record_id, group_id, name from raw_merged_block)
    select min(record_id) as block_id, min_by(name, record_id) as name, count(*) as size, case when count(*) > 1 then list_sort(list(record_id))[2:] else []::bigint[] end as parents from m group by group_id""",
)
def op62(spark, folder):
    m = table(spark, folder, "raw_merged_block").select("record_id", "group_id", "name").dropDuplicates(["record_id"]).withColumnRenamed("record_id", "block_id")
    out = merge.fallback_merged(m, m.select("block_id", F.col("group_id").alias("cluster_id")), "name")
    return out.withColumn("parents", F.transform("parents", lambda x: x.cast("bigint")))


_TAGS = ", ".join(f"'{t}'" for t in merge.TAGS)


@query(
    "op63_merge_coercion",
    f"""select distinct record_id, list_filter(list_transform(tags, lambda t: upper(trim(t))), lambda t, i: t in ({_TAGS}) and not list_contains(list_transform(tags, lambda u: upper(trim(u)))[1:i - 1], t)) as tags,
    case when coalesce(trim(name), '') = '' then 'missing name' when coalesce(trim(trusted_answer), '') = '' then 'missing answer' when length(trim(trusted_answer)) > 500 then 'answer too long' end as error from raw_merged_block""",
)
def op63(spark, folder):
    return merge.coerced(table(spark, folder, "raw_merged_block")).select("record_id", "tags", "error").distinct()


def _distilled(spark, folder):
    m = table(spark, folder, "raw_merged_block").dropDuplicates(["record_id"])
    return merge.distill(m.select(F.col("record_id").cast("string").alias("block_id"), "name", "critical_question", "trusted_answer"), start=0.9, step=0.02)


@query("op64_distill")
def op64(spark, folder):
    return _distilled(spark, folder)[0]


@query("op65_hierarchical_merge")
def op65(spark, folder):
    edges = written(similarity.pairs_above(vectors(spark, folder), 0.25), "pairs")
    parts = graph.partitioned(graph.components(vectors(spark, folder), edges), edges)
    canonical = parts.groupBy("cluster_id", "part").agg(F.min("block_id").alias("canonical"), F.count("*").alias("n"))
    return canonical.groupBy("cluster_id").agg(F.min("canonical").alias("block_id"), F.count("*").alias("parts"), F.sum("n").alias("size"))


@query("op66_distill_rounds")
def op66(spark, folder):
    _, figures = _distilled(spark, folder)
    rows = [(f["round"], f["threshold"], f["blocks"], f["edges"], f["survivors"], merge.reduction(f["survivors"], figures[0]["blocks"])) for f in figures]
    return spark.createDataFrame(rows, "round int, threshold double, blocks long, edges long, survivors long, reduction double")
