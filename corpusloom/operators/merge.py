"""Clusters of blocks into canonical blocks, in one round or in tightening rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.operators import embedding, graph, similarity
from corpusloom.plans.lineage import written

TAGS = ["IMPORTANT", "WARNING", "TECHNOLOGY", "PROCESS", "REFERENCE", "FAQ", "TROUBLESHOOTING", "SECURITY", "ARCHITECTURE", "API", "DATASET", "POLICY"]
#: What a merge result holds.
FIELDS = ["name", "critical_question", "trusted_answer", "tags", "entities", "keywords", "reasoning"]
#: Start, step and cap of the threshold, and rounds.
START, STEP, CAP, ROUNDS, CLUSTER_MOST = 0.55, 0.01, 0.98, 4, 20


def fallback_merged(blocks: DataFrame, labels: DataFrame, *kept: str) -> DataFrame:
    """Each cluster's first member by id with its columns, the size of the cluster and, for merged ones, the ids of the others.

    Only ids are gathered into lists (the parents are part of the result); the columns come from one row.
    """
    own = blocks.select("block_id", *kept).join(labels, "block_id")
    first = F.struct("block_id", *kept)
    merged = own.groupBy("cluster_id").agg(F.min_by(first, "block_id").alias("f"), F.count("*").alias("size"), F.sort_array(F.collect_list("block_id")).alias("ids"))
    return merged.select("f.*", "size", F.when(F.col("size") > 1, F.slice("ids", 2, F.greatest(F.col("size") - 1, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<string>")).alias("parents"))


def coerce_tags(tags):
    """Tags of the vocabulary, in upper case, each once, in order."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.upper(F.trim(t))), lambda t: t.isin(TAGS)))


def unwrapped(rows: DataFrame) -> DataFrame:
    """Merge results out of their envelopes: the fields of the struct `block`, else of `merged`, else the row's own."""
    envelopes = [c for c in ("block", "merged") if c in rows.columns and isinstance(rows.schema[c].dataType, T.StructType)]
    if not envelopes:
        return rows
    own = [c for c in rows.columns if c not in envelopes]
    names = dict.fromkeys([*own, *(f for e in envelopes for f in rows.schema[e].dataType.names)])
    out = []
    for n in names:
        value = F.col(n) if n in own else F.lit(None)
        for e in reversed(envelopes):
            # a key beside the envelope belongs to the row, a field that the envelope lacks is missing
            inside = F.col(e)[n] if n in rows.schema[e].dataType.names else value if n not in FIELDS else F.lit(None)
            value = F.when(F.col(e).isNotNull(), inside).otherwise(value)
        out.append(value.alias(n))
    return rows.select(*out)


def coerced(rows: DataFrame) -> DataFrame:
    """Merge results made sound: out of their envelopes, tags of the vocabulary, an error for invalid ones, confidence (where there is one) between 0 and 1."""
    rows = unwrapped(rows)
    if "confidence" in rows.columns:
        c = F.col("confidence")
        rows = rows.withColumn("confidence", F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))))
    answer = F.trim("trusted_answer")
    error = F.when(F.coalesce(F.trim("name"), F.lit("")) == "", "missing name").when(F.coalesce(answer, F.lit("")) == "", "missing answer").when(F.char_length(answer) > 500, "answer too long")
    return rows.withColumn("tags", coerce_tags(F.col("tags"))).withColumn("error", error)


def distill(blocks: DataFrame, start: float = START, step: float = STEP, cap: float = CAP, rounds: int = ROUNDS, dimension: int = 128) -> tuple[DataFrame, list[dict]]:
    """Rounds of embed, join, cluster and merge, each with a higher threshold, until no cluster of two is left.

    blocks: block_id, name, critical_question, trusted_answer. Returns the survivors with `parents`, the original ids of everything
    merged into them, and one row of figures for each round. The join is exact at every size. Clusters above CLUSTER_MOST are merged in parts first; as the
    merge keeps the first member, that changes no result, so parts aren't made here.
    """
    current = written(blocks.select("block_id", "name", "critical_question", "trusted_answer").withColumn("parents", F.array().cast("array<string>")), "round")
    figures: list[dict] = []
    threshold = start
    for n in range(rounds):
        text = embedding.embedding_text(F.col("name"), F.col("critical_question"), F.col("trusted_answer"))
        vectors = written(embedding.dense(current, "block_id", text, dimension), "vectors")
        edges = written(similarity.pairs_above(vectors, threshold), "edges")
        labels = graph.components(current, edges)
        own = current.join(labels, "block_id")
        first = F.min_by(F.struct("block_id", "name", "critical_question", "trusted_answer"), "block_id")
        ids = F.flatten(F.collect_list(F.concat("parents", F.array("block_id"))))
        after = own.groupBy("cluster_id").agg(first.alias("f"), F.array_sort(F.array_distinct(ids)).alias("ids"))
        after = written(after.select("f.*", F.array_remove("ids", F.col("f.block_id")).alias("parents")), "round")
        survivors, before = after.count(), current.count()
        figures.append({"round": n + 1, "threshold": round(threshold, 6), "blocks": before, "edges": edges.count(), "survivors": survivors, "merged": before - survivors})
        current = after
        if survivors == before:
            break
        threshold = min(cap, threshold + step)
    return current, figures


def reduction(survivors: int, blocks: int) -> float:
    return 0.0 if blocks == 0 else 1.0 - survivors / blocks
