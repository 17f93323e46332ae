"""From ranked blocks to an answer or an abstention, over tables of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a token, floors of faithfulness and confidence, evidence kept for a question.
CHARS, LEAST_FAITHFUL, LEAST_CONFIDENT, EVIDENCE = 4.0, 0.5, 0.2, 20


def within_budget(ranked: DataFrame, cost: Column, budget: float, keep: int = 1, query_id: str = "query_id") -> DataFrame:
    """The best-first prefix of each question whose costs stay within the budget, at least `keep` rows.

    As costs aren't negative, the running sum never comes back under the budget once it is over it.
    """
    w = Window.partitionBy(query_id).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum(cost).over(w)).filter((F.col("used") <= budget) | (F.col("rank") <= keep))


def head_tail(ranked: DataFrame, query_id: str = "query_id") -> DataFrame:
    """position: even places from the front, odd ones from the back, so that the strongest are at both ends."""
    r = F.col("rank") - 1
    n = F.count("*").over(Window.partitionBy(query_id))
    return ranked.withColumn("position", F.when(r % 2 == 0, r / 2).otherwise(n - 1 - (r - 1) / 2).cast("int"))


def grounded(citations: DataFrame, candidates: DataFrame, query_id: str = "query_id", id_col: str = "block_id") -> DataFrame:
    """Citations of blocks that the question was given, each once."""
    return citations.join(candidates.select(query_id, id_col).distinct(), [query_id, id_col], "left_semi").dropDuplicates([query_id, id_col])


def gated(text: Column, found: Column, faithful: Column, confident: Column) -> Column:
    """struct<abstained, reason, confidence>: nothing found, nothing said, unfaithful, unsure; else confidence times faithfulness."""
    no = lambda why: F.struct(F.lit(True).alias("abstained"), F.lit(why).alias("reason"), F.lit(0.0).alias("confidence"))
    eff = confident * F.coalesce(faithful, F.lit(1.0))
    return (
        F.when(found == 0, no("no candidates"))
        .when(F.coalesce(F.trim(text), F.lit("")) == "", no("empty answer"))
        .when(faithful < LEAST_FAITHFUL, no("unfaithful"))
        .when(confident < LEAST_CONFIDENT, no("unsure"))
        .otherwise(F.struct(F.lit(False).alias("abstained"), F.lit(None).cast("string").alias("reason"), eff.alias("confidence")))
    )


def overlap_faithfulness(answer: Column, evidence: Column) -> Column:
    """Offline judge: share of the answer's distinct tokens that the evidence has; an empty answer has none."""
    a = F.array_distinct(answer)
    return F.when(F.size(a) == 0, 0.0).otherwise(F.size(F.array_intersect(a, evidence)) / F.size(a))


def merged_evidence(steps: DataFrame, most: int = EVIDENCE, query_id: str = "query_id", id_col: str = "block_id") -> DataFrame:
    """Evidence of all steps: the best score of each block, at most `most` blocks for a question."""
    best = steps.groupBy(query_id, id_col).agg(F.max("score").alias("score"))
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


#: Other names of the actions.
ACTIONS = {
    "retrieve": "retrieve", "search": "retrieve", "lookup": "retrieve", "query": "retrieve",
    "plan": "plan", "decompose": "plan", "break_down": "plan",
    "synthesize": "synthesize", "synthesise": "synthesize", "answer": "synthesize", "finish": "synthesize", "done": "synthesize", "final": "synthesize",
}


def action(raw: Column, question: Column, parts: Column) -> Column:
    """An action by any of its names; what lacks its argument, and what is unknown, becomes synthesize."""
    named = F.coalesce(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv])[F.lower(F.trim(raw))], F.lit("synthesize"))
    no_query = F.coalesce(F.trim(question), F.lit("")) == ""
    no_parts = F.coalesce(F.size(F.filter(parts, lambda p: F.trim(p) != "")), F.lit(0)) < 1
    return F.when((named == "retrieve") & no_query, "synthesize").when((named == "plan") & no_parts, "synthesize").otherwise(named)
