"""Batch question answering: whole tables of questions through retrieve, grade, refine and read; model steps are pluggable."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import reading
from corpusloom.plans.lineage import written

Search = Callable[[DataFrame], DataFrame]


def _grades(found: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, relevance) of every question: mean token overlap of its first five blocks, rounded, as the order of a sum decides its last digits."""
    q, a = F.array_distinct(T.latin_tokens(F.col("query"))), T.latin_tokens(F.coalesce("text", F.lit("")))
    o = F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, a)) / F.size(q))
    g = found.filter("rank <= 5").join(questions, "query_id").groupBy("query_id").agg(F.round(F.avg(o), 9).alias("relevance"))
    return questions.select("query_id").join(g, "query_id", "left").select("query_id", F.coalesce("relevance", F.lit(0.0)).alias("relevance"))


def refined(query):
    """Offline refinement: the question without its first word, which is mostly a question word."""
    return F.regexp_replace(query, r"^\s*\S+\s+", "")


def first_text(texts):
    """Offline reader: the best evidence itself."""
    return F.get(texts, 0)


def ask(questions: DataFrame, search: Search, least: float = 0.5, rounds: int = 2, refine=refined, read=first_text) -> DataFrame:
    """(query_id, answer, block_id, relevance, abstained, reason, confidence).

    questions: query_id, query. search: gives (query_id, block_id, text, score, rank). Only questions whose evidence is graded
    below `least` are refined and searched again; of all rounds the best-graded evidence is kept. read: makes the answer of the texts of up to
five blocks, best first; it is faithful as far as its words are in them.
    """
    todo = written(questions.select("query_id", "query"), "questions")
    best = None
    for n in range(rounds + 1):
        found = written(search(todo).select("query_id", "block_id", "text", "score", "rank"), "found")
        grades = _grades(found, todo)
        now = written(grades.join(found.filter("rank <= 5"), "query_id", "left").withColumn("round", F.lit(n)), "graded")
        best = now if best is None else best.unionByName(now)
        todo = written(todo.join(grades.filter(F.col("relevance") < least), "query_id", "left_semi").withColumn("query", refine(F.col("query"))).filter("query != ''"), "questions")
        if n == rounds or todo.isEmpty():
            break
    evidence = F.array_sort(F.collect_list(F.when(F.col("block_id").isNotNull(), F.struct("rank", "block_id", "text"))))  # at most five
    each = best.groupBy("query_id", "round").agg(F.first("relevance").alias("relevance"), evidence.alias("e"))
    kept = each.groupBy("query_id").agg(F.max_by(F.struct("relevance", "e"), F.struct("relevance", -F.col("round"))).alias("b"), F.sum(F.size("e")).alias("found"))
    texts = F.transform("b.e", lambda x: F.coalesce(x["text"], F.lit("")))
    kept = kept.select("query_id", "b", "found", texts.alias("texts")).withColumn("said", read(F.col("texts")))
    faithful = reading.overlap_faithfulness(T.latin_tokens(F.coalesce("said", F.lit(""))), F.flatten(F.transform("texts", T.latin_tokens)))
    gate = reading.gated(F.col("said"), F.col("found"), faithful, F.col("b.relevance"))
    return kept.select("query_id", F.when(gate["abstained"], F.lit(None)).otherwise(F.col("said")).alias("answer"), F.get("b.e", F.lit(0))["block_id"].alias("block_id"), F.round("b.relevance", 6).alias("relevance"), gate.alias("g")).select("query_id", "answer", "block_id", "relevance", "g.abstained", "g.reason", F.round("g.confidence", 6).alias("confidence"))


def investigate(questions: DataFrame, search: Search, plan: Callable[[DataFrame], DataFrame], steps: int = 4, patience: int = 2) -> DataFrame:
    """(query_id, block_id, score, rank): evidence of a seed search and of up to `steps` planned ones.

    plan: gives the next (query_id, query) from the questions and the step's number. A question that gains no block in `patience`
    steps is left alone.
    """
    evidence = written(search(questions).select("query_id", "block_id", "score"), "evidence")
    idle = written(questions.select("query_id", "query", F.lit(0).alias("idle")), "idle")
    for n in range(steps):
        active = idle.filter(F.col("idle") < patience)
        if active.isEmpty():
            break
        more = written(search(plan(active.select("query_id", "query"), n)).select("query_id", "block_id", "score"), "step")
        gained = more.join(evidence, ["query_id", "block_id"], "left_anti").select("query_id").distinct().withColumn("g", F.lit(1))
        idle = written(idle.join(gained, "query_id", "left").select("query_id", "query", F.when(F.col("g") == 1, 0).otherwise(F.col("idle") + 1).alias("idle")), "idle")
        evidence = written(reading.merged_evidence(evidence.unionByName(more)).drop("rank"), "evidence")
    return reading.merged_evidence(evidence)
