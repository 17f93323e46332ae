"""Feedback roll-ups, retrieval metrics, scaling tiers and adversarial traps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RATINGS = ("positive", "negative", "corrected")
#: Growth of the tiers, tolerance of a tie.
GROWTH, TIE = 1.25, 1e-9


def rating(c: Column) -> Column:
    return F.lower(F.trim(c))


def rollup(feedback: DataFrame, *by: str) -> DataFrame:
    """total, positive, negative, corrected and approval (0 for none) of each group, or of all."""
    r = rating(F.col("rating"))
    counts = [F.count_if(r == name).alias(name) for name in RATINGS]
    out = feedback.groupBy(*by).agg(F.count("*").alias("total"), *counts)
    return out.withColumn("approval", F.coalesce(F.round(F.try_divide(F.col("positive"), F.col("total")), 6), F.lit(0.0)))


def breakdown(feedback: DataFrame) -> DataFrame:
    """The roll-up of each block that a feedback names."""
    return rollup(feedback.select("rating", F.explode("block_ids").alias("block_id")), "block_id")


def low_recall(feedback: DataFrame, least_hits: int = 1, occurrences: int = 2) -> DataFrame:
    """(question, occurrences, average) of questions that came back with too few blocks again and again."""
    q = F.trim(F.regexp_replace(F.lower("query"), r"\s+", " "))
    n = F.coalesce(F.size("block_ids"), F.lit(0))
    few = feedback.select(q.alias("question"), F.when(n < 0, 0).otherwise(n).alias("n")).filter((F.col("question") != "") & (F.col("n") < least_hits))
    return few.groupBy("question").agg(F.count("*").alias("occurrences"), F.avg("n").alias("average")).filter(F.col("occurrences") >= occurrences)


def split_candidates(blocks: DataFrame, least: int = 2, ratio: float = 0.5) -> DataFrame:
    bad = F.round((F.col("negative") + F.col("corrected")) / F.col("total"), 6)
    return blocks.filter(F.col("total") >= least).withColumn("bad_ratio", bad).filter(F.col("bad_ratio") >= ratio)


def metrics(ranked: DataFrame, truth: DataFrame, queries: DataFrame, ks: Sequence[int] = (1, 3, 5), by: Sequence[str] = (), query_id: str = "query_id", id_col: str = "block_id") -> DataFrame:
    """hit_at_k, mrr (cut at the largest k) and mean top score, by group. Every query counts; the top score only where there are hits."""
    most = max(ks)
    keys = [*by, query_id]
    hit = ranked.join(truth.select(query_id, id_col).distinct(), [query_id, id_col], "left_semi").filter(F.col("rank") <= most).groupBy(*keys).agg(F.min("rank").alias("first"))
    top = ranked.groupBy(*keys).agg(F.max_by("score", -F.col("rank")).alias("top"))
    rows = queries.select(*keys).distinct().join(hit, keys, "left").join(top, keys, "left")
    cols = [F.round(F.avg(F.coalesce((F.col("first") <= k).cast("int"), F.lit(0))), 6).alias(f"hit_at_{k}") for k in ks]
    return rows.groupBy(*by).agg(F.count("*").alias("queries"), *cols, F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"), F.round(F.coalesce(F.avg("top"), F.lit(0.0)), 6).alias("top_score"))


def token_stats(rows: DataFrame, text: Column, *by: str) -> DataFrame:
    tokens = F.char_length(text) / 4.0
    return rows.groupBy(*by).agg(F.count("*").alias("units"), F.round(F.sum(tokens), 3).alias("tokens"), F.round(F.avg(tokens), 3).alias("average"))


def improvement(new: Column, old: Column) -> Column:
    """new over old; 0 where old is 0."""
    return F.coalesce(F.round(F.try_divide(new, old), 6), F.lit(0.0))


def tier_sizes(least: int, most: int, growth: float = GROWTH, cap: int | None = None) -> list[int]:
    """Sizes from least on, each growth times the one before, the last one the whole."""
    if growth <= 1:
        raise ValueError("growth must be > 1")
    out, size = [], least
    while size < most and (cap is None or len(out) < cap - 1):
        out.append(size)
        size = max(size + 1, math.ceil(size * growth))
    return [*out, most]


def band(ordinal: Column, sizes: Sequence[int]) -> Column:
    """The first tier that holds a row: the number of sizes that its ordinal isn't below."""
    return F.aggregate(F.array(*[F.lit(s) for s in sizes]), F.lit(0), lambda n, s: n + (ordinal >= s).cast("int"))


def in_tiers(ranked: DataFrame, sizes: Sequence[int], k: int, query_id: str = "query_id", id_col: str = "block_id") -> DataFrame:
    """The first k of each query in each nested tier: (tier, tier_size, query_id, id_col, score, rank).

    ranked: at least the k best rows of each query and `band`; a tier's best are among those of its own band and the lower ones.
    """
    tiers = F.explode(F.filter(F.array(*[F.struct(F.lit(n).alias("tier"), F.lit(s).alias("tier_size")) for n, s in enumerate(sizes)]), lambda t: F.col("band") <= t["tier"]))
    rows = ranked.select(query_id, id_col, "score", tiers.alias("t")).select("t.*", query_id, id_col, "score")
    w = Window.partitionBy("tier", query_id).orderBy(F.desc("score"), id_col)
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def leaders(tiers: DataFrame, a: str, b: str) -> DataFrame:
    """leader of each tier, and whether it is the first whose leader differs from the first tier's (ties don't count)."""
    lead = F.when(F.abs(F.col(a) - F.col(b)) < TIE, "tie").when(F.col(a) > F.col(b), a).otherwise(b)
    rows = tiers.withColumn("leader", lead)
    w = Window.orderBy("tier")  # one row for each tier
    other = (F.col("leader") != F.first("leader").over(w)) & (F.col("leader") != "tie")
    return rows.withColumn("other", other).withColumn("crossover", F.col("other") & (F.sum(F.col("other").cast("int")).over(w) == 1)).drop("other")


def traps(scored: DataFrame, answers: DataFrame, n: int = 1, least: float = 0.0) -> DataFrame:
    """(target, donor, score, place): for each block the nearest others whose answer is another one.

    scored: (target, donor, score) candidates of a neighbour search or a similarity join.
    """
    a = answers.select(F.col("block_id").alias("target"), F.trim("answer").alias("ta"))
    d = answers.select(F.col("block_id").alias("donor"), F.trim("answer").alias("da"))
    rows = scored.filter(F.col("score") >= least).join(a, "target").join(d, "donor").filter("ta != da")
    w = Window.partitionBy("target").orderBy(F.desc("score"), "donor")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("target", "donor", "score", "place")


def robustness(ranked: DataFrame, truth: DataFrame, trap_ids: DataFrame, queries: DataFrame, query_id: str = "query_id", id_col: str = "block_id") -> DataFrame:
    """One row: rate of true hits, of contaminated queries, mean rank of the first trap, resistance (true over contaminated)."""
    true = ranked.join(truth, [query_id, id_col], "left_semi").select(query_id).distinct().withColumn("t", F.lit(1))
    trap = ranked.join(trap_ids, [query_id, id_col], "left_semi").groupBy(query_id).agg(F.min("rank").alias("r"))
    rows = queries.select(query_id).distinct().join(true, query_id, "left").join(trap, query_id, "left")
    hit, bad = F.avg(F.coalesce("t", F.lit(0))), F.avg(F.when(F.col("r").isNotNull(), 1).otherwise(0))
    resist = F.when((bad == 0) & (hit > 0), F.lit(float("inf"))).when(bad == 0, F.lit(0.0)).otherwise(F.round(hit / bad, 6))
    return rows.agg(F.count("*").alias("cases"), F.round(hit, 6).alias("true_hit_rate"), F.round(bad, 6).alias("contamination"), F.round(F.avg("r"), 6).alias("first_trap_rank"), resist.alias("resistance"))


def qa_scores(cases: DataFrame) -> DataFrame:
    """One row of means. cases: f1 (null without a reference), hit, faithfulness, confidence, abstained.

    Abstentions are 0; without a reference a miss is 0 and a hit its faithfulness, or a half if that is unknown.
    """
    correct = F.when(F.col("abstained"), 0.0).when(F.col("f1").isNotNull(), F.col("f1")).when(~F.col("hit"), 0.0).otherwise(F.coalesce("faithfulness", F.lit(0.5)))
    return cases.agg(F.count("*").alias("cases"), F.round(F.avg(correct), 6).alias("correctness"), F.round(F.coalesce(F.avg("faithfulness"), F.lit(0.0)), 6).alias("faithfulness"), F.round(F.avg("confidence"), 6).alias("confidence"), F.round(F.avg(F.col("abstained").cast("int")), 6).alias("abstention_rate"))
