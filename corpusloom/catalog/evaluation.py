from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.catalog.lexical import _legs, _leg_sql, eval_queries
from corpusloom.catalog.vectors import DOT, KNN, asked, vectors
from corpusloom.operators import evaluation as E
from corpusloom.operators import similarity
from corpusloom.operators.stores import page
from corpusloom.sources.corpus import blocks, docs, feedback
from corpusloom.sources.tables import table

_R = "lower(trim(rating))"
_ROLL = f"count(*) as total, count(*) filter ({_R} = 'positive') as positive, count(*) filter ({_R} = 'negative') as negative, count(*) filter ({_R} = 'corrected') as corrected, round(count(*) filter ({_R} = 'positive') / count(*)::double, 6) as approval"


@query("op123_feedback_list", f"select feedback_id, rating, created_at from {{feedback}} where {_R} = 'negative' and kb_id is not null order by created_at desc, feedback_id desc limit 25 offset 3")
def op123(spark, folder):
    f = feedback(spark, folder).filter((E.rating(F.col("rating")) == "negative") & F.col("kb_id").isNotNull())
    return page(f.select("feedback_id", "rating", "created_at"), 25, 3, F.desc("created_at"), F.desc("feedback_id"))


@query("op124_feedback_rollup", f"select kb_id, {_ROLL} from {{feedback}} group by kb_id")
def op124(spark, folder):
    return E.rollup(feedback(spark, folder), "kb_id")


_BREAK = f"(select block_id, {_ROLL} from (select rating, unnest(block_ids) as block_id from {{feedback}}) group by block_id)"


@query("op125_block_breakdown", f"select * from {_BREAK}")
def op125(spark, folder):
    return E.breakdown(feedback(spark, folder))


_LOW = "(select question, count(*) as occurrences, avg(n) as average from (select trim(regexp_replace(lower(query), '\\s+', ' ', 'g')) as question, coalesce(len(block_ids), 0) as n from {feedback}) where question <> '' and n < 2 group by question having count(*) >= 2)"


@query("op126_low_recall", f"select question, occurrences, average from {_LOW}")
def op126(spark, folder):
    return E.low_recall(feedback(spark, folder), least_hits=2)


_SPLIT = f"(select *, round((negative + corrected) / total::double, 6) as bad_ratio from {_BREAK} where total >= 2 and round((negative + corrected) / total::double, 6) >= 0.5)"


@query("op127_split_candidates", f"select block_id, total, bad_ratio from {_SPLIT}")
def op127(spark, folder):
    return E.split_candidates(E.breakdown(feedback(spark, folder))).select("block_id", "total", "bad_ratio")


@query("op128_healing_report", f"select 'low_recall' as signal, question as subject, occurrences as n, average as value from {_LOW} union all select 'split', block_id, total, bad_ratio from {_SPLIT}")
def op128(spark, folder):
    f = feedback(spark, folder)
    low = E.low_recall(f, least_hits=2).select(F.lit("low_recall").alias("signal"), F.col("question").alias("subject"), F.col("occurrences").alias("n"), F.col("average").alias("value"))
    split = E.split_candidates(E.breakdown(f)).select(F.lit("split"), "block_id", "total", "bad_ratio")
    return low.union(split)


def _metrics_sql(ranked: str, truth: str, queries: str) -> str:
    return f"""select count(*) as queries, round(avg(coalesce((first <= 1)::int, 0)), 6) as hit_at_1, round(avg(coalesce((first <= 3)::int, 0)), 6) as hit_at_3, round(avg(coalesce((first <= 5)::int, 0)), 6) as hit_at_5, round(avg(coalesce(1.0 / first, 0.0)), 6) as mrr, round(coalesce(avg(top), 0.0), 6) as top_score
    from (select distinct query_id from {queries}) left join (select query_id, min(rank) as first from {ranked} join {truth} using (query_id, block_id) where rank <= 5 group by 1) using (query_id) left join (select query_id, max(score) filter (rank = 1) as top from {ranked} group by 1) using (query_id)"""


_NEXT = "(select q.vec_id as query_id, d.vec_id as block_id from embeddings q join embeddings d on d.label = q.label where q.vec_id % 20 = 0 and d.vec_id % 20 = 1)"


def _truth(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", "label")
    return e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label").join(e.filter("vec_id % 20 = 1").select(F.col("vec_id").alias("block_id"), "label"), "label").select("query_id", "block_id")


@query("op129_retrieval_metrics", _metrics_sql(f"(select * from {KNN} where rank <= 10)", _NEXT, KNN))
def op129(spark, folder):
    q = asked(spark, folder)
    return E.metrics(similarity.nearest(q, vectors(spark, folder), 10), _truth(spark, folder), q)


@query("op130_token_stats", "select language, count(*) as units, round(sum(length(coalesce(trusted_answer, '')) / 4.0::double), 3) as tokens, round(avg(length(coalesce(trusted_answer, '')) / 4.0::double), 3) as average from {blocks} group by language")
def op130(spark, folder):
    return E.token_stats(blocks(spark, folder, "language", "trusted_answer"), F.coalesce("trusted_answer", F.lit("")), "language")


@query("op131_recursive_chunks")
def op131(spark, folder):
    from corpusloom.functions.chunks import chunked

    return chunked(docs(spark, folder), "doc_id", "body_markdown")


def _ab_sql() -> str:
    truth = f"(select query_id, block_id from a where rank <= 1 union select query_id, block_id from n where rank <= 1)"
    both = " union all ".join(f"select '{name}' as strategy, * from ({_metrics_sql(leg, truth, '(select item_id as query_id from eval_case)')})" for name, leg in (("answers", "a"), ("names", "n")))
    return f"with a as materialized {_leg_sql(10)[0]}, n as materialized {_leg_sql(10)[1]} {both}"


@query("op132_ab_benchmark", _ab_sql())
def op132(spark, folder):
    legs, q = _legs(spark, folder, 10), eval_queries(spark, folder)
    truth = reduce(DataFrame.union, [leg.filter("rank <= 1").select("query_id", "block_id") for leg in legs]).distinct()
    return reduce(DataFrame.unionByName, [E.metrics(leg, truth, q).withColumn("strategy", F.lit(n)) for n, leg in zip(("answers", "names"), legs)])


@query("op133_improvement", "with t as (select source, count(*) as n, sum(length(coalesce(text, ''))) / 4.0::double as tokens from documents group by 1) select source, coalesce(round(tokens / nullif(n - 40, 0), 6), 0.0) as ratio from t")
def op133(spark, folder):
    t = table(spark, folder, "documents").groupBy("source").agg(F.count("*").alias("n"), (F.sum(F.char_length(F.coalesce("text", F.lit("")))) / 4.0).alias("tokens"))
    return t.select("source", E.improvement(F.col("tokens"), F.col("n") - 40).alias("ratio"))


_ALL = f"(select q.vec_id as query_id, d.vec_id as block_id, {DOT} as score from embeddings q, embeddings d where q.vec_id % 20 = 0)"


def _tier_sql() -> str:
    sizes = "(with recursive s as (select 0 as tier, 100 as tier_size union all select tier + 1, least((select count(*)::int from embeddings), ceil(tier_size * 1.25)::int) from s where tier_size < (select count(*) from embeddings)) select * from s)"
    return f"""with ranked as materialized (select tier, tier_size, query_id, block_id, score, row_number() over (partition by tier, query_id order by score desc, block_id) as rank from {_ALL} join {sizes} on block_id < tier_size),
    hits as (select tier, query_id, min(rank) as first from ranked join {_NEXT} using (query_id, block_id) where rank <= 5 group by all),
    tops as (select tier, query_id, max(score) filter (rank = 1) as top from ranked where rank <= 5 group by all)
    select tier, count(*) as queries, round(avg(coalesce((first <= 1)::int, 0)), 6) as hit_at_1, round(avg(coalesce((first <= 5)::int, 0)), 6) as hit_at_5, round(avg(coalesce(1.0 / first, 0.0)), 6) as mrr, round(coalesce(avg(top), 0.0), 6) as top_score
    from (select distinct tier, query_id from {sizes}, (select vec_id as query_id from embeddings where vec_id % 20 = 0)) left join hits using (tier, query_id) left join tops using (tier, query_id) group by tier"""


def _tiers(spark, folder):
    v, q = vectors(spark, folder), asked(spark, folder)
    n = v.count()
    sizes = E.tier_sizes(100, n)
    scored = q.select("query_id", F.col("vector").alias("q"))
    # the stated queries against all rows, by partitions of the rows; of each band of rows only the best are kept
    ranked = similarity.nearest(q, v.withColumn("band", E.band(F.col("block_id"), sizes)), 5, within="band")
    tiers = E.in_tiers(ranked, sizes, 5)
    every = scored.select("query_id", F.explode(F.array(*[F.lit(n) for n in range(len(sizes))])).alias("tier"))
    return tiers, every


@query("op134_scaling_staircase", _tier_sql())
def op134(spark, folder):
    tiers, every = _tiers(spark, folder)
    return E.metrics(tiers, _truth(spark, folder), every, (1, 5), by=["tier"])


@query("op135_crossover", f"with m as ({_tier_sql()}), l as (select tier, hit_at_5, mrr * 2 as double_mrr, case when abs(hit_at_5 - mrr * 2) < 1e-9 then 'tie' when hit_at_5 > mrr * 2 then 'hit_at_5' else 'double_mrr' end as leader from m), o as (select *, leader <> first_value(leader) over (order by tier) and leader <> 'tie' as other from l) select tier, leader, other and sum(other::int) over (order by tier) = 1 as crossover from o")
def op135(spark, folder):
    m = op134(spark, folder).select("tier", "hit_at_5", (F.col("mrr") * 2).alias("double_mrr"))
    return E.leaders(m, "hit_at_5", "double_mrr").select("tier", "leader", "crossover")


_TRAPS = f"(select * from (select q.vec_id as target, d.vec_id as donor, {DOT} as score, row_number() over (partition by q.vec_id order by {DOT} desc, d.vec_id) as place from embeddings q join embeddings d on q.vec_id <> d.vec_id and q.label <> d.label where q.vec_id % 20 = 0 and {DOT} >= 0) where place <= 2)"


def _made_traps(spark, folder):
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("block_id"), F.col("embedding").alias("vector"), F.trim(F.col("label").cast("string")).alias("answer"))
    q = e.filter("block_id % 20 = 0").withColumnRenamed("block_id", "query_id")
    found = similarity.nearest(q, e, 2, other_than="answer").select(F.col("query_id").alias("target"), F.col("block_id").alias("donor"), "score")
    answers = e.select("block_id", "answer")
    return E.traps(found, answers, 2)


@query("op136_traps", f"select target, donor, score, place from {_TRAPS}")
def op136(spark, folder):
    return _made_traps(spark, folder)


@query(
    "op137_robustness",
    f"""with r as materialized (select * from {KNN} where rank <= 5), t as (select distinct query_id from r join {_NEXT} using (query_id, block_id)), b as (select query_id, min(rank) as first from r join (select target as query_id, donor as block_id from {_TRAPS}) using (query_id, block_id) group by 1),
    c as (select q.query_id, t.query_id is not null as hit, b.first from (select vec_id as query_id from embeddings where vec_id % 20 = 0) q left join t using (query_id) left join b using (query_id))
    select count(*) as cases, round(avg(hit::int), 6) as true_hit_rate, round(avg((first is not null)::int), 6) as contamination, round(avg(first), 6) as first_trap_rank, case when avg((first is not null)::int) = 0 then case when avg(hit::int) > 0 then 'inf'::double else 0.0 end else round(avg(hit::int) / avg((first is not null)::int), 6) end as resistance from c""",
)
def op137(spark, folder):
    q = asked(spark, folder)
    t = _made_traps(spark, folder).select(F.col("target").alias("query_id"), F.col("donor").alias("block_id"))
    return E.robustness(similarity.nearest(q, vectors(spark, folder), 5), _truth(spark, folder), t, q)


@query(
    "op138_qa_scores",
    """with c as (select event_id % 5 = 0 as abstained, case when event_type = 'view' then value / 100 end as f1, event_type <> 'error' as hit, case when event_id % 3 = 0 then (event_id % 10) / 10.0::double end as faithfulness, (event_id % 7) / 7.0::double as confidence from events)
    select count(*) as cases, round(avg(case when abstained then 0.0 when f1 is not null then f1 when not hit then 0.0 else coalesce(faithfulness, 0.5) end), 6) as correctness, round(coalesce(avg(faithfulness), 0.0), 6) as faithfulness, round(avg(confidence), 6) as confidence, round(avg(abstained::int), 6) as abstention_rate from c""",
)
def op138(spark, folder):
    e = table(spark, folder, "events")
    cases = e.select((F.col("event_id") % 5 == 0).alias("abstained"), F.when(F.col("event_type") == "view", F.col("value") / 100).alias("f1"), (F.col("event_type") != "error").alias("hit"), F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 10) / 10).alias("faithfulness"), ((F.col("event_id") % 7) / 7).alias("confidence"))
    return E.qa_scores(cases)
