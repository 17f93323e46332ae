from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.catalog.vectors import DOT, asked, vectors
from corpusloom.operators import questions as Q
from corpusloom.sources.corpus import blocks, feedback
from corpusloom.sources.tables import table

RULES = [Q.IntentRule(("limit", "límite", "limite"), "technical", 0.9), Q.IntentRule(("why", "warum", "pourquoi"), "analysis"), Q.IntentRule(("when",), "factual", 0.3)]
_INTENT = "case when contains(lower(query), 'limit') or contains(lower(query), 'límite') or contains(lower(query), 'limite') then 'technical' when contains(lower(query), 'why') or contains(lower(query), 'warum') or contains(lower(query), 'pourquoi') then 'analysis' when contains(lower(query), 'when') then 'factual' else 'business_analysis' end"
_CONF = f"case {_INTENT} when 'technical' then 0.9 when 'analysis' then 1.0 when 'factual' then 0.3 else 0.5 end::double"


@query("op93_intent_rules", f"select item_id, {_INTENT} as intent, {_CONF} as confidence from eval_case")
def op93(spark, folder):
    return table(spark, folder, "eval_case").select("item_id", Q.intent(F.col("query"), RULES).alias("i")).select("item_id", "i.*")


@query("op94_intent_coercion", "select event_id, case when event_type in ('view', 'click') then event_type else 'business_analysis' end as intent, least(1.0, greatest(0.0, value / 50.0))::double as confidence from events")
def op94(spark, folder):
    e = table(spark, folder, "events")
    return e.select("event_id", Q.coerced_intent(F.upper("event_type"), F.col("value") / 50, ["view", "click"], F.col("props")).alias("i")).select("event_id", "i.*")


@query("op95_query_rejection", f"select item_id, ({_INTENT} = 'analysis' or {_CONF} < 0.4) as rejected from eval_case")
def op95(spark, folder):
    i = table(spark, folder, "eval_case").select("item_id", Q.intent(F.col("query"), RULES).alias("i"))
    return i.select("item_id", Q.rejected(F.col("i.intent"), F.col("i.confidence"), ["analysis"]).alias("rejected"))


@query("op96_rewrite_rules", "select item_id, coalesce(nullif(regexp_replace(query, '^What is ', 'Tell ', 'g'), query), nullif(regexp_replace(query, '([0-9]+)', '<\\1>', 'g'), query), query) as rewritten from eval_case")
def op96(spark, folder):
    return table(spark, folder, "eval_case").select("item_id", Q.rewritten(F.col("query"), [("^What is ", "Tell "), ("([0-9]+)", "<$1>")]).alias("rewritten"))


@query("op98_expansion_gate", "select block_id, len(list_filter(regexp_split_to_array(trim(name), '\\s+'), lambda x: x <> '')) <= 1 and length(trim(name)) <= 6 or len(list_filter(regexp_split_to_array(trim(name), '\\s+'), lambda x: x <> '')) between 2 and 6 as draft from {blocks}")
def op98(spark, folder):
    return blocks(spark, folder, "name").select("block_id", Q.worth_hyde(F.col("name")).alias("draft"))


@query("op98_paraphrases", "select block_id, [x for x in [trim(critical_question)] if x <> '' and x <> trim(name)] as variants from {blocks}")
def op98_paraphrases(spark, folder):
    b = blocks(spark, folder, "name", "critical_question")
    return b.select("block_id", Q.paraphrases(F.col("name"), F.array(F.col("name"), F.concat(F.lit(" "), F.col("name")), F.col("critical_question"), F.concat(F.col("critical_question"), F.lit(" ")))).alias("variants"))


@query("op101_semantic_cache", f"select query_id, block_id, score from (select q.vec_id as query_id, d.vec_id as block_id, {DOT} as score, row_number() over (partition by q.vec_id order by {DOT} desc, d.vec_id) as r from embeddings q, (select * from embeddings where vec_id % 20 <> 0 order by vec_id desc limit 300) d where q.vec_id % 20 = 0) where r = 1 and score >= 0.3")
def op101(spark, folder):
    cache = vectors(spark, folder).filter("block_id % 20 != 0").withColumn("seq", F.col("block_id"))
    return Q.cached(asked(spark, folder), cache, 0.3, 300)


@query("op102_conversation_window", "select kb_id, array_to_string(list_transform(list_sort(list({'created_at': created_at, 'id': feedback_id, 'q': coalesce(query, '')}))[-3:], lambda t: concat('user: ', t.q)), chr(10)) as context from {feedback} where kb_id is not null group by kb_id")
def op102(spark, folder):
    from pyspark.sql import Window

    # only the last turns of a conversation are gathered, whatever its length
    w = Window.partitionBy("kb_id").orderBy(F.desc("created_at"), F.desc("feedback_id"))
    f = feedback(spark, folder).filter("kb_id is not null").withColumn("n", F.row_number().over(w)).filter("n <= 3")
    turns = F.sort_array(F.collect_list(F.struct("created_at", "feedback_id", F.lit("user").alias("role"), F.coalesce("query", F.lit("")).alias("content"))))
    return f.groupBy("kb_id").agg(turns.alias("t")).select("kb_id", Q.window_text(F.col("t"), 3).alias("context"))


@query("op103_intent_routing", f"select item_id, case {_INTENT} when 'technical' then 'kb-001' when 'analysis' then 'kb-002' else 'kb-000' end as kb_id from eval_case")
def op103(spark, folder):
    i = table(spark, folder, "eval_case").select("item_id", Q.intent(F.col("query"), RULES).alias("i"))
    return i.select("item_id", Q.routed(F.col("i.intent"), {"technical": "kb-001", "analysis": "kb-002"}, "kb-000").alias("kb_id"))
