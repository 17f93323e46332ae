from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.catalog.lexical import eval_queries
from corpusloom.catalog.vectors import KNN, asked, vectors
from corpusloom.functions import text as T
from corpusloom.operators import answering, lexical, reading, similarity
from corpusloom.plans.lineage import written
from corpusloom.sources.corpus import blocks, feedback, once
from corpusloom.sources.tables import spread, table

#: Blocks found whose numbers may be sent to every executor; more are joined by a shuffle.
SENT = 500_000


def _top(spark, folder, k):
    return similarity.nearest(asked(spark, folder), vectors(spark, folder), k)


@query("op104_token_budget", f"select query_id, block_id, rank from (select query_id, block_id, rank, sum(label + 1) over (partition by query_id order by rank) as used from {KNN} join (select vec_id as block_id, label from embeddings) using (block_id) where rank <= 10) where used <= 40 or rank <= 1")
def op104(spark, folder):
    e = table(spark, folder, "embeddings").select(F.col("vec_id").alias("block_id"), "label")
    return reading.within_budget(_top(spark, folder, 10).join(e, "block_id"), F.col("label") + 1, 40).select("query_id", "block_id", "rank")


@query("op105_head_tail", f"select query_id, block_id, (case when (rank - 1) % 2 = 0 then (rank - 1) // 2 else 9 - (rank - 2) // 2 end)::int as position from {KNN} where rank <= 10")
def op105(spark, folder):
    return reading.head_tail(_top(spark, folder, 10)).select("query_id", "block_id", "position")


@query("op106_citation_grounding", "with c as (select distinct feedback_id as query_id, unnest(block_ids) as block_id from feedback) select distinct query_id, block_id from c join {blocks} b using (block_id) where b.status = 'ACTIVE'")
def op106(spark, folder):
    cited = feedback(spark, folder).select(F.col("feedback_id").alias("query_id"), F.explode("block_ids").alias("block_id"))
    given = cited.join(blocks(spark, folder, "status").filter("status = 'ACTIVE'"), "block_id", "left_semi")
    return reading.grounded(cited.unionByName(cited), given)


@query(
    "op107_read_gates",
    """select event_id, case when event_id % 7 = 0 then true when event_type = 'view' and event_id % 2 = 0 then true when value / 100 < 0.5 then true when (event_id % 10) / 10.0 < 0.2 then true else false end as abstained,
    case when event_id % 7 = 0 then 'no candidates' when event_type = 'view' and event_id % 2 = 0 then 'empty answer' when value / 100 < 0.5 then 'unfaithful' when (event_id % 10) / 10.0 < 0.2 then 'unsure' end as reason from events""",
)
def op107(spark, folder):
    e = table(spark, folder, "events")
    text = F.when((F.col("event_type") == "view") & (F.col("event_id") % 2 == 0), " ").otherwise(F.col("event_type"))
    return e.select("event_id", reading.gated(text, F.col("event_id") % 7, F.col("value") / 100, (F.col("event_id") % 10) / 10).alias("g")).select("event_id", "g.abstained", "g.reason")


@query("op108_faithfulness")
def op108(spark, folder):
    f = feedback(spark, folder).select("feedback_id", "answer_text", F.explode("block_ids").alias("block_id")).join(blocks(spark, folder, "trusted_answer"), "block_id")
    o = reading.overlap_faithfulness(T.latin_tokens(F.coalesce("answer_text", F.lit(""))), T.latin_tokens(F.coalesce("trusted_answer", F.lit(""))))
    return f.groupBy("feedback_id").agg(F.round(F.max(o), 6).alias("faithfulness"))


def _search(spark, folder, texts=True):
    table_ = spread(table(spark, folder, "idea_blocks").select("block_id", "trusted_answer", "critical_question", "name", "keywords"))
    corpus = lexical.Corpus(once(table_, "block_id"), "block_id", lexical.bag(F.col("trusted_answer"), F.col("critical_question"), F.col("name"), F.col("keywords")))
    rows = table(spark, folder, "idea_blocks").select("block_id", F.col("trusted_answer").alias("text"))

    def search(q):
        found = corpus.search(q, 5, "query_id", T.index_tokens(F.col("query")))
        if not texts:
            return found
        found = written(found, "found")
        ids = found.select("block_id").distinct()
        read = rows.join(F.broadcast(ids) if found.count() <= SENT else ids, "block_id", "left_semi").dropDuplicates(["block_id"])
        return found.join(read, "block_id")

    return search


@query("op109_batch_ask")
def op109(spark, folder):
    return answering.ask(eval_queries(spark, folder), _search(spark, folder))


@query("op110_agent_evidence")
def op110(spark, folder):
    # the plan: the halves of the question, then the reference's first words
    def plan(active, step):
        words = F.split("query", " ")
        half = F.ceil(F.size(words) / 2).cast("int")
        return active.select("query_id", F.array_join(F.slice(words, 1, half) if step % 2 == 0 else F.slice(words, half + 1, F.size(words)), " ").alias("query"))

    return answering.investigate(eval_queries(spark, folder).select("query_id", "query"), _search(spark, folder, texts=False), plan, steps=2)


@query("op110_evidence_merge", f"select query_id, block_id, score, rank from {KNN} where rank <= 20")
def op110_merge(spark, folder):
    found = _top(spark, folder, 25).drop("rank")
    return reading.merged_evidence(found.unionByName(found.withColumn("score", F.col("score") - 1)))


@query("op111_action_coercion", "select event_id, case when event_type in ('view', 'click') and coalesce(props, '') <> '' then 'retrieve' else 'synthesize' end as action from events")
def op111(spark, folder):
    raw = F.when(F.col("event_type") == "view", " Search").when(F.col("event_type") == "click", "LOOKUP").when(F.col("event_type") == "error", "plan").otherwise("done")
    return table(spark, folder, "events").select("event_id", reading.action(raw, F.col("props"), F.array(F.lit(" "))).alias("action"))


@query("op112_history", "select kb_id, feedback_id, created_at, n from (select kb_id, feedback_id, created_at, row_number() over (partition by kb_id order by created_at desc, feedback_id desc) as n from {feedback} where kb_id is not null and kb_id <> 'kb-001') where n <= 5")
def op112(spark, folder):
    from corpusloom.operators.stores import deleted

    f = feedback(spark, folder).filter("kb_id is not null").select("kb_id", "feedback_id", "created_at")
    left = deleted(f, f.filter("kb_id = 'kb-001'"), ["kb_id"])
    return similarity.top_k(left, ["kb_id"], 5, F.desc("created_at"), F.desc("feedback_id")).withColumnRenamed("rank", "n")
