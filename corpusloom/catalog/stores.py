from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.operators import stores as S
from corpusloom.sources.corpus import blocks, docs
from corpusloom.sources.tables import table

TAGS = "list_has_any(coalesce(tags, []), ['ops', 'policy'])"


@query("op113_list_documents", f"select doc_id, title, created_at from {{docs}} where {TAGS} and (contains(lower(title), 'index') or contains(lower(body_markdown), 'index')) order by created_at desc, doc_id desc limit 20 offset 5")
def op113(spark, folder):
    d = docs(spark, folder).filter(S.has_any(F.col("tags"), ["ops", "policy"]) & S.contains_text("INDEX", F.col("title"), F.col("body_markdown")))
    return S.page(d.select("doc_id", "title", "created_at"), 20, 5, F.desc("created_at"), F.desc("doc_id"))


@query("op114_tag_counts", "select tag, count(distinct doc_id) as documents from (select doc_id, trim(unnest(tags)) as tag from {docs}) where tag <> '' group by tag")
def op114(spark, folder):
    t = docs(spark, folder).select("doc_id", F.explode("tags").alias("t")).select("doc_id", F.trim("t").alias("tag")).filter("tag != ''")
    return t.groupBy("tag").agg(F.count_distinct("doc_id").alias("documents"))


@query("op115_document_store", "select doc_id, case when batch_no > 30 then 'changed' else title end as title, updated_at from {docs} where kb_id <> 'kb-001'")
def op115(spark, folder):
    d = docs(spark, folder).select("doc_id", "kb_id", "batch_no", "title", "updated_at")
    now = S.upserted(d, d.filter("batch_no > 30").withColumn("title", F.lit("changed")), ["doc_id"])
    return S.deleted(now, d.filter("kb_id = 'kb-001'"), ["doc_id"]).select("doc_id", "title", "updated_at")


_BATCH = "(select doc_id, case when batch_no % 3 = 0 then body_markdown || '.' else body_markdown end as body from {docs} where batch_no > 10)"


@query("op116_hash_aware_update", f"select b.doc_id, case when d.doc_id is null then 'created' when sha256(d.body_markdown) = sha256(b.body) then 'unchanged' else 'updated' end as change from {_BATCH} b left join (select * from {{docs}} where batch_no < 30) d using (doc_id)")
def op116(spark, folder):
    d = docs(spark, folder).select("doc_id", "batch_no", F.col("body_markdown").alias("body"))
    batch = d.filter("batch_no > 10").withColumn("body", F.when(F.col("batch_no") % 3 == 0, F.concat("body", F.lit("."))).otherwise(F.col("body")))
    return S.change_kinds(d.filter("batch_no < 30"), batch, "doc_id", "body")


@query(
    "op117_external_key_upsert",
    """with k as (select external_key, body_markdown as body, row_number() over (partition by external_key order by arrival_id) as f, row_number() over (partition by external_key order by arrival_id desc) as l from {docs} where external_key is not null)
    select n.external_key, case when sha256(o.body) = sha256(n.body) then 'unchanged' else 'updated' end as change from (select * from k where l = 1) n join (select * from k where f = 1) o using (external_key)""",
)
def op117(spark, folder):
    from corpusloom.sources.corpus import latest

    d = docs(spark, folder).filter("external_key is not null").select("external_key", "arrival_id", F.col("body_markdown").alias("body"))
    return S.change_kinds(latest(d, ["external_key"], "arrival_id"), latest(d, ["external_key"], F.desc("arrival_id")), "external_key", "body")


@query("op118_cascade_delete", "select arrival_id, doc_id from kb_block_state where doc_id is null or doc_id not in (select doc_id from document_record where kb_id = 'kb-001')")
def op118(spark, folder):
    gone = table(spark, folder, "document_record").filter("kb_id = 'kb-001'")
    return S.deleted(table(spark, folder, "kb_block_state").select("arrival_id", "doc_id"), gone, ["doc_id"])


@query("op119_orphans", "select arrival_id, doc_id from kb_block_state where doc_id is not null and doc_id not in (select doc_id from document_record where batch_no < 20)")
def op119(spark, folder):
    parents = table(spark, folder, "document_record").filter("batch_no < 20")
    return S.orphans(table(spark, folder, "kb_block_state").select("arrival_id", "doc_id"), parents, "doc_id")


@query("op120_block_browse", "select block_id, total from (select block_id, created_at, count(*) over () as total from {blocks} where list_has_any(tags, ['API']) and language = 'en' and status = 'ACTIVE') order by created_at desc, block_id limit 50 offset 10")
def op120(spark, folder):
    b = blocks(spark, folder, "tags", "language", "status", "created_at").filter(S.has_any(F.col("tags"), ["API"]) & (F.col("language") == "en") & (F.col("status") == "ACTIVE"))
    return S.page(b, 50, 10, F.desc("created_at"), "block_id").select("block_id", F.lit(b.count()).alias("total"))


@query("op121_kb_counts", "select k.kb_id, k.name, coalesce(n, 0) as blocks from kb_info k left join (select kb_id, count(*) as n from {blocks} group by 1) using (kb_id)")
def op121(spark, folder):
    n = blocks(spark, folder, "kb_id").groupBy("kb_id").agg(F.count("*").alias("n"))
    return table(spark, folder, "kb_info").join(n, "kb_id", "left").select("kb_id", "name", F.coalesce("n", F.lit(0)).alias("blocks"))


def _kb_sql() -> str:
    from corpusloom.catalog.lexical import QUERY_TERMS, bm25_sql, index_sql

    return f"select query_id, block_id, score, rank from {bm25_sql(index_sql(rows='(select * from {blocks} where kb_id = ' + chr(39) + 'kb-001' + chr(39) + ')'), QUERY_TERMS, 5)}"


@query("op122_kb_search", _kb_sql())
def op122(spark, folder):
    from corpusloom.catalog.lexical import eval_queries
    from corpusloom.functions import text as T
    from corpusloom.operators import lexical

    b = blocks(spark, folder, "trusted_answer", "critical_question", "name", "keywords", "kb_id").filter("kb_id = 'kb-001'")
    index = lexical.postings(b, "block_id", lexical.bag(F.col("trusted_answer"), F.col("critical_question"), F.col("name"), F.col("keywords")))
    return lexical.search(eval_queries(spark, folder), index, 5, "query_id", "block_id", T.index_tokens(F.col("query")))
