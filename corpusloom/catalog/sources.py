from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.catalog.vectors import vectors
from corpusloom.functions.chunks import segmented
from corpusloom.functions.cleaning import SPACE
from corpusloom.operators import generation as G
from corpusloom.plans.lineage import shared_folder
from corpusloom.sources import convert, vector_store
from corpusloom.sources.corpus import blocks, docs
from corpusloom.sources.tables import table


@query("op01_convert")
def op01(spark, folder):
    page = F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title></head><body><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1><p>"), F.regexp_replace("body_markdown", "[<&]", ""), F.lit("</p></body></html>"))
    files = docs(spark, folder).select(F.concat("doc_id", F.lit(".html")).alias("path"), F.encode(page, "UTF-8").alias("content"))
    return convert.converted(files)


@query("op02_folder_scan")
def op02(spark, folder):
    return convert.scan(spark, folder, ["parquet"]).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length")


@query("op03_skip_bad_records", "select doc_id || (case when batch_no % 2 = 0 then '.md' else '.exe' end) as path, batch_no % 2 = 0 as good from {docs}")
def op03(spark, folder):
    d = docs(spark, folder).select(F.concat("doc_id", F.when(F.col("batch_no") % 2 == 0, ".md").otherwise(".exe")).alias("path"), F.encode("body_markdown", "UTF-8").alias("content"))
    return convert.converted(d).select("path", F.col("error").isNull().alias("good"))


@query("op06_write_markdown")
def op06(spark, folder):
    out = f"{shared_folder(spark)}/markdown-{uuid.uuid4().hex}"
    rows = docs(spark, folder).select(F.concat("doc_id", F.lit(".txt")).alias("path"), F.encode("body_markdown", "UTF-8").alias("content"))
    convert.write_markdown(convert.converted(rows), out)
    return convert.scan(spark, out, [".md"]).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), "length")


@query("op08_vector_store", "select vec_id as id, round(list_sum(embedding::double[]), 5) as total from embeddings")
def op08(spark, folder):
    out = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    vector_store.save(vectors(spark, folder), out)
    return vector_store.load(spark, out).select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 5).alias("total"))


@query("op09_tag_table", "select doc_id, tag, min(pos) as position from (select doc_id, trim(tags[i]) as tag, i - 1 as pos from {docs}, unnest(range(1, len(tags) + 1)) as u(i)) where tag <> '' group by all")
def op09(spark, folder):
    t = docs(spark, folder).select("doc_id", F.posexplode("tags").alias("position", "t")).select("doc_id", F.trim("t").alias("tag"), F.col("position").cast("bigint")).filter("tag != ''")
    return t.groupBy("doc_id", "tag").agg(F.min("position").alias("position"))


@query("op11_identifier", "select count(*) as n from documents")
def op11(spark, folder):
    table(spark, folder, "documents").createOrReplaceTempView(convert.identifier("corpus_documents"))
    return spark.sql("select count(*) as n from identifier(:t)", args={"t": "corpus_documents"})


@query("op41_generate_blocks")
def op41(spark, folder):
    return G.generated(docs(spark, folder), "doc_id", "body_markdown")


@query("op42_segments")
def op42(spark, folder):
    return segmented(docs(spark, folder), "doc_id", "body_markdown", 2000)


@query("op43_block_cap", "select doc_id, greatest(1, ceil(length(body_markdown) / 800.0))::int as most from {docs}")
def op43(spark, folder):
    return docs(spark, folder).select("doc_id", G.cap(F.col("body_markdown")).alias("most"))


_T = ", ".join(f"'{t}'" for t in G.TAGS)


@query("op44_vocabulary", f"select distinct on (record_id) record_id, list_filter(list_transform(tags, lambda t: upper(trim(t))), lambda t, i: t in ({_T}) and not list_contains(list_transform(tags, lambda u: upper(trim(u)))[1:i - 1], t)) as tags, list_transform(entities, lambda e: case when upper(trim(e.entity_type)) in ('PRODUCT', 'METRIC', 'SYSTEM') then upper(trim(e.entity_type)) else 'CONCEPT' end) as types from raw_merged_block")
def op44(spark, folder):
    m = table(spark, folder, "raw_merged_block").dropDuplicates(["record_id"])
    return m.select("record_id", G.coerced_tags(F.col("tags")).alias("tags"), F.transform("entities", lambda e: G.coerced_type(e["entity_type"], ["PRODUCT", "METRIC", "SYSTEM"])).alias("types"))


@query("op45_ensure_question", r"select block_id, case when regexp_matches(q, '[?？]$') then q else regexp_replace(q, '[.!。]+$', '') || '?' end as question from (select block_id, regexp_replace(critical_question, '[ \t\n\r\f\v]+$', '') as q from {blocks})")
def op45(spark, folder):
    return blocks(spark, folder, "critical_question").select("block_id", G.ensure_question(F.col("critical_question")).alias("question"))


_TRIM = "regexp_replace({}, '\\A[" + SPACE.replace("{", "{{").replace("}", "}}") + "\\n]+|[" + SPACE.replace("{", "{{").replace("}", "}}") + "\\n]+\\z', '', 'g')"


@query("op46_block_validity", f"select block_id, case when coalesce({_TRIM.format('name')}, '') = '' then 'missing name' when coalesce({_TRIM.format('critical_question')}, '') = '' then 'missing question' when coalesce({_TRIM.format('trusted_answer')}, '') = '' then 'missing answer' when length({_TRIM.format('trusted_answer')}) > 500 then 'answer too long' end as error from {{blocks}}")
def op46(spark, folder):
    return blocks(spark, folder, "name", "critical_question", "trusted_answer").select("block_id", G.invalid(F.col("name"), F.col("critical_question"), F.col("trusted_answer")).alias("error"))
