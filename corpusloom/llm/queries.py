"""The pN_ queries, with production parameters, over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm import answers, encode, garbled, history, language, leaks, neighbours, pieces, survivor
from corpusloom.plans.lineage import shared_folder
from corpusloom.sources.tables import spread, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    blocks = table(spark, folder, "idea_blocks").select("block_id", "critical_question", "trusted_answer", "language")
    model = language.fitted(blocks, "block_id", "trusted_answer", "language")
    return answers.defects(spread(blocks), model)


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    blocks = pieces.split(table(spark, folder, "idea_blocks"), "idea_blocks", "block_id", "trusted_answer", 500, 50)
    bodies = pieces.split(table(spark, folder, "document_record"), "document_record", "doc_id", "body_markdown", 1500, 150)
    return blocks.unionByName(bodies).dropDuplicates(["table_name", "item_id", "piece_no"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    blocks = pieces.split(table(spark, folder, "idea_blocks"), "idea_blocks", "block_id", "trusted_answer", 500, 50)
    bodies = pieces.split(table(spark, folder, "document_record"), "document_record", "doc_id", "body_markdown", 1500, 150)
    return blocks.unionByName(bodies).filter("pieces > 1 and piece_no = 1").select("table_name", "item_id").distinct()


def p3_nearest(spark: SparkSession, folder: str) -> DataFrame:
    near = neighbours.nearest(table(spark, folder, "pgvector_store"), 5)
    return near.select(F.col("id").alias("block_id"), F.col("neighbour").alias("neighbour_id"), "score", "place")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    near = neighbours.nearest(table(spark, folder, "pgvector_store"), 5)
    return near.select(F.least("id", "neighbour").alias("block_id_a"), F.greatest("id", "neighbour").alias("block_id_b")).distinct()


def p4_survivors(spark: SparkSession, folder: str) -> DataFrame:
    return survivor.survivors(table(spark, folder, "raw_merged_block"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return survivor.undisputed(table(spark, folder, "raw_merged_block"))


def _ingested(spark: SparkSession, folder: str, bounds: list[int]) -> DataFrame:
    """Both tables, each taken in by a history of its own in batches that end with the given batch numbers and the last one."""
    out = None
    for name, text, content, longs in (("kb_block_state", "block_json", history.block_content, 3), ("document_record", "body_markdown", history.body_content, 8)):
        rows = table(spark, folder, name).select("arrival_id", "batch_no", text)
        store = history.History(spark, f"{shared_folder(spark)}/history-{uuid.uuid4().hex}", content, longs)
        for low, high in zip([None, *bounds], [*bounds, None]):
            part = rows.filter((F.lit(True) if low is None else F.col("batch_no") > low) & (F.lit(True) if high is None else F.col("batch_no") <= high))
            found = store.ingest(spread(part), "arrival_id", text).select(F.lit(name).alias("table_name"), "first_id", "later_id")
            out = found if out is None else out.unionByName(found)
    return out


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """In three batches, of 20, 10 and the last 10 batch numbers, each checked against what was taken in before."""
    return _ingested(spark, folder, [20, 30])


def p5_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows in other batches: the first 36 batch numbers make the history, the last four come one by one."""
    return _ingested(spark, folder, [36, 37, 38, 39])


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "document_record").select("doc_id", "body_markdown", "language")
    model = language.fitted(docs, "doc_id", "body_markdown", "language")
    return language.segments(spread(docs), model, "doc_id", "body_markdown")


def p6_segments(spark: SparkSession, folder: str) -> DataFrame:
    return _segments(spark, folder).distinct()


def p6_languages(spark: SparkSession, folder: str) -> DataFrame:
    """Each language of each document with its share of the judged text and the confidence over its segments."""
    size = F.col("segment_end") - F.col("segment_start")
    s = _segments(spark, folder).distinct().groupBy("doc_id", "lang_code").agg(F.sum(size).alias("size"), (F.sum(F.col("confidence") * size) / F.sum(size)).alias("confidence"))
    whole = F.sum("size").over(Window.partitionBy("doc_id"))  # at most six rows of a document
    return s.select("doc_id", "lang_code", F.round(F.col("size") / whole, 6).alias("share"), F.round("confidence", 6).alias("confidence"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    spoken = _segments(spark, folder).groupBy("doc_id").agg(F.collect_set("lang_code").alias("codes"))  # at most six
    labels = table(spark, folder, "document_record").select("doc_id", language.label(F.col("language")).alias("label")).groupBy("doc_id").agg(F.min("label").alias("label"))
    wrong = (F.size("codes") > 1) | F.col("label").isNull() | (F.col("codes")[0] != F.col("label"))
    return spoken.join(labels, "doc_id").filter(wrong).select("doc_id", F.explode("codes").alias("lang_code"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode.encode(spread(table(spark, folder, "documents").select("doc_id", "text")))


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaks.leaks(spread(table(spark, folder, "documents").select("doc_id", "text")), table(spark, folder, "eval_case"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_leaks(spark, folder).select("doc_id", "item_id").distinct()


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    return garbled.restored(spread(table(spark, folder, "documents").select("doc_id", "text")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_restored(spark, folder).select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p1_found, p2_pieces, p2_found, p3_nearest, p3_found, p4_survivors, p4_found, p5_found, p5_incremental, p6_segments, p6_languages, p6_found, p7_ids, p8_leaks, p8_found, p9_restored, p9_found)}
_SPACE = r" \t\n\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '\A[{_SPACE}]+|[{_SPACE}]+\z', '', 'g')"


def _entries(c: str, more: str = "") -> str:
    return f"nullif(len(list_distinct(list_filter(list_transform({c}, lambda x: upper({_strip('x')})), lambda x: x <> ''{more}))), 0)"


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


#: Where SQL can say it on whole tables; the other problems are tested against brute force, round trips and held-out texts.
ORACLE: dict[str, str] = {
    "p2_found": f"""select 'idea_blocks' as table_name, block_id as item_id from idea_blocks where length({_strip('trusted_answer')}) > 500
        union select 'document_record', doc_id from document_record where length({_strip('body_markdown')}) > 1500""",
    "p4_found": f"""with r as (select distinct on (record_id) * from raw_merged_block where group_id is not null),
        s as (select group_id, record_id, coalesce(trust, -1) as t, coalesce(updated_at, timestamptz '0001-01-01 00:00:00+00') as u, unnest([
            {{'f': 'trusted_answer', 'n': case when lower(regexp_replace(trusted_answer, '[^\\p{{L}}\\p{{N}}]+', '', 'g')) not in ({_quoted(survivor.STAND_INS)}) and length({_strip('trusted_answer')}) <= 500 then length({_strip('trusted_answer')}) end}},
            {{'f': 'tags', 'n': {_entries('tags', f" and x in ({_quoted(survivor.TAGS)})")}}},
            {{'f': 'entities', 'n': {_entries('list_transform(entities, lambda e: e.entity_name)')}}},
            {{'f': 'keywords', 'n': {_entries('keywords')}}}]) as x from r),
        m as (select group_id, x.f as f, max(x.n) as n, max(t) as t, max(u) as u from s where x.n is not null group by all),
        g as (select group_id from r group by 1 having count(*) > 1)
        select s.group_id, m.f as field_name, min(record_id) as record_id from s join m on m.group_id = s.group_id and m.f = s.x.f and m.n = s.x.n and m.t = s.t and m.u = s.u where s.group_id in (select group_id from g) group by 1, 2 having count(*) = 1""",
}
