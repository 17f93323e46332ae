from __future__ import annotations


from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.catalog.text import INDEX
from corpusloom.catalog.vectors import DOT, KNN, asked, vectors
from corpusloom.functions import text as T
from corpusloom.operators import fusion, lexical, similarity
from corpusloom.plans.lineage import written
from corpusloom.sources.corpus import blocks
from corpusloom.sources.tables import spread, table

_BAG = f"list_concat({INDEX.format('trusted_answer')}, {INDEX.format('critical_question')}, {INDEX.format('name')}, flatten(list_transform(coalesce(keywords, []), lambda k: list_concat({INDEX.format('k')}, {INDEX.format('k')}, {INDEX.format('k')}))))"


def index_sql(bag: str = _BAG, rows: str = "{blocks}") -> str:
    return f"(select block_id, term, length, count(*) as tf from (select block_id, len(t) as length, unnest(t) as term from (select block_id, {bag} as t from {rows})) group by all)"


def bm25_sql(index: str, terms: str, k: int) -> str:
    """terms: (query_id, term), each once."""
    return f"""(select * from (select query_id, block_id, score, row_number() over (partition by query_id order by score desc, block_id) as rank from (
        select query_id, block_id, round(sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * length / average))), 6) as score
        from {terms} join {index} i using (term) join (select term, count(*) as df from {index} group by 1) using (term), (select count(*) as n, avg(length) as average from (select block_id, max(length) as length from {index} group by 1)) group by all) where score > 0) where rank <= {k})"""


QUERY_TERMS = f"(select distinct item_id as query_id, unnest({INDEX.format('query')}) as term from eval_case)"


def block_index(spark, folder):
    b = spread(blocks(spark, folder, "trusted_answer", "critical_question", "name", "keywords"), "block_id")
    # read by the statistics, the term counts and the search
    return written(lexical.postings(b, "block_id", lexical.bag(F.col("trusted_answer"), F.col("critical_question"), F.col("name"), F.col("keywords"))), "postings")


def eval_queries(spark, folder):
    return table(spark, folder, "eval_case").select(F.col("item_id").alias("query_id"), "query", "reference")


@query("op78_bm25_index", f"select term, count(*) as df, sum(tf)::bigint as occurrences from {index_sql()} group by 1")
def op78(spark, folder):
    return block_index(spark, folder).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


@query("op79_bm25_topk", f"select query_id, block_id, score, rank from {bm25_sql(index_sql(), QUERY_TERMS, 10)}")
def op79(spark, folder):
    return lexical.search(eval_queries(spark, folder), block_index(spark, folder), 10, "query_id", "block_id", T.index_tokens(F.col("query")))


_CHANGED = f"(select block_id, case when version = 1 then name else trusted_answer end as trusted_answer, critical_question, name, keywords from {{blocks}} where status <> 'ARCHIVED')"


@query("op80_incremental_index", f"select term, count(*) as df, sum(tf)::bigint as occurrences from {index_sql(rows=_CHANGED)} group by 1")
def op80(spark, folder):
    b = blocks(spark, folder, "trusted_answer", "critical_question", "name", "keywords", "version", "status")
    bag = lexical.bag(F.col("trusted_answer"), F.col("critical_question"), F.col("name"), F.col("keywords"))
    changed = b.filter("version = 1").withColumn("trusted_answer", F.col("name"))
    index = lexical.added(lexical.postings(b, "block_id", bag), lexical.postings(changed, "block_id", bag), "block_id")
    return lexical.removed(index, b.filter("status = 'ARCHIVED'"), "block_id").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences"))


@query("op81_null_lexical", "select item_id as query_id, '' as block_id, 0.0::double as score, 0 as rank from eval_case where false")
def op81(spark, folder):
    return lexical.nothing(eval_queries(spark, folder), "query_id", "block_id")


# two lexical legs: the answers and the names
_ANSWERS = index_sql(INDEX.format("trusted_answer"))
_NAMES = index_sql(INDEX.format("concat(coalesce(name, ''), ' ', coalesce(critical_question, ''))"))


def _leg_sql(k: int) -> tuple[str, str]:
    return bm25_sql(_ANSWERS, QUERY_TERMS, k), bm25_sql(_NAMES, QUERY_TERMS, k)


def _legs(spark, folder, k: int):
    b = blocks(spark, folder, "trusted_answer", "name", "critical_question")
    q = eval_queries(spark, folder)
    names = F.concat(F.coalesce("name", F.lit("")), F.lit(" "), F.coalesce("critical_question", F.lit("")))
    made = [lexical.search(q, written(lexical.postings(b, "block_id", T.index_tokens(c)), "postings"), k, "query_id", "block_id", T.index_tokens(F.col("query"))) for c in (F.col("trusted_answer"), names)]
    return [written(m, "leg") for m in made]


def rrf_sql(legs: list[str], weights: list[float], k: float, top: int) -> str:
    union = " union all ".join(f"select query_id, block_id, {w}::double / ({k} + rank) as s from {leg}" for leg, w in zip(legs, weights))
    return f"(select * from (select query_id, block_id, score, row_number() over (partition by query_id order by score desc, block_id) as rank from (select query_id, block_id, round(sum(s), 9) as score from ({union}) group by all)) where rank <= {top})"


@query("op82_rank_fusion", f"select query_id, block_id, score, rank from {rrf_sql(list(_leg_sql(50)), [0.7, 0.3], 60, 10)}")
def op82(spark, folder):
    return fusion.fused(_legs(spark, folder, 50), weights=(0.7, 0.3), top=10)


# truth for tuning: the first answer of each query by both legs' best rank
_TRUTH = "truth as materialized (select query_id, block_id from a where rank <= 2 union select query_id, block_id from n where rank <= 3), tn as (select query_id, count(*) as c from truth group by 1)"


def _recall_sql(label: str, value, weights, k) -> str:
    return f"select {value} as {label}, round(sum(coalesce(h, 0)::double / c) / (select count(*) from eval_case), 9) as recall from tn left join (select query_id, count(*) as h from {rrf_sql(['a', 'n'], weights, k, 10)} join truth using (query_id, block_id) group by 1) using (query_id)"


def _truth(legs):
    return legs[0].filter("rank <= 2").select("query_id", "block_id").union(legs[1].filter("rank <= 3").select("query_id", "block_id")).distinct()


_WITH = f"with a as materialized {_leg_sql(50)[0]}, n as materialized {_leg_sql(50)[1]}, {_TRUTH}"


@query("op83_tuned_constant", _WITH + " " + " union all ".join(_recall_sql("k_const", k, [1, 1], k) for k in fusion.K_GRID))
def op83(spark, folder):
    legs = _legs(spark, folder, 50)
    return fusion.tuned_k(legs, _truth(legs), eval_queries(spark, folder).count())


@query("op84_tuned_weights", _WITH + " " + " union all ".join(_recall_sql("candidate", n, list(w), 60) for n, w in enumerate(fusion.WEIGHT_GRID)))
def op84(spark, folder):
    legs = _legs(spark, folder, 50)
    return fusion.tuned_weights(legs, _truth(legs), eval_queries(spark, folder).count())


@query(
    "op85_metadata_filter",
    "select block_id from {blocks} where list_has_any(tags, ['SECURITY', 'API']) and language in ('en', 'de') and len(list_filter(entities, lambda e: lower(e.entity_name) like 'z%' or len(list_filter(e.aliases, lambda a: lower(a) like 'z%')) > 0)) >= 0 and kb_id = 'kb-001'",
)
def op85(spark, folder):
    b = blocks(spark, folder, "tags", "entities", "language", "kb_id")
    return b.filter(fusion.passes(tags=["SECURITY", "API"], languages=["en", "de"], kb_id="kb-001")).select("block_id")


@query("op85_entity_filter", "select block_id from {blocks} where len(list_filter(entities, lambda e: lower(e.entity_name) = 'zelha atlas' or list_contains(list_transform(e.aliases, lambda a: lower(a)), 'zelha atlas'))) > 0")
def op85_entities(spark, folder):
    return blocks(spark, folder, "entities").filter(fusion.passes(entities=["Zelha ATLAS"])).select("block_id")




@query(
    "op86_hybrid_search",
    f"""with dn as (select query_id, block_id, score, row_number() over (partition by query_id order by rank) as rank from {KNN} join embeddings e on e.vec_id = block_id where rank <= 80 and e.label % 2 = 0),
    ls as (select q.vec_id as query_id, d.vec_id as block_id, {DOT} as score from embeddings q join embeddings d on q.label = d.label where q.vec_id % 20 = 0),
    ln as (select query_id, block_id, score, row_number() over (partition by query_id order by r) as rank from (select *, row_number() over (partition by query_id order by score desc, block_id) as r from ls) join embeddings e on e.vec_id = block_id where r <= 80 and e.label % 2 = 0),
    both_legs as (select query_id, block_id, round(sum(1.0::double / (60 + rank)), 9) as score from (select query_id, block_id, rank from dn where query_id in (select query_id from ln) union all select query_id, block_id, rank from ln) group by all),
    everything as (select * from (select *, row_number() over (partition by query_id order by score desc, block_id) as r from both_legs) where r <= 80),
    merged as (select query_id, block_id, score from everything union all select query_id, block_id, score from dn where query_id not in (select query_id from ln))
    select query_id, block_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, block_id) as rank from merged) where rank <= 10""",
)
def op86(spark, folder):
    e = table(spark, folder, "embeddings")
    dense = similarity.nearest(asked(spark, folder), vectors(spark, folder), 80)
    same = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "label", F.col("embedding").alias("q")).join(e.select(F.col("vec_id").alias("block_id"), "label", "embedding"), "label")
    scored = same.select("query_id", "block_id", F.round(T.dot(F.col("q"), F.col("embedding")), 6).alias("score"))
    lex = similarity.top_k(scored, ["query_id"], 80, F.desc("score"), F.col("block_id"))
    result, _ = fusion.hybrid(dense, lex, e.select(F.col("vec_id").alias("block_id"), "label"), 10, F.col("label") % 2 == 0)
    return result


@query("op87_registry_resolve", f"select query_id, block_id, label, rank from {KNN} join (select vec_id as block_id, label from embeddings where label % 3 <> 0) using (block_id) where rank <= 10")
def op87(spark, folder):
    registry = table(spark, folder, "embeddings").filter("label % 3 <> 0").select(F.col("vec_id").alias("block_id"), "label")
    return fusion.resolved(similarity.nearest(asked(spark, folder), vectors(spark, folder), 10), registry).select("query_id", "block_id", "label", "rank")


@query("op88_semantic_dedup")
def op88(spark, folder):
    found = similarity.nearest(asked(spark, folder), vectors(spark, folder), 50)
    return fusion.distinct_enough(found, vectors(spark, folder), 0.3)


@query("op89_score_floor", f"with r as (select query_id, block_id, score, rank, max(score) over (partition by query_id) as top from {KNN} where rank <= 10), l as (select *, case when top >= 0.9 then 0.9 when top >= 0.63 then 0.63 when top >= 0.441 then 0.441 when top >= 0.3087 then 0.3087 when top >= 0.3 then 0.3 end as t from r) select query_id, block_id, score, rank from l where score >= t or (t is null and rank = 1 and score >= 0.15)")
def op89(spark, folder):
    v = vectors(spark, folder)
    return fusion.floored(similarity.nearest(asked(spark, folder), v, 10), 0.9)


@query("op90_identity_rerank", f"select query_id, block_id, rank, round((10 - (rank - 1)) / 10.0::double, 6) as score from {KNN} where rank <= 10")
def op90(spark, folder):
    r = fusion.reranked(similarity.nearest(asked(spark, folder), vectors(spark, folder), 10))
    return r.select("query_id", "block_id", "rank", F.round("score", 6).alias("score"))


@query(
    "op91_multi_query",
    f"""with h as (select q.vec_id as query_id, q.variant, d.vec_id as block_id, {DOT} as score from (select vec_id, 0 as variant, embedding from embeddings where vec_id % 20 = 0 union all select vec_id - 1, 1, embedding from embeddings where vec_id % 20 = 1) q, embeddings d),
    r as (select *, row_number() over (partition by query_id, variant order by score desc, block_id) as rank from h),
    s as (select query_id, block_id, round(sum(1.0::double / (60 + rank)), 9) as score from r where rank <= 10 group by all)
    select query_id, block_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, block_id) as rank from s) where rank <= 5""",
)
def op91(spark, folder):
    e = table(spark, folder, "embeddings")
    variants = e.filter("vec_id % 20 < 2").select("vec_id", F.col("embedding").alias("vector"))
    hits = similarity.nearest(variants.withColumnRenamed("vec_id", "query_id"), vectors(spark, folder), 10)
    hits = hits.withColumn("variant", F.col("query_id") % 20).withColumn("query_id", F.col("query_id") - F.col("variant"))
    return fusion.multi_query(hits, 5)


@query("op92_retrieval_grade")
def op92(spark, folder):
    found = lexical.search(eval_queries(spark, folder), block_index(spark, folder), 5, "query_id", "block_id", T.index_tokens(F.col("query")))
    rows = found.join(blocks(spark, folder, "trusted_answer"), "block_id").join(eval_queries(spark, folder), "query_id")
    q, a = T.latin_tokens(F.col("query")), T.latin_tokens(F.coalesce("trusted_answer", F.lit("")))
    overlap = F.when(F.size(q) > 0, F.size(F.array_intersect(q, a)) / F.size(F.array_distinct(q))).otherwise(0.0)
    return fusion.graded(rows, overlap)


