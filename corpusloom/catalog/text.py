from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.functions import text as T
from corpusloom.functions.cleaning import SPACE
from corpusloom.functions.noisy_json import extract_json
from corpusloom.sources.corpus import blocks, docs
from corpusloom.sources.tables import table

LATIN = "regexp_extract_all(lower(replace({}, '''', '')), '[0-9a-z]+')"
_RUN = "case when regexp_matches(r, '^[" + T.CJK.replace("{", "{{").replace("}", "}}") + "]') then case when length(r) = 1 then [r] else list_transform(range(1, length(r)), lambda i: substr(r, i::int, 2)) end else regexp_extract_all(lower(replace(r, '''', '')), '[0-9a-z]+') end"
BIGRAM = "flatten(list_transform(regexp_extract_all({}, '[" + T.CJK.replace("{", "{{").replace("}", "}}") + "]+|[^" + T.CJK.replace("{", "{{").replace("}", "}}") + "]+'), lambda r: " + _RUN + "))"
_CI = T.CJK_INDEX.replace("{", "{{").replace("}", "}}")
INDEX = "list_concat(list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z0-9]+'), lambda w: lower(w)), regexp_extract_all(coalesce({0}, ''), '[" + _CI + "]'), list_transform(range(1, greatest(1, len(regexp_extract_all(coalesce({0}, ''), '[" + _CI + "]')))), lambda i: regexp_extract_all(coalesce({0}, ''), '[" + _CI + "]')[i] || regexp_extract_all(coalesce({0}, ''), '[" + _CI + "]')[i + 1]))"
BOUND = "[" + T.BOUNDARY[1:-1].replace("'", "''") + "]"
WORDS = "list_concat(list_transform(regexp_extract_all({0}, '[A-Za-z0-9]+'), lambda w: lower(w)), regexp_extract_all({0}, '[" + _CI + "]'))"


def _texts(spark, folder, **columns):
    return table(spark, folder, "documents").select("doc_id", *[c.alias(n) for n, c in columns.items()])


@query("op27_latin_tokens", f"select doc_id, array_to_string({LATIN.format('text')}, ' ') as tokens from documents")
def op27(spark, folder):
    return _texts(spark, folder, tokens=F.array_join(T.latin_tokens(F.col("text")), " "))


@query("op28_bigram_tokens", f"select doc_id, array_to_string({BIGRAM.format('text')}, ' ') as tokens from documents")
def op28(spark, folder):
    return _texts(spark, folder, tokens=F.array_join(T.bigram_tokens(F.col("text")), " "))


@query("op29_auto_tokens", f"select doc_id, array_to_string(case when regexp_matches(text, '[{T.CJK}]') then {BIGRAM.format('text')} else {LATIN.format('text')} end, ' ') as tokens from documents")
def op29(spark, folder):
    return _texts(spark, folder, tokens=F.array_join(T.auto_tokens(F.col("text")), " "))


@query("op30_index_tokens", f"select block_id, array_to_string({INDEX.format('trusted_answer')}, ' ') as tokens from {{blocks}}")
def op30(spark, folder):
    return blocks(spark, folder, "trusted_answer").select("block_id", F.array_join(T.index_tokens(F.col("trusted_answer")), " ").alias("tokens"))


@query("op31_phrases", rf"select doc_id, array_to_string(list_filter(list_transform(regexp_split_to_array(text, '{BOUND}'), lambda s: regexp_replace(s, '\A[{SPACE}\n]+|[{SPACE}\n]+\z', '', 'g')), lambda s: s <> ''), '|') as phrases from documents")
def op31(spark, folder):
    return _texts(spark, folder, phrases=F.array_join(T.phrases(F.col("text")), "|"))


@query("op32_summary_sentences")
def op32(spark, folder):
    return docs(spark, folder).select("doc_id", F.posexplode(T.summary_sentences(F.col("body_markdown"))).alias("sentence_no", "sentence"))


_STOPS = ", ".join(f"'{s}'" for s in T.STOPS)


@query("op33_stop_words", f"select doc_id, len(list_filter({LATIN.format('text')}, lambda t: t in ({_STOPS}))) as stops from documents where text is not null")
def op33(spark, folder):
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", F.size(F.filter(T.latin_tokens(F.col("text")), T.is_stop)).cast("bigint").alias("stops"))


@query("op34_content_hash", "select doc_id, sha256(text) as hash from documents")
def op34(spark, folder):
    return _texts(spark, folder, hash=F.sha2("text", 256))


@query(
    "op35_vector_math",
    "select a.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]), 6) as dot, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as cosine, round(list_reduce(list_transform(a.embedding::double[], lambda x: x * x), lambda x, y: x + y), 6) as squared from embeddings a join embeddings b on b.vec_id = a.vec_id + 1",
)
def op35(spark, folder):
    e = table(spark, folder, "embeddings")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    j = e.join(n, "vec_id")
    return j.select("vec_id", F.round(T.dot(F.col("embedding"), F.col("next")), 6).alias("dot"), F.round(T.cosine(F.col("embedding"), F.col("next")), 6).alias("cosine"), F.round(T.norm(F.col("embedding")) * T.norm(F.col("embedding")), 6).alias("squared"))


@query("op36_approximate_tokens", "select doc_id, length(text) / 4.0::double as tokens from documents")
def op36(spark, folder):
    return _texts(spark, folder, tokens=T.approximate_tokens(F.col("text")))


@query(
    "op37_token_f1",
    f"""with t as (select item_id, {WORDS.format('query')} as q, {WORDS.format('reference')} as r from eval_case),
    qc as (select item_id, w, count(*) as n from (select item_id, unnest(q) as w from t) group by all), rc as (select item_id, w, count(*) as n from (select item_id, unnest(r) as w from t) group by all),
    c as (select item_id, sum(least(qc.n, rc.n)) as common from qc join rc using (item_id, w) group by 1)
    select item_id, round(coalesce(2.0 * common / (len(q) + len(r)), 0.0), 6)::double as f1 from t left join c using (item_id)""",
)
def op37(spark, folder):
    e = table(spark, folder, "eval_case")
    return e.select("item_id", F.round(T.token_f1(T.answer_tokens(F.col("query")), T.answer_tokens(F.col("reference"))), 6).alias("f1"))


@query(
    "op38_jaccard",
    f"""with t as (select item_id, list_distinct({LATIN.format('query')}) as q, list_distinct({LATIN.format('reference')}) as r from eval_case)
    select item_id, round(len(list_intersect(q, r))::double / (len(q) + len(r) - len(list_intersect(q, r))), 6) as jaccard from t""",
)
def op38(spark, folder):
    e = table(spark, folder, "eval_case")
    return e.select("item_id", F.round(T.jaccard(T.latin_tokens(F.col("query")), T.latin_tokens(F.col("reference"))), 6).alias("jaccard"))


@query("op39_sigmoid", "select event_id, round(1 / (1 + exp(-(value - 50))), 9) as score from events")
def op39(spark, folder):
    return table(spark, folder, "events").select("event_id", F.round(T.sigmoid(F.col("value") - 50), 9).alias("score"))


@query("op40_noisy_json")
def op40(spark, folder):
    return table(spark, folder, "kb_block_state").select("arrival_id", extract_json(F.col("block_json")).alias("json"))
