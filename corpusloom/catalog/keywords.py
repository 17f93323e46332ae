from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.catalog.text import BOUND
from corpusloom.functions import text as T
from corpusloom.functions.cleaning import SPACE
from corpusloom.operators import keywords as K
from corpusloom.sources.corpus import docs
from corpusloom.sources.tables import spread, table

_STOPS = ", ".join(f"'{s}'" for s in T.ENGLISH_STOPS)
TOKENS = rf"""seg as (select doc_id as id, i as segment, s[i] as t, len(s) as segments from (select doc_id, list_filter(list_transform(regexp_split_to_array(text, '{BOUND}'), lambda x: regexp_replace(x, '\A[{SPACE}\n]+|[{SPACE}\n]+\z', '', 'g')), lambda x: x <> '') as s from documents), unnest(range(1, len(s) + 1)) as u(i)),
    tok as (select id, segment, p as place, w[p] as token, (w[p] in ({_STOPS}) or length(w[p]) < 3) as brk from (select id, segment, regexp_extract_all(lower(replace(t, '''', '')), '[0-9a-z]+') as w from seg), unnest(range(1, len(w) + 1)) as u(p))"""
RAKE = f"""{TOKENS}, isl as (select *, sum(brk::int) over (partition by id, segment order by place) as island from tok),
    phrase as (select id, segment, island, count(*) as n, list(token order by place) as w from isl where not brk group by all having count(*) <= 5),
    word as (select id, n, token, len(list_filter(w, lambda x: x = token)) as times from (select id, n, w, unnest(list_distinct(w)) as token from phrase)),
    ws as (select id, token, (sum(n - 1) + sum(times)) / sum(times)::double as s from word group by all),
    tot as (select id, segment, island, keyword, n, sum(s) as s from (select id, segment, island, n, array_to_string(w, ' ') as keyword, unnest(w) as token from phrase) join ws using (id, token) group by all),
    best as (select id, keyword, round(max(s * (1.0::double + 0.1::double * (n - 1))), 6) as score from tot group by all),
    rake as (select id, keyword, score, row_number() over (partition by id order by score desc, keyword) as rank from best)"""


def _documents(spark, folder):
    return spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


@query("op69_rake", f"with {RAKE} select id as doc_id, keyword, score, rank from rake where rank <= 10")
def op69(spark, folder):
    return K.rake(_documents(spark, folder), "doc_id", "text").select("doc_id", "keyword", "score", "rank")


@query(
    "op70_tfidf",
    f"""with {TOKENS}, c as (select id, token, count(*) as tf, count(distinct segment) as df from tok where not brk group by all), n as (select id, max(segments) as segments from seg group by 1),
    s as (select id, token as keyword, round((1 + ln(tf)) * (ln((1 + segments)::double / (1 + df)) + 1), 6) as score from c join n using (id))
    select id as doc_id, keyword, score, rank from (select *, row_number() over (partition by id order by score desc, keyword) as rank from s) where rank <= 10""",
)
def op70(spark, folder):
    return K.tfidf(_documents(spark, folder), "doc_id", "text").select("doc_id", "keyword", "score", "rank")


@query("op71_textrank")
def op71(spark, folder):
    return K.textrank(_documents(spark, folder), "doc_id", "text")


@query("op72_cohesion_gate")
def op72(spark, folder):
    d = _documents(spark, folder)
    return K.rake(d, "doc_id", "text", tokenizer=T.auto_tokens, gate=K.gate(d, "doc_id", "text")).select("doc_id", "keyword", "score", "rank")


@query("op73_extractor_factory", f"with {RAKE} select id as doc_id, keyword, score, rank from rake where rank <= 3")
def op73(spark, folder):
    return K.extractor("RAKE")(_documents(spark, folder), "doc_id", "text", 3).select("doc_id", "keyword", "score", "rank")


@query(
    "op74_auto_tags",
    f"""with {RAKE}, flat as (select id, rank, p as part, t[p] as tag from (select id, rank, case when len(string_split(keyword, ' ')) <= 3 then [keyword] else string_split(keyword, ' ') end as t from rake where rank <= 16), unnest(range(1, len(t) + 1)) as u(p)),
    one as (select id, tag, min(rank * 100 + part) as spot from flat group by all)
    select id as doc_id, tag, r as rank from (select id, tag, row_number() over (partition by id order by spot) as r from one) where r <= 8""",
)
def op74(spark, folder):
    return K.auto_tags(_documents(spark, folder), "doc_id", "text")


@query(
    "op75_retag",
    """with x as (select doc_id, list_filter(list_transform(list_concat(coalesce(tags, []), ['faq', ' new ', kb_id]), lambda t: trim(t)), lambda t: t <> '') as t from {docs})
    select doc_id, list_filter(t, lambda v, i: not list_contains(t[1:i - 1], v)) as tags from x""",
)
def op75(spark, folder):
    extra = F.array(F.lit("faq"), F.lit(" new "), F.col("kb_id"))
    return docs(spark, folder).select("doc_id", K.retagged(F.col("tags"), extra, replace=False).alias("tags"))


@query("op76_extractive_summary")
def op76(spark, folder):
    return K.summaries(docs(spark, folder), "doc_id", "body_markdown")
