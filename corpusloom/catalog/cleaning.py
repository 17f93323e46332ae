from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.functions import cleaning as C
from corpusloom.functions.scripts import RuleManager, Script, StoredRule
from corpusloom.sources.corpus import docs
from corpusloom.sources.tables import table

SP = C.SPACE


def _texts(spark, folder, rule):
    return table(spark, folder, "documents").select("doc_id", rule(F.col("text")).alias("cleaned"))


_BOM = r"regexp_replace({}, '\A\x{{FEFF}}+', '')"
_EOL = r"replace(replace({}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_CTL = r"regexp_replace({}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')"
_TRAIL = "regexp_replace(regexp_replace({}, '[" + SP.replace("{", "{{").replace("}", "}}") + r"]+(\n|\z)', '\1', 'g'), '\A[" + SP.replace("{", "{{").replace("}", "}}") + r"\n]+|[" + SP.replace("{", "{{").replace("}", "}}") + r"\n]+\z', '', 'g')"
_BLANK = r"regexp_replace({}, '\n{{3,}}', chr(10) || chr(10), 'g')"


def _default(e: str) -> str:
    for f in (_BOM, _EOL, _CTL, _TRAIL, _BLANK):
        e = f.format(e)
    return e


def _sql(f: str) -> str:
    return f"select doc_id, {f.format('text')} as cleaned from documents"


@query("op14_strip_bom", _sql(_BOM))
def op14(spark, folder):
    return _texts(spark, folder, C.strip_bom)


@query("op15_line_ends", _sql(_EOL))
def op15(spark, folder):
    return _texts(spark, folder, C.line_ends)


@query("op16_strip_controls", _sql(_CTL))
def op16(spark, folder):
    return _texts(spark, folder, C.strip_controls)


@query("op17_strip_trailing", _sql(_TRAIL))
def op17(spark, folder):
    return _texts(spark, folder, C.strip_trailing)


@query("op18_collapse_blank", _sql(_BLANK))
def op18(spark, folder):
    return _texts(spark, folder, C.collapse_blank(1))


@query("op19_strip_comments", r"select doc_id, regexp_replace(concat('<!-- a', chr(10), 'b -->', text, '<!-- c -->'), '(?s)<!--.*?-->', '', 'g') as cleaned from documents where text is not null")
def op19(spark, folder):
    noisy = F.concat(F.lit("<!-- a\nb -->"), F.col("text"), F.lit("<!-- c -->"))
    return table(spark, folder, "documents").filter("text is not null").select("doc_id", C.strip_comments(noisy).alias("cleaned"))


@query("op20_regex_replace", r"select doc_id, regexp_replace(text, '(?i)([a-z]+)_([a-z]+)', '\2-\1', 'g') as cleaned from documents")
def op20(spark, folder):
    return _texts(spark, folder, C.replace("([a-z]+)_([a-z]+)", r"\2-\1", flags="i"))


@query("op20_regex_replace_limited", r"select doc_id, regexp_replace(text, '[0-9]+', '#') as cleaned from documents")
def op20_limited(spark, folder):
    return _texts(spark, folder, C.replace("[0-9]+", "#", count=1))


@query("op21_callable", "select doc_id, replace(text, 'the', 'THE') as cleaned from documents")
def op21(spark, folder):
    return _texts(spark, folder, C.call(lambda t: t.replace("the", "THE")))


@query("op22_default_pipeline", f"select doc_id, {_default('text')} as cleaned from documents")
def op22(spark, folder):
    return _texts(spark, folder, C.clean)


@query("op23_source_routing", rf"select doc_id, case when source like 'wiki-%' then regexp_replace({_default('text')}, '[0-9]', '0', 'g') when regexp_matches(source, '^(faq|policy)') then regexp_replace({_default('text')}, '[aeiou]', '_', 'g') else {_default('text')} end as cleaned from documents")
def op23(spark, folder):
    registry = C.Registry().add(C.replace("[0-9]", "0"), "wiki-*").add(C.replace("[aeiou]", "_"), "^(faq|policy)", "regex")
    return C.clean_frame(table(spark, folder, "documents"), "text", "source", registry).select("doc_id", "cleaned")


@query("op24_script_rule", "select doc_id, replace(text, 'the', 'THE') as cleaned, cast(null as varchar) as error from documents")
def op24(spark, folder):
    script = Script("text.replace('the', 'THE')")
    return table(spark, folder, "documents").select("doc_id", script.column(F.col("text"), F.col("source")).alias("r")).select("doc_id", F.col("r.text").alias("cleaned"), "r.error")


@query("op25_rule_manager", "select doc_id, case when source like 'faq-%' then replace(text, 'the', 'THE') else text end as cleaned from documents")
def op25(spark, folder):
    m = RuleManager()
    m.put(StoredRule("shout", "text.replace('the', 'THE')", "faq-*", "glob"))
    m.put(StoredRule("broken", "text.__class__"))
    m.put(StoredRule("off", "text.upper()", enabled=False))
    d = table(spark, folder, "documents")
    return d.select("doc_id", m.registry().clean(F.col("text"), F.col("source"), defaults=False).alias("cleaned"))


@query("op26_batch_clean", f"select doc_id, {_default('body_markdown')} as cleaned, source.uri as uri from {{docs}}")
def op26(spark, folder):
    return C.clean_frame(docs(spark, folder), "body_markdown").select("doc_id", "cleaned", F.col("source.uri").alias("uri"))
