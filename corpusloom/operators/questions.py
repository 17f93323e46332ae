"""Rules on tables of questions: intent, rejection, rewriting, expansion gates, cached answers, routing."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators import similarity

#: The default of a rule set, rejection below this confidence, least cosine and size of the cache, HyDE's limits.
DEFAULT_INTENT, DEFAULT_CONFIDENCE = "business_analysis", 0.5
REJECT_BELOW, CACHE_COSINE, CACHE_SIZE, HYDE_WORDS, DRAFT_CHARS = 0.4, 0.90, 1024, 6, 400


@dataclass(frozen=True)
class IntentRule:
    keywords: Sequence[str]
    intent: str
    confidence: float = 1.0


def intent(text: Column, rules: Sequence[IntentRule], default: str = DEFAULT_INTENT, confidence: float = DEFAULT_CONFIDENCE) -> Column:
    """struct<intent, confidence> of the first rule of which any keyword occurs, without case."""
    low = F.lower(text)
    out = F.struct(F.lit(default).alias("intent"), F.lit(confidence).alias("confidence"))
    for r in reversed(rules):
        hit = F.lit(False)
        for k in r.keywords:
            if k:
                hit = hit | F.contains(low, F.lit(k.lower()))
        out = F.when(hit, F.struct(F.lit(r.intent).alias("intent"), F.lit(float(r.confidence)).alias("confidence"))).otherwise(out)
    return out


def coerced_intent(name: Column, confidence: Column, known: Sequence[str], question: Column, outside: str = "out_of_domain", default: str = DEFAULT_INTENT) -> Column:
    """A model's answer made sound: no question is out of domain for sure, unknown names are the default, confidence is clamped."""
    c = F.when(confidence.isNull() | F.isnan(confidence), F.lit(DEFAULT_CONFIDENCE)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), confidence)))
    low = F.lower(F.trim(name))
    return F.when(F.coalesce(F.trim(question), F.lit("")) == "", F.struct(F.lit(outside).alias("intent"), F.lit(1.0).alias("confidence"))).otherwise(F.struct(F.when(low.isin(list(known)), low).otherwise(default).alias("intent"), c.alias("confidence")))


def rejected(intent_name: Column, confidence: Column, outside: Sequence[str] = ("out_of_domain",), least: float = REJECT_BELOW, keep_unsure: bool = False) -> Column:
    unsure = F.lit(False) if keep_unsure else confidence < least
    return intent_name.isin(list(outside)) | unsure


def rewritten(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The result of the first (pattern, replacement) that changes the text; else the text."""
    if not rules:
        return text
    return F.coalesce(*[F.nullif(F.regexp_replace(text, p, r), text) for p, r in rules], text)


def worth_hyde(text: Column) -> Column:
    """Whether a draft answer helps the search: short questions only; a question without spaces counts its characters."""
    w = F.filter(F.split(F.trim(text), r"\s+"), lambda x: x != "")
    return F.when(F.size(w) <= 1, F.char_length(F.trim(text)) <= HYDE_WORDS).otherwise(F.size(w) <= HYDE_WORDS)


def paraphrases(original: Column, variants: Column) -> Column:
    """Variants trimmed, each once without case, without empty ones and the original."""
    t = F.filter(F.transform(variants, lambda v: F.trim(v)), lambda v: (v != "") & (F.lower(v) != F.lower(F.trim(original))))
    return F.filter(t, lambda v, i: (i == 0) | ~F.array_contains(F.transform(F.slice(t, 1, F.greatest(i, F.lit(1))), lambda x: F.lower(x)), F.lower(v)))


def cached(questions: DataFrame, cache: DataFrame, least: float = CACHE_COSINE, size: int = CACHE_SIZE) -> DataFrame:
    """(query_id, block_id, score) of the questions whose nearest cached key is near enough. The cache holds the last `size` keys by seq."""
    kept = cache.orderBy(F.desc("seq")).limit(size)
    return similarity.nearest(questions, kept, 1).filter(F.col("score") >= least).drop("rank")


def window_text(turns: Column, last: int) -> Column:
    """The last turns (array of struct<role, content>) as lines."""
    n = F.size(turns)
    tail = F.slice(turns, F.greatest(n - last + 1, F.lit(1)), last)
    return F.array_join(F.transform(tail, lambda t: F.concat(t["role"], F.lit(": "), t["content"])), "\n")


def routed(intent_name: Column, routes: dict[str, str], default: str | None = None, explicit: Column | None = None) -> Column:
    """Knowledge base of an intent; one given explicitly wins."""
    m = F.create_map(*[F.lit(x) for kv in routes.items() for x in kv])[intent_name] if routes else F.lit(None)
    return F.coalesce(explicit if explicit is not None else F.lit(None).cast("string"), m, F.lit(default))
