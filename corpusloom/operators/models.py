"""Steps that a model takes, over tables: one client for each Python worker, an offline default, and sound results whatever it says."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.noisy_json import salvage
from corpusloom.operators.generation import TAGS, Client

#: Characters of a body that a summary prompt takes (head and tail), longest refined question, score without an answer.
BODY_CHARS, QUESTION_CHARS, UNKNOWN = 12_000, 400, 0.5


class Echo:
    """Offline client: says nothing, so that every step takes its fallback."""

    def complete(self, prompt: str) -> str:
        return ""


def said(df: DataFrame, prompt: Column, into: str = "said", client: Callable[[], Client] = Echo) -> DataFrame:
    """df with the model's answer to each prompt; a failed call is null."""
    schema = df.withColumn(into, F.lit("")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()
        for b in batches:
            answers = []
            for p in b[into]:
                try:
                    answers.append(model.complete(p) if p is not None else None)
                except Exception:  # noqa: BLE001
                    answers.append(None)
            b[into] = answers
            yield b

    return df.withColumn(into, prompt).mapInPandas(run, schema)


def head_and_tail(text: Column, most: int = BODY_CHARS) -> Column:
    half = most // 2
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, half), F.lit("\n...\n"), F.right(text, F.lit(half))))


def score(answer: Column) -> Column:
    """A score between 0 and 1 out of {"score": x} or a bare number; UNKNOWN without one."""
    x = F.coalesce(F.get_json_object(answer, "$.score"), F.regexp_extract(answer, r"^\s*([01](?:\.\d+)?)\s*$", 1)).try_cast("double")
    return F.when(x.isNull() | F.isnan(x), F.lit(UNKNOWN)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def refined(question: Column, answer: Column) -> Column:
    """The refined question, or the question itself if there is none, it is too long or the same."""
    t = F.trim(answer)
    return F.when((F.coalesce(t, F.lit("")) != "") & (F.char_length(t) <= QUESTION_CHARS) & (t != question), t).otherwise(question)


def with_fallback(answer: Column, fallback: Column) -> Column:
    return F.when(F.coalesce(F.trim(answer), F.lit("")) != "", F.trim(answer)).otherwise(fallback)


def self_query(answer: str | None, question: str) -> dict:
    """The question's text and a filter restricted to the tag vocabulary; the question alone if the answer can't be used."""
    d = salvage(answer)
    if not isinstance(d, dict):
        return {"query": question, "tags": [], "entities": [], "languages": [], "kb_id": None}
    strings = lambda k: [str(x) for x in d.get(k) or [] if x is not None]
    return {"query": str(d.get("query") or question), "tags": [t for t in dict.fromkeys(x.strip().upper() for x in strings("tags")) if t in TAGS], "entities": strings("entities"), "languages": strings("languages"), "kb_id": str(d["kb_id"]) if d.get("kb_id") else None}


def sub_queries(answer: str | None) -> dict:
    """Rewriting result: sub_queries, companies and years, each once without case."""
    d = salvage(answer)
    d = d if isinstance(d, dict) else {}
    once = lambda k: list({str(x).strip().lower(): str(x).strip() for x in reversed(d.get(k) or []) if x is not None and str(x).strip()}.values())[::-1]
    return {"rewritten": str(d.get("rewritten") or "").strip() or None, "sub_queries": once("sub_queries"), "companies": once("companies"), "years": once("years")}


def order(answer: str | None, n: int) -> list[int]:
    """A reranking of n candidates: the named ones in order, each once, then those that weren't named."""
    d = salvage(answer)
    named = d.get("order") if isinstance(d, dict) else d
    given = []
    for x in named if isinstance(named, list) else []:
        try:
            k = int(x)
        except (TypeError, ValueError):
            continue
        if 0 <= k < n and k not in given:
            given.append(k)
    return given + [k for k in range(n) if k not in given]
