"""Blocks out of documents: segments, a pluggable model, and the coercion of what it says."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.cleaning import stripped
from corpusloom.functions.chunks import BLOCK_CHARS, segmented
from corpusloom.functions.noisy_json import salvage

TAGS = ["IMPORTANT", "WARNING", "TECHNOLOGY", "PROCESS", "REFERENCE", "FAQ", "TROUBLESHOOTING", "SECURITY", "ARCHITECTURE", "API", "DATASET", "POLICY"]


class Client(Protocol):
    def complete(self, prompt: str) -> str: ...


class TemplateClient:
    """Offline stand-in for a model: the first sentence names and asks, the segment answers."""

    def complete(self, prompt: str) -> str:
        text = " ".join(prompt.split())
        first = next((s.strip() for s in text.replace("。", ". ").split(". ") if s.strip()), "")
        return json.dumps([{"name": first[:200], "critical_question": first[:299], "trusted_answer": text[:500], "tags": ["reference"], "keywords": []}], ensure_ascii=False)


class ScriptedClient:
    """Answers from a list, for tests."""

    def __init__(self, answers: list[str]):
        self.answers = list(answers)

    def complete(self, prompt: str) -> str:
        return self.answers.pop(0) if self.answers else "[]"


def cap(text: Column) -> Column:
    """Most blocks of a segment."""
    return F.greatest(F.lit(1), F.ceil(F.char_length(text) / BLOCK_CHARS).cast("int"))


def ensure_question(c: Column) -> Column:
    """The question with its mark: full stops at its end make way for it."""
    t = F.regexp_replace(c, r"\s+$", "")
    return F.when(t.rlike("[?？]$"), t).otherwise(F.concat(F.regexp_replace(t, "[.!。]+$", ""), F.lit("?")))


def coerced_tags(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, lambda t: F.upper(F.trim(t))), lambda t: t.isin(TAGS)))


def coerced_type(c: Column, known: list[str], default: str = "CONCEPT") -> Column:
    return F.coalesce(F.when(F.upper(F.trim(c)).isin(known), F.upper(F.trim(c))), F.lit(default))


def invalid(name: Column, question: Column, answer: Column) -> Column:
    """Why a block can't be used, or null; too long answers are refused, never cut."""
    empty = lambda c: F.coalesce(stripped(c), F.lit("")) == ""
    return F.when(empty(name), "missing name").when(empty(question), "missing question").when(empty(answer), "missing answer").when(F.char_length(stripped(answer)) > 500, "answer too long")


def generated(docs: DataFrame, id_col: str, text_col: str, client: Callable[[], Client] = TemplateClient) -> DataFrame:
    """(id_col, segment_no, block_no, name, critical_question, trusted_answer, tags, error).

    One client for each Python worker. A segment whose answer can't be read is a row with an error; others go on.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = client()
        for b in batches:
            rows = []
            for i, n, s in zip(b["id"], b["segment_no"], b["segment"]):
                try:
                    found = salvage(model.complete(s))
                    found = found.get("blocks", [found]) if isinstance(found, dict) else found
                    if not isinstance(found, list):
                        raise ValueError("no JSON in the answer")
                    for k, x in enumerate(found):
                        rows.append((i, n, k, len(s), *(x.get(f) for f in ("name", "critical_question", "trusted_answer")), [str(t) for t in x.get("tags") or []], None))
                except Exception as e:  # noqa: BLE001
                    rows.append((i, n, 0, len(s), None, None, None, [], f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["id", "segment_no", "block_no", "size", "name", "critical_question", "trusted_answer", "tags", "failure"])

    s = segmented(docs, id_col, text_col).withColumnRenamed(id_col, "id")
    raw = s.mapInPandas(run, f"id {kind}, segment_no int, block_no int, size int, name string, critical_question string, trusted_answer string, tags array<string>, failure string")
    question = ensure_question(F.col("critical_question"))
    error = F.coalesce(F.col("failure"), invalid(F.col("name"), F.col("critical_question"), F.col("trusted_answer")))
    most = F.greatest(F.lit(1), F.ceil(F.col("size") / BLOCK_CHARS))
    kept = raw.withColumn("n", F.row_number().over(Window.partitionBy("id", "segment_no").orderBy("block_no"))).filter(F.col("n") <= most)
    return kept.select(F.col("id").alias(id_col), "segment_no", "block_no", stripped(F.col("name")).alias("name"), question.alias("critical_question"), stripped(F.col("trusted_answer")).alias("trusted_answer"), coerced_tags(F.col("tags")).alias("tags"), error.alias("error"))
