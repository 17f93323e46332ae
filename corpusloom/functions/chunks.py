"""Splitters: plain chunks for a baseline index, and segments for block generation."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values.
SEPARATORS = ("\n\n", "\n", ". ", " ", "")
CHUNK, OVERLAP, SEGMENT, BLOCK_CHARS = 400, 50, 12_000, 800


def segments(text: str | None, most: int = SEGMENT) -> list[str]:
    """Stretches of at most `most` characters, cut level by level: what is still too long is cut at every next finer separator.

    Neighbours are put together again, with blank lines, as many as fit.
    """
    text = (text or "").strip()
    spans = [(0, len(text))] if text else []
    for separator in map(re.compile, map(re.escape, filter(None, SEPARATORS))):
        finer = []
        for low, high in spans:
            gaps = separator.finditer(text, low, high) if high - low > most else ()
            edges = [low, *chain.from_iterable(m.span() for m in gaps), high]
            finer += zip(edges[::2], edges[1::2])
        spans = finer
    parts = [part for low, high in spans for at in range(low, high, most) if (part := text[at : min(at + most, high)].strip())]
    ends = np.cumsum([len(part) + 2 for part in parts])
    out, at = [], 0
    while at < len(parts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most + 2, "right")))
        out.append("\n\n".join(parts[at:stop]))
        at = stop
    return out


def _packed(parts: Iterable[str], joint: str, size: int, overlap: int) -> list[str]:
    """Parts joined while they fit; what begins anew repeats the end of the one before if there is room for it."""
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + len(joint) + len(part) <= size:
            out[-1] += joint + part
            continue
        repeat = out[-1][-overlap:] + joint if out and overlap else ""
        out.append(repeat + part if len(repeat) + len(part) <= size else part)
    return out


def chunks(text: str | None, size: int = CHUNK, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters for a baseline index.

    A text is cut at the first separator it has, each part that is too long likewise with the finer ones (without any, into windows), and
    the results are packed again on every level. Null and empty texts have none.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")
    if not text or len(text) <= size:
        return [text] if text else []
    level = next((n for n, s in enumerate(separators) if s and s in text), None)
    if level is None:
        return [text[at : at + size] for at in range(0, len(text) - overlap, size - overlap)]
    parts = (chunks(part, size, overlap, separators[level + 1 :]) for part in text.split(separators[level]) if part)
    return _packed(chain.from_iterable(parts), separators[level], size, overlap)


def chunked(df: DataFrame, id_col: str, text_col: str, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, id_col, start, end, text); chunk ids are the row's id, #, and the chunk's number, places those in the stream of its chunks."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, found in zip(b["id"], (chunks(text, size, overlap) for text in b["text"])):
                ends = list(accumulate(map(len, found)))
                rows += [(f"{i}#{n}", i, end - len(t), end, t) for n, (t, end) in enumerate(zip(found, ends))]
            yield pd.DataFrame(rows, columns=["chunk_id", "id", "start", "end", "text"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"chunk_id string, id {kind}, start int, end int, text string").withColumnRenamed("id", id_col)


def segmented(df: DataFrame, id_col: str, text_col: str, most: int = SEGMENT) -> DataFrame:
    """(id_col, segment_no, segment)."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, n, s) for i, text in zip(b["id"], b["text"]) for n, s in enumerate(segments(text, most))]
            yield pd.DataFrame(rows, columns=["id", "segment_no", "segment"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, segment_no int, segment string").withColumnRenamed("id", id_col)
