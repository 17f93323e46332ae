"""Problem 2: items above a size limit cut into pieces at natural boundaries.

Recursive bisection: a stretch longer than the limit less the overlap is cut at the strongest boundary of its middle
half (ties: the one nearest to the midpoint), or at the nearest boundary at all, or, where there is none, at the
midpoint, never between a character and its combining marks; the halves are treated alike. Then each piece but the first
is given up to `overlap` characters from the end of the one before it, from the start of a word on if there is one.

The pieces less their overlaps, in order, are the whole text, white space included, to the character. Sizes are in code
points. Null, blank and short texts (trimmed length up to the limit) are whole already and give no rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD, CLAUSE, SENTENCE, LINE, FENCE, PARAGRAPH, HEADING = range(1, 8)
_FENCE = re.compile(r"^[ \t]*(?:```|~~~)[^\n]*\n?", re.M)
_HEADING = re.compile(r"^#{1,6}[ \t]", re.M)
_PARAGRAPH = re.compile(r"\n[ \t\r]*\n\s*|\r\r\s*")
_LINE = re.compile(r"\r\n|[\n\r  ]")
_SENTENCE = re.compile(r"[.!?…;:]+[\"'”’»)\]]*\s+|[。！？；]+[”’」』）]*")
_CLAUSE = re.compile(r"[,，、]\s*")
_WORD = re.compile(r"\s+")
_HAN = re.compile(r"(?<=[㐀-鿿])(?=[㐀-鿿])")


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """Places where text may be cut, in order, and how strong each is. Inside a fence only its lines and words count."""
    strength: dict[int, int] = {}

    def add(at: int, s: int) -> None:
        if 0 < at < len(text) and strength.get(at, 0) < s:
            strength[at] = s

    for pattern, s in ((_WORD, WORD), (_HAN, WORD), (_CLAUSE, CLAUSE), (_SENTENCE, SENTENCE), (_LINE, LINE), (_PARAGRAPH, PARAGRAPH)):
        for m in pattern.finditer(text):
            add(m.end(), s)
    for m in _HEADING.finditer(text):
        add(m.start(), HEADING)
    marks = list(_FENCE.finditer(text))
    fences = [(opening.start(), closing.end()) for opening, closing in zip(marks[::2], marks[1::2])]
    for low, high in fences:
        add(low, FENCE)
        add(high, FENCE)
    places = sorted(strength)
    at = 0
    for low, high in fences:  # both in text order: one pass
        at = bisect_right(places, low, at)
        while at < len(places) and places[at] < high:  # within the fence its lines are weaker than a sentence outside
            strength[places[at]] = CLAUSE if strength[places[at]] >= LINE else WORD
            at += 1
    return places, [strength[p] for p in places]


def _whole_character(text: str, at: int, low: int) -> int:
    """The place at or before `at` that doesn't cut off combining marks, joiners or variation selectors."""
    while at > low + 1 and (unicodedata.combining(text[at]) or text[at] in "‍︎️" or text[at - 1] == "‍" or "\U0001f3fb" <= text[at] <= "\U0001f3ff"):
        at -= 1
    return at


def cuts(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, core, end) of each piece: text[start:core] is the repeat, text[core:end] what is new. Empty text: none."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    if not text:
        return []
    places, strength = boundaries(text)
    most = limit - overlap
    todo, cores = [(0, len(text))], []
    while todo:
        low, high = todo.pop()
        if high - low <= most:
            cores.append((low, high))
            continue
        mid, quarter = (low + high) // 2, (high - low) // 4
        i, j = bisect_left(places, low + max(1, quarter)), bisect_right(places, high - max(1, quarter))
        if i < j:
            k = max(range(i, j), key=lambda k: (strength[k], -abs(places[k] - mid)))
            at = places[k]
        else:
            near = [p for p in (places[i - 1] if i else 0, places[j] if j < len(places) else len(text)) if low < p < high]
            at = min(near, key=lambda p: abs(p - mid)) if near else _whole_character(text, mid, low)
        todo += [(at, high), (low, at)]
    out, before = [], 0
    for low, high in cores:
        start = max(low - overlap, before) if out else low
        if start < low:
            k = bisect_left(places, start)
            start = places[k] if k < len(places) and places[k] < low else _after_marks(text, start, low)
        out.append((start, low, high))
        before = start
    return out


def _after_marks(text: str, at: int, high: int) -> int:
    while at < high and (unicodedata.combining(text[at]) or text[at] == "‍"):
        at += 1
    return at


def split(df: DataFrame, table_name: str, id_col: str, text_col: str, limit: int, overlap: int) -> DataFrame:
    """(table_name, item_id, piece_no, core_start, piece_start, piece_end, pieces, piece) of every row too long.

    piece_no counts from 1; a row delivered again gives the same rows again.
    """
    long = df.filter(F.char_length(text_col) > limit).select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).alias("text"))
    schema = "table_name string, item_id string, piece_no int, piece_start int, core_start int, piece_end int, pieces int, piece string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(text.strip()) <= limit:
                    continue
                found = cuts(text, limit, overlap)
                rows += [(table_name, item, n, a, c, b, len(found), text[a:b]) for n, (a, c, b) in enumerate(found, 1)]
            columns = list(zip(*rows)) if rows else [[]] * 8
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["table_name", "item_id", "piece_no", "piece_start", "core_start", "piece_end", "pieces", "piece"])

    return long.mapInArrow(run, schema)
