"""Problem 7: byte-level BPE ids of every text.

A text is cut into words by the tokenizer's pattern, and each word is merged with a contiguous rank array: the bounds of
its parts and the rank of each pair of neighbours lie in two lists; the smallest rank is found by a scan, the bound
between the two parts is deleted and the ranks of the new part with its neighbours are looked up again. Words longer
than LONG bytes, on which the scan would be quadratic, are merged through a heap, with the same result.

Null and empty texts have no ids (an empty list). Nothing is special: "<|endoftext|>" in a text is ordinary text.
"""

from __future__ import annotations

import base64
import heapq
import os
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files, which aren't part of this repository; it must exist on every executor.
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: the pattern of byte_bpe_50k that cuts a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG, CACHED_WORDS, CACHED_CHARS = 256, 400_000, 48
_NONE = 1 << 62
_LOADED: dict[str, "Bpe"] = {}


class Bpe:
    def __init__(self, path: str):
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words = regex.compile(WORDS)
        self.known: dict[str, tuple[int, ...]] = {}

    @staticmethod
    def of(path: str) -> "Bpe":
        """One vocabulary for each Python worker."""
        if path not in _LOADED:
            _LOADED[path] = Bpe(path)
        return _LOADED[path]

    def word(self, b: bytes) -> tuple[int, ...]:
        ranks = self.ranks
        if (whole := ranks.get(b)) is not None:
            return (whole,)
        if len(b) > LONG:
            return self._long(b)
        get = ranks.get
        bounds = list(range(len(b) + 1))
        pairs = [get(b[i : i + 2], _NONE) for i in range(len(b) - 1)]
        while pairs and (least := min(pairs)) != _NONE:
            i = pairs.index(least)
            del bounds[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(b[bounds[i] : bounds[i + 2]], _NONE)
            if i:
                pairs[i - 1] = get(b[bounds[i - 1] : bounds[i + 1]], _NONE)
        return tuple(ranks[b[x:y]] for x, y in zip(bounds, bounds[1:]))

    def _long(self, b: bytes) -> tuple[int, ...]:
        """Parts as a linked list over their first bytes; a heap entry counts only while both its parts are unchanged."""
        n, get = len(b), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(b[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            _, i, end = heapq.heappop(heap)
            if gone[i] or after[i] >= n or after[after[i]] != end:
                continue
            j = after[i]
            gone[j] = 1
            after[i] = end
            if end < n:
                before[end] = i
                if (r := get(b[i : after[end]])) is not None:
                    heapq.heappush(heap, (r, i, after[end]))
            if (p := before[i]) >= 0 and (r := get(b[p:end])) is not None:
                heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(self.ranks[b[i : after[i]]])
            i = after[i]
        return tuple(out)

    def encode_into(self, text: str, ids: array) -> None:
        known = self.known
        for w in self.words.findall(text):
            got = known.get(w)
            if got is None:
                got = self.word(w.encode("utf-8"))
                if len(w) <= CACHED_CHARS:
                    if len(known) >= CACHED_WORDS:
                        known.clear()
                    known[w] = got
            ids.extend(got)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> DataFrame:
    """(id_col, ids array<int>) of every row; other columns of df are not read. One pass, no shuffle."""
    path = os.path.join(folder or TOKENIZER_DIR, vocabulary)
    src = df.select(F.col(id_col), F.col(text_col).cast("string").alias("__text"))
    schema = f"{src.schema.fields[0].simpleString().split(':')[0]} {src.schema.fields[0].dataType.simpleString()}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = Bpe.of(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, offsets = array("i"), array("i", [0])
                for text in part.column(1):
                    if text := text.as_py():
                        bpe.encode_into(text, ids)
                    offsets.append(len(ids))
                lists = pa.ListArray.from_arrays(pa.Array.from_buffers(pa.int32(), len(offsets), [None, pa.py_buffer(offsets)]), pa.Array.from_buffers(pa.int32(), len(ids), [None, pa.py_buffer(ids)]))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=[id_col, "ids"])

    return src.mapInArrow(run, schema)
