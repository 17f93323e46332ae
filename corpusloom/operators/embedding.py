"""Hashing embeddings: signed feature hashing of words, word pairs and character trigrams, of unit length.

A row's n-grams are hashed and summed where the row is, in one Arrow pass: as column expressions they would be exploded into
hundreds of rows each and shuffled to be summed again (measured on 20,000 blocks: 14.7 s against 1.1 s).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CACHED = 500_000


def grams(text: str) -> list[str]:
    """Words, pairs of neighbouring words, trigrams of each word; a word of one or two characters counts once more."""
    w = text.lower().split()
    out = w + [f"{a} {b}" for a, b in zip(w, w[1:])]
    for x in w:
        if len(x) < 3:
            out.append(x)
        else:
            out += [x[i : i + 3] for i in range(len(x) - 2)]
    return out


def slot(gram: str, dimension: int) -> int:
    """2 * place + sign of a gram: the first four bytes of its hash, and the last bit of the fifth."""
    h = hashlib.sha256(gram.encode("utf-8")).digest()
    return int.from_bytes(h[:4], "big") % dimension * 2 + (h[4] & 1)


def dense(df: DataFrame, id_col: str, text: Column, dimension: int = 128) -> DataFrame:
    """(id_col, vector array<double>) of unit length. A text that is null, has no words, or whose sum is zero gives no row."""
    src = df.select(F.col(id_col), text.alias("__text"))
    kind = src.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                m = np.zeros((part.num_rows, dimension))
                for r, t in enumerate(part.column(1).to_pylist()):
                    if not t:
                        continue
                    own = []
                    for g in grams(t):
                        s = known.get(g)
                        if s is None:
                            if len(known) >= CACHED:
                                known.clear()
                            s = known[g] = slot(g, dimension)
                        own.append(s)
                    if own:
                        n = np.bincount(own, minlength=2 * dimension)
                        m[r] = n[1::2] - n[::2]
                length = np.sqrt((m * m).sum(axis=1))
                there = np.flatnonzero(length)
                m = m[there] / length[there, None]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, dimension, dtype=np.int32)), pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(there)), lists], names=[id_col, "vector"])

    return src.mapInArrow(run, f"{id_col} {kind}, vector array<double>")


def hashed(df: DataFrame, id_col: str, text: Column, dimension: int = 128) -> DataFrame:
    """(id_col, idx, value): the non-zero numbers of each unit vector."""
    return dense(df, id_col, text, dimension).select(id_col, F.posexplode("vector").alias("idx", "value")).filter("value != 0")


def embedding_text(name: Column, question: Column, answer: Column, prefix: str | None = None) -> Column:
    """What is embedded for a block; the prefix is for the index side only."""
    parts = [F.coalesce(c, F.lit("")) for c in (name, question, answer)]
    return F.concat(F.lit(f"{prefix}\n" if prefix else ""), F.concat_ws("\n", *parts))
