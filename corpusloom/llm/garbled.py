"""Problem 9: text that was decoded with the wrong character encoding.

How often each pair of neighbouring characters occurs is counted over the whole corpus (by hash, in 2^PAIR_BITS counters,
so the table has one size whatever the corpus). The mutual information of neighbours is the sum of p(a,b) * PMI(a,b) over
all pairs; a pair's score is by how many bits its part of that sum stays below what is usual, that is, below the mean of
the pairs' self-information plus USUAL bits. Pairs that the corpus hardly has, or has no more often than chance
would, score above zero, the pairs of sound text below. The improbable runs of a text are its maximal-scoring segments (Ruzzo
and Tompa), which bridge usual pairs between improbable ones, of at least LEAST bits.

Inverse mappings are tested on what such a run holds beyond ASCII, and nowhere else: the stretch is
encoded with each codec that may have been used wrongly and read again as UTF-8. A reading is taken if all of it (or, in
a stretch with sound neighbours or lost bytes, nearly all of it) is valid and its characters are no less probable than
before. Text of one byte a character that was read under another such codec is found by the bits that its places within
the runs gain together. A document with a reading is likelier to hold more: its runs are then looked for with EVIDENCE bits less.
All is repeated until nothing changes, for text that went wrong several times; each reading makes the text shorter, so it ends.
Replacement characters within a run can't be restored but are a case.

What stands between backticks on one line is a quotation and is never touched. Null and blank texts are sound. Garbling of one
kind that fills a large part of the corpus is usual there, so it isn't found; at a twentieth of the documents it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR_BITS = 20
#: Bits: above the mean of a pair that is still usual, of a run at least, less after a reading, of one pair at most, of a pair never seen at least.
USUAL, LEAST, EVIDENCE, MOST, UNSEEN = 4.5, 6.0, 3.0, 10.0, 4.0
#: Characters that one text counts for at most in the statistics, a longer one in proportion, so that no text makes its own garbling usual.
WEIGHT = 2000
CODECS = ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "gb18030", "cp1254", "iso8859_15", "cp866", "koi8_r", "iso8859_2", "big5"]
#: Codecs under which bytes of Western text were read one by one, and bits of gain that a document needs in all.
SINGLE, GAIN = ["cp850", "mac_roman", "cp437", "cp1250", "cp1251", "koi8_r"], 8.0
_QUOTED = re.compile(r"`[^`\n]+`")
_STRETCH = re.compile(r"[^\x00-\x7f]+")
#: Scripts and controls that chance makes of two Latin characters.
_ODD = re.compile("[\u0180-\u02c5\u02d0-\u036f\u0500-\u05ff\u0700-\u08ff\u0980-\u1dff\ue000-\uf8ff]")
_SEQUENCE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def pair_counts(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character pairs and of characters (those with themselves as a pair with 0), by hash."""
    size = 1 << PAIR_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(2 * size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                texts = [t for t in batch.column(0).slice(at, 500).to_pylist() if t]
                for c in (_codes(t) for t in texts if len(t) > WEIGHT):
                    for offset, slots in ((0, _slot(c[:-1], c[1:])), (size, _slot(c, np.zeros_like(c)))):
                        seen, times = np.unique(slots, return_counts=True)
                        n[seen + offset] += np.ceil(times * (WEIGHT / len(c))).astype(np.int64)
                c = _codes("\n".join(t for t in texts if len(t) <= WEIGHT))
                if len(c) > 1:
                    n[:size] += np.bincount(_slot(c[:-1], c[1:]), minlength=size)
                    n[size:] += np.bincount(_slot(c, np.zeros_like(c)), minlength=size)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(n[seen])], names=["slot", "n"])

    table = np.zeros(2 * size, np.int64)
    got = docs.select(text_col).mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    table[got["slot"].to_numpy()] = got["n"].to_numpy()
    return table[:size], table[size:]


def maximal_segments(scores: np.ndarray, least: float) -> list[tuple[int, int]]:
    """All maximal-scoring segments of at least `least`, as half-open spans, by Ruzzo and Tompa's algorithm in linear time.

    Neighbouring positive scores are taken together first, which leaves the segments as they are.
    """
    edge = np.flatnonzero(np.diff(np.concatenate([[0], (scores > 0).view(np.int8), [0]])))
    begins, ends = edge[::2], edge[1::2]
    total = np.concatenate([[0.0], np.cumsum(scores, dtype=np.float64)])
    found: list[tuple[float, float, int, int]] = []  # sum before, sum after, span
    for before, after, begin, end in zip(total[begins].tolist(), total[ends].tolist(), begins.tolist(), ends.tolist()):
        while True:
            at = len(found) - 1
            while at >= 0 and found[at][0] >= before:
                at -= 1
            if at < 0 or found[at][1] >= after:
                break
            before, begin = found[at][0], found[at][2]
            del found[at:]
        found.append((before, after, begin, end))
    return [(begin, end) for before, after, begin, end in found if after - before >= least]


class Restorer:
    def __init__(self, pairs: np.ndarray, chars: np.ndarray):
        total = max(1, int(chars.sum()))
        self.pair = np.log2(total) - np.log2(pairs + 0.5)
        self.char = np.log2(total) - np.log2(chars + 0.5)
        mean = float((self.pair * pairs).sum() / max(1, int(pairs.sum())))
        self.usual = min(mean + USUAL, float(np.log2(total)) + 1 - UNSEEN)  # the latter in tiny corpora only
        self.unseen = float(np.log2(total) + 0.9)
        self.pair, self.char = self.pair.astype(np.float32), self.char.astype(np.float32)
        self.known: dict[str, tuple[str, str] | None] = {}
        self.places: dict[tuple[str, str, str], dict[str, tuple[float, str]]] = {}

    def scores(self, c: np.ndarray) -> np.ndarray:
        """One less than the characters: bits that a pair's part of the mutual information lacks."""
        h, both = self.char[_slot(c, np.zeros_like(c))], self.pair[_slot(c[:-1], c[1:])]
        mutual = np.where(both < self.unseen, np.maximum(h[:-1] + h[1:] - both, 1 / 16), np.float32(1 / 16))
        return np.clip(both - np.log2(mutual) - self.usual, -MOST, MOST)

    def runs(self, text: str, less: float = 0.0) -> list[tuple[int, int]]:
        """Spans of characters of the improbable runs, in order."""
        if len(text) < 2:
            return [(0, len(text))] if text else []
        return [(low, high + 1) for low, high in maximal_segments(self.scores(_codes(text)) + np.float32(less), LEAST)]

    def surprise(self, s: str) -> float:
        """Mean self-information of the characters, as the corpus has them."""
        c = _codes(s)
        return float(self.char[_slot(c, np.zeros_like(c))].mean())

    @staticmethod
    def _encode(s: str, codec: str) -> bytes | None:
        try:
            return s.encode(codec)
        except UnicodeEncodeError:
            if codec in ("gb18030", "big5"):
                return None
        out = bytearray()  # bytes that the codec leaves undefined are often kept as control characters
        for ch in s:
            try:
                out += ch.encode(codec)
            except UnicodeEncodeError:
                if not 0x80 <= ord(ch) <= 0x9F and ord(ch) != 0xA0:
                    return None
                out.append(ord(ch))
        return bytes(out)

    def reading(self, s: str) -> tuple[str, str] | None:
        """The best reading of a stretch and its codec; None if it is sound."""
        if s in self.known:
            return self.known[s]
        best: tuple[tuple, str, str] | None = None
        if len(s) > 1 or ord(s[0]) > 0x2FF:
            before = self.surprise(s)
            for place, codec in enumerate(CODECS[:2]):  # bytes of Chinese text read as Latin
                raw = self._encode(s, codec)
                if raw is None or len(raw) < 4 or sum(b >= 0xA1 for b in raw) < 0.9 * len(raw):
                    continue
                text = raw.decode("gb18030", "replace")
                han = sum("\u4e00" <= ch <= "\u9fff" or ch in "，。、；：？！（）“”" for ch in text)
                after = self.surprise(text)
                if han >= 2 and han >= 0.9 * len(text) and after < before + 1:
                    best = ((False, round(after, 2), place), text, codec) if best is None or after < best[0][1] else best
            for place, codec in enumerate(CODECS):
                raw = self._encode(s, codec)
                if raw is None or len(raw) < 2:
                    continue
                sequences = list(_SEQUENCE.finditer(raw))
                valid = sum(len(m[0]) for m in sequences)
                if not valid:
                    continue
                ascii_bytes = sum(b < 0x80 for b in raw)
                rest = len(raw) - valid - ascii_bytes
                wide = codec in ("gb18030", "big5")
                if wide and (len(s) < 3 or rest > 0.34 * len(raw)):
                    continue
                if rest and not wide and rest > valid:
                    continue
                if rest and not wide and any(_ODD.search(x := m[0].decode("utf-8")) or "\u0900" <= x <= "\u097f" or "\u0a00" <= x <= "\u0a7f" for m in sequences):
                    continue
                if rest == 0:
                    text = raw.decode("utf-8")
                elif wide:
                    text = raw.decode("utf-8", "replace")
                else:  # sound characters beside garbled ones stay
                    parts, at = [], 0
                    for m in sequences:
                        parts += [raw[at : m.start()].decode(codec, "replace"), m[0].decode("utf-8")]
                        at = m.end()
                    text = "".join(parts) + raw[at:].decode(codec, "replace")
                if len(text) >= len(s):
                    continue
                after = self.surprise(text.replace("�", "") or "�")
                if any(0x80 <= ord(ch) < 0xA0 or 0xE000 <= ord(ch) < 0xF900 for ch in text):
                    after += 2  # still wrong, perhaps garbled twice
                # a stretch that is valid from end to end is evidence enough, unless it reads as characters nobody writes
                if after > before + 1 and not (rest == 0 and not wide and after < before + 12 and not _ODD.search(text)):
                    continue
                key = (rest > 0, round(after, 2), place)
                if best is None or key < best[0]:
                    best = (key, text, codec)
        found = (best[1], best[2]) if best else None
        if len(self.known) < 200_000:
            self.known[s] = found
        return found

    def bits(self, s: str) -> float:
        """Self-information of the pairs of s."""
        c = _codes(s)
        return float(self.pair[_slot(c[:-1], c[1:])].sum())

    def swapped(self, left: str, s: str, right: str) -> dict[str, tuple[float, str]]:
        """For each codec of SINGLE: bits that reading the stretch's bytes as Western text would gain in its context, and that text."""
        key = (left, s, right)
        if key in self.places:
            return self.places[key]
        out: dict[str, tuple[float, str]] = {}
        before = None
        for codec in SINGLE:
            try:
                text = s.encode(codec).decode("cp1252")
            except UnicodeError:
                continue
            if before is None:
                before = self.bits(left + s + right)
            if text[-1].islower() and right.isupper() or text[0].islower() and left.isupper():
                continue  # small letters within capitals
            gain = before - self.bits(left + text + right)
            if gain > 0:
                out[codec] = (gain, text)
        if len(self.places) < 400_000:
            self.places[key] = out
        return out

    def suspect(self, text: str, less: float) -> list[tuple[int, int]]:
        """What the improbable runs of the text hold beyond ASCII, whole stretches, without quotations."""
        quoted, runs = [m.span() for m in _QUOTED.finditer(text)], self.runs(text, less)
        out, q, r = [], 0, 0
        for m in _STRETCH.finditer(text):
            low, high = m.span()
            while q < len(quoted) and quoted[q][1] <= low:
                q += 1
            while r < len(runs) and runs[r][1] <= low:
                r += 1
            if r < len(runs) and runs[r][0] < high and not (q < len(quoted) and quoted[q][0] < low < quoted[q][1]):
                out.append((low, high))
        return out

    def western(self, text: str, spans: list[tuple[int, int]], codecs: list[str]) -> tuple[str, str] | None:
        """(text, codec) if the bytes of Western text were read under another single-byte codec, as the gains of all places together show."""
        found = [(low, high, gains) for low, high in spans if (gains := self.swapped(text[low - 1 : low] or "\n", text[low:high], text[high : high + 1] or "\n"))]
        best = None
        for codec in codecs:
            own = [(low, high, *g[codec]) for low, high, g in found if codec in g]
            total = sum(gain for _, _, gain, _ in own)
            in_word = any(text[max(0, low - 1) : low].isalpha() or text[high : high + 1].isalpha() for low, high, _, _ in own)
            if in_word and total >= GAIN and (best is None or total > best[0]):
                best = (total, codec, own)
        if best is None:
            return None
        out, at = [], 0
        for low, high, _, new in best[2]:
            out += [text[at:low], new]
            at = high
        return "".join(out) + text[at:], best[1]

    def restore(self, text: str | None) -> tuple[str, list[str], bool] | None:
        """(text as far as it can be had, codecs, whether all of it); None for a sound text."""
        if not text or text.isascii():
            return None
        codecs: list[str] = []
        lost = swapped = False
        while True:
            less = EVIDENCE if codecs else 0.0
            spans = self.suspect(text, less)
            out, at = [], 0
            for low, high in spans:
                s = text[low:high]
                if "\ufffd" in s:
                    lost = True
                    parts = re.split("(\ufffd+)", s)
                    read = [self.reading(x) if x and x[0] != "\ufffd" else None for x in parts]
                else:
                    parts, read = [s], [self.reading(s)]
                if any(read):
                    codecs += dict.fromkeys(x[1] for x in read if x and x[1] not in codecs)
                    out += [text[at:low], *(x[0] if x else part for x, part in zip(read, parts))]
                    at = high
            if at:
                text = "".join(out) + text[at:]
                continue
            if not swapped and (got := self.western(text, spans, SINGLE)):
                codecs += [got[1]] if got[1] not in codecs else []
                text, swapped = got[0], True
                if got := self.western(text, self.suspect(text, EVIDENCE), [got[1]]):  # places too usual to be seen at first
                    text = got[0]
                continue
            break
        if not codecs and not lost:
            return None
        return text, codecs, not lost and "\ufffd" not in text


def restored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, restored, codecs, complete) of each garbled document. Two passes over the texts, no shuffle of them."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    tables = spark.sparkContext.broadcast(pair_counts(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(*tables.value)
        for batch in batches:
            rows = [(i, *found) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (found := restorer.restore(t))]
            columns = list(zip(*rows)) if rows else [(), (), (), ()]
            kinds = [batch.schema.field(0).type, pa.string(), pa.list_(pa.string()), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[id_col, "restored", "codecs", "complete"])

    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, f"{id_col} {kind}, restored string, codecs array<string>, complete boolean")
