"""Problem 6: the language of each document and of each stretch of a mixed one.

Multinomial naive Bayes over hashed character n-grams (1 to 4, padded with spaces). The model is fitted on at most SAMPLE
labelled rows (those with the smallest hash of their id), in two rounds: the second leaves out rows whose label the first
one contradicts. Its matrix of log-probabilities (2^BITS x languages) is broadcast, and the sentences of a batch are
scored together in numpy.

Before a body is cut into sentences, fences, inline code, tables, addresses and names of settings are blanked out, so
neither they nor single foreign words can name a language. A sentence needs MIN_WORDS words (or MIN_HAN Han characters).
Confidence is the posterior of a sentence of at most EVIDENCE n-grams with the same mean scores, so that it stays below 1
in doubt; the document's is the mean over its sentences, weighted by length.

Null, blank and sentence-less bodies have no language and no row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LANGUAGES = ["en", "de", "fr", "es", "pt", "zh"]
#: Spellings of the labels, in lower case and without region.
SPELLINGS = {
    "en": ["en", "eng", "english"],
    "de": ["de", "deu", "ger", "german", "deutsch"],
    "fr": ["fr", "fra", "fre", "french", "français", "francais"],
    "es": ["es", "spa", "spanish", "español", "espanol", "castellano"],
    "pt": ["pt", "por", "portuguese", "português", "portugues"],
    "zh": ["zh", "zho", "chi", "cmn", "chinese", "mandarin", "中文", "汉语"],
}
SAMPLE, BITS, ORDERS, EVIDENCE = 3000, 16, (1, 2, 3, 4), 40
MIN_WORDS, MIN_HAN, SURE = 5, 8, 0.9
#: Mean log-odds for each n-gram by which the best language has to lead the next.
LEAD = 0.15

_BLANK = re.compile(
    r"```.*?(?:```|\Z)|~~~.*?(?:~~~|\Z)|`[^`\n]*`|<!--.*?-->|</?[A-Za-z][^<>\n]*>|https?://\S+|\S+@\S+|^[ \t]*\|[^\n]*$|^#{1,6}[ \t][^\n]*$|^[ \t]*[\w.\-]+[ \t]*[:=][ \t]*\S+[ \t]*$|[A-Za-z0-9]+[._/][A-Za-z0-9._/\-]*[A-Za-z0-9]|[!-~]*[0-9][!-~]*",
    re.S | re.M | re.A,
)
_SENTENCE = re.compile(r"[^.!?。！？；\n]+[.!?。！？；]*")
LETTERS = re.compile(r"[^\W\d_㐀-鿿]+")
HAN = re.compile(r"[㐀-鿿]")


def label(c: Column) -> Column:
    """The language that a label names: its code, or null if it names none of LANGUAGES."""
    base = F.regexp_extract(F.lower(F.trim(c)), r"^([^\-_ (]+)", 1)
    out = F.lit(None).cast("string")
    for code, spellings in SPELLINGS.items():
        out = F.when(base.isin(spellings), code).otherwise(out)
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of whole sentences, in text order. Headings are none."""
    masked = _BLANK.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    out = []
    for m in _SENTENCE.finditer(masked):
        s = m[0]
        if len(LETTERS.findall(s)) >= MIN_WORDS or len(HAN.findall(s)) >= MIN_HAN:
            out.append((m.start() + len(s) - len(s.lstrip()), m.start() + len(s.rstrip())))
    return out


def cleaned(text: str) -> str:
    return _BLANK.sub(" ", text)


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of each text, one text after the other, and the number of each."""
    joined = ["  " + re.sub(r"[\W\d_]+", " ", t.lower()).strip() + "  " for t in texts]
    lengths = np.array([len(t) for t in joined])
    c = np.frombuffer("".join(joined).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = max(ORDERS)
    c = np.concatenate([c, np.full(n, 32, np.uint64)])
    keys, h = [], np.zeros(len(c) - n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B1) + c[k : len(c) - n + k] + np.uint64(1)
        if k + 1 in ORDERS:
            x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            keys.append((x >> np.uint64(64 - BITS)).astype(np.int32))
    return np.stack(keys, axis=1), lengths


class Model:
    """log: float32 matrix of (2^BITS, languages)."""

    def __init__(self, log: np.ndarray):
        self.log = log

    @staticmethod
    def fit(texts: list[str], labels: list[int]) -> "Model":
        counts = np.zeros((len(LANGUAGES), 1 << BITS))
        keep = list(range(len(texts)))
        model = None
        for _ in range(2):
            counts[:] = 0
            for lang in range(len(LANGUAGES)):
                own = [texts[i] for i in keep if labels[i] == lang]
                for at in range(0, len(own), 200):
                    keys, _ = _grams(own[at : at + 200])
                    counts[lang] += np.bincount(keys.ravel(), minlength=1 << BITS)
            # counts per million, so that n-grams nobody has seen cost the same in languages of few and of many rows
            total = counts.sum(axis=1, keepdims=True)
            per_million = counts / np.maximum(total, 1) * 1e6
            log = np.where(total > 0, np.log(per_million + 0.05) - np.log(1e6 + 0.05 * (1 << BITS)), -30.0)
            model = Model(np.ascontiguousarray(log.T, np.float32))
            best, _ = model.score(texts)
            keep = [i for i in range(len(texts)) if best[i].argmax() == labels[i]]
        return model

    def score(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-probability of the n-grams of each text by language, and how many there are."""
        out, n = np.zeros((len(texts), len(LANGUAGES)), np.float32), np.zeros(len(texts), np.int64)
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size < 100_000 or end == at):
                size += len(texts[end]) + 4
                end += 1
            keys, lengths = _grams(texts[at:end])
            each = self.log[keys].sum(axis=1)
            starts = np.cumsum(lengths) - lengths
            out[at:end] = np.add.reduceat(each, starts, axis=0) / (lengths * len(ORDERS))[:, None]
            n[at:end] = lengths * len(ORDERS)
            at = end
        return out, n

    def decide(self, texts: list[str]) -> list[tuple[str, float, float]]:
        """(language, confidence, lead) of each text."""
        if not texts:
            return []
        mean, n = self.score(texts)
        order = np.sort(mean, axis=1)
        lead = order[:, -1] - order[:, -2]
        weight = np.minimum(n, EVIDENCE)[:, None]
        p = np.exp((mean - mean.max(axis=1, keepdims=True)) * weight)
        p = p.max(axis=1) / p.sum(axis=1)
        return [(LANGUAGES[k], float(q), float(d)) for k, q, d in zip(mean.argmax(axis=1), p, lead)]


def fitted(labelled: DataFrame, id_col: str, text_col: str, label_col: str) -> Model:
    """A model from a bounded sample of labelled rows; the sample is the same for the same rows."""
    named = labelled.select(F.xxhash64(id_col).alias("h"), F.col(text_col).substr(1, 20_000).alias("text"), label(F.col(label_col)).alias("label"))
    rows = named.filter("label is not null and length(trim(text)) > 0").orderBy("h", "text").limit(SAMPLE).collect()
    return Model.fit([cleaned(r.text) for r in rows], [LANGUAGES.index(r.label) for r in rows])


def segments(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """(id_col, segment_no, segment_start, segment_end, lang_code, confidence): neighbouring sentences of one language are one segment."""
    shared = docs.sparkSession.sparkContext.broadcast(model.log)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                ids, texts, owner, spans = part.column(0).to_pylist(), part.column(1).to_pylist(), [], []
                for k, t in enumerate(texts):
                    for s in sentences(t) if t else ():
                        owner.append(k)
                        spans.append(s)
                found = m.decide([cleaned(texts[k][a:b]) for k, (a, b) in zip(owner, spans)])
                rows: list[list] = []
                for k, (a, b), (lang, p, lead) in zip(owner, spans, found):
                    if p < SURE or lead < LEAD:
                        continue
                    last = rows[-1] if rows and rows[-1][0] == k else None
                    if last and last[4] == lang:
                        last[5] += p * (b - a)
                        last[6] += b - a
                        last[3] = b
                    else:
                        rows.append([k, last[1] + 1 if last else 1, a, b, lang, p * (b - a), b - a])
                col = lambda j, kind: pa.array([r[j] for r in rows], kind)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[r[0]] for r in rows], part.schema.field(0).type), col(1, pa.int32()), col(2, pa.int32()), col(3, pa.int32()), col(4, pa.string()), pa.array([r[5] / r[6] for r in rows], pa.float64())],
                    names=[id_col, "segment_no", "segment_start", "segment_end", "lang_code", "confidence"],
                )

    schema = f"{id_col} {kind}, segment_no int, segment_start int, segment_end int, lang_code string, confidence double"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
