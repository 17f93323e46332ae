"""Keywords and summaries of documents."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators.similarity import top_k

#: Shortest Latin token, longest phrase, least cohesion of a character pair.
MIN_TOKEN, MAX_PHRASE, COHESION = 3, 5, 0.34
#: Fixed values of the graph ranking: window, damping, iterations, tolerance, longest merge.
WINDOW, DAMPING, ITERATIONS, TOLERANCE, MERGE = 4, 0.85, 50, 1e-6, 4
#: Fixed values of the summary: shortest sentence, sentences with a lead bonus, bonus, relevance weight, greatest overlap.
MIN_SENTENCE, LEAD, BONUS, RELEVANCE, OVERLAP = 8, 5, 0.35, 0.6, 0.65


def _tokens(df: DataFrame, id_col: str, text_col: str, tokenizer) -> DataFrame:
    """(id, segment, place, token) of every token of every segment."""
    segments = df.select(F.col(id_col).alias("id"), F.posexplode(T.phrases(F.col(text_col))).alias("segment", "s"))
    return segments.select("id", "segment", F.posexplode(tokenizer(F.col("s"))).alias("place", "token"))


def breaks(token: Column) -> Column:
    """Whether a token ends a phrase: a stop word, or a short Latin one."""
    cjk = token.rlike(f"[{T.CJK}]")
    return T.is_stop(token) | (~cjk & (F.char_length(token) < MIN_TOKEN))


def rake(df: DataFrame, id_col: str, text_col: str, k: int = 10, tokenizer=T.latin_tokens, gate: DataFrame | None = None, digits: int = 6) -> DataFrame:
    """(id_col, keyword, score, rank): phrases between stop words, by degree over frequency of their words.

    gate: (id, token) of the CJK pairs that count as words; others end a phrase.
    """
    t = _tokens(df, id_col, text_col, tokenizer).withColumn("break", breaks(F.col("token")))
    if gate is not None:
        t = t.join(gate.withColumn("good", F.lit(True)), ["id", "token"], "left")
        t = t.withColumn("break", F.col("break") | (F.col("token").rlike(f"^[{T.CJK}]{{2}}$") & F.col("good").isNull()))
    order = Window.partitionBy("id", "segment").orderBy("place")
    islands = t.withColumn("island", F.sum(F.col("break").cast("int")).over(order)).filter(~F.col("break"))
    # phrases are short: at most MAX_PHRASE words survive, longer runs are dropped by their count
    phrase = islands.groupBy("id", "segment", "island").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.sort_array(F.collect_list(F.struct("place", "token"))).alias("w")).filter(F.col("n") <= MAX_PHRASE)
    phrase = phrase.select("id", "segment", "island", "n", F.transform("w", lambda x: x["token"]).alias("w"))
    word = phrase.select("id", "n", F.explode(F.array_distinct("w")).alias("token"), "w").withColumn("times", F.size(F.filter("w", lambda x: x == F.col("token"))))
    scores = word.groupBy("id", "token").agg(F.sum("times").alias("f"), F.sum(F.col("n") - 1).alias("d")).select("id", "token", ((F.col("d") + F.col("f")) / F.col("f")).alias("s"))
    each = phrase.select("id", "segment", "island", "n", F.array_join("w", " ").alias("keyword"), F.explode("w").alias("token")).join(scores, ["id", "token"])
    total = each.groupBy("id", "segment", "island", "keyword", "n").agg(F.sum("s").alias("s"))
    best = total.groupBy("id", "keyword").agg(F.round(F.max(F.col("s") * (1.0 + 0.1 * (F.col("n") - 1))), digits).alias("score"))
    return top_k(best, ["id"], k, F.desc("score"), F.col("keyword")).withColumnRenamed("id", id_col)


def tfidf(df: DataFrame, id_col: str, text_col: str, k: int = 10, tokenizer=T.latin_tokens, digits: int = 6) -> DataFrame:
    """(id_col, keyword, score, rank): terms of a document against its own segments."""
    segments = df.select(F.col(id_col).alias("id"), F.size(T.phrases(F.col(text_col))).alias("segments"))
    t = _tokens(df, id_col, text_col, tokenizer).filter(~breaks(F.col("token")))
    counts = t.groupBy("id", "token", "segment").agg(F.count("*").alias("n")).groupBy("id", "token").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))
    scored = counts.join(segments, "id").select("id", F.col("token").alias("keyword"), F.round((1.0 + F.log("tf")) * (F.log((1.0 + F.col("segments")) / (1.0 + F.col("df"))) + 1.0), digits).alias("score"))
    return top_k(scored, ["id"], k, F.desc("score"), F.col("keyword")).withColumnRenamed("id", id_col)


def cohesive(text: str) -> set[str]:
    """CJK pairs that hold together: cohesion at or above the floor, and in the heaviest cover of their run without overlap."""
    import re

    runs = re.findall("[一-鿿㐀-䶿\U00020000-\U0002b81f぀-ヿ가-힯]+", text)
    chars: dict[str, int] = {}
    pairs: dict[str, int] = {}
    for r in runs:
        for i, ch in enumerate(r):
            chars[ch] = chars.get(ch, 0) + 1
            if i:
                pairs[r[i - 1 : i + 1]] = pairs.get(r[i - 1 : i + 1], 0) + 1
    out: set[str] = set()
    for r in runs:
        total, taken = [0.0, 0.0], [False, False]
        for i in range(2, len(r) + 1):
            p = r[i - 2 : i]
            c = pairs[p] / max(chars[p[0]], chars[p[1]])
            use = c >= COHESION and total[i - 2] + c >= total[i - 1]
            total.append(total[i - 2] + c if use else total[i - 1])
            taken.append(use)
        i = len(r)
        while i >= 2:
            if taken[i]:
                out.add(r[i - 2 : i])
            i -= 2 if taken[i] else 1
    return out


def gate(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, token) of the cohesive pairs of each document."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, p) for i, t in zip(b["id"], b["text"]) if t for p in cohesive(t)]
            yield pd.DataFrame(rows, columns=["id", "token"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, f"id {kind}, token string")


def rank_graph(segments: list[list[str]]) -> dict[str, float]:
    """Weighted random-walk scores of words that stand within WINDOW of each other."""
    names = sorted({w for s in segments for w in s})
    at = {w: i for i, w in enumerate(names)}
    links: dict[tuple[int, int], float] = {}
    for s in segments:
        for i, a in enumerate(s):
            for b in s[i + 1 : i + 1 + WINDOW]:
                if a != b:
                    x, y = at[a], at[b]
                    links[x, y] = links.get((x, y), 0.0) + 1
                    links[y, x] = links.get((y, x), 0.0) + 1
    score = np.ones(len(names))
    if links:
        (to, frm), w = np.array(list(links)).T, np.array(list(links.values()))
        out = np.bincount(frm, w, minlength=len(names))
        for _ in range(ITERATIONS):
            new = (1 - DAMPING) + DAMPING * np.bincount(to, w * score[frm] / out[frm], minlength=len(names))
            change, score = np.abs(new - score).sum(), new
            if change < TOLERANCE:
                break
    else:
        score[:] = 1 - DAMPING
    return dict(zip(names, score.tolist()))


def textrank_words(segments: list[list[str]], k: int) -> list[tuple[str, float]]:
    """The k best of: islands of neighbouring words of the 3k best (mean score, at most MERGE words), and all words outside of them."""
    scores = rank_graph(segments)
    order = sorted(scores, key=lambda w: (-round(scores[w], 9), w))
    best = set(order[: 3 * k])
    flat = [(n, w) for n, s in enumerate(segments) for w in s]
    spots = np.array([i for i, (_, w) in enumerate(flat) if w in best], np.int64)
    out: dict[str, float] = {}
    if len(spots):
        segment = np.array([flat[i][0] for i in spots])
        fresh = np.concatenate([[True], (np.diff(spots) > 1) | (np.diff(segment) > 0)])
        within = np.arange(len(spots)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        starts = np.flatnonzero(within % MERGE == 0)
        value = np.array([scores[flat[i][1]] for i in spots])
        means = np.add.reduceat(value, starts) / np.diff(np.append(starts, len(spots)))
        for part, mean in zip(np.split(spots, starts[1:]), means.tolist()):
            out.setdefault(" ".join(flat[i][1] for i in part), mean)
    inside = {flat[i][1] for i in spots}
    out |= {w: scores[w] for w in order if w not in inside and w not in out}
    return sorted(out.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k]  # equal but for the order of summing: by name


def textrank(df: DataFrame, id_col: str, text_col: str, k: int = 10, tokenizer=T.latin_tokens, digits: int = 6) -> DataFrame:
    """(id_col, keyword, score, rank). Tokens are cut in the JVM; a document's graph is one row of a batch."""
    kind = df.schema[id_col].dataType.simpleString()
    kept = lambda s: F.filter(tokenizer(s), lambda t: ~breaks(t))
    rows = df.select(F.col(id_col).alias("id"), F.transform(T.phrases(F.col(text_col)), lambda s: F.array_join(kept(s), " ")).alias("segments"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, segments in zip(b["id"], b["segments"]):
                words = [s.split(" ") for s in segments if s] if segments is not None else []
                out += [(i, w, round(v, digits), n) for n, (w, v) in enumerate(textrank_words(words, k), 1)]
            yield pd.DataFrame(out, columns=["id", "keyword", "score", "rank"])

    return rows.mapInPandas(run, f"id {kind}, keyword string, score double, rank int").withColumnRenamed("id", id_col)


EXTRACTORS = {"rake": rake, "tfidf": tfidf, "tf-idf": tfidf, "textrank": textrank, "text-rank": textrank}


def extractor(name: str):
    if name.lower() not in EXTRACTORS:
        raise ValueError(f"unknown extractor {name}")
    return EXTRACTORS[name.lower()]


def auto_tags(df: DataFrame, id_col: str, text_col: str, k: int = 8, most_words: int = 3, **options) -> DataFrame:
    """(id_col, tag, rank): keywords as tags; phrases of more than most_words words give their words instead."""
    found = rake(df, id_col, text_col, 2 * k, **options)
    words = F.split("keyword", " ")
    flat = found.select(id_col, "rank", F.posexplode(F.when(F.size(words) <= most_words, F.array("keyword")).otherwise(words)).alias("part", "tag"))
    first = flat.groupBy(id_col, "tag").agg(F.min(F.struct("rank", "part")).alias("at"))
    w = Window.partitionBy(id_col).orderBy("at")
    return first.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(id_col, "tag", "rank")


def retagged(tags: Column, extra: Column, replace: bool) -> Column:
    """The tags with the extra ones, or those alone, trimmed, each once in order."""
    given = extra if replace else F.concat(F.coalesce(tags, F.array().cast("array<string>")), extra)
    return F.array_distinct(F.filter(F.transform(given, lambda t: F.trim(t)), lambda t: t != ""))


def pick_sentences(tokens: list[list[str]], most: int) -> list[int]:
    """Indices of the sentences of a summary: frequent words, a bonus for the first sentences, no restatements.

    Sentences are rows of a matrix of word counts. Each pick is the best of the open rows, those not too similar to any pick so far.
    """
    words = {w: n for n, w in enumerate(dict.fromkeys(chain.from_iterable(tokens)))}
    if not words:
        return list(range(min(most, len(tokens))))
    counts = np.zeros((len(tokens), len(words)))
    np.add.at(counts, ([n for n, s in enumerate(tokens) for _ in s], [words[w] for s in tokens for w in s]), 1)
    length, total = counts.sum(axis=1), counts.sum(axis=0)
    lead = np.maximum(0, 1 - np.arange(len(tokens)) / LEAD)
    relevance = RELEVANCE * (counts @ total / total.max() / np.sqrt(np.maximum(length, 1))) * (1 + BONUS * lead)
    seen = (counts > 0).astype(float)
    both = seen @ seen.T
    either = seen.sum(axis=1)[:, None] + seen.sum(axis=1) - both
    like = np.divide(both, either, out=np.zeros_like(both), where=either > 0)
    nearest, picked = np.zeros(len(tokens)), np.zeros(len(tokens), bool)
    for _ in range(min(most, len(tokens))):
        value = np.where(picked | (nearest > OVERLAP), -np.inf, relevance - (1 - RELEVANCE) * nearest)
        if np.isneginf(value).all():
            break
        picked[at := int(value.argmax())] = True
        nearest = np.maximum(nearest, like[at])
    return np.flatnonzero(picked).tolist()


def summaries(df: DataFrame, id_col: str, text_col: str, most: int = 3, tokenizer=T.auto_tokens) -> DataFrame:
    """(id_col, summary): at most `most` sentences in text order; a text without any is its own summary."""
    kind = df.schema[id_col].dataType.simpleString()
    s = F.filter(T.summary_sentences(F.col(text_col)), lambda x: F.char_length(x) >= MIN_SENTENCE)
    tokens = F.transform(s, lambda x: F.array_join(F.filter(tokenizer(x), lambda t: ~T.is_stop(t)), " "))
    rows = df.select(F.col(id_col).alias("id"), F.trim(text_col).alias("text"), s.alias("sentences"), tokens.alias("tokens"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, text, sentences, toks in b.itertuples(index=False):
                if sentences is None or not len(sentences):
                    out.append((i, text))
                else:
                    out.append((i, " ".join(sentences[j] for j in pick_sentences([t.split(" ") if t else [] for t in toks], most))))
            yield pd.DataFrame(out, columns=["id", "summary"])

    return rows.mapInPandas(run, f"id {kind}, summary string").withColumnRenamed("id", id_col)
