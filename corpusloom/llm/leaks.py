"""Problem 8: evaluation passages in the corpus, by a positional inverted index.

The index is partitioned by document and written to the shared folder: for each document the terms that occur in any
evaluation passage and their positions (other words only move the positions). How often each of these terms occurs in
the whole corpus is summed from it. A passage of at least RUN words of which at most one in eight differs holds SEED
unchanged words in a row; so the positional lists of every such phrase of the references are intersected, adjusted by
their offsets and beginning with the phrase's rarest term. Each hit is then verified around its place: exactly (RUN words
or more of the reference on one diagonal, up to one in eight of them different, the first and the last the same) or by proximity (words dropped or added as well, by an
edit distance of up to one in eight).

Text that stands in the references of several items (SHARED words in a row) is left out, and so are the queries.
The evaluation set is the stated, bounded side: it is taken in blocks of at most about BLOCK items and BLOCK_CHARS characters, each broadcast, and every block
goes over all rows. Null, blank and short texts hold nothing; repeated rows are reported under their own id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.words import words
from corpusloom.plans.lineage import written

RUN, SEED, SHARED, BLOCK = 24, 6, 10, 5000
#: Characters of a block of items on average, so that long references make more blocks.
BLOCK_CHARS = 20_000_000
#: Lengths of the windows that are compared; longer passages hold one of these. Where a passage is cut between two neighbouring equal words,
#: with RUN words or more on each side, one side has no more than one in eight different. So only a passage that can't be cut needs a window of
#: its own: it has at most one equal word among those RUN - 1 away from both ends, n - 47 different ones, which n // 8 allows up to n = 53.
LENGTHS = range(RUN, 54)
_SHIFT = LENGTHS[-1] // 8


class Passages:
    """The references of one block of items, as term numbers, with the phrases to look for."""

    def __init__(self, items: list[tuple[int, str]]):
        texts = sorted({(i, r) for i, r in items if i is not None and r})
        tokens = [words(r) for _, r in texts]
        self.term = {w: n for n, w in enumerate(sorted({w for t in tokens for w in t}))}
        self.item = np.array([i for i, _ in texts], dtype=np.int64)
        pad = 2 * LENGTHS[-1]
        self.owner = np.full(sum(len(t) + pad for t in tokens) + pad, -1, dtype=np.int32)
        self.ref = np.full(len(self.owner), -2, dtype=np.int32)
        owners: dict[tuple, set[int]] = {}
        for (i, _), t in zip(texts, tokens):
            for k in range(len(t) - SHARED + 1):
                owners.setdefault(tuple(t[k : k + SHARED]), set()).add(i)
        at, starts = pad, []
        for n, t in enumerate(tokens):
            own = np.array([self.term[w] for w in t], dtype=np.int32)
            for k in range(len(t) - SHARED + 1):
                if len(owners[tuple(t[k : k + SHARED])]) > 1:
                    own[k : k + SHARED] = -2
            self.ref[at : at + len(t)] = own
            self.owner[at : at + len(t)] = n
            sound = np.convolve(own >= 0, np.ones(SEED, int), "valid") == SEED if len(t) >= SEED else np.zeros(0, bool)
            starts.append(at + np.flatnonzero(sound))
            at += len(t) + pad
        self.starts = np.concatenate(starts).astype(np.int64) if starts else np.zeros(0, np.int64)

    def anchored(self, frequency: np.ndarray) -> "Passages":
        """With the rarest term of each phrase as its anchor, phrases in the order of their anchors."""
        phrases = self.ref[self.starts[:, None] + np.arange(SEED)]
        rarity = np.lexsort((phrases, frequency[phrases]), axis=1) if len(phrases) else np.zeros((0, SEED), int)
        anchor = phrases[np.arange(len(phrases)), rarity[:, 0]] if len(phrases) else np.zeros(0, int)
        order = np.argsort(anchor, kind="stable")
        self.starts, self.phrases, self.rarity = self.starts[order], phrases[order], rarity[order]
        self.first = np.searchsorted(anchor[order], np.arange(len(self.term) + 1))
        return self


def index(docs: DataFrame, term_of: object, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, terms array<int>, positions array<int>) of each document that holds any term, in text order."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = term_of.value.get
        for batch in batches:
            ids, terms, places = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text or i is None:
                    continue
                found = [(t, p) for p, w in enumerate(words(text)) if (t := get(w)) is not None]
                if len(found) >= SEED:
                    ids.append(i)
                    terms.append([t for t, _ in found])
                    places.append([p for _, p in found])
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(terms, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int32()))], names=["id", "terms", "positions"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, terms array<int>, positions array<int>")


def frequencies(postings: DataFrame, terms: int) -> np.ndarray:
    """Occurrences of each term in the corpus; as many numbers as the evaluation set has words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(terms, np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=terms)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(n[seen])], names=["term", "n"])

    out = np.zeros(terms, np.int64)
    for r in postings.select("terms").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out


def _edits(ref: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Row by row: least edit distance of the first 1, 2, ... words of ref to any stretch of doc."""
    row = np.zeros((len(doc), doc.shape[1] + 1), np.int16)
    steps = np.arange(doc.shape[1] + 1, dtype=np.int16)
    out = np.empty(ref.shape, np.int16)
    for i in range(ref.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (doc != ref[:, i, None]), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
        out[:, i] = row.min(axis=1)
    return out


def _matches(p: Passages, ids: list, terms: list, places: list) -> Iterator[tuple]:
    """(document, item, first word of the reference, whether on one diagonal) for each document and item."""
    gap = 2 * LENGTHS[-1]
    lengths = np.array([x[-1] + 1 for x in places])
    base = np.concatenate([[gap], gap + np.cumsum(lengths + gap)])
    dense = np.full(base[-1] + gap, -1, np.int32)
    where = np.concatenate([np.asarray(x) + b for x, b in zip(places, base)])
    what = np.concatenate(terms)
    dense[where] = what
    document = np.repeat(np.arange(len(ids)), [len(x) for x in places])
    order = np.argsort(what, kind="stable")  # the inverted lists, one after the other
    what, where, document = what[order], where[order], document[order]
    many = p.first[what + 1] - p.first[what]
    keep = many > 0
    what, where, document, many = what[keep], where[keep], document[keep], many[keep]
    hits: list[np.ndarray] = []
    ends = np.cumsum(many)
    low = 0
    while low < len(many):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + 2_000_000)))
        n = many[low:high]
        phrase = np.repeat(p.first[what[low:high]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = np.repeat(where[low:high], n) - p.rarity[phrase, 0]
        doc = np.repeat(document[low:high], n)
        for k in range(1, SEED):
            offset = p.rarity[phrase, k]
            same = dense[start + offset] == p.phrases[phrase, offset]
            phrase, start, doc = phrase[same], start[same], doc[same]
        hits.append(np.stack([doc, p.owner[p.starts[phrase]], p.starts[phrase], start]))
        low = high
    if not hits:
        return
    doc, item, ref_at, doc_at = np.concatenate(hits, axis=1)
    # one hit for each document, item, diagonal and stretch of SEED words
    _, once = np.unique(np.stack([doc, item, ref_at - doc_at, ref_at // SEED]), axis=1, return_index=True)
    done: set[tuple[int, int]] = set()
    # another phrase of the same stretch may stand for the one inside the passage
    side = np.arange(-LENGTHS[-1], LENGTHS[-1] + SEED)
    for part in np.array_split(once, max(1, len(once) // 10_000)):
        r, d = ref_at[part, None] + side, doc_at[part, None] + side
        want = p.ref[r]
        inside = (want >= 0) & (p.owner[r] == item[part, None])
        exact = inside & (dense[d] == want)
        near = exact.copy()
        for s in range(1, _SHIFT + 1):
            near |= inside & ((dense[d - s] == want) | (dense[d + s] == want))
        # a window holds words of this item alone, none of them shared with others
        sums = [np.pad(np.cumsum(m, axis=1, dtype=np.int16), ((0, 0), (1, 0))) for m in (inside, exact, near)]
        on_one = np.zeros(len(r), bool)
        close = np.zeros((len(LENGTHS), *r.shape), bool)
        for n, own in zip(LENGTHS, close):
            whole, same, by = (c[:, n:] - c[:, :-n] for c in sums)
            k = whole.shape[1]
            ends = lambda m: m[:, :k] & m[:, n - 1 :]  # noqa: B023, E731
            on_one |= ((whole == n) & (same >= n - n // 8) & ends(exact)).any(axis=1)
            own[:, :k] = (whole == n) & (by >= n - n // 8) & ends(near)
        for k in np.flatnonzero(on_one):
            key = (int(doc[part[k]]), int(item[part[k]]))
            if key not in done:
                done.add(key)
                yield ids[key[0]], int(p.item[key[1]]), True
        row, at = np.nonzero(close.any(axis=0) & ~on_one[:, None])
        for low in range(0, len(row), 4096):
            k, w = row[low : low + 4096], at[low : low + 4096]
            left = np.array([(int(doc[x]), int(item[x])) not in done for x in part[k]], bool)
            k, w = k[left], w[left]
            if not len(k):
                continue
            # beyond the window nothing counts: close has no window there
            refs = p.ref[np.minimum(r[k, w, None] + np.arange(LENGTHS[-1]), len(p.ref) - 1)]
            spots = np.clip(d[k, w, None] + np.arange(-_SHIFT, LENGTHS[-1] + _SHIFT), 0, len(dense) - 1)
            least = _edits(refs, dense[spots])
            for n, own in zip(LENGTHS, close):
                for x in k[own[k, w] & (least[:, n - 1] <= n // 8)]:
                    key = (int(doc[part[x]]), int(item[part[x]]))
                    if key not in done:
                        done.add(key)
                        yield ids[key[0]], int(p.item[key[1]]), False


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", passage_col: str = "reference") -> DataFrame:
    """(id_col, item_col, exact) of each document and each item that it leaks; exact: on one diagonal."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, {item_col} bigint, exact boolean"
    sets = items.select(F.col(item_col).cast("bigint"), passage_col)
    n, size = sets.agg(F.count("*"), F.coalesce(F.sum(F.char_length(passage_col)), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK), -(-size // BLOCK_CHARS))
    out = spark.createDataFrame([], schema)
    for b in range(blocks):
        own = sets if blocks == 1 else sets.filter(F.pmod(F.xxhash64(item_col), F.lit(blocks)) == b)
        p = Passages([(r[0], r[1]) for r in own.collect()])
        if not len(p.starts):
            continue
        postings = written(index(docs, spark.sparkContext.broadcast(p.term), id_col, text_col), "postings")
        shared = spark.sparkContext.broadcast(p.anchored(frequencies(postings, len(p.term))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    lists = [[x.values.to_numpy(zero_copy_only=False) for x in part.column(c)] for c in (1, 2)]
                    rows = list(_matches(shared.value, part.column(0).to_pylist(), *lists)) if part.num_rows else []
                    ids, found, exact = zip(*rows) if rows else ((), (), ())
                    yield pa.RecordBatch.from_arrays([pa.array(ids, part.schema.field(0).type), pa.array(found, pa.int64()), pa.array(exact, pa.bool_())], names=[id_col, item_col, "exact"])

        out = out.unionByName(postings.mapInArrow(run, schema))
    # two items of different blocks are two rows; the same item is in one block alone
    return out
