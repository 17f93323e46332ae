"""Problem 1: answers that don't answer their question.

Each block is taken apart once: white space and markup around the answer, a repeat of the question, a leading
"Name:". What is left is checked in this order, and the first finding is the block's defect:

empty           nothing is left that says something (null, stand-ins such as "N/A", markup without text)
copied_question nothing but the question, once or more, with or without a word such as "Question:" before it
refusal         every clause of the answer belongs to a template (below)
other_language  the answer's sentences are in another language than the question (the naive Bayes of language.py)
truncated       breaks off: no final mark, an open fence, bracket or code span. A bare value, name, list or command is whole

No phrases are given for refusals; they are found by what recurs. The opening is the answer's first clause; an opening with figures
or settings is none, and bare values and lists and answers of fewer than LEAST_WORDS words have none ("No comment." alone can't be told from
"Every hour."). Openings are counted by distinct questions, and clustered by MinHash over shingles of five words, verified at a Jaccard
similarity of SIMILAR: in each band an opening joins every cluster whose leader is similar, or leads one itself. A cluster is a template if
it answers RECURS or more different questions and no more than a SHARED-th of them have a longer word in common with the
opening (a sound stock answer speaks of what was asked, a refusal doesn't). An opening belongs to a template as well if both are the same run of
at least LEAST_WORDS words but for up to BESIDE others before and after it, no more than it has ("Regrettably ...", "..., and I won't guess"). An answer with such an opening is a
refusal if all its other clauses recur as well, in the answers with such openings; one that goes on with anything
of its own is not, so a sound stock opening ("It depends on your version.") before an answer makes no refusal.

Rows delivered again give the same block_id once. A null question can't be compared: its answer is only checked for
empty, refusal and truncated. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import language
from corpusloom.llm.survivor import STAND_INS
from corpusloom.llm.words import INVISIBLE, words

SHINGLE, SIMILAR, BANDS, ROWS = 5, 0.8, 16, 4
RECURS, SHARED, BESIDE, LEAST_WORDS = 2, 4, 6, 4
#: Settings, figures and code name no language.
_CODE = re.compile(r"`[^`]*`|[!-~]*[0-9_][!-~]*")
_EDGE = " \t\r\n　\xa0​*_\"'“”„«»「」『』‘’`>#~"
_NAME = re.compile(r"^[^\n:：.!?。]{1,48}[:：][ \t　]*(?=\S)|^关于[^\n，。]{1,48}，")
_LABEL = re.compile(r"^[\s\W_]*(?:[^\W\d_]+[ ]?){1,4}[:：\-–—]")
_ALNUM = re.compile(r"[\W_]+")
_LONG = re.compile(r"[^\W\d_㐀-鿿]{5,}")
_SETTING = re.compile(r"[\d_`=]|\w\.\w")
_CLAUSE = re.compile(r"[.!?;]+(?=\s|$)|[。！？；\n]+")
_FINAL = re.compile(r"[.!?。！？][\s\"'”’»」』）)\]*_~​]*$")
_BROKEN = re.compile(r"(?:…|\.\.\.)[\s\"'”’»」』）)\]*_]*$")
_BARE = [
    re.compile(r"`[^`\n]+`|```[^\n]*\n.*\n?```", re.S),
    re.compile(r"(?:[-*•+]|\d+[.)])[ \t]+[^\n.!?。！？]{1,60}(?:\n(?:[-*•+]|\d+[.)])[ \t]+[^\n.!?。！？]{1,60})+"),
    re.compile(r"`?[\w.\-/]+`?[ \t]*[=:][ \t]*\S+"),
    re.compile(r"[\d.,:/\-]+[ \t]*[^\W\d_]*(?:[ \t][^\W\d_]+)?", re.U),
    re.compile(r"(?:\|[^\n]*\|\s*)+"),
    re.compile(r"[!-~]{1,60}|[^\s，。、；：！？…]{1,10}"),
]


def _flat(s: str) -> str:
    return _ALNUM.sub("", INVISIBLE.sub("", s).casefold())


def _end_of(flat: str, answer: str, start: int) -> int | None:
    """Where the answer has said `flat` from `start` on, marks and white space aside; None if it says something else."""
    seen = 0
    for k in range(start, len(answer)):
        for ch in answer[k].casefold():
            if ch == "_" or not ch.isalnum():
                continue
            if ch != flat[seen]:
                return None
            seen += 1
            if seen == len(flat):
                return k + 1
    return None


def _after_question(question: str, answer: str) -> tuple[str, bool]:
    """The answer without repeats of the question at its start, and whether there were any.

    The question may have other case, marks and white space, and a label such as "Question:" before it. It must be followed by
    something other than a letter or a figure of the same word.
    """
    flat = _flat(question)
    found = False
    while flat:
        label = _LABEL.match(answer)
        for start in (0, label.end()) if label else (0,):
            at = _end_of(flat, answer, start)
            if at is not None and not (at < len(answer) and answer[at].isascii() and answer[at].isalnum()):
                break
        else:
            break
        answer, found = answer[at:].lstrip("?？.。!！" + _EDGE), True
    return answer, found


def _bare(s: str) -> bool:
    return any(p.fullmatch(s) for p in _BARE)


def _truncated(answer: str) -> bool:
    s = answer.strip(" \t\r\n　\xa0​")
    if _bare(s):
        return False
    if s.count("```") % 2:
        return True
    outside = re.sub(r"```.*?```", "", s, flags=re.S)
    if outside.count("`") % 2:
        return True
    if s.endswith("```") or s.endswith("|"):
        return False
    if _BROKEN.search(s):
        return True
    if not _FINAL.search(s):
        return not _bare(s.split("\n\n")[-1].strip()) if "\n\n" in s else True
    return False


def _clauses(rest: str) -> list[str]:
    """The clauses of an answer that may be a template, in words(): none if its first one has figures or settings, or if it is a bare value."""
    named = _NAME.sub("", rest, count=1)
    parts = [c for c in _CLAUSE.split(named) if c.strip(_EDGE)]
    if not parts or _SETTING.search(parts[0]) or _bare(named.strip()):
        return []
    out = [w for c in parts if (w := words(c.replace("’", "'")))]
    return [" ".join(w) for w in out] if sum(map(len, out)) >= LEAST_WORDS else []


def _long(s: str) -> set[str]:
    """Longer words, and Han characters by twos."""
    s = s.casefold()
    return set(_LONG.findall(s)) | {a + b for a, b in zip(s, s[1:]) if "\u3400" <= a <= "\u9fff" and "\u3400" <= b <= "\u9fff"}


def examine(question: str | None, answer: str | None) -> tuple[str | None, list[str], str]:
    """(defect that needs no other row, clauses, what is left of the answer)."""
    text = INVISIBLE.sub("", answer or "")
    core = re.sub(r"</?[A-Za-z][^<>]{0,100}>", "", text).strip(_EDGE)
    if _flat(core) in STAND_INS:
        return "empty", [], ""
    rest, copied = _after_question(question, core) if question else (core, False)
    if copied and not _flat(rest):
        return "copied_question", [], ""
    if copied and _flat(rest) in STAND_INS:
        return "empty", [], ""
    return ("truncated" if _truncated(text) else None), _clauses(rest), rest


def _signature(w: list[str]) -> np.ndarray:
    """Bands of a MinHash over the shingles."""
    h = np.array([hash_of(s) for s in shingles(w)], np.uint64)
    mixed = h[:, None] * _A[None, :] + _B[None, :]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x94D049BB133111EB)
    least = mixed.min(axis=0).reshape(BANDS, ROWS)
    band = least[:, 0].copy()
    for k in range(1, ROWS):
        band = band * np.uint64(0x9E3779B97F4A7C15) + least[:, k]
    return band.view(np.int64)


_R = np.random.RandomState(7)
_A = _R.randint(1, 2**62, BANDS * ROWS).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_B = _R.randint(0, 2**62, BANDS * ROWS).astype(np.uint64)


def shingles(w: list[str]) -> list[str]:
    return [" ".join(w[k : k + SHINGLE]) for k in range(len(w) - SHINGLE + 1)] or [" ".join(w)]


def hash_of(s: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s)


def examined(blocks: DataFrame, model: language.Model) -> DataFrame:
    """(block_id, defect, clauses, question, shares): one row for each delivery, before openings are compared. shares: the opening has a longer word of the question."""
    shared = blocks.sparkSession.sparkContext.broadcast(model.log)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = language.Model(shared.value)
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                part = batch.slice(low, 2000)
                questions, answers = (part.column(k).to_pylist() for k in (1, 2))
                found = [examine(q, a) for q, a in zip(questions, answers)]
                defects = [d for d, _, _ in found]
                # language: only of answers that hold a sentence
                ask, asked, rests = [], [], []
                for k, (d, _, rest) in enumerate(found):
                    if d in (None, "truncated") and questions[k] and not _bare(rest.strip()) and not _bare(answers[k].strip()):
                        s = _NAME.sub("", rest, count=1)
                        s = _CODE.sub(" ", s)
                        if len(language.LETTERS.findall(s)) >= 4 or len(language.HAN.findall(s)) >= 5:
                            ask.append(k)
                            asked.append(_CODE.sub(" ", questions[k]))
                            rests.append(s)
                for k, (ql, _, qd), (al, ap, ad) in zip(ask, m.decide(asked), m.decide(rests)):
                    if ql != al and qd > language.LEAD and ad > language.LEAD and ap > language.SURE:
                        defects[k] = "other_language"
                keys = [hash_of(_flat(q)) - (1 << 63) if q and c else None for q, (_, c, _) in zip(questions, found)]
                shares = [bool(_long(q) & _long(c[0].replace(" ", "") if language.HAN.search(c[0]) else c[0])) if q and c else None for q, (_, c, _) in zip(questions, found)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(defects, pa.string()), pa.array([c or None for _, c, _ in found], pa.list_(pa.string())), pa.array(keys, pa.int64()), pa.array(shares, pa.bool_())],
                    names=["block_id", "defect", "clauses", "question", "shares"],
                )

    return blocks.select("block_id", "critical_question", "trusted_answer").mapInArrow(run, "block_id string, defect string, clauses array<string>, question bigint, shares boolean")


def similar_pairs(openings: DataFrame) -> DataFrame:
    """(leader, opening) of distinct openings: in each MinHash band, those whose verified similarity to a leader is SIMILAR or more.

    Within a band the openings come in order; one that is similar to no leader so far leads. Memory holds the leaders of one band.
    """

    def bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                texts = batch.column(0).slice(at, 5000).to_pylist()
                keys = np.concatenate([_signature(t.split(" ")) for t in texts])
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(texts))), pa.array(keys), pa.array(np.repeat(texts, BANDS).tolist(), pa.string())], names=["band", "key", "opening"])

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leaders = None, []
        for batch in batches:
            out: list[tuple[str, str]] = []
            for band, key, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if (band, key) != last:
                    last, leaders = (band, key), []
                own = set(shingles(text.split(" ")))
                near = [t for t, s in leaders if len(own & s) >= SIMILAR * len(own | s)]
                out += [(t, text) for t in near]
                if not near:
                    leaders.append((text, own))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.string()), pa.array([b for _, b in out], pa.string())], names=["leader", "opening"])

    banded = openings.select("opening").mapInArrow(bands, "band int, key bigint, opening string")
    return banded.repartition("band", "key").sortWithinPartitions("band", "key", "opening").mapInArrow(lead, "leader string, opening string").distinct()


def _within(openings: DataFrame, whole: DataFrame) -> DataFrame:
    """(opening) of those that share with one of `whole` a run of words that is at least half of each. Both have one column, opening."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, parts = [], []
            for text in batch.column(0).to_pylist():
                w = text.split(" ")
                for i in range(min(BESIDE, len(w)) + 1):
                    for j in range(min(BESIDE, len(w) - i) + 1):
                        if len(w) - i - j >= max(LEAST_WORDS, len(w) / 2):
                            texts.append(text)
                            parts.append(" ".join(w[i : len(w) - j]))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), pa.array(parts, pa.string())], names=["opening", "part"])

    parts = lambda df: df.mapInArrow(cut, "opening string, part string")
    return parts(openings).join(parts(whole).select("part").distinct(), "part", "left_semi").select("opening").distinct()


def templates(rows: DataFrame) -> DataFrame:
    """(opening) of every template and of the openings that belong to one."""
    from corpusloom.plans.lineage import written

    asked = rows.filter("clauses is not null and question is not null").select(F.col("clauses")[0].alias("opening"), "question", F.col("shares").cast("int").alias("shares"))
    support = written(asked.groupBy("opening", "question").agg(F.max("shares").alias("shares")).groupBy("opening").agg(F.count("*").alias("n"), F.sum("shares").alias("shares")), "openings")
    member = similar_pairs(support).join(support, "opening").select("leader", "opening", "n", "shares").unionByName(support.select(F.col("opening").alias("leader"), "opening", "n", "shares"))
    strong = member.groupBy("leader").agg(F.sum("n").alias("n"), F.sum("shares").alias("shares")).filter((F.col("n") >= RECURS) & (F.col("shares") * SHARED <= F.col("n"))).select("leader")
    found = written(member.join(strong, "leader", "left_semi").select("opening").distinct(), "templates")
    openings = rows.filter("clauses is not null").select(F.col("clauses")[0].alias("opening")).distinct()
    return found.unionByName(_within(openings.join(found, "opening", "left_anti"), found))


def refusals(rows: DataFrame) -> DataFrame:
    """(block_id) of the answers all of whose clauses recur, beginning with a template."""
    from corpusloom.plans.lineage import written

    whole = written(templates(rows), "templates")
    opened = rows.filter("clauses is not null").select("block_id", "question", "clauses", F.col("clauses")[0].alias("opening")).join(whole, "opening", "left_semi")
    later = written(opened.select("block_id", "question", F.explode(F.slice("clauses", 2, F.greatest(F.lit(1), F.size("clauses")))).alias("opening")), "clauses")
    recurring = later.filter("question is not null").select("opening", "question").distinct().groupBy("opening").agg(F.count("*").alias("n")).filter(F.col("n") >= RECURS).select("opening")
    known = written(recurring.unionByName(whole).distinct(), "recurring")
    other = later.select("opening").distinct().join(known, "opening", "left_anti")
    own = later.join(other.join(_within(other, known), "opening", "left_anti"), "opening", "left_semi").select("block_id").distinct()
    return opened.select("block_id").distinct().join(own, "block_id", "left_anti")


def defects(blocks: DataFrame, model: language.Model) -> DataFrame:
    """(block_id, defect) of each defective block."""
    from corpusloom.plans.lineage import written

    rows = written(examined(blocks, model), "examined")
    refused = refusals(rows).select("block_id", F.lit("refusal").alias("defect"), F.lit(0).alias("o"))
    known = rows.filter("defect is not null").select("block_id", "defect", F.lit(1).alias("o")).unionByName(refused)
    return known.groupBy("block_id").agg(F.min(F.struct("o", "defect")).alias("d")).select("block_id", "d.defect")
