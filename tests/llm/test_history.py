import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import history as H
from corpusloom.llm.words import words

@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(H, "BUCKETS", 3)


VOCABULARY = [f"{a}{b}" for a in ("bel", "dor", "fin", "gal", "hul", "jin", "kor", "lem", "mar", "nop") for b in ("a", "ek", "is", "on", "um", "yx")]


def corpus(n=160, seed=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        if out and r.random() < 0.45:
            w = out[r.randrange(len(out))].split()
            for _ in range(r.randrange(0, 1 + len(w) // 3)):
                k, what = r.randrange(len(w)), r.random()
                if what < 0.5:
                    w[k] = r.choice(VOCABULARY)
                elif what < 0.75 and len(w) > 3:
                    del w[k]
                else:
                    w.insert(k, r.choice(VOCABULARY))
            r.shuffle(w) if r.random() < 0.3 else None
            out.append(" ".join(w))
        else:
            out.append(" ".join(r.choice(VOCABULARY) for _ in range(r.randrange(3, 60))))
    return out


def brute(texts):
    bags = [Counter(words(t or "")) for t in texts]
    size = [sum(b.values()) for b in bags]
    out = set()
    for j in range(len(texts)):
        for i in range(j):
            m = max(size[i], size[j])
            if size[i] and size[j] and m - sum((bags[i] & bags[j]).values()) <= int(H.SHARE * m + 1e-9):
                out.add((i, j))
                break
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "arrival_id long, body string, n int")


def got(df):
    return {(r.first_id, r.later_id) for r in df.collect()}


def test_against_brute_force(spark):
    texts = corpus()
    assert got(H.had_before(frame(spark, enumerate(texts)), "arrival_id", "body", H.body_content, 3)) == brute(texts)


def test_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(H, "HOT", 10)
    texts = corpus(120, 3)
    assert got(H.had_before(frame(spark, enumerate(texts)), "arrival_id", "body", H.body_content, 1)) == brute(texts)


def test_batches_give_the_same(spark, tmp_path):
    texts = corpus(120, 1)
    store = H.History(spark, str(tmp_path), H.body_content, 2)
    found = set()
    for low in range(0, len(texts), 40):
        found |= got(store.ingest(frame(spark, [(i, texts[i]) for i in range(low, min(low + 40, len(texts)))]), "arrival_id", "body"))
    assert found == brute(texts)


def _store(spark, folder, **more):
    return H.History(spark, str(folder), H.body_content, 1, **more)


def test_hot_words_become_parted_later(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "HOT", 15)
    texts = corpus(120, 5)
    store, found = _store(spark, tmp_path), set()
    for n, (low, high) in enumerate(((0, 12), (12, 80), (80, 120))):
        found |= got(store.ingest(frame(spark, [(i, texts[i]) for i in range(low, high)]), "arrival_id", "body", n))
    assert found == brute(texts)
    parts = {r.batch: r.most for r in store.stored("postings", [0, 1, 2]).groupBy("batch").agg(F.max("part").alias("most")).collect()}
    assert parts[0] < parts[2]


def test_batches_are_whole(spark, tmp_path, monkeypatch):
    texts = corpus(90, 6)
    rows = lambda low, high: frame(spark, [(i, texts[i]) for i in range(low, high)])
    store = _store(spark, tmp_path)
    found = got(store.ingest(rows(0, 30), "arrival_id", "body", 4))
    with monkeypatch.context() as m:  # the last write of a batch fails
        m.setattr(H.History, "_save", lambda *a: 1 / 0)
        try:
            store.ingest(rows(30, 60), "arrival_id", "body", 5)
        except ZeroDivisionError:
            pass
    assert store.accepted() == [4]
    again = _store(spark, tmp_path)  # another session, with other rows under that number
    found |= got(again.ingest(rows(30, 50), "arrival_id", "body", 5)) | got(again.ingest(rows(50, 90), "arrival_id", "body"))
    assert found == brute(texts) and again.accepted() == [4, 5, 6]
    try:
        again.ingest(rows(0, 1), "arrival_id", "body", 6)
        raise AssertionError
    except ValueError:
        pass


def test_a_small_batch_reads_little_of_the_history(spark, tmp_path, monkeypatch):
    """What a batch of two rows reads of the stored postings doesn't grow with the history."""
    monkeypatch.setattr(H, "PAGE", 50)
    read = []
    whole = H.History._asked

    def counted(self, rows, column, stored):
        out = whole(self, rows, column, stored)
        if column == "key":
            frame_ = out._jdf.queryExecution()
            out.write.format("noop").mode("overwrite").save()
            frame_.executedPlan().executeCollect()
            plan, scans = frame_.executedPlan(), []
            todo = [plan]
            while todo:
                p = todo.pop()
                if p.getClass().getSimpleName() == "FileSourceScanExec":
                    scans.append(p.metrics().apply("numOutputRows").value())
                todo += [p.children().apply(k) for k in range(p.children().length())]
            read.append(sum(scans))
        return out

    for n in (1500, 6000):
        r = random.Random(n)
        text = lambda: " ".join(f"{r.choice(VOCABULARY)}{r.randrange(3000)}" for _ in range(12))  # noqa: B023, E731
        store = _store(spark, tmp_path / str(n), buckets=2)
        store.ingest(frame(spark, [(i, text()) for i in range(n)]), "arrival_id", "body")
        with monkeypatch.context() as m:
            m.setattr(H.History, "_asked", counted)
            store.ingest(frame(spark, [(n, text()), (n + 1, text())]), "arrival_id", "body")
    assert read[0] < 1000 and read[1] < 1.5 * read[0] + 100


def test_what_does_not_count(spark):
    a = "The nightly crew moves the **shared** index, then it rests. Zelha keeps 42 pages."
    b = "zelha keeps 42 pages!\n\nThe nightly crew   moves the shared index; then it rests"
    rows = [(1, a), (2, b), (3, None), (4, ""), (5, " \n"), (6, "?!"), (7, "?!"), (9, a), (8, "汉字可以一个一个地数"), (10, "汉字可以一个一个地算")]
    assert got(H.had_before(frame(spark, rows), "arrival_id", "body", H.body_content, 1)) == {(1, 2), (1, 9), (8, 10)}


def test_many_copies_and_long_texts(spark):
    rows = [(i, "same words in every one of these rows") for i in range(200)] + [(900, "long " * 30_000), (901, "long " * 29_000)]
    assert got(H.had_before(frame(spark, rows), "arrival_id", "body", H.body_content, 1)) == {(0, i) for i in range(1, 200)} | {(900, 901)}


def test_blocks():
    block = {"critical_question": "Q?", "trusted_answer": "A."}
    assert H.block_content(json.dumps(block)) == H.block_content(json.dumps({"block": block}, indent=1)) == "Q?\nA."
    for bad in ("{", "[]", "null", "{}", '{"block": 3}', '{"trusted_answer": null}', '{"trusted_answer": " "}', '{"trusted_answer": 5}'):
        assert H.block_content(bad) is None
    assert H.block_content('{"critical_question": null, "trusted_answer": "A"}') == "\nA"


def test_empty(spark):
    assert H.had_before(frame(spark, []), "arrival_id", "body", H.body_content, 1).count() == 0


def test_pairs_of_other_sizes_are_told_apart(spark, tmp_path, monkeypatch):
    """100 words and 85, of which 75 are common: 25 words apart; the sum of the differences is under twice the bound, but not by the 15 that the sizes differ."""
    rows, pairs = [], []
    for i in range(20):
        w = [*(f"t{i}x{k}" for k in range(75)), *(f"g{k}" for k in range(25))]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:75], *(f"h{k}" for k in range(10))]))]
    whole = H.History.near
    monkeypatch.setattr(H.History, "near", lambda *a: pairs.append(whole(*a)) or pairs[-1])
    store = H.History(spark, str(tmp_path), H.body_content, 8)
    assert got(store.ingest(frame(spark, rows), "arrival_id", "body")) == brute([t for _, t in rows]) == set()
    assert pairs[0].count() <= 4


def test_postings_of_a_word_lie_together(spark, tmp_path, monkeypatch):
    texts = corpus(120, 8)
    rows = lambda low, high: frame(spark, [(i, texts[i]) for i in range(low, high)])
    for n, sizes in enumerate(({}, {"PACK": 2, "MADE": 7, "LOOKED": 5, "HOT": 10})):
        for name, size in sizes.items():
            monkeypatch.setattr(H, name, size)
        store = _store(spark, tmp_path / str(n))
        assert got(store.ingest(rows(0, 80), "arrival_id", "body")) | got(store.ingest(rows(80, 120), "arrival_id", "body")) == brute(texts)
        stored = store.stored("postings", [0])
        assert (stored.count() == stored.select("key", "part").distinct().count()) == (n == 0)
