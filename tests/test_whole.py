"""Operators that once did less than the whole job."""

import os
import random

import numpy as np
import pytest

from corpusloom import catalog
from corpusloom.operators import embedding, merge, similarity

FOLDER = "/root/testdata/sf0.1"
QUERIES = catalog.load()[0]


def test_distill_joins_exactly_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(merge, "EXACT_UP_TO", 0, raising=False)
    r = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    rows = [(f"b{i:03}", "", "", " ".join(r.choices(words, k=8))) for i in range(250)]
    b = spark.createDataFrame(rows, "block_id string, name string, critical_question string, trusted_answer string")
    text = embedding.embedding_text(b["name"], b["critical_question"], b["trusted_answer"])
    m = np.array([x.vector for x in embedding.dense(b, "block_id", text, 128).collect()])
    want = int((np.triu(np.round(m @ m.T, 6), 1) >= 0.3).sum())
    _, figures = merge.distill(b, start=0.3, rounds=1)
    assert want > 500 and figures[0]["edges"] == want


def test_pairs_above_with_larger_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 4)
    monkeypatch.setattr(similarity, "WIDE", 16)
    r = np.random.RandomState(1)
    m = r.randn(200, 6)
    m /= np.linalg.norm(m, axis=1)[:, None]
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "block_id long, vector array<double>")
    want = set(zip(*(x.tolist() for x in np.nonzero(np.triu(np.round(m @ m.T, 6), 1) >= 0.5))))
    assert {(x.a, x.b) for x in similarity.pairs_above(v, 0.5).collect()} == want


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_op54_recall(spark):
    want = {(r.a, r.b): r.score for r in QUERIES["op52_pairs_above"](spark, FOLDER).collect()}
    got = {(r.a, r.b): r.score for r in QUERIES["op54_hyperplane_pairs"](spark, FOLDER).collect()}
    assert set(got) <= set(want) and all(abs(want[k] - s) < 2e-6 for k, s in got.items())
    assert len(want) > 500 and len(got) >= 0.99 * len(want)


def test_hyperplane_pairs_are_the_verified_candidates(spark):
    r = np.random.RandomState(7)
    m = r.randn(150, 8)
    m /= np.linalg.norm(m, axis=1)[:, None]
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "block_id long, vector array<double>")
    tables = similarity.tables_for(0.6, 0.9)
    assert similarity.theoretical_recall(0.6, tables=tables) >= 0.9 > similarity.theoretical_recall(0.6, tables=tables - 1)
    want = similarity.verified(similarity.candidates(v, 8, tables=tables), v, 0.6).collect()
    assert sorted(map(tuple, similarity.hyperplane_pairs(v, 8, 0.6, 0.9).collect())) == sorted(map(tuple, want))


def test_traps_behind_many_equal_answers(spark, tmp_path):
    near = [(i, [1.0, i / 1e5], "same") for i in range(600)]
    far = [(600, [0.6, 0.8], "other"), (601, [0.5, 0.8], "third"), (602, [0.4, 0.8], "other"), (603, [1.0, 0.0], None)]
    spark.createDataFrame(near + far, "vec_id long, embedding array<double>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.target, r.place): r.donor for r in QUERIES["op136_traps"](spark, str(tmp_path)).collect()}
    assert {got[t, p] for t in range(0, 600, 20) for p in (1,)} == {600} and {got[t, 2] for t in range(0, 600, 20)} == {601}
    assert (got[600, 1], got[600, 2]) == (601, 599)


def test_merge_coercion_unwraps_and_clamps(spark):
    fields = "struct<name: string, trusted_answer: string, tags: array<string>>"
    rows = [
        (1, None, None, "own", "an answer", ["faq"], 1.5),
        (2, ("inner", "an answer", [" api ", "API"]), ("second", "no", []), None, None, None, -0.5),
        (3, None, ("merged", "x" * 501, []), "own", "an answer", [], None),
        (4, (None, "an answer", []), None, "own", "an answer", [], 0.25),
    ]
    d = spark.createDataFrame(rows, f"record_id long, block {fields}, merged {fields}, name string, trusted_answer string, tags array<string>, confidence double")
    got = {r.record_id: (r.name, r.tags, r.error, r.confidence) for r in merge.coerced(d).collect()}
    assert got == {1: ("own", ["FAQ"], None, 1.0), 2: ("inner", ["API"], None, 0.0), 3: ("merged", [], "answer too long", None), 4: (None, [], "missing name", 0.25)}
