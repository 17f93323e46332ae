import numpy as np

from corpusloom.llm import neighbours as N

SCHEMA = "block_id string, embedding array<float>, score double"


def vectors(groups, size, noise=0.02, seed=0):
    r = np.random.RandomState(seed)
    out = []
    for g in range(groups):
        c = r.randn(N.DIMENSIONS)
        c /= np.linalg.norm(c)
        out += [c + r.randn(N.DIMENSIONS) * noise for _ in range(size)]
    return np.array(out)


def exact(m, k):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL", 300)
    m = vectors(200, 12)
    df = spark.createDataFrame([(f"{i:05}", v.tolist(), 0.0) for i, v in enumerate(m)], SCHEMA)
    got = {}
    for r in N.nearest(df, 5).collect():
        got.setdefault(int(r.id), set()).add(int(r.neighbour))
    want = exact(m, 5)
    recall = np.mean([len(got[i] & set(want[i].tolist())) / 5 for i in range(len(m))])
    assert recall >= 0.9 and all(len(v) == 5 and i not in v for i, v in got.items())


def test_hot_cell_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_MOST", 50)
    m = vectors(40, 10)
    df = spark.createDataFrame([(f"{i:05}", v.tolist(), 0.0) for i, v in enumerate(m)], SCHEMA)
    got = {}
    for r in N.nearest(df, 5).collect():
        got.setdefault(int(r.id), set()).add(int(r.neighbour))
    want = exact(m, 5)
    assert np.mean([len(got[i] & set(want[i].tolist())) / 5 for i in range(len(m))]) >= 0.97


def test_dirty_rows_copies_and_ties(spark):
    a, b = vectors(1, 1)[0].tolist(), vectors(1, 1, seed=5)[0].tolist()
    nan, zero, short = [float("nan"), *a[1:]], [0.0] * N.DIMENSIONS, a[:50]
    rows = [("a1", a), ("a1", a), ("a2", a), ("a3", [2 * x for x in a]), ("b", b), ("n", nan), ("z", zero), ("s", short), ("0", None), ("e", []), (None, a)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], SCHEMA)
    got = {(r.id, r.place): (r.neighbour, round(r.score, 4)) for r in N.nearest(df, 2).collect()}
    assert {i for i, _ in got} == {"a1", "a2", "a3", "b"}
    assert got["a1", 1] == ("a2", 1.0) and got["a1", 2] == ("a3", 1.0) and got["a2", 1] == ("a1", 1.0) and got["b", 1][0] == "a1"


def test_many_copies(spark):
    a, b = vectors(1, 1)[0].tolist(), vectors(1, 1, seed=5)[0].tolist()
    df = spark.createDataFrame([(f"{i:03}", a, 0.0) for i in range(60)] + [("x", b, 0.0)], SCHEMA)
    rows = N.nearest(df, 5).collect()
    assert len(rows) == 61 * 5
    assert sorted(r.neighbour for r in rows if r.id == "030") == ["000", "001", "002", "003", "004"]
    assert sorted(r.neighbour for r in rows if r.id == "000") == ["001", "002", "003", "004", "005"]


def test_empty_and_single(spark):
    df = spark.createDataFrame([("a", vectors(1, 1)[0].tolist(), 0.0)], SCHEMA)
    assert N.nearest(df.limit(0), 5).count() == 0
    assert N.nearest(df, 5).count() == 0


def test_one_direction_is_a_tie(spark):
    """Vectors that differ by their length alone have a cosine of exactly 1 and come in the order of their ids."""
    m = vectors(40, 1, seed=3)
    df = spark.createDataFrame([(f"{i:02}{c}", (f * v).tolist(), 0.0) for i, v in enumerate(m) for c, f in zip("abcd", (1, 2, 4, 8))], SCHEMA)
    got = {(r.id, r.place): (r.neighbour, r.score) for r in N.nearest(df, 3).collect()}
    assert got == {(f"{i:02}{c}", n + 1): (f"{i:02}{o}", 1.0) for i in range(40) for c in "abcd" for n, o in enumerate(x for x in "abcd" if x != c)}
