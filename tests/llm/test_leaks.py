import random

from corpusloom.llm import leaks as K

R = random.Random(5)
VOCABULARY = [a + b for a in "bdfgklmnprst" for b in ("alo", "ire", "unde", "ost", "ek")]
STOCK = "the text below was shortened for review and must be read together with the glossary it came from every single day of the year"


def passage(seed, n=60):
    r = random.Random(seed)
    return [f"{r.choice(VOCABULARY)}{r.randrange(40)}" for _ in range(n)]


def found(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    e = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, reference string, query string")
    return {(r.doc_id, r.item_id): r.exact for r in K.leaks(d, e).collect()}


def test_leaks(spark):
    a, b = passage(1), passage(2)
    part = a[10:40]
    changed = list(a[5:35])
    for k in (4, 12, 20):
        changed[k] = "other"
    many = list(a[0:30])
    for k in range(2, 30, 5):
        many[k] = "other"
    dropped = b[3:20] + b[21:34]
    added = b[3:20] + ["more"] + b[20:34]
    docs = [
        (1, "Before. " + " ".join(part).upper().replace(" ", ",\n", 3) + " after"),
        (2, "x " + " ".join(changed) + " y"),
        (3, " ".join(many)),
        (4, " ".join(a[:23])),
        (5, " ".join(a[:24])),
        (6, "z " + " ".join(dropped) + " z"),
        (7, "z " + " ".join(added) + " z"),
        (8, None),
        (9, ""),
        (10, "**" + "​ ".join(b[:30]) + "**"),
        (11, " ".join(a + b)),
        (12, "word " * 50_000),
        (13, STOCK),
        (14, " ".join(part)),
    ]
    items = [(100, " ".join(a)), (200, " ".join(b)), (300, STOCK + " " + " ".join(passage(3))), (400, STOCK + " " + " ".join(passage(4))), (500, None), (600, ""), (100, " ".join(a))]
    got = found(spark, docs, items)
    assert got == {(1, 100): True, (2, 100): True, (5, 100): True, (6, 200): False, (7, 200): False, (10, 200): True, (11, 100): True, (11, 200): True, (14, 100): True}


def test_against_brute_force(spark):
    items = [(i, " ".join(passage(i, 50))) for i in range(8)]
    docs = []
    for n in range(150):
        w = passage(1000 + n, 30)
        if n % 3 == 0:
            i = R.randrange(8)
            low, size = R.randrange(20), R.randrange(18, 34)
            x = items[i][1].split()[low : low + size]
            for _ in range(R.randrange(6)):
                x[R.randrange(len(x))] = "odd"
            w = w[:10] + x + w[10:]
        docs.append((n, " ".join(w)))
    want = set()
    for d, t in docs:
        w = t.split()
        for i, r in items:
            r = r.split()
            for n in range(24, 32):
                for k in range(len(r) - n + 1):
                    for p in range(len(w) - n + 1):
                        if r[k] == w[p] and r[k + n - 1] == w[p + n - 1] and sum(x != y for x, y in zip(r[k : k + n], w[p : p + n])) <= n // 8:
                            want.add((d, i))
    assert {k for k, exact in found(spark, docs, items).items() if exact} == want and want


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 2)
    items = [(i, " ".join(passage(i))) for i in range(5)]
    docs = [(i, " ".join(passage(i)[5:45])) for i in range(5)]
    assert set(found(spark, docs, items)) == {(i, i) for i in range(5)}


def test_empty(spark):
    assert found(spark, [], [(1, " ".join(passage(1)))]) == {} and found(spark, [(1, "a b")], []) == {}


def valid(ref, doc):
    """Whether 24 words or more of ref stand in doc in a row, at most one in eight different, the first and the last the same."""
    for k in range(len(ref)):
        for p in range(len(doc)):
            wrong = 0
            for n in range(1, min(len(ref) - k, len(doc) - p) + 1):
                same = ref[k + n - 1] == doc[p + n - 1]
                wrong += not same
                if n == 1 and not same:
                    break
                if n >= 24 and same and wrong <= n // 8:
                    return True
    return False


def test_passages_of_any_length(spark):
    r = random.Random(8)
    items = [(i, " ".join(passage(i, 90))) for i in range(6)]
    docs = [(0, " ".join("odd" if k in (27, 28, 30, 31, 32) else w for k, w in enumerate(items[0][1].split()[:50]) if k >= 10))]
    docs.append((1, " ".join("odd" if 21 <= k < 27 else w for k, w in enumerate(items[1][1].split()[:48]))))
    for n in range(2, 260):
        i = r.randrange(6)
        size = r.choice([24, 31, 32, 33, 39, 40, 41, 47, 48, 49, 53, 56, 64, 70])
        low = r.randrange(90 - size)
        x = items[i][1].split()[low : low + size]
        middle = r.randrange(2)
        for k in r.sample(range(size // 3, 2 * size // 3) if middle else range(1, size - 1), size // 8 + r.randrange(-1, 2)):
            x[k] = f"odd{k}"
        docs.append((n, " ".join(passage(5000 + n, 6) + x + passage(7000 + n, 6))))
    want = {(d, i) for d, t in docs for i, q in items if valid(q.split(), t.split())}
    got = found(spark, docs, items)
    assert {k for k, exact in got.items() if exact} == want and {(0, 0), (1, 1)} <= want < {(d, i) for d, _ in docs for i, _ in items}


def test_long_passages_by_proximity(spark):
    a = passage(1, 40)
    doc = [w for k, w in enumerate(a) if k not in (16, 17, 19, 20, 21)]
    assert found(spark, [(1, " ".join(doc)), (2, " ".join(doc[:34]))], [(100, " ".join(a))]) == {(1, 100): False}
