import random

from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import pieces


def check(text, limit, overlap):
    found = pieces.cuts(text, limit, overlap)
    assert "".join(text[c:e] for _, c, e in found) == text
    for n, (s, c, e) in enumerate(found):
        assert 0 < e - s <= limit and s <= c < e
        assert c - s <= overlap
        if n:
            assert c == found[n - 1][2] and s >= found[n - 1][0]
    return found


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\n#|`é汉é👩‍💻", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_round_trip(text, limit, overlap):
    check(text, limit, overlap)


def test_boundaries():
    paragraph = "Alpha beta gamma delta. " * 12
    text = f"# One\n\n{paragraph}\n\n# Two\n\n{paragraph}"
    found = check(text, 450, 40)
    assert any(text[c:].startswith("# Two") for _, c, _ in found)
    fence = "```\n" + "a = 1\n" * 20 + "```\n"
    text = paragraph + "\n" + fence + "\n" + paragraph
    found = check(text, 400, 0)
    low, high = text.index("```"), text.rindex("```")
    assert not any(low < c < high for _, c, _ in found)


def test_words_stay_whole():
    text = " ".join(random.Random(1).choice(["alpha", "beta", "gamma"]) for _ in range(800))
    for s, c, e in check(text, 200, 30):
        assert c == 0 or text[c - 1] == " "
        assert s == 0 or text[s - 1] == " "


def test_no_boundary_and_very_long():
    found = check("x" * 300_000, 500, 50)
    assert max(e - s for s, _, e in found) <= 500
    check("é" * 2000, 101, 10)
    assert pieces.cuts("", 10, 2) == []


def test_split(spark):
    rows = [("a", "word " * 300), ("a", "word " * 300), ("b", "short"), ("c", None), ("d", " " * 900), (None, "word " * 300), ("e", "x" * 500), ("f", " " + "x" * 500 + " ")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "block_id string, trusted_answer string, piece_no int")
    got = pieces.split(df, "idea_blocks", "block_id", "trusted_answer", 500, 50)
    assert {r.item_id for r in got.collect()} == {"a", None}
    one = sorted((r.piece_no, r.core_start, r.piece_start, r.piece) for r in got.filter("item_id = 'a'").dropDuplicates(["piece_no"]).collect())
    assert "".join(p[c - s :] for _, c, s, p in one) == "word " * 300
    assert pieces.split(df.limit(0), "t", "block_id", "trusted_answer", 500, 50).count() == 0
