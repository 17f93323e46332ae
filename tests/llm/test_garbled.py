import numpy as np
import pytest

from corpusloom.llm import garbled as G

SOUND = [
    "Die Plattformgruppe prüft die Größe der Übersicht – „ganz“ in Ruhe… für 5 €.",
    "La rédaction déplace les critères dès l’accord, à la clôture : « déjà vu ».",
    "A comissão avisa que não há gráficos válidos. ATENÇÃO: NÃO ALTERE. MANHÃ” ok",
    "自2024年9月22日起，文档组对每个租户合并闲置的连接器，只保留三百个租户。",
    "Âge moyen : 5 ; Île, Ère, Œuvre, ¼ × ½ ≤ 1 √ ∂. Привет مرحبا 👩🏽‍💻",
    "Exports may show `Ã©` or `â€™` in place of the right sign; glyphs print as `�` here.",
    "┌──────┬─────┐\n│ seed │ 311 │\n└──────┴─────┘",
]


@pytest.fixture(scope="module")
def restorer():
    size = 1 << G.PAIR_BITS
    c = G._codes("\n".join(SOUND * 5))
    return G.Restorer(np.bincount(G._slot(c[:-1], c[1:]), minlength=size), np.bincount(G._slot(c, np.zeros_like(c)), minlength=size))


@pytest.mark.parametrize("text", SOUND)
def test_sound(restorer, text):
    assert restorer.restore(text) is None


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1250"])
@pytest.mark.parametrize("text", [SOUND[0], SOUND[1], SOUND[3]])
def test_wrong_codec(restorer, codec, text):
    bad = text.encode().decode(codec, "replace")
    got = restorer.restore(bad)
    assert got is not None
    if "�" not in bad and codec in ("latin-1", "mac_roman"):
        assert got[0] == text and got[2]


def test_part_and_twice(restorer):
    assert restorer.restore("Sound – then naÃ¯ve, sound again: é.")[0] == "Sound – then naïve, sound again: é."
    twice = "Größe".encode().decode("cp1252").encode().decode("cp1252")
    assert restorer.restore(f"Die {twice} bleibt")[0] == "Die Größe bleibt"


def test_lost(restorer):
    got = restorer.restore("10� Both the �manual� train")
    assert got is not None and got[2] is False and got[1] == []


def test_nothing(restorer):
    for t in (None, "", "  ", "plain ascii", "x" * 200_000):
        assert restorer.restore(t) is None


def test_frame(spark):
    # enough sound text that the garbled pairs aren't usual in it
    rows = [(i, t, "x") for i, t in enumerate(SOUND)] + [(1000 + i, t, "x") for i, t in enumerate(SOUND * 1500)] + [(90, "Für dÃ¼rre Größe", "x"), (91, None, "x"), (92, "", "x"), (93, "Für dÃ¼rre Größe", "x"), (94, SOUND[0] * 5000 + " Für dÃ¼rre Größe", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored string")
    got = {r.doc_id: r for r in G.restored(df).collect()}
    assert set(got) == {90, 93, 94} and got[90].restored == "Für dürre Größe" and got[90].codecs == ["cp1252"] and got[90].complete
    assert G.restored(df.limit(0)).count() == 0


@pytest.mark.parametrize("codec", ["cp850", "mac_roman", "cp437"])
def test_western_text_under_another_codec(restorer, codec):
    text = "die Größe der Übersicht prüft"
    bad = text.encode("cp1252").decode(codec)
    got = restorer.restore(bad)
    assert got is not None and got[0] == text and got[1] == [codec]


def test_capitals_are_sound(restorer):
    assert restorer.restore("LOS MÁRGENES ÚLTIMOS CIERRAN") is None


def _recursive(s, low, high):
    """Maximal segments by definition: the best one, then those to its left and right."""
    best = max(((sum(s[a:b]), -(b - a), a, b) for a in range(low, high) for b in range(a + 1, high + 1)), default=(0, 0, 0, 0))
    if best[0] <= 0:
        return []
    return [*_recursive(s, low, best[2]), best[2:], *_recursive(s, best[3], high)]


def test_maximal_segments_by_definition():
    rng = np.random.RandomState(3)
    for _ in range(60):
        s = rng.standard_normal(rng.randint(1, 25)) - 0.2
        assert G.maximal_segments(s, 0.0) == _recursive(s.tolist(), 0, len(s))
    assert G.maximal_segments(np.array([2.0, -1.0, 2.0, -5.0, 1.0]), 3.0) == [(0, 3)]  # the weak pair is bridged


def test_readings_only_inside_runs(restorer):
    usual, place = G.Restorer(np.full(1 << G.PAIR_BITS, 1000), np.full(1 << G.PAIR_BITS, 1000)), "Die GrÃ¶ÃŸe bleibt"
    assert usual.runs(place) == [] and usual.restore(place) is None  # nothing is improbable there
    assert restorer.runs(place) and restorer.restore(place)[0] == "Die Größe bleibt"


def test_wrong_many_times(restorer):
    text = bad = "Größe"
    for _ in range(6):
        bad = bad.encode().decode("latin-1")
    assert restorer.restore(f"Die {bad} bleibt")[0] == f"Die {text} bleibt"
