import os

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import answers, language

Q = "What is the limit of queue_depth for the shared index in Zelha Atlas?"


@pytest.mark.parametrize(
    "answer, defect",
    [
        (None, "empty"),
        ("  ​ ", "empty"),
        ("N/A", "empty"),
        ("<p></p>", "empty"),
        ("[answer]", "empty"),
        ("???", "empty"),
        ("k. A.", "empty"),
        (Q, "copied_question"),
        (Q.upper(), "copied_question"),
        (f"Question: {Q}", "copied_question"),
        (f"{Q}\n{Q}", "copied_question"),
        (f"**{Q[:-1]}**", "copied_question"),
        (f"{Q} The limit is 42 requests.", None),
        (f"{Q}\n\n42 requests", None),
        ("Sorry, I can't help with that request. Try rephrasing the question.", None),  # a refusal only if it recurs
        ("Users who are not able to open the card of 3 tenants should set queue_depth to 4.", None),
        ("In Zelha Atlas 7.1, queue_depth is set to 42, so the shared index", "truncated"),
        ("Set queue_depth to 42 because the index tracks…", "truncated"),
        ("Set queue_depth to 42.\n\n```\nqueue_depth: 42", "truncated"),
        ("Set queue_depth to 42.\n\n```\nqueue_depth: 42\n```", None),
        ("`zelha --set queue_depth=42`", None),
        ("queue_depth = 42", None),
        ("42 requests", None),
        ("- Zelha Atlas\n- Lemon One\n- Pucele", None),
        ("采购部隔离权限组之后，还剩0次重", "truncated"),
        ("35条记录", None),
    ],
)
def test_examine(answer, defect):
    assert answers.examine(Q, answer)[0] == defect


def test_short_questions_are_copied_as_well():
    assert answers.examine("Is it on?", "Is it on?")[0] == "copied_question"
    assert answers.examine("Is it on?", "Question: is it on? IS IT ON")[0] == "copied_question"
    assert answers.examine("Is it on?", "Is it only on weekdays? Yes, it is.")[2].startswith("Is it only")
    assert answers.examine("Is it on?", "Is it on? Yes, since 2019.")[2] == "Yes, since 2019."
    long = "Was ist " + "Straße " * 3000 + "?"  # the whole repeat is seen, however long, in any case and with any marks
    assert answers.examine(long, "  - ".join(long.upper().split(" ")))[0] == "copied_question"


def test_clauses():
    of = lambda a: answers.examine(None, a)[1]
    assert of("Zosomi: Regrettably, I won’t say. Ask again!") == ["regrettably i won't say", "ask again"]
    assert of("Set queue.depth to 4. Then wait for it.") == [] and of("42 requests") == [] and of("No comment.") == [] and of("- Zelha Atlas\n- Lemon One") == []


REFUSED = ["Regrettably we leave such a matter open", "We leave such a matter open", "We leave such a matter open, and that is that"]
PROMPTS = ["Which team moves the shared index?", "When does the nightly report run?", "Why was the archive locked?", "Who may read the ledger?", "How large are old snapshots?"]


def test_refusals_and_stock_openings(spark, model):
    rows = [(f"r{k}", q, f"{r}. Try another wording.") for k, (q, r) in enumerate(zip(PROMPTS, [REFUSED[1], *REFUSED, REFUSED[1]]))]
    # sound stock openings: before something of their own, or speaking of what was asked
    rows += [(f"v{k}", q, f"It depends on the version that you run. {a}") for k, (q, a) in enumerate(zip(PROMPTS, ("Old ones wait.", "Never before noon.", "By mistake only.", "All clerks may.", "They hardly grow.")))]
    rows += [(f"m{k}", f"{q} Or does the {w} page open?", "The page opens from the main menu under settings.") for k, (q, w) in enumerate(zip(PROMPTS, ("menu", "settings", "opens", "under", "main")))]
    rows += [(f"b{k}", q, "- Zelha Atlas\n- Lemon One\n- Pucele Desk") for k, q in enumerate(PROMPTS)]
    got = {r.block_id: r.defect for r in answers.defects(frame(spark, rows), model).collect()}
    assert got == {f"r{k}": "refusal" for k in range(5)}


def test_leaders_of_a_band_are_all_compared(spark):
    long = [f"w{i}" for i in range(30)]
    texts = [" ".join(long), " ".join([*long[:-1], "other"]), " ".join(["more", *long]), " ".join(f"x{i}" for i in range(30)), "few words"]
    pairs = {(r.leader, r.opening) for r in answers.similar_pairs(spark.createDataFrame([(t,) for t in texts], "opening string")).collect()}
    assert {frozenset(p) for p in pairs} <= {frozenset((a, b)) for a in texts[:3] for b in texts[:3]} and len({x for p in pairs for x in p}) == 3


def test_null_question():
    assert answers.examine(None, "x y z.")[0] is None and answers.examine(None, None)[0] == "empty"


TRAIN = {
    "en": "The support team moves the shared index to the archive whenever the nightly report shows more than twelve open requests.",
    "de": "Die Plattformgruppe verschiebt den gemeinsamen Index ins Archiv, sobald der Bericht mehr als zwölf offene Anfragen zeigt.",
    "fr": "La rédaction technique déplace les index communs vers les archives dès que le rapport affiche plus de douze demandes.",
    "es": "La oficina de compras mueve los índices comunes al archivo cuando el informe muestra más de doce peticiones abiertas.",
    "pt": "A comissão técnica move os índices comuns para o arquivo quando o relatório mostra mais de doze pedidos abertos.",
    "zh": "如果报表超过十二次请求，客服组就把共享的索引移到归档里，并且每天早上通知平台团队。",
}


@pytest.fixture(scope="module")
def model():
    return language.Model.fit(list(TRAIN.values()) * 3, list(range(6)) * 3)


def frame(spark, rows):
    # columns with clashing names are there on purpose
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "block_id string, critical_question string, trusted_answer string, defect string, opening int")


def test_defects(spark, model):
    template = "We would much rather leave this question open for now"
    rows = [(f"t{i}", f"What is the limit of number {i} in the nightly report of the team?", f"{template}, {w} so.") for i, w in enumerate(("quite", "quite", "quite", "quite"))]
    rows += [("l1", "Which team moves the shared index to the archive?", TRAIN["de"]), ("l2", "Which team moves the shared index to the archive?", TRAIN["en"])]
    rows += [("e", "Which team moves it?", None), ("n", None, "A whole sentence stands here."), ("long", "Which team moves it?", "A whole sentence. " * 20_000)]
    df = frame(spark, rows + rows[:3])
    got = {r.block_id: r.defect for r in answers.defects(df, model).collect()}
    assert {k: v for k, v in got.items()} == {"t0": "refusal", "t1": "refusal", "t2": "refusal", "t3": "refusal", "l1": "other_language", "e": "empty"}


def test_templates_need_different_questions(spark, model):
    rows = [(f"t{i}", "What is the limit?", "We would much rather leave this question open for now.") for i in range(5)]
    assert answers.defects(frame(spark, rows), model).count() == 0


def test_minhash_bands_find_similar(spark):
    a = [f"w{i}" for i in range(24)]
    b = [*a[:-1], "other"]
    s = lambda w: set(answers.shingles(w))
    assert len(s(a) & s(b)) / len(s(a) | s(b)) >= 0.8
    assert (answers._signature(a) == answers._signature(b)).any()


def test_empty(spark, model):
    assert answers.defects(frame(spark, []).filter(F.lit(False)), model).count() == 0


def test_entry_has_all():
    from corpusloom.llm.queries import QUERIES

    assert {f"p{n}_found" for n in (1, 2, 3, 4, 5, 6, 8, 9)} | {"p7_ids"} <= set(QUERIES)
    assert os.path.basename(__file__).startswith("test_")
