import pytest
from pyspark.sql import functions as F

from corpusloom.llm import language as L
from tests.llm.test_answers import TRAIN


@pytest.fixture(scope="module")
def model():
    return L.Model.fit(list(TRAIN.values()) * 3, list(range(6)) * 3)


SCHEMA = "doc_id string, body_markdown string, confidence string, segment_no int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 0) for i, t in rows], SCHEMA)


def test_labels(spark):
    given = ["en", "EN-gb", "English", "eng", "zh-CN", "Chinese", "por", "xx", "", None, "und", "--", "German "]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(given)], "i int, l string")
    assert [r.c for r in df.orderBy("i").select(L.label(F.col("l")).alias("c")).collect()] == ["en", "en", "en", "en", "zh", "zh", "pt", None, None, None, None, None, "de"]


def test_segments(spark, model):
    mixed = f"# Title of it\n\n{TRAIN['en']} {TRAIN['en']}\n\n> {TRAIN['de']}\n\n```\nreste de la ligne avec des mots\n```\n\n| eine | Tabelle | mit | vielen | Worten |\n\n{TRAIN['zh']}"
    rows = L.segments(frame(spark, [("m", mixed), ("n", None), ("b", "  "), ("c", "`queue_depth = 4`"), ("s", "Hallo Welt."), ("m", mixed)]), model, "doc_id", "body_markdown").distinct().collect()
    got = sorted((r.segment_no, r.lang_code) for r in rows)
    assert got == [(1, "en"), (2, "de"), (3, "zh")]
    for r in rows:
        assert TRAIN[r.lang_code] in mixed[r.segment_start : r.segment_end] and 0.9 <= r.confidence <= 1


def test_very_long(spark, model):
    rows = L.segments(frame(spark, [("l", (TRAIN["pt"] + " ") * 3000)]), model, "doc_id", "body_markdown").collect()
    assert [(r.segment_no, r.lang_code) for r in rows] == [(1, "pt")]


def test_held_out(model):
    new = {
        "en": "Please check the new settings before you restart the service tomorrow morning.",
        "de": "Bitte prüfen Sie die neuen Einstellungen, bevor der Dienst morgen neu gestartet wird.",
        "fr": "Merci de vérifier les nouveaux réglages avant de relancer le service demain matin.",
        "es": "Revise la nueva configuración antes de reiniciar el servicio mañana por la mañana.",
        "pt": "Verifique as novas configurações antes de reiniciar o serviço amanhã de manhã.",
        "zh": "请在明天早上重新启动服务之前检查新的设置。",
    }
    right = [x[0] == k for k, x in zip(new, model.decide(list(new.values())))]
    assert sum(right) >= 5  # of a model that has seen one sentence of each


def test_wrong_labels_are_left_out():
    texts, labels = list(TRAIN.values()) * 6, list(range(6)) * 6
    labels[0] = 3
    m = L.Model.fit(texts, labels)
    assert m.decide([TRAIN["en"]])[0][0] == "en"


def test_empty(spark):
    empty = frame(spark, [])
    m = L.fitted(empty.withColumn("language", F.lit("en")), "doc_id", "body_markdown", "language")
    assert m.decide([]) == [] and L.segments(empty, m, "doc_id", "body_markdown").count() == 0
