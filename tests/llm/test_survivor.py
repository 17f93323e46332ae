from datetime import datetime as D

from corpusloom.llm import survivor as S

SCHEMA = "record_id long, group_id long, name string, trusted_answer string, tags array<string>, entities array<struct<entity_name string, entity_type string, aliases array<string>>>, keywords array<string>, trust int, updated_at timestamp, size int"


def row(r, g, answer="Some answer.", tags=(), names=(), words=(), trust=1, at=D(2024, 1, 1)):
    lists = [None if x is None else list(x) for x in (tags, words)]
    return (r, g, None, answer, lists[0], [(n, None, None) for n in names] if names is not None else None, lists[1], trust, at, 7)


def found(spark, rows):
    return {(r.group_id, r.field_name, r.record_id) for r in S.undisputed(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_found(spark):
    rows = [row(1, 1, "A long answer here.", ["api"], trust=5, at=D(2024, 5, 1)), row(2, 1, "Short.", [" API ", "api", "faq"], trust=1), row(3, 1, "n/a", trust=None, at=None)]
    assert found(spark, rows + rows[:1]) == {(1, "trusted_answer", 1)}


def test_all_three_at_once(spark):
    later = [row(1, 1, "A long answer here.", trust=5, at=D(2024, 1, 1)), row(2, 1, "Short.", trust=5, at=D(2024, 6, 1))]
    assert found(spark, later) == set()
    tie = [row(1, 1, "Same size 1"), row(2, 1, "Same size 2")]
    assert found(spark, tie) == set()
    assert found(spark, [row(1, 1, "Alone in its group.")]) == set()
    assert found(spark, [row(1, 1, "Only usable."), row(2, 1, "TBD", trust=5, at=D(2025, 1, 1))]) == {(1, "trusted_answer", 1)}
    assert found(spark, [row(1, 1, "x" * 501, trust=5), row(2, 1, "Fits.", trust=1)]) == {(1, "trusted_answer", 2)}
    assert found(spark, [row(1, 1, None, trust=None, at=None), row(2, 1, "Fits.", trust=None, at=None)]) == {(1, "trusted_answer", 2)}


def test_lists(spark):
    rows = [row(1, 1, None, ["todo", None, ""], ["Zelha", " zelha "], ["  ", None]), row(2, 1, None, ["API"], ["a", "b"], ["w"])]
    assert found(spark, rows) == {(1, "tags", 2), (1, "entities", 2), (1, "keywords", 2)}


def test_survivors(spark):
    rows = [row(1, 1, " Best answer of all. ", ["api", "API", "zzz"], ["A", " a", "B"], ["k", "K", " "], trust=2), row(2, 1, "Less.", ["faq", "api"], None, None), row(3, 2, None, None, None, None), row(4, None, "No group.")]
    got = {r.group_id: r for r in S.survivors(spark.createDataFrame(rows + rows, SCHEMA)).collect()}
    assert set(got) == {1, 2}
    assert got[1].trusted_answer == "Best answer of all." and got[1].tags == ["FAQ", "API"] and [e.entity_name for e in got[1].entities] == ["A", "B"] and got[1].keywords == ["k"]
    assert (got[1].trusted_answer_from, got[1].tags_from) == (1, 2) and got[2].trusted_answer is None


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.undisputed(df).count() == 0 and S.survivors(df).count() == 0


def test_hot_group(spark):
    rows = [row(i, 1, "x" * (1 + i % 400), trust=i % 5, at=D(2024, 1, 1 + i % 28)) for i in range(3000)]
    rows.append(row(9999, 1, "y" * 500, trust=9, at=D(2025, 1, 1)))
    assert found(spark, rows) == {(1, "trusted_answer", 9999)}
