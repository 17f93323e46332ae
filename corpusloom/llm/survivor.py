"""Problem 4: one record for each group of duplicates, field by field.

Every record is laid out as one narrow row for each field: how complete its value is (null: not usable), its trust, its
time. A window over (group, field) ranks the rows by completeness, trust and recency, with record_id last so that the
order is total; only the first rank is kept, which Spark also applies before the shuffle (WindowGroupLimit), so a group
that holds a third of all rows sends a few rows for each task and no more. The values themselves are fetched afterwards,
for the chosen records alone.

Usable: an answer that says something, is no stand-in for a missing answer and has at most 500 characters trimmed; a
list with at least one valid entry. Entries are compared trimmed and without case. Null trust and null time rank lowest.
A record delivered again counts once. Records without group_id belong to no group and come out nowhere. A group without
any usable value of a field gets null for it. Extra columns of the table are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The vocabulary of tags.
TAGS = ["IMPORTANT", "WARNING", "TECHNOLOGY", "PROCESS", "REFERENCE", "FAQ", "TROUBLESHOOTING", "SECURITY", "ARCHITECTURE", "API", "DATASET", "POLICY"]
#: Stand-ins for a missing answer, as letters and digits in lower case.
STAND_INS = [
    "", "tbd", "tba", "tbc", "todo", "fixme", "na", "nan", "none", "null", "nil", "empty", "blank", "pending", "unknown", "undefined", "missing", "placeholder", "answer", "noanswer", "notapplicable", "notavailable", "noneyet",
    "tobewritten", "tobeadded", "tobedone", "tobedefined", "tobedetermined", "tobeconfirmed", "tobecompleted", "tobefilled", "tobefilledin", "comingsoon", "workinprogress", "wip", "xxx",
    "seeotherentry", "seeother", "seeabove", "seebelow", "sameasabove", "asabove", "ditto", "seelink", "seedocs", "seedocumentation", "loremipsum",
    "ka", "keineangabe", "keineangaben", "keine", "entfällt", "nd", "sansobjet", "aucun", "aucune", "àcompléter", "ninguno", "ninguna", "nodisponible", "sindatos", "porcompletar", "nenhum", "nenhuma", "nãodisponível", "acompletar",
    "待补充", "待定", "暂无", "无", "略", "同上",
]
LONGEST_ANSWER = 500
FIELDS = ["trusted_answer", "tags", "entities", "keywords"]
_EDGE = r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, _EDGE, "")


def says_something(c: Column) -> Column:
    letters = F.lower(F.regexp_replace(c, r"(?U)[^\p{L}\p{N}]+", ""))
    return ~letters.isin(STAND_INS)


def _entries(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.upper(trimmed(x))), lambda x: x.isNotNull() & (x != "")))


def _completeness() -> dict[str, Column]:
    """By field: characters of the answer or number of distinct valid entries; null if not usable."""
    answer = trimmed(F.col("trusted_answer"))
    tags = F.size(F.array_intersect(_entries(F.col("tags")), F.array(*[F.lit(t) for t in TAGS])))
    names = F.size(_entries(F.transform("entities", lambda e: e["entity_name"])))
    words = F.size(_entries(F.col("keywords")))
    at_least_one = lambda n: F.when(n > 0, n)
    return {
        "trusted_answer": F.when(says_something(answer) & (F.char_length(answer) <= LONGEST_ANSWER), F.char_length(answer)),
        "tags": at_least_one(tags),
        "entities": at_least_one(names),
        "keywords": at_least_one(words),
    }


def measured(records: DataFrame) -> DataFrame:
    """One row for each record and field with a usable value: group_id, field_name, record_id, size, trust, at."""
    sizes = F.array(*[F.struct(F.lit(f).alias("field_name"), n.cast("int").alias("size")) for f, n in _completeness().items()])
    narrow = (
        records.filter(F.col("group_id").isNotNull() & F.col("record_id").isNotNull())
        .select("group_id", "record_id", F.coalesce("trust", F.lit(-(2**31))).alias("trust"), F.coalesce(F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(-(2**63))).alias("at"), sizes.alias("sizes"))
        .dropDuplicates(["group_id", "record_id"])
    )
    return narrow.select("group_id", "record_id", "trust", "at", F.explode("sizes").alias("s")).select("group_id", "s.field_name", "record_id", "s.size", "trust", "at")


def chosen(records: DataFrame) -> DataFrame:
    """(group_id, field_name, record_id): the record that gives each field of each group."""
    order = Window.partitionBy("group_id", "field_name").orderBy(F.desc("size"), F.desc("trust"), F.desc("at"), "record_id")
    ranked = measured(records).filter("size is not null").withColumn("place", F.row_number().over(order))
    return ranked.filter("place <= 1").select("group_id", "field_name", "record_id")


def survivors(records: DataFrame) -> DataFrame:
    """One block for each group: the four fields, cleaned, each with the record_id it comes from."""
    pick = chosen(records)
    upper_once = lambda c, key: F.aggregate(
        c,
        F.filter(c, lambda x: F.lit(False)),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.upper(trimmed(key(y))) == F.upper(trimmed(key(x)))), acc).otherwise(F.concat(acc, F.array(x))),
    )
    filled = lambda c, key: F.filter(c, lambda x: key(x).isNotNull() & (trimmed(key(x)) != ""))
    itself, name = (lambda x: x), (lambda x: x["entity_name"])
    values = records.select(
        "record_id",
        trimmed(F.col("trusted_answer")).alias("trusted_answer"),
        F.array_intersect(_entries(F.col("tags")), F.array(*[F.lit(t) for t in TAGS])).alias("tags"),
        upper_once(filled(F.col("entities"), name), name).alias("entities"),
        upper_once(F.transform(filled(F.col("keywords"), itself), trimmed), itself).alias("keywords"),
    )
    # a record delivered again matches twice; first() keeps one
    joined = pick.join(values, "record_id")
    of = lambda f, c: F.first(F.when(F.col("field_name") == f, F.col(c)), ignorenulls=True)
    found = joined.groupBy("group_id").agg(*[of(f, f).alias(f) for f in FIELDS], *[of(f, "record_id").alias(f"{f}_from") for f in FIELDS])
    # groups of which no record has any usable value still come out
    return records.filter("group_id is not null").select("group_id").distinct().join(found, "group_id", "left")


def undisputed(records: DataFrame) -> DataFrame:
    """(group_id, field_name, record_id) where one record alone is the most complete, the most trusted and the latest.

    Such a record is first in the ranking; it has to have the group's highest trust and time as well, and the rank must
    not be shared. Only groups of two or more records.
    """
    rows = measured(records)
    by = Window.partitionBy("group_id", "field_name")
    first = rows.filter("size is not null").withColumn("place", F.rank().over(by.orderBy(F.desc("size"), F.desc("trust"), F.desc("at")))).filter("place <= 1")
    top = first.groupBy("group_id", "field_name").agg(F.count("*").alias("n"), F.min("record_id").alias("record_id"), F.first("trust").alias("trust"), F.first("at").alias("at")).filter("n = 1")
    usable = F.col("size").isNotNull()
    best = rows.groupBy("group_id", "field_name").agg(F.count("*").alias("members"), F.max(F.when(usable, F.col("trust"))).alias("most"), F.max(F.when(usable, F.col("at"))).alias("last")).filter("members > 1")
    return top.join(best, ["group_id", "field_name"]).filter("trust = most and at = last").select("group_id", "field_name", "record_id")
