from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.catalog import query
from corpusloom.functions.cleaning import SPACE
from corpusloom.operators import embedding, similarity
from corpusloom.sources.corpus import blocks
from corpusloom.sources.tables import spread, table

_SPLIT = rf"list_filter(regexp_split_to_array(lower({{0}}), '[{SPACE.replace('{', '{{').replace('}', '}}')}\n]+'), lambda x: x <> '')"


def hash_sql(rows: str, key: str, text: str, dim: int) -> str:
    """SQL of hashed(): rows is a table expression with the columns key and text."""
    return f"""select {key}, idx, s / sqrt(sum(s * s) over (partition by {key})) as value from (
        select {key}, (('0x' || substr(h, 1, 8))::bigint % {dim})::int as idx, sum(case when ('0x' || substr(h, 10, 1))::int % 2 = 1 then 1.0::double else -1.0::double end) as s from (
            select {key}, sha256(unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), flatten(list_transform(w, lambda x: case when length(x) < 3 then [x] else list_transform(range(1, length(x) - 1), lambda i: substr(x, i::int, 3)) end))))) as h
            from (select {key}, {_SPLIT.format(text)} as w from {rows}))
        group by all having sum(case when ('0x' || substr(h, 10, 1))::int % 2 = 1 then 1 else -1 end) <> 0)"""


@query("op48_hashing_embedding", f"select item_id, idx, round(value, 6) as value from ({hash_sql('eval_case', 'item_id', 'reference', 128)})")
def op48(spark, folder):
    h = embedding.hashed(table(spark, folder, "eval_case"), "item_id", F.col("reference"), 128)
    return h.select("item_id", "idx", F.round("value", 6).alias("value"))


_BLOCK_TEXT = "concat('passage:', chr(10), coalesce(name, ''), chr(10), coalesce(critical_question, ''), chr(10), coalesce(trusted_answer, ''))"


@query("op49_block_embedding", f"select block_id, idx, round(value, 6) as value from ({hash_sql('(select block_id, ' + _BLOCK_TEXT + ' as t from {blocks})', 'block_id', 't', 128)})")
def op49(spark, folder):
    b = spread(blocks(spark, folder, "name", "critical_question", "trusted_answer"), "block_id")
    h = embedding.hashed(b, "block_id", embedding.embedding_text(F.col("name"), F.col("critical_question"), F.col("trusted_answer"), "passage:"), 128)
    return h.select("block_id", "idx", F.round("value", 6).alias("value"))


def vectors(spark, folder):
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("block_id"), F.col("embedding").alias("vector"))


def asked(spark, folder):
    """The stated queries: every vector whose id is divisible by 20, against all."""
    return vectors(spark, folder).filter("block_id % 20 = 0").withColumnRenamed("block_id", "query_id")


DOT = "round(list_dot_product(q.embedding::double[], d.embedding::double[]), 6)"
KNN = f"(select query_id, block_id, score, row_number() over (partition by query_id order by score desc, block_id) as rank from (select q.vec_id as query_id, d.vec_id as block_id, {DOT} as score from embeddings q, embeddings d where q.vec_id % 20 = 0))"
PAIRS = f"(select q.vec_id as a, d.vec_id as b, {DOT} as score from embeddings q join embeddings d on q.vec_id < d.vec_id where {DOT} >= {{0}})"


@query("op50_exact_knn", f"select query_id, block_id, score, rank from {KNN} where rank <= 10")
def op50(spark, folder):
    return similarity.nearest(asked(spark, folder), vectors(spark, folder), 10)


@query("op51_vector_upsert", "select vec_id as block_id, round(list_sum(case when vec_id % 3 = 0 then list_transform(embedding::double[], lambda x: -x) else embedding::double[] end), 5) as total from embeddings where vec_id % 5 <> 0")
def op51(spark, folder):
    from corpusloom.operators.stores import deleted, upserted

    v = vectors(spark, folder)
    changed = v.filter("block_id % 3 = 0").select("block_id", F.transform("vector", lambda x: -x).alias("vector"))
    now = deleted(upserted(v, changed, ["block_id"]), v.filter("block_id % 5 = 0"), ["block_id"])
    return now.select("block_id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@query("op52_pairs_above", f"select a, b, score from {PAIRS.format(0.4)}")
def op52(spark, folder):
    return similarity.pairs_above(vectors(spark, folder), 0.4)


@query("op52_pairs_above_top", f"select a, b, score from {PAIRS.format(0.3)} order by score desc, a, b limit 25")
def op52_top(spark, folder):
    return similarity.pairs_above(vectors(spark, folder), 0.3).orderBy(F.desc("score"), "a", "b").limit(25)


@query("op53_verified_candidates", f"select q.vec_id as a, d.vec_id as b, {DOT} as score from embeddings q join embeddings d on d.vec_id = q.vec_id + 1 where {DOT} >= 0.0")
def op53(spark, folder):
    v = vectors(spark, folder)
    near = v.select(F.col("block_id").alias("a"), F.explode(F.array(F.col("block_id") + 1, F.col("block_id") + 1, F.lit(-1).cast("bigint"))).alias("b"))
    return similarity.verified(near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))), v, 0.0)


@query("op54_hyperplane_pairs")
def op54(spark, folder):
    v = vectors(spark, folder)
    return similarity.hyperplane_pairs(v, 64, 0.4)


@query("op55_theoretical_recall", "select c as cosine, round(1 - power(1 - power(1 - acos(c) / pi(), 6), 20), 9) as recall from (select unnest([0.55, 0.6, 0.7, 0.8, 0.9]::double[]) as c)")
def op55(spark, folder):
    return spark.createDataFrame([(c, round(similarity.theoretical_recall(c), 9)) for c in (0.55, 0.6, 0.7, 0.8, 0.9)], "cosine double, recall double")


@query("op56_pair_selector", f"select a, b, score from {PAIRS.format(0.45)}")
def op56(spark, folder):
    v = vectors(spark, folder)
    if similarity.use_hyperplanes(v.count()):
        return similarity.verified(similarity.candidates(v, 64, tables=200), v, 0.45)
    return similarity.pairs_above(v, 0.45)
