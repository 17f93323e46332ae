"""Operators against plain restatements and edge cases."""

import math
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import chunks, cleaning, noisy_json, scripts
from corpusloom.functions import text as T
from corpusloom.operators import answering, embedding, evaluation, fusion, generation, graph, keywords, lexical, models, questions, reading, similarity, stores
from corpusloom.plans.jobs import Jobs
from corpusloom.sources import convert, vector_store


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


def test_cleaning_rules(spark):
    assert one(spark, "﻿﻿a\r\nb\rc", lambda c: cleaning.line_ends(cleaning.strip_bom(c))) == "a\nb\nc"
    assert one(spark, "a\x00\x07\tb\x7f", cleaning.strip_controls) == "a\tb"
    for s in ("  a \xa0\n b \t\n\n", "x  \n", "\n \n", "a b", " end\x85"):
        assert one(spark, s, cleaning.strip_trailing) == "\n".join(x.rstrip() for x in s.split("\n")).strip()
    assert one(spark, "a\n\n\n\nb", cleaning.collapse_blank(1)) == "a\n\nb"
    assert one(spark, "a<!-- x\ny -->b<!---->c", cleaning.strip_comments) == "abc"
    assert one(spark, None, cleaning.clean) is None
    assert one(spark, "a1b22c3", cleaning.replace("[0-9]+", "#", count=2)) == "a#b#c3"


def test_routing(spark):
    r = cleaning.Registry().add(F.upper, "*.md").add(cleaning.replace("A", "b"), "^dir/", "regex")
    df = spark.createDataFrame([("a", "x/y.md"), ("a", "x.MD"), ("a", None), ("A", "dir/z")], "t string, s string")
    assert [x[0] for x in df.select(r.clean(F.col("t"), F.col("s"), defaults=False)).collect()] == ["A", "a", "a", "b"]
    with pytest.raises(ValueError):
        cleaning.Routed(F.upper, "x", "fuzzy")


def test_scripts():
    assert scripts.Script("text.upper()").run("a") == ("A", None)
    assert scripts.Script("text[5]").run("a")[0] == "a"
    for bad in ("text.__class__", "open('x')", "[x for x in text]", "lambda: 1"):
        with pytest.raises(ValueError):
            scripts.Script(bad)


def test_tokenizers(spark):
    assert one(spark, "Don't été 42", T.latin_tokens) == ["dont", "t", "42"]
    assert one(spark, "企业知识 RAG 管", T.bigram_tokens) == ["企业", "业知", "知识", "rag", "管"]
    assert one(spark, "A漢b字", T.index_tokens) == ["a", "b", "漢", "字", "漢字"]
    assert one(spark, "", T.index_tokens) == []


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(T.cosine(F.col("a"), F.col("b")).alias("c"), T.normalized(F.col("a")).alias("n"), T.normalized(F.col("b")).alias("z")).first()
    assert r.c == 0.0 and r.n == [0.6, 0.8] and r.z == [0.0, 0.0]
    with pytest.raises(Exception):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(T.dot(F.col("a"), F.col("b"))).collect()


def test_hashing_embedding(spark):
    import hashlib

    def plain(text, d=32):
        v = np.zeros(d)
        w = text.lower().split()
        g = w + [" ".join(w[i : i + 2]) for i in range(len(w) - 1)] + [x for t in w for x in ([t[i : i + 3] for i in range(len(t) - 2)] or [t])]
        for x in g:
            h = hashlib.sha256(x.encode()).digest()
            v[int.from_bytes(h[:4], "big") % d] += 1 if h[4] & 1 else -1
        return v / (np.linalg.norm(v) or 1)

    texts = ["Set the limit to 42", "été à Paris", "知识 管理", "a", "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.vector for r in embedding.dense(df, "id", F.col("t"), 32).collect()}
    for i, t in enumerate(texts[:-1]):
        assert np.allclose(got[i], plain(t))
    assert 4 not in got


def planted(n=12, d=48):
    r = np.random.RandomState(3)
    rows = []
    for g in range(n):
        c = r.randn(d)
        for m in range(3):
            v = c + r.randn(d) * 0.05
            rows.append((f"g{g:02}m{m}", (v / np.linalg.norm(v)).tolist()))
    return rows


def test_similarity_joins(spark):
    rows = planted()
    v = spark.createDataFrame(rows, "block_id string, vector array<double>")
    m, ids = np.array([r[1] for r in rows]), [r[0] for r in rows]
    want = {(ids[i], ids[j]) for i in range(len(ids)) for j in range(i + 1, len(ids)) if m[i] @ m[j] >= 0.8}
    assert {(r.a, r.b) for r in similarity.pairs_above(v, 0.8, blocks=3).collect()} == want
    reduced = {(r.a, r.b) for r in similarity.verified(similarity.candidates(v, 48), v, 0.8).collect()}
    assert reduced <= want and len(reduced) >= 0.9 * len(want)
    near = similarity.nearest(v.withColumnRenamed("block_id", "query_id"), v, 2, exclude_self=True).collect()
    for r in near:
        assert r.query_id[:3] == r.block_id[:3] and r.query_id != r.block_id


def test_components_and_louvain(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefgh"], "block_id string")
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.8), ("d", "e", 0.7), ("g", "f", 0.9), ("c", "f", 0.6)], "a string, b string, score double")
    got = {r.block_id: r.cluster_id for r in graph.components(nodes, edges).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "f": "a", "g": "a", "d": "d", "e": "d", "h": "h"}
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(60)], "a int, b int, score double")
    labels = graph.components(spark.range(61).select(F.col("id").cast("int").alias("block_id")), chain)
    assert {r.cluster_id for r in labels.collect()} == {0}
    two = [(a, b, 1.0) for g in ("abcd", "wxyz") for a in g for b in g if a < b] + [("d", "w", 0.1)]
    found = graph.louvain(list("abcdwxyz"), two)
    assert {found[x] for x in "abcd"} == {"a"} and {found[x] for x in "wxyz"} == {"w"}


def test_strongest_partition():
    pairs = [("a", "b", 0.9), ("b", "c", 0.5), ("c", "d", 0.95)]
    assert graph.strongest_partition(list("abcd"), pairs, 2) == [["a", "b"], ["c", "d"]]
    assert graph.strongest_partition(list("abcde"), [], 2) == [["a", "b", "c"], ["d", "e"]]
    assert graph.strongest_partition([], [], 3) == []


def test_keywords_text():
    assert keywords.cohesive("知识管理。知识库。管理") == {"知识", "管理"}
    scores = keywords.rank_graph([["a", "b"], ["b", "c"]])
    assert scores["b"] > scores["a"]
    assert keywords.textrank_words([["x"]], 3) == [("x", pytest.approx(0.15))]
    assert keywords.pick_sentences([["a", "b"], ["a", "b"], ["c", "d", "a"]], 2) == [0, 2]
    with pytest.raises(ValueError):
        keywords.extractor("magic")


def test_bm25_incremental(spark):
    rows = [("1", "the index of the cluster"), ("2", "a cluster view"), ("3", "")]
    df = spark.createDataFrame(rows, "block_id string, t string")
    full = lexical.postings(df, "block_id", T.index_tokens(F.col("t")))
    part = lexical.added(lexical.postings(df.filter("block_id = '1'"), "block_id", T.index_tokens(F.lit("old"))), full, "block_id")
    assert sorted(map(tuple, part.collect())) == sorted(map(tuple, full.collect()))
    q = spark.createDataFrame([("q", "cluster cluster view")], "query_id string, q string")
    found = lexical.search(q, full, 5, "query_id", "block_id", T.index_tokens(F.col("q"))).orderBy("rank").collect()
    assert [r.block_id for r in found] == ["2", "1"]


def leg(spark, *ids):
    return spark.createDataFrame([("q", b, 1.0 / (n + 1), n + 1) for n, b in enumerate(ids)], "query_id string, block_id string, score double, rank int")


def test_fusion(spark):
    both = fusion.fused([leg(spark, "a", "b"), leg(spark, "b", "c")]).orderBy("rank").collect()
    assert both[0].block_id == "b"
    alone = fusion.fused([leg(spark, "a"), leg(spark, "c")], weights=(1, 0)).collect()
    assert [r.block_id for r in alone] == ["a"]
    with pytest.raises(ValueError):
        fusion.fused([leg(spark, "a")], weights=(-1,))
    r = fusion.floored(leg(spark, "a", "b", "c"), 0.6).collect()
    assert [x.block_id for x in r] == ["a"]


def test_reading(spark):
    r = leg(spark, *"abcdef")
    got = sorted((x.position, x.block_id) for x in reading.head_tail(r).collect())
    assert [b for _, b in got] == ["a", "c", "e", "f", "d", "b"]
    kept = reading.within_budget(r, F.lit(10.0), 5.0).collect()
    assert [x.block_id for x in kept] == ["a"]


def test_stores(spark):
    cur = spark.createDataFrame([(1, "a"), (2, "b")], "id int, t string")
    new = spark.createDataFrame([(2, "B"), (3, "c")], "id int, t string")
    assert sorted(map(tuple, stores.upserted(cur, new, ["id"]).collect())) == [(1, "a"), (2, "B"), (3, "c")]
    assert {r.id: r.change for r in stores.change_kinds(cur, new.union(cur.filter("id = 1")), "id", "t").collect()} == {1: "unchanged", 2: "updated", 3: "created"}
    assert stores.deleted(cur, new, ["id"]).count() == 1


def test_metrics_and_tiers(spark):
    truth = spark.createDataFrame([("q", "b"), ("r", "x")], "query_id string, block_id string")
    qs = spark.createDataFrame([("q",), ("r",)], "query_id string")
    m = evaluation.metrics(leg(spark, "a", "b"), truth, qs, (1, 2)).first()
    assert (m.hit_at_1, m.hit_at_2, m.mrr, m.top_score) == (0.0, 0.5, 0.25, 1.0)
    assert evaluation.tier_sizes(10, 100, 2.0) == [10, 20, 40, 80, 100]
    assert evaluation.tier_sizes(10, 10) == [10]


def test_chunks():
    of = lambda t, *a: chunks.chunks(t, *a)
    assert of("aaaa bbbb cccc dddd", 9, 0) == ["aaaa bbbb", "cccc dddd"]
    assert of("aaaa bbbb cccc dddd", 9, 4) == ["aaaa bbbb", "bbbb cccc", "cccc dddd"]  # the repeat fits
    assert of("aaaa bbbbbbb cccc", 9, 4) == ["aaaa", "bbbbbbb", "bbbb cccc"]  # no room for a repeat
    assert of("One two. Three four five.\n\nSix", 12, 0) == ["One two", "Three four", "five.\n\nSix"]  # paragraphs, sentences, words; packed again
    assert of("abcdefghij", 4, 1) == ["abcd", "defg", "ghij"]  # no separator: windows
    assert of("x\n\n\n\ny", 3, 0) == ["x", "y"] and of("short", 9, 0) == ["short"] and of("", 9, 0) == of(None, 9, 0) == []
    long = "Alpha beta gamma. " * 400 + "z" * 1000
    assert all(0 < len(c) <= 100 for c in of(long, 100, 20))
    with pytest.raises(ValueError):
        of("x", 5, 5)


def test_chunk_places(spark):
    rows = spark.createDataFrame([(1, "aaaa bbbb cccc dddd", "clash"), (2, None, "clash"), (3, "", "clash")], "doc_id long, text string, start string")
    got = [tuple(r) for r in chunks.chunked(rows, "doc_id", "text", 9, 4).collect()]
    assert got == [("1#0", 1, 0, 9, "aaaa bbbb"), ("1#1", 1, 9, 18, "bbbb cccc"), ("1#2", 1, 18, 27, "cccc dddd")]


def test_segments():
    assert chunks.segments("a\n\n" + "b" * 30, 20) == ["a", "b" * 20, "b" * 10]
    assert chunks.segments(" one\n\ntwo\n\nthree four five ", 10) == ["one\n\ntwo", "three", "four\n\nfive"]
    assert chunks.segments("  ") == chunks.segments(None) == []
    assert all(len(x) <= 50 for x in chunks.segments("Some words. And more\nof them " * 90, 50))


def test_summary_sentences(spark):
    md = "# Title\n\nFirst one. ![pic](u) Second [link](http://x)!\n```\ncode. here\n```\n| a | b |\n---\n* item: rest\n~~~\nnever closed"
    got = spark.createDataFrame([(md,), (None,)], "t string").select(T.summary_sentences(F.col("t")).alias("s")).collect()
    assert got[0].s == ["Title", "First one", "Second link", "item", "rest", "~~~", "never closed"] and got[1].s is None


def test_components_of_a_long_path(spark):
    n = 300
    nodes = spark.createDataFrame([(i,) for i in range(n)], "block_id long")
    edges = spark.createDataFrame([((i * 7) % n, ((i + 1) * 7) % n) for i in range(n - 1)], "a long, b long")
    assert {r.cluster_id for r in graph.components(nodes, edges).collect()} == {0}


def test_hot_bucket(spark, monkeypatch):
    rng = np.random.RandomState(2)
    rows = [(i, [1.0, 0.0, float(x)]) for i, x in enumerate(rng.rand(60) / 1000)]
    v = spark.createDataFrame(rows, "block_id long, vector array<double>")
    whole = {tuple(r) for r in similarity.candidates(v, 3, 2, 3).collect()}
    monkeypatch.setattr(similarity, "BUCKET", 7)
    cut = [tuple(r) for r in similarity.candidates(v, 3, 2, 3).collect()]
    assert len(cut) == len(set(cut)) and set(cut) == whole and len(whole) > 100


def test_nearest_in_small_products(spark, monkeypatch):
    rng = np.random.RandomState(4)
    d, q = rng.standard_normal((90, 5)), rng.standard_normal((7, 5))
    data = spark.createDataFrame([(i, [float(x) for x in r], i % 3) for i, r in enumerate(d)], "block_id long, vector array<double>, band int")
    asked = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(q)], "query_id long, vector array<double>")
    monkeypatch.setattr(similarity, "PRODUCT", 50)
    got = {(r.query_id, r["rank"]): r.block_id for r in similarity.nearest(asked, data, 4).collect()}
    best = np.argsort(-(q @ d.T), axis=1)
    assert got == {(i, k + 1): best[i, k] for i in range(7) for k in range(4)}
    got = {(r.query_id, r.band, r["rank"]): r.block_id for r in similarity.nearest(asked, data, 2, within="band").collect()}
    assert got == {(i, b, k + 1): [x for x in best[i] if x % 3 == b][k] for i in range(7) for b in range(3) for k in range(2)}


def test_shared_folder(spark, monkeypatch):
    from corpusloom.plans import lineage

    class Elsewhere:
        class conf:
            get = staticmethod(lambda key, default=None: None)

        class sparkContext:
            master = "spark://host:7077"
            getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda key: None)}))

    with pytest.raises(RuntimeError):
        lineage.shared_folder(Elsewhere)
    assert lineage.shared_folder(spark)


def test_write_markdown_names_a_file_system(spark, tmp_path):
    rows = spark.createDataFrame([("/a/x.txt", "# X"), ("/a/y.txt", None)], "path string, markdown string")
    convert.write_markdown(rows, f"file://{tmp_path}/out")
    assert [(f.name, f.read_text()) for f in (tmp_path / "out").iterdir()] == [("x.md", "# X")]
    with pytest.raises(Exception, match="nofs"):
        convert.write_markdown(rows, "nofs://bucket/out")


def test_noisy_json():
    assert noisy_json.salvage('```json\n{"a": 1,}\n```') == {"a": 1}
    assert noisy_json.salvage('Sure: [{"a": 1}, {"b": 2') in ([{"a": 1}, {"b": 2}], [{"a": 1}])
    assert noisy_json.salvage('{"a": "say \\"hi') == {"a": 'say "hi'} and noisy_json.salvage('{"a": "x\\\\", "b": ["y\\') == {"a": "x\\", "b": ["y"]}
    assert noisy_json.salvage("nothing") is None and noisy_json.salvage(None) is None


def test_models():
    assert models.order("[2, 0, 9, 2]", 3) == [2, 0, 1] and models.order("?", 2) == [0, 1]
    assert models.self_query('{"query": "x", "tags": ["api", "zzz"]}', "q")["tags"] == ["API"]
    assert models.sub_queries('{"sub_queries": ["A", "a ", ""]}')["sub_queries"] == ["A"]


def test_generation(spark):
    docs = spark.createDataFrame([(1, "First. Second."), (2, None), (3, "  ")], "id int, t string")
    rows = generation.generated(docs, "id", "t").collect()
    assert [(r.id, r.critical_question, r.error) for r in rows] == [(1, "First?", None)]
    bad = generation.generated(docs, "id", "t", lambda: generation.ScriptedClient(["no json"])).collect()
    assert bad[0].error


def test_questions(spark):
    assert one(spark, "WHY so", lambda c: questions.intent(c, [questions.IntentRule(("why",), "a")])).intent == "a"
    assert one(spark, "", lambda c: questions.intent(c, [])).intent == questions.DEFAULT_INTENT
    assert one(spark, "abc", lambda c: questions.rewritten(c, [("x", "y"), ("b", "B")])) == "aBc"


def test_convert_and_vector_store(spark, tmp_path):
    (tmp_path / "a.HTML").write_text("<title>T</title><h2>H</h2><p>x &amp; y</p><script>no</script>")
    (tmp_path / "b.csv").write_text("a,b\n1,2\n")
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.exe").write_bytes(b"\0")
    rows = {r.path.rsplit("/", 1)[1]: r for r in convert.converted(convert.scan(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a.HTML", "b.csv", "c.json"}
    assert rows["a.HTML"].title == "T" and "## H" in rows["a.HTML"].markdown and "no" not in rows["a.HTML"].markdown
    assert rows["c.json"].error and rows["c.json"].markdown is None
    with pytest.raises(FileNotFoundError):
        convert.scan(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        convert.identifier("a; drop")
    v = spark.createDataFrame([("a", [1.0, 2.0])], "block_id string, vector array<double>")
    vector_store.save(v, str(tmp_path / "store"))
    assert vector_store.load(spark, str(tmp_path / "store")).first().vector == [1.0, 2.0]


def test_jobs(spark):
    jobs = Jobs(spark)
    assert jobs.submit(lambda j: 42).wait(20) == "success"
    assert jobs.submit(lambda j: 1 / 0).wait(20) == "failed"

    def slow(job):
        for _ in range(100):
            time.sleep(0.05)
            job.phase(0.1)

    j = jobs.submit(slow)
    j.cancel()
    assert j.wait(20) == "cancelled" and not j.cancel()
    with pytest.raises(RuntimeError):
        j.start()
    assert jobs.submit(slow, timeout=0.1).wait(20) == "timeout"


def test_recall_formula():
    assert math.isclose(similarity.theoretical_recall(0.55), 0.888, abs_tol=2e-3)
    assert not similarity.use_hyperplanes(4999) and similarity.use_hyperplanes(5000)


def test_written_and_swept(spark):
    from corpusloom.plans.lineage import sweep, written

    sweep(spark)
    df = written(spark.range(5))
    assert df.count() == 5 and df.columns == ["id"]
    assert sweep(spark) == 1 and sweep(spark) == 0


def test_ask_is_judged_by_its_evidence(spark):
    q = spark.createDataFrame([("q", "who moves the index"), ("n", "nothing here")], "query_id string, query string")
    hits = spark.createDataFrame([("q", "b1", "the night crew moves the index", 2.0, 1), ("q", "b2", "the index is moved at noon", 1.0, 2)], "query_id string, block_id string, text string, score double, rank int")
    search = lambda asked: hits.join(asked.select("query_id"), "query_id")
    got = {r.query_id: r for r in answering.ask(q, search).collect()}
    assert (got["q"].answer, got["q"].block_id, got["q"].abstained) == ("the night crew moves the index", "b1", False) and got["n"].reason == "no candidates"
    joined = {r.query_id: r for r in answering.ask(q, search, read=lambda t: F.array_join(t, " ")).collect()}
    assert joined["q"].answer.endswith("at noon") and not joined["q"].abstained
    made_up = {r.query_id: r for r in answering.ask(q, search, read=lambda t: F.lit("penguins ate every cable yesterday")).collect()}
    assert made_up["q"].abstained and made_up["q"].reason == "unfaithful" and made_up["q"].answer is None


def test_corpus_search_is_bm25(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_TERMS", 20)
    monkeypatch.setattr(lexical, "SCORES", 100)
    r = np.random.default_rng(3)
    text = lambda n: " ".join(f"w{int(x)}" for x in r.zipf(1.6, n) % 25)
    made = [text(n) for n in (1, 4, 9, 9, 20) * 12]
    df = spark.createDataFrame([(f"b{n}-{c}", t) for n, t in enumerate(made) for c in range(3)] + [("empty", ""), ("null", None), (None, made[0])], "block_id string, t string")
    q = spark.createDataFrame([(n, text(6)) for n in range(12)] + [(98, "unheard"), (99, "w1 w1 w2"), (None, "w2"), (97, None)], "query_id int, q string")
    tokens = T.index_tokens(F.col("q"))
    key = lambda x: (str(x.query_id), x.rank)
    want = sorted(lexical.search(q, lexical.postings(df, "block_id", T.index_tokens(F.col("t"))), 4, "query_id", "block_id", tokens).collect(), key=key)
    got = sorted(lexical.Corpus(df, "block_id", T.index_tokens(F.col("t"))).search(q, 4, "query_id", tokens).collect(), key=key)
    assert len(got) > 40 and got == want
    assert lexical.Corpus(df, "block_id", T.index_tokens(F.col("t"))).search(q.filter("query_id = 98"), 4, "query_id", tokens).count() == 0


@pytest.mark.parametrize("name", ["op109_batch_ask", "op110_agent_evidence"])
def test_searches_of_many_hits_shuffle_little(spark, tmp_path, name):
    """What is shuffled follows the blocks and the answers, not the pairs of questions and blocks that share a word."""
    from corpusloom import catalog

    words = "the index of a cluster moves every night"
    blocks = [(f"b{n}", f"{words} {n % 40}", "what moves", "index", ["cluster"]) for n in range(1500)]
    spark.createDataFrame(blocks, "block_id string, trusted_answer string, critical_question string, name string, keywords array<string>").write.parquet(f"{tmp_path}/idea_blocks.parquet")
    spark.createDataFrame([(n, f"{words} {n}", "") for n in range(200)], "item_id bigint, query string, reference string").write.parquet(f"{tmp_path}/eval_case.parquet")
    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    assert catalog.load()[0][name](spark, str(tmp_path)).select("query_id").distinct().count() == 200
    time.sleep(1)
    assert shuffled() - before < 1_000_000


def test_corpus_stores_only_what_is_asked_for(spark):
    """Words that no question has aren't stored; a later search for them finds them all the same."""
    r = np.random.default_rng(5)
    df = spark.createDataFrame([(f"b{n}", "the index " + " ".join(f"w{x}" for x in r.integers(0, 10**9, 200))) for n in range(400)] + [("late", "seldom the index")], "block_id string, t string")
    corpus = lexical.Corpus(df, "block_id", T.index_tokens(F.col("t")))
    ask = lambda text: corpus.search(spark.createDataFrame([(1, text)], "query_id int, q string"), 3, "query_id", T.index_tokens(F.col("q"))).collect()
    assert [x.block_id for x in ask("the index")] == ["late", "b0", "b1"]
    first = corpus.rows
    assert sum(os.path.getsize(f.removeprefix("file://")) for f in first.inputFiles()) < 100_000
    assert [x.block_id for x in ask("index")] == ["late", "b0", "b1"] and corpus.rows is first
    assert [x.block_id for x in ask("seldom")] == ["late"] and [x.block_id for x in ask("the")] == ["late", "b0", "b1"]


def test_once_shuffles_repeated_keys_only(spark, monkeypatch):
    from corpusloom.sources import corpus

    df = spark.createDataFrame([(f"k{n % 90}", "x" * 10) for n in range(100)] + [(None, "n"), (None, "n")], "id string, v string")
    want = sorted(df.dropDuplicates(["id"]).collect(), key=str)
    assert sorted(corpus.once(df, "id").collect(), key=str) == want
    monkeypatch.setattr(corpus, "SENT", 3)
    assert sorted(corpus.once(df, "id").collect(), key=str) == want
