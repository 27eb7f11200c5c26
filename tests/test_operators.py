"""Operators on fixtures with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from engrava.functions import dialect, text as tx, vector as vec
from engrava.operators import analytics as an, graphs as gr, hyper as hd, joins, lexical as lex, ranking as rk, store as st
from engrava.sources import files


def graph(spark, edges):
    return gr.simple(spark.createDataFrame(edges, "src string, dst string"))


def test_bm25_closed_forms(spark):
    row = spark.range(1).select(lex.bm25(F.lit(2), F.lit(1), F.lit(10), F.lit(3), F.lit(8.0)).alias("a"), lex.bm25(F.lit(1), F.lit(2), F.lit(5), F.lit(4), F.lit(5.0)).alias("b")).first()
    assert row.a == pytest.approx(1.26004341, abs=1e-6) and row.b == pytest.approx(math.log(2), abs=1e-9)


@pytest.mark.parametrize(("edges", "want"), [([("a", "b"), ("b", "c"), ("c", "a")], 1.0), ([("h", str(i)) for i in range(5)], 0.0), ([("a", "b"), ("b", "c"), ("c", "d")], 0.0), ([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x")], 1.0)])
def test_clustering_of_small_graphs(spark, edges, want):
    assert gr.clustering(graph(spark, edges)).agg(F.avg("c")).first()[0] == pytest.approx(want)


def test_paths_and_betweenness_on_a_path(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "d"), (None, "a"), ("a", "a"), ("b", "a")])
    nodes = gr.degrees(g).select("node")
    d = gr.distances(g, nodes)
    assert gr.mean_path_length(d).first().apsl == pytest.approx(20 / 12)
    h = {r.node: r.harmonic for r in gr.harmonic(d).collect()}
    assert h["b"] == pytest.approx(2.5) and h["a"] == pytest.approx(1 + 1 / 2 + 1 / 3)
    b = {r.node: r.score for r in gr.betweenness(g, nodes, 4).collect()}
    assert b == {"a": 0.0, "b": pytest.approx(2 / 3), "c": pytest.approx(2 / 3), "d": 0.0}


def test_communities_and_modularity_of_two_triangles(spark):
    g = graph(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "z"), ("z", "x")])
    c = {r.node: r.community for r in gr.propagated_communities(g, 10).collect()}
    assert len({c[n] for n in "abc"}) == 1 and len({c[n] for n in "xyz"}) == 1 and c["a"] != c["x"]
    labels = spark.createDataFrame(list(c.items()), "node string, c string")
    assert gr.modularity(g, labels).first().q == pytest.approx(0.5)


def test_asof_ties_gaps_and_groups(spark):
    left = spark.createDataFrame([(1, "s", 5), (2, "s", 1), (3, "t", 9), (4, None, 9), (5, "s", None)], "id int, s string, t int")
    right = spark.createDataFrame([(10, "s", 5), (11, "s", 5), (12, "s", 3), (13, "u", 1), (14, None, 1)], "rid int, s string, t int")
    got = {r.id: r.r_rid for r in joins.asof_backward(left, right, ["s"], "t", "t", ["rid"]).collect()}
    assert got == {1: 11}


def test_supersession_chain(spark):
    r = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "id string")
    e = spark.createDataFrame([("A", "B", "contradicts", 1.0), ("B", "C", "contradicts", 1.0), ("D", "D", "contradicts", 1.0)], "src string, dst string, edge_type string, weight double")
    got = {x.id: (x.current, x.hops) for x in joins.supersede_chain(r, e).collect()}
    assert got == {"A": ("C", 2), "B": ("C", 1)}


def test_supersede_cap_reaches_a_fixpoint(spark):
    h = spark.createDataFrame([("g", "a", 0.9), ("g", "b", 0.5), ("g", "c", 0.3)], "grp string, id string, score double")
    c = spark.createDataFrame([("a", "b"), ("b", "c")], "id string, by string")
    got = {r.id: r.score for r in rk.supersede_capped(h, "grp", c).collect()}
    assert got["c"] == 0.3 and got["b"] == pytest.approx(0.2999) and got["a"] == pytest.approx(0.2998)


def test_rank_bases(spark):
    lane = spark.createDataFrame([(1, 0.9), (2, 0.5)], "doc int, score double")
    assert {r.doc: round(r.rrf, 9) for r in rk.rrf([lane, lane], "doc", "score").collect()} == {1: round(2 / 60, 9), 2: round(2 / 61, 9)}
    assert {r.doc: round(r.rrf, 9) for r in rk.rrf([lane], "doc", "score", base=1).collect()} == {1: round(1 / 61, 9), 2: round(1 / 62, 9)}


def test_average_rank_percentile(spark):
    df = spark.createDataFrame([("g", 1), ("g", 1), ("g", 2), ("g", 3), ("h", 7)], "g string, v int")
    got = sorted((r.g, r.v, r.percentile) for r in an.average_rank_percentile(df, "v", ["g"]).collect())
    assert got == [("g", 1, 0.5 / 3), ("g", 1, 0.5 / 3), ("g", 2, 2 / 3), ("g", 3, 1.0), ("h", 7, 0.0)]


def test_budget_keeps_one_hit_and_stops_at_overflow(spark):
    df = spark.createDataFrame([("g", 1, 90), ("g", 2, 20), ("g", 3, 1), ("h", 1, 500), ("h", 2, 1)], "g string, r int, c int")
    assert sorted((r.g, r.r) for r in an.budget_packed(df, "g", "r", "c", 100).collect()) == [("g", 1), ("h", 1)]


def test_upsert_update_and_delete_semantics(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, x string, y int")
    n = spark.createDataFrame([(2, "B"), (3, "C")], "k int, x string")
    assert sorted(map(tuple, st.upsert(t, n, ["k"]).collect())) == [(1, "a", 1), (2, "B", 2), (3, "C", None)]
    assert sorted(map(tuple, st.upsert(t, n, ["k"], []).collect())) == [(1, "a", 1), (2, "b", 2), (3, "C", None)]
    assert sorted(map(tuple, st.insert_or_ignore(t, spark.createDataFrame([(2, "z", 0), (4, "d", 4), (None, "n", 0)], "k int, x string, y int"), ["k"]).collect()), key=str) == sorted([(1, "a", 1), (2, "b", 2), (4, "d", 4), (None, "n", 0)], key=str)
    s = st.update_where(spark.createDataFrame([(1, 2, True), (3, 4, None)], "a int, b int, c boolean"), F.col("c"), {"a": F.col("b"), "b": F.col("a")})
    assert sorted(map(tuple, s.collect())) == [(2, 1, True), (3, 4, None)]
    assert st.delete_where(s, F.col("c")).count() == 1


def test_three_valued_logic_and_storage_classes(spark):
    v = spark.createDataFrame([(True,), (False,), (None,)], "a boolean")
    got = {(r.a, r.b): (r["and"], r["or"]) for r in v.crossJoin(v.withColumnRenamed("a", "b")).select("a", "b", (F.col("a") & F.col("b")).alias("and"), (F.col("a") | F.col("b")).alias("or")).collect()}
    assert got[(None, False)] == (False, None) and got[(None, True)] == (None, True) and got[(None, None)] == (None, None)
    c = dialect.storage_class
    less = lambda a, b: spark.range(1).select(dialect.typed_less(a, b)).first()[0]
    assert less(c(F.lit(5)), c(text=F.lit("a"))) is True and less(c(text=F.lit("z")), c(blob=F.lit(b"a"))) is True
    assert less(c(), c(F.lit(1))) is None and less(c(text=F.lit("10")), c(F.lit(9))) is False


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.tokens(F.lit("parseHTTPResponse snake_case_x 12 345"))) == ["parsehttpresponse", "parse", "http", "response", "snake_case_x", "snake", "case", "345"]
    assert one(tx.trigram_jaccard(F.lit("abcd"), F.lit("bcde"))) == pytest.approx(1 / 3) and one(tx.trigram_jaccard(F.lit("ab"), F.lit("abc"))) == 0
    assert one(tx.epistemic_status(F.lit("I think it is confirmed"))) == "estimate" and one(tx.epistemic_status(F.lit("measured"))) == "fact" and one(tx.epistemic_status(F.lit(" "))) == "unknown"
    assert tx.date_mentions("in March, 3rd of May 2024 or 2025-02") == [tx.DateMention(2025, 2), tx.DateMention(2024, 5, 3)]
    assert one(tx.tools_of(tx.tools_trailer(F.array(*[F.lit(f"t{i}") for i in range(10)])))) == [f"t{i}" for i in range(8)]
    assert one(tx.scrub_secrets(F.lit("a\npassword: hunter2hunter2\nb"))) == "a\n[redacted]\nb"
    assert one(tx.entity_anchors(F.lit("see `load_all` and @some_one in Velmouth via myClass"))) == ["load_all", "some_one", "myclass", "velmouth"]


def test_classifiers_of_other_scripts(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.is_correction(F.lit("Нет, правильно иначе"))) and one(tx.is_correction(F.lit("НА САМОМ ДЕЛЕ так"))) and not one(tx.is_correction(F.lit("правильно")))
    assert one(tx.cue_intent(F.lit("как это было"))) is None and one(tx.cue_intent(F.lit("изначальный текст"))) == "historical_verbatim"
    assert one(tx.cue_intent(F.lit("вспомни, как было ранее"))) is None and one(tx.cue_intent(F.lit("напомни, что было ранее"))) == "historical_verbatim"
    assert one(tx.cue_mode(F.lit("найди дословно это"))) == "verbatim"
    v = one(tx.injection(F.lit("忽略 это"), F.lit("zh")))
    assert v.detected and v.severity == "strong" and v.confidence == 0.9 and v.matched == ["忽略"] and not one(tx.injection(F.lit("忽略"), F.lit("de"))).detected
    assert [one(tx.shield_action(tx.injection(F.lit("please override")), t)) for t in ("hard_block", "flag", "log")] == ["reject", "flag", "log_allow"]
    assert one(tx.entity_anchors(F.lit("пишет Велмут из кто-то и мод_три, это Потом"))) == ["мод_три", "велмут"]
    assert [one(tx.identifier_shaped(F.lit(x))) for x in ("v2", "_1", "x_1", "12", "plain")] == [True, False, True, False, False]


def test_vector_functions(spark):
    r = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [float("nan"), 1.0], [0.0, 0.0])], "a array<float>, b array<float>, c array<float>, z array<float>")
    x = r.select(vec.cosine(F.col("a"), F.col("b")).alias("cos"), vec.sanitized(F.col("c")).alias("s"), vec.cosine(F.col("a"), F.col("z")).alias("zero"), vec.quantized(F.col("a"))["values"].alias("q")).first()
    assert x.cos == pytest.approx(0.96) and x.s == [0.0, 1.0] and x.zero == 0 and x.q == [95, 127]


def test_hypervector_majority_tie_and_phases(spark):
    import numpy as np

    bits = np.zeros((2, 128), bool)
    bits[0, :64] = True
    rows = [("g", w.tolist()) for w in hd.to_words(bits)]
    hv = hd.bundled(spark.createDataFrame(rows, "g string, hv array<long>"), "g", "hv", 128).first()
    assert hv.n == 2 and hv.hv == [-1, 0]  # an even split is 1
    one = lambda c: spark.range(1).select(c).first()[0]
    a, b = F.array(F.lit(250), F.lit(3)), F.array(F.lit(10), F.lit(255))
    assert one(hd.phase_bind(a, b)) == [4, 2] and one(hd.phase_unbind(hd.phase_bind(a, b), b)) == [250, 3]
    assert one(hd.sparse_similarity(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == pytest.approx(1 / 3)


def test_hypervectors_change_and_replay(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    w = hd.to_words(rng.integers(0, 2, (5, 256)).astype(bool))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(w)], "key long, hv array<long>")
    v = df.select("key", "hv", hd.with_pair(F.col("hv"), "subject", "a", 256).alias("one"), hd.with_role(hd.with_pair(F.col("hv"), "subject", "a", 256), "subject", "a", "b", 256).alias("two"), hd.with_pair(F.col("hv"), "subject", "b", 256).alias("b"))
    x = v.select(hd.hamming(F.col("two"), F.col("b")).alias("same"), hd.hamming(F.col("one"), F.col("b")).alias("apart"), hd.hamming(hd.with_pair(F.col("one"), "subject", "a", 256), F.col("hv")).alias("back")).first()
    assert (x.same, x.back) == (0, 0) and x.apart > 60
    assert {tuple(r.hv) for r in hd.replayed(df, "key", "hv", 0.0, 3, 256).collect()} == {tuple(r.hv) for r in df.collect()}
    a, b = hd.replayed(df, "key", "hv", 0.1, 3, 256), hd.replayed(df.repartition(3), "key", "hv", 0.1, 3, 256)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    flipped = [r[0] for r in a.toDF("key", "n").join(df, "key").select(hd.hamming(F.col("n"), F.col("hv"))).collect()]
    assert 5 <= sum(flipped) / 5 <= 50
    t = rng.integers(0, 2, 512).astype(np.uint8)
    assert hd.separated(t, np.empty((0, 512), np.uint8)) is t and (hd.separated(t, t[None, :], 0.97) != t).sum() == 16


def test_scratch_tables_go_at_the_end(spark):
    import os

    from engrava.storage import materialize, scratch

    with scratch(spark):
        t = materialize(spark.range(5))
        assert t.count() == 5 and os.path.isdir(t._engrava_path)
    assert not os.path.exists(t._engrava_path)
    kept = materialize(spark.range(5))
    assert os.path.isdir(kept._engrava_path)


def test_first_share_is_the_first_rows(spark):
    from engrava.operators.analytics import first_share

    df = spark.range(1003).select("id", (F.col("id") * 7 % 10).alias("v"))
    want = sorted(range(1003), key=lambda i: (-(i * 7 % 10), i))
    for share, n in ((0.1, 101), (0.0, 1), (1.0, 1003)):
        assert sorted(r.id for r in first_share(df, share, F.desc("v"), F.asc("id")).collect()) == sorted(want[:n])
    assert first_share(df.limit(0), 0.1, F.desc("v"), F.asc("id")).count() == 0


def test_uses_take_the_next_reply(spark):
    from engrava.operators.cofire import transcript_uses, use_pairs

    block = "struct<type: string, text: string, content: string>"
    hits = '{"hits": [{"record_id": "a", "score": 1, "literal_surface": "red fox"}, {"record_id": "b", "score": 1, "literal_surface": "blue sky"}, {"record_id": "c", "score": 1, "literal_surface": "old oak"}]}'
    rows = [(1, "s", ("user", [("tool_result", None, hits)])), (2, "s", ("assistant", [("text", " ", None), ("text", "the old oak, then a red fox", None)])), (3, "s", ("assistant", [("text", "blue sky", None)])), (4, "t", ("user", [("tool_result", None, hits)])), (5, "t", ("assistant", [("text", "old oak by a red fox", None)]))]
    df = spark.createDataFrame(rows, f"row_id long, sessionId string, message struct<role: string, content: array<{block}>>")
    uses = transcript_uses(df)
    assert sorted((r.row_id, tuple(r.used)) for r in uses.collect()) == [(1, ("c", "a")), (4, ("c", "a"))]
    assert [tuple(r) for r in use_pairs(uses).collect()] == [("c", "a", 2, 2)]


def test_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<html><head><title>t</title></head><body><p>One &amp; two</p><script>x()</script><div>three</div></body></html>")
    (tmp_path / "b.csv").write_text("x,y\n1,\"2,3\"\n")
    (tmp_path / "c.docx").write_bytes(b"not a zip")
    (tmp_path / "d.bin").write_bytes(b"\0")
    good, bad = files.split_errors(files.documents(spark, str(tmp_path)))
    assert sorted(r.text for r in good.collect()) == ["One & two\nthree", "x | y\n1 | 2,3"] and bad.count() == 1
    (tmp_path / "t").mkdir()
    (tmp_path / "t/x.jsonl").write_text('{"a": 1}\n{broken\n{"a": 2}\n')
    rows, lines = files.transcript_table(spark, str(tmp_path / "t"), "a int")
    assert sorted(r.a for r in rows.select("a").collect()) == [1, 2] and [r.line for r in lines.collect()] == ["{broken"]


def test_token_chunks_cover_the_text_with_overlap(spark):
    import os

    from engrava.functions.tokenizer import token_spans, tokenizer_path

    if not os.path.exists(tokenizer_path()):
        pytest.skip("no vocabulary here")
    text = " ".join(f"Sentence number {i} says naïve things, ünïcödé 漢字 too." for i in range(200))
    spans = token_spans(tokenizer_path())(text)
    assert spans[0][0] == 0 and spans[-1][1] == len(text) and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    df = spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, "  "), (5, "just long enough")], "k int, t string")
    got = [(r.key, r.chunk) for r in lex.token_chunked(df, "k", "t").orderBy("key", "chunk_no").collect()]
    chunks = [c for k, c in got if k == 1]
    assert [c for k, c in got if k != 1] == ["just long enough"] and len(chunks) > 5
    at = 0
    for c in chunks:
        here = text.find(c)
        assert 0 <= here <= at and c.endswith(".") and (c is chunks[-1] or 100 < len(token_spans(tokenizer_path())(c)) <= 257)
        at = here + len(c)
    assert at == len(text)


def test_chunks_overlap_and_short_tails(spark):
    text = " ".join(f"w{i}." if i % 10 == 9 else f"w{i}" for i in range(100))
    got = [r.chunk for r in lex.chunked(spark.createDataFrame([(1, text), (2, "short"), (3, None)], "k int, t string"), "k", "t", 30, 6).orderBy("chunk_no").collect()]
    assert got[0].startswith("w0") and got[0].endswith("w19.") and got[1].startswith("w14") and got[-1].endswith("w99.")


def test_used_hits(spark):
    from engrava.operators.cofire import use_pairs, used_hits

    hits = [("a", 0.9, "alpha beta"), ("b", 0.8, "beta"), ("c", 0.7, "gamma (x)"), ("d", 0.6, None)]
    rows = [(1, hits, "so gamma (x), then alpha beta."), (2, hits, "alpha beta and beta"), (3, hits[:1], "alpha beta"), (4, hits, None), (5, None, "alpha beta"), (6, hits[:2], "beta alpha beta")]
    df = spark.createDataFrame(rows, "i int, hits array<struct<record_id: string, score: double, literal_surface: string>>, reply string")
    got = df.select("i", used_hits(F.col("hits"), F.col("reply")).alias("used"))
    assert {r.i: r.used for r in got.collect()} == {1: ["c", "a"], 2: ["a", "b"], 3: [], 4: [], 5: [], 6: ["b", "a"]}
    assert {(r.a, r.b, r.n) for r in use_pairs(got.withColumn("session", F.lit("s"))).collect()} == {("c", "a", 1), ("a", "b", 1), ("b", "a", 1)}
