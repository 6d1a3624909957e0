import math

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import fusion, lexical, metrics, segments, spans, stats, vectors


def docs(spark, **texts):
    return spark.createDataFrame([(k, v.split()) for k, v in texts.items()], "doc_id string, tokens array<string>")


def ranking(spark, *items):
    return spark.createDataFrame([("q", d, i, 1.0 / i) for i, d in enumerate(items, 1)], "query_id string, doc_id string, rank int, score double")


def order(df):
    return [r.doc_id for r in df.orderBy("query_id", "rank").collect()]


def test_text_scalars(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "v string").select(c(F.col("v")).alias("r")).first().r
    assert one(T.words, "Ab 가나_1 é!") == ["ab", "가나_1", "é"]
    assert one(T.bigrams, "a b c") == ["ab", "bc"] and one(T.bigrams, "a") == [] and one(T.bigrams, "") == []
    assert one(T.compact_bigrams, "가") == ["가"] and one(T.trigrams, "abcabc") == ["abc", "bca", "cab"]
    assert one(T.words_and_bigrams, "가나다 ab") == ["가나다", "가나", "나다", "ab"]
    assert one(T.hangul_share, "") == 1.0 and one(T.hangul_share, "가a") == 0.5
    for v, want in {"x_20240101(3)": "20240101", "x_230404(2)": "20230404", "x_20240101_230404": None, "x_1701011": None}.items():
        assert one(T.strict_date, v) == want
    assert one(lambda c: T.only_one_of(c, ("a", "b")), "xa") == "a" and one(lambda c: T.only_one_of(c, ("a", "b")), "ab") is None
    assert one(T.words, None) is None


def test_bm25(spark):
    d = docs(spark, d1="red fox fox", d2="blue dog", d3="red")
    q = docs(spark, q="fox red red").withColumnRenamed("doc_id", "query_id")
    n, avg = 3, 2.0
    idf = lambda df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    tf = lambda t, dl: t * 2.5 / (t + 1.5 * (0.25 + 0.75 * dl / avg))
    got = {r.doc_id: r.score for r in lexical.bm25(d, q).collect()}
    assert got == pytest.approx({"d1": idf(1) * tf(2, 3) + 2 * idf(2) * tf(1, 3), "d3": 2 * idf(2) * tf(1, 1)}, abs=1e-5)
    assert order(lexical.bm25_all_candidates(d, q)) == ["d1", "d3", "d2"]
    assert lexical.bm25(d.limit(0), q).count() == 0 == lexical.bm25(d, q.limit(0)).count()
    f = spark.createDataFrame([("a", "t", ["x", "y"]), ("a", "b", ["z"]), ("b", "t", ["z"]), ("b", "b", ["x", "y"])], "doc_id string, field string, tokens array<string>")
    qq = docs(spark, q="x y").withColumnRenamed("doc_id", "query_id")
    assert order(lexical.bm25f(f, qq, {"t": 1.0, "b": 0.01}, {"t": 0.5, "b": 0.5}))[0] == "a"
    assert order(lexical.bm25f(f, qq, {"t": 0.01, "b": 5.0}, {"t": 0.5, "b": 0.5}))[0] == "b"


def test_fusion(spark):
    a, b = ranking(spark, "1", "2", "3"), ranking(spark, "3", "2", "1")
    assert order(fusion.rrf({"a": a, "b": b})) == ["1", "3", "2"]
    assert order(fusion.rrf({"a": b, "b": a}, first_seen=True)) == ["3", "1", "2"]
    second = ranking(spark, "40", "30", "20", "10")
    assert order(fusion.rerank_head(ranking(spark, "10", "20", "30", "40"), second, 2)) == ["20", "10", "30", "40"]
    assert order(fusion.rerank_head(ranking(spark, "10", "20", "30", "40"), second, 10)) == ["40", "30", "20", "10"]
    r = ranking(spark, "0", "1", "2", "3").withColumn("ok", F.col("doc_id").isin("1", "3"))
    by = lambda depth: [x.doc_id for x in fusion.verified_first(r, F.col("ok"), depth).orderBy("new_rank").collect()]
    assert by(3) == ["1", "0", "2", "3"] and by(4) == ["1", "3", "0", "2"]
    base = ranking(spark, "e1", "e2", "e3", "e4").withColumn("unit", F.when(F.col("doc_id").isin("e1", "e2"), "j1").otherwise(F.col("doc_id")))
    assert order(fusion.preserve_prefix(base, ranking(spark, "e9"), 2)) == ["e1", "e2", "e3", "e9", "e4"]
    with pytest.raises(ValueError, match="unknown mode"):
        fusion.normalized(a, "x")


def test_metrics(spark):
    gold = lambda *ds: spark.createDataFrame([("q", d) for d in ds], "query_id string, doc_id string")
    m = metrics.rank_suite(ranking(spark, "a", "b", "c", "d"), gold("a", "d", "z"), (2, 4)).first()
    assert (m.r2, m.r4, m.hit2, m.first_rank) == (0.333333, 0.666667, 1, 1)
    m = metrics.rank_suite(ranking(spark, "3", "7", "9"), gold("7")).first()
    assert (m.hit1, m.hit5, m.rr10, m.ndcg10) == (0, 1, 0.5, round(1 / math.log2(3), 6))
    m = metrics.rank_suite(ranking(spark, "2", "5", "1"), gold("1", "2")).first()
    assert m.ndcg10 == round((1 + 0.5) / (1 + 1 / math.log2(3)), 6) and m.r5 == 1.0
    none = metrics.rank_suite(ranking(spark, "x").limit(0), gold("1")).first()
    assert (none.hit5, none.rr10, none.ndcg10, none.first_rank) == (0, 0.0, 0.0, None)
    g = gold("a", "b", "c").withColumn("gain", F.when(F.col("doc_id") == "a", 2.0).otherwise(1.0))
    assert metrics.ndcg_graded(ranking(spark, "a", "b", "c"), g, 3).first().ndcg == 1.0 > metrics.ndcg_graded(ranking(spark, "c", "b", "a"), g, 3).first().ndcg


def test_statistics(spark):
    p = lambda b, c: spark.createDataFrame([(b, c)], "b int, c int").select(stats.binomial_two_sided(F.col("b"), F.col("c")).alias("p")).first().p
    assert p(1, 3) == pytest.approx(0.625) and p(0, 8) == pytest.approx(2 / 256) and p(0, 0) == 1.0
    same = spark.range(50).select("id", F.lit(0.5).alias("v"))
    b = stats.bootstrap(same, "id", "v", 50).first()
    assert b.low == pytest.approx(0.5) == b.high and b.mean == 0.5 and b.n == 50
    x = spark.range(40).select("id", F.lit(0.8).alias("a"), F.lit(0.5).alias("b"))
    s = stats.sign_flip(x, "id", "a", "b", 200).first()
    assert s.mean_difference == pytest.approx(0.3) and s.p < 0.05
    t = spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", 0.03)], "name string, p double")
    assert {r.name: r.adjusted for r in stats.holm(t).collect()} == {"x": 0.03, "z": 0.06, "y": 0.06}


def test_spans(spark):
    u = spark.createDataFrame([("d", "j1", 0, 100), ("d", "j2", 100, 200), ("d", "all", 0, 3000)], "doc string, unit_id string, u0 int, u1 int")
    s = spark.createDataFrame([("d", "s", 20, 80), ("d", "t", 2990, 3010)], "doc string, span_id string, c0 int, c1 int")
    assert {(r.span_id, r.unit_id, r.how) for r in spans.smallest_containing(u, s).collect()} == {("s", "j1", "contained"), ("t", "all", "split")}
    two = spans.smallest_containing(u.where("unit_id != 'all'"), spark.createDataFrame([("d", "s", 80, 120)], s.schema))
    assert {(r.unit_id, r.s0, r.s1) for r in two.collect()} == {("j1", 80, 100), ("j2", 100, 120)}
    m = spans.merged(spark.createDataFrame([("d", 0, 10), ("d", 1, 3), ("d", 15, 20), ("d", 50, 60)], "k string, c0 int, c1 int"), "k", 6)
    assert {(r.c0, r.c1, r.n) for r in m.collect()} == {(0, 20, 3), (50, 60, 1)}
    chain = spark.createDataFrame([(f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("x", "y")], "a string, b string")
    assert {r.component for r in spans.components(chain).collect()} == {"n000", "x"}
    decl = spark.createDataFrame([("k1", "j2"), ("k2", "j3"), ("k3", "a"), ("k3", "b")], "key string, target string")
    refs = spark.createDataFrame([("j1", "k1"), ("j2", "k2"), ("j1", "k3")], "source string, key string")
    assert {tuple(r) for r in spans.reference_paths(decl, refs).collect()} == {("j1", "j2", 1), ("j2", "j3", 1), ("j1", "j3", 2)}


def test_vectors(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.1]), (2, [0.0, 1.0]), (3, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.doc_id for r in vectors.nearest(v, v.where("vec_id = 0"), 5).orderBy("rank").collect()] == [1, 2]
    a = vectors.audit(v).first()
    assert (a.n, a.zero, a.with_nan) == (4, 1, 0)
    full = ranking(spark, *"abcdefghij")
    got = vectors.backfill(full, full.where("rank <= 3").select("query_id", "doc_id"), 3).orderBy("rank").collect()
    assert [(r.doc_id, r.rank) for r in got] == [("d", 4), ("e", 5), ("f", 6)]


def test_segments(spark):
    s = "첫 문장이다. " * 60 + "x" * 1300
    got = segments.sentence_spans(s, 512, 80)
    assert all(80 <= b - a <= 512 for a, b in got) and got[0][0] == 0
    b = segments.boundary_spans(s, 600, 100)
    assert b[0][0] == 0 and b[-1][1] == len(s) and all(y[0] < x[1] for x, y in zip(b, b[1:], strict=False)) and all(q - p <= 600 for p, q in b)
    d = spark.createDataFrame([(1, "제목 문단이 충분히 길어서 남는다 확실히\n\n짧음\n\n다음 문단도 충분히 길어서 따로 남는다"), (2, "")], "doc_id long, text string")
    assert [r.paragraph.count("\n") for r in segments.paragraphs(d).orderBy("no").collect()] == [1, 0]
    t = spark.createDataFrame([(1, "| a | b |\n|---|---|\n| k | 1 |\n| k | 2 |")], "element_id long, text string")
    assert [(r.key, r.cells) for r in segments.table_rows(t).orderBy("row_no").collect()] == [("1", "k | 1"), ("2", "k | 2")]
