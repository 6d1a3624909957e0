"""Sequential operators against their definitions on small inputs."""

import random

import numpy as np
import pandas as pd
import pytest

from textloom.operators import matching, sequences as S
from textloom.queries_checked import gates
from pyspark.sql import functions as F


def text(seed, n=400):
    r = random.Random(seed)
    return "".join(r.choice(["가나다 ", "단어. ", "끝!\n", "문단\n\n", "제3조 (뜻)\n", "| a | b |\n", "b", "길고긴낱말"]) for _ in range(n))


@pytest.mark.parametrize("seed", range(6))
def test_ranges_cover_the_text(seed):
    s = text(seed, 30 + 150 * seed)
    parts = S.recursive_ranges(s)
    assert "".join(s[a:b] for a, b, _ in parts) == s
    assert all(b - a <= 600 for a, b, _ in parts)
    assert len(parts) == 1 or min(b - a for a, b, _ in parts) >= 190
    wide = S.with_overlap(parts)
    assert all(w[1] == p[1] and w[0] == max(0, p[0] - 100) for w, p in zip(wide, parts, strict=True))
    mixed = S.limit_heads(s, parts)
    assert "".join(s[a:b] for a, b, _ in mixed) == s and all(len(S._HEAD.findall(s[a:b])) <= 3 for a, b, _ in mixed)


@pytest.mark.parametrize("cut", [S.sections, S.repaired])
def test_sections_cover_the_text(cut):
    for seed in range(4):
        s = text(seed, 900)
        parts = cut(s)
        assert "".join(s[a:b] for a, b, _ in parts) == s
        assert all(b - a <= 4000 for a, b, _ in parts)
    assert cut("") == [] and [x[:2] for x in S.repaired("짧다")] == [(0, 2)]


def test_markdown_blocks():
    s = "# 제목\n\n문장이 끊\n- 3 -\n긴다.\n\n다음 문단.\n| a | b |\n| 1 | 2 |\n```\n코드 # 아님\n\n```\n$$ x $$\n끝.\n"
    got = [(k, s[a:b]) for a, b, k in S.markdown_blocks(s)]
    assert [k for k, _ in got] == ["heading", "paragraph", "paragraph", "table", "fence", "formula", "paragraph"]
    assert got[1][1] == "문장이 끊\n- 3 -\n긴다.\n" and got[4][1].count("```") == 2
    long = "| x |\n" * 2000
    assert all(b - a <= 4000 and long[a:b].endswith("\n") for a, b, _ in S.markdown_blocks(long))


def test_packs(spark):
    rows = [("d", "s", "text", i, 1500) for i in range(4)] + [("d", "t", "text", 4, 10), ("d", "t", "heading", 5, 10), ("d", "t", "text", 6, 9000), ("e", "s", "text", 0, 5)]
    got = S.packed(spark.createDataFrame(rows, "document_key string, scope string, kind string, at int, chars int")).collect()
    assert sorted((r.document_key, r.pack, r.units, r.chars) for r in got) == [("d", 0, 2, 3000), ("d", 1, 2, 3000), ("d", 2, 1, 10), ("d", 3, 1, 10), ("d", 4, 1, 9000), ("e", 0, 1, 5)]


def test_labels_of_tables(spark):
    rows = [("d", "l", "text", "별표 1", 1, 2), ("d", "t1", "table", None, 5, 9), ("d", "t2", "table", None, 17, 20), ("d", "t3", "table", None, 40, 41), ("d", "t4", "table", None, 42, 43), ("e", "t5", "table", None, 3, 4)]
    got = S.labelled_tables(spark.createDataFrame(rows, "document_key string, element_id string, kind string, label string, line_start int, line_end int")).collect()
    assert sorted(tuple(r) for r in got) == [("t1", "별표 1"), ("t2", "별표 1")]


def test_orders_of_rankings():
    base = "같은 글이 여기 있다 그리고 더 이어진다"
    p = pd.DataFrame({"doc_id": [1, 2, 3, 4], "text": [base, base, base + " 특이", "딴 글"], "question": ["무엇 특이"] * 4, "family": ["f", "f", "f", "g"], "base": ["b", "b", "b", "c"], "title": ["", "", "", ""]})
    assert S.family_last(0.7)(p) == [0, 2, 3, 1]
    assert S.cover_top(top=5, most=1)(p) == [0, 3, 1, 2]
    r = pd.DataFrame({"doc_id": [1, 2, 3, 1, 4, 5], "source": [0, 0, 0, 1, 1, 1], "place": [1, 2, 3, 1, 2, 3], "unit": ["a", "a", "b", "a", "c", "d"]})
    assert [int(r.doc_id[i]) for i in S.quota((1, 1), 3)(r)] == [1, 4, 3]


def test_bca_against_percentile():
    x = np.random.default_rng(3).normal(0.2, 1, 400)
    low, high = S.bca(x, draws=4000)
    plain = np.quantile(S.paired_bootstrap(x, 7, 4000), [0.025, 0.975])
    assert abs(low - plain[0]) < 0.03 and abs(high - plain[1]) < 0.03
    skewed = np.random.default_rng(3).exponential(1, 60)
    assert S.bca(skewed)[1] > np.quantile(S.paired_bootstrap(skewed, 7, 2000), 0.975)
    assert S.bca(np.ones(5)) == (1.0, 1.0)


def test_contained_is_a_plain_search(spark):
    r = random.Random(1)
    t = ["".join(r.choice("ab") for _ in range(12)) for _ in range(30)] + ["", "a"]
    p = ["".join(r.choice("ab") for _ in range(n)) for n in (3, 4, 5, 6) for _ in range(4)]
    a, b = spark.createDataFrame([(x,) for x in t], "t string"), spark.createDataFrame([(x,) for x in p], "p string")
    want = sorted((x, y) for x in t for y in p if y in x)
    for head in (1, 3):
        assert sorted((x.t, x.p) for x in matching.contained(a, "t", b, "p", head).collect()) == want


def test_refusals(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "answer: y")], "id int, part string, text string")
    with pytest.raises(ValueError):
        matching.refuse(df, "id", "text")
    assert matching.refuse(df.where("id = 1"), "id", "text").count() == 1
    was = matching.frozen(df, "part", ["id", "text"])
    assert matching.refuse_changed(df, was, "part", ["id", "text"]).count() == 2
    for changed in (df.withColumn("text", F.lit("z")), df.where("id = 1"), df.unionByName(df)):
        with pytest.raises(ValueError):
            matching.refuse_changed(changed, was, "part", ["id", "text"])
    with pytest.raises(ValueError):
        gates(F.col("text"), ["duration", "no such gate"])
    old = spark.createDataFrame([("o1", 0, "a"), ("o2", 0, "b")], "id string, k int, t string")
    new = spark.createDataFrame([("n1", 0, "a"), ("n2", 1, "a")], "e string, k int, t string")
    got = {r.e: r.id for r in matching.stable_ids(new, old, ["k", "t"]).collect()}
    assert got["n1"] == "o1" and got["n2"].startswith("n-") and len(got["n2"]) == 18
    with pytest.raises(Exception, match="occurs twice"):
        matching.stable_ids(new, old.unionByName(old), ["k", "t"]).collect()


def test_skeletons_are_lossless(spark):
    from textloom.operators import skeletons

    texts = ["지급 사유는 30일 이내, 금액 100만원.", "지급 사유는 90일 이내, 금액 200만원.", "지급 사유는 180일 이내, 금액 200만원."]
    frame = skeletons.skeleton(texts)
    for t in texts:
        assert skeletons.filled(frame, skeletons.gaps(t, frame)) == t
    assert "사유는" in frame and "30일" not in frame
    df = spark.createDataFrame([("k", f"v{i}", t) for i, t in enumerate(texts)] + [("k", "v9", None), ("one", "v", "a b")], "key string, version string, text string")
    made = skeletons.induced(df, "key", "version", "text")
    assert made.where("lossless").count() == made.count() == 4
    kinds = {(r.kind, r["values"]) for r in skeletons.key_values(made).collect()}
    assert kinds == {("period", 3), ("amount", 2)}


def test_tags_on_axes():
    from textloom.queries_ranks import adapt

    got = adapt({"a": {"subject": ["x", {"deep": "y"}], "flag": True, "none": None}, "n": 3, "skip": {"subject": "z"}}, {"subject": "s"}, frozenset({"skip"}))
    assert got == {"s": ["x", "y"], "extra": ["3"]}


def test_alignment_of_answers(spark):
    from textloom.queries_ranks import aligned

    rows = [('[{"i":2,"v":"b"},{"i":1,"v":"a"}]', 2), ('[{"v":"a"},{"v":"b"}]', 2), ('[{"i":1,"v":"a"}]', 2), ('[{"i":1,"v":"a"},{"i":3,"v":"b"}]', 2), ("no json", 1), (None, 0), ("[]", 0)]
    df = spark.createDataFrame(rows, "said string, n int")
    assert [r.y for r in df.select(aligned(F.col("said"), F.col("n")).alias("y")).collect()] == [["a", "b"], ["a", "b"], None, None, None, None, []]
