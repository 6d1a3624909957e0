"""Queries against the survey's definition where their own SQL states less."""

import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tests.test_queries import DIR, rows_of
from textloom.queries import DOCS2, QUESTIONS2, bm25_parts, ranked_sql


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(DIR).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def test_bigram_candidates_score_bigrams(spark, db):
    every = "SELECT query_id, doc_id, coalesce(score, 0.0) AS score FROM (SELECT query_id FROM q) CROSS JOIN (SELECT doc_id FROM d) LEFT JOIN s USING (query_id, doc_id)"
    r = db.sql("WITH " + bm25_parts(DOCS2, QUESTIONS2, 1.2, 0.75, True, 1) + " " + ranked_sql(every, 10))
    df = entry.queries()["bm25_bigram_candidates"](spark, DIR)
    assert rows_of(df.columns, df.collect()) == rows_of(r.columns, r.fetchall())


def test_offset_map_has_no_limit(spark, db):
    asked = db.sql("SELECT item_id, question FROM eval_items WHERE question IS NOT NULL").fetchall()
    want = {k: ",".join(str(i) for i, c in enumerate(q) if not c.isspace()) for k, q in asked}
    assert {r.item_id: r.value for r in entry.queries()["str_offset_map"](spark, DIR).collect()} == want
    assert any(v.count(",") >= 50 for v in want.values())


def _core(v):
    v = re.sub(r"\(무배당[^)]*\)|\(간편\)|해약환급금\s*미지급형|갱신형|일반형", "", v)
    v = re.sub("[^가-힣a-z0-9]", "", v.lower()).replace("특약", "")
    return v.replace("허혈성심장질환", "허혈심장질환").replace("대상포진진단", "대상포진통풍진단")


def _fuzzy(scope, text):
    q, t = _core(scope or ""), _core(text or "")
    if not q or not t:
        return False
    if q in t or t in q:
        return True
    g = {q[i : i + 3] for i in range(len(q) - 2)}
    return min(len(q), len(t)) >= 5 and q[:3] in t and q[-4:] in t and sum(x in t for x in g) / len(g) >= 0.72


def test_fuzzy_contains_by_brute_force(spark, db, tmp_path):
    own = [("short", "암", "암 진단"), ("back", "가나다라마 보장특약", "다라마"), ("part", "가나다라마바사아자차카타파하", "가나다라마바사아자X차카타파하"), ("far", "가나다라마바사", "가나다 라마 X 라마바사"), ("no head", "가나다라마바사아자차카타파하", "X다라마바사아자차카타파하"), ("variant", "가나 (무배당 1종) 특약", "가나"), ("blank", "특약", "가나"), ("none", None, "가나")]
    spark.createDataFrame([(k, "d", c, t) for k, c, t in own], "element_id string, document_key string, contract_scope string, text string").write.parquet(f"{tmp_path}/elements.parquet")
    spark.createDataFrame([("d", "x")], "doc_id string, doc_type string").write.parquet(f"{tmp_path}/doc_facts.parquet")
    f = entry.queries()["predicate_fuzzy_contains"]
    got = {r.element_id for r in f(spark, str(tmp_path)).collect()}
    assert got == {k for k, c, t in own if _fuzzy(c, t)} and {"short", "back", "part", "variant"} <= got
    rows = db.sql("SELECT element_id, contract_scope, doc_type, text FROM elements a JOIN doc_facts b ON a.document_key = b.doc_id").fetchall()
    assert sorted(map(str, map(tuple, f(spark, DIR).collect()))) == sorted(str(r[:3]) for r in rows if _fuzzy(r[1], r[3]))
