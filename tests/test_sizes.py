"""Jobs whose rows or time grew with the product of two tables, on small tables that show it."""

import time

import pytest

import __spark_entry__ as entry
from tests.test_queries import rows_of


def written(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def by_sql(folder, name, *tables):
    import duckdb

    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    r = c.sql(entry.oracle_sql()[name])
    return rows_of(r.columns, r.fetchall())


CHUNKS, GOLD = "chunk_id string, contract_scope string, text string", "qid string, gold_chunk_ids array<string>"


def test_gold_occurrences_by_sql(spark, tmp_path):
    head = "가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허고노"
    chunks = [(f"c{i:02}", "s", f"{'x' * (i % 5)} {head} {i}") for i in range(0, 30)]  # some hold it inside
    chunks += [("c05", "s", head + " again"), ("c05", "r", head[::-1] + "!"), ("z", "r", "- " + head[::-1]), ("far", "r", head), ("short", "s", head[:29]), ("none", "s", None), ("alone", None, head), (None, "s", head)]
    gold = [("q1", ["c05", "c29", "short"]), ("q2", ["c25", "none", "alone", None]), ("q2", ["c00", "missing"]), (None, ["c00"]), ("q3", None)]
    d = written(spark, tmp_path, chunks=(chunks, CHUNKS), train350_gold=(gold, GOLD))
    df = entry.queries()["gold_occurrence_expand"](spark, d)
    assert rows_of(df.columns, df.collect()) == by_sql(d, "gold_occurrence_expand", "chunks", "train350_gold")


def test_gold_occurrences_of_a_common_beginning(spark, tmp_path):
    n, head = 6000, "가나다라마바사아자차카타파하거너더러머버서어저처커터퍼허고노"
    d = written(spark, tmp_path, chunks=([(f"c{i:04}", "s", f"{head}{i}") for i in range(n)], CHUNKS), train350_gold=([(f"q{i}", [f"c{i:04}"]) for i in range(n)], GOLD))
    began = time.time()
    rows = entry.queries()["gold_occurrence_expand"](spark, d).collect()
    assert len(rows) == 10 * n and time.time() - began < 40


@pytest.mark.parametrize("name", ["str_trigrams", "tokenize_char_bigram_compact"])
def test_grams_of_odd_texts_by_sql(spark, tmp_path, name):
    rows = [("long", "가나 다라-마바사 " * 30), ("one", " 가 "), ("two", "가-나"), ("astral", "가😀나\n다"), ("empty", ""), ("none", None)]
    d = written(spark, tmp_path, elements=(rows, "element_id string, text string"))
    df = entry.queries()[name](spark, d)
    assert rows_of(df.columns, df.collect()) == by_sql(d, name, "elements")


@pytest.mark.parametrize(("name", "value"), [("str_trigrams", 7), ("tokenize_char_bigram_compact", "|".join(["가나", "나다", "다라", "라마", "마바", "바사", "사가"] * 8_000)[:-3])])
def test_grams_of_a_long_text(spark, tmp_path, name, value):
    d = written(spark, tmp_path, elements=([("long", "가나 다라-마바사 " * 8_000)], "element_id string, text string"))
    began = time.time()
    rows = entry.queries()[name](spark, d).collect()
    assert [r.value for r in rows] == [value] and time.time() - began < 20


FIELDS = "element_id string, locator struct<article: string, article_title: string, section: string>"


def test_locators_of_many_questions(spark, tmp_path, monkeypatch):
    from textloom.operators import scoring

    monkeypatch.setattr(scoring, "QUERIES", 200)
    n, same = 500, "가나다라마바사아자차카타파하거너더러머버서어저처"
    own = lambda i: "".join(chr(0x4E00 + 20 * i + j) for j in range(20))
    fields = [(f"e{i}", (same, own(i), None)) for i in range(n)] + [("short", ("가나", None, None)), ("none", None)]
    gold = [(f"q{i}", f"{own(i)[:8]} {same}") for i in range(n)] + [("q0", own(1)), ("q1", None), (None, same)]
    d = written(spark, tmp_path, element_semantic_fields_v4=(fields, FIELDS), train350_gold=(gold, "qid string, question string"))
    began = time.time()
    df = entry.queries()["locator_coverage_bonus"](spark, d)
    got = rows_of(df.columns, df.collect())
    assert time.time() - began < 60
    assert got == by_sql(d, "locator_coverage_bonus", "element_semantic_fields_v4", "train350_gold") and len(got[1]) > n


def test_locators_in_one_plan(spark, tmp_path, monkeypatch):
    """The driver held a part of the plan and a broadcast for every block of questions."""
    from textloom.operators import scoring, tiles

    monkeypatch.setattr(scoring, "QUERIES", 10)
    monkeypatch.setattr(tiles, "PAIRS", 300, raising=False)
    n = 60
    fields = [(f"e{i}", (f"제{i}조", f"입원보험금의 지급사유 {i % 7}", None)) for i in range(n)]
    gold = [(f"q{i % 50}", f"제{i}조에 입원보험금 지급사유 {i % 7}이 있습니까") for i in range(n)]
    d = written(spark, tmp_path, element_semantic_fields_v4=(fields, FIELDS), train350_gold=(gold, "qid string, question string"))
    df = entry.queries()["locator_coverage_bonus"](spark, d)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and "Broadcast" not in plan
    assert rows_of(df.columns, df.collect()) == by_sql(d, "locator_coverage_bonus", "element_semantic_fields_v4", "train350_gold")


def test_named_contracts_by_comparison(spark, tmp_path, monkeypatch):
    import random

    from textloom import queries_ranks as R

    monkeypatch.setattr(R, "NAMES", 40)
    rng = random.Random(5)
    names = sorted({"".join(rng.choices("가나다", k=rng.choice([3, 4, 5, 6, 7, 9, 12, 50]))) for _ in range(150)})
    gold = [(f"q{i}", "".join(rng.choices("가나다 라1", [4, 4, 4, 1, 1, 1], k=rng.choice([3, 8, 20, 40])))) for i in range(150)] + [("q0", names[-1]), (None, names[0]), ("none", None)]
    d = written(spark, tmp_path, elements=([(n + " 1종",) for n in names[::2]] + [(None,)], "contract_scope string"), doc_facts=([(n + "-1",) for n in names[1::2]] + [(None,)], "clean_name string"), train350_gold=(gold, "qid string, question string"))
    known = {n for n in names[::2] if len(n) >= 4} | {n for n in names[1::2] if len(n) >= 6}
    want = {}
    for k, t in {(k, t.replace(" ", "")) for k, t in gold if k and t}:
        found = [(1.0, len(n), n) for n in known if n in t] + [(0.5, z, n) for n in known if (z := R.common_part(t, n)) >= 6 or (z >= 4 and z >= 0.6 * len(n))]
        want[k] = want.get(k, []) + found
    best = {k: min(((-c, -z, n) for c, z, n in v), default=None) for k, v in want.items()}
    rows = entry.queries()["route_slots"](spark, d).collect()
    assert {r.qid: (r.contract, r.confidence) for r in rows} == {k: (x[2], -x[0]) if x else (None, None) for k, x in best.items()}


def test_contracts_by_their_subjects(spark, tmp_path):
    """Whole names before subjects, these before parts; a subject of four contracts stands for none."""
    tags = [("가나특약 1종", ["골절 진단금", "수술비용", "모두의것"]), ("다라특약", ["수술비용", "입원 일당", "모두의것"]), ("마바특약", ["입원 일당", "수술비용", "모두의것", "짧은것"]), ("사아특약", ["모두의것", None]), ("차카타파하특약", ["AB치료비"]), (None, ["골절진단금"]), ("자자특약", None)]
    gold = {"one": "골절진단금은 얼마", "most": "입원일당과 수술 비용", "ties": "입원-일당", "four": "모두의것", "short": "짧은것", "whole": "가나특약의 입원일당", "part": "차카타파하특별", "before": "차카타파하특별 골절진단금", "case": "ab치료비", "none": "무엇"}
    d = written(spark, tmp_path, elements=([(x,) for x, _ in tags], "contract_scope string"), doc_facts=([("가나",)], "clean_name string"), element_semantic_fields_v4=(tags, "contract_key string, subject_key array<string>"), train350_gold=([*gold.items(), ("most", "수술비용"), (None, "수술비용")], "qid string, question string"))
    got = {r.qid: (r.contract, r.confidence) for r in entry.queries()["route_slots"](spark, d).collect()}
    assert got == {
        "one": ("가나특약", 0.75), "most": ("다라특약", 0.75), "ties": ("다라특약", 0.75), "four": (None, None), "short": (None, None), "whole": ("가나특약", 1.0),
        "part": ("차카타파하특약", 0.5), "before": ("가나특약", 0.75), "case": ("차카타파하특약", 0.75), "none": (None, None),
    }


def test_slots_by_rule(spark, tmp_path):
    gold = [("a", "'x' 별표 3의 갑상선암 지급사유와 면책, 90일 한도 50%는?"), ("b", "「간병 자금」의 계산식"), ("c", "그래")]
    d = written(spark, tmp_path, elements=([("가나다라특약",)], "contract_scope string"), doc_facts=([("가나",)], "clean_name string"), train350_gold=(gold, "qid string, question string"))
    got = {r.qid: (r.role, r.qualifier, r.schema) for r in entry.queries()["route_slots"](spark, d).collect()}
    assert got == {"a": ("exclusion_exception|payment_trigger|limit_frequency", "90일 한도|50%", "table"), "b": ("payment_amount", "", "formula"), "c": ("", "", "")}
    rows = {r.qid: r.subject for r in entry.queries()["route_slots"](spark, d).collect()}
    assert rows["b"] == "간병 자금" and rows["c"] == ""


def test_named_contracts_of_many_alike(spark, tmp_path):
    n = 2500
    names = [f"가나다라마바사아{chr(0xAC00 + i)}" for i in range(n)]
    d = written(spark, tmp_path, elements=([(x,) for x in names], "contract_scope string"), doc_facts=([("가나",)], "clean_name string"), train350_gold=([(f"q{i:04}", f"{x[3:]}특약은 며칠입니까") for i, x in enumerate(names)], "qid string, question string"))
    began = time.time()
    rows = entry.queries()["route_slots"](spark, d).collect()
    assert time.time() - began < 60
    assert [(r.contract, r.confidence) for r in sorted(rows)] == [(x, 0.5) for x in names]


def test_longest_titles_by_sql(spark, tmp_path, monkeypatch):
    from textloom.operators import matching

    monkeypatch.setattr(matching, "PHRASES", 3)
    titles = ["가나다라마", "가나다라마바", "다라마바사아", "라마바사아", "사아자차카", "나다라", "하하하하하"]
    elements = [(f"{x} 1종", f"d{i}") for i, x in enumerate(titles)] + [("하하하하하", "other"), ("가나다라마(2)", "d0"), (None, "d"), ("사아자차카", None)]
    gold = [(f"q{i}", t) for i, t in enumerate(["가나 다라마", "가나다라마바", "x가나다라마바사아", "라마바사아자차카", "하하하하하하 가나다라마", "나다라", "사아자차카", ""])] + [("q0", "사아자차카"), ("q1", "라마바사아"), (None, "가나다라마"), ("none", None)]
    d = written(spark, tmp_path, elements=(elements, "contract_scope string, document_key string"), train350_gold=(gold, "qid string, question string"))
    df = entry.queries()["join_table_catalog"](spark, d)
    got = rows_of(df.columns, df.collect())
    assert got == by_sql(d, "join_table_catalog", "elements", "train350_gold") and got[1]


def test_texts_are_not_moved_for_titles(spark, tmp_path):
    """A row of five characters for every place of every text was made and moved."""
    d = written(spark, tmp_path, elements=([("가나다라마", "d")], "contract_scope string, document_key string"), train350_gold=([("q", "가나다라마바")], "qid string, question string"))
    df = entry.queries()["join_table_catalog"](spark, d)
    assert "Generate" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 1


TAGS = "element_id string, subject_key array<string>, qualifier array<string>, reference array<string>"


def test_structural_ranks_by_sql(spark, tmp_path, monkeypatch):
    import random

    from textloom.operators import matching

    monkeypatch.setattr(matching, "PHRASES", 7)
    rng = random.Random(3)
    words = ["".join(rng.choices("가나다", k=rng.choice([2, 3, 3, 4, 6]))) for _ in range(25)]
    some = lambda: [None, *rng.choices(words, k=rng.choice([0, 1, 2]))] if rng.random() < 0.9 else None
    fields = [(f"e{rng.randrange(200):03}", some(), some(), some()) for _ in range(400)] + [(None, words, words, words)]
    gold = [(f"q{i // 2}", " ".join(rng.choices([*words, "마마"], k=rng.choice([1, 2, 4])))) for i in range(80)] + [(None, words[0]), ("none", None)]
    d = written(spark, tmp_path, element_semantic_fields_v4=(fields, TAGS), train350_gold=(gold, "qid string, question string"))
    df = entry.queries()["structural_key_rank"](spark, d)
    assert rows_of(df.columns, df.collect()) == by_sql(d, "structural_key_rank", "element_semantic_fields_v4", "train350_gold")


def test_structural_ranks_of_a_common_phrase(spark, tmp_path):
    n = 6000
    d = written(spark, tmp_path, element_semantic_fields_v4=([(f"e{i:04}", ["보험금지급"], None, None) for i in range(n)], TAGS), train350_gold=([(f"q{i:04}", f"{i} 보험금 지급") for i in range(n)], "qid string, question string"))
    began = time.time()
    rows = entry.queries()["structural_key_rank"](spark, d).collect()
    assert {(r.element_id, r["rank"]) for r in rows} == {(f"e{i:04}", i + 1) for i in range(5)} and len(rows) == 5 * n
    assert time.time() - began < 40


def test_best_by_fields_as_by_joins(spark):
    """More queries and documents than a tile has, common and rare terms, ties, repeats, empty and missing tokens."""
    import random

    from textloom.operators import lexical, tiles

    rng = random.Random(7)
    words = [chr(0xAC00 + i) for i in range(400)]
    some = lambda n: [words[min(399, int(rng.expovariate(0.02)))] for _ in range(n)]
    docs = [(f"d{i % 9100:05}", some(rng.choice([0, 1, 3])), some(2)) for i in range(9000)] + [(f"e{i}", ["가"], [words[9], None]) for i in range(90)] + [("f", [], [])]
    asked = [(f"q{i:03}", some(rng.choice([0, 1, 2, 4]))) for i in range(600)] + [("same", ["가", "가", words[9]]), ("none", ["없음", None])]
    wide = spark.createDataFrame(docs, "doc_id string, f0 array<string>, f1 array<string>").repartition(3)
    queries = spark.createDataFrame(asked, "query_id string, tokens array<string>")
    rows = wide.selectExpr("doc_id", "'f0' AS field", "f0 AS tokens").unionByName(wide.selectExpr("doc_id", "'f1' AS field", "f1 AS tokens"))
    got = lexical.ranked(tiles.bm25f(wide, queries, [2.0, 0.5], [0.5, 0.9], 1.2, 1, 10), 10)
    want = lexical.bm25f(rows, queries, {"f0": 2.0, "f1": 0.5}, {"f0": 0.5, "f1": 0.9}, top=10)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.collect())


def test_tags_of_many_questions_alike(spark, tmp_path):
    """A row was made for every term that a question and an element share, here 200 million."""
    n = 2500
    fields = [(f"e{i:04}", ["입원급여금을 지급합니다"], [f"{i}회"], None, ["payment_amount"], f"간병보장특약{i} AB-{10000 + i}") for i in range(2 * n)]
    d = written(spark, tmp_path, element_semantic_fields_v4=(fields, TAGS + ", role array<string>, contract_key string"), train350_gold=([(f"q{i:04}", f"간병보장특약의 입원급여금을 {i}회 지급합니다", ["x"]) for i in range(n)], "qid string, question string, content_labels array<string>"))
    began = time.time()
    rows = entry.queries()["bm25f_structured_tags"](spark, d).collect()
    assert len(rows) == 10 * n and time.time() - began < 60


def test_documents_are_not_broadcast(spark, monkeypatch):
    """Every batch of documents passed the driver and stayed in its memory."""
    from textloom.operators import tiles

    sent, plain = [], spark.sparkContext.broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(x) or plain(x))
    queries = spark.createDataFrame([("q", ["1", "x"])], "query_id string, tokens array<string>")
    counts = []
    for n in (10, 40_000):
        docs = spark.range(n).selectExpr("format_string('d%05d', id) AS doc_id", "array('x', cast(id % 7 AS string)) AS f0")
        got = tiles.bm25f(docs, queries, [1.0], [0.5], 1.2, 1, 2)
        assert sorted(r.doc_id for r in got.collect()) == ["d00001", "d00008"]
        counts.append(len(sent))
        sent.clear()
    assert counts[0] == counts[1]


def test_tags_with_bonuses_by_comparison(spark, tmp_path):
    """Elements below the fifty best without the bonuses that are among the ten best with them."""
    import random
    import re
    from math import log

    rng = random.Random(13)
    part = lambda n: ["".join(rng.choices("가나다", k=3)) for _ in range(rng.choice([0, 1, n]))]
    riders = ["가나다라특약", "가나", "다라마바특약", "라마바"]
    cites = ["제1조", "제2조", "제12조 제1조", "제3조의2"]
    codes = ["AB-12345", "XAB-1234567", "CD1234", "QCD12345", "EF-123"]
    pick = lambda xs, n: rng.sample(xs, rng.choice([0, 0, n]))
    fields = [(f"e{i:03}", part(3) + pick(codes, 1), part(2) + pick(codes, 2), pick(cites, 2), ["r"], rng.choice([*riders, None]) and f"{rng.choice(riders)} 1종") for i in range(400)] + [(None, ["가나"], None, None, None, None), ("none", None, None, None, None, None)]
    gold = [(f"q{i:02}", " ".join(part(4) + ["가나가 나다나", *pick(riders, 1), *pick(["제1조", "제2조", "제12조", "제9조"], 3), *pick(["AB-12345", "CD1234", "AB-12345 AB-1234"], 1)]), None) for i in range(60)] + [("qn", None, None), (None, "가나", None)]
    d = written(spark, tmp_path, element_semantic_fields_v4=(fields, TAGS + ", role array<string>, contract_key string"), train350_gold=(gold, "qid string, question string, content_labels array<string>"))
    grams = lambda t: [x[i : i + 2] for x in ["".join(t.lower().split())] for i in range(len(x) - 1)]
    docs = {e: [" ".join(x or []) for x in (a, b, r, o)] + [k or ""] for e, a, b, r, o, k in fields if e}
    toks = {e: [grams(x) for x in v] for e, v in docs.items()}
    n, mean = len(docs), [sum(len(v[i]) for v in toks.values()) / len(docs) or 1 for i in range(5)]
    df = {g: sum(any(g in x for x in v) for v in toks.values()) for v in toks.values() for x in v for g in x}
    want, low = set(), 0
    for k, t, _ in gold:
        if not k or not t:
            continue
        plain, scores = {}, {}
        for e, v in toks.items():
            x = {g: sum(w * y.count(g) / (0.5 + 0.5 * len(y) / m) for w, y, m in zip((3, 1.5, 1, 0.5, 2), v, mean)) for g in set(grams(t))}
            plain[e] = sum(log(1 + (n - df[g] + 0.5) / (df[g] + 0.5)) * y / (1.2 + y) for g, y in x.items() if y)
            stem = re.match("[가-힣]*", docs[e][4])[0]
            said = f"{docs[e][0]} {docs[e][1]}"
            bonus = 2.0 * (len(stem) >= 3 and stem in t) + 2.0 * bool({*re.findall("제[0-9]+조", t)} & {*re.findall("제[0-9]+조", docs[e][2])}) + 2.5 * sum(x in said for x in {*re.findall("[A-Z]{2,4}-?[0-9]{4,6}", t)})
            scores[e] = round(plain[e] + bonus, 6)
        best = sorted((e for e in docs if plain[e] > 0), key=lambda e: (-scores[e], e))[:10]
        low += bool({*best} - {*sorted(docs, key=lambda e: (-plain[e], e))[:50]})
        want |= {(k, e, round(scores[e], 4)) for e in best}
    rows = entry.queries()["bm25f_structured_tags"](spark, d).collect()
    assert low and {(r.query_id, r.doc_id, round(r.score, 4)) for r in rows} == want and len(rows) == len(want)


ELEMENTS, ASKED = "element_id string, text string, contract_scope string", "qid string, question string, content_labels array<string>"


def test_named_riders_by_sql(spark, tmp_path):
    """Riders named with and without a match, fewer than ten inside, roles that agree with and without a common word."""
    import random

    rng = random.Random(11)
    words = ["".join(rng.choices("가나다라마바", k=2)) for _ in range(30)]
    riders = ["가나다라마특약", "가나다라마특약바", "사아자차카특약", "짧은", "하하하하하"]
    roles = ["payment", " PAYMENT ", "claim", "surgery", "", None]
    text = lambda n: " ".join(rng.choices(words, k=n))
    elements = [(f"e{i:03}", text(rng.choice([0, 1, 3, 6])), rng.choice([*riders[:4], None]) and f"{rng.choice(riders[:4])} 1종") for i in range(300)] + [("e000", "나머지", None), ("none", None, riders[0]), (None, "가나", None)]
    elements += [(f"few{i}", words[i], "타파타파타 2종") for i in range(3)]
    fields = [(f"e{rng.randrange(300):03}", rng.choice([None, rng.choices(roles, k=2)])) for _ in range(300)]
    gold = [(f"q{i:03}", f"{rng.choice([*riders, '타파타파타', ''])} {text(rng.choice([0, 1, 4]))}", rng.choice([None, [], ["payment"], ["claim", "surgery"], ["claim,payment", "claim"]])) for i in range(150)] + [("q000", "가나", None), ("qn", None, None), (None, words[0], None)]
    d = written(spark, tmp_path, elements=(elements, ELEMENTS), element_semantic_fields_v4=(fields, "element_id string, role array<string>"), train350_gold=(gold, ASKED))
    df = entry.queries()["field_aware_namespace"](spark, d)
    assert rows_of(df.columns, df.collect()) == by_sql(d, "field_aware_namespace", "elements", "element_semantic_fields_v4", "train350_gold")


def test_elements_of_many_questions_alike(spark, tmp_path):
    """A row was made for every word that a question and an element share, here 150 million."""
    n = 5000
    d = written(spark, tmp_path, elements=([(f"e{i:04}", f"{i}회 받을 수 있는 날 뒤 때", "입원보장특약" if i % 2 else "수술") for i in range(n)], ELEMENTS), element_semantic_fields_v4=([("e0001", ["payment"])], "element_id string, role array<string>"), train350_gold=([(f"q{i:04}", f"{i}회 받을 수 있는 날 뒤 때", ["payment"]) for i in range(n)], ASKED))
    began = time.time()
    rows = entry.queries()["field_aware_namespace"](spark, d).collect()
    assert len(rows) == 10 * n and time.time() - began < 40


PARTS, WANTED = "chunk_id string, text string, section_path array<string>, contract_scope string", "qid string, question string, business_type string, gold_chunk_ids array<string>"


def test_arms_of_odd_rows_by_sql(spark, tmp_path):
    """A suite a question, so that every rank counts; ties, repeated words and rows, nulls, documents that are missing."""
    import random

    rng = random.Random(5)
    words = ["".join(rng.choices("가나다라마바사Aé9_", k=3)) for _ in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    text = lambda n: " ".join(rng.choices(words, weights, k=n))
    chunks = [(f"c{i:04}", rng.choice([None, "", *[text(rng.choice([1, 4, 20]))] * 6]), rng.choice([None, [], [text(1), None], [text(2)]]), rng.choice([None, "", text(1)])) for i in range(4600)]  # more than a tile
    chunks += [("c0000", "나머지", None, "다"), (None, words[0], None, None), *[(f"t{i:02}", f"{words[0]} {words[300]}", [words[1]], words[2]) for i in range(14)]]
    gold = []
    for i in range(1300):  # more than a block
        own = rng.randrange(4600)
        like = " ".join((chunks[own][1] or "").split()[: rng.choice([2, 6])])
        gold.append((f"q{i:04}", rng.choice([like, f"{like} {text(2)}", text(5), ""]), f"s{i}", rng.choice([[f"c{own:04}"]] * 6 + [[f"c{own:04}", f"c{rng.randrange(4600):04}", None, "missing"], ["missing"], [], None])))
    gold += [(f"tie{i:02}", f"{words[300]} {words[0]}, {words[0]}", f"t{i}", [f"t{i:02}"]) for i in range(14)]
    gold += [("q0000", "아", None, ["c0001"]), ("q0001", None, "a", ["c0002"]), ("none", None, "z", ["c0003"]), (None, words[0], "z", ["c0000"]), ("plain", words[0], None, ["c0000"])]
    d = written(spark, tmp_path, chunks=(chunks, PARTS), train350_gold=(gold, WANTED))
    df = entry.queries()["bench_four_arm_suite"](spark, d)
    got = df.collect()
    assert rows_of(df.columns, got) == by_sql(d, "bench_four_arm_suite", "chunks", "train350_gold")
    assert [sum(r[k] for r in got if r.arm == "text") > 100 for k in ("hit1", "hit10")] == [True, True]


def test_arms_without_words_or_wanted(spark, tmp_path):
    for i, (chunks, gold) in enumerate([([], [("q", "가", "s", ["c"])]), ([("c", "!", None, None)], [("q", "가", "s", ["c"])]), ([("c", "가", None, None)], [("q", "가", "s", None), ("r", "", "s", ["c"])]), ([("c", "가", None, None)], [])]):
        d = written(spark, tmp_path / str(i), chunks=(chunks, PARTS), train350_gold=(gold, WANTED))
        df = entry.queries()["bench_four_arm_suite"](spark, d)
        assert rows_of(df.columns, df.collect()) == by_sql(d, "bench_four_arm_suite", "chunks", "train350_gold")


def test_arms_of_many_questions_alike(spark, tmp_path):
    """Every question was scored on every chunk that shares a word with it, in each arm."""
    n = 15000
    d = written(spark, tmp_path, chunks=([(f"c{i:05}", f"{i}회 받을 수 있는 날 뒤 때", ["수술"], "입원") for i in range(n)], PARTS), train350_gold=([(f"q{i:05}", f"{i}회 받을 수 있는 날 뒤 때", "가" if i % 2 else None, [f"c{i:05}"]) for i in range(n)], WANTED))
    began = time.time()
    rows = entry.queries()["bench_four_arm_suite"](spark, d).collect()
    assert {(r.arm, r.hit1, r.hit10) for r in rows} == {("text", n // 2, n // 2), ("combined", n // 2, n // 2), ("section", 0, 0), ("scope", 0, 0)}
    assert time.time() - began < 60
