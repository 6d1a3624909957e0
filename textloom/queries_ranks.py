"""Scoring by structure, arms of a benchmark, causes and fallbacks, with SQL stated from their definitions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom import queries_sequences  # noqa: F401  (its queries come first)
from textloom.functions import text as T
from textloom.operators import lexical, tiles
from textloom.operators.arms import first_ranks
from textloom.operators.matching import held
from textloom.plans.lineage import cut
from textloom.queries import DOCS, QUESTIONS, RUNS, bm25_sql, corpus, grams_sql, judged, query, questions, ranked_sql, runs, submitted, words_sql
from textloom.queries_checked import _QS, asked
from textloom.sources.tables import table

# ---- index


@query(f"WITH {DOCS}, p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM d) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term), a AS (SELECT doc_id, len(tokens) AS dl FROM d), g AS (SELECT round(coalesce(nullif(avg(len(tokens)), 0), 1.0), 6) AS avgdl FROM d) SELECT term, doc_id, tf, df, dl, avgdl FROM p JOIN f USING (term) JOIN a USING (doc_id) CROSS JOIN g")
def inverted_index_build(s, d):
    """A row a posting: term frequency, document frequency, length, and the mean length (1.0 for an empty corpus)."""
    docs = corpus(s, d)
    p = docs.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    g = docs.agg(F.round(F.coalesce(F.nullif(F.avg(F.size("tokens")), F.lit(0.0)), F.lit(1.0)), 6).alias("avgdl"))
    return p.join(p.groupBy("term").agg(F.count("*").alias("df")), "term").crossJoin(F.broadcast(g)).select("term", "doc_id", "tf", "df", "dl", "avgdl")  # one row


# ---- bonuses and ranks by structure

_LOC = r"regexp_replace(lower(concat_ws(' ', locator.article, locator.article_title, locator.section)), '\s+', '', 'g')"


@query(f"""WITH {_QS}, l AS (SELECT DISTINCT {_LOC} AS loc FROM element_semantic_fields_v4), lg AS (SELECT loc, unnest(list_distinct({grams_sql('loc')})) AS g FROM l), n AS (SELECT count(DISTINCT loc)::DOUBLE AS n FROM lg),
w AS (SELECT g, ln(1 + n / count(*)) AS w FROM lg CROSS JOIN n GROUP BY g, n), lw AS (SELECT loc, sum(w) AS total FROM lg JOIN w USING (g) GROUP BY loc HAVING count(*) >= 4),
qg AS (SELECT DISTINCT qid, g FROM (SELECT qid, unnest({grams_sql('t')}) AS g FROM q)), qw AS (SELECT qid, sum(w) AS own FROM qg JOIN w USING (g) GROUP BY qid),
m AS (SELECT qid, loc, count(*) AS matches, sum(w) AS s FROM qg JOIN w USING (g) JOIN lg USING (g) GROUP BY ALL HAVING count(*) >= 3)
SELECT qid, loc, matches, round(s / total, 5) AS coverage, round(2 * s / (total + own), 5) AS dice, round(2.0 * (s / total) * (s / total), 5) AS bonus FROM m JOIN lw USING (loc) JOIN qw USING (qid) WHERE round(s / total, 9) >= 0.2""")
def locator_coverage_bonus(s, d):
    """Weighted share of a locator's bigrams that a question has, squared, where it has three and a fifth of their weight."""
    f = table(s, d, "element_semantic_fields_v4")
    loc = F.regexp_replace(F.lower(F.concat_ws(" ", "locator.article", "locator.article_title", "locator.section")), r"\s+", "")
    grams = lambda x: T.char_grams(F.col(x), 2)
    locs = cut(f.select(loc.alias("loc")).distinct().select(F.col("loc").alias("doc_id"), F.array_distinct(grams("loc")).alias("f0")))  # read for the grams and for the batches
    q = asked(s, d).groupBy(F.col("qid").alias("query_id")).agg(F.array_distinct(F.flatten(F.collect_list(grams("t")))).alias("tokens"))  # a question's few texts
    x = tiles.overlaps(locs, q, 4, 3, 0.2, 2.0)
    return x.select(F.col("query_id").alias("qid"), F.col("doc_id").alias("loc"), "matches", "coverage", "dice", "bonus")


_EL = "e AS (SELECT element_id, min(text) AS text, min(contract_scope) AS scope FROM elements WHERE element_id IS NOT NULL AND text IS NOT NULL GROUP BY element_id)"
_T1 = "t AS (SELECT qid, min(question) AS question, min(coalesce(array_to_string(content_labels, ','), '')) AS labels FROM train350_gold WHERE qid IS NOT NULL AND question IS NOT NULL GROUP BY qid)"


def _first(s, d) -> DataFrame:
    q = table(s, d, "train350_gold").where("qid is not null and question is not null")
    return q.groupBy("qid").agg(F.min("question").alias("question"), F.min(F.coalesce(F.array_join("content_labels", ","), F.lit(""))).alias("labels"))


def _one_element(s, d) -> DataFrame:
    return table(s, d, "elements").where("element_id is not null and text is not null").groupBy("element_id").agg(F.min("text").alias("text"), F.min("contract_scope").alias("scope"))


@query(f"""WITH {_EL}, {_T1}, st AS (SELECT element_id, regexp_extract(scope, '^[가-힣]+') AS stem FROM e), et AS (SELECT element_id, unnest(list_distinct({words_sql('text')})) AS term FROM e), qt AS (SELECT qid, unnest(list_distinct({words_sql('question')})) AS term FROM t),
f AS (SELECT term, ln(1 + (SELECT count(*) FROM e)::DOUBLE / count(*)) AS w FROM et GROUP BY term), h AS (SELECT qid, element_id, sum(w) AS s FROM qt JOIN et USING (term) JOIN f USING (term) GROUP BY ALL),
nm AS (SELECT DISTINCT qid, stem FROM t JOIN (SELECT DISTINCT stem FROM st WHERE length(stem) >= 5) ON contains(question, stem)), i AS (SELECT h.*, nm.stem IS NOT NULL AS inside FROM h JOIN st USING (element_id) LEFT JOIN nm ON nm.qid = h.qid AND nm.stem = st.stem),
a AS (SELECT qid, bool_or(inside) AS restricted FROM i GROUP BY qid), r AS (SELECT element_id, list_distinct(flatten(list(list_transform(coalesce(role, []), lambda x: lower(trim(x)))))) AS roles FROM element_semantic_fields_v4 GROUP BY element_id),
z AS (SELECT i.qid AS query_id, i.element_id AS doc_id, round(s + 8 * len(list_filter(coalesce(roles, []), lambda x: x <> '' AND list_contains(string_split(labels, ','), x))), 4) AS score FROM i JOIN a USING (qid) JOIN t USING (qid) LEFT JOIN r ON r.element_id = i.element_id WHERE inside OR NOT restricted) {ranked_sql('SELECT * FROM z', 10)}""")
def field_aware_namespace(s, d):
    """Elements of the riders that a question names, or all where none of theirs match, by word weights and 8 a role that agrees."""
    e, t = _one_element(s, d), _first(s, d)
    words = lambda c: F.array_distinct(T.words(F.col(c)))
    of = lambda kind, c: F.transform(c, lambda x: F.concat(F.lit(kind), x))  # noqa: E731  (words have no blanks)
    none = F.array().cast("array<string>")
    e = e.select("element_id", "text", F.regexp_extract("scope", "^[가-힣]+", 0).alias("stem"))
    stems = e.select("stem").distinct().where("char_length(stem) >= 5")
    nm = held(t, "qid", "question", stems, "stem", 5).groupBy("qid").agg(F.collect_set("stem").alias("stems"))
    roles = F.transform(F.coalesce("role", none), lambda x: F.lower(F.trim(x)))
    r = table(s, d, "element_semantic_fields_v4").select("element_id", F.explode(roles).alias("r")).where("r <> ''").groupBy("element_id").agg(F.collect_set("r").alias("roles"))  # an element's few roles
    inside = F.when(F.char_length("stem") >= 5, F.array("stem")).otherwise(none)
    docs = e.join(r, "element_id", "left").select(F.col("element_id").alias("doc_id"), words("text").alias("f0"), of(" r", F.coalesce("roles", none)).alias("f1"), of(" s", inside).alias("f2"))
    labels = F.array_distinct(F.filter(F.split("labels", ","), lambda x: x != ""))
    q = t.join(nm, "qid", "left").select(F.col("qid").alias("query_id"), F.concat(words("question"), of(" r", labels), of(" s", F.coalesce("stems", none))).alias("tokens"))
    q = cut(q)  # read for the terms and for the scores
    c = tiles.corpus(docs, q, 3)
    role, stem = (np.array([v.startswith(k) for v in c.vocabulary] or [False]) for k in (" r", " s"))
    idf = np.log(1 + c.n / np.maximum(1, c.df))
    most = q.agg(F.max(F.size("tokens")).alias("n")).first().n or 0
    above = 2.0 ** math.ceil(math.log2(1 + most * max(8.0, math.log(1 + max(1, c.n)))))  # more than all the rest of a score
    one = np.ones(3)
    found = tiles.best(c, tiles.Weights(np.where(role, 8.0, np.where(stem, above, idf)), one, one * 0, one, None, role | stem, 4), docs, q, 1, 10)
    x = found.withColumn("restricted", F.max("score").over(Window.partitionBy("query_id")) >= above).where((F.col("score") >= above) | ~F.col("restricted"))
    return lexical.ranked(x.select("query_id", "doc_id", F.round(F.col("score") - F.when(F.col("restricted"), above).otherwise(0.0), 4).alias("score")), 10)


_MEMBERS = " UNION ALL ".join(f"SELECT element_id, '{c}' AS field, unnest({c}) AS v FROM element_semantic_fields_v4" for c in ("subject_key", "qualifier", "reference"))


@query(rf"""WITH {_QS}, m AS (SELECT DISTINCT element_id, field, regexp_replace(v, '\s+', '', 'g') AS v FROM ({_MEMBERS}) WHERE element_id IS NOT NULL AND length(regexp_replace(v, '\s+', '', 'g')) >= 3),
h AS (SELECT DISTINCT qid, element_id, field, v FROM q JOIN m ON contains(t, v)), k AS (SELECT qid, element_id, count(*) AS phrases, count(DISTINCT field) AS fields, max(length(v)) AS longest, sum(length(v))::BIGINT AS total FROM h GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fields DESC, phrases DESC, longest DESC, total DESC, element_id) AS rank FROM k) WHERE rank <= 5""")
def structural_key_rank(s, d):
    """Elements by the tuple: fields with a phrase of the question, phrases, the longest, their sum; ties by id."""
    f = table(s, d, "element_semantic_fields_v4").where("element_id is not null")
    m = None
    for c in ("subject_key", "qualifier", "reference"):
        x = f.select("element_id", F.lit(c).alias("field"), F.explode(c).alias("v")).select("element_id", "field", F.regexp_replace("v", r"\s+", "").alias("v"))
        m = x if m is None else m.unionByName(x)
    m = m.where("char_length(v) >= 3").distinct()
    qv = cut(held(asked(s, d), "qid", "t", m.select("v").distinct(), "v", 3).distinct())  # some phrases a question
    m = m.join(qv.select("v").distinct(), "v", "left_semi")
    ev = m.groupBy("element_id", "v").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    # an element with one phrase of a question is not among its five where five smaller ones have it in the same fields
    few = ev.withColumn("n", F.row_number().over(Window.partitionBy("v", "fields").orderBy("element_id"))).where("n <= 5")
    two = lambda x, key: x.groupBy(key).agg(F.collect_list("v").alias("vs")).where("size(vs) > 1").select(key, F.explode(F.expr("flatten(transform(vs, a -> transform(filter(vs, b -> b > a), b -> struct(a, b))))")).alias("pair"))
    some = qv.join(few, "v").select("qid", "element_id").unionByName(two(qv, "qid").join(two(ev, "element_id"), "pair").select("qid", "element_id")).distinct()
    h = some.join(qv, "qid").join(m, ["element_id", "v"]).select("qid", "element_id", "field", "v")
    size = F.char_length("v")
    k = h.groupBy("qid", "element_id").agg(F.count("*").alias("phrases"), F.count_distinct("field").alias("fields"), F.max(size).alias("longest"), F.sum(size).alias("total"))
    w = Window.partitionBy("qid").orderBy(F.col("fields").desc(), F.col("phrases").desc(), F.col("longest").desc(), F.col("total").desc(), "element_id")
    return k.withColumn("rank", F.row_number().over(w)).where("rank <= 5")


# ---- benchmark arms

_CHUNK = "c AS (SELECT chunk_id, min(coalesce(text, '')) AS text, min(coalesce(array_to_string(section_path, ' '), '')) AS section, min(coalesce(contract_scope, '')) AS scope FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id)"
_ARMS = {"text": "text", "section": "section", "scope": "scope", "combined": "concat_ws(' ', scope, section, text)"}


def _arm_sql(arm: str) -> str:
    docs = f"{_CHUNK}, d AS (SELECT chunk_id AS doc_id, {words_sql(_ARMS[arm])} AS tokens FROM c)"
    asked_ = f"q AS (SELECT qid AS query_id, {words_sql('min(question)')} AS tokens FROM train350_gold WHERE qid IS NOT NULL AND question IS NOT NULL GROUP BY qid)"
    return f"SELECT '{arm}' AS arm, query_id, doc_id, rank FROM ({bm25_sql(docs, asked_, 1.5, 0.75, True, None, 10)})"


@query("WITH x AS (" + " UNION ALL ".join(_arm_sql(a) for a in _ARMS) + """), g AS (SELECT DISTINCT qid AS query_id, c AS doc_id FROM (SELECT qid, unnest(gold_chunk_ids) AS c FROM train350_gold WHERE qid IS NOT NULL) WHERE c IS NOT NULL),
b AS (SELECT qid AS query_id, min(coalesce(business_type, '-')) AS suite FROM train350_gold WHERE qid IS NOT NULL AND question IS NOT NULL GROUP BY qid), a AS (SELECT unnest(['text', 'section', 'scope', 'combined']) AS arm),
h AS (SELECT arm, query_id, min(rank) AS first FROM x JOIN g USING (query_id, doc_id) GROUP BY ALL)
SELECT arm, suite, count(*) AS questions, count(*) FILTER (first <= 1) AS hit1, count(*) FILTER (first <= 10) AS hit10 FROM b CROSS JOIN a LEFT JOIN h USING (arm, query_id) GROUP BY arm, suite""")
def bench_four_arm_suite(s, d):
    """The same questions over four texts of a chunk: hits at 1 and 10 of any gold chunk, by suite."""
    part = lambda x: F.min(F.coalesce(x, F.lit("")))
    c = table(s, d, "chunks").where("chunk_id is not null").repartitionByRange("chunk_id")  # one shuffle for the groups and for the order of ids
    c = c.groupBy(F.col("chunk_id").alias("doc_id")).agg(part("text").alias("text"), part(F.array_join("section_path", " ")).alias("section"), part("contract_scope").alias("scope"))
    c = c.select("doc_id", *[T.words(F.col(x)).alias(x) for x in ("text", "section", "scope")])
    t, asked_ = table(s, d, "train350_gold").where("qid is not null"), F.col("question").isNotNull()
    b = t.groupBy(F.col("qid").alias("query_id")).agg(F.min("question").alias("q"), F.min(F.when(asked_, F.coalesce("business_type", F.lit("-")))).alias("suite"), F.array_distinct(F.flatten(F.collect_set("gold_chunk_ids"))).alias("wanted"))  # a question's few rows
    b = cut(b.where("q is not null").select("query_id", "suite", T.words(F.col("q")).alias("tokens"), F.filter("wanted", lambda x: x.isNotNull()).alias("wanted")))
    arms = {"text": ["text"], "section": ["section"], "scope": ["scope"], "combined": ["scope", "section", "text"]}
    x = b.select("query_id", "suite").join(first_ranks(c, b, arms), "query_id", "left").groupBy("suite")
    x = x.agg(F.count("*").alias("questions"), *[F.count_if(F.col(a) <= k).alias(f"{a}{k}") for a in arms for k in (1, 10)])
    rows = F.array(*[F.struct(F.lit(a).alias("arm"), "suite", "questions", F.col(f"{a}1").alias("hit1"), F.col(f"{a}10").alias("hit10")) for a in arms])
    return x.select(F.inline(rows))


# ---- fields by rule, contents, causes, fallbacks

_SENT = r"list_filter(list_transform(string_split_regex(text, '[.!?\n]+'), lambda x: trim(x, ' ')), lambda x: x <> '')"


@query(rf"SELECT element_id, y[1] AS summary, array_to_string(list_filter(y, lambda x: contains(x, '경우')), '|') AS conditions, array_to_string(list_filter(y, lambda x: regexp_matches(x, '않|제외')), '|') AS exceptions, len(y) AS sentences FROM (SELECT element_id, {_SENT} AS y FROM elements WHERE text IS NOT NULL)")
def rule_summary_fields(s, d):
    """The first sentence as summary, sentences with conditions and with exceptions."""
    y = F.filter(F.transform(F.split("text", r"[.!?\n]+"), lambda x: F.trim(x)), lambda x: x != "")
    e = table(s, d, "elements").where("text is not null").select("element_id", y.alias("y"))
    own = lambda p: F.array_join(F.filter("y", lambda x: x.rlike(p)), "|")
    return e.select("element_id", F.try_element_at("y", F.lit(1)).alias("summary"), own("경우").alias("conditions"), own("않|제외").alias("exceptions"), F.size("y").alias("sentences"))


_GROUND = r"SELECT DISTINCT element_id, text, list_distinct(regexp_extract_all(text, '제[0-9]+조')) AS arts FROM elements WHERE text IS NOT NULL"


@query(rf"""WITH e AS ({_GROUND}), f AS (SELECT element_id, list_distinct(list_filter(list_transform(flatten(list(coalesce(subject_key, []))), lambda x: trim(x)), lambda x: x <> '')) AS names, list_distinct(flatten(list(coalesce(reference, [])))) AS refs FROM element_semantic_fields_v4 GROUP BY element_id)
SELECT element_id, len(names) AS names, len(list_filter(names, lambda v: contains(text, v))) AS grounded, len(arts) AS articles, len(list_filter(arts, lambda a: NOT list_contains(list_transform(refs, lambda r: trim(r)), a))) AS gaps FROM e JOIN f USING (element_id)""")
def content_grounding_verify(s, d):
    """Names that occur in the text they were taken from; articles that the text cites and the references lack."""
    e = table(s, d, "elements").where("text is not null").select("element_id", "text").distinct()
    e = e.withColumn("arts", F.array_distinct(F.regexp_extract_all("text", F.lit("(제[0-9]+조)"), F.lit(1))))
    none = F.array().cast("array<string>")
    f = table(s, d, "element_semantic_fields_v4").select("element_id", F.filter(F.transform(F.coalesce("subject_key", none), lambda x: F.trim(x)), lambda x: x != "").alias("n"), F.transform(F.coalesce("reference", none), lambda x: F.trim(x)).alias("r"))
    f = f.groupBy("element_id").agg(F.array_distinct(F.flatten(F.collect_list("n"))).alias("n"), F.array_distinct(F.flatten(F.collect_list("r"))).alias("r"))  # an element's few rows
    x = e.join(f, "element_id")
    gaps = F.size(F.filter("arts", lambda a: ~F.coalesce(F.array_contains("r", a), F.lit(False))))
    return x.select("element_id", F.size("n").alias("names"), F.size(F.filter("n", lambda v: F.contains(F.col("text"), v))).alias("grounded"), F.size("arts").alias("articles"), gaps.alias("gaps"))


@query(f"""WITH {RUNS}, c AS (SELECT chunk_id, min(coalesce(text, '')) AS text, min(coalesce(contract_scope, '')) AS scope FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id), ck AS (SELECT DISTINCT contract_key FROM element_semantic_fields_v4 WHERE contract_key IS NOT NULL),
x AS (SELECT gd.query_id, gd.doc_id, rank, c.chunk_id, scope IN (SELECT contract_key FROM ck) AS tagged, list_has_any({words_sql("coalesce(query_text, '')")}, {words_sql("coalesce(text, '')")}) AS lexical FROM gd JOIN k USING (query_id) LEFT JOIN rk USING (query_id, doc_id) LEFT JOIN c ON c.chunk_id = gd.doc_id WHERE coalesce(rank, 1000000) > 5),
y AS (SELECT CASE WHEN chunk_id IS NULL THEN 'chunk_missing' WHEN NOT tagged THEN 'tag_missing' WHEN NOT lexical THEN 'lexical_mismatch' ELSE 'rank_only' END AS cause FROM x) SELECT cause, count(*) AS n, round(count(*) / (SELECT count(*) FROM y), 6) AS share FROM y GROUP BY cause""")
def metric_failure_cause(s, d):
    """Why a gold chunk is not among the first five, the first cause that holds; counts and shares."""
    r = runs(s, d)
    c = table(s, d, "chunks").where("chunk_id is not null").groupBy(F.col("chunk_id").alias("doc_id")).agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min(F.coalesce("contract_scope", F.lit(""))).alias("scope"), F.lit(True).alias("known"))
    ck = table(s, d, "element_semantic_fields_v4").where("contract_key is not null").select(F.col("contract_key").alias("scope"), F.lit(True).alias("tagged")).distinct()
    x = judged(r).join(submitted(r), ["query_id", "doc_id"], "left").where(F.coalesce("rank", F.lit(1000000)) > 5).join(r.select("query_id", "query_text"), "query_id").join(c, "doc_id", "left").join(ck, "scope", "left")
    shared = F.arrays_overlap(T.words(F.coalesce("query_text", F.lit(""))), T.words(F.coalesce("text", F.lit(""))))
    cause = F.when(F.col("known").isNull(), "chunk_missing").when(F.col("tagged").isNull(), "tag_missing").when(~shared, "lexical_mismatch").otherwise("rank_only")
    n = x.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).select("cause", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))  # one row


_AXES = {"identity": "[가-힣]+(?:보험|특약)", "amount": "[0-9][0-9,]*(?:만원|원)", "period": "[0-9]+(?:일|개월|년|세)", "code": "[A-Z]{2,4}-?[0-9]{4,6}"}


@query(f"""WITH r1 AS ({bm25_sql(DOCS, QUESTIONS, 1.5, 0.75, True, None, 1)}), x AS (SELECT item_id AS query_id, score IS NOT NULL AS found, coalesce(m.text, '') AS body, {', '.join(f"regexp_extract_all(question, '{p}') AS {n}" for n, p in _AXES.items())} FROM eval_items i LEFT JOIN r1 ON r1.query_id = i.item_id LEFT JOIN documents m ON m.doc_id = r1.doc_id WHERE question IS NOT NULL),
y AS (SELECT query_id, found, {' + '.join(f'(len({n}) > 0)::INT' for n in _AXES)} AS routed, {' + '.join(f'(len(list_filter({n}, lambda v: contains(body, v))) > 0)::INT' for n in _AXES)} AS covered, len(identity) > 0 AND len(list_filter(identity, lambda v: contains(body, v))) = 0 AS missed FROM x)
SELECT query_id, routed, covered, CASE WHEN NOT found THEN 'empty' WHEN missed THEN 'identity' WHEN routed >= 2 AND covered < 0.5 * routed THEN 'coverage' WHEN routed = 0 THEN 'unrouted' END AS reason FROM y""")
def fallback_gate_axis(s, d):
    """Why a question falls back: no result, its identity missed, under half of two axes or more covered, or none routed."""
    top = lexical.bm25(corpus(s, d), questions(s, d), top=1).join(table(s, d, "documents").select("doc_id", "text"), "doc_id").select("query_id", F.col("text").alias("body"))
    q = table(s, d, "eval_items").where("question is not null").select(F.col("item_id").alias("query_id"), "question").join(top, "query_id", "left")
    found = F.col("body").isNotNull()
    q = q.select("query_id", found.alias("found"), F.coalesce("body", F.lit("")).alias("body"), *[F.regexp_extract_all("question", F.lit(f"({p})"), F.lit(1)).alias(n) for n, p in _AXES.items()])
    has = {n: F.size(n) > 0 for n in _AXES}
    hit = {n: F.exists(n, lambda v: F.contains(F.col("body"), v)) for n in _AXES}
    add = lambda cs: sum((c.cast("int") for c in cs), F.lit(0))
    q = q.select("query_id", "found", add(has.values()).alias("routed"), add(hit.values()).alias("covered"), (has["identity"] & ~hit["identity"]).alias("missed"))
    reason = F.when(~F.col("found"), "empty").when(F.col("missed"), "identity").when((F.col("routed") >= 2) & (F.col("covered") < 0.5 * F.col("routed")), "coverage").when(F.col("routed") == 0, "unrouted")
    return q.select("query_id", "routed", "covered", reason.alias("reason"))


@query("""WITH f AS (SELECT element_id, list_distinct(list_filter(list_transform(coalesce(subject_key, []), lambda x: trim(x)), lambda x: x <> '')) AS v, row_number() OVER (PARTITION BY element_id ORDER BY loaded_at, array_to_string(subject_key, ',') NULLS FIRST) AS n FROM element_semantic_fields_v4 WHERE element_id IS NOT NULL)
SELECT element_id, CASE WHEN ('0x' || left(sha256(element_id), 1))::INT < 12 THEN array_to_string(list_sort(v), '|') END AS aligned FROM f WHERE n = 1""")
def json_align_items(s, d):
    """Answers to numbered items in the order of the items: by their numbers, without numbers by place, else refused.

    The answers are made of each element's terms: numbered backwards, without numbers, or with one missing.
    """
    none = F.array().cast("array<string>")
    w = Window.partitionBy("element_id").orderBy("loaded_at", F.array_join("subject_key", ",").asc_nulls_first())
    f = table(s, d, "element_semantic_fields_v4").where("element_id is not null").withColumn("n", F.row_number().over(w)).where("n = 1")
    v = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("subject_key", none), lambda x: F.trim(x)), lambda x: x != "")))
    f = f.select("element_id", v.alias("v"), F.conv(F.substring(F.sha2("element_id", 256), 1, 1), 16, 10).cast("int").alias("h"))
    item = lambda number: lambda x, i: F.struct(F.when(F.lit(number), i + 1).alias("i"), x.alias("v"))
    numbered, bare = F.reverse(F.transform("v", item(True))), F.transform("v", item(False))
    short = F.concat(F.slice("v", 1, 1 << 30), F.array(F.lit("one too many")))
    said = F.when(F.col("h") < 6, F.to_json(numbered)).when(F.col("h") < 12, F.to_json(bare)).otherwise(F.to_json(F.transform(short, item(False))))
    f = f.select("element_id", F.size("v").alias("n"), said.alias("said"))
    return f.select("element_id", F.array_join(aligned(F.col("said"), F.col("n")), "|").alias("aligned"))


def aligned(said, n):
    """The values of a JSON array of ``{"i": ..., "v": ...}`` in the order of ``n`` items, or null."""
    items = F.from_json(said, "array<struct<i: int, v: string>>")
    by_number = F.transform(F.array_sort(items), lambda x: x["v"])
    numbers = F.array_sort(F.transform(items, lambda x: x["i"]))
    whole = numbers == F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    bare = F.forall(items, lambda x: x["i"].isNull())
    return F.when(F.size(items) != n, None).when(bare, F.transform(items, lambda x: x["v"])).when(whole, by_number)


def longest_run(evidence: str, found: str) -> int:
    """Characters of the longest run of words of ``evidence`` that ``found`` has; all if it holds the whole."""
    import difflib

    if evidence in found:
        return len(evidence)
    a, b = evidence.split(), found.split()
    m = difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match()
    return len(" ".join(a[m.a : m.a + m.size]))


@query()
def metric_span_coverage(s, d):
    """Evidence characters found in the first five submitted texts: coverage, density (at most 1) and their F1."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for q, evidence, found in zip(p.query_id, p.evidence, p.found, strict=True):
                text = "\n".join(found)
                got, want = sum(longest_run(e, text) for e in evidence), sum(map(len, evidence))
                c, y = got / want if want else 0.0, min(1.0, got / len(text)) if text else 0.0
                rows.append((q, round(c, 6), round(y, 6), round(2 * c * y / (c + y), 6) if c + y else 0.0))
            yield pd.DataFrame(rows, columns=["query_id", "coverage", "density", "f1"])

    r = runs(s, d)
    c = table(s, d, "chunks").where("chunk_id is not null and text is not null").groupBy(F.col("chunk_id").alias("doc_id")).agg(F.min("text").alias("text"))
    gold = judged(r).join(c, "doc_id").groupBy("query_id").agg(F.array_sort(F.collect_list("text")).alias("evidence"))  # a question's few gold chunks
    top = submitted(r).where("rank <= 5").join(c, "doc_id").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("found"))  # five at most
    x = gold.join(top, "query_id", "left").select("query_id", "evidence", F.coalesce("found", F.array().cast("array<string>")).alias("found"))
    return x.mapInPandas(run, "query_id string, coverage double, density double, f1 double")



# ---- identities and tags

_NAME = "SELECT DISTINCT regexp_extract(clean_name, '^[가-힣]+') AS name FROM doc_facts WHERE length(regexp_extract(clean_name, '^[가-힣]+')) >= 6"


def _names(s, d) -> DataFrame:
    return table(s, d, "doc_facts").where("clean_name is not null").select(F.regexp_extract("clean_name", "^[가-힣]+", 0).alias("name")).where("char_length(name) >= 6").distinct()


@query(f"""WITH n AS ({_NAME}), l AS (SELECT unnest(range(3, 9)) AS l), p AS (SELECT name, l, unnest(range(1, length(name) - l + 2)) AS i FROM n CROSS JOIN l), b AS (SELECT DISTINCT name, substr(name, i, l) AS sub FROM p),
h AS (SELECT sub FROM b GROUP BY sub HAVING count(*) >= 2), v AS (SELECT DISTINCT name, left(name, strpos(name, sub) - 1) || substr(name, strpos(name, sub) + length(sub)) AS variant FROM b JOIN h USING (sub))
SELECT name, variant FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY length(variant) DESC, variant) AS n FROM v WHERE length(variant) >= 3) WHERE n <= 12""")
def route_identity_expand(s, d):
    """Variants of a name without a substring of 3 to 8 characters that another name has too; the twelve longest."""
    n = _names(s, d).withColumn("l", F.explode(F.sequence(F.lit(3), F.lit(8)))).where("char_length(name) >= l")
    b = n.withColumn("i", F.explode(F.expr("sequence(1, char_length(name) - l + 1)"))).select("name", F.substring(F.col("name"), F.col("i"), F.col("l")).alias("sub")).distinct()
    h = b.groupBy("sub").agg(F.count("*").alias("k")).where("k >= 2").select("sub")
    at = F.position(F.col("sub"), F.col("name"))
    v = b.join(h, "sub").select("name", F.concat(F.substring(F.col("name"), F.lit(1), at - 1), F.substring(F.col("name"), at + F.char_length("sub"), F.char_length("name"))).alias("variant")).where("char_length(variant) >= 3").distinct()
    w = Window.partitionBy("name").orderBy(F.char_length("variant").desc(), "variant")
    return v.withColumn("n", F.row_number().over(w)).where("n <= 12").drop("n")


def common_part(a: str, b: str) -> int:
    """Length of the longest common substring."""
    import difflib

    return difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match().size


#: Names that are indexed at a time; a longer one than ``LONG`` is compared, as its parts would be too many.
NAMES, LONG = 10_000, 40


class NameIndex:
    """Names by their parts: those of six characters, or of four that are 0.6 of the name, with the smallest name."""

    def __init__(self, names: list[str]):
        self.whole = {n for n in names if len(n) <= LONG}
        self.heads: set[str] = set()
        self.part: dict[str, str] = {}
        self.long: dict[str, set[str]] = {}
        for n in sorted(self.whole):
            for i in range(len(n) - 3):
                self.heads.add(n[i : i + 4])
                for size in range(4, len(n) - i + 1):
                    if size >= 6 or size >= 0.6 * len(n):
                        self.part.setdefault(n[i : i + size], n)
        for n in set(names) - self.whole:
            for i in range(len(n) - 3):
                self.long.setdefault(n[i : i + 4], set()).add(n)

    def best(self, t: str) -> tuple[bool, int, str] | None:
        """(in part, minus the size, name), the least: of a whole name, else of the longest part."""
        found = []
        for i in range(len(t) - 3):
            if t[i : i + 4] not in self.heads:
                continue
            for size in range(4, len(t) - i + 1):
                x = t[i : i + size]
                if (n := self.part.get(x)) is not None:
                    found.append((x not in self.whole, -size, x if x in self.whole else n))
                elif size >= 6:
                    break
        for n in {n for i in range(len(t) - 3) for n in self.long.get(t[i : i + 4], ())} if self.long else ():
            if (size := common_part(t, n)) >= 6 or size >= 0.6 * len(n):
                found.append((size < len(n), -size, n))
        return min(found, default=None)


def named(q: DataFrame, names: DataFrame) -> DataFrame:
    """``qid, contract, confidence`` of the best of ``names`` for the texts ``t`` of each question; names go by blocks."""
    spark, out = q.sparkSession, None

    def against(block):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = NameIndex(block.value)
            for p in batches:
                rows = [(k, *x) for k, x in zip(p.qid, map(index.best, p.t), strict=True) if x]
                yield pd.DataFrame(rows, columns=["qid", "part", "size", "name"])

        return q.mapInPandas(run, "qid string, part boolean, size int, name string")

    every = (r.name for r in names.select("name").toLocalIterator())
    while block := list(islice(every, NAMES)):
        x = against(spark.sparkContext.broadcast(block))
        out = x if out is None else out.unionByName(x)
    if out is None:
        return spark.createDataFrame([], "qid string, contract string, confidence double")
    best = out.groupBy("qid").agg(F.min(F.struct("part", "size", "name")).alias("x"))
    return best.select("qid", F.col("x.name").alias("contract"), F.when(F.col("x.part"), 0.5).otherwise(1.0).alias("confidence"))


ROLES = {
    "exclusion_exception": "지급하지 않|보상하지 않|면책|제외", "premium_waiver": "납입.?면제", "payment_trigger": "지급사유|지급 조건", "payment_amount": "지급금액|지급률|산정|계산",
    "limit_frequency": r"한도|횟수|최초\s*1회", "timing_period": "보장개시|책임개시|감액|대기기간|보험기간|보험나이|가입연령", "definition": "정의|이라 함은|라 함은", "criteria_rule": "진단확정|판정기준|적용 기준|등록 및 결정",
    "contract_lifecycle": "갱신|해지|소멸|무효|환급", "claim_procedure": "청구|구비서류", "code_reference": "분류표|분류코드|질병코드|수가코드",
}
SCHEMAS = {"table": "(?<![가-힣])표(?![가-힣적준])|분류표|별표|부표|테이블", "formula": "산식|계산식|수식"}
_QUOTED = r'["“「『<](.{2,60}?)["”」』>]'
_DEFINED = r"([가-힣A-Za-z0-9·()\- ]{2,50}?)(?:이라 함은|라 함은|이란)"
_SUBJECT = r"[가-힣A-Za-z0-9·()\- ]{2,60}?(?:보험금|급여금|지원비|치료비|진단비|수술비|입원비|검사비|환급금|보험료|보험나이|가입연령|납입면제|질병|질환|신생물|장해|재해|암|수술|치료|검사|입원|통원)"
_VALUE = r"(?:보험가입금액|가입금액)의?\s*\d+(?:\.\d+)?%|\d+(?:\.\d+)?%|최초\s*1회(?:한)?|\d+회(?:한)?|\d+일(?:\s*한도|분)?|\d+개월|\d+년|\d+(?:,\d{3})*(?:만)?원|\d+세|[A-Z]\d{2}(?:\.\d+)?(?:~[A-Z]?\d{2})?"
_COMMON = set("보험금 급여금 질병 질환 치료 수술 검사 입원 통원 특약 주계약 피보험자 보험수익자 계약자 회사 해당 경우".split()) | {"보험금 지급사유", "보험금 지급에 관한 세부규정", "용어의 정의"}
_NOT_KEY = r"제\d+(?:-\d+)?\s*(?:조|관)|부표\s?\d|별표\s?\d|한국표준질병|보험금 지급|주계약 약관|세부규정|간편심사형|직접적인 치료|지급절차|제\s?\d+항|주\d+\)|계약자는|경우|동안|에도 불구하고|에 따라|^이라 함은|^은\s|^의\s"
_NOT_SUBJECT = r"^(?:및|의|을|를|은|는|이|가|으로|로|에서|에|등)\s|(?:받는 방법의 변경|지급하지 않는 사유|및 진단확정|에 관한 세부규정|보험금 등의 지급절차)$|^\d+(?:\.\d+)?$|^(?:/?tr|/?td|/?th|일반형|제\d+편\s+일반사항|\(간편\)암)$"


def different(values: list[str]) -> list[str]:
    """The first ten different values of two to a hundred characters that are no common words and no references."""
    import re

    values = [re.sub(r"\s+", " ", v).strip(" |,.;:[]#") for v in values]
    return list(dict.fromkeys(v for v in values if v not in _COMMON and 2 <= len(v) <= 100 and not re.search(_NOT_KEY, v)))[:10]


def subjects_of(question: str) -> list[str]:
    """What is quoted or defined or ends like a benefit, a disease or a treatment, cleaned."""
    import re

    out = []
    for v in re.findall(_QUOTED, question) + re.findall(_DEFINED, question) + re.findall(_SUBJECT, question):
        v = re.sub(r"^[\s\"'“”「」『』]+|[\s\"'“”「」『』]+$", "", v)
        v = re.sub(r"\s+", " ", re.sub(r"^(?:및|또는)\s+", "", v)).strip(" |,.;:[]#")
        if 2 <= len(v) <= 60 and not re.search(_NOT_SUBJECT, v) and re.search("[가-힣A-Za-z]{2}", v):
            out.append(v)
    return different(out)


def spoken(question: str) -> Column:
    """``subject, qualifier`` of a column: what its questions are about and the values in them."""
    import re

    @F.pandas_udf("struct<subject: string, qualifier: string>")
    def run(v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"subject": ["|".join(subjects_of(x)) for x in v], "qualifier": ["|".join(different(re.findall(_VALUE, x))) for x in v]})

    return run(question)


#: Contracts that a subject may have to stand for them.
REVERSE = 3


def by_subject(q: DataFrame, tags: DataFrame) -> DataFrame:
    """``qid, contract`` with the most subjects of ``tags`` in the texts ``t`` of a question, then the smaller name.

    A subject has four characters or more and at most ``REVERSE`` contracts.
    """
    tags = tags.select(F.regexp_extract("contract_key", "^[가-힣]+", 0).alias("contract"), F.explode(F.array_distinct(F.transform("subject_key", T.compact))).alias("term"))
    tags = tags.where("char_length(term) >= 4 and contract <> ''").distinct()
    few = cut(tags.groupBy("term").agg(F.collect_set("contract").alias("contracts")).where(F.size("contracts") <= REVERSE))  # read for the subjects and for their contracts
    hits = held(q.select("qid", T.compact(F.col("t")).alias("t")), "qid", "t", few.select("term"), "term", 4).distinct()
    n = hits.join(few, "term").select("qid", F.explode("contracts").alias("contract")).groupBy("qid", "contract").agg(F.count("*").alias("n"))
    return n.groupBy("qid").agg(F.min(F.struct(-F.col("n"), "contract"))["contract"].alias("reverse"))


def tags_of(s, d) -> DataFrame | None:
    """The tags, or None where the project has none: then no subject stands for a contract."""
    try:
        return table(s, d, "element_semantic_fields_v4").select("contract_key", "subject_key")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


@query()
def route_slots(s, d):
    """The contract a question names, whole (1.0), else by its subjects (0.75), else in part (0.5), with its roles, subjects, values and kinds by rule.

    In part: six characters in common, or four that are 0.6 of the name; the longest, then the smaller name.
    """
    q = table(s, d, "train350_gold").where("qid is not null and question is not null")
    q = q.groupBy("qid", F.regexp_replace("question", r"\s+", "").alias("t")).agg(F.min("question").alias("question"))  # as ``asked``, with the words
    names = table(s, d, "elements").where("contract_scope is not null").select(F.regexp_extract("contract_scope", "^[가-힣]+", 0).alias("name")).unionByName(_names(s, d)).where("char_length(name) >= 4").distinct()
    best = named(q, names)
    if (tags := tags_of(s, d)) is not None:
        whole, x = F.coalesce(F.col("confidence") == 1.0, F.lit(False)), best.join(by_subject(q, tags), "qid", "full")
        known = ~whole & F.col("reverse").isNotNull()
        best = x.select("qid", F.when(known, F.col("reverse")).otherwise(F.col("contract")).alias("contract"), F.when(known, 0.75).otherwise(F.col("confidence")).alias("confidence"))
    by = lambda rules: F.concat_ws("|", *[F.when(F.col("question").rlike(p), n) for n, p in rules.items()])
    found = lambda p: F.array_join(F.array_distinct(F.regexp_extract_all("t", F.lit(f"({p})"), F.lit(1))), "|")
    return q.join(best, "qid", "left").withColumn("x", spoken("question")).select("qid", "contract", "confidence", by(ROLES).alias("role"), "x.subject", "x.qualifier", by(SCHEMAS).alias("schema"), *[found(_AXES[n]).alias(n) for n in ("amount", "period", "code")])


@query(f"WITH {_EL}, {_T1}, x AS (SELECT element_id, unnest(['subject', 'role', 'qualifier', 'reference']) AS field, unnest([coalesce(array_to_string(subject_key, ' '), ''), coalesce(array_to_string(role, ' '), ''), coalesce(array_to_string(qualifier, ' '), ''), coalesce(array_to_string(reference, ' '), '')]) AS body FROM element_semantic_fields_v4) SELECT field, count(DISTINCT element_id) AS elements, count(*) FILTER (body <> '') AS filled FROM x GROUP BY field")
def schema_adapter(s, d):
    """Nested tags of unknown shape put on axes by the name of their last key; here how many elements fill each axis."""
    f = table(s, d, "element_semantic_fields_v4")
    tag = F.to_json(F.struct(F.struct("subject_key", "role").alias("what"), F.struct("qualifier", F.struct("reference").alias("see")).alias("more")))
    rows = axes(f.select("element_id", tag.alias("tag")), "element_id", "tag", {"subject_key": "subject", "reference": "reference", "role": "role", "qualifier": "qualifier"})
    every = f.select("element_id", F.explode(F.array(*map(F.lit, ("subject", "role", "qualifier", "reference")))).alias("field"))
    n = every.groupBy("field").agg(F.count_distinct("element_id").alias("elements"))
    filled = rows.where("axis != 'extra' and body != ''").groupBy(F.col("axis").alias("field")).agg(F.count("*").alias("filled"))
    return n.join(filled, "field", "left").select("field", "elements", F.coalesce("filled", F.lit(0)).alias("filled"))


def adapt(tag, aliases: dict[str, str], ignored: frozenset[str] = frozenset()) -> dict[str, list[str]]:
    """Scalars of a nested value by axis: that of the nearest key with an alias; unknown ones under 'extra'.

    Keys in ``ignored`` are dropped with what is under them, as are booleans and nulls.
    """
    out: dict[str, list[str]] = {}
    todo = [(tag, None)]
    while todo:
        value, axis = todo.pop()
        if isinstance(value, dict):
            todo += [(v, aliases.get(k, axis)) for k, v in reversed(list(value.items())) if k not in ignored]
        elif isinstance(value, list):
            todo += [(v, axis) for v in reversed(value)]
        elif value is not None and not isinstance(value, bool):
            out.setdefault(axis or "extra", []).append(str(value))
    return out


def axes(df: DataFrame, key: str, tag: str, aliases: dict[str, str]) -> DataFrame:
    """``key, axis, body`` of JSON tags: the values of an axis joined by blanks."""
    import json

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = [(k, a, " ".join(v)) for k, t in zip(p[key], p[tag], strict=True) if t is not None for a, v in adapt(json.loads(t), aliases).items()]
            yield pd.DataFrame(rows, columns=["key", "axis", "body"])

    return df.select(key, tag).mapInPandas(run, "key string, axis string, body string")


NOISE = {"markup": "&nbsp;|<br>", "rule": r"(?m)^\s*=====\s*$", "omitted": r"\[표 생략\]", "page": r"(?m)^\s*-\s*[0-9]+\s*-\s*$"}


@query("SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in NOISE.items()) + ") AS profiles FROM documents WHERE text IS NOT NULL")
def predicate_noise_block(s, d):
    """The noise profiles of which any pattern matches."""
    return table(s, d, "documents").where("text is not null").select("doc_id", F.concat_ws(",", *[F.when(F.col("text").rlike(p), n) for n, p in NOISE.items()]).alias("profiles"))


@query("SELECT element_id, schema_tag FROM element_semantic_fields_v4 WHERE schema_tag = 'table' AND len(list_filter(coalesce(role, []), lambda x: lower(trim(x)) IN ('payment_amount', 'limit_frequency'))) > 0 AND len(list_filter(coalesce(subject_key, []), lambda x: trim(x) <> '')) > 0")
def filter_metadata_and(s, d):
    """All given fields: a list of names matches any of a list column, case ignored; a single value matches exactly."""
    f = table(s, d, "element_semantic_fields_v4").where(all_fields({"schema_tag": "table", "role": ["Payment_Amount", "limit_frequency"]}))
    return f.where(F.exists("subject_key", lambda x: F.trim(x) != "")).select("element_id", "schema_tag")


def all_fields(wanted: dict[str, str | list[str]]):
    """True where every field agrees: names (a list) any of a list column, case and outer blanks ignored, or one value."""
    out = F.lit(True)
    for c, v in wanted.items():
        names = [x.strip().lower() for x in v] if isinstance(v, list) else []
        out = out & F.coalesce(F.exists(c, lambda x: F.lower(F.trim(x)).isin(names)) if isinstance(v, list) else F.col(c) == v, F.lit(False))  # noqa: B023
    return out


#: Letters and digits of a code; every code inside a longer run of both is one too.
_CODE = "[A-Z]{2,4}-?[0-9]{4,6}"


@query()
def bm25f_structured_tags(s, d):
    """Tag fields by weighted BM25 of bigrams, with bonuses for a contract (2.0), an article (2.0) and each code (2.5) named.

    The bonuses are terms of fixed weight, so that the ten best are those of the whole score. A question with more
    articles is asked once for each, as one bonus is for any of them: its best scores are the largest of these.
    """
    weights = {"subject_key": 3.0, "qualifier": 1.5, "reference": 1.0, "role": 0.5, "contract": 2.0}
    f = table(s, d, "element_semantic_fields_v4").where("element_id is not null").repartitionByRange("element_id")  # one shuffle for the groups and for the order of ids
    body = {c: F.array_join(c, " ") for c in ("subject_key", "qualifier", "reference", "role")} | {"contract": F.col("contract_key")}
    wide = f.groupBy(F.col("element_id").alias("doc_id")).agg(*[F.min(F.coalesce(x, F.lit(""))).alias(c) for c, x in body.items()])
    every = lambda c, p: F.array_distinct(F.regexp_extract_all(c, F.lit(f"({p})"), F.lit(1)))
    of = lambda kind, c: F.transform(c, lambda x: F.concat(F.lit(kind), x))  # noqa: E731  (bigrams have no blanks)
    stem = F.regexp_extract("contract", "^[가-힣]+", 0)
    run = every(F.concat_ws(" ", "subject_key", "qualifier"), "[A-Z]{2,}-?[0-9]{4,}")
    inside = F.flatten(F.transform(run, lambda x: F.array(*[F.regexp_extract(x, f"[A-Z]{{{i}}}-?[0-9]{{{j}}}", 0) for i in (2, 3, 4) for j in (4, 5, 6)])))
    named = F.when(F.char_length(stem) >= 3, F.array(F.concat(F.lit(" s"), stem))).otherwise(F.array().cast("array<string>"))
    extra = F.concat(named, of(" a", every("reference", "제[0-9]+조")), of(" c", F.array_distinct(inside)))
    docs = wide.select("doc_id", *[T.bigrams(F.col(c)).alias(f"f{i}") for i, c in enumerate(weights)], extra.alias(f"f{len(weights)}"))
    q = _first(s, d).select(F.col("qid").alias("query_id"), "question")
    stems = table(s, d, "element_semantic_fields_v4").select(F.regexp_extract("contract_key", "^[가-힣]+", 0).alias("stem")).distinct().where("char_length(stem) >= 3")
    nm = held(q, "query_id", "question", stems, "stem", 3).groupBy("query_id").agg(F.collect_set("stem").alias("stems"))
    q = cut(q.join(nm, "query_id", "left").withColumn("article", F.explode_outer(every("question", "제[0-9]+조"))))  # read for the terms and for the scores
    own = F.concat(T.bigrams(F.col("question")), of(" s", F.coalesce("stems", F.array().cast("array<string>"))), of(" a", F.array_compact(F.array("article"))), of(" c", every("question", _CODE)))
    q = q.select("query_id", own.alias("tokens"))
    c = tiles.corpus(docs, q, len(weights) + 1)
    code = np.array([v.startswith(" c") for v in c.vocabulary] or [False])
    extra = np.array([v.startswith(" ") for v in c.vocabulary] or [False])
    idf = np.where(extra, np.where(code, 2.5, 2.0), np.log(1 + (c.n - c.df + 0.5) / (c.df + 0.5)))
    mean = np.where(c.lengths > 0, c.lengths / max(1, c.n), 1.0)
    w = tiles.Weights(idf, np.array([*weights.values(), 0.0]), np.array([0.5] * len(weights) + [0.0]), mean, 1.2, extra)
    found = tiles.best(c, w, docs, q, 1, 10).repartition("query_id")  # once for the largest and for the ranks
    return lexical.ranked(found.groupBy("query_id", "doc_id").agg(F.max("score").alias("score")), 10)
