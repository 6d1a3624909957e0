"""Queries on tags, routes, contracts and splits, with SQL stated from their definitions; some replace thinner ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom import queries_more  # noqa: F401  (its queries come first)
from textloom.functions import text as T
from textloom.operators.matching import anchors, contained, held
from textloom.queries import COMPACT, DOCS2, QUERIES, QUESTIONS2, RUNS, SQL, bm25_parts, grams_sql, query, ranked_sql, runs, submitted, words_sql
from textloom.sources.tables import table

# ---- SQL that now states the whole definition

SQL["bm25_bigram_candidates"] = "WITH " + bm25_parts(DOCS2, QUESTIONS2, 1.2, 0.75, True, 1) + " " + ranked_sql("SELECT query_id, doc_id, coalesce(score, 0.0) AS score FROM (SELECT query_id FROM q) CROSS JOIN (SELECT doc_id FROM d) LEFT JOIN s USING (query_id, doc_id)", 10)
SQL["str_offset_map"] = r"SELECT item_id, array_to_string(list_filter(range(0, length(question)), lambda i: NOT regexp_matches(substr(question, i + 1, 1), '\s')), ',') AS value FROM eval_items WHERE question IS NOT NULL"


def _core_sql(c: str) -> str:
    bare = rf"regexp_replace({c}, '\(무배당[^)]*\)|\(간편\)|해약환급금\s*미지급형|갱신형|일반형', '', 'g')"
    return f"replace(replace(replace({COMPACT.format(bare)}, '특약', ''), '허혈성심장질환', '허혈심장질환'), '대상포진진단', '대상포진통풍진단')"


SQL["predicate_fuzzy_contains"] = f"""WITH e AS (SELECT element_id, contract_scope, document_key, {_core_sql('text')} AS t, {_core_sql('contract_scope')} AS c FROM elements WHERE text IS NOT NULL AND contract_scope IS NOT NULL),
g AS (SELECT *, list_distinct({grams_sql('c', 3)}) AS g FROM e WHERE c <> '' AND t <> '')
SELECT element_id, contract_scope, doc_type FROM g JOIN doc_facts f ON document_key = f.doc_id
WHERE contains(t, c) OR contains(c, t) OR (least(length(c), length(t)) >= 5 AND contains(t, left(c, 3)) AND contains(t, right(c, 4)) AND len(list_filter(g, lambda x: contains(t, x))) >= 0.72 * len(g))"""

# ---- predicates and filters

_ARTICLE, _CONTRACT = r"제[0-9]+조", r"특약"


@query(rf"""SELECT element_id, length(text) AS chars, (length(text) > 4000 OR line_end - line_start + 1 > 80) AS giant, len(regexp_extract_all(text, '{_ARTICLE}')) >= 3 AS mixed_articles, len(list_distinct(regexp_extract_all(text, '[가-힣]+{_CONTRACT}'))) >= 2 AS mixed_contracts,
(element_type = 'formula' AND (length(text) > 4000 OR len(regexp_extract_all(text, '{_ARTICLE}')) >= 2 OR length(text) - length(replace(text, '|', '')) > 30)) AS bad_formula FROM elements WHERE text IS NOT NULL""")
def predicate_suspect_element(s, d):
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1)))
    chars, articles = F.char_length("text"), count(_ARTICLE)
    named = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(f"([가-힣]+{_CONTRACT})"), F.lit(1))))
    bars = chars - F.char_length(F.replace("text", F.lit("|"), F.lit("")))
    bad = (F.col("element_type") == "formula") & ((chars > 4000) | (articles >= 2) | (bars > 30))
    giant = (chars > 4000) | (F.col("line_end") - F.col("line_start") + 1 > 80)
    return table(s, d, "elements").where("text is not null").select("element_id", chars.alias("chars"), giant.alias("giant"), (articles >= 3).alias("mixed_articles"), (named >= 2).alias("mixed_contracts"), bad.alias("bad_formula"))


GATES = {"duration": "며칠|기간|개월", "amount": "얼마|금액|만원", "place": "어디|조항", "condition": "경우|도 .*있습니까"}


def gates(question, names: list[str]):
    """The given surface gates that a question opens, in their order; a name that is no gate raises."""
    unknown = sorted(set(names) - set(GATES))
    if unknown:
        raise ValueError(f"unknown gates: {', '.join(unknown)}")
    return F.concat_ws(",", *[F.when(question.rlike(GATES[n]), n) for n in names])


@query("SELECT qid, question, concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(question, '{p}') THEN '{n}' END" for n, p in GATES.items()) + ") AS gates FROM train350_gold WHERE question IS NOT NULL")
def predicate_gates_surface(s, d):
    return table(s, d, "train350_gold").where("question is not null").select("qid", "question", gates(F.col("question"), list(GATES)).alias("gates"))


_TAX = "element_type = 'text' AND contract_scope <> '' AND title IS NOT NULL"


@query(f"SELECT element_id, element_type, contract_scope, (SELECT count(*) FROM elements WHERE {_TAX}) AS matched, (SELECT count(*) FROM elements) AS searched FROM elements WHERE {_TAX}")
def filter_taxonomy_exact(s, d):
    e = table(s, d, "elements")
    n = e.agg(F.count_if(F.expr(_TAX)).alias("matched"), F.count("*").alias("searched"))
    return e.where(_TAX).select("element_id", "element_type", "contract_scope").crossJoin(F.broadcast(n))  # one row


_NORM = "list_distinct(list_filter(list_transform(coalesce({}, []), lambda x: lower(trim(x))), lambda x: x <> ''))"
_SLOT_FROM = f"WITH f AS (SELECT DISTINCT element_id, {_NORM.format('role')} AS role, {_NORM.format('qualifier')} AS qualifier, {_NORM.format('reference')} AS reference FROM element_semantic_fields_v4), m AS (SELECT * FROM f WHERE list_has_any(role, ['payment_amount', 'limit_frequency']) AND len(list_filter(qualifier, lambda x: regexp_matches(x, '^[0-9]+(일|%)$'))) > 0)"


@query(f"""{_SLOT_FROM} SELECT 'match' AS kind, NULL AS value, element_id, CAST(NULL AS BIGINT) AS n FROM m UNION ALL SELECT 'slot', 'role', NULL, count(*) FROM f WHERE list_has_any(role, ['payment_amount', 'limit_frequency'])
UNION ALL SELECT 'slot', 'qualifier', NULL, count(*) FROM f WHERE len(list_filter(qualifier, lambda x: regexp_matches(x, '^[0-9]+(일|%)$'))) > 0
UNION ALL SELECT 'refine', value, NULL, n FROM (SELECT value, count(*) AS n FROM (SELECT unnest(reference) AS value FROM m) GROUP BY value ORDER BY n DESC, value LIMIT 8)""")
def filter_slot_and(s, d):
    """Matches of all slots (any value of one), counts of each slot alone, and the eight commonest values of the unused slot."""
    norm = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))), lambda x: x != "")).alias(c)
    f = table(s, d, "element_semantic_fields_v4").select("element_id", norm("role"), norm("qualifier"), norm("reference")).distinct()
    role, value = F.arrays_overlap("role", F.array(F.lit("payment_amount"), F.lit("limit_frequency"))), F.exists("qualifier", lambda x: x.rlike("^[0-9]+(일|%)$"))
    null = lambda t: F.lit(None).cast(t)
    m = f.where(role & value)
    out = m.select(F.lit("match").alias("kind"), null("string").alias("value"), "element_id", null("long").alias("n"))
    for name, c in (("role", role), ("qualifier", value)):
        out = out.unionByName(f.agg(F.count_if(c).alias("n")).select(F.lit("slot").alias("kind"), F.lit(name).alias("value"), null("string").alias("element_id"), "n"))
    refine = m.select(F.explode("reference").alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "value").limit(8)
    return out.unionByName(refine.select(F.lit("refine").alias("kind"), "value", null("string").alias("element_id"), "n"))


@query(r"SELECT doc_id, marker FROM (SELECT doc_id, unnest(list_filter([CASE WHEN regexp_matches(text, '(?i)answer\s*[:=]') THEN 'answer' END, CASE WHEN contains(text, '정답') THEN '정답' END, CASE WHEN regexp_matches(text, 'gold_[a-z]+') THEN 'gold' END, CASE WHEN regexp_matches(text, '<<<|>>>') THEN 'merge' END, CASE WHEN regexp_matches(text, '\[표 생략\]') THEN 'omitted' END], lambda x: x IS NOT NULL)) AS marker FROM documents WHERE text IS NOT NULL)")
def input_guard(s, d):
    """Documents with a marker that inputs must not have; ``matching.refuse`` raises where there is one."""
    from textloom.operators.matching import forbidden

    return forbidden(table(s, d, "documents").where("text is not null"), "doc_id", "text")


# ---- text scalars

# The particles that are taken off a word, the longest that fits.
PARTICLES = ("은", "는", "이", "가", "을", "를", "의", "에", "에서", "으로", "로", "와", "과", "도", "만", "까지", "부터", "에게", "한테")
_LONGEST = sorted(PARTICLES, key=len, reverse=True)


def stem(w):
    """The word without the longest particle that leaves two characters or more, of words over two characters."""
    out = w
    for p in reversed(_LONGEST):
        out = F.when(w.endswith(p) & (F.char_length(w) - len(p) >= 2), F.substring(w, F.lit(1), F.char_length(w) - len(p))).otherwise(out)
    return F.when(F.char_length(w) > 2, out).otherwise(w)


_STEM = "CASE WHEN length(w) <= 2 THEN w " + " ".join(f"WHEN suffix(w, '{p}') AND length(w) >= {len(p) + 2} THEN left(w, length(w) - {len(p)})" for p in _LONGEST) + " ELSE w END"
QUERIES["tokenize_ko_suffix_strip"] = lambda s, d: table(s, d, "elements").where("text is not null").select("element_id", F.array_join(F.transform(T.words(F.col("text")), stem), " ").alias("value"))
SQL["tokenize_ko_suffix_strip"] = f"SELECT element_id, array_to_string(list_transform({words_sql('text')}, lambda w: {_STEM}), ' ') AS value FROM elements WHERE text IS NOT NULL"

_STOP = ("받은", "환자도", "있습니까", "어디에", "있나요", "조항은", "줄어드는")


@query("SELECT qid, array_to_string(list_distinct_in_order, '|') AS tokens FROM (SELECT qid, list_filter(w, lambda x, i: list_position(w, x) = i) AS list_distinct_in_order FROM (SELECT qid, list_filter(" + words_sql("question") + ", lambda w: length(w) BETWEEN 4 AND 14 AND regexp_matches(w, '[가-힣]') AND NOT regexp_matches(w, '^(19|20)[0-9]{2}년?$|약관|사업방법서|상품요약서') AND NOT list_contains(['" + "', '".join(_STOP) + "'], w)) AS w FROM train350_gold WHERE question IS NOT NULL))")
def verify_tokens(s, d):
    """Surface tokens of 4 to 14 characters with Hangul, without template words, years and document types."""
    keep = lambda w: F.char_length(w).between(4, 14) & w.rlike("[가-힣]") & ~w.rlike("^(19|20)[0-9]{2}년?$|약관|사업방법서|상품요약서") & ~w.isin(*_STOP)
    return table(s, d, "train350_gold").where("question is not null").select("qid", F.array_join(F.array_distinct(F.filter(T.words(F.col("question")), keep)), "|").alias("tokens"))


def judgment(output):
    """'correct' or 'incorrect' where that is the whole trimmed output, case ignored; else 'format_error'."""
    t = F.lower(F.regexp_replace(output, r"^\s+|\s+$", ""))
    return F.when(t.isin("correct", "incorrect"), t).otherwise("format_error")


_OUT = r"CASE WHEN error <> 0 THEN 'The answer is incorrect.' WHEN r5 IS NULL THEN NULL WHEN r5 >= 0.5 THEN chr(10) || ' Correct ' WHEN r5 > 0 THEN 'incorrect' ELSE 'INCORRECT!' END"


@query(rf"SELECT run_id, qid, rep, CASE WHEN lower(trim(o, ' ' || chr(10))) IN ('correct', 'incorrect') THEN lower(trim(o, ' ' || chr(10))) ELSE 'format_error' END AS verdict FROM (SELECT DISTINCT run_id, qid, rep, {_OUT} AS o FROM results WHERE qid IS NOT NULL)")
def json_parse_judgment(s, d):
    """Judge outputs, here written from each run's figures in the ways that judges answer."""
    o = F.when(F.col("error") != 0, "The answer is incorrect.").when(F.col("r5").isNull(), None).when(F.col("r5") >= 0.5, "\n Correct ").when(F.col("r5") > 0, "incorrect").otherwise("INCORRECT!")
    return table(s, d, "results").where("qid is not null").select("run_id", "qid", "rep", o.alias("o")).distinct().select("run_id", "qid", "rep", judgment(F.col("o")).alias("verdict"))


# ---- contracts, ledgers, splits

_SUM = "CAST(sum(('0x' || left(sha256(CAST(doc_id AS VARCHAR) || '|' || coalesce(text, '')), 12))::BIGINT) AS DECIMAL(38, 0))::VARCHAR"


@query(f"WITH a AS (SELECT source, count(*) AS n, {_SUM} AS c FROM documents WHERE loaded_at < created_at + INTERVAL 30 DAY GROUP BY source), b AS (SELECT source, count(*) AS n, {_SUM} AS c FROM documents GROUP BY source) SELECT b.source, a.n AS frozen, b.n AS found, coalesce(a.c = b.c, FALSE) AS unchanged FROM b LEFT JOIN a ON a.source IS NOT DISTINCT FROM b.source")
def freeze_verify(s, d):
    """Documents of each source against what was frozen of them: those loaded within 30 days. ``matching.refuse_changed`` raises."""
    from textloom.operators.matching import frozen

    docs = table(s, d, "documents")
    a = frozen(docs.where(F.col("loaded_at") < F.col("created_at") + F.expr("interval 30 days")), "source", ["doc_id", "text"]).toDF("source", "frozen", "was")
    b = frozen(docs, "source", ["doc_id", "text"]).toDF("s", "found", "now")
    x = b.join(a, F.col("s").eqNullSafe(F.col("source")), "left")
    return x.select(F.col("s").alias("source"), "frozen", "found", F.coalesce(F.col("was") == F.col("now"), F.lit(False)).alias("unchanged"))


@query("""WITH o AS (SELECT document_key, char_start, char_end, text, min(chunk_id) AS old_id FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL),
n AS (SELECT DISTINCT element_id, document_key, char_start, char_end, text FROM elements WHERE text IS NOT NULL AND char_start IS NOT NULL AND char_end IS NOT NULL)
SELECT element_id, coalesce(old_id, 'n-' || left(sha256(concat_ws('|', n.document_key, n.char_start, n.char_end, n.text)), 16)) AS id FROM n LEFT JOIN o USING (document_key, char_start, char_end, text)""")
def id_stabilize(s, d):
    from textloom.operators.matching import stable_ids

    n = table(s, d, "elements").where("text is not null and char_start is not null and char_end is not null").select("element_id", "document_key", "char_start", "char_end", "text").distinct()
    o = table(s, d, "chunks").where("text is not null and chunk_id is not null").groupBy("document_key", "char_start", "char_end", "text").agg(F.min("chunk_id").alias("id"))
    return stable_ids(n, o, ["document_key", "char_start", "char_end", "text"]).select("element_id", "id")


@query("""WITH x AS (SELECT qid, question, gold_chunk_ids, row_number() OVER (PARTITION BY qid ORDER BY loaded_at DESC NULLS LAST, question DESC NULLS LAST) AS rn FROM train350_gold WHERE qid IS NOT NULL),
v AS (SELECT qid, count(*) AS edits, count(DISTINCT coalesce(array_to_string(gold_chunk_ids, ','), '-')) AS opinions FROM train350_gold WHERE qid IS NOT NULL GROUP BY qid)
SELECT x.qid, question, array_to_string(list_sort(list_distinct(list_filter(gold_chunk_ids, lambda c: c IS NOT NULL))), ',') AS gold, edits, CASE WHEN edits = 1 THEN 'single' WHEN opinions = 1 THEN 'agreed' ELSE 'replaced' END AS adjudication FROM x JOIN v USING (qid) WHERE rn = 1""")
def gold_ledger_apply(s, d):
    """The gold after all edits in order: the row loaded last replaces those before it; equal reviews agree."""
    t = table(s, d, "train350_gold").where("qid is not null")
    w = Window.partitionBy("qid").orderBy(F.col("loaded_at").desc_nulls_last(), F.col("question").desc_nulls_last())
    last = t.withColumn("rn", F.row_number().over(w)).where("rn = 1")
    v = t.groupBy("qid").agg(F.count("*").alias("edits"), F.count_distinct(F.coalesce(F.array_join("gold_chunk_ids", ","), F.lit("-"))).alias("opinions"))
    how = F.when(F.col("edits") == 1, "single").when(F.col("opinions") == 1, "agreed").otherwise("replaced")
    return last.join(v, "qid").select("qid", "question", F.array_join(F.array_sort(F.array_distinct(F.array_compact("gold_chunk_ids"))), ",").alias("gold"), "edits", how.alias("adjudication"))


_STRATA = "WITH n AS (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source), e AS (SELECT source, n, 100.0 * n / sum(n) OVER () AS exact FROM n), q AS (SELECT *, greatest(1, floor(exact))::BIGINT AS base, exact - floor(exact) AS rest FROM e), r AS (SELECT source, n, base, row_number() OVER (ORDER BY CASE WHEN exact < 1 THEN -1 ELSE rest END DESC, source) AS pos, 100 - sum(base) OVER () AS open FROM q), a AS (SELECT source, n, least(n, base + CASE WHEN pos <= open THEN 1 ELSE 0 END) AS quota FROM r)"


@query(f"{_STRATA}, p AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('17|' || doc_id)) - 1 AS pos FROM documents WHERE source IS NOT NULL) SELECT doc_id, p.source, quota FROM p JOIN a USING (source) WHERE list_contains(list_transform(range(0, quota), lambda i: (i * n) // quota), pos)")
def win_stratified_even_sample(s, d):
    """A hundred documents: each source's share with at least one, open places by largest remainder, taken evenly in hash order."""
    docs = table(s, d, "documents").where("source is not null")
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    n = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("t")))).withColumn("exact", F.lit(100.0) * F.col("n") / F.col("t"))  # one row
    n = n.withColumn("base", F.greatest(F.lit(1), F.floor("exact"))).withColumn("rest", F.when(F.col("exact") < 1, -1.0).otherwise(F.col("exact") - F.floor("exact")))
    n = n.crossJoin(F.broadcast(n.agg((F.lit(100) - F.sum("base")).alias("open"))))  # one row
    n = n.withColumn("at", F.row_number().over(Window.orderBy(F.col("rest").desc(), "source")))  # a row a source
    n = n.select("source", "n", F.least("n", F.col("base") + (F.col("at") <= F.col("open")).cast("long")).alias("quota"))
    w = Window.partitionBy("source").orderBy(F.sha2(F.concat(F.lit("17|"), F.col("doc_id").cast("string")), 256))
    p = docs.select("doc_id", "source").withColumn("pos", F.row_number().over(w) - 1).join(F.broadcast(n), "source")
    taken = F.exists(F.sequence(F.lit(0).cast("long"), F.col("quota") - 1), lambda i: F.floor(i * F.col("n") / F.col("quota")) == F.col("pos"))
    return p.where(taken).select("doc_id", "source", "quota")


@query("WITH t AS (SELECT DISTINCT qid, business_type AS intent FROM train350_gold WHERE qid IS NOT NULL AND business_type IS NOT NULL), i AS (SELECT intent, CASE (row_number() OVER (ORDER BY intent)) % 3 WHEN 2 THEN 40 ELSE 30 END AS quota FROM (SELECT DISTINCT intent FROM t)) SELECT qid, intent, CASE WHEN row_number() OVER (PARTITION BY intent ORDER BY sha256(qid), qid) <= quota THEN 'dev' ELSE 'test' END AS part FROM t JOIN i USING (intent)")
def split_assign_hash(s, d):
    """Per intent in hash order the first 30, 40, 30, ... are dev, the rest test."""
    t = table(s, d, "train350_gold").where("qid is not null and business_type is not null").select("qid", F.col("business_type").alias("intent")).distinct()
    i = t.select("intent").distinct().withColumn("no", F.row_number().over(Window.orderBy("intent"))).select("intent", F.when(F.col("no") % 3 == 2, 40).otherwise(30).alias("quota"))  # a row an intent
    w = Window.partitionBy("intent").orderBy(F.sha2("qid", 256), "qid")
    return t.join(F.broadcast(i), "intent").select("qid", "intent", F.when(F.row_number().over(w) <= F.col("quota"), "dev").otherwise("test").alias("part"))


_P = "SELECT lang, doc_type, count(*) AS c FROM documents WHERE lang IS NOT NULL AND doc_type IS NOT NULL GROUP BY ALL"


@query(f"""WITH c AS ({_P}), p AS (SELECT lang, doc_type, c / sum(c) OVER (PARTITION BY lang) AS p FROM c), l AS (SELECT DISTINCT lang FROM p), t AS (SELECT DISTINCT doc_type FROM p),
f AS (SELECT l.lang, t.doc_type, coalesce(p.p, 0.0) AS p FROM l CROSS JOIN t LEFT JOIN p ON p.lang = l.lang AND p.doc_type = t.doc_type)
SELECT a.lang AS lang_a, b.lang AS lang_b, round(sum(a.p * b.p) / sqrt(sum(a.p * a.p) * sum(b.p * b.p)), 6) AS cosine, round(max(abs(a.p - b.p)), 6) AS max_difference, round(avg(abs(a.p - b.p)), 6) AS mean_difference FROM f a JOIN f b ON a.doc_type = b.doc_type AND a.lang < b.lang GROUP BY ALL""")
def eda_prevalence_similarity(s, d):
    """Cosine and absolute differences of label shares; a label that a language lacks has share 0."""
    c = table(s, d, "documents").where("lang is not null and doc_type is not null").groupBy("lang", "doc_type").agg(F.count("*").alias("c"))
    p = c.join(c.groupBy("lang").agg(F.sum("c").alias("t")), "lang").select("lang", "doc_type", (F.col("c") / F.col("t")).alias("p"))
    every = p.select("lang").distinct().crossJoin(F.broadcast(p.select("doc_type").distinct()))  # languages by labels
    f = every.join(p, ["lang", "doc_type"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    x = f.toDF("lang_a", "doc_type", "a").join(f.toDF("lang_b", "doc_type", "b"), "doc_type").where("lang_a < lang_b")
    cosine = F.sum(F.expr("a * b")) / F.sqrt(F.sum(F.expr("a * a")) * F.sum(F.expr("b * b")))
    gap = F.abs(F.col("a") - F.col("b"))
    return x.groupBy("lang_a", "lang_b").agg(F.round(cosine, 6).alias("cosine"), F.round(F.max(gap), 6).alias("max_difference"), F.round(F.avg(gap), 6).alias("mean_difference"))


# ---- names, catalogues and phrases inside questions

_QS = "q AS (SELECT DISTINCT qid, regexp_replace(question, '\\s+', '', 'g') AS t FROM train350_gold WHERE qid IS NOT NULL AND question IS NOT NULL)"
_NAMES = "n AS (SELECT DISTINCT regexp_extract(clean_name, '^[가-힣]+') AS name FROM doc_facts WHERE length(regexp_extract(clean_name, '^[가-힣]+')) >= 6)"


def asked(s, d) -> DataFrame:
    q = table(s, d, "train350_gold").where("qid is not null and question is not null")
    return q.select("qid", F.regexp_replace("question", r"\s+", "").alias("t")).distinct()


@query(f"WITH {_QS}, {_NAMES}, m AS (SELECT qid, name FROM q JOIN n ON contains(t, name)) SELECT qid, name, 2.0 AS bonus FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.qid = m.qid AND length(o.name) > length(m.name) AND contains(o.name, m.name))")
def exact_identity_bonus(s, d):
    """Names of six characters or more that a question holds, none that lies in a longer one of its names."""
    name = F.regexp_extract("clean_name", "^[가-힣]+", 0)
    n = table(s, d, "doc_facts").where("clean_name is not null").select(name.alias("name")).where("char_length(name) >= 6").distinct()
    m = contained(asked(s, d), "t", n, "name", 6).select("qid", "name").distinct()
    longer = m.select(F.col("qid").alias("q"), F.col("name").alias("o"))
    nested = (F.col("q") == F.col("qid")) & (F.char_length("o") > F.char_length("name")) & F.contains(F.col("o"), F.col("name"))
    return m.join(longer, nested, "left_anti").withColumn("bonus", F.lit(2.0))


_STEMS = "SELECT DISTINCT regexp_extract(contract_scope, '^[가-힣]+') AS title, document_key FROM elements WHERE length(regexp_extract(contract_scope, '^[가-힣]+')) >= 5 AND document_key IS NOT NULL"


@query(f"""WITH {_QS}, c AS ({_STEMS}), u AS (SELECT title, count(*) AS documents, min(document_key) AS document_key FROM c GROUP BY title), m AS (SELECT qid, title, documents, document_key, rank() OVER (PARTITION BY qid ORDER BY length(title) DESC) AS r FROM q JOIN u ON contains(t, title)),
o AS (SELECT qid, count(*) AS k FROM m WHERE r = 1 GROUP BY qid) SELECT m.qid, title, document_key FROM m JOIN o USING (qid) WHERE r = 1 AND k = 1 AND documents = 1""")
def join_table_catalog(s, d):
    """The longest catalogue title that a question holds; a title of several documents, or two as long, gives nothing."""
    title = F.regexp_extract("contract_scope", "^[가-힣]+", 0)
    c = table(s, d, "elements").where("contract_scope is not null and document_key is not null").select(title.alias("title"), "document_key").where("char_length(title) >= 5").distinct()
    u = c.groupBy("title").agg(F.count("*").alias("documents"), F.min("document_key").alias("document_key"))
    m = held(asked(s, d), "qid", "t", u, "title", 5, longest=True).distinct().join(u, "title")
    w = Window.partitionBy("qid")
    m = m.withColumn("r", F.rank().over(w.orderBy(F.char_length("title").desc()))).where("r = 1").withColumn("k", F.count("*").over(w))
    return m.where("k = 1 and documents = 1").select("qid", "title", "document_key")


@query(r"""WITH p AS (SELECT DISTINCT regexp_replace(title, '\s+', '', 'g') AS phrase FROM elements WHERE length(regexp_replace(title, '\s+', '', 'g')) >= 6), e AS (SELECT DISTINCT document_key, regexp_replace(text, '\s+', '', 'g') AS t FROM elements WHERE text IS NOT NULL AND document_key IS NOT NULL)
SELECT phrase, count(DISTINCT document_key) AS documents FROM p JOIN e ON contains(t, phrase) GROUP BY phrase""")
def join_near_contains(s, d):
    """Documents that hold a phrase, white space ignored."""
    e = table(s, d, "elements")
    p = e.where("title is not null").select(F.regexp_replace("title", r"\s+", "").alias("phrase")).where("char_length(phrase) >= 6").distinct()
    t = e.where("text is not null and document_key is not null").select("document_key", F.regexp_replace("text", r"\s+", "").alias("t")).distinct()
    return contained(t, "t", p, "phrase", 6).groupBy("phrase").agg(F.count_distinct("document_key").alias("documents"))


@query(r"""WITH k AS (SELECT DISTINCT g.qid, c.chunk_id, c.contract_scope, left(regexp_replace(c.text, '\s+', '', 'g'), 30) AS key FROM (SELECT qid, unnest(gold_chunk_ids) AS chunk_id FROM train350_gold WHERE qid IS NOT NULL) g JOIN chunks c USING (chunk_id) WHERE c.text IS NOT NULL AND c.contract_scope IS NOT NULL),
o AS (SELECT DISTINCT chunk_id AS member, contract_scope, regexp_replace(text, '\s+', '', 'g') AS t FROM chunks WHERE text IS NOT NULL AND chunk_id IS NOT NULL), m AS (SELECT DISTINCT qid, k.chunk_id, member FROM k JOIN o ON k.contract_scope = o.contract_scope AND contains(t, key) WHERE length(key) = 30),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY CASE WHEN member = chunk_id THEN 0 ELSE 1 END, member) AS n FROM m) SELECT qid, chunk_id, member FROM r WHERE n <= 10""")
def gold_occurrence_expand(s, d):
    """Chunks of the same contract that hold the first 30 characters of a gold chunk, as alternatives: at most ten, itself first."""
    c = table(s, d, "chunks").where("text is not null and chunk_id is not null and contract_scope is not null").select("chunk_id", "contract_scope", F.regexp_replace("text", r"\s+", "").alias("t")).distinct()
    g = table(s, d, "train350_gold").where("qid is not null").select("qid", F.explode("gold_chunk_ids").alias("chunk_id")).distinct()
    k = g.join(c, "chunk_id").select("qid", "chunk_id", F.col("contract_scope").alias("scope"), F.substring("t", 1, 30).alias("key")).where("char_length(key) = 30").distinct()
    own = k.select("scope", "key").distinct().select("scope", "key", F.explode(anchors("key", 30)).alias("a"))
    o = c.withColumn("row", F.xxhash64("chunk_id", "contract_scope", "t"))
    at = o.select("row", F.col("contract_scope").alias("scope"), F.explode(anchors("t", 30)).alias("a"))
    place = F.xxhash64("scope", "a").alias("place")
    met = at.select("row", place).join(own.select("scope", "key", place), "place").select("row", "scope", "key")
    m = o.join(met, "row").where((F.col("scope") == F.col("contract_scope")) & F.contains("t", "key")).select("scope", "key", F.col("chunk_id").alias("member")).distinct()
    first = Window.partitionBy("scope", "key").orderBy("member")
    ten = m.withColumn("n", F.row_number().over(first)).where("n <= 10").drop("n")  # a gold chunk itself and nine more are shown
    x = k.join(ten, ["scope", "key"]).select("qid", "chunk_id", "member").unionByName(k.select("qid", "chunk_id", F.col("chunk_id").alias("member"))).distinct()
    w = Window.partitionBy("qid", "chunk_id").orderBy(F.when(F.col("member") == F.col("chunk_id"), 0).otherwise(1), "member")
    return x.withColumn("n", F.row_number().over(w)).where("n <= 10").drop("n")


# ---- metrics

_SPAN = "SELECT chunk_id, min(document_key) AS doc, min(char_start) AS a, max(char_end) AS b FROM chunks WHERE chunk_id IS NOT NULL AND document_key IS NOT NULL AND char_start IS NOT NULL AND char_end IS NOT NULL GROUP BY chunk_id"


@query(f"""WITH {RUNS}, sp AS ({_SPAN}), h AS (SELECT rk.query_id, min(rank) AS first_rank FROM rk JOIN sp x ON rk.doc_id = x.chunk_id JOIN gd USING (query_id) JOIN sp y ON gd.doc_id = y.chunk_id WHERE x.doc = y.doc AND x.a < y.b AND y.a < x.b GROUP BY rk.query_id)
SELECT query_id, first_rank, coalesce(first_rank <= 1, FALSE) AS r1, coalesce(first_rank <= 5, FALSE) AS r5, coalesce(first_rank <= 10, FALSE) AS r10, round(coalesce(1.0 / first_rank, 0), 6) AS mrr FROM k LEFT JOIN h USING (query_id)""")
def metric_first_rank_overlap(s, d):
    """The first submitted unit that overlaps a gold span of its document; recall at 1, 5, 10 and reciprocal rank."""
    from textloom.queries import judged

    r = runs(s, d)
    c = table(s, d, "chunks").where("chunk_id is not null and document_key is not null and char_start is not null and char_end is not null")
    sp = c.groupBy("chunk_id").agg(F.min("document_key").alias("doc"), F.min("char_start").alias("a"), F.max("char_end").alias("b"))
    x = submitted(r).join(sp.toDF("doc_id", "doc", "a", "b"), "doc_id")
    y = judged(r).join(sp.toDF("doc_id", "gdoc", "ga", "gb"), "doc_id").drop("doc_id")
    h = x.join(y, "query_id").where("doc = gdoc and a < gb and ga < b").groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    at = lambda k: F.coalesce(F.col("first_rank") <= k, F.lit(False)).alias(f"r{k}")
    return r.select("query_id").join(h, "query_id", "left").select("query_id", "first_rank", at(1), at(5), at(10), F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("mrr"))


# ---- routes

@query("""WITH t AS (SELECT DISTINCT f.element_id, lower(trim(r)) AS role, e.title FROM (SELECT element_id, unnest(role) AS r FROM element_semantic_fields_v4) f JOIN (SELECT DISTINCT element_id, trim(regexp_replace(title, '^[#\\s]*제?[0-9]+조?(의[0-9]+)?\\s*', '')) AS title FROM elements WHERE title IS NOT NULL) e USING (element_id) WHERE r IS NOT NULL),
n AS (SELECT role, title, count(*) AS n FROM t WHERE role <> '' AND title <> '' GROUP BY ALL HAVING count(*) >= 2) SELECT role, title, n FROM (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n DESC, title) AS pos FROM n) WHERE pos <= 4""")
def route_intent_roles(s, d):
    """The four title phrases that a role has most often, of those it has twice or more."""
    title = F.trim(F.regexp_replace("title", r"^[#\s]*제?[0-9]+조?(의[0-9]+)?\s*", ""))
    e = table(s, d, "elements").where("title is not null").select("element_id", title.alias("title")).distinct()
    f = table(s, d, "element_semantic_fields_v4").select("element_id", F.explode("role").alias("r")).where("r is not null").select("element_id", F.lower(F.trim("r")).alias("role"))
    n = f.join(e, "element_id").where("role != '' and title != ''").distinct().groupBy("role", "title").agg(F.count("*").alias("n")).where("n >= 2")
    w = Window.partitionBy("role").orderBy(F.col("n").desc(), "title")
    return n.withColumn("at", F.row_number().over(w)).where("at <= 4").drop("at")


@query("WITH f AS (SELECT DISTINCT element_id, list_filter(list_transform(coalesce(role, []), lambda x: lower(trim(x))), lambda x: x <> '') AS r FROM element_semantic_fields_v4), x AS (SELECT element_id, r, list_distinct(list_transform(r, lambda v: split_part(v, '_', 1))) AS families FROM f) SELECT element_id, array_to_string(list_sort(list_transform(families, lambda g: list_sort(list_filter(r, lambda v: split_part(v, '_', 1) = g))[1])), ',') AS roles FROM x WHERE len(families) >= 2")
def route_claim_roles(s, d):
    """Roles collapsed to families with the first of each as its representative, where two families or more are asked for."""
    r = F.filter(F.transform("role", lambda x: F.lower(F.trim(x))), lambda x: x != "")
    f = table(s, d, "element_semantic_fields_v4").where("role is not null").select("element_id", r.alias("r")).distinct()
    family = lambda v: F.split_part(v, F.lit("_"), F.lit(1))
    f = f.withColumn("families", F.array_distinct(F.transform("r", family))).where(F.size("families") >= 2)
    roles = F.transform("families", lambda g: F.array_min(F.filter("r", lambda v: family(v) == g)))
    return f.select("element_id", F.array_join(F.array_sort(roles), ",").alias("roles"))


_MEMBER = r"([가-힣]+)[을를] 받은 ([가-힣A-Za-z]+) 환자"


@query(f"""WITH q AS (SELECT DISTINCT qid, regexp_extract(question, '{_MEMBER}', 2) AS category, regexp_extract(question, '{_MEMBER}', 1) AS member FROM train350_gold WHERE qid IS NOT NULL AND regexp_matches(question, '{_MEMBER}')),
e AS (SELECT DISTINCT contract_scope, text FROM elements WHERE text IS NOT NULL AND contract_scope <> '') SELECT qid, category, member, count(DISTINCT contract_scope) AS scopes FROM q LEFT JOIN e ON contains(e.text, q.category) GROUP BY ALL""")
def route_membership_plan(s, d):
    """Category and member named by a question, and the contracts whose texts hold the category."""
    q = table(s, d, "train350_gold").where("qid is not null").where(F.col("question").rlike(_MEMBER))
    q = q.select("qid", F.regexp_extract("question", _MEMBER, 2).alias("category"), F.regexp_extract("question", _MEMBER, 1).alias("member")).distinct()
    e = table(s, d, "elements").where("text is not null and contract_scope != ''").select("contract_scope", "text").distinct()
    n = contained(e, "text", q.select("category").distinct(), "category", 1).groupBy("category").agg(F.count_distinct("contract_scope").alias("scopes"))
    return q.join(n, "category", "left").select("qid", "category", "member", F.coalesce("scopes", F.lit(0)).alias("scopes"))


@query("WITH c AS (SELECT qid, CASE WHEN regexp_matches(question, '[가-힣]{3,}(보험|특약)') THEN 1.0 WHEN regexp_matches(question, '보험|특약') THEN 0.75 ELSE 0.5 END AS confidence FROM (SELECT DISTINCT qid, question FROM train350_gold WHERE qid IS NOT NULL AND question IS NOT NULL)) SELECT qid, confidence::DOUBLE AS confidence, (3.0 * confidence)::DOUBLE AS w_contract, (2.0 * confidence)::DOUBLE AS w_title, 1.0::DOUBLE AS w_text FROM c")
def route_confidence_weights(s, d):
    """Weights of the identity fields times the confidence of the identity; the text keeps its own."""
    q = table(s, d, "train350_gold").where("qid is not null and question is not null").select("qid", "question").distinct()
    c = F.when(F.col("question").rlike("[가-힣]{3,}(보험|특약)"), 1.0).when(F.col("question").rlike("보험|특약"), 0.75).otherwise(0.5)
    return q.select("qid", c.alias("confidence")).select("qid", "confidence", (3.0 * F.col("confidence")).alias("w_contract"), (2.0 * F.col("confidence")).alias("w_title"), F.lit(1.0).alias("w_text"))


@query("WITH x AS (SELECT qid, question, question_types, row_number() OVER (PARTITION BY qid ORDER BY loaded_at NULLS LAST, question) AS n FROM train350_gold WHERE qid IS NOT NULL AND question IS NOT NULL) SELECT qid, CASE WHEN len(question_types) >= 2 THEN 'portfolio' WHEN regexp_matches(question, '그리고|또는|및') THEN 'portfolio' ELSE 'single' END AS mode FROM x WHERE n = 1")
def portfolio_mode_effective(s, d):
    """The mode that the first wording of a question sets; later wordings do not change it."""
    w = Window.partitionBy("qid").orderBy(F.col("loaded_at").asc_nulls_last(), "question")
    x = table(s, d, "train350_gold").where("qid is not null and question is not null").withColumn("n", F.row_number().over(w)).where("n = 1")
    return x.select("qid", F.when((F.size("question_types") >= 2) | F.col("question").rlike("그리고|또는|및"), "portfolio").otherwise("single").alias("mode"))


# ---- features by rule

_FEATURES = {"amounts": r"[0-9][0-9,]*(?:만원|원)", "periods": r"[0-9]+(?:일|개월|년|세)", "shares": r"[0-9.]+%", "articles": r"제[0-9]+조(?:의[0-9]+)?", "codes": r"[A-Z]{2,4}-?[0-9]{4,6}", "conditions": r"[가-힣]+ (?:경우|때)"}


def _found(name: str, pattern: str, source: str, key: str) -> None:
    inner = ", ".join(f"array_to_string(list_filter({n}, lambda x, i: list_position({n}, x) = i), '|') AS {n}" for n in _FEATURES)
    SQL[name] = f"SELECT {key}, {inner} FROM (SELECT {key}, " + ", ".join(f"regexp_extract_all(text, '{p}') AS {n}" for n, p in _FEATURES.items()) + f" FROM {source} WHERE text IS NOT NULL)"

    def f(s, d):
        one = lambda p: F.array_join(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1))), "|")
        return table(s, d, source).where("text is not null").select(key, *[one(p).alias(n) for n, p in _FEATURES.items()])

    QUERIES[name] = f


_found("tag_rules_extract", "", "elements", "element_id")


@query(r"SELECT doc_id, array_to_string(list_slice(regexp_extract_all(text, '#+ [^\n]*'), 1, 5), '|') AS headings, array_to_string(list_slice(list_filter(c, lambda x, i: list_position(c, x) = i), 1, 5), '|') AS codes, array_to_string(list_slice(list_filter(t, lambda x, i: list_position(t, x) = i), 1, 5), '|') AS tables FROM (SELECT doc_id, text, regexp_extract_all(text, '[A-Z]{2,4}-?[0-9]{4,6}') AS c, regexp_extract_all(text, '\[?(?:별표|부표) [0-9]+\]?') AS t FROM documents WHERE text IS NOT NULL)")
def frontmatter_extract(s, d):
    """Headings, codes and table names of a document in order, the first five of each; codes and tables once."""
    all_of = lambda p: F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1))
    five = lambda c: F.array_join(F.slice(c, 1, 5), "|")
    return table(s, d, "documents").where("text is not null").select("doc_id", five(all_of(r"#+ [^\n]*")).alias("headings"), five(F.array_distinct(all_of("[A-Z]{2,4}-?[0-9]{4,6}"))).alias("codes"), five(F.array_distinct(all_of(r"\[?(?:별표|부표) [0-9]+\]?"))).alias("tables"))


@query(r"SELECT doc_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), '|') AS declared, array_to_string(list_filter(b, lambda x, i: list_position(b, x) = i AND NOT list_contains(a, x)), '|') AS referenced FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '\[((?:별표|부표) [0-9]+)\]', 1), lambda x: replace(x, ' ', '')) AS a, list_transform(regexp_extract_all(text, '((?:별표|부표) [0-9]+)', 1), lambda x: replace(x, ' ', '')) AS b FROM documents WHERE text IS NOT NULL)")
def reference_key_parse(s, d):
    """Keys of tables that a document declares (in brackets), and those it only refers to."""
    keys = lambda p: F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(p), F.lit(1)), lambda x: F.replace(x, F.lit(" "), F.lit(""))))
    x = table(s, d, "documents").where("text is not null").select("doc_id", keys(r"\[((?:별표|부표) [0-9]+)\]").alias("a"), keys(r"((?:별표|부표) [0-9]+)").alias("b"))
    return x.select("doc_id", F.array_join("a", "|").alias("declared"), F.array_join(F.array_except("b", "a"), "|").alias("referenced"))


@query(r"""SELECT element_id, left(t, 60) AS title, contains(text, t) AS repeated, regexp_matches(t, '[A-Z]{2,4}-?[0-9]{4,6}') AS identifier, CASE WHEN contains(text, t) OR regexp_matches(t, '[A-Z]{2,4}-?[0-9]{4,6}') THEN NULL ELSE left(t, 60) END AS kept FROM (SELECT element_id, text, trim(regexp_replace(title, '\s+', ' ', 'g')) AS t FROM elements WHERE text IS NOT NULL AND title IS NOT NULL) WHERE t <> ''""")
def str_sanitize_meta(s, d):
    """Generated metadata clipped to 60 characters; what the body says already or an identifier is dropped."""
    e = table(s, d, "elements").where("text is not null and title is not null").select("element_id", "text", F.trim(F.regexp_replace("title", r"\s+", " ")).alias("t")).where("t != ''")
    repeated, code = F.contains("text", "t"), F.col("t").rlike("[A-Z]{2,4}-?[0-9]{4,6}")
    short = F.substring("t", 1, 60)
    return e.select("element_id", short.alias("title"), repeated.alias("repeated"), code.alias("identifier"), F.when(~(repeated | code), short).alias("kept"))


@query("""WITH x AS (SELECT DISTINCT qid, g.c0 AS a, g.c1 AS b FROM (SELECT qid, unnest(gold_spans) AS g FROM train350_gold WHERE qid IS NOT NULL) WHERE g.c0 IS NOT NULL AND g.c1 > g.c0),
m AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY b - a DESC, a) AS n, lag(b) OVER (PARTITION BY qid ORDER BY a, b) AS before, lead(a) OVER (PARTITION BY qid ORDER BY a, b) AS after FROM x)
SELECT qid, a, b, CASE WHEN n = 1 THEN 'required' WHEN b - a < 20 THEN 'noise' WHEN least(coalesce(a - before, 1000000), coalesce(after - b, 1000000)) > 2000 THEN 'far' ELSE 'supporting' END AS grade FROM m""")
def str_region_grade(s, d):
    """The longest region of a question is required; others are noise (under 20), far (over 2,000 from the next) or supporting."""
    x = table(s, d, "train350_gold").where("qid is not null").select("qid", F.explode("gold_spans").alias("g")).select("qid", F.col("g.c0").alias("a"), F.col("g.c1").alias("b")).where("a is not null and b > a").distinct()
    w = Window.partitionBy("qid")
    near = w.orderBy("a", "b")
    n = F.row_number().over(w.orderBy((F.col("b") - F.col("a")).desc(), "a"))
    gap = F.least(F.coalesce(F.col("a") - F.lag("b").over(near), F.lit(1000000)), F.coalesce(F.lead("a").over(near) - F.col("b"), F.lit(1000000)))
    x = x.withColumn("n", n).withColumn("gap", gap)
    return x.select("qid", "a", "b", F.when(F.col("n") == 1, "required").when(F.col("b") - F.col("a") < 20, "noise").when(F.col("gap") > 2000, "far").otherwise("supporting").alias("grade"))


@query(r"""WITH g AS (SELECT DISTINCT t.qid, t.question, c.chunk_id, c.text FROM (SELECT qid, question, unnest(gold_chunk_ids) AS chunk_id FROM train350_gold WHERE qid IS NOT NULL AND question IS NOT NULL) t JOIN chunks c USING (chunk_id) WHERE c.text IS NOT NULL),
k AS (SELECT qid, chunk_id, question FROM g WHERE length(question) BETWEEN 8 AND 140 AND regexp_matches(question, '[가-힣]') AND NOT contains(text, question) AND list_has_any(""" + grams_sql(r"regexp_replace(lower(question), '\s+', '', 'g')") + ", " + grams_sql(r"regexp_replace(lower(text), '\s+', '', 'g')") + r""")
AND len(list_filter(regexp_extract_all(question, '[A-Z]{2,4}-?[0-9]{4,6}'), lambda v: NOT contains(text, v))) = 0)
SELECT chunk_id, qid, question FROM (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY qid, question) AS n FROM k) WHERE n <= 3""")
def str_filter_generated_queries(s, d):
    """Questions of a chunk that are neither verbatim nor foreign to it and keep its codes; three a chunk."""
    t = table(s, d, "train350_gold").where("qid is not null and question is not null").select("qid", "question", F.explode("gold_chunk_ids").alias("chunk_id"))
    g = t.join(table(s, d, "chunks").where("text is not null").select("chunk_id", "text"), "chunk_id").distinct()
    codes = F.filter(F.regexp_extract_all("question", F.lit("([A-Z]{2,4}-?[0-9]{4,6})"), F.lit(1)), lambda v: ~F.contains(F.col("text"), v))
    ok = F.char_length("question").between(8, 140) & F.col("question").rlike("[가-힣]") & ~F.contains("text", "question") & F.arrays_overlap(T.bigrams(F.col("question")), T.bigrams(F.col("text"))) & (F.size(codes) == 0)
    w = Window.partitionBy("chunk_id").orderBy("qid", "question")
    return g.where(ok).withColumn("n", F.row_number().over(w)).where("n <= 3").select("chunk_id", "qid", "question")
