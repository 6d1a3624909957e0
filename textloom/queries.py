"""The queries of the engine's own operators, each over whole tables, with the SQL it is checked against.

``QUERIES`` maps a name to a function of (spark, folder); ``SQL`` maps it to the same in SQL where there is one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import fusion, lexical, metrics, spans, stats, vectors
from textloom.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return add


# ---- frames and SQL that several queries share

WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"


def words_sql(c: str) -> str:
    return WORDS.format(c)


def grams_sql(c: str, n: int = 2) -> str:
    return f"CASE WHEN length({c}) >= {n} THEN list_transform(range(1, length({c}) - {n - 2}), lambda i: substr({c}, i, {n})) ELSE [] END"


DENSE = r"regexp_replace(lower({}), '\s+', '', 'g')"
COMPACT = "regexp_replace(lower({}), '[^가-힣a-z0-9]', '', 'g')"


def corpus(s: SparkSession, d: str, tokens=T.words) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", tokens(F.col("text")).alias("tokens"))


def questions(s: SparkSession, d: str, tokens=T.words) -> DataFrame:
    return table(s, d, "eval_items").where("question is not null").select(F.col("item_id").alias("query_id"), tokens(F.col("question")).alias("tokens"))


DOCS = f"d AS (SELECT doc_id, {words_sql('text')} AS tokens FROM documents WHERE text IS NOT NULL)"
QUESTIONS = f"q AS (SELECT item_id AS query_id, {words_sql('question')} AS tokens FROM eval_items WHERE question IS NOT NULL)"
DOCS2 = f"d AS (SELECT doc_id, {grams_sql('x')} AS tokens FROM (SELECT doc_id, {DENSE.format('text')} AS x FROM documents WHERE text IS NOT NULL))"
QUESTIONS2 = f"q AS (SELECT query_id, {grams_sql('x')} AS tokens FROM (SELECT item_id AS query_id, {DENSE.format('question')} AS x FROM eval_items WHERE question IS NOT NULL))"


def ranked_sql(scores: str, top: int | None, extra: str = "") -> str:
    keep = f" WHERE rank <= {top}" if top else ""
    return f"SELECT * FROM (SELECT query_id, doc_id, score{extra}, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({scores})){keep}"


def bm25_parts(docs: str, qs: str, k1: float, b: float, boost: bool, cap: int | None) -> str:
    """CTEs up to ``s(query_id, doc_id, score)``."""
    qtf = f"least(count(*), {cap})" if cap else "count(*)"
    num = f"p.tf * {k1 + 1 if boost else 1.0}"
    return f"""{docs}, {qs},
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM d) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM d), dl AS (SELECT doc_id, len(tokens) AS dl FROM d),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
qt AS (SELECT query_id, term, {qtf} AS qtf FROM (SELECT query_id, unnest(tokens) AS term FROM q) GROUP BY query_id, term),
s AS (SELECT query_id, p.doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * {num} / (p.tf + {k1} * (1 - {b} + {b} * dl / avgdl))), 6) AS score
  FROM qt JOIN p USING (term) JOIN f USING (term) JOIN dl ON dl.doc_id = p.doc_id CROSS JOIN st GROUP BY query_id, p.doc_id)"""


def bm25_sql(docs: str, qs: str, k1: float, b: float, boost: bool, cap: int | None, top: int | None) -> str:
    return "WITH " + bm25_parts(docs, qs, k1, b, boost, cap) + " " + ranked_sql("SELECT * FROM s", top)


RUNS = """runs AS (SELECT DISTINCT run_id, qid, rep, split, source, query_text, gold_chunk_ids, submitted, error, elapsed, r5, rr10 FROM results WHERE qid IS NOT NULL),
k AS (SELECT *, concat_ws('|', split, source, qid, CAST(rep AS VARCHAR), run_id) AS query_id FROM runs),
rk AS (SELECT query_id, doc_id, min(rank) AS rank FROM (SELECT query_id, unnest(submitted) AS doc_id, generate_subscripts(submitted, 1) AS rank FROM k) WHERE doc_id IS NOT NULL GROUP BY ALL),
gd AS (SELECT DISTINCT query_id, doc_id FROM (SELECT query_id, unnest(gold_chunk_ids) AS doc_id FROM k) WHERE doc_id IS NOT NULL)"""


def runs(s: SparkSession, d: str) -> DataFrame:
    """One row a run, rep and question, with ``query_id``."""
    cols = ["run_id", "qid", "rep", "split", "source", "query_text", "gold_chunk_ids", "submitted", "error", "elapsed", "r5", "rr10"]
    r = table(s, d, "results").where("qid is not null").select(*cols).distinct()
    return r.withColumn("query_id", F.concat_ws("|", "split", "source", "qid", F.col("rep").cast("string"), "run_id"))


def submitted(r: DataFrame) -> DataFrame:
    x = r.select("query_id", F.posexplode("submitted").alias("pos", "doc_id")).where("doc_id is not null")
    return x.groupBy("query_id", "doc_id").agg((F.min("pos") + 1).alias("rank"))


def judged(r: DataFrame) -> DataFrame:
    return r.select("query_id", F.explode("gold_chunk_ids").alias("doc_id")).where("doc_id is not null").distinct()


# ---- scans and projections


@query("SELECT doc_id, text FROM (SELECT doc_id, coalesce(nullif(title, ''), text) AS text FROM documents) WHERE text IS NOT NULL")
def scan_beir_triplet(s, d):
    return table(s, d, "documents").select("doc_id", F.coalesce(F.nullif("title", F.lit("")), "text").alias("text")).where("text is not null")


@query("SELECT doc_id, left(concat_ws(' ', 'passage:', title, text), 4096) AS embed_text FROM documents")
def project_embed_text(s, d):
    return table(s, d, "documents").select("doc_id", F.substring(F.concat_ws(" ", F.lit("passage:"), "title", "text"), 1, 4096).alias("embed_text"))


@query("WITH " + RUNS + " SELECT query_id, count(*) AS n FROM gd GROUP BY query_id")
def filter_positive_qrels(s, d):
    return judged(runs(s, d)).groupBy("query_id").agg(F.count("*").alias("n"))


@query("SELECT element_id, element_type, contract_scope FROM elements WHERE element_type = 'text' AND contract_scope <> '' AND title IS NOT NULL")
def filter_taxonomy_exact(s, d):
    return table(s, d, "elements").where("element_type = 'text' and contract_scope <> '' and title is not null").select("element_id", "element_type", "contract_scope")


@query("SELECT element_id, schema_tag FROM element_semantic_fields_v4 WHERE schema_tag = 'table' AND list_has_any(list_transform(coalesce(role, []), lambda x: lower(trim(x))), ['payment_amount', 'limit_frequency'])")
def filter_metadata_and(s, d):
    f = table(s, d, "element_semantic_fields_v4")
    any_of = F.exists("role", lambda x: F.lower(F.trim(x)).isin("payment_amount", "limit_frequency"))
    return f.where((F.col("schema_tag") == "table") & F.coalesce(any_of, F.lit(False))).select("element_id", "schema_tag")


_SLOTS = """SELECT term, count(*) AS n FROM (SELECT DISTINCT element_id, lower(trim(t)) AS term FROM
(SELECT element_id, unnest(qualifier) AS t FROM element_semantic_fields_v4 WHERE list_contains(list_transform(coalesce(role, []), lambda x: lower(trim(x))), 'payment_amount')) WHERE t IS NOT NULL) WHERE term <> '' GROUP BY term"""


@query(f"SELECT term, n FROM ({_SLOTS}) ORDER BY n DESC, term LIMIT 8")
def facet_counts(s, d):
    f = table(s, d, "element_semantic_fields_v4").where(F.coalesce(F.exists("role", lambda x: F.lower(F.trim(x)) == "payment_amount"), F.lit(False)))
    t = f.select("element_id", F.explode("qualifier").alias("t")).select("element_id", F.lower(F.trim("t")).alias("term")).where("term <> ''").distinct()
    return t.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "term").limit(8)


@query(_SLOTS)
def filter_slot_and(s, d):
    f = table(s, d, "element_semantic_fields_v4").where(F.coalesce(F.exists("role", lambda x: F.lower(F.trim(x)) == "payment_amount"), F.lit(False)))
    t = f.select("element_id", F.explode("qualifier").alias("t")).select("element_id", F.lower(F.trim("t")).alias("term")).where("term <> ''").distinct()
    return t.groupBy("term").agg(F.count("*").alias("n"))


@query(r"SELECT element_id, length(text) AS chars, (length(text) > 2000 OR len(regexp_extract_all(text, '제[0-9]+조')) >= 3) AS suspect FROM elements WHERE text IS NOT NULL")
def predicate_suspect_element(s, d):
    e = table(s, d, "elements").where("text is not null")
    suspect = (F.char_length("text") > 2000) | (F.size(F.regexp_extract_all("text", F.lit("(제[0-9]+조)"), F.lit(1))) >= 3)
    return e.select("element_id", F.char_length("text").alias("chars"), suspect.alias("suspect"))


@query(r"SELECT element_id, length(regexp_replace(text, '[\s|0-9.]+', '', 'g')) < 40 AS navigation FROM elements WHERE text IS NOT NULL")
def predicate_is_navigation(s, d):
    return table(s, d, "elements").where("text is not null").select("element_id", (F.char_length(F.regexp_replace("text", r"[\s|0-9.]+", "")) < 40).alias("navigation"))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)&nbsp;|<br>|^\s*=====\s*$|\[표 생략\]') AS noisy FROM documents WHERE text IS NOT NULL")
def predicate_noise_block(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.col("text").rlike(r"(?i)&nbsp;|<br>|^\s*=====\s*$|\[표 생략\]").alias("noisy"))


@query(r"SELECT doc_id, filename FROM doc_facts WHERE regexp_matches(filename, '(^|[^0-9])(19|20)(19|20)[0-9]{4}([^0-9]|$)')")
def predicate_ambiguous_date(s, d):
    return table(s, d, "doc_facts").where(F.col("filename").rlike("(^|[^0-9])(19|20)(19|20)[0-9]{4}([^0-9]|$)")).select("doc_id", "filename")


@query(r"SELECT qid, question FROM train350_gold WHERE regexp_matches(question, '며칠|얼마|어디')")
def predicate_gates_surface(s, d):
    return table(s, d, "train350_gold").where(F.col("question").rlike("며칠|얼마|어디")).select("qid", "question")


@query(f"""SELECT a.element_id, a.contract_scope, b.doc_type AS doc_type FROM elements a JOIN doc_facts b ON a.document_key = b.doc_id
WHERE length({COMPACT.format('a.contract_scope')}) >= 5 AND contains({COMPACT.format('a.text')}, {COMPACT.format('a.contract_scope')})""")
def predicate_fuzzy_contains(s, d):
    e = table(s, d, "elements").select("element_id", "contract_scope", "document_key", T.contract_core(F.col("text")).alias("t"), T.contract_core(F.col("contract_scope")).alias("c"))
    anchored = (F.least(F.char_length("c"), F.char_length("t")) >= 5) & F.contains(F.col("t"), F.substring("c", 1, 3)) & F.contains(F.col("t"), F.substring("c", -4, 4))
    grams = T.trigrams(F.col("c"))
    shared = F.size(F.filter(grams, lambda g: F.contains(F.col("t"), g))) / F.size(grams) >= 0.72
    e = e.where("c <> '' and t <> ''").where(F.contains("t", "c") | F.contains("c", "t") | (anchored & shared))
    return e.join(table(s, d, "doc_facts").select(F.col("doc_id").alias("document_key"), "doc_type"), "document_key").select("element_id", "contract_scope", "doc_type")


# ---- tokens and text scalars

_EL = "FROM elements WHERE text IS NOT NULL"


def _text_query(name: str, column, sql: str, source: str = "elements", key: str = "element_id", text: str = "text") -> None:
    def f(s, d):
        return table(s, d, source).where(F.col(text).isNotNull()).select(key, column(F.col(text)).alias("value"))

    QUERIES[name] = f
    SQL[name] = f"SELECT {key}, {sql} AS value FROM {source} WHERE {text} IS NOT NULL"


_text_query("tokenize_word", lambda c: F.array_join(T.words(c), " "), f"array_to_string({words_sql('text')}, ' ')")
_text_query("tokenize_char_bigram", lambda c: F.array_join(T.bigrams(c), "|"), f"array_to_string({grams_sql(DENSE.format('text'))}, '|')")
_text_query("tokenize_char_bigram_compact", lambda c: F.array_join(T.compact_bigrams(c), "|"), f"array_to_string(CASE WHEN length({COMPACT.format('text')}) = 1 THEN [{COMPACT.format('text')}] ELSE {grams_sql(COMPACT.format('text'))} END, '|')")
_text_query("str_compact", T.compact, COMPACT.format("text"))
_text_query("str_norm_lower_ws", T.lower_one_blank, r"lower(trim(regexp_replace(text, '\s+', ' ', 'g')))")
_text_query("str_trigrams", lambda c: F.size(T.trigrams(c)), f"len(list_distinct({grams_sql(COMPACT.format('text'), 3)}))")
_text_query("str_hangul_ratio", lambda c: F.round(T.hangul_share(c), 6), r"round(CASE WHEN length(regexp_replace(text, '\s+', '', 'g')) = 0 THEN 1.0 ELSE length(regexp_replace(text, '[^가-힣]', '', 'g')) / length(regexp_replace(text, '\s+', '', 'g')) END, 6)")
_text_query("hash_stable_ids", lambda c: T.stable_id("e-", c), "'e-' || left(sha256(text), 16)")
_text_query("str_doc_type", lambda c: T.only_one_of(c, ("약관", "사업방법서", "상품요약서")), "CASE WHEN contains(filename, '약관')::INT + contains(filename, '사업방법서')::INT + contains(filename, '상품요약서')::INT = 1 THEN CASE WHEN contains(filename, '약관') THEN '약관' WHEN contains(filename, '사업방법서') THEN '사업방법서' ELSE '상품요약서' END END", "doc_facts", "doc_id", "filename")
_text_query("str_title_clean", T.clean_title, r"trim(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(filename, '(?i)\.md$', ''), '\([^)]*\)', ' ', 'g'), '(?i)ver\.? ?[0-9]+', ' ', 'g'), '[0-9]{6,8}', ' ', 'g'), '_', ' '), '\s+', ' ', 'g'))", "doc_facts", "doc_id", "filename")
_text_query("str_question_key", T.question_key, f"array_to_string(list_sort(list_distinct(list_filter({words_sql('question')}, lambda w: length(w) >= 2))), ' ')", "eval_items", "item_id", "question")
_text_query("date_parse_strict", T.strict_date, r"""(SELECT CASE WHEN count(DISTINCT x) = 1 AND min(substr(x, 1, 4))::INT BETWEEN 1990 AND 2027 AND min(substr(x, 5, 2))::INT BETWEEN 1 AND 12 AND min(substr(x, 7, 2))::INT BETWEEN 1 AND 31 THEN min(x) END
 FROM (SELECT CASE WHEN length(t) = 8 THEN t WHEN substr(t, 1, 2)::INT <= 27 THEN '20' || t ELSE '19' || t END AS x FROM (SELECT unnest(list_filter(regexp_extract_all(filename, '[0-9]+'), lambda t: length(t) IN (6, 8))) AS t)))""", "doc_facts", "doc_id", "filename")


@query("SELECT doc_id, sha256(text) AS h FROM documents WHERE text IS NOT NULL")
def hash_file(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("h"))


@query("SELECT element_id, array_to_string(list_filter(['[' || contract_scope || ']', title, left(text, 200)], lambda x: x IS NOT NULL AND x <> ''), ' / ') AS view FROM elements")
def view_render(s, d):
    parts = F.array(F.concat(F.lit("["), "contract_scope", F.lit("]")), F.col("title"), F.substring("text", 1, 200))
    return table(s, d, "elements").select("element_id", F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " / ").alias("view"))


@query("""SELECT element_id, array_to_string(list_slice(list_filter(['payment_amount', 'payment_trigger', 'limit_frequency', 'timing_period', 'definition'],
lambda v: list_contains(list_transform(coalesce(role, []), lambda x: lower(trim(x))), v)), 1, 3), ',') AS roles FROM element_semantic_fields_v4""")
def role_vocab_extract(s, d):
    vocab = F.array(*[F.lit(v) for v in ("payment_amount", "payment_trigger", "limit_frequency", "timing_period", "definition")])
    own = F.transform(F.coalesce("role", F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))
    return table(s, d, "element_semantic_fields_v4").select("element_id", F.array_join(F.slice(F.filter(vocab, lambda v: F.coalesce(F.array_contains(own, v), F.lit(False))), 1, 3), ",").alias("roles"))


@query(r"""SELECT element_id, array_to_string(list_distinct_in_order, '|') AS keys FROM (SELECT element_id, list_filter(x, lambda v, i: list_position(x, v) = i) AS list_distinct_in_order
FROM (SELECT element_id, regexp_extract_all(text, '제[0-9]+조(?:의[0-9]+)?|별표 ?[0-9]+') AS x FROM elements WHERE text IS NOT NULL))""")
def str_article_keys(s, d):
    return table(s, d, "elements").where("text is not null").select("element_id", F.array_join(F.array_distinct(F.regexp_extract_all("text", F.lit("(제[0-9]+조(?:의[0-9]+)?|별표 ?[0-9]+)"), F.lit(1))), "|").alias("keys"))


@query("""SELECT element_id, array_to_string(list_slice(list_filter(y, lambda v, i: list_position(y, v) = i), 1, 5), '|') AS subjects FROM (SELECT element_id, list_filter(list_transform(coalesce(subject_key, []), lambda x: trim(x)), lambda x: length(x) BETWEEN 2 AND 20) AS y FROM element_semantic_fields_v4)""")
def str_clean_subjects(s, d):
    own = F.filter(F.transform(F.coalesce("subject_key", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.char_length(x).between(2, 20))
    return table(s, d, "element_semantic_fields_v4").select("element_id", F.array_join(F.slice(F.array_distinct(own), 1, 5), "|").alias("subjects"))


@query("""SELECT doc_id, array_to_string(list_sort(list_concat(list_filter(a, lambda x: NOT list_contains(b, x)), list_filter(b, lambda x: NOT list_contains(a, x)))), ' ') AS tokens FROM
(SELECT doc_id, list_distinct(string_split(clean_name, ' ')) AS a, list_distinct(string_split(product_dir, ' ')) AS b FROM doc_facts WHERE clean_name IS NOT NULL AND product_dir IS NOT NULL)""")
def set_symmetric_tokens(s, d):
    f = table(s, d, "doc_facts").where("clean_name is not null and product_dir is not null").select("doc_id", F.split("clean_name", " ").alias("a"), F.split("product_dir", " ").alias("b"))
    return f.select("doc_id", F.array_join(F.array_sort(F.array_union(F.array_except("a", "b"), F.array_except("b", "a"))), " ").alias("tokens"))


# ---- lexical retrieval


@query("WITH " + DOCS + ", p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM d) GROUP BY ALL) SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM p GROUP BY term")
def inverted_index_build(s, d):
    return lexical.postings(corpus(s, d)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(bm25_sql(DOCS, QUESTIONS, 1.5, 0.75, True, None, 10))
def bm25_okapi_word(s, d):
    return lexical.bm25(corpus(s, d), questions(s, d))


@query(bm25_sql(DOCS, QUESTIONS, 1.5, 0.75, True, 2, 10))
def bm25_sparse_qtf_capped(s, d):
    return lexical.bm25(corpus(s, d), questions(s, d), cap=2)


@query(bm25_sql(DOCS, QUESTIONS, 1.5, 0.75, True, 1, 10))
def bm25_token_list(s, d):
    return lexical.bm25(corpus(s, d), questions(s, d), cap=1)


@query(bm25_sql(DOCS, QUESTIONS, 1.5, 0.75, True, None, 50))
def bm25_robertson_library(s, d):
    return lexical.bm25(corpus(s, d), questions(s, d), top=50)


@query(bm25_sql(DOCS2, QUESTIONS2, 1.2, 0.75, True, 1, 10))
def bm25_bigram_top10(s, d):
    return lexical.bm25(corpus(s, d, T.bigrams), questions(s, d, T.bigrams), 1.2, 0.75, cap=1)


@query("WITH " + bm25_parts(DOCS, QUESTIONS, 1.2, 0.75, True, 1) + " " + ranked_sql("SELECT query_id, doc_id, coalesce(score, 0.0) AS score FROM (SELECT query_id FROM q) CROSS JOIN (SELECT doc_id FROM d) LEFT JOIN s USING (query_id, doc_id)", 10))
def bm25_bigram_candidates(s, d):
    return lexical.bm25_all_candidates(corpus(s, d, T.bigrams), questions(s, d, T.bigrams))


FIELDS = f"""fl AS (SELECT doc_id, 'title' AS field, {words_sql('title')} AS tokens FROM documents WHERE title IS NOT NULL
 UNION ALL SELECT doc_id, 'text', {words_sql('text')} FROM documents WHERE text IS NOT NULL)"""


def doc_fields(s, d):
    t = table(s, d, "documents")
    part = lambda c: t.where(F.col(c).isNotNull()).select("doc_id", F.lit(c).alias("field"), T.words(F.col(c)).alias("tokens"))
    return part("title").unionByName(part("text"))


@query(f"""WITH {FIELDS}, {QUESTIONS}, qt AS (SELECT DISTINCT query_id, unnest(tokens) AS term FROM q),
av AS (SELECT field, avg(len(tokens)) AS avgdl FROM fl GROUP BY field),
h AS (SELECT doc_id, field, term, len(any_value(tokens)) AS dl, count(*) AS tf FROM (SELECT doc_id, field, tokens, unnest(tokens) AS term FROM fl) GROUP BY doc_id, field, term),
x AS (SELECT doc_id, term, sum((CASE field WHEN 'title' THEN 3.0 ELSE 1.0 END) * tf / (1 - (CASE field WHEN 'title' THEN 0.2 ELSE 0.75 END) + (CASE field WHEN 'title' THEN 0.2 ELSE 0.75 END) * dl / avgdl)) AS x FROM h JOIN av USING (field) GROUP BY doc_id, term),
f AS (SELECT term, count(*) AS df FROM x GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS n FROM fl),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * x / (1.2 + x)), 6) AS score FROM x JOIN qt USING (term) JOIN f USING (term) CROSS JOIN n GROUP BY query_id, doc_id)
""" + ranked_sql("SELECT * FROM s WHERE score > 0", 10))
def bm25f_fields(s, d):
    return lexical.bm25f(doc_fields(s, d), questions(s, d), {"title": 3.0, "text": 1.0}, {"title": 0.2, "text": 0.75})


@query(f"""WITH {FIELDS}, {QUESTIONS}, qt AS (SELECT DISTINCT query_id, unnest(tokens) AS term FROM q),
h AS (SELECT doc_id, term, max(CASE field WHEN 'title' THEN 3.0 ELSE 1.0 END) AS w FROM (SELECT doc_id, field, unnest(tokens) AS term FROM fl) GROUP BY doc_id, term),
f AS (SELECT term, count(*) AS df FROM h GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS n FROM fl),
s AS (SELECT query_id, doc_id, round(sum(w * ln(1 + n / df)), 6) AS score FROM h JOIN qt USING (term) JOIN f USING (term) CROSS JOIN n GROUP BY query_id, doc_id)
""" + ranked_sql("SELECT * FROM s", 10))
def idf_weight_max_field(s, d):
    return lexical.max_field_idf(doc_fields(s, d), questions(s, d), {"title": 3.0, "text": 1.0})


@query(f"""WITH {DOCS}, {QUESTIONS}, qt AS (SELECT DISTINCT query_id, unnest(tokens) AS term FROM q), nq AS (SELECT query_id, count(*) AS terms FROM qt GROUP BY query_id),
h AS (SELECT query_id, doc_id, count(*) AS m FROM (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM d) JOIN qt USING (term) GROUP BY ALL)
""" + ranked_sql("SELECT query_id, doc_id, round(m / terms, 6) AS score FROM h JOIN nq USING (query_id)", 10))
def clm_coordination_match(s, d):
    return lexical.coordination(corpus(s, d), questions(s, d))


_UNITS = f"d AS (SELECT {{{{'doc_id': doc_id, 'unit': unit}}}} AS doc_id, {words_sql('line')} AS tokens FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS unit FROM documents WHERE text IS NOT NULL))".replace("{{", "{").replace("}}", "}")


@query("WITH " + bm25_parts(_UNITS, QUESTIONS, 1.2, 0.7, True, 1) + " " + ranked_sql("SELECT query_id, doc_id.doc_id AS doc_id, max(score) AS score FROM s GROUP BY ALL", 10))
def evidence_unit_max(s, d):
    lines = table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("unit", "line"))
    return lexical.best_unit(lines.select("doc_id", "unit", T.words(F.col("line")).alias("tokens")), questions(s, d))


_GREP = r"SELECT doc_id, line_no, line FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS full_line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, left(full_line, 200) AS line FROM documents) WHERE regexp_matches(full_line, '(?i)청구|claim'))"


@query(_GREP.replace("unnest(string_split(text, chr(10))) AS full_line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, left(full_line, 200) AS line FROM documents", "line_no, full_line, left(full_line, 200) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS full_line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)") + " WHERE n <= 5")
def grep_lines(s, d):
    return lexical.grep_lines(table(s, d, "documents"), "청구|claim")


@query(r"""WITH h AS (SELECT DISTINCT contract_scope, element_id FROM elements WHERE contract_scope IS NOT NULL AND contains(text, '수술')),
g AS (SELECT contract_scope, element_id, row_number() OVER (PARTITION BY contract_scope ORDER BY element_id) AS n, count(*) OVER (PARTITION BY contract_scope) AS hits FROM h)
SELECT contract_scope, hits, array_to_string(list(element_id ORDER BY element_id), ',') AS samples FROM g WHERE n <= 3 GROUP BY contract_scope, hits ORDER BY hits DESC, contract_scope LIMIT 15""")
def grep_grouped_by_scope(s, d):
    from pyspark.sql import Window

    h = table(s, d, "elements").where("contract_scope is not null").where(F.contains("text", F.lit("수술"))).select("contract_scope", "element_id").distinct()
    w = Window.partitionBy("contract_scope").orderBy("element_id")
    three = h.withColumn("n", F.row_number().over(w)).where("n <= 3").groupBy("contract_scope").agg(F.array_join(F.array_sort(F.collect_list("element_id")), ",").alias("samples"))
    return h.groupBy("contract_scope").agg(F.count("*").alias("hits")).join(three, "contract_scope").orderBy(F.col("hits").desc(), "contract_scope").limit(15)


@query("""WITH h AS (SELECT DISTINCT document_key, line_start, element_id FROM elements WHERE contains(text, '지급') AND line_start IS NOT NULL),
g AS (SELECT *, row_number() OVER (PARTITION BY document_key ORDER BY line_start, element_id) - 1 AS pos, count(*) OVER (PARTITION BY document_key) AS n FROM h)
SELECT document_key, line_start, element_id FROM g WHERE n <= 5 OR list_contains(list_transform(range(0, 5), lambda i: (i * n) // 5), pos)""")
def grep_even_sample(s, d):
    h = table(s, d, "elements").where(F.contains("text", F.lit("지급"))).where("line_start is not null").select("document_key", "line_start", "element_id").distinct()
    return lexical.even_sample(h.withColumn("at", F.struct("line_start", "element_id")), "document_key", "at", 5).drop("at")


@query(r"""SELECT doc_id, substr(flat, greatest(strpos(flat, '특약') - 40, 1), 120) AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS flat FROM documents WHERE contains(text, '특약'))""")
def snippet_window(s, d):
    return table(s, d, "documents").where(F.contains("text", F.lit("특약"))).select("doc_id", lexical.snippet(F.col("text"), F.lit("특약")).alias("snippet"))


@query("""SELECT item_id AS query_id, question AS text, CASE WHEN contains(question, '청구') AND NOT contains(question, '신청') THEN question || ' 신청' WHEN contains(question, '신청') AND NOT contains(question, '청구') THEN question || ' 청구' ELSE question END AS expanded FROM eval_items WHERE question IS NOT NULL""")
def alias_expand_query(s, d):
    q = table(s, d, "eval_items").where("question is not null").select(F.col("item_id").alias("query_id"), F.col("question").alias("text"))
    return lexical.expand_aliases(q, (("청구", "신청"),))


# ---- vectors: every vector whose id is divisible by 100 is a query, against all

_DOT = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"
UNIT = f"""n AS (SELECT vec_id, embedding, sqrt({_DOT.format('embedding', 'embedding')}) AS n FROM embeddings),
u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / n) AS v FROM n WHERE n > 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round({_DOT.format('a.v', 'b.v')}, 6) AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)"""


def _nearest(s, d, top):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    return vectors.nearest(e, e.where("vec_id % 100 = 0"), top)


def _similarities(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    return vectors.similarities(e, e.where("vec_id % 100 = 0"))


@query(f"WITH {UNIT} " + ranked_sql("SELECT * FROM s", 10))
def dense_dot_topk(s, d):
    return _nearest(s, d, 10)


@query(f"WITH {UNIT} " + ranked_sql("SELECT * FROM s", None))
def dense_rank_all(s, d):
    return _nearest(s, d, None)


@query(f"WITH {UNIT}, r AS (" + ranked_sql("SELECT * FROM s", 40) + "), x AS (SELECT r.* FROM r LEFT JOIN (SELECT query_id, doc_id FROM r WHERE rank <= 3) t USING (query_id, doc_id) WHERE t.doc_id IS NULL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM x) WHERE place <= 10")
def dense_pull_backfill(s, d):
    r = _nearest(s, d, 40)
    return vectors.backfill(r, r.where("rank <= 3").select("query_id", "doc_id"), 10)


@query(f"WITH {UNIT} SELECT query_id, count(*) AS n, round(avg(score), 6) AS mean, min(score) AS low, max(score) AS high FROM s GROUP BY query_id")
def dense_cosine(s, d):
    return _similarities(s, d).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"), F.min("score").alias("low"), F.max("score").alias("high"))


@query(f"WITH {UNIT}, r AS (" + ranked_sql("SELECT * FROM s", 10) + ") SELECT a.label AS label, count(*) AS n, round(avg(CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END), 6) AS same FROM r JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = doc_id GROUP BY a.label")
def vector_similarity_search_arms(s, d):
    e = table(s, d, "embeddings")
    r = _nearest(s, d, 10)
    a, b = e.select(F.col("vec_id").alias("query_id"), "label"), e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("other"))
    return r.join(a, "query_id").join(b, "doc_id").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("label") == F.col("other")).cast("double")), 6).alias("same"))


@query(f"SELECT count(*) AS n, min(len(embedding)) AS min_width, max(len(embedding)) AS max_width, count(*) FILTER (len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) > 0) AS with_nan, count(*) FILTER (n = 0) AS zero, round(min(n), 6) AS norm_min, round(max(n), 6) AS norm_max, round(avg(n), 6) AS norm_mean FROM (SELECT embedding, sqrt({_DOT.format('embedding', 'embedding')}) AS n FROM embeddings)")
def embedding_audit(s, d):
    return vectors.audit(table(s, d, "embeddings"))


@query(f"WITH {UNIT} " + ranked_sql("SELECT query_id, doc_id, round(score + CASE WHEN a.label = b.label THEN 0.15 ELSE 0 END, 6) AS score FROM s JOIN embeddings a ON a.vec_id = query_id JOIN embeddings b ON b.vec_id = doc_id", 10))
def boost_taxonomy_additive(s, d):
    e = table(s, d, "embeddings")
    r = _similarities(s, d)
    r = r.join(e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("a")), "query_id").join(e.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("b")), "doc_id")
    return lexical.ranked(r.select("query_id", "doc_id", F.round(F.col("score") + F.when(F.col("a") == F.col("b"), 0.15).otherwise(0.0), 6).alias("score")), 10)


# ---- fusion: a word ranking and a title ranking of the same questions

TITLES = f"d AS (SELECT doc_id, {words_sql('title')} AS tokens FROM documents WHERE title IS NOT NULL)"


def two_rankings(s, d, top: int | None = 20):
    t = table(s, d, "documents").where("title is not null").select("doc_id", T.words(F.col("title")).alias("tokens"))
    return {"words": lexical.bm25(corpus(s, d), questions(s, d), top=top), "titles": lexical.bm25(t, questions(s, d), top=top)}


def _two(top: int = 20) -> str:
    return f"""r1 AS ({bm25_sql(DOCS, QUESTIONS, 1.5, 0.75, True, None, top)}), r2 AS ({bm25_sql(TITLES, QUESTIONS, 1.5, 0.75, True, None, top)}),
al AS (SELECT *, 0 AS list_no, 'words' AS channel FROM r1 UNION ALL SELECT *, 1, 'titles' FROM r2)"""


def _rrf(weight: str, tie: str, top: int) -> str:
    return f"WITH {_two()}, f AS (SELECT query_id, doc_id, round(sum({weight} / (60 + rank)), 8) AS score, min({{'l': list_no, 'r': rank}}) AS seen, count(*) AS lists FROM al GROUP BY ALL) SELECT query_id, doc_id, score, lists, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {tie} doc_id) AS rank FROM f) WHERE rank <= {top}"


@query(_rrf("1.0", "", 10))
def rrf(s, d):
    return fusion.rrf(two_rankings(s, d), top=10)


@query(_rrf("(CASE channel WHEN 'words' THEN 1.0 ELSE 0.5 END)", "", 10))
def rrf_weighted_channels(s, d):
    return fusion.rrf(two_rankings(s, d), weights={"titles": 0.5}, top=10)


@query(_rrf("1.0", "seen,", 10))
def rrf_first_seen_tie(s, d):
    return fusion.rrf(two_rankings(s, d), top=10, first_seen=True)


@query(_rrf("1.0", "seen,", 50))
def rrf_hybrid_chunks(s, d):
    return fusion.rrf(two_rankings(s, d), top=50, first_seen=True)


_ONE = "(CASE WHEN {0} = 0 THEN 1.0 ELSE {0} END)"


def _fused(value: str) -> str:
    return f"WITH {_two()}, v AS (SELECT *, {value} AS value FROM al WINDOW w AS (PARTITION BY channel, query_id)), f AS (SELECT query_id, doc_id, round(sum(value * CASE channel WHEN 'words' THEN 0.7 ELSE 0.3 END), 6) AS score FROM v GROUP BY ALL) " + ranked_sql("SELECT * FROM f", 10)


@query(_fused(f"(score - min(score) OVER w) / {_ONE.format('(max(score) OVER w - min(score) OVER w)')}"))
def score_fusion_normalized(s, d):
    return fusion.score_fusion(two_rankings(s, d), {"words": 0.7, "titles": 0.3}, "minmax")


@query(" UNION ALL ".join(f"SELECT {w1}.0 AS w_words, {w2}.0 AS w_titles, count(*) AS n, round(avg(score), 4) AS mean FROM (WITH {_two()}, v AS (SELECT *, score / {_ONE.format('max(score) OVER (PARTITION BY channel, query_id)')} AS value FROM al), f AS (SELECT query_id, doc_id, round(sum(value * CASE channel WHEN 'words' THEN {w1}.0 ELSE {w2}.0 END), 6) AS score FROM v GROUP BY ALL) {ranked_sql('SELECT * FROM f', 1)})" for w1, w2 in ((0, 1), (1, 0), (1, 1), (1, 2), (2, 1))))
def score_grid_sweep(s, d):
    r = two_rankings(s, d)
    out = None
    for a, b in ((0.0, 1.0), (1.0, 0.0), (1.0, 1.0), (1.0, 2.0), (2.0, 1.0)):
        x = fusion.score_fusion(r, {"words": a, "titles": b}, "max", 1).agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean")).select(F.lit(a).alias("w_words"), F.lit(b).alias("w_titles"), "n", "mean")
        out = x if out is None else out.unionByName(x)
    return out


@query(f"WITH {_two()} SELECT query_id, doc_id, variants, row_number() OVER (PARTITION BY query_id ORDER BY best) AS rank FROM (SELECT query_id, source AS unit, min(rank) AS best, arg_min(r1.doc_id, rank) AS doc_id, count(*) AS variants FROM r1 JOIN documents USING (doc_id) GROUP BY query_id, source)".replace("SELECT query_id, doc_id, variants,", "SELECT query_id, unit, doc_id, variants,"))
def collapse_by_unit(s, d):
    r = two_rankings(s, d)["words"].join(table(s, d, "documents").select("doc_id", "source"), "doc_id")
    return fusion.collapse(r, F.col("source"))


@query(f"WITH {_two()} SELECT query_id, doc_id, old_rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN old_rank <= 5 THEN 0 ELSE 1 END, CASE WHEN old_rank <= 5 THEN again END DESC NULLS LAST, old_rank) AS rank FROM (SELECT a.query_id, a.doc_id, a.rank AS old_rank, b.score AS again FROM r1 a LEFT JOIN r2 b USING (query_id, doc_id))")
def cascade_rerank(s, d):
    r = two_rankings(s, d)
    return fusion.rerank_head(r["words"], r["titles"], 5)


@query(f"WITH {_two()}, x AS (SELECT r1.*, coalesce(contains(text, '청구'), false) AS passed FROM r1 JOIN documents USING (doc_id)) SELECT query_id, doc_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN rank <= 5 THEN 0 ELSE 1 END, CASE WHEN rank <= 5 AND passed THEN 0 ELSE 1 END, rank) AS new_rank FROM x")
def verify_partition(s, d):
    r = two_rankings(s, d)["words"].join(table(s, d, "documents").select("doc_id", F.coalesce(F.contains("text", F.lit("청구")), F.lit(False)).alias("passed")), "doc_id")
    return fusion.verified_first(r, F.col("passed"), 5).select("query_id", "doc_id", "rank", "new_rank")


@query(f"WITH {_two()} SELECT query_id, doc_id, rank FROM r1 WHERE rank BETWEEN 6 AND 10")
def topk_paging(s, d):
    return fusion.page(two_rankings(s, d)["words"], 2, 5).select("query_id", "doc_id", "rank")


@query(f"WITH {_two()}, x AS (SELECT query_id, doc_id, CASE WHEN rank <= 3 THEN 0 ELSE 2 END AS phase, rank, -1 AS l FROM r1 UNION ALL SELECT query_id, doc_id, 1, rank, 0 FROM r2), b AS (SELECT query_id, doc_id, min({{'p': phase, 'r': rank, 'l': l}}) AS seen FROM x GROUP BY ALL) SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY seen, doc_id) AS rank FROM b) WHERE rank <= 10")
def portfolio_round_robin(s, d):
    r = two_rankings(s, d)
    return fusion.round_robin({"titles": r["titles"]}, r["words"], 3, 10)


@query(f"WITH {_two()}, x AS (SELECT query_id, doc_id, 0 AS phase, rank FROM r1 WHERE rank <= 5 UNION ALL SELECT query_id, doc_id, 1, rank FROM r2 WHERE rank <= 3 UNION ALL SELECT query_id, doc_id, 2, rank FROM r1 WHERE rank > 5), b AS (SELECT query_id, doc_id, min({{'p': phase, 'r': rank}}) AS seen FROM x GROUP BY ALL) SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY seen, doc_id) AS rank FROM b) WHERE rank <= 10")
def append_only_recompose(s, d):
    r = two_rankings(s, d)
    rows = r["words"].select("query_id", "doc_id", F.when(F.col("rank") <= 5, 0).otherwise(2).alias("phase"), "rank").unionByName(r["titles"].where("rank <= 3").select("query_id", "doc_id", F.lit(1).alias("phase"), "rank"))
    return _by_phase(rows, 10)


def _by_phase(rows: DataFrame, top: int) -> DataFrame:
    from pyspark.sql import Window

    b = rows.groupBy("query_id", "doc_id").agg(F.min(F.struct("phase", "rank")).alias("at"))
    return b.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "doc_id")).alias("rank")).where(F.col("rank") <= top)


@query(f"WITH {_two()}, x AS (SELECT query_id, doc_id, 0 AS phase, rank FROM r1 UNION ALL SELECT query_id, doc_id, 1, rank FROM r2), b AS (SELECT query_id, doc_id, min({{'p': phase, 'r': rank}}) AS seen FROM x GROUP BY ALL) SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY seen, doc_id) AS rank FROM b) WHERE rank <= 30")
def set_union_dedup(s, d):
    r = two_rankings(s, d)
    return _by_phase(r["words"].select("query_id", "doc_id", F.lit(0).alias("phase"), "rank").unionByName(r["titles"].select("query_id", "doc_id", F.lit(1).alias("phase"), "rank")), 30)


QUERIES["submit_pad_merge"] = lambda s, d: set_union_dedup(s, d).where("rank <= 10")
SQL["submit_pad_merge"] = f"SELECT * FROM ({SQL['set_union_dedup']}) WHERE rank <= 10"


@query(f"WITH {_two()}, f AS (SELECT query_id, max(score) AS top FROM r1 GROUP BY query_id), q0 AS (SELECT item_id AS query_id FROM eval_items WHERE question IS NOT NULL) SELECT query_id, f.top AS top_score, (f.top IS NULL OR f.top < 20) AS fallback FROM q0 LEFT JOIN f USING (query_id)")
def fallback_gate_axis(s, d):
    top = two_rankings(s, d)["words"].groupBy("query_id").agg(F.max("score").alias("top_score"))
    return questions(s, d).select("query_id").join(top, "query_id", "left").withColumn("fallback", F.col("top_score").isNull() | (F.col("top_score") < 20))


@query(f"""WITH {_two()}, f AS (SELECT query_id, max(score) AS top FROM r1 GROUP BY query_id), t AS (SELECT unnest([5.0, 10.0, 20.0, 40.0]) AS threshold),
g AS (SELECT item_id AS query_id, lang = 'ko' AS truth FROM eval_items WHERE question IS NOT NULL)
SELECT threshold, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM (SELECT threshold, count(*) FILTER (coalesce(top, 0) >= threshold AND truth) AS tp, count(*) FILTER (coalesce(top, 0) >= threshold AND NOT truth) AS fp, count(*) FILTER (coalesce(top, 0) < threshold AND truth) AS fn FROM g LEFT JOIN f USING (query_id) CROSS JOIN t GROUP BY threshold)""")
def threshold_tuning(s, d):
    top = two_rankings(s, d)["words"].groupBy("query_id").agg(F.max("score").alias("top"))
    g = table(s, d, "eval_items").where("question is not null").select(F.col("item_id").alias("query_id"), (F.col("lang") == "ko").alias("truth")).join(top, "query_id", "left")
    x = g.withColumn("threshold", F.explode(F.array(*[F.lit(v) for v in (5.0, 10.0, 20.0, 40.0)]))).withColumn("fires", F.coalesce("top", F.lit(0.0)) >= F.col("threshold"))
    c = x.groupBy("threshold").agg(F.count_if(F.col("fires") & F.col("truth")).alias("tp"), F.count_if(F.col("fires") & ~F.col("truth")).alias("fp"), F.count_if(~F.col("fires") & F.col("truth")).alias("fn"))
    rate = lambda n: F.round(F.coalesce(F.col("tp") / F.nullif(F.col("tp") + F.col(n), F.lit(0)), F.lit(0.0)), 6)
    return c.select("threshold", "tp", "fp", "fn", rate("fp").alias("precision"), rate("fn").alias("recall"))


# ---- metrics over the submitted rankings of all runs


def _suite(k: int) -> str:
    ideal = f"list_sum(list_transform(range(1, least(any_value(n_gold), {k}) + 1), lambda i: 1 / log2(i + 1.0)))"
    return f"CAST(least(count(*) FILTER (rank <= {k}), 1) AS INT) AS hit{k}, round(count(*) FILTER (rank <= {k}) / {k}, 6) AS p{k}, round(count(*) FILTER (rank <= {k}) / any_value(n_gold), 6) AS r{k}, round(coalesce(sum(1 / log2(rank + 1.0)) FILTER (rank <= {k}), 0) / {ideal}, 6) AS ndcg{k}"


HITS = RUNS + """, ng AS (SELECT query_id, count(*) AS n_gold FROM gd GROUP BY query_id),
ht AS (SELECT ng.query_id, n_gold, rank FROM ng LEFT JOIN (SELECT rk.query_id, rank FROM rk JOIN gd USING (query_id, doc_id)) USING (query_id)),
su AS (SELECT query_id, min(rank) AS first_rank, round(coalesce(max(1 / rank) FILTER (rank <= 10), 0), 6) AS rr10, """ + ", ".join(_suite(k) for k in (1, 5, 10)) + " FROM ht GROUP BY query_id)"


def suite(s, d):
    r = runs(s, d)
    return metrics.rank_suite(submitted(r), judged(r))


@query("WITH " + HITS + " SELECT * FROM su")
def metric_rank_suite(s, d):
    return suite(s, d)


for _name, _col in (("metric_recall_at_k", "r5"), ("metric_hit_at_k", "hit5"), ("metric_precision_at_k", "p5"), ("metric_mrr_at_k", "rr10"), ("metric_ndcg_binary", "ndcg10"), ("win_rank_gold", "first_rank")):
    QUERIES[_name] = lambda s, d, c=_col: suite(s, d).select("query_id", c)
    SQL[_name] = f"WITH {HITS} SELECT query_id, {_col} FROM su"


@query("WITH " + RUNS + """, g AS (SELECT query_id, unnest(gold_chunk_ids) AS doc_id, generate_subscripts(gold_chunk_ids, 1) AS i FROM k), gg AS (SELECT query_id, doc_id, max(CASE WHEN i = 1 THEN 2.0 ELSE 1.0 END) AS gain FROM g WHERE doc_id IS NOT NULL GROUP BY ALL),
i AS (SELECT query_id, sum(gain / log2(n + 1.0)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id) AS n FROM gg) WHERE n <= 10 GROUP BY query_id),
o AS (SELECT query_id, sum(gain / log2(rank + 1.0)) AS got FROM rk JOIN gg USING (query_id, doc_id) WHERE rank <= 10 GROUP BY query_id) SELECT query_id, round(coalesce(got, 0) / ideal, 6) AS ndcg FROM i LEFT JOIN o USING (query_id)""")
def metric_ndcg_graded(s, d):
    r = runs(s, d)
    g = r.select("query_id", F.posexplode("gold_chunk_ids").alias("i", "doc_id")).where("doc_id is not null").withColumn("gain", F.when(F.col("i") == 0, 2.0).otherwise(1.0))
    return metrics.ndcg_graded(submitted(r), g)


@query("WITH " + HITS + " SELECT split, source, count(*) AS n, round(avg(su.r5), 6) AS recall5, round(avg(su.rr10), 6) AS mrr, round(avg(ndcg10), 6) AS ndcg FROM su JOIN k USING (query_id) GROUP BY GROUPING SETS ((), (split), (source))")
def metric_multi_grouping(s, d):
    x = suite(s, d).select("query_id", F.col("r5").alias("recall5"), F.col("rr10").alias("mrr"), F.col("ndcg10").alias("ndcg")).join(runs(s, d).select("query_id", "split", "source"), "query_id")
    return metrics.grouped_means(x, ["split", "source"], ["recall5", "mrr", "ndcg"])


def _exact_mean(c: str):
    """Mean of values with four decimals, summed as integers so that it does not depend on the order."""
    return F.sum(F.round(F.col(c) * 10000).cast("long")).cast("double") / F.count(c) / 10000


@query("WITH " + RUNS + " SELECT run_id, count(*) AS n, CAST(sum(CAST(round(r5 * 10000) AS BIGINT)) AS DOUBLE) / count(r5) / 10000 AS r5, CAST(sum(CAST(round(rr10 * 10000) AS BIGINT)) AS DOUBLE) / count(rr10) / 10000 AS rr10, round(quantile_cont(elapsed, 0.5), 6) AS p50, round(quantile_cont(elapsed, 0.95), 6) AS p95 FROM k GROUP BY run_id")
def metric_macro_aggregate(s, d):
    return runs(s, d).groupBy("run_id").agg(F.count("*").alias("n"), _exact_mean("r5").alias("r5"), _exact_mean("rr10").alias("rr10"), F.round(F.percentile("elapsed", 0.5), 6).alias("p50"), F.round(F.percentile("elapsed", 0.95), 6).alias("p95"))


@query("WITH " + RUNS + " SELECT run_id, count(*) AS n, round(avg(CASE WHEN error <> 0 OR submitted IS NULL THEN 1.0 ELSE 0.0 END), 6) AS failure_rate, avg(CASE WHEN error <> 0 OR submitted IS NULL THEN 1.0 ELSE 0.0 END) > 0.2 AS abort FROM k GROUP BY run_id")
def metric_failure_rate(s, d):
    f = F.avg(F.when((F.col("error") != 0) | F.col("submitted").isNull(), 1.0).otherwise(0.0))
    return runs(s, d).groupBy("run_id").agg(F.count("*").alias("n"), F.round(f, 6).alias("failure_rate"), (f > 0.2).alias("abort"))


@query("WITH " + RUNS + """, l AS (SELECT rk.query_id, rk.doc_id, rank, len FROM rk LEFT JOIN (SELECT chunk_id AS doc_id, max(length(text)) AS len FROM chunks GROUP BY chunk_id) USING (doc_id)),
b AS (SELECT *, coalesce(sum(coalesce(len, 0)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l),
h AS (SELECT query_id, count(*) AS got FROM b JOIN gd USING (query_id, doc_id) WHERE before < 2000 GROUP BY query_id), n AS (SELECT query_id, count(*) AS n FROM gd GROUP BY query_id)
SELECT query_id, round(coalesce(got, 0) / n, 6) AS recall FROM n LEFT JOIN h USING (query_id)""")
def metric_char_budget_recall(s, d):
    r = runs(s, d)
    length = table(s, d, "chunks").groupBy(F.col("chunk_id").alias("doc_id")).agg(F.max(F.char_length("text")).alias("len"))
    x = submitted(r).join(length, "doc_id", "left").withColumn("len", F.coalesce("len", F.lit(0)))
    return metrics.char_budget_hits(x, judged(r), "len", 2000)


PAIRS = HITS + """, w AS (SELECT k.split, k.source, k.qid, max(su.r5) FILTER (rep = 0) AS a, max(su.r5) FILTER (rep = 1) AS b, max(hit5) FILTER (rep = 0) AS ha, max(hit5) FILTER (rep = 1) AS hb FROM su JOIN k USING (query_id) GROUP BY ALL),
pr AS (SELECT * FROM w WHERE a IS NOT NULL AND b IS NOT NULL)"""


def pairs(s, d):
    """Recall and hit at 5 of the first two reps of every evaluation question."""
    x = suite(s, d).select("query_id", "r5", "hit5").join(runs(s, d).select("query_id", "split", "source", "qid", "rep"), "query_id")
    at = lambda c, rep, n: F.max(F.when(F.col("rep") == rep, F.col(c))).alias(n)
    return x.groupBy("split", "source", "qid").agg(at("r5", 0, "a"), at("r5", 1, "b"), at("hit5", 0, "ha"), at("hit5", 1, "hb")).where("a is not null and b is not null")


@query("WITH " + PAIRS + " SELECT count(*) FILTER (a - b > 0) AS wins, count(*) FILTER (a - b = 0) AS ties, count(*) FILTER (a - b < 0) AS losses, round(avg(a - b), 6) AS mean_difference FROM pr")
def metric_paired_wtl(s, d):
    return stats.win_tie_loss(pairs(s, d), "a", "b")


@query("WITH " + PAIRS + " SELECT split, source, qid, a, b FROM pr")
def join_paired_arms(s, d):
    return pairs(s, d).select("split", "source", "qid", "a", "b")


@query("WITH " + HITS + ", x AS (SELECT split, source, qid, bool_or(rep = 0 AND su.hit5 = 1) AS a, bool_or(rep = 1 AND su.hit5 = 1) AS b FROM su JOIN k USING (query_id) GROUP BY ALL) SELECT CASE WHEN a AND b THEN 'both' WHEN a THEN 'first_only' WHEN b THEN 'second_only' ELSE 'neither' END AS kind, count(*) AS n FROM x GROUP BY 1")
def metric_channel_oracle(s, d):
    r = runs(s, d).withColumn("query_id", F.struct("split", "source", "qid"))
    first, second = r.where("rep = 0"), r.where("rep = 1")
    return metrics.channel_oracle(submitted(first), submitted(second), judged(r.where("gold_chunk_ids is not null")), 5)


@query("WITH " + PAIRS + ", s AS (SELECT count(*) FILTER (ha = 1 AND hb = 0) AS only_a, count(*) FILTER (ha = 0 AND hb = 1) AS only_b FROM pr) SELECT only_a, only_b, round(CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1), lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2.0))))) END, 6) AS p FROM s")
def stat_mcnemar_exact(s, d):
    return stats.mcnemar(pairs(s, d), "ha", "hb")


@query("WITH " + PAIRS + ", s AS (SELECT count(*) FILTER (a > b) AS greater, count(*) FILTER (a < b) AS less FROM pr) SELECT greater, less, round(CASE WHEN greater + less = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(greater, less) + 1), lambda i: exp(lgamma(greater + less + 1) - lgamma(i + 1) - lgamma(greater + less - i + 1) - (greater + less) * ln(2.0))))) END, 6) AS p FROM s")
def stat_sign_test(s, d):
    return stats.sign_test(pairs(s, d), "a", "b")


@query("WITH " + PAIRS + " SELECT count(*) AS n, round(2.801585 * stddev_samp(a - b) / sqrt(count(*)), 6) AS mde FROM pr")
def stat_mde(s, d):
    return stats.minimum_detectable(pairs(s, d).withColumn("diff", F.col("a") - F.col("b")), "diff")


@query("""WITH t AS (SELECT doc_type AS name, round(exp(-count(*) / 100.0), 9) AS p FROM documents WHERE doc_type IS NOT NULL GROUP BY doc_type), r AS (SELECT *, row_number() OVER (ORDER BY p, name) AS r, count(*) OVER () AS m FROM t)
SELECT name, p, round(max(least(1.0, (m - r + 1) * p)) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM r""")
def stat_holm(s, d):
    t = table(s, d, "documents").where("doc_type is not null").groupBy(F.col("doc_type").alias("name")).agg(F.round(F.exp(-F.count("*") / 100.0), 9).alias("p"))
    return stats.holm(t)


@query()
def stat_bootstrap_percentile(s, d):
    return stats.bootstrap(suite(s, d), "query_id", "r5")


@query()
def stat_signflip(s, d):
    p = pairs(s, d).withColumn("key", F.concat_ws("|", "split", "source", "qid"))
    return stats.sign_flip(p, "key", "a", "b")


@query()
def stat_cluster_bootstrap(s, d):
    x = suite(s, d).select("query_id", "r5").join(runs(s, d).select("query_id", F.concat_ws("|", "split", "source", "qid").alias("cluster")), "query_id")
    return stats.bootstrap(x.groupBy("cluster").agg(F.avg("r5").alias("r5")), "cluster", "r5")


@query()
def compare_probe_rows(s, d):
    p = pairs(s, d).withColumn("key", F.concat_ws("|", "split", "source", "qid")).withColumn("difference", F.col("a") - F.col("b"))
    return stats.bootstrap(p, "key", "difference")


# ---- joins of spans and units

_ELS = "el AS (SELECT DISTINCT document_key AS doc, element_id AS unit_id, char_start AS u0, char_end AS u1 FROM elements WHERE char_start IS NOT NULL AND char_start < char_end)"
_CHS = "ch AS (SELECT DISTINCT document_key AS doc, chunk_id AS span_id, char_start AS c0, char_end AS c1 FROM chunks WHERE char_start IS NOT NULL AND char_start < char_end)"
OVER = f"{_ELS}, {_CHS}, ov AS (SELECT doc, span_id, c0, c1, unit_id, u0, u1, least(u1, c1) - greatest(u0, c0) AS overlap FROM ch JOIN el USING (doc) WHERE u0 < c1 AND u1 > c0)"


def units_and_spans(s, d):
    u = table(s, d, "elements").select(F.col("document_key").alias("doc"), F.col("element_id").alias("unit_id"), F.col("char_start").alias("u0"), F.col("char_end").alias("u1")).distinct()
    c = table(s, d, "chunks").select(F.col("document_key").alias("doc"), F.col("chunk_id").alias("span_id"), F.col("char_start").alias("c0"), F.col("char_end").alias("c1")).distinct()
    return u, c


@query(f"WITH {OVER}, i AS (SELECT *, (u0 <= c0 AND u1 >= c1) AS inside FROM ov), j AS (SELECT *, bool_or(inside) OVER (PARTITION BY doc, span_id) AS any_in, row_number() OVER (PARTITION BY doc, span_id ORDER BY inside DESC, u1 - u0, u0, unit_id) AS n FROM i) SELECT doc, span_id, unit_id, greatest(u0, c0) AS s0, least(u1, c1) AS s1, CASE WHEN any_in THEN 'contained' ELSE 'split' END AS how FROM j WHERE (any_in AND n = 1) OR NOT any_in")
def join_span_overlap(s, d):
    return spans.smallest_containing(*units_and_spans(s, d))


@query(f"WITH {OVER} SELECT doc, span_id, unit_id, overlap FROM (SELECT *, row_number() OVER (PARTITION BY doc, span_id ORDER BY overlap DESC, u0, unit_id) AS n FROM ov) WHERE n = 1")
def join_span_max_overlap(s, d):
    return spans.greatest_overlap(*units_and_spans(s, d)).select("doc", "span_id", "unit_id", "overlap")


@query(f"WITH {OVER} SELECT doc, span_id, unit_id, overlap FROM ov")
def join_span_all_overlaps(s, d):
    return spans.overlapping(*units_and_spans(s, d)).select("doc", "span_id", "unit_id", "overlap")


@query(f"WITH {OVER} SELECT doc, count(DISTINCT span_id) AS spans, count(DISTINCT unit_id) AS units FROM ov GROUP BY doc")
def predicate_span_overlap(s, d):
    return spans.overlapping(*units_and_spans(s, d)).groupBy("doc").agg(F.count_distinct("span_id").alias("spans"), F.count_distinct("unit_id").alias("units"))


@query(f"WITH {OVER}, t AS (SELECT DISTINCT element_id AS unit_id, lower(trim(x)) AS tag FROM (SELECT element_id, unnest(role) AS x FROM element_semantic_fields_v4) WHERE x IS NOT NULL), c AS (SELECT span_id, tag, count(DISTINCT unit_id) AS n FROM ov JOIN t USING (unit_id) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY span_id ORDER BY n DESC, tag) AS i FROM c) SELECT span_id, string_agg(tag, ' ' ORDER BY i) AS summary FROM r WHERE i <= 3 GROUP BY span_id")
def join_chunk_tag_summary(s, d):
    from pyspark.sql import Window

    t = table(s, d, "element_semantic_fields_v4").select(F.col("element_id").alias("unit_id"), F.explode("role").alias("x")).where("x is not null").select("unit_id", F.lower(F.trim("x")).alias("tag")).distinct()
    c = spans.overlapping(*units_and_spans(s, d)).join(t, "unit_id").groupBy("span_id", "tag").agg(F.count_distinct("unit_id").alias("n"))
    r = c.withColumn("i", F.row_number().over(Window.partitionBy("span_id").orderBy(F.col("n").desc(), "tag"))).where("i <= 3")
    return r.groupBy("span_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "tag"))), lambda x: x["tag"]), " ").alias("summary"))


_ORD = "SELECT DISTINCT element_id, document_key, line_start, CASE WHEN element_type = 'heading' THEN text END AS heading, nullif(trim(contract_scope), '') AS scope FROM elements WHERE line_start IS NOT NULL"


def ordered_elements(s, d):
    e = table(s, d, "elements").where("line_start is not null")
    return e.select("element_id", "document_key", "line_start", F.when(F.col("element_type") == "heading", F.col("text")).alias("heading"), F.nullif(F.trim("contract_scope"), F.lit("")).alias("scope")).distinct()


@query(f"WITH o AS ({_ORD}) SELECT element_id, line_start, last_value(heading IGNORE NULLS) OVER (PARTITION BY document_key ORDER BY line_start, element_id ROWS UNBOUNDED PRECEDING) AS heading_now FROM o")
def join_asof_heading(s, d):
    return spans.carried(ordered_elements(s, d), "document_key", ["line_start", "element_id"], "heading").select("element_id", "line_start", "heading_now")


@query(f"WITH o AS ({_ORD}) SELECT element_id, line_start, last_value(heading IGNORE NULLS) OVER w AS heading_now, last_value(scope IGNORE NULLS) OVER w AS scope_now FROM o WINDOW w AS (PARTITION BY document_key ORDER BY line_start, element_id ROWS UNBOUNDED PRECEDING)")
def win_running_context(s, d):
    return spans.carried(ordered_elements(s, d), "document_key", ["line_start", "element_id"], "heading", "scope").select("element_id", "line_start", "heading_now", "scope_now")


@query(f"WITH o AS ({_ORD}), b AS (SELECT *, CASE WHEN scope IS DISTINCT FROM lag(scope) OVER (PARTITION BY document_key ORDER BY line_start, element_id) THEN 1 ELSE 0 END AS step FROM o), g AS (SELECT *, sum(step) OVER (PARTITION BY document_key ORDER BY line_start, element_id ROWS UNBOUNDED PRECEDING) AS run FROM b) SELECT document_key, run, min(scope) AS scope, min(line_start) AS first_line, max(line_start) AS last_line, count(*) AS n FROM g GROUP BY document_key, run")
def join_asof_breakpoints(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("document_key").orderBy("line_start", "element_id")
    o = ordered_elements(s, d).withColumn("step", F.when(F.equal_null(F.col("scope"), F.lag("scope").over(w)), 0).otherwise(1))
    o = o.withColumn("run", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return o.groupBy("document_key", "run").agg(F.min("scope").alias("scope"), F.min("line_start").alias("first_line"), F.max("line_start").alias("last_line"), F.count("*").alias("n"))


SQL["join_asof_breakpoints"] = SQL["join_asof_breakpoints"].replace("CASE WHEN scope IS DISTINCT FROM lag(scope) OVER (PARTITION BY document_key ORDER BY line_start, element_id) THEN 1 ELSE 0 END", "CASE WHEN scope IS NOT DISTINCT FROM lag(scope) OVER (PARTITION BY document_key ORDER BY line_start, element_id) THEN 0 ELSE 1 END")


@query("SELECT DISTINCT e.element_id, f.schema_tag, f.contract_key FROM elements e JOIN element_semantic_fields_v4 f ON e.element_id = f.element_id")
def join_id_tags(s, d):
    return table(s, d, "elements").select("element_id").join(table(s, d, "element_semantic_fields_v4").select("element_id", "schema_tag", "contract_key"), "element_id").distinct()


@query("SELECT DISTINCT doc_id, doc_type FROM doc_facts WHERE doc_id IN (SELECT document_key FROM chunks)")
def join_semi_subset(s, d):
    return table(s, d, "doc_facts").join(table(s, d, "chunks").select(F.col("document_key").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "doc_type").distinct()


_GOLD = "SELECT DISTINCT qid, c FROM (SELECT qid, unnest(gold_chunk_ids) AS c FROM train350_gold) WHERE c IS NOT NULL AND qid IS NOT NULL"


def train_gold(s, d):
    return table(s, d, "train350_gold").where("qid is not null").select("qid", F.explode("gold_chunk_ids").alias("c")).where("c is not null").distinct()


@query(f"SELECT qid, c FROM ({_GOLD}) g WHERE NOT EXISTS (SELECT 1 FROM chunks WHERE chunk_id = g.c)")
def join_anti_missing(s, d):
    return train_gold(s, d).join(table(s, d, "chunks").select(F.col("chunk_id").alias("c")), "c", "left_anti").select("qid", "c")


QUERIES["set_difference"], SQL["set_difference"] = lambda s, d: join_anti_missing(s, d).select("c").distinct(), f"SELECT DISTINCT c FROM ({SQL['join_anti_missing']})"


@query("SELECT c FROM (SELECT unnest(gold_chunk_ids) AS c FROM train350_gold) INTERSECT SELECT c FROM (SELECT unnest(gold_chunk_ids) AS c FROM results)")
def set_intersect(s, d):
    one = lambda t: table(s, d, t).select(F.explode("gold_chunk_ids").alias("c"))
    return one("train350_gold").intersect(one("results"))


_DECL = r"""de AS (SELECT document_key || '#' || regexp_extract(title, '^제[0-9]+조(?:의[0-9]+)?') AS key, element_id AS target FROM elements WHERE regexp_matches(title, '^제[0-9]+조') AND element_type = 'heading'),
un AS (SELECT key, min(target) AS target FROM de WHERE key IS NOT NULL GROUP BY key HAVING count(DISTINCT target) = 1),
re AS (SELECT DISTINCT e.element_id AS source, e.document_key || '#' || r AS key FROM (SELECT element_id, unnest(reference) AS r FROM element_semantic_fields_v4) f JOIN elements e USING (element_id) WHERE r IS NOT NULL),
p1 AS (SELECT DISTINCT source, target FROM re JOIN un USING (key) WHERE source <> target), al AS (SELECT source, target, 1 AS hops FROM p1 UNION ALL SELECT a.source, b.target, 2 FROM p1 a JOIN p1 b ON a.target = b.source WHERE a.source <> b.target)"""


@query(f"WITH {_DECL} SELECT source, target, min(hops) AS hops FROM al GROUP BY ALL")
def join_reference_graph(s, d):
    e = table(s, d, "elements")
    article = F.regexp_extract("title", r"^(제[0-9]+조(?:의[0-9]+)?)", 1)
    declared = e.where((F.col("element_type") == "heading") & F.col("title").rlike("^제[0-9]+조")).select(F.concat("document_key", F.lit("#"), article).alias("key"), F.col("element_id").alias("target")).where("key is not null")
    refs = table(s, d, "element_semantic_fields_v4").select("element_id", F.explode("reference").alias("r")).where("r is not null").join(e.select("element_id", "document_key").distinct(), "element_id")
    return spans.reference_paths(declared, refs.select(F.col("element_id").alias("source"), F.concat("document_key", F.lit("#"), "r").alias("key")).distinct())


@query(f"""WITH RECURSIVE g AS ({_GOLD}), e AS (SELECT 'q' || qid AS a, 'c' || c AS b FROM g), ed AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT DISTINCT a AS id, a AS component FROM ed UNION SELECT ed.b, r.component FROM r JOIN ed ON ed.a = r.id)
SELECT id, min(component) AS component FROM r GROUP BY id""")
def join_gold_regions_union_find(s, d):
    return spans.components(train_gold(s, d).select(F.concat(F.lit("q"), "qid").alias("a"), F.concat(F.lit("c"), "c").alias("b")))


@query("SELECT c.chunk_id, c.section_path[len(c.section_path)] AS last_section, d.product_dir FROM (SELECT DISTINCT chunk_id, section_path, document_key FROM chunks) c LEFT JOIN (SELECT DISTINCT doc_id, product_dir FROM doc_facts) d ON d.doc_id = c.document_key")
def parent_map(s, d):
    c = table(s, d, "chunks").select("chunk_id", "section_path", "document_key").distinct()
    f = table(s, d, "doc_facts").select(F.col("doc_id").alias("document_key"), "product_dir").distinct()
    return c.join(f, "document_key", "left").select("chunk_id", F.when(F.size("section_path") > 0, F.element_at("section_path", -1)).alias("last_section"), "product_dir")


# ---- windows, sorts, samples, sets


@query(f"""WITH {_CHS}, f AS (SELECT doc, c0, c1, max(c1) OVER (PARTITION BY doc ORDER BY c0, c1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM (SELECT DISTINCT doc, c0, c1 FROM ch)),
i AS (SELECT *, sum(CASE WHEN c0 - far <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY c0, c1 ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT doc, min(c0) AS c0, max(c1) AS c1, count(*) AS n FROM i GROUP BY doc, island""")
def win_gap_islands_merge(s, d):
    c = units_and_spans(s, d)[1].where("c0 is not null and c0 < c1").select("doc", "c0", "c1").distinct()
    return spans.merged(c, "doc", 50)


@query("SELECT clean_name, doc_id, doc_date FROM (SELECT *, rank() OVER (PARTITION BY clean_name ORDER BY doc_date DESC) AS r FROM (SELECT DISTINCT clean_name, doc_id, doc_date FROM doc_facts WHERE doc_date IS NOT NULL)) WHERE r = 1")
def win_latest_version(s, d):
    from pyspark.sql import Window

    f = table(s, d, "doc_facts").where("doc_date is not null").select("clean_name", "doc_id", "doc_date").distinct()
    return f.withColumn("r", F.rank().over(Window.partitionBy("clean_name").orderBy(F.col("doc_date").desc()))).where("r = 1").drop("r")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents WHERE text IS NOT NULL),
i AS (SELECT *, no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS island FROM l WHERE regexp_matches(line, '^[\s=\-0-9]*$')) SELECT doc_id, min(no) AS start, count(*) AS lines FROM i GROUP BY doc_id, island HAVING count(*) >= 3""")
def win_noise_runs(s, d):
    from textloom.operators import segments

    return segments.noise_runs(table(s, d, "documents").where("text is not null"))


@query("SELECT doc_id, source, n FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY sha256('17|' || doc_id)) AS n FROM documents) WHERE n <= 5")
def win_stratified_even_sample(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(F.sha2(F.concat(F.lit("17|"), F.col("doc_id").cast("string")), 256))
    return table(s, d, "documents").select("doc_id", "source").withColumn("n", F.row_number().over(w)).where("n <= 5")


@query("SELECT qid FROM (SELECT DISTINCT qid FROM train350_gold WHERE qid IS NOT NULL) ORDER BY sha256('7|' || qid), qid LIMIT 50")
def sample_seeded_queries(s, d):
    return table(s, d, "train350_gold").select("qid").where("qid is not null").distinct().orderBy(F.sha2(F.concat(F.lit("7|"), "qid"), 256), "qid").limit(50)


@query("SELECT chunk_id, gold, CASE WHEN b < 32 THEN 'small' WHEN b < 96 THEN 'medium' ELSE 'large' END AS subset FROM (SELECT chunk_id, gold, CASE WHEN gold THEN 0 ELSE ('0x' || left(sha256('3|' || chunk_id), 2))::INT END AS b FROM (SELECT DISTINCT chunk_id, chunk_id IN (SELECT c FROM (SELECT unnest(gold_chunk_ids) AS c FROM train350_gold) WHERE c IS NOT NULL) AS gold FROM chunks WHERE chunk_id IS NOT NULL))")
def sample_nested_subsets(s, d):
    g = train_gold(s, d).select(F.col("c").alias("chunk_id"), F.lit(True).alias("g")).distinct()
    c = table(s, d, "chunks").select("chunk_id").where("chunk_id is not null").distinct().join(g, "chunk_id", "left").select("chunk_id", F.coalesce("g", F.lit(False)).alias("gold"))
    b = F.when(F.col("gold"), 0).otherwise(F.conv(F.substring(F.sha2(F.concat(F.lit("3|"), "chunk_id"), 256), 1, 2), 16, 10).cast("int"))
    return c.select("chunk_id", "gold", F.when(b < 32, "small").when(b < 96, "medium").otherwise("large").alias("subset"))


@query("SELECT doc_id, source, CASE WHEN row_number() OVER (PARTITION BY source ORDER BY sha256(CAST(doc_id AS VARCHAR))) <= 30 THEN 'dev' ELSE 'test' END AS part FROM documents")
def split_assign_hash(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(F.sha2(F.col("doc_id").cast("string"), 256))
    return table(s, d, "documents").select("doc_id", "source", F.when(F.row_number().over(w) <= 30, "dev").otherwise("test").alias("part"))


@query("SELECT DISTINCT qid FROM train350_gold t WHERE qid IS NOT NULL AND regexp_matches(question, '며칠') AND NOT EXISTS (SELECT 1 FROM results r WHERE r.qid = t.qid) ORDER BY sha256('9|' || qid) LIMIT 20")
def audit_batch_select(s, d):
    t = table(s, d, "train350_gold").where("qid is not null").where(F.col("question").rlike("며칠")).select("qid").distinct()
    return t.join(table(s, d, "results").select("qid"), "qid", "left_anti").orderBy(F.sha2(F.concat(F.lit("9|"), "qid"), 256)).limit(20)


SQL["audit_batch_select"] = "SELECT qid FROM (SELECT DISTINCT qid FROM train350_gold t WHERE qid IS NOT NULL AND regexp_matches(question, '며칠') AND NOT EXISTS (SELECT 1 FROM results r WHERE r.qid = t.qid)) ORDER BY sha256('9|' || qid) LIMIT 20"


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def limit_topk(s, d):
    return table(s, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100)


@query("SELECT element_id, rank() OVER (PARTITION BY document_key ORDER BY line_start NULLS LAST, line_end NULLS LAST, element_id) AS place FROM (SELECT DISTINCT element_id, document_key, line_start, line_end FROM elements)")
def sort_total_order(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("document_key").orderBy(F.col("line_start").asc_nulls_last(), F.col("line_end").asc_nulls_last(), "element_id")
    return table(s, d, "elements").select("element_id", "document_key", "line_start", "line_end").distinct().select("element_id", F.rank().over(w).alias("place"))


@query("SELECT element_id, title, text FROM (SELECT *, row_number() OVER (PARTITION BY title, text ORDER BY element_id, loaded_at) AS n FROM elements WHERE text IS NOT NULL) WHERE n = 1")
def dedup_first_occurrence(s, d):
    e = table(s, d, "elements").where("text is not null")
    return e.groupBy("title", "text").agg(F.min("element_id").alias("element_id")).select("element_id", "title", "text")


# ---- exploration


@query("SELECT count(n) AS n, min(n) AS lo, max(n) AS hi, round(avg(n), 4) AS mean, round(quantile_cont(n, 0.25), 4) AS p25, round(quantile_cont(n, 0.5), 4) AS p50, round(quantile_cont(n, 0.75), 4) AS p75, round(quantile_cont(n, 0.95), 4) AS p95, round(quantile_cont(n, 0.99), 4) AS p99 FROM (SELECT length(text) AS n FROM documents)")
def eda_distribution(s, d):
    n = table(s, d, "documents").select(F.char_length("text").alias("n"))
    q = lambda p: F.round(F.percentile("n", p), 4)
    return n.agg(F.count("n").alias("n"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.round(F.avg("n"), 4).alias("mean"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), q(0.95).alias("p95"), q(0.99).alias("p99"))


@query("SELECT sha256(text) AS h, count(*) AS n, count(*) - 1 AS excess FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def eda_duplicates(s, d):
    return table(s, d, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.count("*").alias("n")).where("n > 1").withColumn("excess", F.col("n") - 1)


@query(r"SELECT doc_id, CASE WHEN lines < 5 THEN 'D' WHEN articles >= 3 THEN 'A' WHEN tables > 0.2 * lines THEN 'C' ELSE 'B' END AS kind FROM (SELECT doc_id, len(string_split(text, chr(10))) AS lines, len(regexp_extract_all(text, '제[0-9]+조')) AS articles, len(list_filter(string_split(text, chr(10)), lambda x: starts_with(x, '|'))) AS tables FROM documents WHERE text IS NOT NULL)")
def eda_type_assign(s, d):
    lines = F.split("text", "\n")
    x = table(s, d, "documents").where("text is not null").select("doc_id", F.size(lines).alias("lines"), F.size(F.regexp_extract_all("text", F.lit("(제[0-9]+조)"), F.lit(1))).alias("articles"), F.size(F.filter(lines, lambda v: F.startswith(v, F.lit("|")))).alias("tables"))
    return x.select("doc_id", F.when(F.col("lines") < 5, "D").when(F.col("articles") >= 3, "A").when(F.col("tables") > 0.2 * F.col("lines"), "C").otherwise("B").alias("kind"))


@query("SELECT kind, count(*) AS n FROM (" + SQL["eda_type_assign"] + ") GROUP BY kind")
def eda_structure_class(s, d):
    return eda_type_assign(s, d).groupBy("kind").agg(F.count("*").alias("n"))


_RULES = (("payment", "지급"), ("surgery", "수술"), ("deadline", "일 안에|days"), ("table", r"^\|"))


@query("SELECT element_id, coalesce(nullif(concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{n}' END" for n, p in _RULES) + "), ''), 'other') AS labels FROM elements WHERE text IS NOT NULL")
def eda_label_rules(s, d):
    hit = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), n) for n, p in _RULES]))
    return table(s, d, "elements").where("text is not null").select("element_id", F.when(F.size(hit) == 0, "other").otherwise(F.array_join(hit, ",")).alias("labels"))


@query(r"""SELECT kind, count(*) AS n, CAST(sum(length(line)) AS BIGINT) AS chars FROM (SELECT line, CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^#{1,6} ') THEN 'heading' WHEN starts_with(line, '|') THEN 'table' WHEN regexp_matches(line, '^[①-⑳]') THEN 'item' ELSE 'text' END AS kind FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM elements WHERE text IS NOT NULL)) GROUP BY kind""")
def eda_line_census(s, d):
    line = F.col("line")
    kind = F.when(F.trim(line) == "", "blank").when(line.rlike("^#{1,6} "), "heading").when(F.startswith(line, F.lit("|")), "table").when(line.rlike("^[①-⑳]"), "item").otherwise("text")
    return table(s, d, "elements").where("text is not null").select(F.explode(F.split("text", "\n")).alias("line")).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.sum(F.char_length("line")).alias("chars"))


@query("WITH x AS (SELECT elapsed FROM results WHERE elapsed IS NOT NULL) SELECT round(quantile_cont(elapsed, 0.9), 6) AS linear, round(quantile_disc(elapsed, 0.5), 6) AS nearest FROM x")
def percentile_variants(s, d):
    return table(s, d, "results").agg(F.round(F.percentile("elapsed", 0.9), 6).alias("linear"), F.round(F.expr("percentile_disc(0.5) within group (order by elapsed)"), 6).alias("nearest"))


@query("SELECT count(*) AS n, " + ", ".join(f"round(avg(CASE WHEN len({c}) > 0 THEN 1.0 ELSE 0.0 END), 6) AS {c}" for c in ("subject_key", "role", "qualifier", "reference")) + " FROM element_semantic_fields_v4")
def audit_coverage(s, d):
    return table(s, d, "element_semantic_fields_v4").agg(F.count("*").alias("n"), *[F.round(F.avg(F.when(F.size(c) > 0, 1.0).otherwise(0.0)), 6).alias(c) for c in ("subject_key", "role", "qualifier", "reference")])


_PREV = "SELECT lang, doc_type, count(*) AS c FROM documents WHERE lang IS NOT NULL AND doc_type IS NOT NULL GROUP BY ALL"


@query(f"WITH p AS (SELECT lang, doc_type, c / sum(c) OVER (PARTITION BY lang) AS p FROM ({_PREV})) SELECT a.lang AS lang_a, b.lang AS lang_b, round(max(abs(a.p - b.p)), 6) AS max_difference FROM p a JOIN p b ON a.doc_type = b.doc_type AND a.lang < b.lang GROUP BY ALL")
def eda_prevalence_similarity(s, d):
    c = table(s, d, "documents").where("lang is not null and doc_type is not null").groupBy("lang", "doc_type").agg(F.count("*").alias("c"))
    p = c.join(c.groupBy("lang").agg(F.sum("c").alias("t")), "lang").select("lang", "doc_type", (F.col("c") / F.col("t")).alias("p"))
    a, b = p.select(F.col("lang").alias("lang_a"), "doc_type", F.col("p").alias("pa")), p.select(F.col("lang").alias("lang_b"), "doc_type", F.col("p").alias("pb"))
    return a.join(b, "doc_type").where("lang_a < lang_b").groupBy("lang_a", "lang_b").agg(F.round(F.max(F.abs(F.col("pa") - F.col("pb"))), 6).alias("max_difference"))


@query(f"WITH {DOCS}, {QUESTIONS}, v AS (SELECT DISTINCT unnest(tokens) AS term FROM d), t AS (SELECT DISTINCT query_id, unnest(tokens) AS term FROM q) SELECT query_id, count(*) AS terms, count(v.term) AS covered, round(count(v.term) / count(*), 6) AS share FROM t LEFT JOIN v USING (term) GROUP BY query_id")
def eda_dataset(s, d):
    v = corpus(s, d).select(F.explode("tokens").alias("term")).distinct().withColumn("known", F.lit(1))
    t = lexical.query_terms(questions(s, d), 1).join(v, "term", "left")
    return t.groupBy("query_id").agg(F.count("*").alias("terms"), F.count("known").alias("covered"), F.round(F.count("known") / F.count("*"), 6).alias("share"))


# ---- routing


@query("SELECT qid, CASE WHEN identity AND content THEN 'mixed' WHEN content THEN 'content' ELSE 'identity' END AS route FROM (SELECT qid, regexp_matches(question, '보험|특약') AS identity, regexp_matches(question, '며칠|얼마|청구|나오나요') AS content FROM train350_gold WHERE question IS NOT NULL)")
def route_query_type(s, d):
    i, c = F.col("question").rlike("보험|특약"), F.col("question").rlike("며칠|얼마|청구|나오나요")
    return table(s, d, "train350_gold").where("question is not null").select("qid", F.when(i & c, "mixed").when(c, "content").otherwise("identity").alias("route"))


@query("SELECT qid, CASE WHEN contains(question, '입원') THEN 'admission' WHEN contains(question, '코드') THEN 'code' WHEN contains(question, '청구') THEN 'claim' END AS intent FROM train350_gold WHERE question IS NOT NULL")
def route_scenario_intent(s, d):
    q = F.col("question")
    return table(s, d, "train350_gold").where("question is not null").select("qid", F.when(F.contains(q, F.lit("입원")), "admission").when(F.contains(q, F.lit("코드")), "code").when(F.contains(q, F.lit("청구")), "claim").alias("intent"))


# ---- segmentation


@query(r"""WITH p AS (SELECT doc_id, trim(x) AS p, pos FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) AS x, generate_subscripts(regexp_split_to_array(text, '\n[ \t\r]*\n'), 1) AS pos FROM documents WHERE text IS NOT NULL) WHERE trim(x) <> ''),
n AS (SELECT *, CASE WHEN length(p) >= 20 OR row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1 THEN 1 ELSE 0 END AS new FROM p), i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS no FROM n)
SELECT doc_id, no, string_agg(p, chr(10) ORDER BY pos) AS paragraph FROM i GROUP BY doc_id, no""")
def split_elements_paragraph(s, d):
    from textloom.operators import segments

    return segments.paragraphs(table(s, d, "documents").where("text is not null"))


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents WHERE text IS NOT NULL),
x AS (SELECT *, CASE WHEN regexp_matches(line, '^#{1,6} ') THEN 1 ELSE 0 END AS h FROM l), y AS (SELECT *, sum(h) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS section FROM x)
SELECT doc_id, section, max(CASE WHEN h = 1 THEN trim(regexp_replace(line, '^#{1,6} ', '')) END) AS title, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM y GROUP BY doc_id, section""")
def split_md_sections(s, d):
    from textloom.operators import segments

    return segments.sections(table(s, d, "documents").where("text is not null"))


@query(r"""WITH e AS (SELECT DISTINCT element_id, text FROM elements WHERE element_type = 'table' AND text IS NOT NULL), l AS (SELECT element_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM e),
r AS (SELECT element_id, list_transform(string_split(regexp_replace(trim(line, ' '), '^\||\|$', '', 'g'), '|'), lambda c: trim(c, ' ')) AS cells, row_number() OVER (PARTITION BY element_id ORDER BY n) - 1 AS row_no FROM l WHERE regexp_matches(line, '^\s*\|.*\|\s*$') AND NOT regexp_matches(line, '^[\s|:-]+$')),
v AS (SELECT element_id, count(DISTINCT cells[1]) > 1 AS varies, count(*) AS n FROM r WHERE row_no > 0 GROUP BY element_id)
SELECT element_id, row_no, CASE WHEN varies OR n = 1 THEN cells[1] ELSE coalesce(cells[2], cells[1]) END AS key, array_to_string(cells, ' | ') AS cells FROM r JOIN v USING (element_id) WHERE row_no > 0""")
def table_rows_extract(s, d):
    from textloom.operators import segments

    return segments.table_rows(table(s, d, "elements").where("element_type = 'table' and text is not null").select("element_id", "text").distinct())


@query()
def chunk_sentence_512(s, d):
    from textloom.operators import segments

    return segments.sentence_chunks(table(s, d, "documents"))


@query()
def chunk_boundary_overlap(s, d):
    from textloom.operators import segments

    return segments.boundary_chunks(table(s, d, "documents"))


@query(f"WITH o AS ({_ORD}), h AS (SELECT *, sum(CASE WHEN heading IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY document_key ORDER BY line_start, element_id ROWS UNBOUNDED PRECEDING) AS unit FROM o) SELECT document_key, unit, max(heading) AS heading, count(*) AS members, min(element_id) AS first_element FROM h GROUP BY document_key, unit")
def unit_aggregate_jo(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("document_key").orderBy("line_start", "element_id").rowsBetween(Window.unboundedPreceding, 0)
    h = ordered_elements(s, d).withColumn("unit", F.sum(F.col("heading").isNotNull().cast("int")).over(w))
    return h.groupBy("document_key", "unit").agg(F.max("heading").alias("heading"), F.count("*").alias("members"), F.min("element_id").alias("first_element"))


# ---- quality and contracts


@query("""SELECT 'duplicate_id' AS rule, count(*) AS violations FROM (SELECT qid FROM train350_gold GROUP BY qid HAVING count(*) > 1)
UNION ALL SELECT 'no_gold', count(*) FROM train350_gold WHERE coalesce(len(gold_chunk_ids), 0) = 0
UNION ALL SELECT 'null_type', count(*) FROM train350_gold WHERE business_type IS NULL
UNION ALL SELECT 'unknown_gold', count(*) FROM (""" + SQL["join_anti_missing"] + ")")
def qa_validate(s, d):
    t = table(s, d, "train350_gold")
    one = lambda df, rule: df.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")
    return one(t.groupBy("qid").count().where("count > 1"), "duplicate_id").unionByName(one(t.where("coalesce(size(gold_chunk_ids), 0) <= 0"), "no_gold")).unionByName(one(t.where("business_type is null"), "null_type")).unionByName(one(join_anti_missing(s, d), "unknown_gold"))


@query("""SELECT qid, CASE WHEN length(question) < 20 THEN 'reject' WHEN coalesce(len(gold_chunk_ids), 0) = 0 THEN 'revise' WHEN business_type IS NULL THEN 'revise' ELSE 'accept' END AS verdict,
concat_ws(',', CASE WHEN length(question) < 20 THEN 'short' END, CASE WHEN coalesce(len(gold_chunk_ids), 0) = 0 THEN 'no_gold' END, CASE WHEN business_type IS NULL THEN 'no_type' END) AS reasons FROM train350_gold WHERE question IS NOT NULL""")
def qa_review_rules(s, d):
    short, none, kind = F.char_length("question") < 20, F.coalesce(F.size("gold_chunk_ids"), F.lit(0)) <= 0, F.col("business_type").isNull()
    reasons = F.concat_ws(",", F.when(short, "short"), F.when(none, "no_gold"), F.when(kind, "no_type"))
    return table(s, d, "train350_gold").where("question is not null").select("qid", F.when(short, "reject").when(none | kind, "revise").otherwise("accept").alias("verdict"), reasons.alias("reasons"))


@query("SELECT element_id, coalesce(o.old_id, 'n-' || left(sha256(concat_ws('|', n.char_start, n.char_end, n.text)), 16)) AS id FROM (SELECT DISTINCT element_id, document_key, char_start, char_end, text FROM elements WHERE text IS NOT NULL AND char_start IS NOT NULL AND char_end IS NOT NULL) n LEFT JOIN (SELECT document_key, char_start, char_end, min(chunk_id) AS old_id FROM chunks GROUP BY ALL) o USING (document_key, char_start, char_end)")
def id_stabilize(s, d):
    n = table(s, d, "elements").where("text is not null and char_start is not null and char_end is not null").select("element_id", "document_key", "char_start", "char_end", "text").distinct()
    o = table(s, d, "chunks").groupBy("document_key", "char_start", "char_end").agg(F.min("chunk_id").alias("old"))
    new = F.concat(F.lit("n-"), F.substring(F.sha2(F.concat_ws("|", F.col("char_start").cast("string"), F.col("char_end").cast("string"), "text"), 256), 1, 16))
    return n.join(o, ["document_key", "char_start", "char_end"], "left").select("element_id", F.coalesce("old", new).alias("id"))


@query("SELECT title, count(DISTINCT document_key) AS documents, count(*) AS n FROM (SELECT DISTINCT element_id, title, document_key FROM elements WHERE element_type = 'heading' AND title IS NOT NULL AND title <> '') GROUP BY title HAVING count(*) > 1")
def table_catalog_audit(s, d):
    h = table(s, d, "elements").where("element_type = 'heading' and title is not null and title <> ''").select("element_id", "title", "document_key").distinct()
    return h.groupBy("title").agg(F.count_distinct("document_key").alias("documents"), F.count("*").alias("n")).where("n > 1")


@query("SELECT element_id, array_to_string(list_filter(y, lambda v, i: list_position(y, v) = i), '|') AS kept FROM (SELECT e.element_id, list_filter(list_filter(f.qualifier, lambda v: v IS NOT NULL AND v <> ''), lambda v: contains(regexp_replace(e.text, '\\s+', '', 'g'), regexp_replace(v, '\\s+', '', 'g'))) AS y FROM (SELECT DISTINCT element_id, text FROM elements WHERE text IS NOT NULL) e JOIN (SELECT DISTINCT element_id, qualifier FROM element_semantic_fields_v4 WHERE qualifier IS NOT NULL) f USING (element_id))")
def verbatim_value_filter(s, d):
    f = table(s, d, "element_semantic_fields_v4").where("qualifier is not null").select("element_id", "qualifier").distinct()
    kept = F.filter("qualifier", lambda v: v.isNotNull() & (v != "") & F.contains(F.col("t"), F.regexp_replace(v, r"\s+", "")))
    e = table(s, d, "elements").where("text is not null").select("element_id", "text").distinct().select("element_id", F.regexp_replace("text", r"\s+", "").alias("t"))
    return e.join(f, "element_id").select("element_id", F.array_join(F.array_distinct(kept), "|").alias("kept"))


@query("SELECT event_id, CASE WHEN event_type IN ('click', 'purchase') THEN 'correct' WHEN event_type = 'error' THEN 'incorrect' ELSE 'format_error' END AS verdict FROM events")
def json_parse_judgment(s, d):
    t = F.lower(F.trim("event_type"))
    return table(s, d, "events").select("event_id", F.when(t.isin("click", "purchase"), "correct").when(t == "error", "incorrect").otherwise("format_error").alias("verdict"))


@query("SELECT count(*) AS n, CAST(sum(('0x' || left(sha256(CAST(doc_id AS VARCHAR) || '|' || coalesce(text, '')), 12))::BIGINT) AS DECIMAL(38, 0))::VARCHAR AS checksum FROM documents")
def freeze_verify(s, d):
    h = F.conv(F.substring(F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.coalesce("text", F.lit(""))), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return table(s, d, "documents").agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("checksum"))


QUERIES["recompute_scores"] = lambda s, d: suite(s, d).select("query_id", "r5", "rr10")
SQL["recompute_scores"] = f"WITH {HITS} SELECT query_id, r5, rr10 FROM su"
