"""Further queries: scoring variants, routing into scopes, metrics by group, text scalars, checks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from textloom.functions import text as T
from textloom.operators import fusion, lexical
from textloom.queries import COMPACT, DOCS, FIELDS, HITS, PAIRS, QUERIES, QUESTIONS, RUNS, SQL, _by_phase, _text_query, _two, bm25_parts, bm25_sql, corpus, doc_fields, grams_sql, judged, pairs, query, questions, ranked_sql, runs, submitted, suite, train_gold, two_rankings, words_sql
from textloom.sources.tables import table

# ---- text scalars

_PARTICLES = "(으로|에서|에게|까지|부터|은|는|이|가|을|를|의|에|로|와|과|도)$"


def _stem(w):
    s = F.regexp_replace(w, _PARTICLES, "")
    return F.when((F.char_length(w) > 2) & (F.char_length(s) >= 2), s).otherwise(w)


_STEM = f"CASE WHEN length(w) > 2 AND length(regexp_replace(w, '{_PARTICLES}', '')) >= 2 THEN regexp_replace(w, '{_PARTICLES}', '') ELSE w END"
def _more(c: str) -> str:
    return f"flatten(list_transform({words_sql(c)}, lambda w: CASE WHEN length(w) >= 3 AND regexp_matches(w, '[^\\x00-\\x7F]') THEN list_concat([w], {grams_sql('w')}) ELSE [w] END))"


_text_query("tokenize_ko_suffix_strip", lambda c: F.array_join(F.transform(T.words(c), _stem), " "), f"array_to_string(list_transform({words_sql('text')}, lambda w: {_STEM}), ' ')")
_text_query("tokenize_word_plus_bigram", lambda c: F.array_join(T.words_and_bigrams(c), " "), f"array_to_string({_more('text')}, ' ')")
_text_query("tokenize_word_plus_trigram", lambda c: F.array_join(F.flatten(F.transform(T.words(c), lambda w: F.when((F.char_length(w) >= 4) & w.rlike("^[가-힣]+$"), F.concat(F.array(w), T.char_grams(w, 3))).otherwise(F.array(w)))), " "), f"array_to_string(flatten(list_transform({words_sql('text')}, lambda w: CASE WHEN length(w) >= 4 AND regexp_matches(w, '^[가-힣]+$') THEN list_concat([w], {grams_sql('w', 3)}) ELSE [w] END)), ' ')")
_text_query("str_contract_core", lambda c: T.compact(F.regexp_replace(c, r"\((무배당|갱신형|간편가입|무)[^)]*\)|무배당|갱신형", "")), COMPACT.format(r"regexp_replace(contract_scope, '\((무배당|갱신형|간편가입|무)[^)]*\)|무배당|갱신형', '', 'g')"), "elements", "element_id", "contract_scope")
_text_query("str_variants", lambda c: F.array_join(F.regexp_extract_all(c, F.lit(r"\(([^)]*)\)"), F.lit(1)), "|"), r"array_to_string(regexp_extract_all(contract_scope, '\(([^)]*)\)', 1), '|')", "elements", "element_id", "contract_scope")
_text_query("str_surface_token", lambda c: F.array_join(F.array_distinct(F.filter(F.transform(T.words(c), _stem), lambda w: F.char_length(w).between(4, 14))), " "), f"array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), ' ')", "train350_gold", "qid", "question")
SQL["str_surface_token"] = f"SELECT qid, array_to_string(list_filter(x, lambda v, i: list_position(x, v) = i), ' ') AS value FROM (SELECT qid, list_filter(list_transform({words_sql('question')}, lambda w: {_STEM}), lambda w: length(w) BETWEEN 4 AND 14) AS x FROM train350_gold WHERE question IS NOT NULL)"
QUERIES["verify_tokens"], SQL["verify_tokens"] = QUERIES["str_surface_token"], SQL["str_surface_token"]
_text_query("str_offset_map", lambda c: F.array_join(F.transform(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(c), F.lit(1))), lambda i: F.struct(i.alias("i"), F.substring(c, i, F.lit(1)).alias("ch"))), lambda x: ~x["ch"].rlike(r"^\s?$")), lambda x: (x["i"] - 1).cast("string")), ","), r"array_to_string(list_slice(list_transform(list_filter(range(1, length(question) + 1), lambda i: NOT regexp_matches(substr(question, i, 1), '^\s?$')), lambda i: i - 1), 1, 50), ',')", "eval_items", "item_id", "question")
_text_query("str_locate_all", lambda c: F.array_join(F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.char_length(c), F.lit(1))), lambda i: F.substring(c, i, F.lit(2)) == "지급"), lambda i: (i - 1).cast("string")), ","), "array_to_string(list_transform(list_filter(range(1, length(passage) + 1), lambda i: substr(passage, i, 2) = '지급'), lambda i: i - 1), ',')", "eval_items", "item_id", "passage")
_text_query("date_parse_graded", lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r"((?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])[0-3][0-9])", 1), F.lit("")), F.concat(F.lit("20"), F.nullif(F.regexp_extract(c, r"_([0-2][0-9](?:0[1-9]|1[0-2])[0-3][0-9])(?:[^0-9]|$)", 1), F.lit("")))), r"coalesce(nullif(regexp_extract(filename, '((?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])[0-3][0-9])', 1), ''), '20' || nullif(regexp_extract(filename, '_([0-2][0-9](?:0[1-9]|1[0-2])[0-3][0-9])(?:[^0-9]|$)', 1), ''))", "doc_facts", "doc_id", "filename")
_text_query("predicate_pii", lambda c: F.concat_ws(",", F.when(c.rlike(r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z]"), "email"), F.when(c.rlike(r"01[016789]-[0-9]{3,4}-[0-9]{4}"), "phone"), F.when(c.rlike(r"[0-9]{6}-[1-4][0-9]{6}"), "resident_id")), r"concat_ws(',', CASE WHEN regexp_matches(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+\.[A-Za-z]') THEN 'email' END, CASE WHEN regexp_matches(text, '01[016789]-[0-9]{3,4}-[0-9]{4}') THEN 'phone' END, CASE WHEN regexp_matches(text, '[0-9]{6}-[1-4][0-9]{6}') THEN 'resident_id' END)", "documents", "doc_id")
_text_query("query_alias_append_replace", lambda c: F.replace(F.replace(c, F.lit("알려 주세요"), F.lit("안내")), F.lit("궁금합니다"), F.lit("안내")), "replace(replace(question, '알려 주세요', '안내'), '궁금합니다', '안내')", "train350_gold", "qid", "question")
_text_query("evidence_anchors", lambda c: F.array_join(F.slice(F.filter(F.split(c, r"(?<=다\.)\s"), lambda x: x.rlike("[0-9]+(%|일|원|회|세)")), 1, 40), "|"), "''")
del SQL["evidence_anchors"]


@query()
def header_dedup(s, d):
    return table(s, d, "elements").where("text is not null").select("element_id", F.regexp_replace("text", r"\[([^\]\n]+)\]\s*【\1】", "[$1]").alias("text"))


@query()
def str_nfc_ws_normalize(s, d):
    @F.pandas_udf(ST.StringType())
    def nfc(x: pd.Series) -> pd.Series:
        return x.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")

    c = F.regexp_replace(F.regexp_replace(nfc("text"), r"\r\n?", "\n"), r"[ \t]+", " ")
    return table(s, d, "documents").where("text is not null").select("doc_id", F.regexp_replace(c, r"\n{3,}", "\n\n").alias("text"))


@query("SELECT element_id, CASE WHEN tag LIKE '@el:%' THEN substr(tag, 5) ELSE tag END AS tag, list_has_any([CASE WHEN tag LIKE '@el:%' THEN substr(tag, 5) ELSE tag END], ['text', 'table']) AS matched FROM (SELECT element_id, lower(trim(schema_tag)) AS tag FROM element_semantic_fields_v4 WHERE schema_tag IS NOT NULL)")
def predicate_tag_match(s, d):
    t = F.regexp_replace(F.lower(F.trim("schema_tag")), "^@el:", "")
    return table(s, d, "element_semantic_fields_v4").where("schema_tag is not null").select("element_id", t.alias("tag"), t.isin("text", "table").alias("matched"))


# ---- scoring variants


@query(f"WITH {DOCS}, {QUESTIONS}, p AS (SELECT DISTINCT doc_id, unnest(tokens) AS term FROM d), t AS (SELECT DISTINCT query_id, unnest(tokens) AS term FROM q) SELECT query_id, count(DISTINCT term) AS terms, count(*) AS postings FROM t JOIN p USING (term) GROUP BY query_id")
def join_equi_postings(s, d):
    return lexical.query_terms(questions(s, d), 1).join(lexical.postings(corpus(s, d)), "term").groupBy("query_id").agg(F.count_distinct("term").alias("terms"), F.count("*").alias("postings"))


def _f(weights, bs, top):
    w = lambda m: "(CASE field " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in m.items()) + " END)"
    return f"""WITH {FIELDS}, {QUESTIONS}, qt AS (SELECT DISTINCT query_id, unnest(tokens) AS term FROM q), av AS (SELECT field, avg(len(tokens)) AS avgdl FROM fl GROUP BY field),
h AS (SELECT doc_id, field, term, len(any_value(tokens)) AS dl, count(*) AS tf FROM (SELECT doc_id, field, tokens, unnest(tokens) AS term FROM fl) GROUP BY doc_id, field, term),
x AS (SELECT doc_id, term, sum({w(weights)} * tf / (1 - {w(bs)} + {w(bs)} * dl / avgdl)) AS x FROM h JOIN av USING (field) GROUP BY doc_id, term),
f AS (SELECT term, count(*) AS df FROM x GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS n FROM fl),
s AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * x / (1.2 + x)), 6) AS score FROM x JOIN qt USING (term) JOIN f USING (term) CROSS JOIN n GROUP BY query_id, doc_id) """ + ranked_sql("SELECT * FROM s WHERE score > 0", top)


@query(_f({"title": 1.0, "text": 1.0}, {"title": 0.3, "text": 0.3}, 20))
def bm25f_rank_positive(s, d):
    return lexical.bm25f(doc_fields(s, d), questions(s, d), {"title": 1.0, "text": 1.0}, {"title": 0.3, "text": 0.3}, top=20)


@query(_f({"title": 0.0, "text": 1.0}, {"title": 0.2, "text": 0.75}, 10))
def bm25f_profile_weights(s, d):
    return lexical.bm25f(doc_fields(s, d), questions(s, d), {"title": 0.0, "text": 1.0}, {"title": 0.2, "text": 0.75})


@query(f"""WITH {FIELDS}, {QUESTIONS}, qt AS (SELECT DISTINCT query_id, unnest(tokens) AS term FROM q), h AS (SELECT DISTINCT doc_id, field, unnest(tokens) AS term FROM fl),
f AS (SELECT term, count(DISTINCT doc_id) AS df FROM h GROUP BY term), n AS (SELECT count(DISTINCT doc_id) AS n FROM fl),
m AS (SELECT query_id, doc_id, sum(ln(1 + n / df) * CASE field WHEN 'title' THEN 2.0 ELSE 1.0 END) AS base, count(DISTINCT field) AS fields FROM h JOIN qt USING (term) JOIN f USING (term) CROSS JOIN n GROUP BY query_id, doc_id) """ + ranked_sql("SELECT query_id, doc_id, round(base + 2 * (fields - 1), 6) AS score FROM m", 10))
def fielded_idf_regex(s, d):
    h = doc_fields(s, d).select("doc_id", "field", F.explode(F.array_distinct("tokens")).alias("term"))
    df = h.groupBy("term").agg(F.count_distinct("doc_id").alias("df"))
    n = doc_fields(s, d).agg(F.count_distinct("doc_id").alias("n"))
    x = h.join(lexical.query_terms(questions(s, d), 1), "term").join(df, "term").crossJoin(F.broadcast(n))  # one row
    m = x.groupBy("query_id", "doc_id").agg(F.sum(F.log(1 + F.col("n") / F.col("df")) * F.when(F.col("field") == "title", 2.0).otherwise(1.0)).alias("base"), F.count_distinct("field").alias("fields"))
    return lexical.ranked(m.select("query_id", "doc_id", F.round(F.col("base") + 2 * (F.col("fields") - 1), 6).alias("score")), 10)


_S = "WITH " + bm25_parts(DOCS, QUESTIONS, 1.5, 0.75, True, None)


def _scored(s, d):
    r = lexical.bm25(corpus(s, d), questions(s, d), top=None).drop("rank")
    return r.join(table(s, d, "documents").select("doc_id", "lang", "source"), "doc_id")


@query(_S + " " + ranked_sql("SELECT query_id, s.doc_id AS doc_id, score FROM s JOIN documents ON documents.doc_id = s.doc_id WHERE lang = 'ko'", 10))
def filter_scope_hard(s, d):
    return lexical.ranked(_scored(s, d).where("lang = 'ko'").select("query_id", "doc_id", "score"), 10)


@query(_S + " " + ranked_sql("SELECT query_id, s.doc_id AS doc_id, score * CASE WHEN source LIKE 'terms%' THEN 1.3::DOUBLE ELSE 1.0::DOUBLE END AS score FROM s JOIN documents ON documents.doc_id = s.doc_id", 10))
def boost_scope_multiplicative(s, d):
    return lexical.ranked(_scored(s, d).select("query_id", "doc_id", (F.col("score") * F.when(F.col("source").like("terms%"), 1.3).otherwise(1.0)).alias("score")), 10)


@query(_S + " " + ranked_sql("SELECT query_id, s.doc_id AS doc_id, round(score + CASE WHEN source LIKE 'terms%' THEN 2.0 ELSE 0.0 END, 6) AS score FROM s JOIN documents ON documents.doc_id = s.doc_id", 10))
def boost_scope_additive(s, d):
    return lexical.ranked(_scored(s, d).select("query_id", "doc_id", F.round(F.col("score") + F.when(F.col("source").like("terms%"), 2.0).otherwise(0.0), 6).alias("score")), 10)


_PLUG_D = f"d AS (SELECT doc_id, {_more('text')} AS tokens FROM documents WHERE text IS NOT NULL)"
_PLUG_Q = f"q AS (SELECT item_id AS query_id, {_more('question')} AS tokens FROM eval_items WHERE question IS NOT NULL)"


@query(bm25_sql(_PLUG_D, _PLUG_Q, 1.5, 0.75, True, 2, 10))
def plugin_tokenizer(s, d):
    return lexical.bm25(corpus(s, d, T.words_and_bigrams), questions(s, d, T.words_and_bigrams), cap=2)


_ROLES = "SELECT element_id, bool_or(r = 'payment_amount') AS amount, bool_or(r = 'payment_trigger') AS cause, bool_or(r = 'limit_frequency') AS often FROM (SELECT element_id, lower(trim(r)) AS r FROM (SELECT element_id, unnest(role) AS r FROM element_semantic_fields_v4) WHERE r IS NOT NULL) GROUP BY element_id"


def _slots(s, d):
    r = table(s, d, "element_semantic_fields_v4").select("element_id", F.explode("role").alias("x")).where("x is not null").select("element_id", F.lower(F.trim("x")).alias("r"))
    any_of = lambda v, n: F.bool_or(F.col("r") == v).alias(n)
    return r.groupBy("element_id").agg(any_of("payment_amount", "amount"), any_of("payment_trigger", "cause"), any_of("limit_frequency", "often"))


@query(_ROLES)
def slot_match_table(s, d):
    return _slots(s, d)


@query(f"SELECT element_id FROM ({_ROLES}) WHERE amount AND cause")
def clm_and_mode(s, d):
    return _slots(s, d).where("amount and cause").select("element_id")


@query(f"SELECT element_id, 2 * (amount::INT + cause::INT + often::INT) + greatest(amount::INT + cause::INT + often::INT - 1, 0) AS bonus FROM ({_ROLES})")
def axis_coordination_bonus(s, d):
    n = F.col("amount").cast("int") + F.col("cause").cast("int") + F.col("often").cast("int")
    return _slots(s, d).select("element_id", (2 * n + F.greatest(n - 1, F.lit(0))).alias("bonus"))


@query(f"SELECT element_id, CASE WHEN amount::INT + cause::INT >= 2 THEN 3 * (amount::INT + cause::INT) ELSE 0 END AS bonus FROM ({_ROLES})")
def evidence_role_bonus(s, d):
    n = F.col("amount").cast("int") + F.col("cause").cast("int")
    return _slots(s, d).select("element_id", F.when(n >= 2, 3 * n).otherwise(0).alias("bonus"))


_VAR = f"b AS (SELECT e.element_id, e.contract_scope, 2 * (amount::INT + cause::INT + often::INT) AS score FROM (SELECT DISTINCT element_id, contract_scope FROM elements WHERE contract_scope <> '') e JOIN ({_ROLES}) USING (element_id))"


@query(f"WITH {_VAR}, r AS (SELECT *, row_number() OVER (PARTITION BY score, contract_scope ORDER BY element_id) AS turn FROM b) SELECT element_id, score, turn, row_number() OVER (PARTITION BY score ORDER BY turn, contract_scope, element_id) AS place FROM r")
def clm_variant_round_robin(s, d):
    e = table(s, d, "elements").where("contract_scope <> ''").select("element_id", "contract_scope").distinct().join(_slots(s, d), "element_id")
    b = e.withColumn("score", 2 * (F.col("amount").cast("int") + F.col("cause").cast("int") + F.col("often").cast("int")))
    r = b.withColumn("turn", F.row_number().over(Window.partitionBy("score", "contract_scope").orderBy("element_id")))
    return r.select("element_id", "score", "turn", F.row_number().over(Window.partitionBy("score").orderBy("turn", "contract_scope", "element_id")).alias("place"))


# ---- fusion variants


@query(f"WITH {_two()}, c AS (SELECT query_id, source AS doc_id, list_no, row_number() OVER (PARTITION BY list_no, query_id ORDER BY min(rank)) AS rank FROM al JOIN documents ON documents.doc_id = al.doc_id GROUP BY query_id, source, list_no), f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 8) AS score, count(*) AS lists FROM c GROUP BY ALL) SELECT query_id, doc_id, score, lists, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f")
def rrf_collapse_before_fuse(s, d):
    src = table(s, d, "documents").select("doc_id", "source")
    units = {n: fusion.collapse(r.join(src, "doc_id"), F.col("source")).select("query_id", F.col("unit").alias("doc_id"), "rank") for n, r in two_rankings(s, d).items()}
    return fusion.rrf(units)


@query(f"""WITH {_two()}, u AS (SELECT r1.*, source AS unit FROM r1 JOIN documents USING (doc_id)), f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY query_id, unit ORDER BY rank) = 1 THEN 1 ELSE 0 END AS new FROM u),
k AS (SELECT *, sum(new) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS units FROM f),
x AS (SELECT query_id, doc_id, rank, CASE WHEN units < 3 OR (units - new < 3 AND new = 1) THEN 0 ELSE 2 END AS phase FROM k UNION ALL SELECT query_id, doc_id, rank, 1 FROM r2),
b AS (SELECT query_id, doc_id, min({{'p': phase, 'r': rank}}) AS seen FROM x GROUP BY ALL) SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY seen, doc_id) AS rank FROM b""")
def preserve_prefix(s, d):
    r = two_rankings(s, d)
    base = r["words"].join(table(s, d, "documents").select("doc_id", F.col("source").alias("unit")), "doc_id")
    return fusion.preserve_prefix(base, r["titles"], 3)


@query(f"WITH {_two()}, x AS (SELECT query_id, doc_id, 0 AS phase, rank FROM r1 WHERE rank <= 3 UNION ALL SELECT query_id, doc_id, 1, rank FROM r2 UNION ALL SELECT query_id, doc_id, 2, rank FROM r1 WHERE rank > 3), b AS (SELECT query_id, doc_id, min({{'p': phase, 'r': rank}}) AS seen FROM x GROUP BY ALL) SELECT * FROM (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY seen, doc_id) AS rank FROM b) WHERE rank <= 10")
def fallback_merge_lower_slots(s, d):
    r = two_rankings(s, d)
    rows = r["words"].select("query_id", "doc_id", F.when(F.col("rank") <= 3, 0).otherwise(2).alias("phase"), "rank").unionByName(r["titles"].select("query_id", "doc_id", F.lit(1).alias("phase"), "rank"))
    return _by_phase(rows, 10)


@query(f"WITH {_two()}, t AS (SELECT query_id, max(score) AS top FROM r1 GROUP BY query_id) SELECT query_id, doc_id, rank, 'titles' AS used FROM r2 JOIN t USING (query_id) WHERE top < 20 AND rank <= 5 UNION ALL SELECT query_id, doc_id, rank, 'words' FROM r1 JOIN t USING (query_id) WHERE top >= 20 AND rank <= 5")
def conditional_alias_rerank(s, d):
    r = two_rankings(s, d)
    top = r["words"].groupBy("query_id").agg(F.max("score").alias("top"))
    part = lambda n, ok: r[n].join(top, "query_id").where(ok).where("rank <= 5").select("query_id", "doc_id", "rank", F.lit(n).alias("used"))
    return part("titles", "top < 20").unionByName(part("words", "top >= 20"))


@query(f"""WITH {_two()}, f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 8) AS score FROM al GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f),
l AS (SELECT o.query_id, o.doc_id, rank, coalesce(length(text), 0) AS n FROM o JOIN documents USING (doc_id)), c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l) SELECT query_id, doc_id, rank, least(n, 4000 - before) AS chars FROM c WHERE before < 4000""")
def rag_pipeline(s, d):
    r = fusion.rrf(two_rankings(s, d)).join(table(s, d, "documents").select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n")), "doc_id")
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    return r.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).where("before < 4000").select("query_id", "doc_id", "rank", F.least(F.col("n").cast("long"), 4000 - F.col("before")).alias("chars"))


@query(f"WITH {_two()}, u AS (SELECT query_id, doc_id, min(rank) AS first FROM al GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, doc_id) AS place, count(*) OVER (PARTITION BY query_id) AS offered FROM u) SELECT query_id, doc_id, place, greatest(offered - 5, 0) AS rejected FROM n WHERE place <= 5")
def agent_workspace(s, d):
    u = fusion.stacked(two_rankings(s, d)).groupBy("query_id", "doc_id").agg(F.min("rank").alias("first"))
    w = Window.partitionBy("query_id")
    n = u.withColumn("place", F.row_number().over(w.orderBy("first", "doc_id"))).withColumn("offered", F.count("*").over(w))
    return n.where("place <= 5").select("query_id", "doc_id", "place", F.greatest(F.col("offered") - 5, F.lit(0)).alias("rejected"))


# ---- joins


@query("SELECT DISTINCT id, coalesce(e.document_key, c.document_key) AS unit FROM (SELECT DISTINCT element_id AS id FROM elements UNION SELECT unnest(submitted) FROM results) i LEFT JOIN (SELECT DISTINCT element_id, document_key FROM elements) e ON i.id = e.element_id LEFT JOIN (SELECT DISTINCT chunk_id, document_key FROM chunks) c ON i.id = c.chunk_id WHERE e.document_key IS NOT NULL OR c.document_key IS NOT NULL")
def join_resolve_mixed_ids(s, d):
    ids = table(s, d, "elements").select(F.col("element_id").alias("id")).unionByName(table(s, d, "results").select(F.explode("submitted").alias("id"))).distinct()
    e = table(s, d, "elements").select(F.col("element_id").alias("id"), F.col("document_key").alias("e")).distinct()
    c = table(s, d, "chunks").select(F.col("chunk_id").alias("id"), F.col("document_key").alias("c")).distinct()
    return ids.join(e, "id", "left").join(c, "id", "left").select("id", F.coalesce("e", "c").alias("unit")).where("unit is not null").distinct()


_REFS = "re AS (SELECT DISTINCT e.element_id, e.document_key, r FROM (SELECT element_id, unnest(reference) AS r FROM element_semantic_fields_v4) f JOIN elements e USING (element_id) WHERE r IS NOT NULL), he AS (SELECT DISTINCT document_key, element_id AS target, regexp_extract(title, '^제[0-9]+조(?:의[0-9]+)?') AS r FROM elements WHERE element_type = 'heading' AND regexp_matches(title, '^제[0-9]+조'))"


@query(f"WITH {_REFS}, j AS (SELECT element_id, target, row_number() OVER (PARTITION BY element_id ORDER BY target) AS n FROM (SELECT DISTINCT element_id, target FROM re JOIN he USING (document_key, r) WHERE element_id <> target)) SELECT element_id, target, n FROM j WHERE n <= 4")
def join_same_scope_refs(s, d):
    e = table(s, d, "elements")
    refs = table(s, d, "element_semantic_fields_v4").select("element_id", F.explode("reference").alias("r")).where("r is not null").join(e.select("element_id", "document_key").distinct(), "element_id").distinct()
    heads = e.where("element_type = 'heading'").where(F.col("title").rlike("^제[0-9]+조")).select("document_key", F.col("element_id").alias("target"), F.regexp_extract("title", "^(제[0-9]+조(?:의[0-9]+)?)", 1).alias("r")).distinct()
    j = refs.join(heads, ["document_key", "r"]).where("element_id != target").select("element_id", "target").distinct()
    return j.withColumn("n", F.row_number().over(Window.partitionBy("element_id").orderBy("target"))).where("n <= 4")


QUERIES["join_reference_follow"] = lambda s, d: QUERIES["join_reference_graph"](s, d).groupBy("source").agg(F.min("hops").alias("nearest"), F.count("*").alias("targets"))
SQL["join_reference_follow"] = f"SELECT source, min(hops) AS nearest, count(*) AS targets FROM ({SQL['join_reference_graph']}) GROUP BY source"


# ---- metrics


@query("WITH " + HITS + " SELECT query_id, " + ", ".join(f"count(*) FILTER (rank <= {k}) AS exposed{k}, CASE WHEN count(*) FILTER (rank <= {k}) = 0 THEN 'zero' WHEN count(*) FILTER (rank <= {k}) = any_value(n_gold) THEN 'full' ELSE 'partial' END AS split{k}" for k in (5, 10, 20)) + " FROM ht GROUP BY query_id")
def metric_exposure_at_k(s, d):
    from textloom.operators.metrics import hits

    r = runs(s, d)
    cols = []
    for k in (5, 10, 20):
        n = F.count_if(F.col("rank") <= k)
        cols += [n.alias(f"exposed{k}"), F.when(n == 0, "zero").when(n == F.first("n_gold"), "full").otherwise("partial").alias(f"split{k}")]
    return hits(submitted(r), judged(r)).groupBy("query_id").agg(*cols)


@query("WITH " + RUNS + ", cd AS (SELECT chunk_id AS doc_id, min(document_key) AS grp FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id), gg AS (SELECT query_id, doc_id, grp FROM gd JOIN cd USING (doc_id) WHERE grp IS NOT NULL), f AS (SELECT query_id, grp, min(rank) AS first FROM gg LEFT JOIN rk USING (query_id, doc_id) GROUP BY ALL) SELECT query_id, count(*) AS groups, round(count(*) FILTER (first <= 5) / count(*), 6) AS group_recall5, count(*) FILTER (first <= 5) = count(*) AS sufficient5 FROM f GROUP BY query_id")
def metric_group_recall(s, d):
    r = runs(s, d)
    home = table(s, d, "chunks").where("chunk_id is not null").groupBy(F.col("chunk_id").alias("doc_id")).agg(F.min("document_key").alias("grp")).where("grp is not null")
    first = judged(r).join(home, "doc_id").join(submitted(r), ["query_id", "doc_id"], "left").groupBy("query_id", "grp").agg(F.min("rank").alias("first"))
    n = F.count_if(F.col("first") <= 5)
    return first.groupBy("query_id").agg(F.count("*").alias("groups"), F.round(n / F.count("*"), 6).alias("group_recall5"), (n == F.count("*")).alias("sufficient5"))


@query("WITH " + HITS + ", m AS (SELECT split, rep % 2 AS arm, avg(su.r5) AS v FROM su JOIN k USING (query_id) WHERE rep IN (0, 1) GROUP BY ALL), p AS (SELECT max(v) FILTER (split = 'dev' AND arm = 0) AS d0, max(v) FILTER (split = 'dev' AND arm = 1) AS d1, max(v) FILTER (split = 'test' AND arm = 0) AS t0, max(v) FILTER (split = 'test' AND arm = 1) AS t1 FROM m) SELECT round(((t0 + t1) - (d0 + d1)) / 2, 5) AS split_effect, round(((d1 + t1) - (d0 + t0)) / 2, 5) AS rep_effect, round((t1 - t0) - (d1 - d0), 5) AS interaction FROM p")
def metric_factorial_effects(s, d):
    x = suite(s, d).select("query_id", "r5").join(runs(s, d).select("query_id", "split", "rep"), "query_id").where("rep in (0, 1)")
    m = x.groupBy("split", (F.col("rep") % 2).alias("arm")).agg(F.avg("r5").alias("v"))
    at = lambda sp, a, n: F.max(F.when((F.col("split") == sp) & (F.col("arm") == a), F.col("v"))).alias(n)
    p = m.agg(at("dev", 0, "d0"), at("dev", 1, "d1"), at("test", 0, "t0"), at("test", 1, "t1"))
    return p.selectExpr("round(((t0 + t1) - (d0 + d1)) / 2, 5) as split_effect", "round(((d1 + t1) - (d0 + t0)) / 2, 5) as rep_effect", "round((t1 - t0) - (d1 - d0), 5) as interaction")


@query("WITH " + PAIRS + " SELECT avg(a - b) > -0.05 AS not_worse, count(*) FILTER (a >= b) >= 0.5 * count(*) AS mostly, count(*) >= 10 AS enough, avg(a - b) > -0.05 AND count(*) FILTER (a >= b) >= 0.5 * count(*) AND count(*) >= 10 AS accepted FROM pr")
def metric_acceptance_rule(s, d):
    p = pairs(s, d).agg((F.avg(F.col("a") - F.col("b")) > -0.05).alias("not_worse"), (F.count_if(F.col("a") >= F.col("b")) >= 0.5 * F.count("*")).alias("mostly"), (F.count("*") >= 10).alias("enough"))
    return p.withColumn("accepted", F.col("not_worse") & F.col("mostly") & F.col("enough"))


@query("WITH " + HITS + " SELECT query_id, su.r5 AS recall, len(submitted) AS pulls, round(CASE WHEN coalesce(len(submitted), 0) = 0 THEN 0.0 ELSE su.r5 / len(submitted) END, 6) AS efficiency FROM su JOIN k USING (query_id)")
def metric_efficiency(s, d):
    n = F.when(F.col("submitted").isNotNull(), F.size("submitted"))
    x = suite(s, d).select("query_id", F.col("r5").alias("recall")).join(runs(s, d).select("query_id", n.alias("pulls")), "query_id")
    return x.withColumn("efficiency", F.round(F.when(F.coalesce("pulls", F.lit(0)) == 0, 0.0).otherwise(F.col("recall") / F.col("pulls")), 6))


_CAUSE = "CASE WHEN NOT known THEN 'unknown_gold' WHEN failed THEN 'run_failed' WHEN rank IS NULL THEN 'not_retrieved' WHEN rank > 5 THEN 'rank_only' ELSE 'hit' END"


@query("WITH " + RUNS + f", x AS (SELECT gd.query_id, rk.rank, gd.doc_id IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL) AS known, (error <> 0 OR submitted IS NULL) AS failed FROM gd JOIN k USING (query_id) LEFT JOIN rk USING (query_id, doc_id)) SELECT {_CAUSE} AS cause, count(*) AS n FROM x GROUP BY 1")
def metric_failure_cause(s, d):
    r = runs(s, d)
    known = table(s, d, "chunks").where("chunk_id is not null").select(F.col("chunk_id").alias("doc_id"), F.lit(True).alias("known")).distinct()
    x = judged(r).join(known, "doc_id", "left").join(submitted(r), ["query_id", "doc_id"], "left").join(r.select("query_id", ((F.col("error") != 0) | F.col("submitted").isNull()).alias("failed")), "query_id")
    cause = F.when(F.col("known").isNull(), "unknown_gold").when(F.col("failed"), "run_failed").when(F.col("rank").isNull(), "not_retrieved").when(F.col("rank") > 5, "rank_only").otherwise("hit")
    return x.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))


@query("WITH " + HITS + " SELECT su.query_id, n_gold, su.r5, su.ndcg10, len(submitted) AS returned FROM su JOIN ng USING (query_id) JOIN k USING (query_id)")
def metric_evaluate_query(s, d):
    r = runs(s, d)
    n = judged(r).groupBy("query_id").agg(F.count("*").alias("n_gold"))
    return suite(s, d).select("query_id", "r5", "ndcg10").join(n, "query_id").join(r.select("query_id", F.when(F.col("submitted").isNotNull(), F.size("submitted")).alias("returned")), "query_id")


# ---- windows, units and checks

_LN = "l AS (SELECT doc_id, line, no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents WHERE text IS NOT NULL))"


def _lines(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("no", F.col("no") + 1)


@query(rf"""WITH {_LN}, h AS (SELECT *, CASE WHEN regexp_matches(line, '^# ') THEN 1 WHEN regexp_matches(line, '^## ') THEN 2 END AS lv FROM l), g AS (SELECT *, count(*) FILTER (lv = 1) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS top FROM h)
SELECT doc_id, no, concat_ws(' > ', last_value(CASE WHEN lv = 1 THEN trim(substr(line, 3)) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING), last_value(CASE WHEN lv = 2 THEN trim(substr(line, 4)) END IGNORE NULLS) OVER (PARTITION BY doc_id, top ORDER BY no ROWS UNBOUNDED PRECEDING)) AS path FROM g""")
def win_running_breadcrumb(s, d):
    w = Window.partitionBy("doc_id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    h = _lines(s, d).withColumn("one", F.when(F.col("line").rlike("^# "), F.trim(F.substring("line", 3, 1 << 30)))).withColumn("two", F.when(F.col("line").rlike("^## "), F.trim(F.substring("line", 4, 1 << 30))))
    g = h.withColumn("top", F.count("one").over(w)).withColumn("a", F.last("one", ignorenulls=True).over(w))
    inner = Window.partitionBy("doc_id", "top").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    return g.select("doc_id", "no", F.concat_ws(" > ", "a", F.last("two", ignorenulls=True).over(inner)).alias("path"))


@query(rf"WITH {_LN}, t AS (SELECT *, starts_with(line, '|') AS tab FROM l), b AS (SELECT *, CASE WHEN tab IS NOT DISTINCT FROM lag(tab) OVER (PARTITION BY doc_id ORDER BY no) THEN 0 ELSE 1 END AS step FROM t), g AS (SELECT *, sum(step) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS block FROM b) SELECT doc_id, block, bool_or(tab) AS is_table, min(no) AS first_line, max(no) AS last_line FROM g GROUP BY doc_id, block")
def split_elements_lines(s, d):
    w = Window.partitionBy("doc_id").orderBy("no")
    t = _lines(s, d).withColumn("tab", F.startswith("line", F.lit("|"))).withColumn("step", F.when(F.equal_null(F.col("tab"), F.lag("tab").over(w)), 0).otherwise(1))
    g = t.withColumn("block", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("doc_id", "block").agg(F.bool_or("tab").alias("is_table"), F.min("no").alias("first_line"), F.max("no").alias("last_line"))


@query(rf"WITH {_LN}, a AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#* ?제[0-9]+조') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY no ROWS UNBOUNDED PRECEDING) AS unit FROM l) SELECT doc_id, unit, max(CASE WHEN regexp_matches(line, '^#* ?제[0-9]+조') THEN regexp_extract(line, '제[0-9]+조(?:의[0-9]+)?') END) AS article, count(*) AS n_lines FROM a GROUP BY doc_id, unit")
def segment_units_articles(s, d):
    head = F.col("line").rlike("^#* ?제[0-9]+조")
    w = Window.partitionBy("doc_id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    a = _lines(s, d).withColumn("unit", F.sum(head.cast("int")).over(w))
    return a.groupBy("doc_id", "unit").agg(F.max(F.when(head, F.regexp_extract("line", "(제[0-9]+조(?:의[0-9]+)?)", 1))).alias("article"), F.count("*").alias("n_lines"))


@query("SELECT chunk_id FROM (SELECT DISTINCT chunk_id FROM chunks c WHERE chunk_id IS NOT NULL AND chunk_id NOT IN (SELECT c FROM (SELECT unnest(gold_chunk_ids) AS c FROM train350_gold) WHERE c IS NOT NULL)) ORDER BY sha256('5|' || chunk_id) LIMIT 30")
def sample_pilot_distractors(s, d):
    c = table(s, d, "chunks").where("chunk_id is not null").select("chunk_id").distinct()
    return c.join(train_gold(s, d).select(F.col("c").alias("chunk_id")), "chunk_id", "left_anti").orderBy(F.sha2(F.concat(F.lit("5|"), "chunk_id"), 256)).limit(30)


SQL["sample_pilot_distractors"] = SQL["sample_pilot_distractors"].replace("FROM train350_gold) WHERE c IS NOT NULL", "FROM train350_gold WHERE qid IS NOT NULL) WHERE c IS NOT NULL")


@query("SELECT e.element_id, count(*) AS names, count(*) FILTER (contains(e.text, v)) AS grounded FROM (SELECT DISTINCT element_id, text FROM elements WHERE text IS NOT NULL) e JOIN (SELECT DISTINCT element_id, trim(v) AS v FROM (SELECT element_id, unnest(subject_key) AS v FROM element_semantic_fields_v4) WHERE v IS NOT NULL AND trim(v) <> '') f USING (element_id) GROUP BY e.element_id")
def content_grounding_verify(s, d):
    e = table(s, d, "elements").where("text is not null").select("element_id", "text").distinct()
    f = table(s, d, "element_semantic_fields_v4").select("element_id", F.explode("subject_key").alias("v")).where("v is not null").select("element_id", F.trim("v").alias("v")).where("v != ''").distinct()
    return e.join(f, "element_id").groupBy("element_id").agg(F.count("*").alias("names"), F.count_if(F.contains("text", "v")).alias("grounded"))


@query("""SELECT 'gold_in_corpus' AS contract, count(*) AS broken FROM (""" + SQL["join_anti_missing"] + """) UNION ALL SELECT 'unique_documents', count(*) FROM (SELECT doc_id FROM documents GROUP BY doc_id HAVING count(*) > 1)
UNION ALL SELECT 'targets_sum', CASE WHEN abs(sum(target_share) - 1) > 0.02 THEN 1 ELSE 0 END FROM mix_targets UNION ALL SELECT 'tags_have_elements', count(*) FROM (SELECT DISTINCT element_id FROM element_semantic_fields_v4) t WHERE NOT EXISTS (SELECT 1 FROM elements e WHERE e.element_id = t.element_id)""")
def contract_preflight(s, d):
    one = lambda df, n: df.agg(F.count("*").alias("broken")).select(F.lit(n).alias("contract"), "broken")
    out = one(QUERIES["join_anti_missing"](s, d), "gold_in_corpus").unionByName(one(table(s, d, "documents").groupBy("doc_id").count().where("count > 1"), "unique_documents"))
    out = out.unionByName(table(s, d, "mix_targets").agg(F.when(F.abs(F.sum("target_share") - 1) > 0.02, 1).otherwise(0).cast("long").alias("broken")).select(F.lit("targets_sum").alias("contract"), "broken"))
    tags = table(s, d, "element_semantic_fields_v4").select("element_id").distinct().join(table(s, d, "elements").select("element_id"), "element_id", "left_anti")
    return out.unionByName(one(tags, "tags_have_elements"))


@query("SELECT count(*) AS n, CAST(sum(('0x' || left(sha256(CAST(vec_id AS VARCHAR) || '|' || array_to_string(list_transform(embedding, lambda x: CAST(round(x * 1000) AS BIGINT)), ',')), 12))::BIGINT) AS DECIMAL(38, 0))::VARCHAR AS cache_key FROM embeddings")
def vector_cache_key(s, d):
    body = F.array_join(F.transform("embedding", lambda x: F.round(x.cast("double") * 1000).cast("long").cast("string")), ",")
    h = F.conv(F.substring(F.sha2(F.concat(F.col("vec_id").cast("string"), F.lit("|"), body), 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return table(s, d, "embeddings").agg(F.count("*").alias("n"), F.sum(h).cast("string").alias("cache_key"))


SQL["vector_cache_key"] = SQL["vector_cache_key"].replace("round(x * 1000)", "round(x::DOUBLE * 1000)")


@query("SELECT CASE WHEN source LIKE 'terms%' THEN 'terms' ELSE 'other' END AS arm, count(*) AS documents, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def corpus_materialize(s, d):
    return table(s, d, "documents").groupBy(F.when(F.col("source").like("terms%"), "terms").otherwise("other").alias("arm")).agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources"))


@query("SELECT qid, min(question) AS question, count(DISTINCT question) AS versions FROM train350_gold WHERE qid IS NOT NULL GROUP BY qid")
def gold_ledger_apply(s, d):
    return table(s, d, "train350_gold").where("qid is not null").groupBy("qid").agg(F.min("question").alias("question"), F.count_distinct("question").alias("versions"))


_TAGS = "SELECT element_id, schema_tag || ':' || coalesce(nullif(trim(contract_key), ''), '-') AS s1, concat_ws('/', schema_tag, nullif(trim(contract_key), ''), array_to_string(list_slice(list_filter(role, lambda x: x IS NOT NULL AND trim(x) <> ''), 1, 2), '+')) AS s2 FROM element_semantic_fields_v4 WHERE schema_tag IS NOT NULL"


@query(_TAGS)
def tag_schema_variants(s, d):
    key = F.nullif(F.trim("contract_key"), F.lit(""))
    roles = F.array_join(F.slice(F.filter("role", lambda x: x.isNotNull() & (F.trim(x) != "")), 1, 2), "+")
    return table(s, d, "element_semantic_fields_v4").where("schema_tag is not null").select("element_id", F.concat("schema_tag", F.lit(":"), F.coalesce(key, F.lit("-"))).alias("s1"), F.concat_ws("/", "schema_tag", key, roles).alias("s2"))


@query()
def str_lcs_length(s, d):
    """Longest common substring of a training question with the next one by id, in batches."""
    @F.pandas_udf(ST.IntegerType())
    def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([SequenceMatcher(None, x or "", y or "", False).find_longest_match(0, len(x or ""), 0, len(y or "")).size for x, y in zip(a, b, strict=True)])

    t = table(s, d, "train350_gold").where("question is not null").groupBy("qid", "business_type").agg(F.min("question").alias("question"))
    w = Window.partitionBy("business_type").orderBy("qid")
    return t.withColumn("next", F.lead("question").over(w)).where("next is not null").select("qid", lcs("question", "next").alias("length"))


@query()
def str_sequence_ratio(s, d):
    @F.pandas_udf(ST.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        from difflib import SequenceMatcher

        return pd.Series([round(SequenceMatcher(None, x, y, False).ratio(), 6) for x, y in zip(a, b, strict=True)])

    t = table(s, d, "train350_gold").where("question is not null").groupBy("qid", "business_type").agg(F.min("question").alias("question"))
    w = Window.partitionBy("business_type").orderBy("qid")
    pairs_ = t.withColumn("next", F.lead("question").over(w)).where("next is not null")
    digits = lambda c: F.array_join(F.regexp_extract_all(c, F.lit("([0-9]+)"), F.lit(1)), ",")
    r = ratio("question", "next")
    return pairs_.select("qid", r.alias("ratio"), ((r >= 0.94) & (digits("question") == digits("next"))).alias("conflict"))
