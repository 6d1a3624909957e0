"""Queries that are sequential inside a text, a document or a ranking, and reads and writes of files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom import queries_checked  # noqa: F401  (its queries come first)
from textloom.operators import sequences as S
from textloom.plans.lineage import use_shared_checkpoints
from textloom.plans.shipping import ship_package
from textloom.queries import QUERIES, query, two_rankings
from textloom.sources import files
from textloom.sources.tables import table

# ---- splitters


def _split(name: str, source: str, key: str, cut) -> None:
    QUERIES[name] = lambda s, d: S.split_texts(table(s, d, source), key, "text", cut)


_split("chunk_recursive_600", "documents", "doc_id", lambda s: S.with_overlap(S.recursive_ranges(s)))
_split("chunk_article_mix_limit", "documents", "doc_id", lambda s: S.limit_heads(s, S.recursive_ranges(s)))
_split("split_elements_markdown", "documents", "doc_id", S.markdown_blocks)
_split("split_elements_sections", "documents", "doc_id", S.sections)
_split("split_structural_repair", "elements", "element_id", S.repaired)


@query()
def win_cumulative_pack(s, d):
    e = table(s, d, "elements").where("document_key is not null and text is not null and char_start is not null")
    one = e.groupBy("document_key", "element_id").agg(F.min(F.struct("char_start", "contract_scope", "element_type", F.char_length("text").alias("chars"))).alias("x"))
    return S.packed(one.select("document_key", F.coalesce("x.contract_scope", F.lit("")).alias("scope"), F.coalesce("x.element_type", F.lit("")).alias("kind"), F.col("x.char_start").alias("at"), "x.chars"))


@query()
def win_appendix_context(s, d):
    e = table(s, d, "elements").where("document_key is not null and line_start is not null and line_end is not null").dropDuplicates(["element_id"])
    label = F.nullif(F.regexp_extract(F.coalesce("title", "text", F.lit("")), r"(별표|부표)\s*[0-9]+", 0), F.lit(""))
    return S.labelled_tables(e.select("document_key", "element_id", F.col("element_type").alias("kind"), F.when(F.col("element_type") != "table", label).alias("label"), "line_start", "line_end"))


# ---- rankings


def _with_texts(s: SparkSession, d: str, r: DataFrame) -> DataFrame:
    docs = table(s, d, "documents").select("doc_id", "text", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("doc_type", F.lit("")).alias("doc_type"))
    asked = table(s, d, "eval_items").select(F.col("item_id").alias("query_id"), "question")
    return r.join(docs, "doc_id").join(asked, "query_id")


@query()
def near_dup_family_dedup(s, d):
    r = _with_texts(s, d, two_rankings(s, d)["words"].where("rank <= 20"))
    core = F.regexp_replace(F.concat_ws("|", "source", "title"), "[0-9]+", "")
    return S.reorder(r.select("query_id", "doc_id", "rank", "text", "question", core.alias("family")), S.family_last())


@query()
def near_dup_cover_top(s, d):
    r = _with_texts(s, d, two_rankings(s, d)["words"].where("rank <= 20"))
    return S.reorder(r.select("query_id", "doc_id", "rank", "text", "title", F.col("source").alias("base")), S.cover_top())


@query()
def quota_unique_unit(s, d):
    t = two_rankings(s, d)
    r = t["words"].withColumn("kind", F.lit(0)).unionByName(t["titles"].withColumn("kind", F.lit(1)))
    unit = F.concat_ws("|", F.col("source"), F.col("doc_type"))
    r = _with_texts(s, d, r).select("query_id", "doc_id", F.col("kind").alias("source"), F.col("rank").alias("place"), unit.alias("unit"))
    return S.reorder(r.withColumn("rank", F.col("place") * 2 + F.col("source")), S.quota((3, 3)))


@query("""WITH r AS (SELECT DISTINCT qid, c AS chunk_id, n FROM (SELECT qid, unnest(gold_chunk_ids) AS c, generate_subscripts(gold_chunk_ids, 1) AS n FROM train350_gold WHERE qid IS NOT NULL) WHERE c IS NOT NULL),
b AS (SELECT qid, chunk_id, min(n) AS place FROM r GROUP BY ALL), k AS (SELECT DISTINCT qid, unnest(content_labels) AS role FROM train350_gold WHERE qid IS NOT NULL),
x AS (SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY place, chunk_id) AS pos FROM b)
SELECT x.qid, chunk_id, pos AS before, row_number() OVER (PARTITION BY x.qid ORDER BY CASE WHEN pos <= 1 THEN 0 WHEN pos % 2 = 0 AND coalesce(m, 0) > 0 THEN 1 ELSE 2 END, pos) AS after FROM x LEFT JOIN (SELECT qid, count(*) AS m FROM k WHERE role IS NOT NULL GROUP BY qid) USING (qid)""")
def claim_role_injection(s, d):
    """The first stays, then every second candidate of a question that has roles, then the others; the page keeps its size."""
    t = table(s, d, "train350_gold").where("qid is not null")
    b = t.select("qid", F.posexplode("gold_chunk_ids").alias("n", "chunk_id")).where("chunk_id is not null").groupBy("qid", "chunk_id").agg(F.min("n").alias("at"))
    k = t.select("qid", F.explode("content_labels").alias("role")).where("role is not null").distinct().groupBy("qid").agg(F.count("*").alias("m"))
    w = Window.partitionBy("qid")
    x = b.withColumn("before", F.row_number().over(w.orderBy("at", "chunk_id"))).join(k, "qid", "left")
    phase = F.when(F.col("before") <= 1, 0).when((F.col("before") % 2 == 0) & (F.coalesce("m", F.lit(0)) > 0), 1).otherwise(2)
    return x.select("qid", "chunk_id", "before", F.row_number().over(w.orderBy(phase, "before")).alias("after"))


# ---- resampling


def _paired(s: SparkSession, d: str) -> DataFrame:
    r = table(s, d, "results").where("qid is not null and r5 is not null").groupBy("source", "split", "qid", "rep").agg(F.max("r5").alias("r5"))
    one = r.groupBy("source", "split", "qid").agg(F.max(F.when(F.col("rep") == 1, F.col("r5"))).alias("a"), F.max(F.when(F.col("rep") == 2, F.col("r5"))).alias("b"))
    return one.where("a is not null and b is not null and source is not null").select(F.col("source").alias("arm"), F.concat_ws("|", "split", "qid").alias("pair"), (F.col("b") - F.col("a")).alias("delta"))


@query()
def stat_bca(s, d):
    return S.intervals(_paired(s, d)).select("arm", "n", "mean", "bca_low", "bca_high")


@query()
def stat_bootstrap_paired_numpy(s, d):
    return S.intervals(_paired(s, d)).select("arm", "n", "mean", "low", "high")


# ---- files: written into the shared folder and read again


def _folder(s: SparkSession, name: str) -> str:
    use_shared_checkpoints(s)
    return f"{s.sparkContext._jsc.sc().getCheckpointDir().get()}/files-{uuid.uuid4().hex}/{name}"


@query("SELECT doc_id, text, source FROM documents")
def scan_jsonl(s, d):
    path = _folder(s, "documents.jsonl")
    files.write_jsonl(table(s, d, "documents").select("doc_id", "text", "source"), path)
    return files.read_jsonl(s, path, "doc_id long, text string, source string")


@query("SELECT count(*) AS lines, count(source) AS with_source FROM documents")
def sink_jsonl(s, d):
    path = _folder(s, "documents.jsonl")
    files.write_jsonl(table(s, d, "documents").select("doc_id", "source"), path)
    lines = s.read.text(path)
    return lines.agg(F.count("*").alias("lines"), F.count(F.get_json_object("value", "$.source")).alias("with_source"))


@query("SELECT item_id, question, passage FROM eval_items")
def scan_csv_qa(s, d):
    path = _folder(s, "items.csv")
    table(s, d, "eval_items").select("item_id", "question", "passage").write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    return files.read_qa_csv(s, path, "item_id long, question string, passage string")


@query("SELECT qid, count(*) AS n FROM (SELECT DISTINCT qid FROM results WHERE qid IS NOT NULL) GROUP BY qid")
def append_resume_sink(s, d):
    """Runs appended in two goes, the second with all of them: every question is there once."""
    path = _folder(s, "runs")
    r = table(s, d, "results").where("qid is not null").select("qid", "source")
    files.append_new(r.where("qid < 'test'"), path, "qid")
    files.append_new(r, path, "qid")
    return s.read.parquet(path).groupBy("qid").agg(F.count("*").alias("n"))


@query("SELECT source, target_share, max_repeats FROM mix_targets")
def sink_atomic_publish(s, d):
    path = _folder(s, "targets")
    t = table(s, d, "mix_targets").select("source", "target_share", "max_repeats")
    if not files.publish(t, path, "first") or files.publish(t, path, "first"):
        raise ValueError("published twice or not at all")
    return s.read.parquet(f"{path}/data")


@query("SELECT 'documents' AS name, 'doc_id,source' AS columns, count(*) AS rows, CAST(sum(('0x' || left(sha256(CAST(doc_id AS VARCHAR)), 12))::BIGINT) AS DECIMAL(38, 0))::VARCHAR AS checksum, '1' AS version FROM documents")
def sink_results_manifest(s, d):
    return files.manifest(table(s, d, "documents").select("doc_id", "source"), "documents", "doc_id", version="1")


@query("SELECT vec_id, len(embedding) AS dim, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm FROM embeddings")
def embedding_store(s, d):
    """Vectors kept as rows of their dimension and norm beside the values, written and read again."""
    path = _folder(s, "vectors")
    norm = F.sqrt(F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    table(s, d, "embeddings").select("vec_id", "embedding", F.size("embedding").alias("dim"), F.round(norm, 4).alias("norm")).write.parquet(path)
    return s.read.parquet(path).select("vec_id", "dim", "norm")


def _shipped(f):
    def g(s, d):
        ship_package(s)
        return f(s, d)

    return g


for _n in ("chunk_recursive_600", "chunk_article_mix_limit", "split_elements_markdown", "split_elements_sections", "split_structural_repair", "win_cumulative_pack", "win_appendix_context", "near_dup_family_dedup", "near_dup_cover_top", "quota_unique_unit", "stat_bca", "stat_bootstrap_paired_numpy"):
    QUERIES[_n] = _shipped(QUERIES[_n])


# ---- skeletons of texts that recur, views, balanced halves


def _versions(s: SparkSession, d: str) -> DataFrame:
    from textloom.operators import skeletons

    e = table(s, d, "elements").where("element_type = 'heading' or char_length(text) < 400")
    key = F.regexp_replace(F.regexp_replace("title", "[0-9]+", "0"), r"\s+", " ")
    return skeletons.induced(e.select("element_id", "text", key.alias("key")).where("key != ''"), "key", "element_id", "text")


@query()
def skeleton_induce(s, d):
    return _versions(s, d)


@query()
def skeleton_key_values(s, d):
    from textloom.operators import skeletons

    return skeletons.key_values(_versions(s, d))


@query("SELECT CASE WHEN source LIKE 'terms%' THEN 'terms' ELSE 'other' END AS arm, count(*) AS documents, count(DISTINCT source) AS sources FROM documents GROUP BY 1")
def corpus_materialize(s, d):
    """A folder for each arm, written apart and read apart, so that no arm can see another's documents."""
    docs = table(s, d, "documents").select("doc_id", "source", "text", F.when(F.col("source").like("terms%"), "terms").otherwise("other").alias("arm"))
    path = _folder(s, "arms")
    docs.write.partitionBy("arm").parquet(path)
    out = None
    for arm in ("terms", "other"):
        try:
            view = s.read.parquet(f"{path}/arm={arm}")
        except Exception as e:  # an arm without documents has no folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
            continue
        x = view.agg(F.count("*").alias("documents"), F.count_distinct("source").alias("sources")).select(F.lit(arm).alias("arm"), "documents", "sources")
        out = x if out is None else out.unionByName(x)
    return out if out is not None else s.createDataFrame([], "arm string, documents long, sources long")


@query(r"""WITH t AS (SELECT qid, min(regexp_replace(lower(question), '\s+', '', 'g')) AS g, min(coalesce(array_to_string(list_sort(content_labels), ','), '')) AS labels FROM train350_gold WHERE qid IS NOT NULL AND question IS NOT NULL GROUP BY qid),
u AS (SELECT g, min(labels) AS pattern FROM t GROUP BY g), n AS (SELECT pattern, count(*) AS n FROM u GROUP BY pattern), o AS (SELECT pattern, n, n // 2 + CASE WHEN n % 2 = 1 AND row_number() OVER (PARTITION BY n % 2 ORDER BY pattern) % 2 = 1 THEN 1 ELSE 0 END AS quota FROM n),
r AS (SELECT g, u.pattern, CASE WHEN row_number() OVER (PARTITION BY u.pattern ORDER BY sha256(g), g) <= quota THEN 'test' ELSE 'train' END AS part FROM u JOIN o USING (pattern)) SELECT qid, part FROM t JOIN r USING (g)""")
def split_balanced(s, d):
    """Halves with every set of labels split evenly (odd ones by turns); wordings of one question stay together."""
    q = table(s, d, "train350_gold").where("qid is not null and question is not null")
    t = q.groupBy("qid").agg(F.min(F.regexp_replace(F.lower("question"), r"\s+", "")).alias("g"), F.min(F.coalesce(F.array_join(F.array_sort("content_labels"), ","), F.lit(""))).alias("labels"))
    u = t.groupBy("g").agg(F.min("labels").alias("pattern"))
    n = u.groupBy("pattern").agg(F.count("*").alias("n"))
    turn = F.row_number().over(Window.partitionBy(F.col("n") % 2).orderBy("pattern")) % 2  # a row a set of labels
    o = n.select("pattern", (F.floor(F.col("n") / 2) + ((F.col("n") % 2 == 1) & (turn == 1)).cast("int")).alias("quota"))
    w = Window.partitionBy("pattern").orderBy(F.sha2("g", 256), "g")
    r = u.join(o, "pattern").select("g", F.when(F.row_number().over(w) <= F.col("quota"), "test").otherwise("train").alias("part"))
    return t.join(r, "g").select("qid", "part")
