"""Lexical scoring over token columns: an inverted index as rows, and rankings as joins with it.

Only postings of query terms are kept and scored; corpus statistics are one-row frames. Scores are rounded to six
digits before ranks are given, so that ties do not depend on the order of a sum; ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.scoring import top_scores


def ranked(scores: DataFrame, top: int | None = None, query: str = "query_id", item: str = "doc_id") -> DataFrame:
    """``scores`` with a 1-based ``rank`` by (score descending, item); at most ``top`` a query."""
    w = Window.partitionBy(query).orderBy(F.col("score").desc(), item)
    out = scores.withColumn("rank", F.row_number().over(w))
    return out if top is None else out.where(F.col("rank") <= top)


def postings(docs: DataFrame) -> DataFrame:
    """``doc_id, term, tf`` of documents with a ``tokens`` array."""
    return docs.select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    return postings(docs).groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: documents ``n`` and mean length ``avgdl`` (1.0 for an empty corpus)."""
    return docs.agg(F.count("*").alias("n"), F.coalesce(F.nullif(F.avg(F.size("tokens")), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))


def query_terms(queries: DataFrame, cap: int | None = None) -> DataFrame:
    """``query_id, term, qtf``; ``cap`` limits the counted repeats (1: distinct terms)."""
    q = queries.select("query_id", F.explode("tokens").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    return q if cap is None else q.withColumn("qtf", F.least("qtf", F.lit(cap)))


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, boost: bool = True, cap: int | None = None, top: int | None = 10) -> DataFrame:
    """``query_id, doc_id, score, rank`` of matching documents. ``boost``: factor k1 + 1 in the numerator.

    With ``top`` the queries are held against batches of documents (``scoring``); without, every matching pair is a
    row, made by joins of postings.
    """
    if top is not None:
        return ranked(top_scores(docs, queries, k1, b, boost, cap, top), top)
    q = query_terms(queries, cap)
    hits = docs.select("doc_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(q.select("term").distinct(), "term", "left_semi")
    hits = hits.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    rows = hits.join(df, "term").join(q, "term").crossJoin(F.broadcast(corpus_stats(docs)))  # one row
    tf = F.col("tf") * ((k1 + 1) if boost else 1.0) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scores = rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("qtf") * idf(F.col("n"), F.col("df")) * tf), 6).alias("score"))
    return ranked(scores)


def bm25_all_candidates(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75, top: int = 10) -> DataFrame:
    """Distinct query terms; documents without a match follow with score 0, in order of their ids, up to ``top``.

    Only queries with fewer than ``top`` matches are filled, and at most ``top`` of the 2 * top smallest ids match.
    """
    hit = bm25(docs, queries, k1, b, boost=True, cap=1, top=top).drop("rank")
    first = Window.partitionBy("query_id").orderBy("doc_id")
    lowest = docs.select("doc_id").orderBy("doc_id").limit(2 * top)
    few = queries.select("query_id").distinct().join(hit.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < top)
    fill = few.select("query_id").crossJoin(F.broadcast(lowest))  # 2 * top rows
    fill = fill.join(hit, ["query_id", "doc_id"], "left_anti").withColumn("i", F.row_number().over(first)).where(F.col("i") <= top)
    return ranked(hit.unionByName(fill.select("query_id", "doc_id", F.lit(0.0).alias("score"))), top)


def bm25f(fields: DataFrame, queries: DataFrame, weights: Mapping[str, float], bs: Mapping[str, float], k1: float = 1.2, top: int = 10) -> DataFrame:
    """Field-weighted BM25 of ``doc_id, field, tokens``: length-normalised frequencies are summed over the fields
    before they saturate, x / (k1 + x); document frequencies count the union of fields; query terms are distinct."""
    q = query_terms(queries, 1)
    lengths = fields.groupBy("field").agg(F.coalesce(F.nullif(F.avg(F.size("tokens")), F.lit(0.0)), F.lit(1.0)).alias("avgdl"))
    setup = F.create_map(*[x for f in weights for x in (F.lit(f), F.struct(F.lit(float(weights[f])).alias("w"), F.lit(float(bs[f])).alias("b")))])
    hits = fields.select("doc_id", "field", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).join(q.select("term").distinct(), "term", "left_semi")
    hits = hits.groupBy("doc_id", "field", "dl", "term").agg(F.count("*").alias("tf")).join(F.broadcast(lengths), "field")  # a row a field
    hits = hits.withColumn("s", setup[F.col("field")])
    x = F.sum(F.col("s.w") * F.col("tf") / (1 - F.col("s.b") + F.col("s.b") * F.col("dl") / F.col("avgdl"))).alias("x")
    per_term = hits.groupBy("doc_id", "term").agg(x)
    df = per_term.groupBy("term").agg(F.count("*").alias("df"))
    n = fields.agg(F.count_distinct("doc_id").alias("n"))
    rows = per_term.join(df, "term").join(q, "term").crossJoin(F.broadcast(n))  # one row
    score = F.round(F.sum(idf(F.col("n"), F.col("df")) * F.col("x") / (k1 + F.col("x"))), 6).alias("score")
    return ranked(rows.groupBy("query_id", "doc_id").agg(score).where("score > 0"), top)


def coordination(docs: DataFrame, queries: DataFrame, top: int = 10) -> DataFrame:
    """Score: share of the query's distinct terms that the document holds."""
    q = query_terms(queries, 1)
    n = q.groupBy("query_id").agg(F.count("*").alias("terms"))
    hits = docs.select("doc_id", F.explode(F.array_distinct("tokens")).alias("term")).join(q, "term")
    scores = hits.groupBy("query_id", "doc_id").agg(F.count("*").alias("m")).join(n, "query_id")
    return ranked(scores.select("query_id", "doc_id", F.round(F.col("m") / F.col("terms"), 6).alias("score")), top)


def best_unit(units: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.7, top: int = 10) -> DataFrame:
    """Units ``doc_id, unit, tokens`` are scored one by one; a document has the score of its best unit."""
    keyed = units.select(F.struct("doc_id", "unit").alias("doc_id"), "tokens")
    s = bm25(keyed, queries, k1, b, cap=1, top=None)
    return ranked(s.groupBy("query_id", F.col("doc_id.doc_id").alias("doc_id")).agg(F.max("score").alias("score")), top)


def max_field_idf(fields: DataFrame, queries: DataFrame, weights: Mapping[str, float], top: int = 10) -> DataFrame:
    """Sum over distinct query terms of ln(1 + N/df) times the greatest weight among the fields holding the term."""
    q = query_terms(queries, 1)
    w = F.create_map(*[x for f, v in weights.items() for x in (F.lit(f), F.lit(float(v)))])
    held = fields.select("doc_id", w[F.col("field")].alias("w"), F.explode(F.array_distinct("tokens")).alias("term")).join(q.select("term").distinct(), "term", "left_semi")
    held = held.groupBy("doc_id", "term").agg(F.max("w").alias("w"))
    df = held.groupBy("term").agg(F.count("*").alias("df"))
    n = fields.agg(F.count_distinct("doc_id").alias("n"))
    rows = held.join(df, "term").join(q, "term").crossJoin(F.broadcast(n))  # one row
    return ranked(rows.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * F.log(1 + F.col("n") / F.col("df"))), 6).alias("score")), top)


def expand_aliases(queries: DataFrame, groups: tuple[tuple[str, ...], ...]) -> DataFrame:
    """``text`` with the members of each synonym group it names added, those missing only."""
    out = F.col("text")
    for g in groups:
        named = F.exists(F.array(*[F.lit(x) for x in g]), lambda x: F.contains(F.col("text"), x))
        missing = F.filter(F.array(*[F.lit(x) for x in g]), lambda x: ~F.contains(F.col("text"), x))
        out = F.when(named & (F.size(missing) > 0), F.concat(out, F.lit(" "), F.array_join(missing, " "))).otherwise(out)
    return queries.withColumn("expanded", out)


def grep_lines(docs: DataFrame, pattern: str, most: int = 5, width: int = 200) -> DataFrame:
    """``doc_id, line_no, line`` of lines that match, case ignored: the first ``most`` a document, cut to ``width``.

    Both limits are the feature: what a reader is shown of a hit list.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.col("line").rlike("(?i)" + pattern))
    w = Window.partitionBy("doc_id").orderBy("line_no")
    return lines.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("doc_id", F.col("line_no") + 1, F.substring("line", 1, width)).toDF("doc_id", "line_no", "line")


def even_sample(hits: DataFrame, key: str, order: str, most: int = 20) -> DataFrame:
    """Where a key has more than ``most`` hits, those at positions ``int(i * n / most)``; else all."""
    w = Window.partitionBy(key)
    x = hits.withColumn("pos", F.row_number().over(w.orderBy(order)) - 1).withColumn("n", F.count("*").over(w))
    at = F.exists(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.floor(i * F.col("n") / most) == F.col("pos"))
    return x.where((F.col("n") <= most) | at).drop("pos", "n")


def snippet(text: Column, term: Column, before: int = 40, width: int = 120) -> Column:
    """White space made single blanks, from ``before`` characters ahead of the term's first occurrence."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    at = F.position(term, flat)
    return F.substring(flat, F.greatest(at - before, F.lit(1)), F.lit(width))
