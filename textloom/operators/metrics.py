"""Retrieval metrics over rankings ``query_id, doc_id, rank`` and judgments ``query_id, doc_id[, gain]``.

Queries without judgments leave the denominator; judged queries without results have 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hits(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """Judged queries with their hits: ``query_id, n_gold, rank`` (null if none)."""
    n = gold.select("query_id", "doc_id").distinct().groupBy("query_id").agg(F.count("*").alias("n_gold"))
    got = ranking.select("query_id", "doc_id", "rank").join(gold.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"])
    got = got.groupBy("query_id", "doc_id").agg(F.min("rank").alias("rank"))
    return n.join(got.select("query_id", "rank"), "query_id", "left")


def _mean(c: Column) -> Column:
    return F.round(c, 6)


def rank_suite(ranking: DataFrame, gold: DataFrame, cuts: Sequence[int] = (1, 5, 10)) -> DataFrame:
    """One row a query: first hit, reciprocal rank at 10, and hit, precision, recall and binary nDCG at the cuts."""
    h = hits(ranking, gold)
    cols = [F.min("rank").alias("first_rank"), _mean(F.coalesce(F.max(F.when(F.col("rank") <= 10, 1 / F.col("rank"))), F.lit(0.0))).alias("rr10")]
    for k in cuts:
        inside = F.col("rank") <= k
        n = F.count(F.when(inside, 1))
        best = F.aggregate(F.sequence(F.lit(1), F.least(F.first("n_gold"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
        gain = F.coalesce(F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1.0))), F.lit(0.0))
        cols += [F.least(n, F.lit(1)).alias(f"hit{k}"), _mean(n / k).alias(f"p{k}"), _mean(n / F.first("n_gold")).alias(f"r{k}"), _mean(gain / best).alias(f"ndcg{k}")]
    return h.groupBy("query_id").agg(*cols)


def ndcg_graded(ranking: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, ndcg``: linear gains over log2(rank + 1), the ideal from the sorted gains."""
    g = gold.groupBy("query_id", "doc_id").agg(F.max("gain").alias("gain"))
    w = Window.partitionBy("query_id").orderBy(F.col("gain").desc(), "doc_id")
    ideal = g.withColumn("i", F.row_number().over(w)).where(F.col("i") <= k).groupBy("query_id").agg(F.sum(F.col("gain") / F.log2(F.col("i") + 1.0)).alias("ideal"))
    got = ranking.where(F.col("rank") <= k).join(g, ["query_id", "doc_id"]).groupBy("query_id").agg(F.sum(F.col("gain") / F.log2(F.col("rank") + 1.0)).alias("got"))
    return ideal.join(got, "query_id", "left").select("query_id", F.round(F.coalesce("got", F.lit(0.0)) / F.nullif("ideal", F.lit(0.0)), 6).alias("ndcg"))


def grouped_means(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Means overall and by each key, in one pass; keys not grouped by are null."""
    sets = [[], *[[k] for k in keys]]
    return rows.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(F.count("*").alias("n"), *[F.round(F.avg(v), 6).alias(v) for v in values])


def char_budget_hits(ranking: DataFrame, gold: DataFrame, length: str, budget: int) -> DataFrame:
    """``query_id, recall`` over the first items whose text reaches ``budget`` characters, the crossing item included."""
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    shown = ranking.withColumn("before", F.coalesce(F.sum(length).over(w), F.lit(0))).where(F.col("before") < budget)
    n = gold.select("query_id", "doc_id").distinct()
    got = shown.join(n, ["query_id", "doc_id"]).groupBy("query_id").agg(F.count_distinct("doc_id").alias("got"))
    return n.groupBy("query_id").agg(F.count("*").alias("n")).join(got, "query_id", "left").select("query_id", F.round(F.coalesce("got", F.lit(0)) / F.col("n"), 6).alias("recall"))


def channel_oracle(a: DataFrame, b: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """How many judged queries are hit within ``k`` by both, one or neither ranking."""
    side = lambda r, n: hits(r, gold).groupBy("query_id").agg((F.count(F.when(F.col("rank") <= k, 1)) > 0).alias(n))
    x = side(a, "a").join(side(b, "b"), "query_id", "full_outer").fillna(False, ["a", "b"])
    kind = F.when(F.col("a") & F.col("b"), "both").when(F.col("a"), "first_only").when(F.col("b"), "second_only").otherwise("neither")
    return x.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
