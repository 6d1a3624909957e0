"""Fusing, re-ordering and diversifying rankings ``query_id, doc_id, rank`` (and ``score``)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.lexical import ranked


def stacked(channels: Mapping[str, DataFrame]) -> DataFrame:
    """All channels as rows with ``channel`` and its number ``list_no``."""
    out = None
    for i, (name, r) in enumerate(channels.items()):
        score = F.col("score") if "score" in r.columns else F.lit(None).cast("double")
        rows = r.select("query_id", "doc_id", "rank", score.alias("score"), F.lit(name).alias("channel"), F.lit(i).alias("list_no"))
        out = rows if out is None else out.unionByName(rows)
    return out


def rrf(channels: Mapping[str, DataFrame], k: int = 60, weights: Mapping[str, float] | None = None, top: int | None = None, first_seen: bool = False) -> DataFrame:
    """Sum of weight / (k + rank); ties by id, or with ``first_seen`` by the earliest (list, rank)."""
    w = F.lit(1.0)
    for name, v in (weights or {}).items():
        w = F.when(F.col("channel") == name, v).otherwise(w)
    s = stacked(channels).groupBy("query_id", "doc_id").agg(F.round(F.sum(w / (k + F.col("rank"))), 8).alias("score"), F.min(F.struct("list_no", "rank")).alias("seen"), F.count("*").alias("lists"))
    tie = ["seen"] if first_seen else []
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *tie, "doc_id")
    out = s.withColumn("rank", F.row_number().over(order)).drop("seen")
    return out if top is None else out.where(F.col("rank") <= top)


def normalized(ranking: DataFrame, mode: str) -> DataFrame:
    """``value`` of each score within its query: 'max', 'minmax', 'zscore' (population) or 'rank'; no range gives 1 as divisor."""
    w = Window.partitionBy("query_id")
    s = F.col("score")
    some = lambda c: F.when(c == 0, 1.0).otherwise(c)
    value: Column
    match mode:
        case "max":
            value = s / some(F.max(s).over(w))
        case "minmax":
            value = (s - F.min(s).over(w)) / some(F.max(s).over(w) - F.min(s).over(w))
        case "zscore":
            value = (s - F.avg(s).over(w)) / some(F.stddev_pop(s).over(w))
        case "rank":
            value = 1 / F.col("rank")
        case _:
            raise ValueError(f"unknown mode {mode}")
    return ranking.withColumn("value", value)


def score_fusion(channels: Mapping[str, DataFrame], weights: Mapping[str, float], mode: str, top: int = 10) -> DataFrame:
    parts = {n: normalized(r, mode).withColumn("score", F.col("value") * float(weights[n])) for n, r in channels.items()}
    s = stacked(parts).groupBy("query_id", "doc_id").agg(F.round(F.sum("score"), 6).alias("score"))
    return ranked(s, top)


def collapse(ranking: DataFrame, unit: Column) -> DataFrame:
    """The first item of each unit, re-ranked; ``variants`` counts the items it stands for."""
    x = ranking.withColumn("unit", unit)
    best = x.groupBy("query_id", "unit").agg(F.min("rank").alias("best"), F.min_by("doc_id", "rank").alias("doc_id"), F.count("*").alias("variants"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("best"))).drop("best")


def rerank_head(ranking: DataFrame, second: DataFrame, head: int) -> DataFrame:
    """The first ``head`` by the second score (missing last), the tail as it was."""
    x = ranking.select("query_id", "doc_id", "rank").join(second.select("query_id", "doc_id", F.col("score").alias("again")), ["query_id", "doc_id"], "left")
    inside = F.col("rank") <= head
    order = Window.partitionBy("query_id").orderBy(F.when(inside, 0).otherwise(1), F.when(inside, F.col("again")).desc_nulls_last(), "rank")
    return x.withColumn("new_rank", F.row_number().over(order)).select("query_id", "doc_id", F.col("rank").alias("old_rank"), F.col("new_rank").alias("rank"))


def verified_first(ranking: DataFrame, passed: Column, depth: int) -> DataFrame:
    """Stable partition of the first ``depth``: those that pass come first; if none does, nothing moves."""
    inside = F.col("rank") <= depth
    order = Window.partitionBy("query_id").orderBy(F.when(inside, 0).otherwise(1), F.when(inside & passed, 0).otherwise(1), "rank")
    return ranking.withColumn("new_rank", F.row_number().over(order))


def preserve_prefix(baseline: DataFrame, challenger: DataFrame, n_units: int) -> DataFrame:
    """The baseline's prefix that reaches ``n_units`` units (column ``unit``), then the challenger, then the rest."""
    w = Window.partitionBy("query_id").orderBy("rank")
    first = baseline.withColumn("new", (F.row_number().over(Window.partitionBy("query_id", "unit").orderBy("rank")) == 1).cast("int"))
    seen = first.withColumn("units", F.sum("new").over(w)).withColumn("before", F.col("units") - F.col("new"))
    kept = seen.withColumn("phase", F.when((F.col("units") < n_units) | ((F.col("before") < n_units) & (F.col("new") == 1)), 0).otherwise(2)).select("query_id", "doc_id", "rank", "phase")
    rows = kept.unionByName(challenger.select("query_id", "doc_id", "rank", F.lit(1).alias("phase")))
    best = rows.groupBy("query_id", "doc_id").agg(F.min(F.struct("phase", "rank")).alias("at"))
    return best.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "doc_id")).alias("rank"))


def round_robin(lists: Mapping[str, DataFrame], seed: DataFrame, quota: int, top: int) -> DataFrame:
    """The seed's first ``quota``, then the lists' items in turn, then the seed's tail; each item once."""
    s = seed.select("query_id", "doc_id", F.when(F.col("rank") <= quota, 0).otherwise(2).alias("phase"), "rank", F.lit(-1).alias("list_no"))
    x = stacked(lists).select("query_id", "doc_id", F.lit(1).alias("phase"), "rank", "list_no")
    best = s.unionByName(x).groupBy("query_id", "doc_id").agg(F.min(F.struct("phase", "rank", "list_no")).alias("at"))
    out = best.select("query_id", "doc_id", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "doc_id")).alias("rank"))
    return out.where(F.col("rank") <= top)


def page(ranking: DataFrame, number: int, size: int) -> DataFrame:
    return ranking.where(F.col("rank").between((number - 1) * size + 1, number * size))
