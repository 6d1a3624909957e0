"""Joins of block keys that stay whole and spread out where one key is held by a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys are counted in so many hash buckets; at most an eighth of them can hold eight times the mean.
BUCKETS = 1 << 16
LIMIT = 50_000


def hot_buckets(rows: DataFrame, key: str, limit: int = LIMIT) -> list[tuple[int, int]]:
    """Buckets of ``key`` with more than ``limit`` rows and eight times the mean, with the parts to split them into.

    Rows are counted before they are moved; at most ``BUCKETS / 8`` buckets can be hot, so the list is bounded.
    """
    counts = rows.groupBy(_bucket(key).alias("bucket")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("t"))
    hot = counts.crossJoin(F.broadcast(total)).where((F.col("n") > limit) & (F.col("n") > 8 * F.col("t") / BUCKETS))  # one row
    return [(r.bucket, -(-r.n // limit) + 1) for r in hot.select("bucket", "n").collect()]


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def join_blocks(left: DataFrame, right: DataFrame, key: str, spread: str, hot: list[tuple[int, int]], condition: Column | None = None) -> DataFrame:
    """Inner join of ``left`` (alias a) and ``right`` (alias b) on ``key`` and ``condition``, all pairs kept.

    The rows of a hot key (``hot``: what ``hot_buckets`` says of the rows or of more rows) are split: each of the left
    ones goes to one part, by a hash of ``spread``, the right ones to all parts. Where nothing is hot there is a plain
    sort-merge join, and a join with itself moves its rows once. The result has the structs ``a`` and ``b``.
    """
    on = F.col(f"a.{key}") == F.col(f"b.{key}")
    on = on if condition is None else on & condition
    keep = [F.struct(*[F.col(f"{s}.{c}").alias(c) for c in d.columns]).alias(s) for s, d in (("a", left), ("b", right))]
    if not hot:
        return left.alias("a").hint("merge").join(right.alias("b").hint("merge"), on).select(*keep)
    few = F.broadcast(left.sparkSession.createDataFrame(hot, "hot_bucket int, hot_parts int"))  # at most BUCKETS / 8 rows
    l, r = (d.join(few, _bucket(key) == F.col("hot_bucket"), "left") for d in (left, right))
    cold = l.where("hot_parts is null").alias("a").hint("merge").join(r.where("hot_parts is null").alias("b").hint("merge"), on)
    a = l.where("hot_parts is not null").withColumn("part", F.pmod(F.xxhash64(spread), F.col("hot_parts")).cast("int"))
    b = r.where("hot_parts is not null").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("hot_parts") - 1)))
    warm = a.alias("a").hint("merge").join(b.alias("b").hint("merge"), on & (F.col("a.part") == F.col("b.part")))
    return cold.select(*keep).unionByName(warm.select(*keep))
