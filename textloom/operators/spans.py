"""Joins of intervals and as-of lookups, all on equi keys with bins or windows; never a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overlapping(units: DataFrame, spans: DataFrame, key: str = "doc", bin_size: int = 1024) -> DataFrame:
    """Spans ``key, span_id, c0, c1`` with every unit ``key, unit_id, u0, u1`` they overlap (half-open).

    Both sides are placed in bins of ``bin_size``; a pair is emitted in the bin where the later one begins only.
    """
    bins = lambda d, lo, hi: d.withColumn("bin", F.explode(F.sequence(F.floor(F.col(lo) / bin_size), F.floor((F.col(hi) - 1) / bin_size))))
    u = bins(units.where("u0 < u1 and u0 is not null"), "u0", "u1")
    s = bins(spans.where("c0 < c1 and c0 is not null"), "c0", "c1")
    hit = s.join(u, [key, "bin"]).where("u0 < c1 and u1 > c0").where(F.col("bin") == F.floor(F.greatest("u0", "c0") / bin_size))
    return hit.withColumn("overlap", F.least("u1", "c1") - F.greatest("u0", "c0")).drop("bin")


def smallest_containing(units: DataFrame, spans: DataFrame, key: str = "doc") -> DataFrame:
    """The smallest unit that contains the span, else every overlap clipped to the span."""
    o = overlapping(units, spans, key).withColumn("inside", (F.col("u0") <= F.col("c0")) & (F.col("u1") >= F.col("c1")))
    w = Window.partitionBy(key, "span_id")
    o = o.withColumn("any", F.max("inside").over(w)).withColumn("n", F.row_number().over(w.orderBy(F.col("inside").desc(), F.col("u1") - F.col("u0"), "u0", "unit_id")))
    o = o.where("(any and n = 1) or not any")
    return o.select(key, "span_id", "unit_id", F.greatest("u0", "c0").alias("s0"), F.least("u1", "c1").alias("s1"), F.when(F.col("any"), "contained").otherwise("split").alias("how"))


def greatest_overlap(units: DataFrame, spans: DataFrame, key: str = "doc") -> DataFrame:
    """The unit with the greatest overlap; the earliest on ties."""
    w = Window.partitionBy(key, "span_id").orderBy(F.col("overlap").desc(), "u0", "unit_id")
    return overlapping(units, spans, key).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def carried(rows: DataFrame, partition: str, order: list, *columns: str) -> DataFrame:
    """``columns`` filled with the latest value that is not null so far."""
    w = Window.partitionBy(partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for c in columns:
        rows = rows.withColumn(f"{c}_now", F.last(c, ignorenulls=True).over(w))
    return rows


def merged(spans: DataFrame, key: str, gap: int) -> DataFrame:
    """Spans ``key, c0, c1`` joined where the next begins within ``gap`` of the furthest end so far."""
    w = Window.partitionBy(key).orderBy("c0", "c1")
    far = F.max("c1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    x = spans.withColumn("new", F.when(F.col("c0") - far <= gap, 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    return x.groupBy(key, "island").agg(F.min("c0").alias("c0"), F.max("c1").alias("c1"), F.count("*").alias("n")).drop("island")


def unique_targets(keys: DataFrame) -> DataFrame:
    """Declarations ``key, target`` whose key has exactly one target: ambiguous references are dropped."""
    return keys.groupBy("key").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target")).where("n = 1").drop("n")


def reference_paths(declared: DataFrame, references: DataFrame) -> DataFrame:
    """``source, target, hops``: unique direct targets, and those reached over one unit between."""
    one = references.join(unique_targets(declared), "key").where("source != target").select("source", "target").distinct()
    two = one.alias("x").join(one.alias("y"), F.col("x.target") == F.col("y.source")).select(F.col("x.source"), F.col("y.target")).where("source != target")
    both = one.withColumn("hops", F.lit(1)).unionByName(two.withColumn("hops", F.lit(2)))
    return both.groupBy("source", "target").agg(F.min("hops").alias("hops"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``id, component``: the smallest id reachable over ``a, b`` links, by label propagation with pointer jumping.

    Labels are cut into reliable storage every round, and only their number of changes reaches the driver.
    """
    from textloom.plans.lineage import cut

    links = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = links.select(F.col("a").alias("id")).distinct().withColumn("component", F.col("id"))
    for _ in range(rounds):
        near = links.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("best"))
        step = labels.join(near, F.col("id") == F.col("a")).select("id", F.col("component").alias("was"), F.least("component", "best").alias("component"))
        far = step.select(F.col("id").alias("component"), F.col("component").alias("further"))
        step = cut(step.join(far, "component", "left").select("id", "was", F.least("component", "further").alias("component")))
        labels = step.select("id", "component")
        if step.where("was != component").isEmpty():
            return labels
    raise ValueError(f"components did not settle in {rounds} rounds")
