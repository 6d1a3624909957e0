"""Paired statistics over rows; resampling draws come from hashes, so every partitioning gives the same result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def binomial_two_sided(b: Column, c: Column) -> Column:
    """min(1, 2 * P(X <= min(b, c))) for X binomial with n = b + c and p = 1/2; 1 for n = 0. Exact sums of logs."""
    n, m = (b + c).cast("int"), F.least(b, c).cast("int")
    start = F.struct(F.lit(0.0).alias("log"), F.lit(0.0).alias("sum"))
    step = lambda s, i: F.struct((s["log"] + F.when(i == 0, 0.0).otherwise(F.log((n - i + 1) / F.greatest(i, F.lit(1))))).alias("log"), (s["sum"] + F.exp(s["log"] + F.when(i == 0, 0.0).otherwise(F.log((n - i + 1) / F.greatest(i, F.lit(1)))) - n * F.log(F.lit(2.0)))).alias("sum"))
    total = F.aggregate(F.sequence(F.lit(0), m), start, step)["sum"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * total))


def mcnemar(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: discordant counts of two 0/1 columns and the exact p."""
    x = pairs.agg(F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("only_a"), F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("only_b"))
    return x.withColumn("p", F.round(binomial_two_sided(F.col("only_a"), F.col("only_b")), 6))


def sign_test(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Ties are dropped."""
    x = pairs.agg(F.count_if(F.col(a) > F.col(b)).alias("greater"), F.count_if(F.col(a) < F.col(b)).alias("less"))
    return x.withColumn("p", F.round(binomial_two_sided(F.col("greater"), F.col("less")), 6))


def win_tie_loss(pairs: DataFrame, a: str, b: str) -> DataFrame:
    d = F.col(a) - F.col(b)
    return pairs.agg(F.count_if(d > 0).alias("wins"), F.count_if(d == 0).alias("ties"), F.count_if(d < 0).alias("losses"), F.round(F.avg(d), 6).alias("mean_difference"))


def _iterations(n: int, spark) -> DataFrame:
    return spark.range(n).withColumnRenamed("id", "it")


def bootstrap(rows: DataFrame, key: str, value: str, iterations: int = 500, seed: int = 7, level: float = 0.95) -> DataFrame:
    """One row: mean and percentile interval. Each row is drawn a Poisson(1) number of times, by a hash of
    (seed, iteration, key), so an iteration is a map-side sum and no row is ever gathered."""
    u = F.pmod(F.xxhash64(F.lit(seed), "it", key), F.lit(1 << 30)) / float(1 << 30)
    cut, p, times = 0.0, 2.718281828459045**-1, F.lit(0)
    for k in range(8):
        cut += p
        times = times + (u >= cut).cast("int")
        p /= k + 1
    draws = rows.select(key, F.col(value).cast("double").alias("v")).crossJoin(F.broadcast(_iterations(iterations, rows.sparkSession))).withColumn("w", times)  # one row an iteration
    means = draws.groupBy("it").agg((F.sum(F.col("w") * F.col("v")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    edge = (1 - level) / 2
    return means.agg(F.percentile("m", edge).alias("low"), F.percentile("m", 1 - edge).alias("high")).crossJoin(rows.agg(F.avg(value).alias("mean"), F.count(value).alias("n")))


def sign_flip(pairs: DataFrame, key: str, a: str, b: str, iterations: int = 500, seed: int = 7) -> DataFrame:
    """One row: mean difference and p = (extreme + 1) / (iterations + 1) under random signs."""
    d = pairs.select(key, (F.col(a) - F.col(b)).cast("double").alias("d"))
    sign = F.when(F.pmod(F.xxhash64(F.lit(seed), "it", key), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    sums = d.crossJoin(F.broadcast(_iterations(iterations, pairs.sparkSession))).groupBy("it").agg(F.avg(sign * F.col("d")).alias("m"))  # one row an iteration
    seen = d.agg(F.avg("d").alias("mean_difference"))
    x = sums.crossJoin(F.broadcast(seen)).agg(F.first("mean_difference").alias("mean_difference"), F.count_if(F.abs("m") >= F.abs("mean_difference") - 1e-12).alias("extreme"))
    return x.withColumn("p", (F.col("extreme") + 1) / (iterations + 1)).drop("extreme")


def holm(tests: DataFrame, p: str = "p") -> DataFrame:
    """``adjusted``: step-down p-values, monotone and at most 1. A family of tests is small: one row a hypothesis."""
    order = Window.orderBy(p, "name")
    m = tests.agg(F.count("*").alias("m"))
    x = tests.crossJoin(F.broadcast(m)).withColumn("r", F.row_number().over(order))
    step = F.max(F.least(F.lit(1.0), (F.col("m") - F.col("r") + 1) * F.col(p))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("adjusted", F.round(step, 6)).drop("m", "r")


def minimum_detectable(rows: DataFrame, value: str, z: float = 1.959964 + 0.841621) -> DataFrame:
    """One row: z * sd / sqrt(n), the smallest mean difference found with 80 % power at 5 %."""
    return rows.agg(F.count(value).alias("n"), F.round(z * F.stddev_samp(value) / F.sqrt(F.count(value)), 6).alias("mde"))
