"""Sampling studies and discrete distributions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import normal
from tallyloom.operators import limits, series


def standardised_means(df: DataFrame, sample: list[str], value: str, mean: Column, sd: Column) -> DataFrame:
    """(sample..., n, z): sample means in standard errors from the mean."""
    s = df.groupBy(*sample).agg(F.count(value).alias("n"), F.avg(value).alias("x_bar"), F.first(mean).alias("_m"), F.first(sd).alias("_s"))
    return s.select(*sample, "n", ((F.col("x_bar") - F.col("_m")) / (F.col("_s") / F.sqrt("n"))).alias("z"))


def range_estimates(ranged: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., sigma): mean moving range over 1.128 of each baseline."""
    return ranged.groupBy(*keys).agg((F.avg("mr") / limits.CONSTANTS[2][0]).alias("sigma"))


def intervals(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., mean, t, low95, high95, low99, high99) with the known-deviation factors 1.96 and 2.58; t against 0."""
    s = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    error = F.col("sd") / F.sqrt("n")
    cols = {"t": F.col("mean") / error}
    for level, z in ((95, 1.96), (99, 2.58)):
        cols |= {f"low{level}": F.col("mean") - z * error, f"high{level}": F.col("mean") + z * error}
    return s.withColumns(cols).drop("sd", "n")


def false_signal_limits(df: DataFrame, replication: list[str], subgroup: str, value: str, n: int, d2: float | None = None) -> DataFrame:
    """(replication..., lcl, ucl) of mean charts with A2 = 3 / (d2 sqrt(n))."""
    if d2 is None and n not in limits.CONSTANTS:
        raise ValueError("give d2 for sizes outside 2..6")
    a2 = 3 / ((d2 or limits.CONSTANTS[n][0]) * math.sqrt(n))
    groups = limits.subgroups(df, replication, subgroup, value).where(F.col("n") == n)
    s = groups.groupBy(*replication).agg(F.avg("mean").alias("centre"), F.avg("range").alias("_r"))
    return s.select(*replication, (F.col("centre") - a2 * F.col("_r")).alias("lcl"), (F.col("centre") + a2 * F.col("_r")).alias("ucl"))


def false_signal_probabilities(charts: DataFrame, n: int) -> DataFrame:
    """Adds probability: that a mean of n standard normal values lies outside a chart's limits."""
    root = math.sqrt(n)
    return charts.withColumn("probability", normal.cdf(F.col("lcl") * root) + 1 - normal.cdf(F.col("ucl") * root))


def probability_panel(charts: DataFrame, keys: list[str], x_max: float = 0.03, width: float = 0.0003) -> DataFrame:
    """Histogram of probabilities clipped to x_max, with the tallest bar of each panel."""
    from tallyloom.operators.histograms import histogram

    clipped = charts.withColumn("p", F.least("probability", F.lit(x_max)))
    return histogram(clipped, keys, "p", width).withColumn("tallest", F.max("count").over(Window.partitionBy(*keys)))


def density_grid(spark: SparkSession, functions: dict[str, object], low: float, high: float, n: int) -> DataFrame:
    """(name, x, density): functions of a column on n evenly spaced points."""
    if n < 2:
        raise ValueError("a grid has two points at least")
    grid = spark.range(n).select((low + F.col("id") * ((high - low) / (n - 1))).alias("x"))
    pairs = F.array(*[F.struct(F.lit(name).alias("name"), f(F.col("x")).alias("density")) for name, f in functions.items()])
    return grid.select("x", F.explode(pairs).alias("d")).select("d.name", "x", "d.density")


def confidence_bands(spark: SparkSession, level: float = 0.95, z: float | None = None, n: int = 801, reach: float = 4.0) -> DataFrame:
    """(x, density, band): the standard normal density, each point in the central band or a tail."""
    z = normal.quantile((1 + level) / 2) if z is None else z
    grid = density_grid(spark, {"normal": normal.pdf}, -reach, reach, n)
    return grid.select("x", "density", F.when(F.abs("x") <= z, F.lit("central")).otherwise(F.lit("tail")).alias("band"))


def moments(pmf: DataFrame, keys: list[str], x: str = "x", p: str = "p") -> DataFrame:
    """(keys..., mean, variance) of a table of probabilities."""
    s = pmf.groupBy(*keys).agg(F.sum(F.col(x) * F.col(p)).alias("mean"), F.sum(F.col(x) * F.col(x) * F.col(p)).alias("_q"))
    return s.select(*keys, "mean", (F.col("_q") - F.col("mean") * F.col("mean")).alias("variance"))


def interval_probability(pmf: DataFrame, keys: list[str], a: float, b: float, x: str = "x", p: str = "p") -> DataFrame:
    """(keys..., probability): of a <= X <= b."""
    return pmf.groupBy(*keys).agg(F.sum(F.when(F.col(x).between(a, b), F.col(p)).otherwise(0.0)).alias("probability"))


def cumulative(pmf: DataFrame, keys: list[str], x: str = "x", p: str = "p") -> DataFrame:
    """Adds f, the distribution function."""
    return pmf.withColumn("f", series.cumulative(pmf, keys, [x], p))


def normal_approximation(a: Column, b: Column, n: Column, p: Column) -> Column:
    """P(a <= X <= b) of a binomial by the normal with half a unit at both ends."""
    mean, sd = n * p, F.sqrt(n * p * (1 - p))
    return normal.cdf((b + 0.5 - mean) / sd) - normal.cdf((a - 0.5 - mean) / sd)


def shares(df: DataFrame, keys: list[str], outcome: str) -> DataFrame:
    """(keys..., outcome, count, share) of outcomes."""
    s = df.groupBy(*keys, outcome).agg(F.count(F.lit(1)).alias("count"))
    return s.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(*keys)))


def baseline_study(spark: SparkSession, baselines: list[int], charts: int, after: int, seed: int, shifts: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(baseline, charts, inside, outside, arl_1, ...): by baseline length, the share of charts of normal values with a false
    alarm in the baseline, and of points after the baseline of charts without one that lie outside; the average run
    length of the latter charts after a shift by so many sigmas, from the chance that a point lies outside (C15)."""
    length = F.explode(F.array(*[F.lit(b) for b in baselines])).alias("baseline")
    point = spark.range(charts).select("id", length).select("id", "baseline", F.explode(F.sequence(F.lit(1), F.col("baseline") + after)).alias("t"))
    drawn = point.withColumn("value", F.randn(seed))
    ranged = drawn.withColumn("mr", F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("id", "baseline").orderBy("t"))))
    first = ranged.groupBy("id", "baseline").agg(F.avg(F.when(F.col("t") <= F.col("baseline"), F.col("value"))).alias("c"), F.avg(F.when(F.col("t") <= F.col("baseline"), F.col("mr"))).alias("r"))
    judged = ranged.join(first, ["id", "baseline"]).withColumn("out", (F.abs(F.col("value") - F.col("c")) > limits.XMR * F.col("r")).cast("int"))
    each = judged.groupBy("id", "baseline").agg(F.max(F.when(F.col("t") <= F.col("baseline"), F.col("out"))).alias("inside"), F.first("c").alias("c"), F.first("r").alias("r"), F.sum(F.when(F.col("t") > F.col("baseline"), F.col("out"))).alias("later"))
    reach = limits.XMR * F.col("r")
    chance = lambda s: 1 - normal.cdf(F.col("c") + reach - s) + normal.cdf(F.col("c") - reach - s)
    runs = [(1 / F.avg(F.when(F.col("inside") == 0, chance(s)))).alias(f"arl_{s}") for s in shifts]
    return each.groupBy("baseline").agg(F.count(F.lit(1)).alias("charts"), F.avg("inside").alias("inside"), (F.sum(F.when(F.col("inside") == 0, F.col("later"))) / (F.count_if(F.col("inside") == 0) * after)).alias("outside"), *runs)
