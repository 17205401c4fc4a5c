"""Control-chart limits and signals.

Limits are tables of one row a chart, made by aggregation; signals join them back.  Lower limits may be negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control-chart constants by subgroup size (h: mean range in sigmas; H: limits of the mean chart in mean
# ranges; h2: upper limit of the range chart in mean ranges).
CONSTANTS = {
    2: (1.128, 1.880, 3.267),
    3: (1.693, 1.023, 2.575),
    4: (2.059, 0.729, 2.282),
    5: (2.326, 0.577, 2.114),
    6: (2.534, 0.483, 2.004),
}
XMR, MEDIAN_MR = 2.66, 3.145


def constant(n: Column | str, which: str) -> Column:
    """A constant (h, H or h2) by a column of subgroup sizes; null outside 2..6."""
    i, n = ("h", "H", "h2").index(which), F.col(n) if isinstance(n, str) else n
    out = F.lit(None).cast("double")
    for size, c in CONSTANTS.items():
        out = F.when(n == size, F.lit(c[i])).otherwise(out)
    return out


def individuals(ranged: DataFrame, keys: list[str], baseline: int | None = None, value: str = "value", scale: float = XMR) -> DataFrame:
    """(keys..., n, central, mr_bar, lcl, ucl) from the first `baseline` points of (keys..., t, value, mr), or all.

    The moving range that crosses the baseline's edge is not part of it.
    """
    if baseline is not None:
        if baseline < 2:
            raise ValueError("a baseline has two points at least")
        ranged = ranged.where(F.col("t") <= baseline)
    s = ranged.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("central"), F.avg("mr").alias("mr_bar"))
    return s.withColumns({"lcl": F.col("central") - scale * F.col("mr_bar"), "ucl": F.col("central") + scale * F.col("mr_bar")})


def median_individuals(ranged: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys..., central, mr_median, lcl, ucl): medians in place of means, both exact."""
    s = ranged.groupBy(*keys).agg(F.median(value).alias("central"), F.median("mr").alias("mr_median"))
    return s.withColumns({"lcl": F.col("central") - MEDIAN_MR * F.col("mr_median"), "ucl": F.col("central") + MEDIAN_MR * F.col("mr_median")})


def deviations(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys..., central, sd, lcl, ucl): three sample deviations about the mean."""
    s = df.groupBy(*keys).agg(F.avg(value).alias("central"), F.stddev_samp(value).alias("sd"))
    return s.withColumns({"lcl": F.col("central") - 3 * F.col("sd"), "ucl": F.col("central") + 3 * F.col("sd")})


def counts(df: DataFrame, keys: list[str], n: int, value: str = "value") -> DataFrame:
    """np chart of counts out of n: (keys..., central, lcl, ucl)."""
    s = df.groupBy(*keys).agg(F.avg(value).alias("central"))
    reach = 3 * F.sqrt(F.col("central") * (1 - F.col("central") / n))
    return s.withColumns({"lcl": F.col("central") - reach, "ucl": F.col("central") + reach})


def proportions(df: DataFrame, keys: list[str], n: int, hits: str, of: str) -> DataFrame:
    """p chart for samples of n: (keys..., central, lcl, ucl), central from all hits out of all."""
    s = df.groupBy(*keys).agg((F.sum(hits) / F.sum(of)).alias("central"))
    reach = 3 * F.sqrt(F.col("central") * (1 - F.col("central")) / n)
    return s.withColumns({"lcl": F.col("central") - reach, "ucl": F.col("central") + reach})


def subgroups(df: DataFrame, keys: list[str], group: str, value: str = "value") -> DataFrame:
    """(keys..., group, n, mean, range) of each subgroup."""
    return df.groupBy(*keys, group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.max(value) - F.min(value)).alias("range"))


def means_and_ranges(groups: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Mean and range chart of subgroups of n: (keys..., m, grand_mean, mean_range, lcl, ucl, range_ucl)."""
    if n not in CONSTANTS:
        raise ValueError("subgroups have 2 to 6 values")
    _, wide, top = CONSTANTS[n]
    s = groups.where(F.col("n") == n).groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), F.avg("mean").alias("grand_mean"), F.avg("range").alias("mean_range"))
    return s.withColumns({"lcl": F.col("grand_mean") - wide * F.col("mean_range"), "ucl": F.col("grand_mean") + wide * F.col("mean_range"), "range_ucl": top * F.col("mean_range")})


def range_sigma(groups: DataFrame, of: str = "range", n: str = "n") -> DataFrame:
    """Adds sigma, the range divided by h of the subgroup's size; null outside 2..6."""
    return groups.withColumn("sigma", F.col(of) / constant(n, "h"))


def fixed(points: DataFrame, keys: list[str], lcl: float, ucl: float, value: str = "value") -> DataFrame:
    """(keys..., central, lcl, ucl): limits that are given, as of the red-bead chart (1.4 and 18.2); central is the mean."""
    return points.groupBy(*keys).agg(F.avg(value).alias("central")).withColumns({"lcl": F.lit(float(lcl)), "ucl": F.lit(float(ucl))})


def signals(points: DataFrame, limits: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """points with central, lcl, ucl and signal: strictly outside the limits.  Limits have one row a chart."""
    met = points.join(limits.select(*keys, "central", "lcl", "ucl"), keys) if keys else points.crossJoin(F.broadcast(limits.select("central", "lcl", "ucl")))
    return met.withColumn("signal", (F.col(value) < F.col("lcl")) | (F.col(value) > F.col("ucl")))


def absolute_deviation(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """(keys..., mad): mean absolute difference from the mean (A3)."""
    mean = df.groupBy(*keys).agg(F.avg(value).alias("_m"))
    return df.join(mean, keys).groupBy(*keys).agg(F.avg(F.abs(F.col(value) - F.col("_m"))).alias("mad"))
