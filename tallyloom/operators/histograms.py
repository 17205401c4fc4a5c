"""Histograms: left-closed bins [boundary + k width, boundary + (k + 1) width)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import normal


def bin_index(x: Column, width: float, boundary: float = 0.0) -> Column:
    """k of a value's bin; the quotient is rounded to nine places first, so that edges fall where they should."""
    if width <= 0:
        raise ValueError("width must be positive")
    return F.floor(F.round((x - boundary) / width, 9))


def histogram(df: DataFrame, keys: list[str], value: str, width: float, boundary: float = 0.0, relative: bool = False) -> DataFrame:
    """(keys..., bin, low, high, count or share)."""
    k = bin_index(F.col(value), width, boundary)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, k.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    out = counted.withColumns({"low": boundary + F.col("bin") * width, "high": boundary + (F.col("bin") + 1) * width})
    if relative:
        out = out.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(*keys))).drop("count")
    return out


def with_density(df: DataFrame, keys: list[str], value: str, width: float, boundary: float = 0.0) -> DataFrame:
    """Counts with the fitted normal density at bin centres, scaled to counts (n times width)."""
    fit = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    met = histogram(df, keys, value, width, boundary).join(fit, keys) if keys else histogram(df, keys, value, width, boundary).crossJoin(F.broadcast(fit))
    centre = F.col("low") + width / 2
    checked = F.when(F.col("sd") > 0, F.col("sd")).otherwise(F.raise_error(F.lit("the deviation must be positive")).cast("double"))
    return met.withColumn("density", F.col("n") * width * normal.pdf(centre, F.col("mean"), checked)).drop("mean", "sd", "n")


def against_specification(df: DataFrame, keys: list[str], value: str, lsl: float, usl: float) -> DataFrame:
    """Bins of width 1 about whole numbers, with the limits, flags of bins outside and the height of the picture."""
    if not lsl < usl:
        raise ValueError("the lower limit must be below the upper")
    out = histogram(df, keys, value, 1.0, 0.5)
    centre = F.col("low") + 0.5
    return out.withColumns({"below": centre < lsl, "above": centre > usl, "y_max": 1.6 * F.max("count").over(Window.partitionBy(*keys))})


def tabulated(df: DataFrame, keys: list[str], value: str, edges: list[float]) -> DataFrame:
    """Counts by interval [edge, next edge), the last closed on both sides (A17)."""
    x, k = F.col(value), F.lit(None).cast("int")
    for i in range(len(edges) - 1):
        inside = (x >= edges[i]) & ((x < edges[i + 1]) if i < len(edges) - 2 else (x <= edges[i + 1]))
        k = F.when(inside, F.lit(i + 1)).otherwise(k)
    return df.groupBy(*keys, k.alias("interval")).agg(F.count(F.lit(1)).alias("count")).where("interval is not null")


def expanded(df: DataFrame, position: str = "position", count: str = "count") -> DataFrame:
    """Weighted bins as single rows (level counts them from 1)."""
    return df.where(F.col(count) > 0).select("*", F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))).alias("level"))
