"""Ordered series: positions, moving ranges, runs.

A series is (keys..., t, value): t starts at 1 and has no gaps; order is always given by columns that are unique within
a series, never by where a row happens to lie.  Series may be long: with `chunk`, a column that rises with the order
(such as the day), windows run inside a chunk only, and what crosses chunks goes through a table of one row a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def number(df: DataFrame, keys: list[str], order: list[str], value: str, chunk: str | None = None) -> DataFrame:
    """df with t (position in its series) and previous (the value before; null at the first)."""
    if chunk is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({"t": F.row_number().over(w).cast("long"), "previous": F.lag(value).over(w)})
    w = Window.partitionBy(*keys, chunk).orderBy(*order)
    parts = df.groupBy(*keys, chunk).agg(F.count(F.lit(1)).alias("_n"), F.max_by(value, F.struct(*order)).alias("_end"))
    along = Window.partitionBy(*keys).orderBy(chunk)
    parts = parts.select(*keys, chunk, F.coalesce(F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.lag("_end").over(along).alias("_last"))
    met = df.join(parts, [*keys, chunk])
    first = F.row_number().over(w) == 1
    return met.withColumns({"t": F.row_number().over(w) + F.col("_before"), "previous": F.when(first, F.col("_last")).otherwise(F.lag(value).over(w))}).drop("_before", "_last")


def moving_ranges(numbered: DataFrame, value: str = "value") -> DataFrame:
    """Adds mr, the absolute difference from the value before; null at t = 1."""
    return numbered.withColumn("mr", F.abs(F.col(value) - F.col("previous")))


def cumulative(df: DataFrame, keys: list[str], order: list[str], value: Column | str) -> Column:
    """Running sum of a series."""
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def stacked(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Adds level, the height of a row among those of equal value (W3)."""
    return df.withColumn("level", F.row_number().over(Window.partitionBy(*keys, value).orderBy(*order)).cast("long"))


def concatenated(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Two halves of series (keys, t, value) as one: the second's t goes on from the first's last (W10)."""
    ends = first.groupBy(*keys).agg(F.max("t").alias("_end"))
    moved = second.join(ends, keys, "left").withColumn("t", F.col("t") + F.coalesce("_end", F.lit(0))).drop("_end")
    return first.unionByName(moved)


def capped_gaps(df: DataFrame, keys: list[str], order: list[str], ms: Column, cap_ms: int, idle_ms: int) -> DataFrame:
    """Adds active_ms: time since the row before, at most cap_ms, and 0 after a gap of more than idle_ms (W11)."""
    gap = ms - F.lag(ms).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("active_ms", F.when(gap <= idle_ms, F.least(gap, F.lit(cap_ms))).otherwise(F.lit(0)).cast("long"))


def toggled(df: DataFrame, keys: list[str], order: list[str], mark: Column) -> DataFrame:
    """Adds inside: whether an odd number of marks stands at or before a row, as between fences (W5)."""
    return df.withColumn("inside", F.sum(mark.cast("int")).over(Window.partitionBy(*keys).orderBy(*order)) % 2 == 1)


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, name: str = "island") -> DataFrame:
    """Adds a group number that goes up at every row where starts holds (W12, W13)."""
    return df.withColumn(name, F.sum(starts.cast("int")).over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def lag1_correlation(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys..., r): correlation of a series with itself one step on (A18); null without variance, where corr fails."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    spread = F.stddev_pop(value) * F.stddev_pop(F.when(F.col(value).isNotNull(), F.col("_b")))
    return df.withColumn("_b", before).where("_b is not null").groupBy(*keys).agg(F.try_divide(F.covar_pop(value, "_b"), spread).alias("r"))


def half_ratio(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys..., ratio): sample deviation of the second half of a series (t > n / 2) to the first's (A18); null if that
    is 0 or a half has fewer than two rows."""
    n = df.groupBy(*keys).agg(F.max("t").alias("_n"))
    met = df.join(n, keys)
    return met.groupBy(*keys).agg(F.try_divide(F.stddev_samp(F.when(F.col("t") > F.col("_n") / 2, F.col(value))), F.stddev_samp(F.when(F.col("t") <= F.col("_n") / 2, F.col(value)))).alias("ratio"))
