"""Activity as streams (an extension: the batch operators are in operators.ledger)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", idle: str = "60 seconds", late: str = "10 minutes") -> DataFrame:
    """(user, start, end, events): sessions that end after an idle gap; append mode, late events within the mark."""
    w = F.session_window(ts, idle)
    return events.withWatermark(ts, late).groupBy(F.col(user), w).agg(F.count(F.lit(1)).alias("events")).select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def latest_values(events: DataFrame, keys: list[str], value: str, ts: str = "ts", quiet: str = "400 milliseconds", late: str = "10 minutes") -> DataFrame:
    """(keys..., value): the last value of each burst, once it has been quiet for so long."""
    return events.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, quiet)).agg(F.max_by(value, ts).alias(value)).drop("session_window")


def running_limits(events: DataFrame, key: str, value: str, ts: str = "ts", width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(key, start, n, mean, low, high) of tumbling windows."""
    w = F.window(ts, width)
    s = events.withWatermark(ts, late).groupBy(F.col(key), w).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"))
    return s.select(key, F.col("window.start").alias("start"), "n", "mean", "low", "high")
