"""Queries: series and control charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import limits, series
from tallyloom.plans.register import query, table

BASELINE, BATCH, SUBGROUP = 24, 50, 5
LINES = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice", "l_quantity"]


def six(c: Column | str) -> Column:
    return F.round(c, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, as the comparisons take them."""
    return df.select(*[six(n).alias(n) if kind == "double" else F.col(n) for n, kind in df.dtypes])


def event_series(spark, sf_dir: str) -> DataFrame:
    """Events by type: (series_id, t, value, mr)."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), "ts", "event_id", "value", F.to_date("ts").alias("day"))
    return series.moving_ranges(series.number(e, ["series_id"], ["ts", "event_id"], "value", "day")).select("series_id", "t", "value", "mr")


def daily_orders(spark, sf_dir: str) -> DataFrame:
    """Orders a day as one series: (series_id, t, value, mr)."""
    per = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    per = per.select(F.lit("orders").alias("series_id"), "day", "value", F.year("day").alias("year"))
    return series.moving_ranges(series.number(per, ["series_id"], ["day"], "value", "year")).select("series_id", "t", "day", "value", "mr")


def supplier_lines(spark, sf_dir: str) -> DataFrame:
    """Line items numbered from 0 within their supplier."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", *LINES, "l_returnflag")
    return li.withColumn("i", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(*LINES)) - 1)


def batches(spark, sf_dir: str) -> DataFrame:
    """(l_suppkey, batch, value): returned lines in each full batch of 50 of a supplier."""
    b = supplier_lines(spark, sf_dir).groupBy("l_suppkey", F.floor(F.col("i") / BATCH).alias("batch")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").cast("double").alias("value"))
    return b.where(F.col("n") == BATCH)


def quantity_groups(spark, sf_dir: str) -> DataFrame:
    """(l_suppkey, subgroup, n, mean, range): quantities in full subgroups of 5 of a supplier."""
    q = supplier_lines(spark, sf_dir).select("l_suppkey", F.floor(F.col("i") / SUBGROUP).alias("subgroup"), F.col("l_quantity").alias("value"))
    return limits.subgroups(q, ["l_suppkey"], "subgroup").where(F.col("n") == SUBGROUP)


EVENTS = """s AS (SELECT event_type AS series_id, row_number() OVER w AS t, value, abs(value - lag(value) OVER w) AS mr
      FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))"""
ORDERS = """d AS (SELECT o_orderdate::DATE AS day, count(*)::DOUBLE AS value FROM orders GROUP BY 1),
s AS (SELECT 'orders' AS series_id, row_number() OVER (ORDER BY day) AS t, day, value, abs(value - lag(value) OVER (ORDER BY day)) AS mr FROM d)"""
LINE_SQL = f"li AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(LINES)}) - 1 AS i FROM lineitem)"
BATCH_SQL = f"{LINE_SQL}, b AS (SELECT l_suppkey, i // {BATCH} AS batch, count(*) FILTER (l_returnflag = 'R')::DOUBLE AS value FROM li GROUP BY 1, 2 HAVING count(*) = {BATCH})"
GROUP_SQL = f"{LINE_SQL}, g AS (SELECT l_suppkey, i // {SUBGROUP} AS subgroup, count(*) AS n, avg(l_quantity) AS mean, max(l_quantity) - min(l_quantity) AS \"range\" FROM li GROUP BY 1, 2 HAVING count(*) = {SUBGROUP})"
_XMR = "round(c, 6) AS central, round(r, 6) AS mr_bar, round(c - 2.66::DOUBLE * r, 6) AS lcl, round(c + 2.66::DOUBLE * r, 6) AS ucl"


@query(f"WITH {EVENTS} SELECT series_id, t, value, round(mr, 6) AS mr FROM s")
def moving_range(spark, sf_dir):
    return event_series(spark, sf_dir).withColumn("mr", six("mr"))


@query(f"WITH {EVENTS}, l AS (SELECT series_id, avg(value) AS c, avg(mr) AS r FROM s GROUP BY 1) SELECT series_id, t AS x, value AS y, {_XMR.replace('round(r, 6) AS mr_bar, ', '')} FROM s JOIN l USING (series_id)")
def run_chart_points(spark, sf_dir):
    s = event_series(spark, sf_dir)
    chart = limits.individuals(s, ["series_id"]).select("series_id", "central", "lcl", "ucl")
    return rounded(s.join(chart, "series_id").select("series_id", F.col("t").alias("x"), F.col("value").alias("y"), "central", "lcl", "ucl"))


@query(f"WITH {EVENTS} SELECT series_id, n, {_XMR} FROM (SELECT series_id, count(value) AS n, avg(value) AS c, avg(mr) AS r FROM s GROUP BY 1)")
def xmr_limits(spark, sf_dir):
    return rounded(limits.individuals(event_series(spark, sf_dir), ["series_id"]))


@query(f"WITH {EVENTS} SELECT series_id, n, {_XMR} FROM (SELECT series_id, count(value) AS n, avg(value) AS c, avg(mr) AS r FROM s WHERE t <= {BASELINE} GROUP BY 1)")
def xmr_baseline_limits(spark, sf_dir):
    return rounded(limits.individuals(event_series(spark, sf_dir), ["series_id"], BASELINE))


@query(
    f"""WITH {ORDERS}, l AS (SELECT avg(value) AS c, avg(mr) AS r FROM s WHERE t <= {BASELINE})
    SELECT series_id, t, value, round(c, 6) AS central, round(c - 2.66::DOUBLE * r, 6) AS lcl, round(c + 2.66::DOUBLE * r, 6) AS ucl,
    value < c - 2.66::DOUBLE * r OR value > c + 2.66::DOUBLE * r AS signal FROM s, l"""
)
def xmr_signals(spark, sf_dir):
    s = daily_orders(spark, sf_dir)
    return rounded(limits.signals(s.select("series_id", "t", "value"), limits.individuals(s, ["series_id"], BASELINE), ["series_id"]))


@query(
    f"""WITH {EVENTS}, n AS (SELECT series_id, max(t) // 2 AS k FROM s GROUP BY 1),
    l AS (SELECT series_id, avg(value) AS c, avg(mr) AS r FROM s JOIN n USING (series_id) WHERE t <= k GROUP BY 1)
    SELECT series_id, t, CASE WHEN t <= k THEN 1 ELSE 2 END AS half, value, round(c, 6) AS central, round(c - 2.66::DOUBLE * r, 6) AS lcl,
    round(c + 2.66::DOUBLE * r, 6) AS ucl, value < c - 2.66::DOUBLE * r OR value > c + 2.66::DOUBLE * r AS signal FROM s JOIN n USING (series_id) JOIN l USING (series_id)"""
)
def xmr_pair_extended(spark, sf_dir):
    s = event_series(spark, sf_dir)
    # lengths from the events themselves, which need no order
    lengths = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id")).agg(F.floor(F.count(F.lit(1)) / 2).alias("k"))
    half = s.join(lengths, "series_id").withColumn("half", F.when(F.col("t") <= F.col("k"), 1).otherwise(2))
    chart = limits.individuals(half.where("half = 1"), ["series_id"])
    return rounded(limits.signals(half.select("series_id", "t", "half", "value"), chart, ["series_id"]))


@query(f"WITH {EVENTS} SELECT series_id, round(c, 6) AS central, round(d, 6) AS sd, round(c - 3 * d, 6) AS lcl, round(c + 3 * d, 6) AS ucl FROM (SELECT series_id, avg(value) AS c, stddev_samp(value) AS d FROM s GROUP BY 1)")
def sd_limits(spark, sf_dir):
    return rounded(limits.deviations(event_series(spark, sf_dir), ["series_id"]))


@query(f"WITH {EVENTS} SELECT series_id, round(c, 6) AS central, round(r, 6) AS mr_median, round(c - 3.145::DOUBLE * r, 6) AS lcl, round(c + 3.145::DOUBLE * r, 6) AS ucl FROM (SELECT series_id, median(value) AS c, median(mr) AS r FROM s GROUP BY 1)")
def median_mr_limits(spark, sf_dir):
    return rounded(limits.median_individuals(event_series(spark, sf_dir), ["series_id"]))


@query(f"WITH {BATCH_SQL} SELECT l_suppkey, round(c, 6) AS central, round(c - 3 * sqrt(c * (1 - c / {BATCH})), 6) AS lcl, round(c + 3 * sqrt(c * (1 - c / {BATCH})), 6) AS ucl FROM (SELECT l_suppkey, avg(value) AS c FROM b GROUP BY 1)")
def np_limits(spark, sf_dir):
    return rounded(limits.counts(batches(spark, sf_dir), ["l_suppkey"], BATCH))


@query(f"WITH {BATCH_SQL} SELECT l_suppkey, round(c, 6) AS central, round(c - 3 * sqrt(c * (1 - c) / {BATCH}), 6) AS lcl, round(c + 3 * sqrt(c * (1 - c) / {BATCH}), 6) AS ucl FROM (SELECT l_suppkey, sum(value) / (count(*) * {BATCH}) AS c FROM b GROUP BY 1)")
def p_limits(spark, sf_dir):
    return rounded(limits.proportions(batches(spark, sf_dir), ["l_suppkey"], BATCH, "value", "n"))


_XBAR = "l AS (SELECT l_suppkey, count(*) AS m, avg(mean) AS c, avg(\"range\") AS r FROM g GROUP BY 1)"


@query(f"WITH {GROUP_SQL}, {_XBAR} SELECT l_suppkey, m, round(c, 6) AS grand_mean, round(r, 6) AS mean_range, round(c - 0.577::DOUBLE * r, 6) AS lcl, round(c + 0.577::DOUBLE * r, 6) AS ucl, round(2.114::DOUBLE * r, 6) AS range_ucl FROM l")
def xbar_r_limits(spark, sf_dir):
    return rounded(limits.means_and_ranges(quantity_groups(spark, sf_dir), ["l_suppkey"], SUBGROUP))


@query(f"""WITH {GROUP_SQL}, {_XBAR} SELECT l_suppkey, subgroup, round(mean, 6) AS mean, round("range", 6) AS "range",
    round(mean, 6) < round(c - 0.577::DOUBLE * r, 6) OR round(mean, 6) > round(c + 0.577::DOUBLE * r, 6) AS mean_signal, round("range", 6) > round(2.114::DOUBLE * r, 6) AS range_signal FROM g JOIN l USING (l_suppkey)""")
def xbar_r_signals(spark, sf_dir):
    g = quantity_groups(spark, sf_dir)
    met = rounded(g.join(limits.means_and_ranges(g, ["l_suppkey"], SUBGROUP), "l_suppkey"))
    out = (F.col("mean") < F.col("lcl")) | (F.col("mean") > F.col("ucl"))
    return met.select("l_suppkey", "subgroup", "mean", "range", out.alias("mean_signal"), (F.col("range") > F.col("range_ucl")).alias("range_signal"))


@query(f'WITH {GROUP_SQL} SELECT l_suppkey, subgroup, round("range", 6) AS "range", round("range" / 2.326::DOUBLE, 6) AS sigma FROM g')
def range_to_sigma(spark, sf_dir):
    return rounded(limits.range_sigma(quantity_groups(spark, sf_dir)).select("l_suppkey", "subgroup", "range", "sigma"))


@query(f"WITH {EVENTS}, m AS (SELECT series_id, avg(value) AS c FROM s GROUP BY 1) SELECT series_id, round(avg(abs(value - c)), 6) AS mad FROM s JOIN m USING (series_id) GROUP BY 1")
def mean_abs_deviation(spark, sf_dir):
    return rounded(limits.absolute_deviation(event_series(spark, sf_dir), ["series_id"]))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, round(max(value) - min(value), 6) AS spread, round(median(value), 6) AS middle, round(var_samp(value), 6) AS variance FROM events GROUP BY 1")
def basic_statistics(spark, sf_dir):
    v = "value"
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), six(F.avg(v)).alias("mean"), F.round(F.sum(v), 4).alias("total"), F.min(v).alias("low"), F.max(v).alias("high"), six(F.max(v) - F.min(v)).alias("spread"), six(F.median(v)).alias("middle"), six(F.var_samp(v)).alias("variance"))
    return e


@query("SELECT event_type, user_id, count(*) AS n, count(*) FILTER (value > 50) AS high FROM events GROUP BY ALL")
def frequency_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("high"))
