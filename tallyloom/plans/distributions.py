"""Queries: histograms, densities, sampling studies, discrete distributions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import normal
from tallyloom.operators import histograms, limits, series, studies
from tallyloom.plans.charts import EVENTS, LINE_SQL, LINES, event_series, rounded, supplier_lines
from tallyloom.plans.register import query, table

N, REPLICATION = 5, 60


def lines(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", F.col("l_quantity").alias("value"), F.col("l_extendedprice").alias("price"))


@query("SELECT l_returnflag, b AS bin, count(*) AS count, b * 5000.0::DOUBLE AS low, (b + 1) * 5000.0::DOUBLE AS high FROM (SELECT l_returnflag, floor(round(l_extendedprice / 5000, 9))::BIGINT AS b FROM lineitem) GROUP BY ALL")
def histogram_counts(spark, sf_dir):
    return histograms.histogram(lines(spark, sf_dir), ["l_returnflag"], "price", 5000.0)


@query("SELECT l_returnflag, b AS bin, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 6) AS share FROM (SELECT l_returnflag, floor(round((l_quantity - 0.5) / 4, 9))::BIGINT AS b FROM lineitem) GROUP BY l_returnflag, b")
def histogram_relative(spark, sf_dir):
    return rounded(histograms.histogram(lines(spark, sf_dir), ["l_returnflag"], "value", 4.0, 0.5, relative=True).drop("low", "high"))


@query(
    f"""WITH f AS (SELECT l_returnflag, avg(l_quantity) AS m, stddev_samp(l_quantity) AS d, count(*) AS n FROM lineitem GROUP BY 1),
    h AS (SELECT l_returnflag, floor(round((l_quantity - 0.5) / 4, 9))::BIGINT AS bin, count(*) AS count FROM lineitem GROUP BY 1, 2)
    SELECT l_returnflag, bin, count, round(n * 4 * exp(-pow((0.5 + bin * 4 + 2 - m) / d, 2) / 2) / (d * {math.sqrt(2 * math.pi)!r}::DOUBLE), 6) AS density FROM h JOIN f USING (l_returnflag)"""
)
def histogram_pdf_overlay(spark, sf_dir):
    return rounded(histograms.with_density(lines(spark, sf_dir), ["l_returnflag"], "value", 4.0, 0.5).drop("low", "high"))


@query(f"WITH {LINE_SQL} SELECT l_suppkey, l_quantity AS value, i, row_number() OVER (PARTITION BY l_suppkey, l_quantity ORDER BY i) AS level FROM li")
def stacked_boxes(spark, sf_dir):
    li = supplier_lines(spark, sf_dir).select("l_suppkey", F.col("l_quantity").alias("value"), F.col("i").cast("long").alias("i"))
    return series.stacked(li, ["l_suppkey"], "value", ["i"])


@query(
    """WITH h AS (SELECT p_brand, floor(round(p_size - 0.5, 9))::BIGINT AS bin, count(*) AS count FROM part GROUP BY 1, 2)
    SELECT p_brand, bin, count, bin + 1.0 < 5 AS below, bin + 1.0 > 45 AS above, round(1.6 * max(count) OVER (PARTITION BY p_brand), 6) AS y_max FROM h"""
)
def spec_limit_histogram(spark, sf_dir):
    return rounded(histograms.against_specification(table(spark, sf_dir, "part").select("p_brand", F.col("p_size").cast("double").alias("v")), ["p_brand"], "v", 5, 45).drop("low", "high"))


@query("SELECT l_returnflag, CASE WHEN q >= 1 AND q < 10 THEN 1 WHEN q >= 10 AND q < 25 THEN 2 WHEN q >= 25 AND q <= 50 THEN 3 END AS interval, count(*) AS count FROM (SELECT l_returnflag, l_quantity AS q FROM lineitem) WHERE q BETWEEN 1 AND 50 GROUP BY 1, 2")
def interval_counts(spark, sf_dir):
    return histograms.tabulated(lines(spark, sf_dir), ["l_returnflag"], "value", [1, 10, 25, 50])


@query("SELECT p_size AS position, u.n AS level FROM (SELECT p_size, count(*) AS c FROM part GROUP BY 1), LATERAL (SELECT unnest(generate_series(1, c)) AS n) u")
def weighted_bins_expanded(spark, sf_dir):
    bins = table(spark, sf_dir, "part").groupBy(F.col("p_size").alias("position")).agg(F.count(F.lit(1)).alias("count"))
    return histograms.expanded(bins).select("position", "level")


@query(
    f"""WITH {LINE_SQL}, p AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS d FROM lineitem)
    SELECT l_suppkey, i // 25 AS sample, count(*) AS n, round((avg(l_quantity) - any_value(m)) / (any_value(d) / sqrt(count(*))), 6) AS z FROM li, p GROUP BY 1, 2 HAVING count(*) = 25"""
)
def clt_standardised_means(spark, sf_dir):
    li = supplier_lines(spark, sf_dir).select("l_suppkey", F.floor(F.col("i") / 25).alias("sample"), F.col("l_quantity").alias("value"))
    whole = lines(spark, sf_dir).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("d"))
    return rounded(studies.standardised_means(li.crossJoin(F.broadcast(whole)), ["l_suppkey", "sample"], "value", F.col("m"), F.col("d")).where("n = 25"))


@query(
    f"""WITH {LINE_SQL}, r AS (SELECT l_suppkey, i // 12 AS baseline, abs(l_quantity - lag(l_quantity) OVER (PARTITION BY l_suppkey, i // 12 ORDER BY i)) AS mr FROM li)
    SELECT l_suppkey, baseline, round(avg(mr) / 1.128::DOUBLE, 6) AS sigma FROM r GROUP BY 1, 2 HAVING count(*) = 12"""
)
def mr_sigma_estimator(spark, sf_dir):
    li = supplier_lines(spark, sf_dir).select("l_suppkey", F.floor(F.col("i") / 12).alias("baseline"), "i", F.col("l_quantity").alias("value"))
    ranged = series.moving_ranges(series.number(li, ["l_suppkey", "baseline"], ["i"], "value"))
    full = ranged.groupBy("l_suppkey", "baseline").agg(F.count(F.lit(1)).alias("n"), (F.avg("mr") / limits.CONSTANTS[2][0]).alias("sigma"))
    return rounded(full.where("n = 12").drop("n"))


@query(
    f"""WITH {EVENTS}, a AS (SELECT series_id, avg(value) AS m, stddev_samp(value) / sqrt(count(value)) AS e FROM s GROUP BY 1)
    SELECT series_id, round(m, 6) AS mean, round(m / e, 6) AS t, round(m - 1.96 * e, 6) AS low95, round(m + 1.96 * e, 6) AS high95, round(m - 2.58 * e, 6) AS low99, round(m + 2.58 * e, 6) AS high99 FROM a"""
)
def conf_interval(spark, sf_dir):
    return rounded(studies.intervals(event_series(spark, sf_dir), ["series_id"], "value"))


def _standard(spark, sf_dir) -> DataFrame:
    whole = lines(spark, sf_dir).agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("d"))
    li = supplier_lines(spark, sf_dir).crossJoin(F.broadcast(whole))
    return li.select("l_suppkey", F.floor(F.col("i") / REPLICATION).alias("replication"), F.floor(F.col("i") / N).alias("subgroup"), ((F.col("l_quantity") - F.col("m")) / F.col("d")).alias("value"))


_A2 = 3 / (limits.CONSTANTS[N][0] * math.sqrt(N))
_FALSE = f"""WITH {LINE_SQL}, p AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS d FROM lineitem),
g AS (SELECT l_suppkey, i // {REPLICATION} AS replication, i // {N} AS subgroup, avg((l_quantity - m) / d) AS a, max((l_quantity - m) / d) - min((l_quantity - m) / d) AS r FROM li, p GROUP BY 1, 2, 3 HAVING count(*) = {N}),
c AS (SELECT l_suppkey, replication, avg(a) - {_A2!r}::DOUBLE * avg(r) AS lcl, avg(a) + {_A2!r}::DOUBLE * avg(r) AS ucl FROM g GROUP BY 1, 2)"""


@query(f"{_FALSE} SELECT l_suppkey, replication, round(lcl, 6) AS lcl, round(ucl, 6) AS ucl FROM c")
def false_signal_limits(spark, sf_dir):
    return rounded(studies.false_signal_limits(_standard(spark, sf_dir), ["l_suppkey", "replication"], "subgroup", "value", N))


_ROOT = repr(math.sqrt(N))
_PROB = f"{normal.cdf_sql(f'(lcl * {_ROOT}::DOUBLE)')} + 1 - {normal.cdf_sql(f'(ucl * {_ROOT}::DOUBLE)')}"


@query(f"{_FALSE} SELECT l_suppkey, replication, round({_PROB}, 6) AS probability FROM c")
def false_signal_probs(spark, sf_dir):
    charts = studies.false_signal_limits(_standard(spark, sf_dir), ["l_suppkey", "replication"], "subgroup", "value", N)
    return rounded(studies.false_signal_probabilities(charts, N).select("l_suppkey", "replication", "probability"))


@query(f"{_FALSE}, h AS (SELECT floor(round(least({_PROB}, 0.03) / 0.0003, 9))::BIGINT AS bin, count(*) AS count FROM c GROUP BY 1) SELECT 'all' AS panel, bin, count, max(count) OVER () AS tallest FROM h")
def false_signal_panel(spark, sf_dir):
    charts = studies.false_signal_limits(_standard(spark, sf_dir), ["l_suppkey", "replication"], "subgroup", "value", N)
    panel = studies.probability_panel(studies.false_signal_probabilities(charts, N).withColumn("panel", F.lit("all")), ["panel"])
    return panel.select("panel", "bin", "count", "tallest")


_Z = lambda x: f"(({x} - n * p) / sqrt(n * p * (1 - p)))"


@query(f"WITH b AS (SELECT x, 100.0::DOUBLE AS n, 0.2::DOUBLE AS p FROM range(5, 41) r(x)) SELECT x, round({normal.cdf_sql(_Z('x + 0.5'))} - {normal.cdf_sql(_Z('x - 0.5'))}, 6) AS approximation FROM b")
def normal_approx(spark, sf_dir):
    x = spark.range(5, 41).select(F.col("id").alias("x"))
    return rounded(x.withColumn("approximation", studies.normal_approximation(F.col("x"), F.col("x"), F.lit(100.0), F.lit(0.2))))


@query("SELECT x, round(exp(-2.0::DOUBLE) * pow(2.0::DOUBLE, x) / factorial(x::INT)::DOUBLE, 9) AS p FROM range(0, 16) r(x)")
def poisson_approx(spark, sf_dir):
    return spark.range(16).select(F.col("id").alias("x"), F.round(normal.poisson_pmf(F.col("id"), 2.0), 9).alias("p"))


_PMF = "pmf AS (SELECT x, exp(lgamma(101) - lgamma(x + 1) - lgamma(101 - x) + x * ln(0.2::DOUBLE) + (100 - x) * ln(0.8::DOUBLE)) AS p FROM range(0, 101) r(x))"


def _binomial(spark) -> DataFrame:
    return spark.range(101).select(F.col("id").alias("x"), normal.binomial_pmf(F.col("id"), 100, 0.2).alias("p"))


@query(f"WITH {_PMF} SELECT round(sum(x * p), 6) AS mean, round(sum(x * x * p) - pow(sum(x * p), 2), 6) AS variance FROM pmf")
def discrete_moments(spark, sf_dir):
    return rounded(studies.moments(_binomial(spark), []))


@query(f"WITH {_PMF} SELECT round(sum(p) FILTER (x BETWEEN 18 AND 25), 6) AS probability FROM pmf")
def interval_probability(spark, sf_dir):
    return rounded(studies.interval_probability(_binomial(spark), [], 18, 25))


@query(f"WITH {_PMF} SELECT x, round(sum(p) OVER (ORDER BY x), 6) AS f FROM pmf")
def distribution_function(spark, sf_dir):
    return rounded(studies.cumulative(_binomial(spark), []).select("x", "f"))


@query(f"SELECT round(k / 10.0, 1)::DOUBLE AS z, round({normal.cdf_sql('(k / 10.0::DOUBLE)')}, 6) AS f FROM range(-39, 40) r(k)")
def phi_table(spark, sf_dir):
    z = spark.range(-39, 40).select(F.round(F.col("id") / 10, 1).alias("z"), (F.col("id") / 10).alias("_z"))
    return z.select("z", F.round(normal.cdf(F.col("_z")), 6).alias("f"))


@query(
    f"""WITH g AS (SELECT -4.0::DOUBLE + k * (8.0::DOUBLE / 200) AS x FROM range(0, 201) r(k))
    SELECT 'normal' AS name, round(x, 6) AS x, round(exp(-x * x / 2) / {math.sqrt(2 * math.pi)!r}::DOUBLE, 6) AS density FROM g
    UNION ALL SELECT 'exponential', round(x, 6), round(CASE WHEN x >= 0 THEN exp(-x) ELSE 0 END, 6) FROM g
    UNION ALL SELECT 'uniform', round(x, 6), round(CASE WHEN x BETWEEN {-math.sqrt(3)!r} AND {math.sqrt(3)!r} THEN {1 / (2 * math.sqrt(3))!r}::DOUBLE ELSE 0 END, 6) FROM g"""
)
def density_grid(spark, sf_dir):
    root = math.sqrt(3)
    functions = {"normal": normal.pdf, "exponential": normal.exponential_pdf, "uniform": lambda x: normal.uniform_pdf(x, -root, root)}
    return rounded(studies.density_grid(spark, functions, -4.0, 4.0, 201))


@query(f"WITH g AS (SELECT -4.0::DOUBLE + k * (8.0::DOUBLE / 800) AS x FROM range(0, 801) r(k)) SELECT round(x, 6) AS x, round(exp(-x * x / 2) / {math.sqrt(2 * math.pi)!r}::DOUBLE, 6) AS density, CASE WHEN abs(x) <= {normal.quantile(0.975)!r} THEN 'central' ELSE 'tail' END AS band FROM g")
def confidence_bands(spark, sf_dir):
    return rounded(studies.confidence_bands(spark))


@query("SELECT o_orderpriority, o_orderstatus AS outcome, count(*) AS count, round(count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority), 6) AS share FROM orders GROUP BY o_orderpriority, o_orderstatus")
def outcome_shares(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_orderstatus").alias("outcome"))
    return rounded(studies.shares(o, ["o_orderpriority"], "outcome"))


@query("SELECT k AS i, round((-1.0::DOUBLE + k * (2.0::DOUBLE / 199)), 6) AS x, round(pow(-1.0::DOUBLE + k * (2.0::DOUBLE / 199), 2), 6) AS loss FROM range(0, 200) r(k)")
def quadratic_loss(spark, sf_dir):
    x = F.lit(-1.0) + F.col("id") * (2.0 / 199)
    return rounded(spark.range(200).select(F.col("id").alias("i"), x.alias("x"), F.pow(x, F.lit(2.0)).alias("loss")))


@query()
def baseline_study(spark, sf_dir):
    """Monte Carlo; the published percentages are the test, not SQL."""
    return rounded(studies.baseline_study(spark, [4, 6, 10, 15, 20], 2000, 50, seed=361))
