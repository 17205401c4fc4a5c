"""Queries: the feedback rules over dice made of line items: a supplier's in runs of 40 stages, the last as long as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import funnel, series
from tallyloom.plans.charts import LINE_SQL, rounded, supplier_lines
from tallyloom.plans.register import query

STAGES = 40
KEYS = ["l_suppkey", "run"]


def throws(spark, sf_dir: str) -> DataFrame:
    """(l_suppkey, run, t, score, e)."""
    li = supplier_lines(spark, sf_dir)
    score = F.pmod("l_partkey", F.lit(6)) + 1 + F.pmod("l_orderkey", F.lit(6)) + 1
    out = li.select("l_suppkey", F.floor(F.col("i") / STAGES).alias("run"), (F.col("i") % STAGES + 1).cast("long").alias("t"), score.alias("score"))
    return out.withColumn("e", funnel.displacement(F.col("score")))


_THROWS = f"{LINE_SQL}, x AS (SELECT l_suppkey, i // {STAGES} AS run, i % {STAGES} + 1 AS t, l_partkey % 6 + l_orderkey % 6 + 2 - 7 AS e FROM li)"
#: The recurrences, stage by stage.
_RUN = f"""WITH RECURSIVE {_THROWS},
r AS (SELECT l_suppkey, run, rule, 1::BIGINT AS t, e::BIGINT AS e, 30::BIGINT AS aim, (30 + e)::BIGINT AS rest FROM x, (VALUES (1), (2), (3), (4)) AS v(rule) WHERE t = 1
      UNION ALL
      SELECT x.l_suppkey, x.run, rule, x.t::BIGINT, x.e::BIGINT, a.aim, a.aim + x.e FROM (SELECT l_suppkey, run, rule, t, CASE rule WHEN 1 THEN 30 WHEN 2 THEN aim - (rest - 30) WHEN 3 THEN 60 - rest ELSE rest END AS aim FROM r) a
      JOIN x ON x.l_suppkey = a.l_suppkey AND x.run = a.run AND x.t = a.t + 1)"""


def _rule(n: int):
    @query(f"{_RUN} SELECT l_suppkey, run, t, e, rest FROM r WHERE rule = {n}", name=f"funnel_rule_{n}")
    def run(spark, sf_dir):
        return funnel.run(throws(spark, sf_dir).drop("score"), KEYS, n)

    return run


for _n in funnel.RULES:
    _rule(_n)


@query(
    f"""{_RUN} SELECT l_suppkey, run, t, e, rest AS marble, aim AS funnel_before, rest - 30 AS relative,
    CASE WHEN e < 0 THEN (-e)::VARCHAR || 'L' WHEN e > 0 THEN e::VARCHAR || 'R' ELSE '↓' END AS direction, 60 - rest AS funnel_after FROM r WHERE rule = 3"""
)
def funnel_stages(spark, sf_dir):
    return funnel.stages(throws(spark, sf_dir).drop("score"), KEYS, 3)


@query(f"{_RUN} SELECT l_suppkey, run, rule, floor(avg(rest) * 100 + 0.5::DOUBLE) / 100 AS mean, floor(stddev_samp(rest) * 100 + 0.5::DOUBLE) / 100 AS sd, min(rest)::DOUBLE AS low, max(rest)::DOUBLE AS high, (max(rest) - min(rest))::DOUBLE AS \"range\" FROM r GROUP BY 1, 2, 3")
def funnel_summary(spark, sf_dir):
    return funnel.summary(funnel.all_rules(throws(spark, sf_dir), KEYS), [*KEYS, "rule"])


@query(f'{_RUN} SELECT l_suppkey, run, rule, least(min(rest) - 2, 20)::DOUBLE AS "left", greatest(max(rest) + 2, 40)::DOUBLE AS "right" FROM r GROUP BY 1, 2, 3')
def funnel_track_range(spark, sf_dir):
    return funnel.track_range(funnel.all_rules(throws(spark, sf_dir), KEYS), [*KEYS, "rule"])


@query(f"{_RUN}, b AS (SELECT *, lag(rest) OVER (PARTITION BY l_suppkey, run, rule ORDER BY t) AS p FROM r) SELECT l_suppkey, run, rule, round(nullif(corr(rest, p), 'NaN'::DOUBLE), 6) + 0.0 AS r FROM b WHERE p IS NOT NULL GROUP BY 1, 2, 3")
def lag1_autocorr(spark, sf_dir):
    return rounded(series.lag1_correlation(funnel.all_rules(throws(spark, sf_dir), KEYS), [*KEYS, "rule"], ["t"], "rest"))


@query(f"{_RUN}, b AS (SELECT *, t <= count(*) OVER (PARTITION BY l_suppkey, run, rule) // 2 AS first FROM r) SELECT l_suppkey, run, rule, round(stddev_samp(rest) FILTER (NOT first) / nullif(stddev_samp(rest) FILTER (first), 0), 6) AS ratio FROM b GROUP BY 1, 2, 3")
def half_sd_ratio(spark, sf_dir):
    return rounded(series.half_ratio(funnel.all_rules(throws(spark, sf_dir), KEYS), [*KEYS, "rule"], "rest"))


@query(f"{_RUN} SELECT l_suppkey, run, rule, floor(rest - 19.5)::BIGINT AS bin, count(*) AS count FROM r GROUP BY ALL")
def rules_histogram(spark, sf_dir):
    from tallyloom.operators.histograms import histogram

    return histogram(funnel.all_rules(throws(spark, sf_dir), KEYS), [*KEYS, "rule"], "rest", 1.0, 19.5).drop("low", "high")


@query(f"WITH {_THROWS} SELECT l_suppkey, run, t, e FROM x WHERE t <= 12")
def funnel_revealed(spark, sf_dir):
    return throws(spark, sf_dir).where("t <= 12").drop("score")


@query(
    f"""{_RUN} SELECT l_suppkey, run, CASE WHEN t <= 14 THEN 1 WHEN t <= 27 THEN 2 ELSE 3 END AS block, {', '.join(f"max(rest) FILTER (t - CASE WHEN t <= 14 THEN 0 WHEN t <= 27 THEN 14 ELSE 27 END = {i})::VARCHAR AS place_{i}" for i in range(1, 15))}
    FROM r WHERE rule = 2 GROUP BY 1, 2, 3"""
)
def funnel_blocks(spark, sf_dir):
    b = funnel.blocks(funnel.stages(throws(spark, sf_dir), KEYS, 2), KEYS, ["marble"])
    return b.select(*KEYS, "block", *[F.col(f"`{i}`").alias(f"place_{i}") for i in range(1, 15)])


@query("SELECT f.f AS funnel, m.m AS marble, f.f - (m.m - 30) AS rule_2, 60 - m.m AS rule_3 FROM range(20, 41) f(f), range(20, 41) m(m)")
def funnel_rule_comparison(spark, sf_dir):
    track = spark.range(20, 41)
    both = track.select(F.col("id").alias("funnel"), F.explode(F.sequence(F.lit(20).cast("long"), F.lit(40).cast("long"))).alias("marble"))
    return funnel.next_aims(both)
