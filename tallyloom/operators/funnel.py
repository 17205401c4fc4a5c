"""The four rules of the feedback experiment, as window expressions over an input of disturbances.

A stage has a disturbance e; the marble rests at the aim plus e; a rule sets the next aim.  The recurrences have closed
forms, so that a series is a window aggregation and not a loop:
rule 1 rests at target + e; rule 2 at target + e - (e before); rule 3 at target + d with d = e - (d before), an
alternating running sum; rule 4 at target + the running sum of e.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET = 30
RULES = (1, 2, 3, 4)
LOW, HIGH = 20, 40


def displacement(score: Column) -> Column:
    """Two dice's score to steps: score - 7; null outside 2..12."""
    return F.when(score.between(2, 12), score - 7)


def direction(steps: Column) -> Column:
    """3L, 4R or a down arrow."""
    return F.when(steps < 0, F.concat((-steps).cast("string"), F.lit("L"))).when(steps > 0, F.concat(steps.cast("string"), F.lit("R"))).when(steps == 0, F.lit("↓"))


def resting(keys: list[str], rule: int, target: float = TARGET, e: str = "e", t: str = "t") -> Column:
    """Where the marble rests, for a series with stages t = 1, 2, ... without gaps."""
    if rule not in RULES:
        raise ValueError(f"no rule {rule}")
    w = Window.partitionBy(*keys).orderBy(t)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    if rule == 1:
        return F.lit(target) + F.col(e)
    if rule == 2:
        return F.lit(target) + F.col(e) - F.coalesce(F.lag(e).over(w), F.lit(0))
    if rule == 3:
        sign = F.when(F.col(t) % 2 == 1, F.lit(-1)).otherwise(F.lit(1))
        return F.lit(target) + sign * F.sum(sign * F.col(e)).over(so_far)
    return F.lit(target) + F.sum(e).over(so_far)


def run(df: DataFrame, keys: list[str], rule: int, target: float = TARGET) -> DataFrame:
    """df(keys..., t, e) with rest."""
    return df.withColumn("rest", resting(keys, rule, target))


def stages(df: DataFrame, keys: list[str], rule: int, target: int = TARGET) -> DataFrame:
    """df(keys..., t, e) with funnel_before, marble, relative, direction and funnel_after."""
    out = df.withColumn("marble", resting(keys, rule, target)).withColumn("funnel_before", F.col("marble") - F.col("e"))
    off = F.col("marble") - target
    after = {1: F.lit(target), 2: F.col("funnel_before") - off, 3: target - off, 4: F.col("marble")}[rule]
    return out.withColumns({"relative": off, "direction": direction(F.col("e")), "funnel_after": after.cast("long")})


def all_rules(df: DataFrame, keys: list[str], target: float = TARGET) -> DataFrame:
    """One row for each stage and rule: (keys..., t, e, rule, rest); the four rules share one window."""
    rests = F.array(*[F.struct(F.lit(r).alias("rule"), resting(keys, r, target).cast("double").alias("rest")) for r in RULES])
    return df.withColumn("_r", rests).withColumn("_r", F.explode("_r")).select(*df.columns, "_r.rule", "_r.rest")


def summary(rests: DataFrame, keys: list[str]) -> DataFrame:
    """(keys..., mean, sd, low, high, range) rounded to two places."""
    two = lambda c: F.floor(c * 100 + 0.5) / 100
    return rests.groupBy(*keys).agg(two(F.avg("rest")).alias("mean"), two(F.stddev_samp("rest")).alias("sd"), F.min("rest").alias("low"), F.max("rest").alias("high"), (F.max("rest") - F.min("rest")).alias("range"))


def track_range(rests: DataFrame, keys: list[str], pad: int = 2) -> DataFrame:
    """(keys..., left, right): what a picture of the track has to show, LOW to HIGH at least."""
    return rests.groupBy(*keys).agg(F.least(F.min("rest") - pad, F.lit(float(LOW))).alias("left"), F.greatest(F.max("rest") + pad, F.lit(float(HIGH))).alias("right"))


def next_aims(df: DataFrame, target: int = TARGET) -> DataFrame:
    """df(funnel, marble) with the next aims of rules 2 and 3; an error outside the track."""
    inside = F.col("funnel").between(LOW, HIGH) & F.col("marble").between(LOW, HIGH)
    checked = F.when(inside, F.col("marble")).otherwise(F.raise_error(F.lit("outside the track")).cast("int"))
    return df.withColumns({"rule_2": F.col("funnel") - (checked - target), "rule_3": 2 * target - checked})


def blocks(staged: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """The book-keeping tables: stages 1-14, 15-27 and 28-40 as blocks, a row for each value, a column for each place."""
    block = F.when(F.col("t") <= 14, 1).when(F.col("t") <= 27, 2).otherwise(3)
    place = F.col("t") - F.element_at(F.array(F.lit(0), F.lit(14), F.lit(27)), block)
    long = staged.select(*keys, block.alias("block"), place.cast("int").alias("place"), F.posexplode(F.array(*[F.col(v).cast("string") for v in values])).alias("pos", "shown"))
    named = long.withColumn("row", F.element_at(F.array(*[F.lit(v) for v in values]), F.col("pos") + 1))
    return named.groupBy(*keys, "block", "row").pivot("place", list(range(1, 15))).agg(F.first("shown"))


# Two recorded sequences of dice, stages 6 to 40; stages 1 to 5 have the scores 10 8 6 7 4 in both.
FIRST_SCORES = (10, 8, 6, 7, 4)
RECORDED = {
    "A": "64 24 45 45 13 56 63 35 64 35 22 52 42 24 66 46 53 43 25 63 56 63 51 61 21 22 36 53 66 53 46 65 34 36 56",
    "B": "35 36 44 13 11 41 53 16 45 12 54 14 61 12 13 54 65 61 43 66 15 63 44 52 44 14 61 32 55 56 62 13 46 63 31",
}


def recorded(spark) -> DataFrame:
    """(seq, t, score, e) of the recorded sequences, 40 stages each."""
    rows = [(seq, t, s, s - 7) for seq, pairs in RECORDED.items() for t, s in enumerate([*FIRST_SCORES, *(int(p[0]) + int(p[1]) for p in pairs.split())], 1)]
    return spark.createDataFrame(rows, "seq string, t long, score int, e int")


def dice(spark, seed: int = 0, rolls: int = 40, fixed: tuple[int, ...] = FIRST_SCORES) -> DataFrame:
    """(t, die1, die2): seeded rolls of two dice after a fixed beginning, which is split as evenly as dice allow."""
    roll = lambda k: (F.rand(seed + k) * 6).cast("int") + 1
    df = spark.range(rolls).select((F.col("id") + 1).alias("t"), roll(1).alias("a"), roll(2).alias("b"))
    given = F.col("t") <= len(fixed)
    score = F.element_at(F.array(*[F.lit(s) for s in fixed]), F.least(F.col("t"), F.lit(len(fixed))).cast("int"))
    first = F.greatest(F.lit(1), F.least(F.lit(6), F.ceil(score / 2))).cast("int")
    return df.select("t", F.when(given, first).otherwise(F.col("a")).alias("die1"), F.when(given, score - first).otherwise(F.col("b")).alias("die2"))
