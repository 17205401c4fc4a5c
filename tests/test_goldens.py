"""Published and recorded values: literal inputs with the figures that belong to them."""

import math

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import normal
from tallyloom.operators import funnel, limits, series, studies, tables
from tallyloom.sources import readers

SERIES = {
    "sales": [13, 19, 18, 14, 16, 12, 21, 18, 17, 22],
    "first_process": [11, 10, 11, 11, 12, 11, 13, 13, 14, 13, 14, 13, 13, 15, 14, 15, 15, 16, 17, 16, 17, 18, 17, 19],
    "commute": [21, 18, 20, 20, 22, 23, 19, 21, 19, 17],
    "beads_a": [7, 10, 11, 11, 12, 11, 11, 8, 10, 9, 12, 15, 3, 10, 10, 10, 9, 6, 6, 13, 10, 6, 14, 11],
    "beads_b": [9, 6, 7, 8, 9, 11, 8, 8, 5, 4, 3, 13, 10, 12, 10, 9, 8, 10, 13, 7, 8, 10, 7, 8],
    "beads_c": [16, 9, 9, 11, 15, 11, 10, 10, 12, 12, 9, 9, 10, 15, 8, 7, 11, 10, 11, 13, 13, 17, 13, 9],
}


@pytest.fixture(scope="module")
def points(spark):
    return readers.literal_series(spark, SERIES)


@pytest.fixture(scope="module")
def ranged(points):
    return series.moving_ranges(series.number(points.withColumnRenamed("t", "nth"), ["series_id"], ["nth"], "value"))


@pytest.mark.parametrize(
    "name, baseline, want",
    [("sales", None, (17.0, 3.8889, 6.6556, 27.3444)), ("first_process", 12, (12.1667, 0.9091, 9.7485, 14.5848)), ("first_process", None, (14.0833, 0.9565, 11.5390, 16.6277)), ("commute", None, (20.0, 2.0, 14.68, 25.32))],
)
def test_individuals(ranged, name, baseline, want):
    r = limits.individuals(ranged.where(F.col("series_id") == name), ["series_id"], baseline).first()
    assert (r.central, r.mr_bar, r.lcl, r.ucl) == pytest.approx(want, abs=5e-5)


def test_signals_beyond_a_baseline(points, ranged):
    one = points.where("series_id = 'first_process'")
    found = limits.signals(one, limits.individuals(ranged, ["series_id"], 12), ["series_id"]).where("signal")
    assert sorted(r.t for r in found.collect()) == [14, 16, 17, 18, 19, 20, 21, 22, 23, 24]


def test_medians(ranged):
    r = limits.median_individuals(ranged.where("series_id = 'sales'"), ["series_id"]).first()
    assert (r.central, r.mr_median, r.lcl, r.ucl) == pytest.approx((17.5, 4, 4.92, 30.08), abs=5e-3)


@pytest.mark.parametrize("name, want", [("beads_a", (9.7917, 1.3734, 18.2099)), ("beads_b", (8.4583, 0.5055, 16.4111)), ("beads_c", (11.25, 2.3917, 20.1083))])
def test_np_chart(points, name, want):
    r = limits.counts(points.where(F.col("series_id") == name), ["series_id"], 50).first()
    assert (r.central, r.lcl, r.ucl) == pytest.approx(want, abs=5e-5)


def test_p_chart(spark):
    r = limits.proportions(spark.createDataFrame([(35, 400)], "hits int, n int"), [], 225, "hits", "n").first()
    assert (r.central, r.lcl, r.ucl) == pytest.approx((0.0875, 0.03099, 0.14401), abs=5e-6)


def test_fixed_chart(points):
    one = points.where("series_id = 'beads_c'")
    assert limits.signals(one, limits.fixed(one, ["series_id"], 1.4, 18.2), ["series_id"]).where("signal").count() == 0
    assert [r.t for r in limits.signals(one, limits.fixed(one, ["series_id"], 1.4, 16.5), ["series_id"]).where("signal").collect()] == [22]


def test_subgroups(spark):
    df = spark.createDataFrame([(1, v) for v in (1.4, 1.2, 2.1, 1.8, 1.2)], "g int, value double").withColumn("k", F.lit(0))
    s = limits.range_sigma(limits.subgroups(df, ["k"], "g")).first()
    assert (s.n, s["mean"], s.range, s.sigma) == pytest.approx((5, 1.54, 0.9, 0.387), abs=5e-4)
    assert limits.absolute_deviation(df, ["k"]).first().mad == pytest.approx(0.328, abs=5e-4)
    groups = spark.createDataFrame([(0, 5, 15.9018, 0.0130)], "k int, n long, mean double, range double")
    r = limits.means_and_ranges(groups, ["k"], 5).first()
    assert (r.lcl, r.ucl, r.range_ucl) == pytest.approx((15.8943, 15.9093, 0.0275), abs=5e-5)


#: mean, deviation, smallest, largest and range over 40 stages.
FUNNEL = {
    ("A", 1): (31.00, 2.32, 26, 35, 9), ("A", 2): (30.10, 3.09, 25, 37, 12), ("A", 3): (30.57, 3.43, 24, 38, 14), ("A", 4): (45.92, 10.70, 30, 70, 40),
    ("B", 1): (30.07, 2.45, 25, 35, 10), ("B", 2): (29.93, 3.38, 24, 36, 12), ("B", 3): (30.23, 11.28, 12, 50, 38), ("B", 4): (27.82, 4.96, 16, 36, 20),
}


def test_recorded_dice(spark):
    rests = funnel.all_rules(funnel.recorded(spark), ["seq"])
    got = {(r.seq, r.rule): (r["mean"], r.sd, r.low, r.high, r.range) for r in funnel.summary(rests, ["seq", "rule"]).collect()}
    assert set(got) == set(FUNNEL)
    for key, want in FUNNEL.items():
        assert got[key] == pytest.approx(want, abs=0.0101)


def test_funnel_cases(spark):
    d = spark.createDataFrame([(2,), (7,), (12,), (1,), (13,)], "s int").select("s", funnel.displacement(F.col("s")).alias("e"))
    assert {r.s: r.e for r in d.collect()} == {2: -5, 7: 0, 12: 5, 1: None, 13: None}
    shown = spark.createDataFrame([(-3,), (4,), (0,)], "e int").select(funnel.direction(F.col("e")).alias("d"))
    assert [r.d for r in shown.collect()] == ["3L", "4R", "↓"]
    r = funnel.next_aims(spark.createDataFrame([(27, 28)], "funnel int, marble int")).first()
    assert (r.rule_2, r.rule_3) == (29, 32)
    with pytest.raises(Exception, match="outside the track"):
        funnel.next_aims(spark.createDataFrame([(19, 28)], "funnel int, marble int")).collect()


BEADS = [(16, 9, 4, 7, 9, 9), (10, 11, 9, 11, 17, 7), (7, 12, 13, 14, 9, 12), (6, 10, 11, 11, 13, 7)]


def _cells(spark, days):
    return spark.createDataFrame([(w, d, v) for d, day in enumerate(days, 1) for w, v in enumerate(day, 1)], "worker int, day int, reds int")


def test_bead_table(spark):
    got = {(r.worker, r.day): r.reds for r in tables.with_totals(_cells(spark, BEADS), "worker", "day", "reds").collect()}
    assert [got[None, d] for d in (1, 2, 3, 4)] == [54, 65, 67, 58] and [got[w, None] for w in range(1, 7)] == [39, 42, 37, 43, 48, 35] and got[None, None] == 244
    missing = [BEADS[0], (10, None, 9, 11, 17, 7)]
    for cells in (_cells(spark, missing), _cells(spark, missing).where("reds is not null")):
        got = {(r.worker, r.day): r.reds for r in tables.with_totals(cells, "worker", "day", "reds").collect()}
        assert (got[None, 1], got[None, 2], got[2, None], got[1, None], got[None, None]) == (54, None, None, 26, None)
    wide = {r.worker: r.total for r in tables.pivoted(_cells(spark, missing), "worker", "day", "reds", [1, 2]).collect()}
    assert wide[2] is None and wide[1] == 26 and wide[None] is None


def test_errors(spark, ranged):
    with pytest.raises(ValueError):
        limits.individuals(ranged, ["series_id"], 1)
    with pytest.raises(ValueError):
        limits.means_and_ranges(ranged, ["series_id"], 7)
    with pytest.raises(ValueError):
        funnel.resting(["k"], 5)


def test_normal_distribution(spark):
    z = [k / 8 for k in range(-40, 41)]
    got = {r.z: r.p for r in spark.createDataFrame([(x,) for x in z], "z double").select("z", normal.cdf(F.col("z")).alias("p")).collect()}
    assert all(abs(got[x] - 0.5 * (1 + math.erf(x / math.sqrt(2)))) < 1.5e-7 for x in z)
    assert (got[1.0], got[1.5]) == pytest.approx((0.8413, 0.9332), abs=5e-5)


def test_counting_distributions(spark):
    x = spark.range(101).withColumnRenamed("id", "x")
    r = x.select("x", normal.binomial_pmf(F.col("x"), 100, 0.2).alias("b"), normal.hypergeometric_pmf(F.col("x"), 10, 30, 100).alias("h")).collect()
    assert r[22].b == pytest.approx(0.0849, abs=5e-5) and sum(r[k].b for k in range(18, 26)) == pytest.approx(0.6413, abs=5e-5)
    assert all(row.h == pytest.approx(math.comb(30, row.x) * math.comb(70, 10 - row.x) / math.comb(100, 10) if row.x <= 10 else 0, rel=1e-9, abs=1e-15) for row in r)
    one = spark.range(1).select(studies.normal_approximation(F.lit(22), F.lit(22), F.lit(100), F.lit(0.2)).alias("a"), studies.normal_approximation(F.lit(18), F.lit(25), F.lit(100), F.lit(0.2)).alias("b")).first()
    assert (one.a, one.b) == pytest.approx((0.0878, 0.6495), abs=2e-4)


#: baseline: false alarms after it and within it, in percent; run lengths after shifts of one to three sigmas.
STUDY = {4: (7.65, 0, 7.1, 3.21, 1.888), 6: (4.28, 1.3, 10.1, 3.73, 1.949), 10: (2.17, 2.1, 14.9, 4.35, 1.992), 20: (0.99, 4.8, 23.1, 5.14, 2.028)}


def test_baseline_study(spark):
    got = {r.baseline: r for r in studies.baseline_study(spark, list(STUDY), 6000, 20, seed=7).collect()}
    for b, (outside, inside, *runs) in STUDY.items():
        assert 100 * got[b].outside == pytest.approx(outside, rel=0.1) and 100 * got[b].inside == pytest.approx(inside, rel=0.25, abs=0.01)
        assert [got[b][f"arl_{s}"] for s in (1, 2, 3)] == pytest.approx(runs, rel=0.05)
