"""Registered queries on small tables against brute force: every row of the input counts, however large its group."""

import math
import statistics
from collections import Counter

import pytest

from tallyloom.plans import registry


LINE_SCHEMA = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate timestamp"


def lines(sizes):
    """Line items in their order: {supplier: how many}."""
    return [(k, k * k % 11, s, 1, float(k % 3), 1.0, "N", None) for s, n in sizes.items() for k in range(n)]


@pytest.fixture
def folder(spark, tmp_path):
    """Writes tables given as (name, rows, schema); returns their folder."""

    def write(*tables):
        for name, rows, schema in tables:
            spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_weighted_bins_expanded(spark, folder):
    sizes = [7] * 30 + [3] * 8 + [5]
    sf_dir = folder(("part", [(i, s) for i, s in enumerate(sizes)], "p_partkey long, p_size int"))
    got = Counter((r.position, r.level) for r in registry.QUERIES["weighted_bins_expanded"](spark, sf_dir).collect())
    assert got == Counter((s, level) for s, n in Counter(sizes).items() for level in range(1, n + 1))


def test_stacked_boxes(spark, folder):
    rows = lines({1: 230, 2: 100, 3: 1})
    sf_dir = folder(("lineitem", rows, LINE_SCHEMA))
    want, height = set(), Counter()
    for k, _, supplier, _, value, *_ in rows:
        height[supplier, value] += 1
        want.add((supplier, value, k, height[supplier, value]))
    got = [(r.l_suppkey, r.value, r.i, r.level) for r in registry.QUERIES["stacked_boxes"](spark, sf_dir).collect()]
    assert len(got) == len(rows) and set(got) == want


@pytest.fixture(scope="module")
def runs(spark, tmp_path_factory):
    """A folder of line items, and {(supplier, run): the displacements}: full runs, short ones, and ones without variance."""
    root = str(tmp_path_factory.mktemp("runs"))
    rows = lines({1: 125, 2: 40, 3: 41, 4: 3, 5: 86})
    rows += [(k, 6, 6, 1, 1.0, 1.0, "N", None) for k in range(0, 6 * 44, 6)]
    spark.createDataFrame(rows, LINE_SCHEMA).write.parquet(f"{root}/lineitem.parquet")
    of, at = {}, Counter()
    for order, part, supplier, *_ in rows:
        of.setdefault((supplier, at[supplier] // 40), []).append(part % 6 + order % 6 + 2 - 7)
        at[supplier] += 1
    return root, of


def rests(e, rule):
    aim, out = 30, []
    for step in e:
        out.append(aim + step)
        aim = {1: 30, 2: aim - (out[-1] - 30), 3: 60 - out[-1], 4: out[-1]}[rule]
    return out


def close(a, b):
    return a is None and b is None or a is not None and b is not None and math.isclose(a, b, abs_tol=2e-6)


@pytest.mark.parametrize("rule", [1, 2, 3, 4])
def test_funnel_rules(spark, runs, rule):
    root, of = runs
    got = {(r.l_suppkey, r.run, r.t): (r.e, r.rest) for r in registry.QUERIES[f"funnel_rule_{rule}"](spark, root).collect()}
    assert got == {(*key, t): (x, y) for key, e in of.items() for t, (x, y) in enumerate(zip(e, rests(e, rule)), 1)}


def test_funnel_stages_and_parts(spark, runs):
    root, of = runs
    take = lambda name: registry.QUERIES[name](spark, root).collect()
    assert {(r.l_suppkey, r.run, r.t): r.marble for r in take("funnel_stages")} == {(*key, t): y for key, e in of.items() for t, y in enumerate(rests(e, 3), 1)}
    assert {(r.l_suppkey, r.run, r.t): r.e for r in take("funnel_revealed")} == {(*key, t): x for key, e in of.items() for t, x in enumerate(e[:12], 1)}
    got = {(r.l_suppkey, r.run, r.block): [r[f"place_{i}"] for i in range(1, 15)] for r in take("funnel_blocks")}
    want = {}
    for key, e in of.items():
        for block, first, last in ((1, 0, 14), (2, 14, 27), (3, 27, 40)):
            if part := [str(y) for y in rests(e, 2)[first:last]]:
                want[*key, block] = part + [None] * (14 - len(part))
    assert got == want


def test_funnel_measures(spark, runs):
    root, of = runs
    take = lambda name: {(r.l_suppkey, r.run, r.rule): r for r in registry.QUERIES[name](spark, root).collect()}
    summary, track, ratio, lag1 = map(take, ("funnel_summary", "funnel_track_range", "half_sd_ratio", "lag1_autocorr"))
    bins = Counter({(r.l_suppkey, r.run, r.rule, r.bin): r["count"] for r in registry.QUERIES["rules_histogram"](spark, root).collect()})
    want = {(*key, rule): rests(e, rule) for key, e in of.items() for rule in (1, 2, 3, 4)}
    assert set(summary) == set(track) == set(ratio) == set(want)
    assert set(lag1) == {key for key, y in want.items() if len(y) > 1}
    assert bins == Counter((*key, math.floor(x - 19.5)) for key, y in want.items() for x in y)
    for key, y in want.items():
        deviation = lambda v: statistics.stdev(v) if len(v) > 1 else None
        two = lambda v: None if v is None else math.floor(v * 100 + 0.5) / 100
        s = summary[key]
        assert close(s.mean, two(statistics.mean(y))) and close(s.sd, two(deviation(y))) and (s.low, s.high, s.range) == (min(y), max(y), max(y) - min(y))
        assert (track[key].left, track[key].right) == (min(min(y) - 2, 20), max(max(y) + 2, 40))
        first, second = deviation(y[: len(y) // 2]), deviation(y[len(y) // 2 :])
        assert close(ratio[key].ratio, second / first if first and second is not None else None)
        if len(y) > 1:
            a, b = y[1:], y[:-1]
            flat = len(set(a)) == 1 or len(set(b)) == 1
            assert close(lag1[key].r, None if flat else statistics.correlation(a, b))
