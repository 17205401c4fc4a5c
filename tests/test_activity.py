"""Active time of ticks that are finer than a millisecond."""

from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from tallyloom.operators import ledger
from tallyloom.plans import registry

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_ticks_are_rounded(spark):
    times = {"2024-01-01 00:00:00.000499": 1704067200000, "2024-01-01 00:00:00.0005": 1704067200001, "2024-01-01 00:00:00.001499": 1704067200001, "1969-12-31 23:59:59.9996": 0, "1969-12-31 23:59:59.9995": -1, "9999-12-31 23:59:59.9985": 253402300799999}
    text = spark.createDataFrame([(t,) for t in times], "t string")
    for kind in ("timestamp_ntz", "timestamp", "string"):
        df = text.withColumn("ts", F.col("t").cast(kind))
        assert {r.t: r.ms for r in df.select("t", ledger.epoch_ms(df, "ts").alias("ms")).collect()} == times


def test_time_without_zone(spark):
    df = spark.createDataFrame([(1, "2024-03-10 01:59:59"), (2, "2024-03-10 03:00:01")], "i int, t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert ledger.active_time(df.withColumn("u", F.lit(1)), ["u"], "ts", ["i"], 10_000_000, 10_000_000).first().active_ms == 3_602_000
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_active_time_query(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(2 * i, start + timedelta(hours=i, microseconds=us), 1, "view", 1.0, None) for i, us in enumerate((499, 500, 1_499, 1_600))]
    spark.createDataFrame(rows, EVENT_SCHEMA).write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in registry.QUERIES["active_time"](spark, str(tmp_path)).select("user_id", "device", "active_ms").collect()] == [(1, 0, 3 * 3_600_000 + 2)]


def merged_rows(spark, folder):
    return [tuple(r) for r in registry.QUERIES["ledger_merge"](spark, str(folder)).select("user_id", "first_seen", "n_days", "n_chapters", "max_day", "acts", "active_ms").collect()]


def test_ledger_merge_query(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(2 * i, start + timedelta(minutes=110 * i, microseconds=us), 1, "purchase", 1.0, None) for i, us in enumerate((499, 500, 1_499, 1_600))]
    spark.createDataFrame(rows, EVENT_SCHEMA).write.parquet(f"{tmp_path}/events.parquet")
    assert merged_rows(spark, tmp_path) == [(1, "2024-01-01", 1, 3, 7, 4, 3 * 6_600_000 + 2)]


def test_ledger_merge_without_keys(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [(1, at, 1, "purchase", 1.0, None), (None, at, 1, "purchase", 1.0, None), (None, at, 2, "view", 1.0, None), (3, None, 3, "purchase", 1.0, None), (5, at, None, "view", 1.0, None), (2, at, 4, None, None, None), (4, None, 4, "view", None, None)]
    spark.createDataFrame(rows, EVENT_SCHEMA).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet/*.parquet')")
    want = [(1, "2024-01-01", 1, 1, 2, 2, 3_600_000), (4, "2024-01-01", 1, 2, 5, 0, 7_200_000)]
    assert sorted(con.execute(registry.ORACLES["ledger_merge"]).fetchall()) == sorted(merged_rows(spark, tmp_path)) == want


def test_dates_as_sql_has_them(spark, tmp_path):
    """A day that the session's zone left out, and years that are not of four digits."""
    con = duckdb.connect()
    times = ["2011-12-29 23:59:59", "2011-12-30 00:00:00", "2011-12-30 12:00:00", "2011-12-31 00:00:00", "10000-01-02 03:04:05", "0999-12-31 00:00:00", "0002-03-04 (BC) 05:06:07", "0001-03-04 (BC) 05:06:07", None]
    con.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    con.executemany("insert into events values (?, ?::timestamp, ?, 'view', 1.0, null)", [(i, t, u) for i, t in enumerate(times) for u in (0, i // 4 + 1)])
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    want = sorted(con.execute(registry.ORACLES["ledger_merge"]).fetchall())
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "Pacific/Apia"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert sorted(merged_rows(spark, tmp_path)) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert [r[:3] for r in want] == [(0, "-1-03-04", 7), (1, "2011-12-29", 3), (2, "-1-03-04", 4)]


def test_far_times(spark, tmp_path):
    """Times of any year; seconds since 1970 of more than twelve digits failed."""
    con = duckdb.connect()
    times = ["33658-09-27 01:46:41", "33658-09-27 03:46:40.9995", "294247-01-10 03:00:00.0005", "294247-01-10 04:00:00.0005", "200000-03-04 (BC) 05:06:07.0015", "200000-03-04 (BC) 06:06:07.001", "2024-01-01 00:00:00"]
    con.execute("create table events (event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar)")
    con.executemany("insert into events values (?, ?::timestamp, ?, 'view', 1.0, null)", [(2 * i, t, u) for i, t in enumerate(times) for u in (0, i // 2 + 1)])
    con.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    got = registry.QUERIES["active_time"](spark, str(tmp_path)).select("user_id", "device", "active_ms").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.ORACLES["active_time"]).fetchall())
    assert sorted(merged_rows(spark, tmp_path)) == sorted(con.execute(registry.ORACLES["ledger_merge"]).fetchall())
