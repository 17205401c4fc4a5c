"""Queries: two-way tables and ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators import tables
from tallyloom.plans.register import query, table

QUARTERS = [1, 2, 3, 4]


def cells(spark, sf_dir: str, by: Column, name: str) -> DataFrame:
    """All orders, counted by their customers' nation and by a column, where there are any."""
    o = table(spark, sf_dir, "orders").select("o_custkey", by.alias(name))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    return o.join(c, "o_custkey").groupBy("nation", name).agg(F.count(F.lit(1)).alias("orders"))


def _cells_sql(by: str, name: str) -> str:
    return f"""c AS (SELECT c_nationkey AS nation, {by} AS {name}, count(*) AS orders FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
g AS (SELECT * FROM (SELECT DISTINCT nation FROM c), (SELECT DISTINCT {name} FROM c)), f AS (SELECT nation, {name}, orders FROM g LEFT JOIN c USING (nation, {name}))"""


@query(f"WITH {_cells_sql('o_orderdate::DATE', 'day')} SELECT nation, day, CASE WHEN count(orders) = count(*) THEN sum(orders)::BIGINT END AS orders FROM f GROUP BY CUBE (nation, day)")
def strict_totals_table(spark, sf_dir):
    """Days on which a nation orders nothing are missing cells, which void the totals."""
    return tables.with_totals(cells(spark, sf_dir, F.to_date("o_orderdate"), "day"), "nation", "day", "orders")


@query(
    f"""WITH {_cells_sql('quarter(o_orderdate)::INT', 'quarter')}, p AS (SELECT nation, {', '.join(f"any_value(orders) FILTER (quarter = {q}) AS q{q}" for q in QUARTERS)} FROM f GROUP BY 1),
    b AS (SELECT *, q1 + q2 + q3 + q4 AS total FROM p)
    SELECT nation, q1, q2, q3, q4, total FROM b UNION ALL
    SELECT NULL, {', '.join(f"CASE WHEN count(q{q}) = count(*) THEN sum(q{q})::BIGINT END" for q in QUARTERS)}, CASE WHEN count(total) = count(*) THEN sum(total)::BIGINT END FROM b"""
)
def worker_day_table(spark, sf_dir):
    p = tables.pivoted(cells(spark, sf_dir, F.quarter("o_orderdate"), "quarter"), "nation", "quarter", "orders", QUARTERS)
    return p.select("nation", *[F.col(f"`{q}`").alias(f"q{q}") for q in QUARTERS], "total")


def ratings(spark, sf_dir: str, options: int = 6) -> DataFrame:
    """A rating for each (area, option, column) that line items give: the one of the smallest order."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 4).cast("int").alias("area"), (F.col("l_partkey") % options).cast("int").alias("option"), (F.col("l_orderkey") % 4).cast("int").alias("col"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    least = li.groupBy("area", "option", "col").agg(F.min(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("m"))
    r = F.pmod(F.col("m.l_partkey") + F.col("m.l_orderkey") + F.col("m.l_linenumber"), F.lit(8)).cast("int")
    return least.select("area", "option", "col", F.get(F.array(*[F.lit(c) for c in tables.CYCLE]), r).alias("rating"))


def _ratings_sql(options: int = 6, name: str = "r") -> str:
    return f"""{name}0 AS (SELECT (l_suppkey % 4)::INT AS area, (l_partkey % {options})::INT AS option, (l_orderkey % 4)::INT AS col, l_partkey AS p, l_orderkey AS o, l_linenumber AS l, row_number() OVER (PARTITION BY l_suppkey % 4, l_partkey % {options}, l_orderkey % 4 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
    {name}1 AS (SELECT area, option, col, (['+', '++', '+++', '0', '-', '--', '---'])[((p + o + l) % 8 + 1)::INT] AS rating FROM {name}0 WHERE n = 1),
    {name} AS (SELECT *, CASE rating WHEN '+' THEN 1 WHEN '++' THEN 2 WHEN '+++' THEN 3 WHEN '-' THEN -1 WHEN '--' THEN -2 WHEN '---' THEN -3 ELSE 0 END AS w FROM {name}1)"""


@query(f"WITH {_ratings_sql()}, s AS (SELECT area, option, col, sum(w)::BIGINT AS net FROM r GROUP BY GROUPING SETS ((area, option), (col), ())) SELECT *, CASE WHEN net > 0 THEN repeat('+', net::INT) WHEN net < 0 THEN repeat('−', (-net)::INT) ELSE '0' END AS effect FROM s")
def rating_net_effects(spark, sf_dir):
    return tables.net_effects(ratings(spark, sf_dir))


@query(f"WITH {_ratings_sql()}, s AS (SELECT area, option, sum(w)::BIGINT AS net FROM r GROUP BY 1, 2 HAVING sum(w) > 0) SELECT *, row_number() OVER (PARTITION BY area ORDER BY option) AS number FROM s")
def rating_positive_rows(spark, sf_dir):
    return tables.positive_rows(ratings(spark, sf_dir))


@query(
    f"""WITH {_ratings_sql()}, {_ratings_sql(9, 'q')},
    a AS (SELECT area, option, sum(w)::BIGINT AS net, 0 AS origin FROM r GROUP BY 1, 2 HAVING sum(w) > 0 UNION ALL SELECT area, option, sum(w)::BIGINT, 1 FROM q GROUP BY 1, 2 HAVING sum(w) > 0)
    SELECT *, row_number() OVER (PARTITION BY area ORDER BY origin, option) AS number FROM a"""
)
def rating_union(spark, sf_dir):
    return tables.joined_rows(tables.positive_rows(ratings(spark, sf_dir)), tables.positive_rows(ratings(spark, sf_dir, 9)))


@query(f"WITH {_ratings_sql()} SELECT area, option, col, rating FROM r WHERE area <> col")
def rating_own_area(spark, sf_dir):
    return tables.own_hidden(ratings(spark, sf_dir))


@query(f"WITH {_ratings_sql()} SELECT area, option, col, rating, CASE rating WHEN '+' THEN '++' WHEN '++' THEN '+++' WHEN '+++' THEN '0' WHEN '0' THEN '-' WHEN '-' THEN '--' WHEN '--' THEN '---' ELSE '+' END AS following FROM r")
def rating_cycle(spark, sf_dir):
    return ratings(spark, sf_dir).withColumn("following", tables.next_rating(F.col("rating")))


@query(f"""WITH {_ratings_sql()}, {_ratings_sql(9, 'q')} SELECT q.area, q.option, q.col, coalesce(CASE WHEN q.area <> q.col THEN r.rating END, q.rating) AS rating FROM q LEFT JOIN r ON r.area = q.area AND r.option = q.option AND r.col = q.col""")
def rating_copy(spark, sf_dir):
    return tables.copied(ratings(spark, sf_dir, 9), tables.own_hidden(ratings(spark, sf_dir)))
