"""Two-way tables with strict totals, and signed ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The ratings in the order in which they are cycled through, and what they count.
CYCLE = ("+", "++", "+++", "0", "-", "--", "---")
WORTH = {"+++": 3, "++": 2, "+": 1, "0": 0, "-": -1, "--": -2, "---": -3}


#: A two-way table with a cell for each row and column has at most so many columns; its rows are not limited.
MOST_COLUMNS = 10_000


def strict_sum(c: Column | str) -> Column:
    """A sum that is null unless every addend is there."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def with_totals(cells: DataFrame, row: str, column: str, value: str, complete: bool = True) -> DataFrame:
    """(row, column, value) with totals: a null row is the total of a column, a null column that of a row, both null
    the grand total.  complete: a cell that is not there counts as missing and voids its totals."""
    if complete:
        columns = [r[0] for r in cells.select(column).distinct().where(F.col(column).isNotNull()).limit(MOST_COLUMNS + 1).collect()]
        if len(columns) > MOST_COLUMNS:
            raise ValueError(f"a table of more than {MOST_COLUMNS} columns")
        kind = cells.schema[column].dataType
        grid = cells.select(row).distinct().select(row, F.explode(F.array(*[F.lit(c).cast(kind) for c in columns]) if columns else F.array().cast(f"array<{kind.simpleString()}>")).alias(column))
        cells = grid.join(cells, [row, column], "left")
    summed = cells.groupBy(row, column).agg(strict_sum(value).alias(value))
    return summed.cube(row, column).agg(strict_sum(value).alias(value))


def pivoted(cells: DataFrame, row: str, column: str, value: str, columns: list) -> DataFrame:
    """A row for each row with its total, and a last one of column totals (row null); totals are strict."""
    wide = cells.groupBy(row).pivot(column, columns).agg(F.first(value))
    named = [F.col(f"`{c}`") for c in columns]
    every = F.lit(True)
    for c in named:
        every = every & c.isNotNull()
    total = sum(named[1:], named[0])
    body = wide.withColumn("total", F.when(every, total))
    foot = body.agg(*[strict_sum(c).alias(str(n)) for c, n in zip(named, columns)], strict_sum("total").alias("total")).withColumn(row, F.lit(None).cast(body.schema[row].dataType))
    return body.unionByName(foot)


def worth(rating: Column) -> Column:
    """What a rating counts; a missing or unknown one counts 0."""
    out = F.lit(0)
    for text, n in WORTH.items():
        out = F.when(rating == text, F.lit(n)).otherwise(out)
    return out


def shown(net: Column) -> Column:
    """A net as repeated signs, 0 as 0; the sign of a negative net is U+2212."""
    return F.when(net > 0, F.repeat(F.lit("+"), net.cast("int"))).when(net < 0, F.repeat(F.lit("\u2212"), (-net).cast("int"))).otherwise(F.lit("0"))


def net_effects(ratings: DataFrame) -> DataFrame:
    """(area, option, col, net, effect) of (area, option, col, rating): by row (col null), by column (area and option
    null) and grand (all null), in one pass."""
    r = ratings.withColumn("worth", worth(F.col("rating")).cast("long"))
    sets = r.groupingSets([["area", "option"], ["col"], []], "area", "option", "col").agg(F.sum("worth").alias("net"))
    return sets.withColumn("effect", shown(F.col("net")))


def own_hidden(ratings: DataFrame) -> DataFrame:
    """The first table: how an area's options look to the other areas; its own column is blank."""
    return ratings.where(F.col("area") != F.col("col"))


def copied(target: DataFrame, source: DataFrame) -> DataFrame:
    """(area, option, col, rating): the target's cells with the source's ratings where it has one."""
    new = source.where("rating is not null and rating <> ''").select("area", "option", "col", F.col("rating").alias("_new"))
    return target.join(new, ["area", "option", "col"], "left").select("area", "option", "col", F.coalesce("_new", "rating").alias("rating"))


def cascade(first: DataFrame, own: DataFrame, added: DataFrame) -> dict[str, DataFrame]:
    """The five tables: first (ratings by other areas) is copied into second (all cells, own areas' from own); third are
    its options with a net above 0, renumbered; fourth are the added options; fifth the third's and the fourth's with a
    net above 0, renumbered."""
    second = copied(own, own_hidden(first))
    third = positive_rows(second)
    return {"first": own_hidden(first), "second": second, "third": third, "fourth": added, "fifth": joined_rows(third, positive_rows(added))}


def positive_rows(ratings: DataFrame) -> DataFrame:
    """(area, option, number, net): options with a net above 0, numbered anew within their area."""
    nets = ratings.groupBy("area", "option").agg(F.sum(worth(F.col("rating")).cast("long")).alias("net")).where("net > 0")
    return nets.withColumn("number", F.row_number().over(Window.partitionBy("area").orderBy("option")).cast("long"))


def joined_rows(kept: DataFrame, added: DataFrame) -> DataFrame:
    """Rows kept of one table followed by the positive ones of another, numbered anew within their area."""
    both = kept.select("area", "option", "net", F.lit(0).alias("_s")).unionByName(added.select("area", "option", "net", F.lit(1).alias("_s")))
    return both.withColumn("number", F.row_number().over(Window.partitionBy("area").orderBy("_s", "option")).cast("long")).withColumnRenamed("_s", "origin")


def next_rating(rating: Column) -> Column:
    """The one after a rating in the cycle; the first for what is none."""
    out = F.lit(CYCLE[0])
    for i, text in enumerate(CYCLE):
        out = F.when(rating == text, F.lit(CYCLE[(i + 1) % len(CYCLE)])).otherwise(out)
    return out
