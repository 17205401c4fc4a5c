"""Mixing sources to target weights by Pareto order sampling.

Targets.  Sources, sorted by code point with null last, weigh `weights` in turn and share `share` times all words by
weight; no target is above `most` times its source's words, and what is above is shared again by weight until none is
(water filling).

Copies.  A source's target divided by its words is how often each of its documents is expected in the mix.  The whole
part is certain copies.  The rest is drawn by Pareto order sampling (Rosen, 1997).  A document's inclusion probability
is lambda = min(1, c * weight), where `weights_of` says its weight (from 0.01 to 1, in hundredths) and c is such that the
probabilities, times sizes, add up to what is left of the source's target.  A document's rank is its random odds
u / (1 - u) divided by its inclusion odds lambda / (1 - lambda), and those of smallest rank are taken, so many that
their words reach what is left: a sample of fixed size, in words, with unequal probabilities.  A document that would
overshoot ends the order.  What is then missing is less than its size; to round, the one document not taken whose size
comes nearest to the gap is taken, if that is nearer to the target than none.

Distribution: random numbers are MD5 hashes of ids, so that reruns agree.  The running sum of a source is made over
ranges of ranks of about `range_rows` documents each, in two levels, so that no task holds a source; only ids and sizes
are shuffled.  The table of sources is broadcast if it has at most BROADCAST_SOURCES rows, else joined by shuffle.
Only DataFrame operations.

Nulls and odd cases: a null text has size 0 and is taken 0 words (in whatever number of copies); null is a source of
its own; a null id is drawn like the id -1; rows that repeat an id are rows of their own, with the same random number;
sources without a word have target 0; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import Scratch, words

BROADCAST_SOURCES = 20_000


def _spread(df: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join with a table of one row a source: broadcast if it is small, counted first."""
    few = small.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    return df.join(F.broadcast(small) if few else small, key, how)


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes(key, size) -> (key, rows, source_size, target); key sorts as the sources do."""
    per = sizes.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    every = Window.orderBy("key")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(turn, (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("cap", F.lit(float(most)) * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    before = Window.orderBy("level", "key").rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.orderBy("level", "key").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    per = per.withColumn("full", F.lit(float(share)) * F.sum("source_size").over(whole))
    per = per.withColumn("try", (F.col("full") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
    per = per.withColumn("water", F.min(F.when(F.col("try") <= F.col("level"), F.struct("level", "key", "try"))).over(whole)["try"])
    return per.select("key", "rows", "source_size", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))


def inclusion(sized: DataFrame, goal: DataFrame) -> DataFrame:
    """(key, weight, lambda, lead) from sized(key, weight, size) and goal(key, left): the inclusion probability of a
    source's documents of a weight, and the largest one below 1 in the source.  A source has a hundred weights at most."""
    classes = sized.groupBy("key", "weight").agg(F.sum("size").alias("words"))
    classes = _spread(classes, goal.select("key", "left"), "key")
    falling = Window.partitionBy("key").orderBy(F.desc("weight"))
    before = F.coalesce(F.sum("words").over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    onward = F.sum(F.col("weight") * F.col("words")).over(falling.rowsBetween(0, Window.unboundedFollowing))
    whole = Window.partitionBy("key")
    # the largest weight that need not be cut to 1, once all above it are
    tried = classes.withColumn("try", F.when(onward > 0, (F.col("left") - before) / onward))
    tried = tried.withColumn("c", F.max(F.when(F.col("try") * F.col("weight") <= 1, F.struct("weight", "try"))).over(whole)["try"])
    chance = F.least(F.lit(1.0), F.coalesce(F.col("c") * F.col("weight"), F.lit(0.0)))
    tried = tried.withColumn("lambda", chance)
    return tried.withColumn("lead", F.max(F.when(F.col("lambda") < 1, F.col("lambda"))).over(whole)).select("key", "weight", "lambda", "lead")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, weights_of: str = "if(size >= 50, 1.0, 0.5)", seed: str = "mix", range_rows: int = 4096) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of docs(doc_id, source, text)."""
    scratch = Scratch(docs.sparkSession, "mixing")
    name = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-1")))
    u = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.size(words(F.col("text"))).cast("long").alias("size"), key.alias("key"), u.alias("u"))
    weight = F.greatest(F.lit(0.01), F.least(F.lit(1.0), F.round(F.expr(weights_of).cast("double"), 2)))
    sized = scratch.keep(sized.withColumn("weight", weight), "sizes")
    goal = scratch.keep(targets(sized, weights, share, most), "targets")

    whole = F.coalesce(F.floor(F.col("target") / F.col("source_size")), F.lit(0)).cast("int")
    goal = goal.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    chances = scratch.keep(inclusion(sized, goal), "chances")
    few = chances.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    dealt = _spread(sized, goal, "key").join(F.broadcast(chances) if few else chances, ["key", "weight"])
    odds = lambda p: F.greatest(p, F.lit(1e-9)) / (1 - p)
    dealt = dealt.withColumn("rank", F.when(F.col("lambda") < 1, F.col("u") / (1 - F.col("u")) / odds(F.col("lambda"))).otherwise(0.0))
    # ranges of ranks in even numbers; documents that are certain, which all come first, by their random numbers
    ranges = F.ceil(F.col("rows") / range_rows)
    even = F.col("rank") * odds(F.col("lead"))
    at = F.when(F.col("rank") > 0, F.least(F.floor(even / (1 + even) * ranges), ranges - 1)).otherwise(F.floor(F.col("u") * ranges) - ranges)
    dealt = dealt.withColumn("at", at)
    starts = dealt.groupBy("key", "at").agg(F.sum("size").alias("words"))
    starts = starts.select("key", "at", F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = Window.partitionBy("key", "at").orderBy("rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ordered = dealt.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["key", "at"])
    ordered = ordered.withColumn("before", F.col("before") + F.col("start"))
    taken = F.col("before") + F.col("size") <= F.col("left")
    ordered = scratch.keep(ordered.select("doc_id", "source", "key", "size", "rank", "source_size", "target", "whole", "left", "before", taken.alias("drawn")), "ordered")

    # the document that comes nearest to what is still missing
    gap = ordered.groupBy("key").agg((F.first("left") - F.coalesce(F.sum(F.when(F.col("drawn"), F.col("size"))), F.lit(0))).alias("gap"))
    missing = _spread(ordered.where("not drawn and size > 0"), gap, "key").where("abs(size - gap) < gap")
    last = missing.groupBy("key").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "before"))["before"].alias("last"))
    out = _spread(ordered, scratch.keep(last, "last"), "key", "left")
    more = F.col("drawn") | (F.coalesce(F.col("before") == F.col("last"), F.lit(False)) & (F.col("size") > 0))
    copies = F.col("whole") + more.cast("int")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
