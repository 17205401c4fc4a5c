"""Reader activity: ledgers, merges, ratings, when to ask.

A ledger is one row a user: first_seen, active_ms by device, days, chapters, acts by device, max_day.  Merging is
idempotent and commutative: the largest counter a device, the union of sets, the earliest first_seen, the largest
max_day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

from tallyloom.operators.series import capped_gaps

# How activity is counted and when a reader is asked.
TICK_CAP_MS, IDLE_MS = 7_500, 60_000
ACTIVE_MS, DAYS, ACTS, DISMISSALS, COOLDOWN_DAYS = 30 * 60_000, 2, 1, 2, 45


def epoch_ms(events: DataFrame, ts: str) -> Column:
    """Milliseconds since 1970: rounded, halves away from 0, as DuckDB 2.0's epoch_ms does.  A time without a zone
    counts as it reads, whatever the session's zone."""
    div = lambda a, b: F.call_function("div", a, b)
    if isinstance(events.schema[ts].dataType, TimestampNTZType):
        micros = div(F.col(ts) - F.lit("1970-01-01").cast("timestamp_ntz"), F.expr("interval '0.000001' second"))
    else:
        micros = F.unix_micros(F.col(ts).cast("timestamp"))
    return div(micros, F.lit(1000)) + div(micros % 1000, F.lit(500))


def date_text(events: DataFrame, ts: str) -> Column:
    """The date as yyyy-MM-dd, a year outside 0 to 9999 as a bare number, as DuckDB's strftime does.  A time without a
    zone counts as it reads, even where the session's zone left that day out."""
    ntz = isinstance(events.schema[ts].dataType, TimestampNTZType)
    date = F.col(ts).cast("date") if ntz else F.col(ts).cast("timestamp").cast("date")
    text, year = date.cast("string"), F.year(date)
    return F.when(year.between(0, 9999), text).otherwise(F.concat(year.cast("string"), F.right(text, F.lit(6))))


def active_time(events: DataFrame, keys: list[str], ts: str, order: list[str], cap_ms: int = TICK_CAP_MS, idle_ms: int = IDLE_MS) -> DataFrame:
    """(keys..., active_ms): time between ticks, each rounded to a millisecond, capped, none over idle gaps."""
    ticks = capped_gaps(events, keys, order, epoch_ms(events, ts), cap_ms, idle_ms)
    return ticks.groupBy(*keys).agg(F.sum("active_ms").alias("active_ms"))


def visits(events: DataFrame, user: str, ts: str, act: Column) -> DataFrame:
    """(user, first_seen, n_days, last_day, acts): what visits add up to."""
    day = F.date_format(ts, "yyyy-MM-dd")
    return events.groupBy(user).agg(F.min(ts).alias("first_seen"), F.count_distinct(day).alias("n_days"), F.max(day).alias("last_day"), F.sum(act.cast("long")).alias("acts"))


def state(events: DataFrame, user: str, device: str, ts: str, day: Column, chapter: Column, act: Column) -> DataFrame:
    """(user, device, first_seen, days, chapters, max_day, acts): what visits and acts add up to on a device.  days are
    the dates of visits, chapters the keys D.C of pages with a day and a chapter, both sorted; max_day is 0 without a
    page of a day."""
    key = F.when(day.isNotNull() & chapter.isNotNull(), F.concat_ws(".", day.cast("string"), chapter.cast("string")))
    date = date_text(events, ts)
    return events.groupBy(user, device).agg(
        F.min(date).alias("first_seen"), F.sort_array(F.collect_set(date)).alias("days"), F.sort_array(F.collect_set(key)).alias("chapters"), F.coalesce(F.max(day), F.lit(0)).alias("max_day"), F.count_if(act).alias("acts")
    )


def joined_states(states: DataFrame, user: str) -> DataFrame:
    """(user, first_seen, n_days, n_chapters, max_day, acts): the devices' states of a user as one."""
    sets = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    return states.groupBy(user).agg(F.min("first_seen").alias("first_seen"), sets("days").alias("n_days"), sets("chapters").alias("n_chapters"), F.max("max_day").alias("max_day"), F.sum("acts").alias("acts"))


# What a page's own events are called.
PAGE_EVENTS = {"notes": "notes-downloaded", "funnel": "funnel-run", "ratings": "rating-table-used", "commentary": "commentary-revealed"}


def page_events(events: DataFrame, path: str, kind: str) -> DataFrame:
    """events of the known kinds with name, day and chapter of their page; all of these count as acts (G7)."""
    name = F.lit(None).cast("string")
    for k, n in PAGE_EVENTS.items():
        name = F.when(F.col(kind) == k, F.lit(n)).otherwise(name)
    return events.withColumn("name", name).where("name is not null").withColumns(page_context(F.col(path)))


def merged(counters: DataFrame, user: str, device: str, values: list[str]) -> DataFrame:
    """(user, values...): the largest counter of each device, added up over devices."""
    per = counters.groupBy(user, device).agg(*[F.max(v).alias(v) for v in values])
    return per.groupBy(user).agg(*[F.sum(v).alias(v) for v in values])


def counter_total(counters: Column) -> Column:
    """Sum of a map's values."""
    return F.aggregate(F.map_values(counters), F.lit(0).cast("long"), lambda a, v: a + v)


def merged_maps(a: Column, b: Column) -> Column:
    """Two device maps as one, the larger value of each device."""
    empty = F.create_map().cast("map<string,bigint>")
    return F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda _, x, y: F.greatest(x, y))


def merged_ledgers(a: str, b: str) -> dict[str, Column]:
    """The merge of two struct columns of ledgers, field by field."""
    f = lambda c, name: F.col(f"{c}.{name}")
    sets = lambda name: F.array_union(F.coalesce(f(a, name), F.array().cast("array<string>")), F.coalesce(f(b, name), F.array().cast("array<string>")))
    return {
        "firstSeen": F.least(f(a, "firstSeen"), f(b, "firstSeen")),
        "activeMsByDevice": merged_maps(f(a, "activeMsByDevice"), f(b, "activeMsByDevice")),
        "days": sets("days"),
        "chapters": sets("chapters"),
        "actsByDevice": merged_maps(f(a, "actsByDevice"), f(b, "actsByDevice")),
        "maxDay": F.greatest(f(a, "maxDay"), f(b, "maxDay")),
    }


def migrated(legacy: Column, device: Column) -> Column:
    """A ledger of the older shape (activeMs, acts) as one with a single device."""
    return F.struct(
        legacy["firstSeen"].alias("firstSeen"),
        F.create_map(device, F.coalesce(legacy["activeMs"], F.lit(0).cast("long"))).alias("activeMsByDevice"),
        legacy["days"].alias("days"),
        legacy["chapters"].alias("chapters"),
        F.create_map(device, F.coalesce(legacy["acts"], F.lit(0).cast("long"))).alias("actsByDevice"),
        legacy["maxDay"].alias("maxDay"),
    )


def latest(events: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """(keys..., value): the last one written."""
    return events.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def rated(events: DataFrame, user: str, chapter: str, rating: str, order: list[str]) -> DataFrame:
    """(user, chapter, rating, act): the last valid rating; the first of a chapter is an act.  Only up and down count."""
    valid = events.where(F.col(rating).isin("up", "down"))
    return latest(valid, [user, chapter], rating, order).withColumn("act", F.lit(1).cast("long"))


def should_prompt(active_ms: Column, days: Column, acts: Column, state: Column, dismissals: Column, days_since: Column, active_min: int = ACTIVE_MS) -> Column:
    """Whether to ask: never asked, or dismissed less than twice and 45 days ago or more; and 30 minutes of activity on
    two days with an act."""
    eligible = state.isNull() | (state == "none") | ((state == "dismissed") & (dismissals < DISMISSALS) & (days_since >= COOLDOWN_DAYS))
    return F.coalesce(eligible & (active_ms >= active_min) & (days >= DAYS) & (acts >= ACTS), F.lit(False))


def page_context(path: Column) -> dict[str, Column]:
    """day and chapter of a page's path /content/days/day-D/C-....html; else nulls."""
    pattern = r"/content/days/day-0*([0-9]+)/0*([0-9]+)-[^/]*\.html$"
    part = lambda i: F.nullif(F.regexp_extract(path, pattern, i), F.lit("")).cast("int")
    return {"day": part(1), "chapter": part(2)}


def ranked_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key (A15)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
