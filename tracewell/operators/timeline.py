"""Counts over time: timelines, groups with a rest, metric series with bands, histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.time import millis
from tracewell.functions.stats import count_band, wilson

BINS = ("hour", "day", "week", "month")
MAX_BUCKETS = 2000
#: Widths, in milliseconds, that a histogram may have.
NICE_MS = tuple(m * 60_000 for m in (1, 5, 15, 60, 180, 360, 720, 1440, 2880, 10080, 20160, 43200))


def bucket(ts: Column, bin: str, tz: str | None = None) -> Column:
    """The start of ``ts``'s bucket, naive UTC; with ``tz`` buckets follow that zone's clock."""
    if bin not in BINS:
        raise ValueError(f"unknown bin: {bin!r}")
    if tz is None:
        return F.date_trunc(bin, ts).cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), F.date_trunc(bin, local).cast("timestamp_ntz"))


def local_day(ts: Column, tz: str = "UTC") -> Column:
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(tz), ts))


def day_number(ts: Column, first_day: Column, tz: str = "UTC") -> Column:
    """1 on the zone's local date ``first_day``."""
    return F.datediff(local_day(ts, tz), first_day) + 1


def top_with_other(df: DataFrame, group: str, k: int, other: str = "other") -> DataFrame:
    """``df`` with groups beyond the ``k`` with most rows (ties by name) relabelled.  The ranking is over
    groups, k rows of which are broadcast."""
    ranked = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), group).limit(k).select(F.col(group).alias("_top"))
    return df.join(F.broadcast(ranked), F.col(group) == F.col("_top"), "left").withColumn(group, F.coalesce("_top", F.lit(other))).drop("_top")


def timeline(records: DataFrame, bin: str = "day", group: str | None = None, top: int = 10, tz: str | None = None) -> DataFrame:
    """(bucket[, group], n): sparse counts of the records that have a time; rarer groups are ``other``."""
    rows = records.where(F.col("ts").isNotNull())
    keys = [bucket(F.col("ts"), bin, tz).alias("bucket")]
    if group:
        rows = top_with_other(rows.withColumn("group", F.coalesce(F.col(group), F.lit("(none)"))), "group", top)
        keys.append(F.col("group"))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def peak(counts: DataFrame) -> DataFrame:
    """The fullest bucket; the earliest wins ties."""
    return counts.orderBy(F.desc("n"), "bucket").limit(1)


def checked_buckets(counts: DataFrame, limit: int = MAX_BUCKETS) -> DataFrame:
    """An error if a timeline has more buckets than a reader can use."""
    if counts.select("bucket").distinct().limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} buckets; use a coarser bin or a narrower window")
    return counts


def active_grid(daily: DataFrame, entity: str, until_last: bool) -> DataFrame:
    """Every (entity, active day) from the entity's first day on, zeros included; ``day_index`` counts the
    days on which anyone was active.

    ``daily`` is (entity, d, num, den).  Days are few whatever the data's size, so they are broadcast.
    """
    days = daily.groupBy("d").agg(F.sum("den").alias("_x")).where("_x > 0").select("d", F.row_number().over(Window.orderBy("d")).alias("day_index"))
    spans = daily.where("den > 0").groupBy(entity).agg(F.min("d").alias("_first"), F.max("d").alias("_last"))
    if not until_last:
        spans = spans.crossJoin(F.broadcast(days.agg(F.max("d").alias("_end")))).withColumn("_last", F.greatest("_last", "_end"))  # one row
    spans = spans.select(entity, F.explode(F.sequence("_first", "_last")).alias("d"))
    grid = spans.join(F.broadcast(days), "d").select(entity, "d", "day_index")
    return grid.join(daily, [entity, "d"], "left").fillna(0, ["num", "den"])


def series(daily: DataFrame, entity: str = "group", kind: str = "count", window: int = 7) -> DataFrame:
    """Per entity and active day: value, mean of the trailing calendar days' active days, 95 % band."""
    grid = active_grid(daily, entity, True).withColumn("_day", F.datediff("d", F.lit("1970-01-01").cast("date")))
    w = Window.partitionBy(entity).orderBy("_day").rangeBetween(-(window - 1), 0)
    total, k = F.sum(F.col("num").cast("double")).over(w), F.count(F.lit(1)).over(w)
    if kind == "count":
        squares = F.sum(F.col("num").cast("double") * F.col("num")).over(w)
        mean, low, high = count_band(total, squares, k)
        raw = F.col("num").cast("double")
    else:
        of = F.sum(F.col("den").cast("double")).over(w)
        mean = F.try_divide(total, of)
        low, high = wilson(total, of)
        raw = F.try_divide(F.col("num").cast("double"), F.col("den").cast("double"))
    return grid.select(entity, "d", "day_index", raw.alias("raw"), mean.alias("mean"), low.alias("low"), high.alias("high"), "num", "den")


def nice_width(span_ms: int, most: int = 600) -> int:
    """The smallest listed width that cuts the span into at most so many bins."""
    return next((w for w in NICE_MS if span_ms <= w * most), NICE_MS[-1])


def histogram(records: DataFrame, keys: list[str], base_ms: int, width_ms: int) -> DataFrame:
    ms = millis()
    return records.groupBy(*keys, F.floor((ms - base_ms) / width_ms).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quota_sample(records: DataFrame, lane: str, quota: int) -> DataFrame:
    """At most ``quota`` rows of each lane, evenly spread over its order: row r of n stays if
    ``floor(r q / n)`` steps up there."""
    n = F.count(F.lit(1)).over(Window.partitionBy(lane))
    rn = F.row_number().over(Window.partitionBy(lane).orderBy("ts", "evidence_id"))
    q = F.lit(quota)
    out = records.withColumn("_n", n).withColumn("_r", rn)
    steps = F.floor(F.col("_r") * q / F.col("_n")) > F.floor((F.col("_r") - 1) * q / F.col("_n"))
    return out.where((F.col("_n") <= quota) | steps).drop("_n", "_r")


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))
