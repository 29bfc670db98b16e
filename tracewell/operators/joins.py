"""Interval, as-of and overlap joins, and runs in an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.time import millis

def within_intervals(points: DataFrame, intervals: DataFrame, start: str = "start_ts", end: str = "end_ts", on: str | None = None, how: str = "inner") -> DataFrame:
    """Points in the half-open intervals that hold them; an open end holds all later points, and
    overlapping intervals each match.

    Both sides are dealt by day, so the join is by equal days, whether Spark broadcasts the intervals' days or shuffles
    them, and the condition is tested within a day; open ends are cut at the last point's day.
    """
    inside = (F.col("ts") >= F.col(start)) & (F.col(end).isNull() | (F.col("ts") < F.col(end)))
    if on:
        inside &= points[on] == intervals[on]
    last = points.agg(F.max("ts").alias("_last"))  # one row
    days = intervals.crossJoin(F.broadcast(last)).withColumn(
        "_day", F.explode(F.sequence(F.to_date(start), F.greatest(F.to_date(start), F.to_date(F.coalesce(end, "_last")))))
    ).drop("_last")
    return points.withColumn("_pd", F.to_date("ts")).join(days, (F.col("_pd") == F.col("_day")) & inside, how).drop("_pd", "_day")


def latest_before(points: DataFrame, marks: DataFrame, keys: list[str], mark_cols: list[str], tolerance: str | None = None, strict: bool = False) -> DataFrame:
    """As-of join: each point with its key's latest mark at or before it (before it, if strict), at most
    ``tolerance`` old.  One shuffle by key: both are stacked and the last mark carried forward."""
    side = lambda df, is_point: df.withColumn("_point", F.lit(is_point))
    tagged = side(marks.select(*keys, "ts", F.struct(F.col("ts").alias("mark_ts"), *mark_cols).alias("_mark")), 0).unionByName(side(points, 1), allowMissingColumns=True)
    order = F.col("_point") if not strict else -F.col("_point")
    w = Window.partitionBy(*keys).orderBy("ts", order).rowsBetween(Window.unboundedPreceding, 0)
    out = tagged.withColumn("_last", F.last("_mark", ignorenulls=True).over(w)).where("_point = 1")
    fresh = F.lit(True) if tolerance is None else F.col("_last.mark_ts") >= F.col("ts") - F.expr(f"interval {tolerance}")
    return out.select(*points.columns, *[F.when(fresh, F.col(f"_last.{c}")).alias(c if c != "ts" else "mark_ts") for c in ["mark_ts", *mark_cols]])


def overlapping(intervals: DataFrame, key: str, owner: str, start: str, end: str) -> DataFrame:
    """Pairs of one key and different owners whose closed intervals overlap, the smaller owner first.

    Two intervals overlap where the later one starts inside the earlier: each is dealt to the days it spans and meets those that
    start on one of them, so a key with very many intervals is the work of as many tasks as it has days.
    """
    rows = intervals.select(key, F.col(owner).alias("owner"), F.col(start).alias("start"), F.col(end).alias("end")).where(F.col("start") <= F.col("end"))
    one = rows.withColumn("_day", F.explode(F.sequence(F.to_date("start"), F.to_date("end"))))
    two = rows.select(key, F.col("owner").alias("owner_l"), F.col("start").alias("start_l"), F.col("end").alias("end_l"), F.to_date("start").alias("_day"))
    near = one.join(two, [key, "_day"]).where((F.col("start_l") >= F.col("start")) & (F.col("start_l") <= F.col("end")))
    # Of two that start together each lies in the other: the smaller owner counts as the earlier.
    near = near.where((F.col("owner") != F.col("owner_l")) & ((F.col("start") < F.col("start_l")) | (F.col("owner") < F.col("owner_l"))))
    low = F.col("owner") < F.col("owner_l")
    pick = lambda name: [F.when(low, F.col(name)).otherwise(F.col(f"{name}_l")).alias(f"{name}_a"), F.when(low, F.col(f"{name}_l")).otherwise(F.col(name)).alias(f"{name}_b")]
    return near.select(key, *pick("owner"), *pick("start"), *pick("end"))


def _carried(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with ``right``'s columns by keys (nulls are a key) and day."""
    named = right.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_day"])], *[c for c in right.columns if c not in (*keys, "_day")])
    on = F.lit(True)
    for i, k in enumerate([*keys, "_day"]):
        on &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return left.join(named, on, "left").drop(*[f"_k{i}" for i in range(len(keys) + 1)])


def with_previous(df: DataFrame, keys: list[str], columns: dict[str, Column], id_col: str = "evidence_id") -> DataFrame:
    """``df`` with ``columns`` of the row before, in the order (ts, id) within the keys.

    Rows are dealt by key and day, so a key of any size is the work of many tasks; what a day's first
    row needs is carried from the last row of the key's day before, one row per key and day.
    """
    rows = df.withColumn("_day", F.to_date("ts")).withColumn("_v", F.struct(*[c.alias(n) for n, c in columns.items()]))
    w = Window.partitionBy(*keys, "_day").orderBy("ts", id_col)
    ends = rows.groupBy(*keys, "_day").agg(F.max_by("_v", F.struct("ts", id_col)).alias("_end"))
    ends = ends.withColumn("_carry", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_day"))).drop("_end")
    near = rows.withColumn("_p", F.lag("_v").over(w))
    out = _carried(near, ends, keys).withColumn("_p", F.coalesce("_p", "_carry"))
    return out.select(*df.columns, *[F.col(f"_p.{n}").alias(n) for n in columns])


def runs(df: DataFrame, keys: list[str], breaks: Column, id_col: str = "evidence_id") -> DataFrame:
    """``df`` with ``run``, which counts up at every row where ``breaks`` holds, in the order (ts, id) within the
    keys: a running sum within key and day, plus the sums of the key's days before."""
    rows = df.withColumn("_day", F.to_date("ts")).withColumn("_b", F.when(breaks, 1).otherwise(0))
    w = Window.partitionBy(*keys, "_day").orderBy("ts", id_col).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = rows.groupBy(*keys, "_day").agg(F.sum("_b").alias("_n"))
    days = days.withColumn("_earlier", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = _carried(rows.withColumn("_here", F.sum("_b").over(w)), days, keys)
    return out.select(*df.columns, (F.col("_here") + F.col("_earlier")).alias("run"))


def gap_runs(df: DataFrame, keys: list[str], gap_ms: int, id_col: str = "evidence_id") -> DataFrame:
    """Runs of rows (all with a time) no more than ``gap_ms`` apart."""
    rows = with_previous(df, keys, {"_before": millis()}, id_col)
    return runs(rows, keys, F.col("_before").isNull() | (millis() - F.col("_before") > gap_ms), id_col).drop("_before")


def first_ids(rows: DataFrame, keys: list[str], k: int, id_col: str = "evidence_id", *order: str) -> DataFrame:
    """(keys, ids): the first ``k`` ids of each group in the order.  Rows are ranked, which Spark limits before it shuffles them, so no
    more than ``k`` of a group are ever gathered."""
    cols = order or ("ts", id_col)
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*cols))
    kept = rows.select(*keys, *cols, at.alias("_n")).where(F.col("_n") <= k)
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.col(id_col).alias("_id")))), lambda x: x["_id"]).alias("ids"))


def earliest(value: str, *order: str) -> Column:
    """Aggregate: ``value`` of the first row; rows without a time lose."""
    return F.min_by(value, F.struct(F.col(order[0]).isNull(), *order))
