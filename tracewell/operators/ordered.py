"""Facts about the rows before and after a row of its keys, however many rows a key has.

Rows are dealt by key and by block of the order (a dense whole number), so a key with a third of all rows is the work
of many tasks.  Within a block a running window gives the facts; across blocks they are carried by a window over one
row per key and block.  Rows after are reached by running the order backwards, which costs as little as running
it forwards.  Where all rows are known to lie in one block (``block=None``) the window alone is enough.  As blocks read their
rows twice, steps upon steps should have a ``stage`` that writes what they have in common.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
_ALL = (Window.unboundedPreceding, -1)
_FOLD = {"max": F.max, "min": F.min, "sum": F.sum}
_JOIN = {"max": F.greatest, "min": F.least, "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}

Stage = Callable[[DataFrame, str], DataFrame]
#: How a fact is folded ("max", "min" or "sum") and what.
Facts = dict[str, tuple[str, Column]]


def last(value: Column) -> tuple[str, Column]:
    return "max", value


def first(value: Column) -> tuple[str, Column]:
    return "min", value


def count(test: Column) -> tuple[str, Column]:
    return "sum", F.when(test, 1).otherwise(0)


def carry(rows: DataFrame, keys: list[str], before: Facts | None = None, after: Facts | None = None, order: str = "sequence", block: int | None = BLOCK, stage: Stage | None = None) -> DataFrame:
    """``rows`` with the facts of the rows strictly before and after each, among those with equal keys (none of them null)."""
    sides = [(facts, sign) for facts, sign in ((before or {}, 1), (after or {}, -1)) if facts]
    given = rows.select(
        "*", (F.floor(F.col(order) / block) if block else F.lit(0)).alias("_block"), F.col(order).alias("_up"), (-F.col(order)).alias("_down"),
        *[value.alias(f"_v_{name}") for facts, _ in sides for name, (_, value) in facts.items()],
    )
    if block and stage:
        given = stage(given, "carried")
    parts = [*keys, "_block"] if block else keys
    here, beyond = ["*"], parts
    for facts, sign in sides:
        inner = Window.partitionBy(*parts).orderBy("_up" if sign > 0 else "_down").rangeBetween(*_ALL)
        outer = Window.partitionBy(*keys).orderBy(sign * F.col("_block")).rowsBetween(*_ALL)
        here = [*here, *[_FOLD[how](f"_v_{name}").over(inner).alias(f"_h_{name}") for name, (how, _) in facts.items()]]
        beyond = [*beyond, *[_FOLD[how](f"_t_{name}").over(outer).alias(f"_o_{name}") for name, (how, _) in facts.items()]]
    if not block:
        alone = lambda name, how: F.coalesce(f"_h_{name}", F.lit(0)) if how == "sum" else F.col(f"_h_{name}")
        return given.select(*here).select(*rows.columns, *[alone(name, how).alias(name) for facts, _ in sides for name, (how, _) in facts.items()])
    folded = [_FOLD[how](f"_v_{name}").alias(f"_t_{name}") for facts, _ in sides for name, (how, _) in facts.items()]
    blocks = given.groupBy(*parts).agg(*folded)
    both = given.select(*here).join(blocks.select(*beyond), parts)
    out = [_JOIN[how](F.col(f"_h_{name}"), F.col(f"_o_{name}")).alias(name) for facts, _ in sides for name, (how, _) in facts.items()]
    return both.select(*rows.columns, *out)


def beside(probes: DataFrame, rows: DataFrame, keys: list[str], before: Facts | None = None, after: Facts | None = None, order: str = "sequence", block: int | None = BLOCK, stage: Stage | None = None) -> DataFrame:
    """``probes`` with facts about the ``rows`` of equal keys before and after each: both are stacked and carried once.  Probes
    with a null key or place find nothing."""
    named = {**(before or {}), **(after or {})}
    values = {name: value for name, (_, value) in named.items()}
    told = _known([*keys, "_at"])
    taken = rows.select(*keys, F.col(order).alias("_at"), *[v.alias(f"_f_{n}") for n, v in values.items()]).where(told)
    asked = probes.select(*keys, F.col(order).alias("_at"), F.struct(*[F.col(c) for c in probes.columns]).alias("_probe"))
    stacked = taken.unionByName(asked.where(told), allowMissingColumns=True)
    again = lambda facts: {n: (how, F.col(f"_f_{n}")) for n, (how, _) in (facts or {}).items()}
    found = carry(stacked, keys, again(before), again(after), "_at", block, stage).where("_probe IS NOT NULL").select("_probe.*", *named)
    lost = probes.where(~_known([*keys, order]))
    for name, (how, _) in named.items():
        lost = lost.withColumn(name, F.lit(0 if how == "sum" else None).cast(found.schema[name].dataType))
    return found.unionByName(lost)


def _known(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))


def last_of_another(probes: DataFrame, rows: DataFrame, keys: list[str], name: str, owner: str = "agent", reverse: bool = False, order: str = "sequence", block: int | None = BLOCK, stage: Stage | None = None, ties: bool = False) -> DataFrame:
    """``probes`` with ``name``, the last row before each (the first after it, if ``reverse``) among the ``rows`` of equal keys
    that another ``owner`` has, as a struct of all its columns, the order first.

    Each row first learns the nearest row of an owner other than its own: the last row of the run of one owner before.  So
    the nearest row of all tells the probe both.  Rows of one key at one place are told apart only with ``ties``: then of each place
    the greatest row counts, and the greatest of another owner there is the nearest other to all that come after.
    """
    sign = -1 if reverse else 1
    columns = [order, *[c for c in rows.columns if c not in (order, "_n")]]
    turned = rows.select("*", (sign * F.col(order)).alias("_n"))
    asked = probes.withColumn("_n", sign * F.col(order))
    whole = F.struct("_n", *columns)
    if ties:
        at = Window.partitionBy(*keys, "_n")
        turned = turned.withColumn("_top", F.max(whole).over(at))
        turned = turned.withColumn("_beside", F.max(F.when(F.col(owner) != F.col(f"_top.{owner}"), whole)).over(at)).where(whole.eqNullSafe(F.col("_top"))).drop("_top")
    near = carry(turned, keys, {"_near": last(F.struct("_n", *columns, "_beside") if ties else whole)}, order="_n", block=block, stage=stage)
    row = F.struct(*[F.col(f"_near.{c}").alias(c) for c in ("_n", *columns)])
    other = F.when(F.col(f"_near.{owner}") != F.col(owner), F.struct("_n", row.alias("row")))
    if ties:
        other = other.when(F.col("_near._beside").isNotNull(), F.struct("_n", F.col("_near._beside").alias("row")))
    told = carry(near.withColumn("_break", other), keys, {"_other": last(F.col("_break"))}, order="_n", block=block, stage=stage)
    told = told.withColumn("_else", F.coalesce(*(["_beside"] if ties else []), F.col("_break.row"), F.col("_other.row")))
    found = beside(asked, told, keys, {"_last": last(F.struct("_n", F.struct("_n", *columns).alias("row"), "_else"))}, order="_n", block=block, stage=stage)
    pick = F.when(F.col(f"_last.row.{owner}") != F.col(owner), F.col("_last.row")).otherwise(F.col("_last._else"))
    return found.withColumn(name, pick).drop("_last", "_n")


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str], start: str, end: str, at: str, width: int) -> DataFrame:
    """Rows of ``right`` with ``at`` in the closed range [start, end] of rows of ``left`` of equal keys.  Ranges are dealt to the
    buckets of ``width`` that they span, so the join is by equal keys and buckets."""
    spread = left.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    held = right.withColumn("_bucket", F.floor(F.col(at) / width))
    return spread.join(held, [*keys, "_bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_bucket")
