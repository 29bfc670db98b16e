"""The spread of ideas: distinctive terms, their coinage and adoption, presence, speed, influence and flow between families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Days in which every term counts as known, texts that a term must stand in, how much likelier a pair must be than by chance.
NOVELTY_DAYS, MIN_TEXTS, MIN_LIFT = 21, 20, 30.0
#: Days in which a term spreads at speed, uses that make an adopter, adopters and bursts of the listed terms.
REACH_DAYS, ADOPT_USES, LISTED_ADOPTERS, DURABLE, EPISODIC = 14, 2, 3, 0.5, 0.6


def idea_uses(messages: DataFrame, common: DataFrame, text: str = "content", least: int = MIN_TEXTS, lift: float = MIN_LIFT, novelty_days: int = NOVELTY_DAYS) -> DataFrame:
    """(term, evidence_id, author_id, channel, ts): uses of words outside ``common`` (word), and of pairs of words within a stretch without
    punctuation that stand together ``lift`` times as often as by chance; in ``least`` texts or more and none of the first days.

    Terms are counted once; the few that qualify then meet the texts again.
    """
    chunks = F.filter(F.split(F.lower(F.col(text)), r"[^a-z0-9_' -]+"), lambda c: c != "")
    words = lambda c: F.regexp_extract_all(c, F.lit("[a-z][a-z0-9_-]{2,}"), F.lit(0))
    pairs = lambda w: F.when(F.size(w) >= 2, F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))).otherwise(F.array().cast("array<string>"))
    listed = messages.where(F.col("ts").isNotNull() & F.col(text).isNotNull()).select("evidence_id", "author_id", "channel", "ts", F.transform(chunks, words).alias("_w"))
    terms = F.array_distinct(F.concat(F.flatten("_w"), F.flatten(F.transform("_w", pairs))))
    held = listed.select("evidence_id", "author_id", "channel", "ts", F.explode(terms).alias("term"))
    counts = held.groupBy("term").agg(F.count(F.lit(1)).alias("texts"), F.min("ts").alias("first_ts"))
    span = listed.agg(F.count(F.lit(1)).alias("all"), (F.min("ts") + F.expr(f"interval {novelty_days} days")).alias("cut"))  # one row
    new = counts.crossJoin(F.broadcast(span)).where((F.col("texts") >= least) & (F.col("first_ts") >= F.col("cut")))
    single = new.where(~F.col("term").contains(" ")).join(common.select(F.col("word").alias("term")), "term", "left_anti").select("term")
    both = new.where(F.col("term").contains(" ")).withColumn("a", F.split_part("term", F.lit(" "), F.lit(1))).withColumn("b", F.split_part("term", F.lit(" "), F.lit(2)))
    one, two = counts.select(F.col("term").alias("a"), F.col("texts").alias("na")), counts.select(F.col("term").alias("b"), F.col("texts").alias("nb"))
    apart = both.join(one, "a").join(two, "b").where(F.col("texts") * F.col("all") / (F.col("na") * F.col("nb")) >= lift).select("term")
    return held.join(single.union(apart), "term")


def presence(agents: DataFrame, messages: DataFrame) -> DataFrame:
    """(agent_id, joined_ts, until_ts): from joining to the later of leaving (the end of the data, if the roster has the agent without a
    date) and the last message.  ``agents`` is (agent_id, joined_ts, listed, left_ts)."""
    end = messages.agg(F.max("ts").alias("_end"))  # one row
    last = messages.groupBy(F.col("author_id").alias("agent_id")).agg(F.max("ts").alias("_last"))
    joined = agents.groupBy("agent_id").agg(F.min("joined_ts").alias("joined_ts"), F.max("listed").alias("listed"), F.max("left_ts").alias("left_ts"))
    rows = joined.join(last, "agent_id", "left").crossJoin(F.broadcast(end))
    gone = F.when(F.col("listed"), F.coalesce("left_ts", "_end")).otherwise(F.col("joined_ts"))
    return rows.select("agent_id", "joined_ts", F.greatest("joined_ts", gone, "_last").alias("until_ts"))


def spread(uses: DataFrame, present: DataFrame, seeded: DataFrame | None = None) -> DataFrame:
    """One row per term and adopter (or with a null adopter where there is none): origin, coinage, texts, who was present then, whether the
    adopter came later and adopted soon.  ``uses`` is (term, evidence_id, author_id, channel, ts), ``seeded`` (term, seeded_ts)."""
    per = uses.groupBy("term", "author_id").agg(F.count(F.lit(1)).alias("uses"), F.min(F.struct("ts", "evidence_id", "channel")).alias("f"))
    coined = per.groupBy("term").agg(F.min(F.struct("f", "author_id")).alias("o"), F.sum("uses").alias("texts"))
    coined = coined.select("term", "texts", F.col("o.author_id").alias("origin"), F.col("o.f.ts").alias("origin_ts"), F.col("o.f.channel").alias("room"))
    # How many were there at a moment: arrivals up to it less departures before it, as running counts over days of change.
    steps = present.select(F.col("joined_ts").alias("at"), F.lit(1).alias("n"), F.lit(0).alias("o")).union(present.select("until_ts", F.lit(-1), F.lit(2)))
    asked = coined.select(F.col("origin_ts").alias("at"), F.lit(0), F.lit(1)).distinct()
    line = steps.union(asked).withColumn("day", F.to_date("at"))
    within = Window.partitionBy("day").orderBy("at", "o").rowsBetween(Window.unboundedPreceding, 0)
    days = line.groupBy("day").agg(F.sum("n").alias("d"))
    days = days.select("day", F.coalesce(F.sum("d").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row a day
    there = line.withColumn("here", F.sum("n").over(within)).where("o = 1").join(F.broadcast(days), "day").select(F.col("at").alias("origin_ts"), (F.col("here") + F.col("before")).alias("present")).distinct()
    out = coined.join(there, "origin_ts")
    if seeded is not None:
        out = out.join(seeded.groupBy("term").agg(F.min("seeded_ts").alias("_s")), "term", "left").withColumn("seeded", F.coalesce(F.col("_s") <= F.col("origin_ts") + F.expr("interval 1 day"), F.lit(False))).drop("_s")
    else:
        out = out.withColumn("seeded", F.lit(False))
    joined = present.select(F.col("agent_id").alias("adopter"), "joined_ts")
    took = per.where(F.col("uses") >= ADOPT_USES).select("term", F.col("author_id").alias("adopter"), F.col("f.ts").alias("adopted_ts"), F.col("f.channel").alias("adopter_room")).join(joined, "adopter")
    took = took.withColumnRenamed("term", "_t")
    rows = out.join(took, (F.col("term") == F.col("_t")) & (F.col("adopter") != F.col("origin")), "left").drop("_t")
    return rows.withColumn("newcomer", F.col("joined_ts") > F.col("origin_ts")).withColumn("soon", F.col("adopted_ts") <= F.col("origin_ts") + F.expr(f"interval {REACH_DAYS} days")).drop("joined_ts")


def quarter(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))


def speed(spread_rows: DataFrame, last_ts) -> DataFrame:
    """(quarter, terms, reach): by quarter of coinage, the mean share of the others present that adopt within a fortnight; terms coined too
    near the end, seeded ones and those of an only agent are left out."""
    horizon = F.lit(last_ts).cast("timestamp_ntz") - F.expr(f"interval {REACH_DAYS} days")
    per = spread_rows.where(~F.col("seeded") & (F.col("origin_ts") <= horizon) & (F.col("present") >= 2)).groupBy("term", "origin_ts", "present").agg(F.count(F.when(F.col("soon") & ~F.col("newcomer"), 1)).alias("n"))
    return per.groupBy(quarter(F.col("origin_ts")).alias("quarter")).agg(F.count(F.lit(1)).alias("terms"), F.avg(F.col("n") / (F.col("present") - 1)).alias("reach"))


def listed(spread_rows: DataFrame, least: int = MIN_TEXTS, adopters: int = LISTED_ADOPTERS) -> DataFrame:
    """The rows of unseeded terms in so many texts with so many adopters."""
    n = F.count("adopter").over(Window.partitionBy("term"))
    return spread_rows.where(~F.col("seeded") & (F.col("texts") >= least)).withColumn("_n", n).where(F.col("_n") >= adopters).drop("_n")


def influence(listed_rows: DataFrame) -> DataFrame:
    """(origin, coined, adoptions): how many terms each coined and how often they were taken up."""
    return listed_rows.groupBy("origin").agg(F.countDistinct("term").alias("coined"), F.count("adopter").alias("adoptions"))


def family_flow(listed_rows: DataFrame, families: DataFrame, other: str = "Human") -> DataFrame:
    """(origin_family, family, n): adoptions from family to family; ``families`` is (agent_id, family)."""
    of = lambda c, name: families.select(F.col("agent_id").alias(c), F.col("family").alias(name))
    rows = listed_rows.where("adopter IS NOT NULL").join(of("origin", "origin_family"), "origin", "left").join(of("adopter", "family"), "adopter", "left")
    return rows.groupBy(F.coalesce("origin_family", F.lit(other)).alias("origin_family"), F.coalesce("family", F.lit(other)).alias("family")).agg(F.count(F.lit(1)).alias("n"))


def by_quarter(listed_rows: DataFrame) -> DataFrame:
    """(quarter, adoptions, newcomers, cross_room) by quarter of adoption."""
    rows = listed_rows.where("adopter IS NOT NULL")
    return rows.groupBy(quarter(F.col("adopted_ts")).alias("quarter")).agg(
        F.count(F.lit(1)).alias("adoptions"), F.count(F.when(F.col("newcomer"), 1)).alias("newcomers"), F.count(F.when(F.col("adopter_room") != F.col("room"), 1)).alias("cross_room")
    )


def kind(burst: Column) -> Column:
    """durable, episodic or neither, by a term's burstiness."""
    return F.when(burst < DURABLE, "durable").when(burst >= EPISODIC, "episodic")


__all__ = ["by_quarter", "family_flow", "idea_uses", "influence", "kind", "listed", "presence", "quarter", "speed", "spread"]
