"""Filters, standard records, search, paging, neighbours and resolution of evidence ids."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.joins import with_previous
from tracewell.functions.text import matches, name_key, snippet

AUTHOR = {"messages": "author_id", "actions": "agent_id"}
#: Names are resolved against every agent, so the names of one call are bounded.
MAX_ASKED = 10_000
KNOWN_FILTERS = ("source", "kind", "type", "channel", "author", "since", "until", "query")
#: Which table holds the ids of a kind.
KIND_TABLE = {"msg": "messages", "event": "actions", "agent": "agents", "period": "periods", "goal": "periods", "artifact": "artifacts"}


def parse_time(value: str | date | datetime | None, end: bool = False) -> datetime | None:
    """A month, date or time as naive UTC.  With ``end`` a bare month or date means the
    moment after it, so that ``until`` can name the last day wanted."""
    if value is None or isinstance(value, datetime):
        out = value
    else:
        text = value.isoformat() if isinstance(value, date) else value.strip()
        if len(text) == 7:
            out = datetime.strptime(text, "%Y-%m")
            return (out.replace(day=28) + timedelta(days=4)).replace(day=1) if end else out
        if len(text) == 10:
            return datetime.strptime(text, "%Y-%m-%d") + timedelta(days=1 if end else 0)
        out = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return out.astimezone(timezone.utc).replace(tzinfo=None) if out is not None and out.tzinfo else out


def author_is(author: Column, who: str) -> Column:
    """All humans for ``human``, else the exact id."""
    return author.startswith("human:") if who == "human" else author == who


def record_filter(table: str, source: str | None = None, channel: str | None = None, author: str | None = None, since=None, until=None) -> Column:
    """The common filter: times are half-open, channels exist for messages only."""
    if table not in AUTHOR:
        raise ValueError(f"no such table of records: {table!r}")
    if channel is not None and table != "messages":
        raise ValueError("only messages have a channel")
    out = F.lit(True)
    if source:
        out &= F.col("source") == source
    if channel is not None:
        out &= F.col("channel") == channel
    if author:
        out &= author_is(F.col(AUTHOR[table]), author)
    if since is not None:
        out &= F.col("ts") >= F.lit(parse_time(since)).cast("timestamp_ntz")
    if until is not None:
        out &= F.col("ts") < F.lit(parse_time(until, end=True)).cast("timestamp_ntz")
    return out


def standard(messages: DataFrame, actions: DataFrame, text: bool = True) -> DataFrame:
    """Messages and actions in one shape."""
    body = lambda df: F.col("content") if text and "content" in df.columns else F.lit(None).cast("string")
    kind = lambda df, c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    one = messages.select(
        "evidence_id", "source", F.lit("msg").alias("kind"), kind(messages, "msg_type").alias("type"), "ts",
        F.col("author_id").alias("actor"), F.col("channel").alias("location"), body(messages).alias("text"),
    )
    two = actions.select(
        "evidence_id", "source", F.lit("event").alias("kind"), F.col("kind").alias("type"), "ts",
        F.col("agent_id").alias("actor"), F.lit(None).cast("string").alias("location"), body(actions).alias("text"),
    )
    return one.unionByName(two)


def select_records(records: DataFrame, **filters) -> DataFrame:
    """Standard records by the filter vocabulary; an unknown key is an error.  Lists mean any of."""
    unknown = set(filters) - set(KNOWN_FILTERS)
    if unknown:
        raise ValueError(f"unknown filters: {', '.join(sorted(unknown))}")
    out = records
    for key, column in (("source", "source"), ("type", "type"), ("channel", "location")):
        if (v := filters.get(key)) is not None:
            out = out.where(F.col(column).isin(*([v] if isinstance(v, str) else v)))
    if (v := filters.get("kind")) is not None:
        parts = [v] if isinstance(v, str) else v
        test = F.lit(False)
        for p in parts:
            source, _, kind = p.rpartition(":")
            test |= (F.col("kind") == kind) & (F.col("source") == source if source else F.lit(True))
        out = out.where(test)
    if (v := filters.get("author")) is not None:
        out = out.where(author_is(F.col("actor"), v))
    if (v := filters.get("since")) is not None:
        out = out.where(F.col("ts") >= F.lit(parse_time(v)).cast("timestamp_ntz"))
    if (v := filters.get("until")) is not None:
        out = out.where(F.col("ts") < F.lit(parse_time(v, end=True)).cast("timestamp_ntz"))
    if (v := filters.get("query")) is not None:
        out = out.where(matches(F.col("text"), v))
    return out


def in_order(df: DataFrame, id_col: str = "evidence_id", descending: bool = False) -> DataFrame:
    """The total order of records: by time with unknown times last, then by id."""
    ts, key = F.col("ts"), F.col(id_col)
    return df.orderBy(ts.desc_nulls_last(), key.desc()) if descending else df.orderBy(ts.asc_nulls_last(), key)


def page(df: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """One page of an ordered frame; limits are clipped to 1..200."""
    return df.offset(max(0, offset)).limit(max(1, min(200, limit)))


def search(messages: DataFrame, query: str, how: str = "phrase", limit: int = 20, offset: int = 0, width: int = 200, **filters) -> DataFrame:
    """A page of the messages that match, oldest first, with a snippet each."""
    found = messages.where(record_filter("messages", **filters)).where(matches(F.col("content"), query, how))
    out = page(in_order(found), limit, offset)
    return out.withColumn("snippet", snippet(F.col("content"), query if how == "phrase" else query.split()[0], width))


def within_budget(df: DataFrame, order: list[Column], budget: int = 80_000) -> DataFrame:
    """The first rows whose JSON fits the budget together; the first row always stays.

    An empty object takes two characters already, so no more than half the budget's rows can fit: only so many, the first in order, are
    ever brought together."""
    size = F.length(F.to_json(F.struct(*df.columns)))
    df = df.orderBy(*order).limit(budget // 2 + 1)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)  # over the rows that one response may hold
    return df.withColumn("_at", F.row_number().over(Window.orderBy(*order))).withColumn("_sum", F.sum(size).over(w)).where((F.col("_sum") <= budget) | (F.col("_at") == 1)).drop("_sum", "_at")


def neighbours(records: DataFrame, wanted: DataFrame, before: int = 3, after: int = 3, group: str = "channel") -> DataFrame:
    """For each wanted id, the records up to so many places before and after it in its group
    (a null group is a group).  Places are numbered once; the rest is an equi-join per offset."""
    w = Window.partitionBy(group).orderBy("ts", "evidence_id")
    placed = records.where(F.col("ts").isNotNull()).withColumn("place", F.row_number().over(w))
    asked = placed.join(wanted.select("evidence_id").distinct(), "evidence_id").select(
        F.col("evidence_id").alias("asked_id"), F.col(group).alias("_g"), F.explode(F.sequence(F.col("place") - before, F.col("place") + after)).alias("place"), F.col("place").alias("_at")
    )
    asked = asked.select("asked_id", "_g", F.col("place").alias("_p"), (F.col("place") - F.col("_at")).alias("offset"))
    return placed.join(asked, placed[group].eqNullSafe(asked["_g"]) & (placed["place"] == asked["_p"])).drop("_g", "_p", "place")


def split_evidence_id(column: str = "evidence_id") -> list[Column]:
    """source, kind and native id; the native id may contain colons."""
    parts = F.split(F.col(column), ":", 3)
    return [F.get(parts, 0).alias("source"), F.get(parts, 1).alias("kind"), F.get(parts, 2).alias("native_id")]


def resolve(ids: DataFrame, known: DataFrame) -> DataFrame:
    """Each id with the table that holds it, or why it does not resolve (``malformed``, ``missing``).

    ``known`` has (evidence_id, table) of all tables.  Bulk resolution is one join.
    """
    well = F.col("evidence_id").rlike(r"^[A-Za-z0-9_.\-]+:[A-Za-z0-9_.\-]+:.+")
    found = ids.join(known.select("evidence_id", F.col("table").alias("found_in")).distinct(), "evidence_id", "left")
    return found.withColumn("problem", F.when(~well, "malformed").when(F.col("found_in").isNull(), "missing"))


def resolve_agents(names: DataFrame, agents: DataFrame) -> DataFrame:
    """(asked, agent_id, how, candidates): the best kind of match wins; more than one agent at it is ambiguous.

    In order: exact id, last part of the id, display name, alias, part of the name.
    """
    asked = names.select(F.col("name").alias("asked"), name_key(F.col("name")).alias("key")).distinct()
    if asked.limit(MAX_ASKED + 1).count() > MAX_ASKED:
        raise ValueError(f"at most {MAX_ASKED} names at once")
    label = name_key(F.col("display_name"))
    ranked_key = lambda k, rank: F.struct(k.alias("k"), F.lit(rank).alias("rank"))
    ids = agents.select("agent_id", F.inline(F.array(ranked_key(F.col("agent_id"), 1), ranked_key(F.element_at(F.split("agent_id", ":"), -1), 2))))
    aliases = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda x: ranked_key(name_key(x), 4))
    titles = agents.select("agent_id", F.inline(F.concat(F.array(ranked_key(label, 3)), aliases)))
    ranked = asked.join(ids, F.col("asked") == F.col("k")).select("asked", "agent_id", "rank")
    ranked = ranked.union(asked.join(titles, F.col("key") == F.col("k")).select("asked", "agent_id", "rank"))
    # Only names that equal nothing are looked for within names: every part of a name, which is short, is a key too.
    left = asked.where("key <> ''").join(ranked.select("asked").distinct(), "asked", "left_anti")
    starts = F.sequence(F.lit(1), F.length("label"))
    parts = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.length("label") - i + 1), lambda n: F.substring(F.col("label"), i, n))))
    held = agents.select("agent_id", label.alias("label")).where("label <> ''").select("agent_id", F.explode(F.array_distinct(parts)).alias("key"))
    ranked = ranked.union(left.join(held, "key").select("asked", "agent_id", F.lit(5))).distinct()
    best = ranked.groupBy("asked", "rank").agg(F.min("agent_id").alias("agent_id"), F.count(F.lit(1)).alias("candidates"))
    top = best.groupBy("asked").agg(F.min_by(F.struct("agent_id", "rank", "candidates"), "rank").alias("b"))
    kinds = F.array(*[F.lit(x) for x in ("id", "suffix", "name", "alias", "part")])
    out = asked.select("asked").distinct().join(top, "asked", "left")
    one = F.col("b.candidates") == 1
    return out.select("asked", F.when(one, F.col("b.agent_id")).alias("agent_id"), F.get(kinds, F.col("b.rank") - 1).alias("how"), F.coalesce("b.candidates", F.lit(0)).alias("candidates"))


def suggestions(name: str, agents: DataFrame, n: int = 3) -> DataFrame:
    """The display names closest to one that resolves to nothing."""
    far = F.levenshtein(name_key(F.col("display_name")), F.lit(name.lower()))
    return agents.select("agent_id", "display_name", far.alias("distance")).orderBy("distance", "agent_id").limit(n)


def resolve_channel(channels: DataFrame, name: str) -> DataFrame:
    """Channels that are ``name``, whatever the case, with or without ``#``."""
    return channels.select("channel").distinct().where(F.lower("channel") == name.lstrip("#").lower())


def condition(column: Column, op: str, value=None) -> Column:
    """A mapping's row condition; values compare as text."""
    text = column.cast("string")
    if op == "==":
        return F.coalesce(text == str(value), F.lit(False))
    if op == "!=":
        return F.coalesce(text != str(value), F.lit(True))
    if op in ("in", "not_in"):
        test = F.coalesce(text.isin(*[str(v) for v in value]), F.lit(False))
        return test if op == "in" else ~test
    if op == "exists":
        return column.isNotNull()
    if op == "missing":
        return column.isNull()
    if op == "contains":
        return F.coalesce(text.contains(str(value)), F.lit(False))
    raise ValueError(f"unknown condition: {op!r}")


def counted_page(records: DataFrame, limit: int = 50, offset: int = 0) -> tuple[DataFrame, dict]:
    """A page of records in order, and what a reader needs to go on: total, has_more, next_offset."""
    total = records.count()
    more = offset + limit < total
    return page(in_order(records), limit=limit, offset=offset), {"total": total, "has_more": more, "next_offset": offset + limit if more else None}


def found(records: DataFrame, query: str, how: str = "phrase", text: str = "content", limit: int = 50, offset: int = 0, width: int = 200) -> DataFrame:
    """A page of the matches of a search with their snippets and, on every row, how many matches there are in all."""
    hits = records.where(matches(F.col(text), query, how))
    total = hits.agg(F.count(F.lit(1)).alias("total"))  # one row
    rows = page(in_order(hits), limit=limit, offset=offset)
    return rows.withColumn("snippet", snippet(F.col(text), query if how == "phrase" else (query.split() or [""])[0], width)).crossJoin(F.broadcast(total))


def outside_actors(messages: DataFrame, agents: DataFrame) -> DataFrame:
    """(kind, actors, records): records of authors that no row of ``agents`` has, by what their ids start with."""
    rows = messages.where("author_id IS NOT NULL").join(agents.select(F.col("agent_id").alias("author_id")), "author_id", "left_anti")
    kind = F.when(F.col("author_id").contains(":"), F.split_part("author_id", F.lit(":"), F.lit(1))).otherwise("unknown")
    per = rows.groupBy(kind.alias("kind"), "author_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("kind").agg(F.count(F.lit(1)).alias("actors"), F.sum("n").alias("records"))


def previous_of_author(messages: DataFrame, n: int = 3) -> DataFrame:
    """(evidence_id, earlier): each message with its author's ``n`` messages before, the nearest first."""
    rows = messages.select("evidence_id", "author_id", "ts").where("author_id IS NOT NULL AND ts IS NOT NULL")
    carried = "evidence_id"
    for i in range(1, n + 1):
        rows = with_previous(rows, ["author_id"], {f"p{i}": F.col(carried)})
        carried = f"p{i}"
    return rows.select("evidence_id", F.array_compact(F.array(*[f"p{i}" for i in range(1, n + 1)])).alias("earlier"))
