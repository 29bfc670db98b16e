"""Foreign datasets: a declarative mapping compiled to projections, a profile, and a check.

A mapping is ``{"messages": {...}, "actions": {...}, "agents": {...}}``.  Each table's entry has ``from`` (a glob over table
names), optionally ``where`` (``[[path, op, value], ...]``), and fields by target column.  A field is a
path, or ``{"path", "values", "default", "lookup": {"from", "key", "value"}, "time", "split", "const"}``.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions.text import name_key
from tracewell.functions.time import parse
from tracewell.operators.records import condition
from tracewell.sources.readers import matching

TARGETS = {
    "messages": ("evidence_id", "source", "channel", "author_id", "recipient_ids", "reply_to", "ts", "msg_type", "content"),
    "actions": ("evidence_id", "source", "agent_id", "run_id", "seq", "ts", "kind", "content"),
    "agents": ("agent_id", "source", "display_name", "aliases"),
}
KIND = {"messages": "msg", "actions": "event", "agents": "agent"}
LOOKUP_ROWS = 1_000_000
#: Words in a field's name that suggest its role.
ROLE_WORDS = {
    "id": ("id", "key", "uuid", "no"), "time": ("time", "date", "created", "sent", "stamp", "ts", "at", "posted"), "actor": ("author", "from", "sender", "speaker", "user", "nick", "agent"),
    "actor_type": ("type", "kind", "role"), "location": ("channel", "room", "thread", "chan"), "text": ("text", "content", "body", "message", "said"), "reply_to": ("reply", "parent"), "recipients": ("to", "recipients", "mentions"),
}


def path_column(df: DataFrame, path: str) -> Column:
    """A dotted path; through an array it collects, and where nothing is there it is null."""
    parts = path.split(".")
    kind: T.DataType = df.schema
    for p in parts:
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        if not isinstance(kind, T.StructType) or p not in kind.names:
            return F.lit(None).cast("string")
        kind = kind[p].dataType
    return F.col(".".join(f"`{p}`" for p in parts))


def _field(df: DataFrame, spec: Any, found: dict[str, DataFrame], joins: list[tuple[DataFrame, str, Column]]) -> Column:
    if not isinstance(spec, dict):
        spec = {"path": spec}
    if "const" in spec:
        return F.lit(spec["const"])
    out = path_column(df, spec["path"])
    if "split" in spec:
        out = F.filter(F.transform(F.split(out.cast("string"), spec["split"]), lambda x: F.trim(x)), lambda x: x != "")
    if "lookup" in spec:
        table = reduce(DataFrame.unionByName, matching(found, spec["lookup"]["from"]).values())
        name = f"_lookup{len(joins)}"
        key, value = path_column(table, spec["lookup"]["key"]), path_column(table, spec["lookup"]["value"])
        # The first row of a key wins: rows are numbered as they are read, file by file.
        rows = table.select(key.cast("string").alias(f"{name}_k"), value.cast("string").alias(name), F.monotonically_increasing_id().alias("_n")).where(F.col(f"{name}_k").isNotNull())
        first = rows.groupBy(f"{name}_k").agg(F.min_by(name, "_n").alias(name))
        joins.append((first, f"{name}_k", out.cast("string")))
        out = F.col(name)
    if "values" in spec:
        table = F.create_map(*[F.lit(str(x)) for pair in spec["values"].items() for x in pair])
        out = F.coalesce(F.try_element_at(table, out.cast("string")), out.cast("string"))
    if "time" in spec:
        out = parse(out, spec["time"])
    if "default" in spec:
        out = F.coalesce(out, F.lit(spec["default"]))
    return out


def apply(mapping: dict, found: dict[str, DataFrame], source: str) -> dict[str, DataFrame]:
    """The store tables that the mapping makes of the found tables."""
    out: dict[str, DataFrame] = {}
    for target, spec in mapping.items():
        parts = []
        for df in matching(found, spec["from"]).values():
            for path, op, *value in spec.get("where", ()):
                df = df.where(condition(path_column(df, path), op, *value))
            joins: list[tuple[DataFrame, str, Column]] = []
            columns = {c: _field(df, f, found, joins) for c, f in spec["fields"].items()}
            for table, key, on in joins:
                small = table.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS
                df = df.join(F.broadcast(table) if small else table, on == F.col(key), "left")
            parts.append(df.select(*[c.alias(n) for n, c in columns.items()]))
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        key = "agent_id" if target == "agents" else "evidence_id"
        rows = rows.withColumn("source", F.lit(source))
        rows = rows.withColumn(key, F.concat_ws(":", F.lit(source), F.lit(KIND[target]), F.col(key).cast("string")))
        for c in TARGETS[target]:
            if c not in rows.columns:
                kind = "array<string>" if c in ("recipient_ids", "aliases") else "timestamp_ntz" if c == "ts" else "string"
                rows = rows.withColumn(c, F.lit(None).cast(kind))
        out[target] = rows.select(*TARGETS[target])
    if "agents" not in out and "messages" in out:
        out["agents"] = derived_agents(out["messages"], source)
    return out


def derived_agents(messages: DataFrame, source: str) -> DataFrame:
    """Agents from the authors, where no table lists them."""
    names = messages.select("author_id").where(F.col("author_id").isNotNull() & ~F.col("author_id").startswith("human:")).distinct()
    return names.select(
        F.concat_ws(":", F.lit(source), F.lit("agent"), F.col("author_id")).alias("agent_id"), F.lit(source).alias("source"), F.col("author_id").alias("display_name"), F.array().cast("array<string>").alias("aliases")
    )


def resolved_authors(rows: DataFrame, agents: DataFrame, column: str = "author_id") -> DataFrame:
    """``rows`` with ids for the names in ``column``: by id, else by name or alias if one agent alone has it."""
    names = agents.select("agent_id", F.explode(F.array_distinct(F.concat(F.array(name_key(F.col("display_name"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), name_key)))).alias("_n"))
    names = names.groupBy("_n").agg(F.min("agent_id").alias("_by_name"), F.count(F.lit(1)).alias("_c")).where("_c = 1").drop("_c")
    ids = agents.select(F.element_at(F.split("agent_id", ":"), -1).alias("_i"), F.col("agent_id").alias("_by_id"))
    out = rows.join(ids, F.col(column) == F.col("_i"), "left").join(names, name_key(F.col(column)) == F.col("_n"), "left")
    return out.withColumn(column, F.coalesce("_by_id", "_by_name", column)).drop("_i", "_by_id", "_n", "_by_name")


def profile(df: DataFrame, cap: int = 5000) -> DataFrame:
    """(field, type, rows, nulls, empties, distinct, avg_length, time_rate, role): one pass over all columns, and
    the role each field's name and values suggest."""
    flat = [(f.name, f.dataType) for f in df.schema if not isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType))]
    aggs = []
    for name, _ in flat:
        text = F.col(f"`{name}`").cast("string")
        aggs.append(
            F.struct(
                F.count(F.lit(1)).alias("rows"), F.count(F.when(text.isNull(), 1)).alias("nulls"), F.count(F.when(F.trim(text) == "", 1)).alias("empties"),
                F.least(F.approx_count_distinct(text), F.lit(cap)).alias("distinct"), F.avg(F.length(text)).alias("avg_length"), F.avg(F.when(text.isNotNull(), parse(text).isNotNull().cast("int"))).alias("time_rate"),
            ).alias(name)
        )
    one = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(t.simpleString()).alias("type"), F.col(f"`{n}`").alias("s")) for n, t in flat])
    out = one.select(F.explode(rows).alias("r")).select("r.field", "r.type", "r.s.*")
    words = F.split(F.lower(F.regexp_replace("field", "([a-z0-9])([A-Z])", "$1 $2")), r"[^a-z0-9]+| ")
    points = {role: F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in names]))) * 2 for role, names in ROLE_WORDS.items()}
    points["time"] += F.when(F.col("time_rate") > 0.9, 3).otherwise(0)
    points["text"] += F.when(F.col("avg_length") > 40, 3).otherwise(0)
    points["id"] += F.when((F.col("distinct") >= F.least(F.lit(cap), F.col("rows")) * 0.95) & (F.col("time_rate") < 0.9), 1).otherwise(0)
    best = F.array_max(F.array(*[F.struct(p.cast("int").alias("p"), F.lit(-i).alias("o"), F.lit(r).alias("r")) for i, (r, p) in enumerate(points.items())]))
    return out.withColumn("_b", best).withColumn("role", F.when(F.col("_b.p") > 0, F.col("_b.r"))).drop("_b")


def foreign_key_overlap(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """One row: the share of the column's distinct values that the key holds."""
    a = child.select(F.col(column).cast("string").alias("v")).where("v IS NOT NULL").distinct()
    b = parent.select(F.col(key).cast("string").alias("v"), F.lit(1).alias("hit")).distinct()
    return a.join(b, "v", "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("overlap"), F.count(F.lit(1)).alias("values"))


def check(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, code, n) of what is wrong: no id, repeated ids, no time, times out of range, no author, unknown authors,
    empty texts, replies to nothing."""
    out = []
    for name, df in tables.items():
        key = "agent_id" if name == "agents" else "evidence_id"
        w = Window.partitionBy(key)
        codes = {"id_missing": F.col(key).isNull() | F.col(key).endswith(":"), "id_repeated": F.col("_n") > 1}
        if "ts" in df.columns:
            codes |= {"time_missing": F.col("ts").isNull(), "time_out_of_range": ~F.year("ts").between(1990, 2100)}
        actor = {"messages": "author_id", "actions": "agent_id"}.get(name)
        if actor:
            codes["author_missing"] = F.col(actor).isNull()
        if "content" in df.columns:
            codes["text_empty"] = F.coalesce(F.trim("content"), F.lit("")) == ""
        counts = df.withColumn("_n", F.count(F.lit(1)).over(w)).agg(*[F.count(F.when(c, 1)).alias(k) for k, c in codes.items()])
        cells = F.array(*[F.struct(F.lit(name).alias("table"), F.lit(k).alias("code"), F.col(k).alias("n")) for k in codes])
        out.append(counts.select(F.explode(cells).alias("c")).select("c.*"))
    if "messages" in tables and "reply_to" in tables["messages"].columns:
        m = tables["messages"]
        lost = m.where("reply_to IS NOT NULL").join(m.select(F.col("evidence_id").alias("reply_to")).distinct(), "reply_to", "left_anti")
        out.append(lost.agg(F.count(F.lit(1)).alias("n")).select(F.lit("messages").alias("table"), F.lit("reply_unresolved").alias("code"), "n"))
    return reduce(DataFrame.unionByName, out).where("n > 0")


def draft(profiles: dict[str, list], table: str) -> dict:
    """A mapping of ``table``'s fields from the roles its profile suggests (rows as collected)."""
    target = {"id": "evidence_id", "time": "ts", "actor": "author_id", "location": "channel", "text": "content", "reply_to": "reply_to", "recipients": "recipient_ids"}
    fields: dict[str, Any] = {}
    for row in profiles[table]:
        column = target.get(row["role"])
        if column and column not in fields:
            fields[column] = {"path": row["field"], "time": "auto"} if column == "ts" else {"path": row["field"], "split": "[;,]"} if column == "recipient_ids" else row["field"]
    return {"messages": {"from": table, "fields": fields}}
