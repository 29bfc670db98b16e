"""Mentions: whom a text names, from a roster of names and aliases."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alias_table(roster: list[tuple[str, str, list[str]]]) -> dict[str, str]:
    """Lower-cased alias to agent id, from (id, display name, aliases).  A short form drops a name's last
    word if that is a number or version; an alias of two agents names nobody."""
    found: dict[str, set[str]] = {}
    for agent_id, name, aliases in roster:
        forms = {name, *aliases}
        forms |= {re.sub(r"[\s_-]+v?\d+(\.\d+)*$", "", f) for f in forms}
        for f in forms:
            key = re.sub(r"[\s_-]+", " ", f.strip().lower())
            if len(key) >= 3:
                found.setdefault(key, set()).add(agent_id)
    return {k: next(iter(v)) for k, v in found.items() if len(v) == 1}


def mention_pattern(aliases: dict[str, str]) -> str:
    """One alternation, longest alias first, that ends neither inside a word nor inside a version."""
    forms = sorted(aliases, key=lambda a: (-len(a), a))
    body = "|".join(re.escape(a).replace(r"\ ", r"[\s_-]+") for a in forms)
    return rf"(?<![\p{{L}}\p{{N}}_])(?:{body})(?![\p{{L}}\p{{N}}_]|[.-]\d)"


def mentions(text: Column, aliases: dict[str, str]) -> Column:
    """The ids that a text names, each once, in order of id.  The roster is a literal of the plan."""
    if not aliases:
        return F.array().cast("array<string>")
    table = F.create_map(*[F.lit(x) for pair in sorted(aliases.items()) for x in pair])
    hits = F.regexp_extract_all(F.lower(text), F.lit(mention_pattern(aliases)), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(hits, lambda h: F.try_element_at(table, F.regexp_replace(h, r"[\s_-]+", " ")))))


def active_mentions(messages: DataFrame, weak: DataFrame, before_days: int = 2, after_days: int = 14, text: str = "content") -> DataFrame:
    """(evidence_id, alias, agent_id): weak aliases resolve only where exactly one of their bearers is active.

    ``weak`` is (alias, agent_id, first_ts, last_ts).
    """
    words = messages.select("evidence_id", "ts", F.explode(F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))).alias("alias"))
    lo = F.col("first_ts") - F.expr(f"interval {before_days} days")
    hi = F.col("last_ts") + F.expr(f"interval {after_days} days")
    near = words.join(weak, "alias").where((F.col("ts") >= lo) & (F.col("ts") <= hi))
    return near.groupBy("evidence_id", "alias").agg(F.count(F.lit(1)).alias("n"), F.min("agent_id").alias("agent_id")).where("n = 1").drop("n")
