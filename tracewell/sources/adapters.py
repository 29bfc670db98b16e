"""Adapters: known recordings to store tables.  Each returns DataFrames by table name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions.names import alias_table, mentions
from tracewell.functions.time import parse
from tracewell.sources.readers import read_jsonl, read_sqlite

#: A file name of the format, and the event kinds that become actions.
GOALS_FILE = "village_goals.jsonl.gz"
ROOM_ACTIONS = ("START_COMPUTER_USE_SESSION", "STOP_COMPUTER_USE_SESSION", "CONSOLIDATE", "SEARCH_HISTORY", "WAIT")
GOAL_KINDS = (("compet", "competition"), ("fundrais", "fundraising"), ("charity", "fundraising"), ("game", "game"), ("event", "event"), ("research", "research"), ("write", "creative"), ("free", "free time"))
#: Rosters that are small enough for a literal pattern of names.
MAX_ROSTER = 2000


def _id(source: str, kind: str, native: Column) -> Column:
    return F.concat(F.lit(f"{source}:{kind}:"), native.cast("string"))


def goal_kind(label: Column) -> Column:
    """The kind of a goal by the first word stem that its text holds."""
    out = None
    for stem, kind in GOAL_KINDS:
        test = F.lower(label).contains(stem)
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("other")


def agent_rooms(spark: SparkSession, root: str, source: str = "rooms") -> dict[str, DataFrame]:
    """Agents, chat, goals and events, gzipped JSON lines, as agents, messages, periods and actions.

    Event lines are filtered as text before they are parsed, as most are of kinds that are not kept.
    Recipients are the agents that a message names, its author left out.
    """
    people = read_jsonl(spark, f"{root}/agents.jsonl.gz", "id string, name string, model_string string, created_at string, is_participating boolean")
    rooms = read_jsonl(spark, f"{root}/chat_rooms.jsonl.gz", "id string, name string")
    chat = read_jsonl(spark, f"{root}/chat_messages.jsonl.gz", "id string, agent_speaker_id string, user_speaker_id string, speaker_type string, content string, room_id string, created_at string")
    goals = read_jsonl(spark, f"{root}/{GOALS_FILE}", "id string, goal string, start_time string, end_time string")
    lines = spark.read.text(f"{root}/events.jsonl.gz").where(F.col("value").rlike("|".join(ROOM_ACTIONS)))
    shape = "id string, created_at string, data struct<actionType: string, agentId: string, speakerId: string, computerUseSessionId: string, sessionGoal: string, nextSessionGoal: string, summary: string, content: string>"
    raw = lines.select(F.from_json("value", shape).alias("e")).select("e.*").where(F.col("data.actionType").isin(*ROOM_ACTIONS))

    roster = people.select("id", "name").limit(MAX_ROSTER + 1).collect()
    if len(roster) > MAX_ROSTER:
        raise ValueError(f"more than {MAX_ROSTER} agents")
    aliases = alias_table([(f"{source}:agent:{r['id']}", r["name"] or "", []) for r in roster])
    author = F.when(F.col("agent_speaker_id").isNotNull(), _id(source, "agent", F.col("agent_speaker_id"))).otherwise(F.concat(F.lit("human:"), F.coalesce("user_speaker_id", F.lit("unknown"))))
    named = chat.join(rooms.select(F.col("id").alias("room_id"), F.col("name").alias("channel")), "room_id", "left")
    messages = named.select(
        _id(source, "msg", F.col("id")).alias("evidence_id"), F.lit(source).alias("source"), F.coalesce("channel", "room_id").alias("channel"), author.alias("author_id"),
        F.array_remove(F.coalesce(mentions(F.col("content"), aliases), F.array().cast("array<string>")), author).alias("recipient_ids"), parse(F.col("created_at"), "iso").alias("ts"), F.lit("chat").alias("msg_type"), "content",
    )
    who = F.coalesce("data.agentId", "data.speakerId")
    actions = raw.where(who.isNotNull()).select(
        _id(source, "event", F.col("id")).alias("evidence_id"), F.lit(source).alias("source"), _id(source, "agent", who).alias("agent_id"), F.col("data.computerUseSessionId").alias("run_id"),
        parse(F.col("created_at"), "iso").alias("ts"), F.lower("data.actionType").alias("kind"), F.coalesce("data.sessionGoal", "data.nextSessionGoal", "data.summary", "data.content").alias("content"),
    )
    periods = goals.select(
        _id(source, "goal", F.col("id")).alias("evidence_id"), F.lit(source).alias("source"), F.lit("goal").alias("kind"), F.col("goal").alias("label"), goal_kind(F.col("goal")).alias("goal_kind"),
        parse(F.col("start_time"), "iso").alias("start_ts"), parse(F.col("end_time"), "iso").alias("end_ts"),
    )
    seen = messages.select(F.col("author_id").alias("agent_id"), "ts").unionByName(actions.select("agent_id", "ts")).groupBy("agent_id").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    agents = people.select(_id(source, "agent", F.col("id")).alias("agent_id"), F.lit(source).alias("source"), F.col("name").alias("display_name"), F.array().cast("array<string>").alias("aliases"), F.col("model_string").alias("model"), "is_participating")
    agents = agents.join(seen, "agent_id", "left").where(F.col("is_participating") | F.col("first_seen").isNotNull()).drop("is_participating")
    return {"agents": agents, "messages": messages, "actions": actions, "periods": periods}


def added_lines(revisions: DataFrame, page: str = "page_key", order: str = "sequence", body: str = "body") -> DataFrame:
    """``revisions`` with ``added``, the lines that the revision before did not have, and ``removed``.  A line that stands there more
    often than before counts as added for each time more."""
    w = Window.partitionBy(page).orderBy(order)
    lines = revisions.withColumn("_l", F.split(F.coalesce(body, F.lit("")), "\n")).withColumn("_b", F.coalesce(F.lag("_l").over(w), F.array().cast("array<string>")))
    # The nth occurrence of a line is told apart from the others by its number.
    occurs = lambda c: F.transform(F.col(c), lambda x, i: F.struct(x.alias("line"), F.size(F.filter(F.slice(F.col(c), 1, i + 1), lambda y: y == x)).alias("nth")))
    more = lambda a, b: F.transform(F.array_except(a, b), lambda x: x["line"])
    numbered = lines.withColumn("_l", occurs("_l")).withColumn("_b", occurs("_b"))
    return numbered.withColumn("added", more(F.col("_l"), F.col("_b"))).withColumn("removed", more(F.col("_b"), F.col("_l"))).drop("_l", "_b")


def wiki(pages: DataFrame, revisions: DataFrame, source: str = "wiki") -> dict[str, DataFrame]:
    """Pages (page_key, name) and revisions (revision_id, page_key, sequence, label, time, body) as messages of added
    lines, artifacts and touches; ``[[links]]`` to other pages are mentions."""
    diffs = added_lines(revisions)
    text = F.array_join(F.filter("added", lambda x: F.trim(x) != ""), "\n")
    known = pages.select(F.lower("name").alias("_n"), _id(source, "artifact", F.col("page_key")).alias("target"))
    record, page = _id(source, "msg", F.col("revision_id")), _id(source, "artifact", F.col("page_key"))
    rows = diffs.select(record.alias("evidence_id"), F.lit(source).alias("source"), page.alias("artifact_id"), F.col("label").alias("author_id"), parse(F.col("time")).alias("ts"), text.alias("content"), "sequence", F.size("added").alias("n_added"), F.size("removed").alias("n_removed"))
    named = rows.join(pages.select(page.alias("artifact_id"), F.col("name").alias("channel")), "artifact_id", "left")
    first = F.row_number().over(Window.partitionBy("artifact_id").orderBy("sequence")) == 1
    ops = rows.withColumn("op", F.when(first, "create").when((F.col("n_added") == 0) & (F.col("n_removed") > 0), "delete").otherwise("modify")).select("source", F.col("evidence_id").alias("record_id"), "artifact_id", "op", "ts")
    links = rows.select("source", "evidence_id", "artifact_id", "ts", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\[\[([^\]|#]+)"), F.lit(1)))).alias("_link"))
    linked = links.join(known, F.lower(F.trim("_link")) == F.col("_n")).where("target <> artifact_id").select("source", F.col("evidence_id").alias("record_id"), F.col("target").alias("artifact_id"), F.lit("mention").alias("op"), "ts")
    touches = ops.unionByName(linked).withColumn("touch_id", F.concat_ws("|", "record_id", "op", "artifact_id")).dropDuplicates(["touch_id"])
    artifacts = pages.select(page.alias("artifact_id"), F.lit(source).alias("source"), F.lit("page").alias("kind"), "name")
    messages = named.where(F.trim("content") != "").select("evidence_id", "source", "channel", "author_id", "ts", F.lit("edit").alias("msg_type"), "content")
    return {"messages": messages, "artifacts": artifacts, "touches": touches}


def recordings(spark: SparkSession, path: str, source: str = "live") -> dict[str, DataFrame]:
    """A recorder's SQLite file as agents, periods (sessions), messages, actions, artifacts and touches.  The first
    write of a file by a tool creates it, later ones modify it."""
    people, acts, said = (read_sqlite(spark, path, t) for t in ("agents", "actions", "messages"))
    when = lambda c: F.timestamp_micros((F.col(c) * 1_000_000).cast("long")).cast("timestamp_ntz")
    agents = people.select(_id(source, "agent", F.col("key")).alias("agent_id"), F.lit(source).alias("source"), F.coalesce("label", "key").alias("display_name"), F.array().cast("array<string>").alias("aliases"), when("started").alias("first_seen"), when("stopped").alias("last_seen"), _id(source, "agent", F.col("parent_key")).alias("parent_id"))
    messages = said.select(_id(source, "msg", F.col("id")).alias("evidence_id"), F.lit(source).alias("source"), F.col("session_id").alias("channel"), _id(source, "agent", F.col("agent_key")).alias("author_id"), when("ts").alias("ts"), F.col("source").alias("msg_type"), F.col("text").alias("content"))
    actions = acts.select(_id(source, "event", F.col("id")).alias("evidence_id"), F.lit(source).alias("source"), _id(source, "agent", F.col("agent_key")).alias("agent_id"), F.col("session_id").alias("run_id"), when("ts").alias("ts"), F.col("tool").alias("kind"), F.col("input").alias("content"), "status")
    periods = acts.groupBy("session_id").agg(F.min("ts").alias("a"), F.max(F.coalesce("ts_end", "ts")).alias("b")).select(_id(source, "period", F.col("session_id")).alias("evidence_id"), F.lit(source).alias("source"), F.lit("session").alias("kind"), F.col("session_id").alias("label"), when("a").alias("start_ts"), when("b").alias("end_ts"))
    file = F.coalesce(F.get_json_object("input", "$.file_path"), F.get_json_object("input", "$.path"))
    used = acts.withColumn("file", file).where("file IS NOT NULL AND coalesce(status, '') <> 'error'")
    writes = F.lower("tool").rlike("write|edit|create")
    n = F.row_number().over(Window.partitionBy("file", writes).orderBy("ts", "id"))
    op = F.when(~writes, "read").when((n == 1) & F.lower("tool").rlike("write|create"), "create").otherwise("modify")
    touches = used.withColumn("op", op).select(F.lit(source).alias("source"), _id(source, "event", F.col("id")).alias("record_id"), _id(source, "artifact", F.col("file")).alias("artifact_id"), "op", when("ts").alias("ts"))
    touches = touches.withColumn("touch_id", F.concat_ws("|", "record_id", "op", "artifact_id"))
    artifacts = used.select(_id(source, "artifact", F.col("file")).alias("artifact_id"), F.lit(source).alias("source"), F.lit("file").alias("kind"), F.col("file").alias("name")).distinct()
    return {"agents": agents, "messages": messages, "actions": actions, "periods": periods, "artifacts": artifacts, "touches": touches}


def landed(commits: DataFrame, pulls: DataFrame) -> DataFrame:
    """(pull, state): how pull requests reached the main line, from (sha, parents, patch_id) of the main line and
    (pull, head_sha, merge_sha, patch_ids, closed) of the requests: merged, fast-forwarded, squashed (all patches, or their
    sum, are there under other ids) or unmerged."""
    main = commits.select(F.col("sha").alias("_sha"), F.lit(1).alias("_on"))
    by_merge = pulls.join(main, F.col("merge_sha") == F.col("_sha"), "left").withColumn("merged", F.col("_on").isNotNull()).drop("_sha", "_on")
    by_head = by_merge.join(main, F.col("head_sha") == F.col("_sha"), "left").withColumn("forward", F.col("_on").isNotNull()).drop("_sha", "_on")
    patches = commits.select(F.col("patch_id").alias("p"), F.lit(1).alias("hit")).distinct()
    held = pulls.select("pull", F.explode("patch_ids").alias("p")).join(patches, "p", "left").groupBy("pull").agg(F.min(F.coalesce("hit", F.lit(0))).alias("all_there"))
    out = by_head.join(held, "pull", "left")
    return out.select("pull", F.when(F.col("merged"), "merged").when(F.col("forward"), "landed").when(F.col("all_there") == 1, "landed").when(F.col("closed"), "unmerged").otherwise("open").alias("state"))
