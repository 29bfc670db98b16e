"""Raw records of agents' work as a typed log: sessions with their ends, verdicts and actions of turns, and chat by its readings.

What a record needs from others is joined as of its time: a message's open session, the claim that it corrects or repeats, the
speaker's own last check of what it speaks of.  A window holds a few thousand records, capped; many windows are adapted at once, by
``window``, which is part of every key, so no task gathers more than one window's records.  What Python reads is staged, as much is
derived from it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell import staging
from tracewell.functions import chat, extract
from tracewell.functions.time import millis
from tracewell.operators.monitors import LOG
from tracewell.operators.ordered import beside, first, last, last_of_another

MAX_EVENTS = 1200
HUMANS = "humans"
KEYS = ["window", "agent"]


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def session_spans(sessions: DataFrame, boundaries: DataFrame) -> DataFrame:
    """``sessions`` (session, agent, ts, ...) with ``end_ts`` and ``end_reason``: the agent's next stop, or its next boundary that belongs
    to another session.  ``boundaries`` is (window, agent, ts, kind, session) with the kinds stop, consolidate and start."""
    at = boundaries.select("window", "agent", _micros("ts").alias("_us"), "ts", "kind", F.coalesce("session", F.lit("")).alias("owner")).where("agent IS NOT NULL")
    # Boundaries of one moment count once; a stop counts for every session, any other for all but its own.
    stops = at.where("kind = 'stop'").select("window", "agent", "_us", F.struct("_us", "ts", "kind").alias("b"))
    rows = sessions.withColumn("_us", _micros("ts")).withColumn("owner", F.col("session"))
    rows = beside(rows, stops, KEYS, after={"stop": first(F.col("b"))}, order="_us", block=None)
    rows = last_of_another(rows, at.where("kind <> 'stop'").select("window", "agent", "owner", "_us", "ts", "kind"), KEYS, "other", owner="owner", reverse=True, order="_us", block=None, ties=True)
    other = F.when(F.col("other").isNotNull(), F.struct(F.col("other._us").alias("_us"), F.col("other.ts").alias("ts"), F.col("other.kind").alias("kind")))
    end = F.least("stop", other)
    reason = F.when(end["kind"] == "stop", "stop").when(end["kind"] == "consolidate", "consolidate").when(end.isNotNull(), "next-start")
    return rows.withColumn("end_ts", end["ts"]).withColumn("end_reason", reason).drop("_us", "owner", "stop", "other")


def open_session(points: DataFrame, spans: DataFrame) -> DataFrame:
    """``points`` (window, agent, ts, ...) with ``task``, the agent's latest started session that is open then.

    A session that another overlaps is rare, so the latest started one is looked up first; only where that one is over already are the
    agent's sessions of the days around searched.
    """
    one = spans.select("window", "agent", F.col("ts").alias("s0"), "end_ts", "session")
    starts = one.select("window", "agent", _micros("s0").alias("_us"), F.struct("s0", "end_ts", "session").alias("s"))
    # A session that starts at the very moment counts as started.
    near = beside(points.withColumn("_us", _micros("ts") + 1), starts, KEYS, {"s": last(F.col("s"))}, order="_us", block=None).drop("_us")
    over = F.col("s.end_ts").isNotNull() & (F.col("s.end_ts") <= F.col("ts"))
    kept = near.where(F.col("s").isNull() | ~over).withColumn("task", F.col("s.session")).drop("s")
    rest = near.where(over).drop("s").withColumn("_id", F.monotonically_increasing_id())
    days = one.where("end_ts IS NOT NULL").withColumn("_day", F.explode(F.sequence(F.to_date("s0"), F.greatest(F.to_date("s0"), F.to_date("end_ts")))))
    asked = rest.withColumn("_day", F.to_date("ts"))
    live = asked.join(days, [*KEYS, "_day"]).where("s0 <= ts AND end_ts > ts")
    found = live.groupBy(*[c for c in rest.columns if c != "task"]).agg(F.max(F.struct("s0", "session"))["session"].alias("task"))
    lost = rest.join(found.select("_id"), "_id", "left_anti").withColumn("task", F.lit(None).cast("string"))
    return kept.unionByName(found.drop("_id")).unionByName(lost.drop("_id"))


def _draft(rows: DataFrame, prio: int, order: Column, **columns: Column) -> DataFrame:
    """Rows of the log still without a number."""
    return rows.select("window", "ts", F.lit(prio).alias("prio"), order.cast("string").alias("order"), *[c.alias(n) for n, c in columns.items()])


def chat_drafts(said: DataFrame, results: DataFrame) -> list[DataFrame]:
    """The log's rows of messages.  ``said`` is (window, message_id, ts, speaker, room, task, said), ``results`` (window, agent, task, ts, event_id, rule,
    outcome, artifact, version)."""
    rows = said.withColumn("_ms", millis("ts")).withColumn("agent", F.coalesce("speaker", F.lit(HUMANS)))
    event = F.concat(F.lit("chat/"), "message_id")
    # Claims on pages, one each; a message that takes back an earlier one on a page it names is a correction instead.
    claims = rows.where("speaker IS NOT NULL AND said.intent = 'claim'").select("window", "agent", "_ms", "message_id", F.size("said.claimed").alias("n"), F.posexplode("said.claimed").alias("i", "c"))
    number = F.when(F.col("n") > 1, F.concat(F.lit("-"), (F.col("i") + 1).cast("string"))).otherwise("")
    part = F.when(F.col("n") > 1, F.concat(F.lit("#"), (F.col("i") + 1).cast("string"))).otherwise("")
    claims = claims.select("window", "agent", F.col("c.page").alias("page"), "_ms", F.struct("_ms", "message_id", "i", F.concat(F.lit("C-"), "message_id", number).alias("claim_id"), F.concat(F.lit("chat/"), "message_id", part).alias("event_id")).alias("k"))
    taking = rows.where("speaker IS NOT NULL AND said.corrects").select("window", "message_id", "agent", "_ms", F.explode("said.pages").alias("page"))
    taken = beside(taking, claims, [*KEYS, "page"], {"k": last(F.col("k"))}, order="_ms", block=None).groupBy("window", "message_id").agg(F.max("k").alias("k")).where("k IS NOT NULL")
    rows = rows.join(taken, ["window", "message_id"], "left")
    plain = rows.where("k IS NULL")
    base = {"event_id": event, "agent": F.col("agent"), "task": F.col("task"), "room": F.col("room"), "refs": F.col("said.refs")}
    fixes = _draft(rows.where("k IS NOT NULL"), 6, F.col("message_id"), **base, type=F.lit("correction"), supersedes=F.col("k.claim_id"), evidence=F.array(F.col("k.event_id")), provenance=F.lit("inferred"))
    # The speaker's own last check of what a message speaks of.
    checks = results.select("window", "agent", "task", F.col("artifact"), "rule", millis("ts").alias("_ms"), "outcome", F.struct(millis("ts").alias("ms"), "event_id", "artifact", "version").alias("r"))
    checks = checks.where("artifact IS NOT NULL")
    quotes = plain.where("said.intent = 'quote'").withColumn("artifact", F.col("said.artifact"))
    quotes = beside(quotes, checks.where("outcome = 'fail'"), [*KEYS, "artifact"], {"r": last(F.col("r"))}, order="_ms", block=None)
    human = F.col("speaker").isNull()
    cited = F.when(F.col("r").isNotNull() & ~human, F.array("r.event_id")).otherwise(F.array().cast("array<string>"))
    told = _draft(quotes, 5, F.col("message_id"), **base, type=F.lit("quote"), artifact=F.col("artifact"), version=F.lit("live"), is_human=human, is_question=F.col("said.is_question"), evidence=cited,
                  quotes_event=F.when(~human, F.col("r.event_id")), provenance=F.lit("inferred"))
    on_pages = plain.where("speaker IS NOT NULL AND said.intent = 'claim'").select("*", F.size("said.claimed").alias("n"), F.posexplode("said.claimed").alias("i", "c"))
    on_pages = on_pages.select(*plain.columns, F.concat("message_id", number).alias("cid"), F.concat(event, part).alias("eid"), F.col("c.page").alias("artifact"), F.lit("live").alias("version"), F.lit("live").alias("asserts"), F.col("i").alias("nth"))
    others = plain.where("said.intent IN ('tests', 'fixed', 'pushed', 'made')")
    others = beside(others, checks.where("rule = 'test-summary'"), KEYS, {"tested": last(F.col("r"))}, order="_ms", block=None)
    others = beside(others, checks.where("rule = 'git-push' AND task IS NOT NULL"), [*KEYS, "task"], {"pushed": last(F.col("r"))}, order="_ms", block=None)
    intent, cid = F.col("said.intent"), F.concat(F.lit("C-"), "message_id")
    basis = F.when(intent == "tests", F.col("tested")).when((intent == "pushed") & F.col("said.artifact").isNull(), F.col("pushed"))
    unsure = (intent == "pushed") & F.col("said.artifact").isNull() & F.col("pushed").isNull()
    asserts = F.when(intent == "tests", "verification_passed").when(intent == "fixed", "fixed").when(intent == "made", "exists").when(F.col("said.artifact").isNotNull(), "merged").otherwise("deployed")
    others = others.select(
        *plain.columns, F.col("message_id").alias("cid"), event.alias("eid"), F.when(unsure, "repo:unknown").otherwise(F.coalesce("said.artifact", basis["artifact"])).alias("artifact"),
        F.when(unsure, F.concat(F.lit("unverified:"), cid)).otherwise(F.coalesce("said.version", basis["version"])).alias("version"), asserts.alias("asserts"), F.lit(0).alias("nth"),
    )
    every = on_pages.unionByName(others).withColumn("_place", F.col("_ms") * 16 + F.col("nth"))
    # Only a claim of the same speaker on the same subject and with the same assertion is repeated; one without a subject never is.
    heads = every.where("artifact IS NOT NULL").groupBy(*KEYS, "artifact", "version", "asserts").agg(F.min(F.struct("_place", "message_id", F.concat(F.lit("C-"), "cid").alias("id"))).alias("head"))
    every = every.join(heads, [*KEYS, "artifact", "version", "asserts"], "left")
    again = F.when(F.struct("_place", "message_id") > F.struct(F.col("head._place").alias("_place"), F.col("head.message_id").alias("message_id")), F.col("head.id"))
    claimed = _draft(
        every, 6, F.concat("message_id", F.lit("/"), F.col("nth").cast("string")), **{**base, "event_id": F.col("eid")}, type=F.lit("claim"), claim_id=F.concat(F.lit("C-"), "cid"), artifact=F.col("artifact"), version=F.col("version"),
        asserts=F.col("asserts"), hedged=F.col("said.hedged"), repeat_of=again, number_value=F.col("said.number_value"), number_kind=F.col("said.number_kind"), provenance=F.lit("inferred"),
    )
    orders = _draft(plain.where("said.intent = 'directive'"), 5, F.col("message_id"), **base, type=F.lit("directive"), to=F.col("said.ordered"), tokens=F.col("said.tokens"), question_to=F.col("said.asked"),
                    is_question=F.col("said.is_question"), provenance=F.lit("inferred"))
    flags = {n: F.col(f"said.{n}") for n in ("is_question", "negative", "blame", "own_error", "conventions", "names")}
    words = _draft(plain.where("said.intent = 'message' OR (speaker IS NULL AND said.intent <> 'quote')"), 5, F.col("message_id"), **base, **flags, type=F.lit("message"), is_human=human, question_to=F.col("said.asked"),
                   named=F.col("said.named"), provenance=F.lit("observed"))
    return [fixes, told, claimed, orders, words]


def numbered(drafts: DataFrame, most: int = MAX_EVENTS) -> DataFrame:
    """Drafts with ``sequence``, 1 to n within a window by time and priority.  Of more than ``most`` records plain messages that name nobody go
    first, evenly over the window, then the window's end; records of a task whose creation went lose the task's name only if it is
    a task's creation that went."""
    w = Window.partitionBy("window")
    order = w.orderBy("ts", "prio", "order", "event_id")
    plain = (F.col("type") == "message") & (F.coalesce(F.size("named"), F.lit(0)) == 0)
    rows = drafts.withColumn("_plain", plain).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_p", F.count(F.when(plain, 1)).over(w))
    rows = rows.withColumn("_i", F.when(plain, F.count(F.when(plain, 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1))
    excess = F.least(F.greatest(F.col("_n") - most, F.lit(0)), F.col("_p"))
    step = F.col("_p") / F.nullif(excess, F.lit(0))
    # The jth to go is the one at floor(j * step): so the ith goes if a multiple of the step lies in [i, i + 1).
    goes = F.col("_plain") & (excess > 0) & (F.ceil(F.col("_i") / step - 1e-9) * step < F.col("_i") + 1 - 1e-9)
    rows = rows.where(~F.coalesce(goes, F.lit(False)))
    return rows.withColumn("sequence", F.row_number().over(order).cast("bigint")).where(F.col("sequence") <= most).drop("_plain", "_n", "_p", "_i")


def adapted(sessions: DataFrame, boundaries: DataFrame, turns: DataFrame, messages: DataFrame, roster: dict[str, str], most: int = MAX_EVENTS) -> DataFrame:
    """The typed log of each window, with ``window``.

    ``sessions`` is (window, session, agent, ts, goal), ``boundaries`` (window, agent, ts, kind, session), ``turns`` (window, turn_id, session, ts, command, output),
    ``messages`` (window, message_id, ts, speaker, room, content) with a null speaker for people.
    """
    spans = staging.stage(session_spans(sessions, boundaries), "spans")
    task = F.concat(F.lit("S-"), "session")
    made = F.array(F.struct(task.alias("task"), F.col("agent").alias("owner"), F.col("goal").alias("title"), extract.goal_key(F.col("goal")).alias("goal_key"), extract.verify_goal(F.col("goal")).alias("verify_goal"), F.array().cast("array<string>").alias("depends_on")))
    id_of = F.concat(F.lit("session/"), "session")
    drafts = [
        _draft(spans, 0, F.col("session"), event_id=id_of, agent=F.col("agent"), type=F.lit("task_created"), tasks=made, provenance=F.lit("observed")),
        _draft(spans, 1, F.col("session"), event_id=F.concat(id_of, F.lit("#start")), agent=F.col("agent"), task=task, type=F.lit("status_updated"), status=F.lit("in_progress"), status_after=F.lit("in_progress"), provenance=F.lit("observed")),
        _draft(spans.where("end_ts IS NOT NULL").drop("ts").withColumnRenamed("end_ts", "ts"), 3, F.col("session"), event_id=F.concat(id_of, F.lit("#end")), agent=F.col("agent"), task=task, type=F.lit("status_updated"), status=F.lit("ended"),
               status_after=F.lit("ended"), end_reason=F.col("end_reason"), provenance=F.lit("observed")),
    ]
    mine = turns.join(spans.select("window", "session", "agent").distinct(), ["window", "session"])
    found = extract.verdicts(mine.select("turn_id", "command", "output", F.lit("").alias("cwd"))).select("turn_id", "verdict.*")
    shown = mine.join(staging.stage(found, "verdicts"), "turn_id").withColumn("_at", F.length("subject") - F.locate("@", F.reverse("subject")) + 1)
    shown = shown.withColumn("artifact", F.expr("substring(subject, 1, _at - 1)")).withColumn("version", F.expr("substring(subject, _at + 1)"))
    web = F.col("version") == "live"
    shown = shown.withColumn("artifact", F.when(web, F.concat(F.lit("https://"), "artifact")).otherwise(F.col("artifact")))
    drafts.append(_draft(
        shown, 4, F.col("turn_id"), event_id=F.concat(F.lit("turn/"), "turn_id"), agent=F.col("agent"), task=task, type=F.lit("tool_result"), run_id=F.col("turn_id"), category=F.col("category"), rule=F.col("rule"), outcome=F.col("outcome"),
        artifact=F.col("artifact"), version=F.col("version"), scope=F.col("scope"), final_url=F.when(F.col("final_url").isNotNull(), F.concat(F.lit("https://"), "final_url")), suppressed=F.col("suppressed"), empty_output=F.col("empty_output"),
        passed_seen=F.col("number"), provenance=F.lit("observed"),
    ))
    hashed = lambda c: F.substring(F.md5(F.coalesce(c, F.lit("")).cast("binary")), 1, 16)
    drafts.append(_draft(
        mine, 3, F.col("turn_id"), event_id=F.concat(F.lit("act/"), "turn_id"), agent=F.col("agent"), task=task, type=F.lit("action"), turn_id=F.col("turn_id"), action_kind=F.when(F.col("command").isNotNull(), "command").otherwise("none"),
        command=F.col("command"), command_hash=F.when(F.col("command").isNotNull(), hashed(F.col("command"))), output_hash=hashed(F.col("output")), destructive=extract.destructive(F.col("command")), provenance=F.lit("observed"),
    ))
    results = shown.select("window", "agent", task.alias("task"), "ts", F.concat(F.lit("turn/"), "turn_id").alias("event_id"), "rule", "outcome", "artifact", "version")
    said = chat.readings(messages.where("trim(content) <> ''").select("window", "message_id", "ts", "speaker", "room", "content"), roster)
    said = staging.stage(said.drop("content"), "readings")
    placed = open_session(said.where("speaker IS NOT NULL").withColumn("agent", F.col("speaker")), spans.withColumn("session", task)).drop("agent")
    said = staging.stage(placed.unionByName(said.where("speaker IS NULL").withColumn("task", F.lit(None).cast("string"))), "said")
    drafts += chat_drafts(said, results)
    rows = numbered(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), drafts), most)
    empty = rows.sparkSession.createDataFrame([], f"window string, named array<string>, {LOG}")
    full = empty.unionByName(rows.drop("prio", "order").withColumn("window", F.col("window").cast("string")), allowMissingColumns=True)
    lists = [f.name for f in empty.schema if f.dataType.typeName() == "array"]
    return full.withColumns({c: F.coalesce(c, F.array().cast(empty.schema[c].dataType)) for c in lists})


__all__ = ["adapted", "chat_drafts", "numbered", "open_session", "session_spans"]
