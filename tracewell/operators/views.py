"""What readers are shown of a store: records in context, explorer payloads, arcs, plans, samples for judges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.stats import js_part
from tracewell.functions.text import name_key
from tracewell.functions.time import millis
from tracewell.operators.joins import within_intervals
from tracewell.functions import extract
from tracewell.operators.ordered import beside, carry, last
from tracewell.operators.records import neighbours


def in_context(records: DataFrame, wanted: DataFrame, touches: DataFrame, periods: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """(asked_id, role, evidence_id, detail): each wanted record's neighbours, touched artifacts and periods."""
    near = neighbours(records, wanted, before, after).select("asked_id", F.when(F.col("offset") == 0, "record").otherwise("neighbour").alias("role"), "evidence_id", F.col("offset").cast("string").alias("detail"))
    ids = wanted.select(F.col("evidence_id").alias("asked_id")).distinct()
    touched = touches.join(ids, F.col("record_id") == F.col("asked_id")).select("asked_id", F.lit("artifact").alias("role"), F.col("artifact_id").alias("evidence_id"), F.col("op").alias("detail"))
    at = records.join(ids, F.col("evidence_id") == F.col("asked_id")).select("asked_id", "ts")
    held = within_intervals(at, periods.select(F.col("evidence_id").alias("pid"), "label", "start_ts", "end_ts"))
    return near.unionByName(touched).unionByName(held.select("asked_id", F.lit("period").alias("role"), F.col("pid").alias("evidence_id"), F.col("label").alias("detail")))


def artifact_history(touches: DataFrame) -> DataFrame:
    """(artifact_id, creates, modifies, deletes, reads, mentions, first_ts, last_ts): operations pivoted."""
    counts = [F.count(F.when(F.col("op") == op, 1)).alias(name) for op, name in (("create", "creates"), ("modify", "modifies"), ("delete", "deletes"), ("read", "reads"), ("mention", "mentions"))]
    return touches.groupBy("artifact_id").agg(*counts, F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def agent_arc(mentions: DataFrame, top: int = 3) -> DataFrame:
    """(src, seg, partners, change): each agent's main partners by segment, and how far the mix moved from its last
    segment (Jensen-Shannon).  ``mentions`` is (seg, src, dst, n)."""
    w = Window.partitionBy("src", "seg")
    mix = mentions.withColumn("p", F.col("n") / F.sum("n").over(w))
    listed = F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "dst"))), 1, top), lambda x: x["dst"])
    partners = mix.groupBy("src", "seg").agg(listed.alias("partners"))
    steps = partners.select("src", "seg", F.lag("seg").over(Window.partitionBy("src").orderBy("seg")).alias("prev")).where("prev IS NOT NULL")
    now = steps.join(mix.select("src", "seg", "dst", "p"), ["src", "seg"]).select("src", "seg", "dst", F.col("p").alias("a"), F.lit(0.0).alias("b"))
    then = steps.join(mix.select("src", F.col("seg").alias("prev"), "dst", "p"), ["src", "prev"]).select("src", "seg", "dst", F.lit(0.0).alias("a"), F.col("p").alias("b"))
    both = now.union(then).groupBy("src", "seg", "dst").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    change = both.groupBy("src", "seg").agg(F.sqrt(F.greatest(F.sum(js_part(F.col("a"), F.col("b"))), F.lit(0.0))).alias("change"))
    return partners.join(change, ["src", "seg"], "left")


def homophily(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """One row: the share of mention weight between nodes of one kind.  ``kinds`` is (node, kind)."""
    a = kinds.select(F.col("node").alias("src"), F.col("kind").alias("ka"))
    b = kinds.select(F.col("node").alias("dst"), F.col("kind").alias("kb"))
    both = edges.join(a, "src").join(b, "dst")
    return both.agg(F.sum("weight").alias("weight"), (F.sum(F.when(F.col("ka") == F.col("kb"), F.col("weight")).otherwise(0)) / F.sum("weight")).alias("same_kind"))


def candidate_claims(log: DataFrame, hours: int = 4) -> DataFrame:
    """Claims whose subject's latest check before was a failure no more than ``hours`` old."""
    check = (F.col("type") == "tool_result") & F.col("outcome").isin("pass", "fail")
    about = log.where("artifact IS NOT NULL")
    rows = beside(about.where("type = 'claim'"), about.where(check), ["artifact", "version"], {"_l": last(F.struct("sequence", "outcome", "ts"))})
    near = F.col("_l.ts") >= F.col("ts") - F.expr(f"interval {hours} hours")
    return rows.where((F.col("_l.outcome") == "fail") & near).drop("_l")


def busiest_window(points: DataFrame, width: str = "4 hours", slide: str = "30 minutes") -> DataFrame:
    """The window with most points; the earliest wins ties."""
    w = F.window(F.col("ts").cast("timestamp"), width, slide)
    counts = points.groupBy(w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), F.col("w.end").cast("timestamp_ntz").alias("end"), "n").orderBy(F.desc("n"), "start").limit(1)


def merged_spans(spans: DataFrame, key: str, gap_ms: int) -> DataFrame:
    """Spans of a key united where no more than ``gap_ms`` lies between them."""
    w = Window.partitionBy(key).orderBy("start_ts", "end_ts")
    reach = F.max(millis("end_ts")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_b", F.when(reach.isNull() | (millis("start_ts") - reach > gap_ms), 1).otherwise(0))
    rows = rows.withColumn("_r", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "_r").agg(F.min("start_ts").alias("start_ts"), F.max("end_ts").alias("end_ts"), F.count(F.lit(1)).alias("n")).drop("_r")


def split_windows(log: DataFrame, parts: int) -> DataFrame:
    """``log`` with ``part``: equal runs of the order of record."""
    end = log.agg(F.max("sequence").alias("_n"))  # one row
    return log.crossJoin(F.broadcast(end)).withColumn("part", F.floor((F.col("sequence") - 1) * parts / F.col("_n"))).drop("_n")


def carried_facts(log: DataFrame, parts: int) -> DataFrame:
    """(part, event_id): records that a part needs from before it: the created tasks that its records belong to, the claims that they
    withdraw or cite, and the latest check of each subject that it claims."""
    rows = split_windows(log, parts)
    made = rows.where("type = 'task_created'").select(F.col("part").alias("from"), "event_id", F.inline("tasks")).select("from", "event_id", "task")
    said = rows.where("type = 'claim'").select(F.col("part").alias("from"), "event_id", "claim_id")
    cites = rows.select("part", F.col("supersedes").alias("claim_id")).union(rows.select("part", F.explode("references").alias("claim_id"))).where("claim_id IS NOT NULL").distinct()
    about = rows.where("type = 'claim' AND artifact IS NOT NULL").groupBy("part", "artifact", "version").agg(F.min("sequence").alias("sequence"))
    checks = rows.where("type = 'tool_result' AND category = 'verification' AND artifact IS NOT NULL").select("artifact", "version", "sequence", F.struct("sequence", "event_id", F.col("part").alias("from")).alias("k"))
    known = beside(about, checks, ["artifact", "version"], {"k": last(F.col("k"))}).where("k.from < part").select("part", F.col("k.event_id").alias("event_id"))
    of = lambda keys, facts: keys.join(facts, keys.columns[1]).where("`from` < part").select("part", "event_id")
    tasks = rows.where("task IS NOT NULL").select("part", "task").distinct()
    return of(tasks, made).union(of(cites, said)).union(known).distinct()


def same_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id): actors of two sources that share a name that is unique on both sides.  Frames are (id, names)."""
    one = lambda df, c: df.select(F.col("id").alias(c), F.explode(F.array_distinct(F.transform("names", name_key))).alias("k")).where("k <> ''").groupBy("k").agg(F.min(c).alias(c), F.countDistinct(c).alias("n")).where("n = 1").drop("n")
    pairs = one(left, "left_id").join(one(right, "right_id"), "k").select("left_id", "right_id").distinct()
    alone = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c)) == 1
    return pairs.withColumn("_a", alone("left_id")).withColumn("_b", alone("right_id")).where("_a AND _b").select("left_id", "right_id")


def masked(text: Column, names: list[str], mask: str = "[agent]") -> Column:
    """``text`` with names blotted out, longest first, for judges who must not know them."""
    out = text
    for n in sorted(names, key=lambda n: (-len(n), n)):
        out = F.regexp_replace(out, r"(?i)(?<![\p{L}\p{N}])\Q" + n + r"\E(?![\p{L}\p{N}])", mask)
    return out


def stratified(df: DataFrame, stratum: str, per: int, seed: int = 0, id_col: str = "evidence_id") -> DataFrame:
    """``per`` rows of each stratum, by the md5 of id and seed."""
    order = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")).cast("binary"))
    at = F.row_number().over(Window.partitionBy(stratum).orderBy(order, id_col))
    return df.withColumn("_n", at).where(F.col("_n") <= per).drop("_n")


def batches(df: DataFrame, size: int, overlap: int, order: str = "evidence_id") -> DataFrame:
    """(row, batch): rows dealt to batches of ``size``, the first ``overlap`` of each also given to the next."""
    at = F.row_number().over(Window.orderBy(order)) - 1  # over one sample for judges
    own = F.floor(at / size)
    return df.withColumn("_b", F.when(at % size < overlap, F.array(own, own + 1)).otherwise(F.array(own))).withColumn("batch", F.explode("_b")).drop("_b")


def trace_problems(events: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, n) of an idea trace: repeated ids, edges to nowhere, edges back in time."""
    repeated = events.groupBy("id").count().where("count > 1").agg(F.count(F.lit(1)).alias("n")).select(F.lit("id_repeated").alias("problem"), "n")
    ids = events.select(F.col("id"), "ts").dropDuplicates(["id"])
    a, b = ids.select(F.col("id").alias("src"), F.col("ts").alias("ta")), ids.select(F.col("id").alias("dst"), F.col("ts").alias("tb"))
    both = edges.join(a, "src", "left").join(b, "dst", "left")
    counts = both.agg(F.count(F.when(F.col("ta").isNull() | F.col("tb").isNull(), 1)).alias("edge_to_nowhere"), F.count(F.when(F.col("ta") > F.col("tb"), 1)).alias("edge_back_in_time"))
    cells = F.array(*[F.struct(F.lit(c).alias("problem"), F.col(c).alias("n")) for c in ("edge_to_nowhere", "edge_back_in_time")])
    return repeated.unionByName(counts.select(F.explode(cells).alias("c")).select("c.*")).where("n > 0")


def turn_index(turns: DataFrame, sessions: DataFrame) -> DataFrame:
    """(turn_id, session, ts, command_hash, output_hash, destructive, empty_output) of every turn of the chosen sessions: 12 hex digits of sha1 tell
    commands and outputs apart without keeping them."""
    digest = lambda c: F.substring(F.sha1(F.coalesce(c, F.lit("")).cast("binary")), 1, 12)
    kept = turns.join(sessions.select("session").distinct(), "session", "left_semi")
    command = F.when(F.col("command").isNotNull(), digest(F.col("command")))
    return kept.select("turn_id", "session", "ts", command.alias("command_hash"), digest(F.col("output")).alias("output_hash"), extract.destructive(F.col("command")).alias("destructive"), (F.trim(F.coalesce("output", F.lit(""))) == "").alias("empty_output"))


def document_problems(log: DataFrame) -> DataFrame:
    """(problem, n): what makes a typed log unfit: records without id, time, agent or type, repeated ids, numbers that are missing, repeated
    or go back in time, claims without id or rule of assertion, corrections of unknown claims."""
    need = {f"no_{c}": F.count(F.when(F.col(c).isNull(), 1)) for c in ("event_id", "ts", "agent", "type", "sequence")}
    need["claim_without_id"] = F.count(F.when((F.col("type") == "claim") & F.col("claim_id").isNull(), 1))
    need["claim_without_assertion"] = F.count(F.when((F.col("type") == "claim") & F.col("asserts").isNull(), 1))
    ends = [F.min("sequence").alias("_lo"), F.max("sequence").alias("_hi"), F.count("sequence").alias("_n")]
    row = log.agg(*[v.alias(k) for k, v in need.items()], *ends).withColumn("numbers_missing", F.greatest(F.col("_hi") - F.col("_lo") + 1 - F.col("_n"), F.lit(0)))
    again = lambda c: log.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.lit(f"repeated_{c}").alias("problem"), F.count(F.lit(1)).alias("n"))
    cells = F.array(*[F.struct(F.lit(k).alias("problem"), F.coalesce(F.col(k), F.lit(0)).cast("bigint").alias("n")) for k in [*need, "numbers_missing"]])
    known = log.where("type = 'claim'").select(F.col("claim_id").alias("supersedes")).distinct()
    lost = log.where("type = 'correction'").join(known, "supersedes", "left_anti").agg(F.lit("correction_of_nothing").alias("problem"), F.count(F.lit(1)).alias("n"))
    steps = carry(log.where("sequence IS NOT NULL").select(F.lit(0).alias("_k"), "sequence", "ts"), ["_k"], {"_p": last(F.struct("sequence", "ts"))})
    back = steps.where("ts < _p.ts").agg(F.lit("back_in_time").alias("problem"), F.count(F.lit(1)).alias("n"))
    out = row.select(F.inline(cells))
    for part in (again("event_id"), again("sequence"), lost, back):
        out = out.unionByName(part)
    return out.where("n > 0")


def review_report(findings: DataFrame, shown: int = 3) -> DataFrame:
    """(monitor, active, resolved, insufficient, agents, examples): what a reviewer of monitors looks at first."""
    place = F.row_number().over(Window.partitionBy("monitor").orderBy(F.desc("detected_at"), "finding_id"))
    examples = findings.withColumn("_n", place).where(F.col("_n") <= shown).groupBy("monitor").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "finding_id"))), lambda x: x["finding_id"]).alias("examples"))
    states = [F.count(F.when(F.col("state") == s, 1)).alias(s) for s in ("active", "resolved", "insufficient")]
    return findings.groupBy("monitor").agg(*states, F.countDistinct("agent").alias("agents")).join(examples, "monitor")


def live_payload(log: DataFrame) -> DataFrame:
    """(session, owner, started, ended, actions, results, fails, claims, last_ts): what a live view shows of each session."""
    made = log.where("type = 'task_created'").select(F.col("ts").alias("started"), F.inline("tasks")).groupBy("task").agg(F.min("started").alias("started"), F.min_by("owner", "started").alias("owner"))
    n = lambda t: F.count(F.when(t, 1))
    kind = F.col("type")
    did = log.where("task IS NOT NULL").groupBy("task").agg(
        n(kind == "action").alias("actions"), n(kind == "tool_result").alias("results"), n((kind == "tool_result") & (F.col("outcome") == "fail")).alias("fails"), n(kind == "claim").alias("claims"),
        F.max("ts").alias("last_ts"), F.min(F.when((kind == "status_updated") & (F.col("status") == "ended"), F.col("ts"))).alias("ended"),
    )
    return made.join(did, "task", "left").select(F.col("task").alias("session"), "owner", "started", "ended", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("actions", "results", "fails", "claims")], "last_ts")
