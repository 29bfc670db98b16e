"""The world as the log tells it at a cursor: tasks and what backs their status, claims, corrections, reach, lineage, flow,
incidents, roles, rates and triage.  All read one ``World`` (see ``monitors``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.descent import downstream
from tracewell.operators.monitors import World, visible
from tracewell.operators.ordered import count, first
from tracewell.staging import stage

#: Findings whose records contradict a claim, and those that a claim's records cannot confirm yet.
CONTRADICTED = ("A", "D", "E", "G", "J", "W", "Y", "AO", "AP", "AQ", "AR", "AY")
NEEDS_EVIDENCE = ("C", "Z", "AM", "AC", "BM", "BJ", "BK")
#: Kinds of subject that a check from outside can settle.
INCIDENT_GRADE = ("url-live", "pages-built", "pr-merged", "tests")
MAX_REPEATS = 10
SOLE_SUBJECTS, CONSENSUS, LONG_SESSION, CHURN_SESSIONS, CHURN_SIMILAR = 3, 3, 100, 5, 0.3


def _event(*more: str) -> Column:
    return F.struct("sequence", "event_id", *more)


def _kind(*names: str) -> Column:
    return F.col("type").isin(*names)


# ---- claims and tasks


def claims(w: World) -> DataFrame:
    """(claim_id, event_id, sequence, agent, task, subject, asserts, standing): each claim as all that is visible, before and after,
    bears on it."""
    said = w.visible.where(_kind("claim"))
    checks = w.visible.where(_kind("tool_result") & (F.col("category") == "verification") & F.col("subject").isNotNull())
    per = checks.groupBy("subject").agg(F.count(F.when(F.col("passed"), 1)).alias("passes"), F.count(F.when(F.col("failed"), 1)).alias("fails"))
    fixed = w.visible.where(_kind("correction")).select(F.col("supersedes").alias("claim_id"), F.lit(True).alias("fixed")).distinct()
    strong = F.coalesce(F.col("asserts").isin("verification_passed", "complete"), F.lit(False))
    standing = F.when(F.col("fixed"), "superseded").when(strong & (F.col("passes") > 0), "supported").when(strong & (F.col("fails") > 0), "contradicted").otherwise("unknown")
    rows = said.join(per, "subject", "left").join(fixed, "claim_id", "left")
    return rows.select("claim_id", "event_id", "sequence", "agent", "task", "subject", "asserts", "evidence", standing.alias("standing"))


def tasks(w: World) -> DataFrame:
    """(task, title, owner, created_by, status, basis, records, last_touched): every created task as its records leave it."""
    made = w.visible.where(_kind("task_created")).select("sequence", "agent", F.inline("tasks"))
    made = made.groupBy("task").agg(F.max(F.struct("sequence", "title", "owner", F.col("agent").alias("created_by"))).alias("m"))
    rows = w.visible.where(F.col("task").isNotNull() & ~_kind("task_created")).join(made, "task", "left").where("m IS NULL OR sequence > m.sequence")
    step = F.when(_kind("status_updated"), F.col("status")).otherwise(F.col("status_after"))
    at = F.when(step.isNotNull(), F.struct("sequence", "event_id", "type", step.alias("status")))
    told = rows.groupBy("task").agg(
        F.max(at).alias("basis"), F.max(F.when(_kind("task_assigned"), F.struct("sequence", "assignee")))["assignee"].alias("assignee"), F.count(F.lit(1)).alias("n"), F.max("sequence").alias("last")
    )
    return made.join(told, "task", "left").select(
        "task", "m.title", F.coalesce("assignee", "m.owner").alias("owner"), "m.created_by", F.coalesce("basis.status", F.lit("todo")).alias("status"), "basis",
        (F.coalesce("n", F.lit(0)) + 1).alias("records"), F.coalesce("last", "m.sequence").alias("last_touched"),
    )


def evidence(w: World) -> DataFrame:
    """``tasks`` with ``evidence_status``: whether what set a task's status is backed, contradicted or unknown."""
    rows = tasks(w)
    known = claims(w).select("claim_id", F.col("event_id").alias("said_id"), F.col("agent").alias("author"), "standing")
    basis = rows.select("task", "owner", F.col("basis.event_id").alias("event_id")).join(w.visible.select("event_id", "claim_id", "evidence", "references", "provenance"), "event_id")
    own = basis.join(known.select("claim_id", F.col("standing").alias("own_standing")), "claim_id", "left")
    cites = basis.select("task", F.explode("references").alias("claim_id")).join(known, "claim_id").groupBy("task").agg(
        F.count(F.when(F.col("standing").isin("superseded", "contradicted"), 1)).alias("bad_refs"), F.count(F.when(F.col("standing") == "supported", 1)).alias("good_refs"), F.count(F.lit(1)).alias("refs")
    )
    shown = w.visible.where(_kind("tool_result")).select(F.col("event_id").alias("ref"), "passed", "failed")
    cited = basis.select("task", F.posexplode("evidence").alias("nth", "ref")).join(shown, "ref").groupBy("task").agg(F.max("failed").alias("cites_fail"), F.min(F.struct("nth", "passed"))["passed"].alias("cites_pass"))
    made = w.visible.where(_kind("claim") & F.col("task").isNotNull()).select("task", "claim_id")
    used = w.visible.where(_kind("action") & F.col("task").isNotNull()).select("task", F.explode("references").alias("claim_id"))
    inside = made.union(used).distinct().join(known, "claim_id").join(rows.select("task", "owner"), "task").where("author = owner").groupBy("task").agg(
        F.count(F.when(F.col("standing") == "contradicted", 1)).alias("bad_own"), F.count(F.when(F.col("standing") == "unknown", 1)).alias("open_own")
    )
    both = rows.join(own.select("task", "provenance", "own_standing"), "task", "left").join(cites, "task", "left").join(cited, "task", "left").join(inside, "task", "left")
    kind = F.col("basis.type")
    by_claim = F.when(F.col("own_standing") == "supported", "supported").when(F.col("own_standing") == "unknown", "unknown").otherwise("contradicted")
    by_action = F.when(F.col("bad_refs") > 0, "contradicted").when(F.col("good_refs") == F.col("refs"), "supported").otherwise("unknown")
    by_record = F.when(F.col("bad_own") > 0, "contradicted").when(F.col("open_own") > 0, "unknown").otherwise("supported")
    status = (
        F.when(F.col("basis").isNull(), "unknown").when(kind.isin("tool_result", "acknowledgement"), "supported").when(kind == "claim", by_claim).when(kind == "action", by_action)
        .when(kind == "correction", F.when(F.col("cites_fail"), "supported").otherwise("unknown")).when(F.col("provenance") == "observed", by_record)
        .otherwise(F.when(F.col("cites_pass"), "supported").otherwise("unknown"))
    )
    return both.select(*rows.columns, status.alias("evidence_status"))


def difference(evidence_col: str = "evidence_status", status_col: str = "status") -> Column:
    """conflict where the evidence contradicts the report, insufficient where work is reported and nothing backs it, else agree."""
    return F.when(F.col(evidence_col) == "contradicted", "conflict").when((F.col(evidence_col) == "unknown") & (F.col(status_col) != "todo"), "insufficient").otherwise("agree")


def dependencies(w: World) -> DataFrame:
    """(src, dst): tasks that others depend on."""
    stated = w.visible.where(_kind("task_created")).select(F.inline("tasks")).select(F.explode("depends_on").alias("src"), F.col("task").alias("dst"))
    return stated.union(w.visible.where(_kind("dependency_created")).select("dep_from", "dep_to")).distinct()


def reach(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node): all nodes reachable from each root, the root itself left out.

    By doubling: what lies 1 to n steps from a root, and from there exactly n steps on, lies n + 1 to 2 n steps from it.  So a chain of any
    length takes rounds by its logarithm, and in a forest each pair is made once.  A round that finds nothing new is the last.
    """
    steps = stage(edges.where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "steps")
    found = stage(steps.join(roots.select(F.col("root").alias("src")).distinct(), "src").select(F.col("src").alias("root"), F.col("dst").alias("node")), "reach")
    while True:
        ahead = found.join(steps, F.col("node") == F.col("src")).select("root", F.col("dst").alias("node")).distinct()
        new = stage(ahead.join(found, ["root", "node"], "left_anti"), "reach")
        if new.isEmpty():
            return found.where("node <> root")
        found = found.union(new)
        other = steps.select(F.col("src").alias("dst"), F.col("dst").alias("to"))
        steps = stage(steps.join(other, "dst").select("src", F.col("to").alias("dst")).distinct(), "steps")


def citing(w: World) -> DataFrame:
    """(claim_id, task, n): tasks with records that state or cite a claim, and how many."""
    stated = w.visible.where(_kind("claim") & F.col("task").isNotNull()).select("claim_id", "task", "event_id")
    cited = w.visible.where(_kind("action") & F.col("task").isNotNull()).select(F.explode(F.array_distinct("references")).alias("claim_id"), "task", "event_id")
    return stated.union(cited).groupBy("claim_id", "task").agg(F.count(F.lit(1)).alias("n"))


def claim_impact(w: World) -> DataFrame:
    """(claim_id, task, how, n): tasks that refer to each claim, and those downstream of them."""
    direct = citing(w)
    further = downstream(dependencies(w), direct, "claim_id", "task")
    return direct.select("claim_id", "task", F.lit("refers").alias("how"), "n").union(further.select("claim_id", "task", F.lit("downstream"), F.lit(0).cast("long")))


def correction_audience(w: World, roster: DataFrame) -> DataFrame:
    """(correction, agent, addressed, ack_id): for each correction each other agent of the (small) ``roster``, with its acknowledgement."""
    fixes = w.visible.where(_kind("correction")).select(F.col("event_id").alias("correction"), F.col("agent").alias("author"), "addressed_to")
    acks = w.visible.where(_kind("acknowledgement")).groupBy(F.col("acknowledges").alias("correction"), "agent").agg(F.min(_event()).alias("ack"))
    people = roster.agg(F.array_sort(F.collect_set("agent")).alias("people"))  # one row
    rows = fixes.crossJoin(F.broadcast(people)).select("correction", "author", "addressed_to", F.explode("people").alias("agent")).where("agent <> author")
    return rows.join(acks, ["correction", "agent"], "left").select("correction", "agent", F.array_contains("addressed_to", F.col("agent")).alias("addressed"), F.col("ack.event_id").alias("ack_id"))


def stale_actions(w: World) -> DataFrame:
    """(correction, event_id, agent, acked_before): actions that cite a claim after its correction."""
    fixes = w.visible.where(_kind("correction")).select(F.col("supersedes").alias("claim_id"), F.col("event_id").alias("correction"), F.col("sequence").alias("at"))
    acts = w.visible.where(_kind("action")).select("sequence", "event_id", "agent", F.explode(F.array_distinct("references")).alias("claim_id")).join(fixes, "claim_id").where("sequence > at")
    acks = w.visible.where(_kind("acknowledgement")).select(F.col("acknowledges").alias("correction"), "agent", "sequence")
    return w.beside(acts, acks, ["correction", "agent"], {"n": count(F.lit(True))}).select("correction", "event_id", "agent", (F.col("n") > 0).alias("acked_before"))


# ---- lineage and flow


def lineage(w: World, asked: DataFrame, max_repeats: int | None = MAX_REPEATS) -> DataFrame:
    """(claim_id, step, event_id, sequence, agent): the life of each asked claim (claim_id), by explicit references and equal subjects.
    A view shows the first ``max_repeats`` repetitions of a claim; None gives all of them."""
    c = claims(w).join(asked.select("claim_id").distinct(), "claim_id").select("claim_id", F.col("event_id").alias("said_id"), F.col("sequence").alias("said"), "subject", "evidence")
    rows = w.visible.select("sequence", "event_id", "agent", "type", "category", "subject", "claim_id", "references", "acknowledges", "supersedes", "is_check")
    plain = rows.drop("claim_id", "subject")
    part = lambda df, step: df.select("claim_id", (F.lit(step) if isinstance(step, str) else step).alias("step"), "event_id", "sequence", "agent")
    backing = part(c.select("claim_id", F.explode("evidence").alias("event_id")).join(plain.where("type = 'tool_result'"), "event_id"), "evidence")
    intro = part(c.select("claim_id", F.col("said_id").alias("event_id")).join(plain, "event_id"), "introduced")
    # What follows on a claim's subject is met without an order, so nothing is sorted by claim; a few repetitions by their places.
    stated = rows.where("type = 'claim' AND subject IS NOT NULL").select("subject", "sequence", "event_id", "agent", "type")
    follows = rows.where("type = 'tool_result' AND category = 'verification' AND subject IS NOT NULL").select(stated.columns)
    follows = follows.union(stated) if max_repeats is None else follows
    followed = part(c.select("claim_id", "said", "subject").join(follows, "subject").where("sequence > said"), F.when(_kind("claim"), "repeated").otherwise("checked"))
    if max_repeats is not None:
        placed = w.beside(stated, stated.select("subject", "sequence"), ["subject"], {"place": count(F.lit(True))})
        later = F.explode(F.sequence(F.col("place") + 1, F.col("place") + max_repeats)).alias("place")
        repeats = placed.join(c.select("claim_id", F.col("said_id").alias("event_id")), "event_id").select("claim_id", "subject", later)
        followed = followed.union(part(repeats.join(placed, ["subject", "place"]), "repeated"))
    fixes = rows.where("type = 'correction'").groupBy(F.col("supersedes").alias("claim_id")).agg(F.min(F.struct("sequence", "event_id", "agent")).alias("fix")).join(c.select("claim_id"), "claim_id")
    fixed = part(fixes.select("claim_id", "fix.*"), "correction")
    acks = part(fixes.select("claim_id", F.col("fix.event_id").alias("acknowledges")).join(plain.where("type = 'acknowledgement'"), "acknowledges"), "acknowledged")
    uses = plain.where("type = 'action'").select("sequence", "event_id", "agent", F.explode(F.array_distinct("references")).alias("claim_id")).join(c.select("claim_id"), "claim_id").join(fixes, "claim_id", "left")
    used = part(uses, F.when(F.col("sequence") > F.col("fix.sequence"), "used_after").otherwise("used"))
    audience = uses.where("fix IS NOT NULL AND sequence < fix.sequence AND agent <> fix.agent").select("claim_id", "agent", F.col("fix.sequence").alias("sequence"), F.col("fix.event_id").alias("fix_id")).distinct()
    # What each of them did next: the first acknowledgement that changed its status, or the first action that does not cite the claim.
    acts = w.visible.where(_kind("action")).select("agent", "sequence", F.struct("sequence", "event_id").alias("a"), "references")
    citing_acts = acts.select("agent", "sequence", F.explode(F.array_distinct("references")).alias("claim_id"))
    clean = _first_clean(w, audience, acts, citing_acts)
    heard = w.visible.where(_kind("acknowledgement") & F.col("status_after").isNotNull()).select("agent", "sequence", F.col("acknowledges").alias("fix_id"), _event().alias("k"))
    done = w.beside(clean, heard, ["agent", "fix_id"], after={"ack": first(F.col("k"))}).where("clean IS NOT NULL AND (ack IS NULL OR clean.sequence < ack.sequence)")
    changed = part(done.select("claim_id", "agent", F.col("clean.event_id").alias("event_id"), F.col("clean.sequence").alias("sequence")), "changed")
    return reduce(DataFrame.union, [backing, intro, followed, fixed, acks, used, changed])


def _first_clean(w: World, audience: DataFrame, acts: DataFrame, citing_acts: DataFrame) -> DataFrame:
    """``audience`` (claim_id, agent, sequence) with ``clean``, the agent's first action afterwards that does not cite the claim: as there
    are one more actions than citing ones up to it, it is found among the first few by their ranks."""
    ranked = w.beside(acts, acts.select("agent", "sequence"), ["agent"], {"rank": count(F.lit(True))}).select("agent", "sequence", "a", "rank")
    start = w.beside(audience, acts.select("agent", "sequence"), ["agent"], {"base": count(F.lit(True))}, {"n1": first(F.col("sequence"))})
    cites = start.select("claim_id", "agent", F.col("sequence").alias("since"), "base").join(citing_acts, ["claim_id", "agent"]).where("sequence > since").join(ranked.drop("a"), ["agent", "sequence"])
    place = F.row_number().over(Window.partitionBy("claim_id", "agent", "since").orderBy("sequence"))
    # Citing actions that follow the correction without a gap are those whose rank is base + 0, 1, 2, ...
    run = cites.withColumn("i", place - 1).where("rank = base + i").groupBy("claim_id", "agent", "since").agg(F.count(F.lit(1)).alias("stale"))
    want = start.join(run.withColumnRenamed("since", "sequence"), ["claim_id", "agent", "sequence"], "left").withColumn("rank", F.col("base") + F.coalesce("stale", F.lit(0)))
    return want.join(ranked.select("agent", "rank", F.col("a").alias("clean")), ["agent", "rank"], "left").drop("base", "n1", "stale", "rank")


def ranked_claims(w: World) -> DataFrame:
    """Claims worth tracing first: superseded, contradicted, supported, unknown; then the most cited."""
    cites = w.visible.where(_kind("action")).select(F.explode("references").alias("claim_id")).groupBy("claim_id").agg(F.count(F.lit(1)).alias("cited"))
    rank = F.when(F.col("standing") == "superseded", 0).when(F.col("standing") == "contradicted", 1).when(F.col("standing") == "unknown", 3).otherwise(2)
    rows = claims(w).join(cites, "claim_id", "left").withColumn("cited", F.coalesce("cited", F.lit(0))).withColumn("rank", rank)
    return rows.orderBy("rank", F.desc("cited"), "sequence").select("claim_id", "standing", "cited", "rank")


def flow(w: World) -> DataFrame:
    """(src, dst, tone, label, n): who checked what, which evidence claims rest on, and who took up whose records."""
    rows, known = w.visible, claims(w).select(F.col("event_id").alias("ref"), "claim_id", "standing")
    shown = rows.where(_kind("tool_result") & (F.col("category") == "verification") & F.col("subject").isNotNull())
    about = w.own_claims.select("subject").distinct()
    cited = rows.select(F.explode("evidence").alias("event_id")).distinct().join(shown.select("event_id", "subject"), "event_id").select("subject")
    shown = shown.join(about.union(cited).distinct(), "subject", "left_semi")
    agent, thing = F.concat(F.lit("agent:"), "agent"), F.concat(F.lit("ev:"), "subject")
    checked = shown.select(agent.alias("src"), thing.alias("dst"), F.lit("normal").alias("tone"), F.lit("checked").alias("label"), "event_id")
    tone = F.when(F.col("standing").isin("superseded", "contradicted"), "unverified").otherwise("normal")
    own = w.own_claims.select("subject", "agent", "event_id", "evidence").join(shown.select("subject").distinct(), "subject", "left_semi").join(known.select(F.col("ref").alias("event_id"), "standing"), "event_id")
    backs = own.select("event_id", "subject", F.explode("evidence").alias("ref")).join(shown.select(F.col("event_id").alias("ref"), "subject"), ["ref", "subject"]).select("event_id", F.lit(True).alias("backed")).distinct()
    claimed = own.join(backs, "event_id", "left").select(thing, agent, tone, F.when(F.col("backed"), "cited").otherwise("claimed"), "event_id")
    links = rows.select("event_id", "agent", "type", F.explode("evidence").alias("ref"))
    links = links.union(rows.where(_kind("acknowledgement")).select("event_id", "agent", "type", F.col("acknowledges").alias("ref")))
    acts = rows.where(_kind("action")).select("event_id", "agent", "type", F.explode("references").alias("claim_id")).join(known, "claim_id")
    links = links.union(acts.select("event_id", "agent", "type", "ref")).distinct()
    doubtful = acts.where("standing IN ('superseded', 'contradicted')").select("event_id", F.lit(True).alias("doubt")).distinct()
    named = rows.select(F.col("event_id").alias("ref"), F.col("agent").alias("author"), F.col("type").alias("ref_type"))
    links = links.join(named, "ref").where("author <> agent AND ref_type <> 'tool_result'").join(known.drop("claim_id"), "ref", "left").join(doubtful, "event_id", "left")
    how = (
        F.when(_kind("acknowledgement"), "ack").when(F.col("ref_type") == "correction", "correction").when(F.col("ref_type") == "claim", tone)
        .when(_kind("action") & F.coalesce("doubt", F.lit(False)), "unverified").otherwise("normal")
    )
    label = F.when(_kind("acknowledgement"), "acknowledged").when(F.col("ref_type") == "correction", "correction").when(F.col("ref_type") == "claim", "claim").otherwise("reference")
    passed = links.select(F.concat(F.lit("agent:"), "author"), agent, how, label, "event_id")
    return checked.union(claimed).union(passed).groupBy("src", "dst", "tone", "label").agg(F.countDistinct("event_id").alias("n"))


# ---- subjects


def _told(w: World) -> DataFrame:
    """Corrections and failure reports of subjects."""
    fixes = w.corrections.where("subject IS NOT NULL").select("subject", "sequence", "agent", "event_id", F.lit("correction").alias("kind"))
    return fixes.union(w.visible.where(_kind("quote") & F.col("subject").isNotNull()).select("subject", "sequence", "agent", "event_id", F.lit("report")))


def _claims_seen(w: World) -> DataFrame:
    """Claims with their subject's first claim and whether their author had checked it before."""
    heads = w.own_claims.groupBy("subject").agg(F.min(_event("agent")).alias("head"))
    checks = w.results.where("is_check").select("subject", "agent", "sequence")
    return w.beside(w.own_claims.select("subject", "agent", "sequence", "event_id"), checks, ["subject", "agent"], {"own": count(F.lit(True))}).join(heads, "subject")


def incidents(w: World) -> DataFrame:
    """One row per claimed subject: its story in numbers, and how it stands (split where agents' latest checks disagree)."""
    heads = w.own_claims.groupBy("subject").agg(F.min(_event("agent")).alias("head"), F.count(F.lit(1)).alias("claims"))
    others = w.own_claims.join(heads.select("subject", "head"), "subject").where("agent <> head.agent").groupBy("subject").agg(F.countDistinct("agent").alias("cascade"))
    verified = w.visible.where(_kind("tool_result") & (F.col("category") == "verification") & F.col("subject").isNotNull())
    checks = verified.groupBy("subject").agg(F.count(F.lit(1)).alias("checks"), F.max(F.when(F.col("is_check"), F.struct("sequence", "outcome")))["outcome"].alias("latest"))
    per = w.results.where("is_check").groupBy("subject", "agent").agg(F.max(F.struct("sequence", "outcome"))["outcome"].alias("o")).groupBy("subject").agg(F.countDistinct("o").alias("views"))
    told = _told(w)
    said = told.groupBy("subject").agg(F.count(F.when(F.col("kind") == "report", 1)).alias("reports"), F.count(F.when(F.col("kind") == "correction", 1)).alias("corrections"))
    rows = heads.join(others, "subject", "left").join(checks, "subject", "left").join(per, "subject", "left").join(said, "subject", "left").withColumn("at", F.col("head.sequence"))
    check = w.results.where("is_check").select("subject", F.col("sequence").alias("at"))
    rows = w.beside(rows, check, ["subject"], after={"first_check": first(F.col("at"))}, order="at")
    rows = w.beside(rows, told.select("subject", F.col("sequence").alias("at")), ["subject"], after={"first_word": first(F.col("at"))}, order="at")
    linked = w.own_claims.select("subject", "sequence").union(told.where("kind = 'report'").select("subject", "sequence")).join(rows.select("subject", "at", "first_check", "first_word"), "subject").where("sequence > at")
    spans = linked.groupBy("subject").agg(
        F.count(F.when(F.col("first_check").isNull() | (F.col("sequence") < F.col("first_check")), 1)).alias("to_first_check"),
        F.count(F.when(F.col("first_word").isNull() | (F.col("sequence") < F.col("first_word")), 1)).alias("to_correction"),
    )
    standing = F.when(F.col("latest").isNull(), "unchecked").when(F.col("views") > 1, "split").when(F.col("latest") == "pass", "passing").otherwise("failing")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(spans, "subject", "left").select(
        "subject", F.col("head.event_id").alias("first_claim"), F.col("head.agent").alias("announcer"), (F.col("claims") - 1).alias("repeats"), zero("checks"), zero("reports"), zero("corrections"), zero("cascade"),
        zero("to_first_check"), F.col("first_check").isNotNull().alias("checked_after"), zero("to_correction"), F.col("first_word").isNotNull().alias("corrected_after"), standing.alias("standing"),
    )


def roles(w: World) -> DataFrame:
    """(agent, role, subject): announcer, repeater, adopter-without-check, verifier, corrector."""
    seen = _claims_seen(w)
    part = lambda df, role: df.select("agent", F.lit(role).alias("role"), "subject")
    announcers = part(seen.where("sequence = head.sequence"), "announcer")
    later = seen.where("sequence > head.sequence AND agent <> head.agent")
    claimed = w.own_claims.select("subject").distinct()
    checkers = part(w.results.where("is_check").join(claimed, "subject", "left_semi"), "verifier")
    fixers = part(_told(w).join(claimed, "subject", "left_semi"), "corrector")
    return reduce(DataFrame.union, [announcers, part(later, "repeater"), part(later.where("own = 0"), "adopter-without-check"), checkers, fixers]).distinct()


def rates(w: World) -> DataFrame:
    """(rate, n, total): counts of so many out of so many, never bare shares."""
    later = _claims_seen(w).where("sequence > head.sequence AND agent <> head.agent")
    repeats = later.agg(F.lit("repeats_without_check").alias("rate"), F.count(F.when(F.col("own") == 0, 1)).alias("n"), F.count(F.lit(1)).alias("total"))
    claimants = w.own_claims.groupBy("subject").agg(F.countDistinct("agent").alias("agents")).where(F.col("agents") >= CONSENSUS)
    checked = w.results.where("is_check").groupBy("subject").agg(F.countDistinct("agent").alias("checkers"), F.min("agent").alias("checker"))
    crowd = claimants.join(checked, "subject", "left")
    consensus = crowd.agg(F.lit("consensus_without_check"), F.count(F.when(F.col("checkers").isNull(), 1)), F.count(F.lit(1)))
    firsts = w.own_claims.groupBy("subject", "agent").agg(F.min("sequence").alias("lo"), F.max("sequence").alias("hi"))
    heard = _told(w).select("subject", F.col("agent").alias("by"), F.col("sequence").alias("at")).join(firsts, "subject").where("lo < at AND agent <> by")
    spread = heard.agg(F.lit("correction_reach"), F.count(F.when(F.col("hi") > F.col("at"), 1)), F.count(F.lit(1)))
    sole = checked.join(w.own_claims.select("subject").distinct(), "subject", "left_semi").where("checkers = 1").groupBy("checker").agg(F.count(F.lit(1)).alias("k"))
    points = sole.agg(F.lit("single_points"), F.count(F.when(F.col("k") >= SOLE_SUBJECTS, 1)), F.count(F.lit(1)))
    return reduce(DataFrame.union, [repeats, consensus, spread, points])


def rechecks(w: World) -> DataFrame:
    """(subject, agent, action): who should check or correct what, for a person to read.  A neutral verifier is the one with most checks
    who neither announced the subject nor saw it fail."""
    story = incidents(w)
    tally = w.visible.where("is_check").groupBy("agent").agg(F.count(F.lit(1)).alias("n"))
    ranks = tally.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "agent"))).alias("ranks"))  # one row, a few agents
    failing = w.visible.where("is_check AND failed AND subject IS NOT NULL").groupBy("subject").agg(F.collect_set("agent").alias("saw_fail"))
    rows = story.join(failing, "subject", "left").crossJoin(F.broadcast(ranks))
    fit = F.filter("ranks", lambda r: (r["agent"] != F.col("announcer")) & ~F.array_contains(F.coalesce("saw_fail", F.array().cast("array<string>")), r["agent"]))
    rows = rows.withColumn("neutral", F.get(fit, F.lit(0))["agent"])
    pick = lambda when, who, what: F.when(when, F.struct(who.alias("agent"), F.lit(what).alias("action")))
    offers = F.array(
        pick(F.col("standing") == "unchecked", F.coalesce("neutral", "announcer"), "verify"), pick((F.col("standing") == "split") & F.col("neutral").isNotNull(), F.col("neutral"), "break the tie"),
        pick(F.col("standing") == "failing", F.col("announcer"), "correct the claim"),
    )
    own = rows.select("subject", F.explode(F.filter(offers, lambda o: o.isNotNull())).alias("o")).select("subject", "o.*")
    adopters = roles(w).where("role = 'adopter-without-check'").select("subject", "agent", F.lit("check it yourself").alias("action"))
    reports = w.visible.where(_kind("quote") & F.col("subject").isNotNull()).groupBy("subject").agg(F.min(_event("agent")).alias("r"))
    heads = w.own_claims.groupBy("subject").agg(F.min("sequence").alias("head"))
    went_on = w.own_claims.join(reports, "subject").join(heads, "subject").where("sequence > r.sequence AND sequence > head AND agent <> r.agent").select("subject", F.col("r.agent").alias("agent"), F.lit("share the failing record again").alias("action"))
    return own.union(adopters).union(went_on).distinct()


# ---- triage and counts over the window


def subject_type(artifact: Column) -> Column:
    """What kind of thing a subject is."""
    starts = lambda *p: reduce(lambda a, b: a | b, [artifact.startswith(x) for x in p])
    return (
        F.when(artifact.isNull(), "no-subject").when(starts("pages:"), "pages-built").when(starts("pr:"), "pr-merged").when(starts("tests:"), "tests").when(starts("repo:"), "repo-pushed")
        .when(starts("file:"), "file-exists").when(starts("proc:"), "proc-running").when(starts("http://", "https://"), "url-live").otherwise("other")
    )


def triage(findings: DataFrame) -> DataFrame:
    """Findings with their bucket: open, needs, patterns, resolved or count."""
    kind = subject_type(F.col("subject"))
    return findings.withColumn(
        "bucket",
        F.when(F.col("state") == "resolved", "resolved").when((F.col("monitor") == "C") & ~kind.isin(*INCIDENT_GRADE), "count")
        .when(F.col("monitor").isin(*CONTRADICTED), F.when(F.col("state") == "active", "open").otherwise("needs")).when(F.col("monitor").isin(*NEEDS_EVIDENCE), "needs").otherwise("patterns"),
    )


def _checkable(artifact: str = "artifact", version: str = "version") -> Column:
    """The kind of subject that a rule for verdicts may cover."""
    head = F.split_part(F.col(artifact), F.lit(":"), F.lit(1))
    slot = F.col(version).isin("live", "working-tree", "pushed", "built", "merged", "exists", "running")
    return F.when(F.col(artifact).isNull(), "none").when(slot, F.concat(F.when(head.startswith("http"), "url").otherwise(head), F.lit(":"), version)).otherwise("artifact-version")


def unverifiable(w: World) -> DataFrame:
    """(agent, n): claims on a kind of subject that no verification in this source is about."""
    seen = w.visible.where(_kind("tool_result") & (F.col("category") == "verification")).select(_checkable().alias("kind")).distinct().where("kind <> 'none'")
    return w.visible.where(_kind("claim")).withColumn("kind", _checkable()).join(seen, "kind", "left_anti").groupBy("agent").agg(F.count(F.lit(1)).alias("n"))


def unclaimed_verify_goals(w: World) -> DataFrame:
    """(task): ended sessions that set out to verify, verified nothing and claimed nothing."""
    busy = w.visible.where((F.col("is_check") | _kind("claim")) & F.col("task").isNotNull()).select("task").distinct()
    return w.sessions.where("verify_goal AND ended IS NOT NULL").join(busy, "task", "left_anti").select("task")


def long_sessions(w: World, least: int = LONG_SESSION) -> DataFrame:
    """(task, owner, turns): ended sessions of so many turns without a verdict or claim."""
    per = w.visible.where("task IS NOT NULL").groupBy("task").agg(
        F.count(F.when(_kind("action") & F.col("turn_id").isNotNull(), 1)).alias("turns"), F.max(_kind("claim") | (_kind("tool_result") & F.coalesce(F.col("outcome") != "inconclusive", F.lit(True)))).alias("busy"),
        F.max(_kind("status_updated") & (F.col("status") == "ended")).alias("over"),
    )
    return w.sessions.select("task", "owner").join(per, "task").where((F.col("turns") >= least) & ~F.col("busy") & F.coalesce("over", F.lit(False))).select("task", "owner", "turns")


def goal_churn(w: World, least: int = CHURN_SESSIONS, similar: float = CHURN_SIMILAR) -> DataFrame:
    """(agent, sessions): agents without verdict or claim who went through so many sessions of goals unlike each other: each is taken
    that is unlike all taken before (an agent's goals are gathered, as the choice goes one by one)."""
    busy = w.visible.where(_kind("claim") | (_kind("tool_result") & F.coalesce(F.col("outcome") != "inconclusive", F.lit(True)))).select(F.col("agent").alias("owner")).distinct()
    words = F.filter(F.array_distinct(F.split("goal_key", " ")), lambda x: F.length(x) > 1)
    rows = w.sessions.where("goal_key <> ''").join(busy, "owner", "left_anti").select("owner", F.struct(F.col("created.sequence").alias("at"), words.alias("words")).alias("g"))
    goals = rows.groupBy("owner").agg(F.transform(F.array_sort(F.collect_list("g")), lambda g: g["words"]).alias("goals"))
    alike = lambda a, b: F.size(F.array_intersect(a, b)) >= similar * F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    taken = F.aggregate("goals", F.array().cast("array<array<string>>"), lambda acc, g: F.when(F.exists(acc, lambda p: alike(p, g)), acc).otherwise(F.concat(acc, F.array(g))))
    return goals.select(F.col("owner").alias("agent"), F.size(taken).cast("long").alias("sessions")).where(F.col("sessions") >= least)


def single_points(log: DataFrame, run, findings: DataFrame, limit: int = 100) -> DataFrame:
    """(finding_id, event_id, outcome): for at most ``limit`` records that active findings rest on (those of most findings, a stated bound on how
    often ``run`` is called), whether a finding flips to insufficient or vanishes when the record is withheld."""
    links = findings.where("state = 'active'").select("finding_id", F.explode("evidence.event_id").alias("event_id"))
    records = [r[0] for r in links.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "event_id").limit(limit).collect()]
    parts = []
    for record in records:
        again = run(log, (record,)).select("finding_id", F.col("state").alias("now"))
        rows = links.where(F.col("event_id") == record).join(again, "finding_id", "left")
        parts.append(rows.select("finding_id", "event_id", F.when(F.col("now").isNull(), "vanishes").when(F.col("now") == "insufficient", "flips").alias("outcome")).where("outcome IS NOT NULL"))
    return reduce(DataFrame.union, parts) if parts else links.select("finding_id", "event_id", F.lit("").alias("outcome")).limit(0)


def at_cursors(log: DataFrame, cursors: list[int], measure) -> DataFrame:
    """``measure`` of the log at each of a few cursors."""
    parts = [measure(visible(log, c)).withColumn("cursor", F.lit(c)) for c in cursors]
    return reduce(DataFrame.unionByName, parts)


__all__ = ["at_cursors", "citing", "claim_impact", "claims", "correction_audience", "dependencies", "difference", "evidence", "flow", "goal_churn", "incidents", "lineage", "long_sessions", "ranked_claims", "rates", "reach",
           "rechecks", "roles", "single_points", "stale_actions", "subject_type", "tasks", "triage", "unclaimed_verify_goals", "unverifiable"]
