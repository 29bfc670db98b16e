"""Monitors: claims, sessions and rooms held against the record, as of any cursor.

The typed log is one wide frame ordered by ``sequence`` (a dense whole number).  ``World`` holds what is visible at a cursor
and derives, once, the frames that monitors share: claims with what surrounds them on their subject, for their
author and in their session; sessions; corrections with the claim they withdraw; chat.  What came before and
after is gathered by running windows over key and block (see ``ordered``), not by joining claims with checks, so a subject,
room or agent with a third of all records is the work of many tasks.

A finding is one row of FINDING.  ``state`` is active, resolved (with the record that resolved it) or insufficient
where the record cannot tell; ``evidence`` names the records that decide, with their roles (of a long run, chain or list of
checks the first and the last ones that matter, not all); ``missing`` says what would settle it.  Two passes over all
findings follow: a session whose record has a gap in time, and a withheld record inside a finding's span, make
findings insufficient.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.ordered import BLOCK, Facts, beside, carry, count, first, last, last_of_another, overlap_pairs
from tracewell.staging import scratch

#: The columns of the typed log.
LOG = """sequence bigint, event_id string, ts timestamp_ntz, agent string, task string, room string, type string, provenance string,
    status string, status_after string, end_reason string, evidence array<string>,
    claim_id string, artifact string, version string, asserts string, hedged boolean, repeat_of string, number_value double, number_kind string,
    run_id string, category string, rule string, outcome string, scope string, final_url string, suppressed boolean, empty_output boolean, passed_seen double, status_seen double,
    supersedes string, addressed_to array<string>, acknowledges string, quotes_event string,
    turn_id string, action_kind string, command string, command_hash string, output_hash string, writes array<string>, destructive string, navigates string, references array<string>,
    is_human boolean, is_question boolean, names array<string>, negative boolean, blame boolean, own_error boolean, conventions array<string>, question_to array<string>,
    to array<string>, tokens array<string>, refs array<string>,
    tasks array<struct<task: string, owner: string, title: string, goal_key: string, verify_goal: boolean, depends_on: array<string>>>, dep_from string, dep_to string, assignee string"""
FINDING = (
    "monitor", "finding_id", "subject", "claim_id", "task", "agent", "detected_at", "detected_id", "state", "resolved_at", "resolved_id", "evidence", "missing", "attributes",
)

#: Thresholds of the monitors.
FLIPS, CHAIN, RUN, AGENTS, CHECKS, CLAIMANTS, SESSIONS, ADOPTERS, USES = 2, 3, 3, 3, 3, 2, 3, 3, 6
#: Monitors that run at a time where frames are staged.
SIDE_BY_SIDE = 4
GAP_MS, BLAME_MS = 2 * 3_600_000, 30 * 60_000
_LOCAL = r"^(proc:|https?://(localhost|127\.0\.0\.1|0\.0\.0\.0)(:|/|$))"


def normal_url(url: Column) -> Column:
    """Scheme and host lower-cased, without fragment and closing slashes."""
    plain = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "/+$", "")
    head = F.regexp_extract(plain, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", 0)
    return F.concat(F.lower(head), F.substring(plain, F.length(head) + 1, F.length(plain)))


def _kind(*names: str) -> Column:
    return F.col("type").isin(*names)


def _event(*more: str) -> Column:
    """A pointer to a record; pointers compare by sequence."""
    return F.struct("sequence", "event_id", *more)


def visible(log: DataFrame, cursor: int | None = None, withheld: tuple[str, ...] = ()) -> DataFrame:
    """The records up to the cursor, less those withheld."""
    out = log if cursor is None else log.where(F.col("sequence") <= cursor)
    return out.where(~F.col("event_id").isin(*withheld)) if withheld else out


#: What is carried along of a claim, a result and a correction.
_CLAIM = "sequence event_id agent task place type claim_id artifact version subject hedged repeat_of number_value number_kind evidence".split()
_RESULT = "sequence event_id agent task type artifact subject category rule outcome scope final_url run_id passed_seen status_seen passed failed is_check quiet empty here hedged".split()
_CORRECTION = "sequence event_id agent task place supersedes evidence is_chat".split()


@dataclass
class World:
    """What is known at ``cursor``.  ``seen`` (ref, sequence) are references carried in from before; ``stage`` may write a shared
    frame to a table, so that many monitors read it."""

    log: DataFrame
    cursor: int | None = None
    withheld: tuple[str, ...] = ()
    seen: DataFrame | None = None
    stage: Callable[[DataFrame, str], DataFrame] = field(default=lambda df, name: df)

    @property
    def stages(self) -> bool:
        """Whether frames are written."""
        return self.stage is not World.stage

    @cached_property
    def block(self) -> int | None:
        """How the order is cut for facts about rows before and after: not at all if the log lies in one block."""
        ends = self.log.agg(F.min("sequence"), F.max("sequence")).first()
        return None if ends[0] is None or ends[0] // BLOCK == ends[1] // BLOCK else BLOCK

    def carry(self, *args, **kwargs) -> DataFrame:
        return carry(*args, **kwargs, block=self.block, stage=self.stage)

    def beside(self, *args, **kwargs) -> DataFrame:
        return beside(*args, **kwargs, block=self.block, stage=self.stage)

    def last_of_another(self, *args, **kwargs) -> DataFrame:
        return last_of_another(*args, **kwargs, block=self.block, stage=self.stage)

    @cached_property
    def visible(self) -> DataFrame:
        check = _kind("tool_result") & (F.col("category") == "verification") & F.col("outcome").isin("pass", "fail")
        human = F.coalesce("is_human", F.lit(False))
        chat = (_kind("message", "quote") & ~human) | _kind("directive") | (_kind("claim", "correction") & F.col("room").isNotNull())
        rows = visible(self.log, self.cursor, self.withheld).withColumns(
            {
                "subject": F.concat("artifact", F.lit("@"), "version"), "human": human, "is_check": F.coalesce(check, F.lit(False)),
                "passed": F.coalesce(F.col("outcome") == "pass", F.lit(False)), "failed": F.coalesce(F.col("outcome") == "fail", F.lit(False)),
                "is_chat": F.coalesce(chat, F.lit(False)), "negative_chat": _kind("quote", "correction") | (_kind("message") & F.coalesce("negative", F.lit(False))),
                "place": F.coalesce("room", F.lit("")), "quiet": F.coalesce("suppressed", F.lit(False)), "empty": F.coalesce("empty_output", F.lit(False)),
                "here": F.coalesce(normal_url(F.col("final_url")) == normal_url(F.col("artifact")), F.lit(False)),
            }
        )
        return self.stage(rows, "visible")

    def status(self, refs: DataFrame, ref: str = "ref") -> DataFrame:
        """``refs`` with ``ref_status``: available, withheld, future or missing."""
        ids = self.log.select(F.col("event_id").alias(ref), F.col("sequence").alias("_seq"))
        hidden = F.col(ref).isin(*self.withheld) if self.withheld else F.lit(False)
        late = F.lit(False) if self.cursor is None else F.col("_seq") > self.cursor
        state = F.when(F.col("_seq").isNull(), "missing").when(late, "future").when(hidden, "withheld").otherwise("available")
        return refs.join(ids, ref, "left").withColumn("ref_status", state).drop("_seq")

    def gone(self, rows: DataFrame, evidence: str = "evidence") -> DataFrame:
        """(event_id, gone): the withheld or missing records that rows cite, in their order (a row cites a few)."""
        refs = rows.select("event_id", F.posexplode(evidence).alias("at", "ref"))
        lost = self.status(refs).where("ref_status IN ('withheld', 'missing')")
        return lost.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "ref"))), lambda x: x["ref"]).alias("gone"))

    # ---- shared frames

    @cached_property
    def results(self) -> DataFrame:
        """Tool results on a subject, each with the next pass after it."""
        rows = self.visible.where(_kind("tool_result") & F.col("subject").isNotNull()).select(*_RESULT)
        good = lambda more: F.when(F.col("passed") & more, _event())
        return self.stage(self.carry(rows, ["subject"], after={"then_pass": first(good(F.col("is_check"))), "then_any_pass": first(good(F.lit(True)))}), "results")

    @cached_property
    def own_claims(self) -> DataFrame:
        """Claims on a subject."""
        return self.visible.where(_kind("claim") & F.col("subject").isNotNull()).select(*_CLAIM)

    @cached_property
    def corrections(self) -> DataFrame:
        """Corrections with the claim they withdraw, where it is visible."""
        known = self.visible.where(_kind("claim")).groupBy("claim_id").agg(F.max(F.struct("sequence", "event_id", "agent", "subject")).alias("claim"))
        rows = self.visible.where(_kind("correction")).select(*_CORRECTION)
        return rows.join(known.withColumnRenamed("claim_id", "supersedes"), "supersedes", "left").withColumn("subject", F.col("claim.subject"))

    @cached_property
    def by_subject(self) -> DataFrame:
        """Claims with the facts of their subject."""
        check, ok, bad = F.col("is_check"), F.col("is_check") & F.col("passed"), F.col("is_check") & F.col("failed")
        verification = F.col("category") == "verification"
        tests, e = ok & (F.col("rule") == "test-summary"), _event("agent", "task", "run_id")
        when = F.when
        before: Facts = {
            "first_fail": first(when(verification & F.col("failed"), e)), "n_verified": count(verification), "n_pass": count(ok),
            "first_check": first(when(check, e)), "last_check": last(when(check, _event("agent", "task", "outcome"))), "n_check": count(check), "n_loud": count(check & ~F.col("quiet")),
            "last_pass": last(when(ok, e)), "last_fail": last(when(bad, e)), "last_result": last(e), "n_result": count(F.lit(True)), "n_full": count(~F.col("empty")),
            "n_other_rule": count(ok & ~F.coalesce(F.col("rule") == "http-status", F.lit(False))), "n_here": count(ok & F.col("here")),
            "last_masked": last(when(ok & F.col("final_url").isNotNull() & ~F.col("here"), e)), "last_uncaptured": last(when(ok & F.col("final_url").isNull(), e)),
            "n_tests": count(tests), "n_whole": count(tests & (F.col("scope") == "full")), "last_tests": last(when(tests, e)), "last_unscoped": last(when(tests & F.col("scope").isNull(), e)),
            "last_passed_seen": last(when(F.col("passed_seen").isNotNull(), _event(F.col("passed_seen").alias("n")))),
            "last_status_seen": last(when(F.col("status_seen").isNotNull(), _event(F.col("status_seen").alias("n")))), "support": last(when(F.col("passed"), e)),
        }
        after: Facts = {
            "next_check": first(when(check, _event("agent", "outcome"))), "next_pass": first(when(ok, e)), "next_fail": first(when(bad, _event("agent", "then_pass"))),
            "next_loud_pass": first(when(ok & ~F.col("quiet"), e)), "next_full": first(when(~F.col("empty"), e)), "next_here": first(when(ok & F.col("here"), e)),
            "next_whole": first(when(tests & (F.col("scope") == "full"), e)),
        }
        return self.stage(self.beside(self.own_claims, self.results, ["subject"], before, after), "claims")

    @cached_property
    def withdrawn(self) -> DataFrame:
        """(claim_id, withdrawn, withdrawn_later): the first correction of a claim by anyone, by agent, and the first by its author after it."""
        rows = self.corrections.select("supersedes", _event("agent").alias("by"), "claim")
        own = F.col("by.agent") == F.col("claim.agent")
        return rows.groupBy(F.col("supersedes").alias("claim_id")).agg(
            F.min("by").alias("withdrawn"), F.min(F.when(own, F.col("by"))).alias("own_withdrawn"), F.min(F.when(own & (F.col("by.sequence") > F.col("claim.sequence")), F.col("by"))).alias("withdrawn_later")
        )

    def claims(self, withdrawn: bool = False, gone: bool = False) -> DataFrame:
        rows = self.by_subject
        if withdrawn:
            rows = rows.join(self.withdrawn, "claim_id", "left")
        return rows.join(self.gone(self.own_claims), "event_id", "left") if gone else rows

    @cached_property
    def sessions(self) -> DataFrame:
        """(task, owner, title, goal_key, verify_goal, created, ended): one row for each task that a record created."""
        made = self.visible.where(_kind("task_created")).select(_event().alias("created"), F.inline("tasks")).drop("depends_on")
        ends = self.visible.where(F.when(_kind("status_updated"), F.col("status")).otherwise(F.col("status_after")) == "ended")
        ended = ends.where("task IS NOT NULL").groupBy("task").agg(F.min(_event(F.when(_kind("status_updated"), F.col("end_reason")).alias("reason"))).alias("ended"))
        return self.stage(made.join(ended, "task", "left"), "sessions")

    @cached_property
    def gaps(self) -> DataFrame:
        return self.stage(gaps(self), "gaps")

    @cached_property
    def verdicts(self) -> DataFrame:
        """Tool results of a session that pass or fail, whatever they check."""
        return self.visible.where(_kind("tool_result") & F.col("task").isNotNull() & F.coalesce(F.col("outcome") != "inconclusive", F.lit(True)))

    @cached_property
    def turns(self) -> DataFrame:
        return self.visible.where(_kind("action") & F.col("task").isNotNull() & F.col("turn_id").isNotNull())

    def next_chat(self, probes: DataFrame, name: str, order: str) -> DataFrame:
        """``probes`` (owner, ...) with the owner's next word after ``order``."""
        said = self.visible.where(F.col("is_chat") | _kind("claim", "correction")).select(F.col("agent").alias("owner"), "sequence", _event("ts", "task", "type", "blame", "own_error", "negative_chat").alias("said"))
        return self.beside(probes.withColumn("_at", F.col(order)), said.withColumnRenamed("sequence", "_at"), ["owner"], after={name: first(F.col("said"))}, order="_at").drop("_at")


def _finding(
    rows: DataFrame, monitor: str, key: Column, *, subject: Column | str | None = None, claim: Column | str | None = None, task: Column | str | None = None, agent: Column | str = "agent",
    at: Column | str = "sequence", at_id: Column | str = "event_id", resolved: Column | None = None, state: Column | None = None,
    evidence: list[tuple[Column, str]] = (), missing: Column | None = None, attributes: Column | None = None, more: tuple[str, ...] = (),
) -> DataFrame:
    """Rows of FINDING.  ``resolved`` points to the record that settles it; ``more`` columns are kept beside."""
    col = lambda c: F.col(c) if isinstance(c, str) else F.lit(None) if c is None else c
    by = F.lit(None).cast("struct<sequence: bigint, event_id: string>") if resolved is None else resolved
    state = F.when(by.isNotNull(), "resolved").otherwise("active") if state is None else state
    settled = F.when(state == "resolved", by["sequence"])
    links = F.array(*[F.struct(c.cast("string").alias("event_id"), F.lit(role).alias("role")) for c, role in evidence])
    none = F.array().cast("array<string>")
    strings = lambda a: none if a is None else F.coalesce(F.filter(a, lambda x: x.isNotNull()), none)
    return rows.select(
        F.lit(monitor).alias("monitor"), F.concat(F.lit(f"{monitor}:"), key.cast("string")).alias("finding_id"), col(subject).cast("string").alias("subject"), col(claim).cast("string").alias("claim_id"),
        F.coalesce(col(task).cast("string"), F.lit("")).alias("task"), col(agent).cast("string").alias("agent"), col(at).cast("bigint").alias("detected_at"), col(at_id).cast("string").alias("detected_id"),
        state.alias("state"), settled.cast("bigint").alias("resolved_at"), F.when(state == "resolved", by["event_id"]).alias("resolved_id"),
        F.filter(links, lambda x: x["event_id"].isNotNull()).alias("evidence"), strings(missing).alias("missing"), strings(attributes).alias("attributes"), *more,
    )


def _on_claim(rows: DataFrame, monitor: str, **how) -> DataFrame:
    """A finding about a claim, made when it was."""
    how = {"key": F.col("event_id"), "subject": "subject", "claim": "claim_id", "task": "task", **how}
    return _finding(rows, monitor, how.pop("key"), **how)


def _id(name: str) -> Column:
    return F.col(f"{name}.event_id")


def _at(name: str) -> Column:
    return F.col(f"{name}.sequence")


def _lacks(settled: Column, *texts) -> Column:
    """What is missing unless ``settled``."""
    parts = [F.lit(t) if isinstance(t, str) else t for t in texts]
    return F.when(settled.isNull(), F.array(F.concat(*parts)))


def _earlier(*pointers: Column) -> Column:
    """The first of some pointers, of which any may be null."""
    plain = [F.when(p.isNotNull(), F.struct(p["sequence"].alias("sequence"), p["event_id"].alias("event_id"))) for p in pointers]
    return F.least(*plain) if len(plain) > 1 else plain[0]


def _unavailable(name: str = "gone") -> Column:
    return F.transform(name, lambda r: F.concat(r, F.lit(" is not available")))


# ---- claims and their evidence


def unsupported_completion(w: World) -> DataFrame:
    """A: a claim after failed verifications of its subject and no passing one; or its cited records cannot be seen and no verification is."""
    rows = w.claims(withdrawn=True, gone=True).where("task IS NOT NULL")
    failed = rows.where("n_verified > 0 AND first_fail IS NOT NULL AND n_pass = 0")
    by = _earlier(F.col("next_pass"), F.col("withdrawn"))
    known = _on_claim(
        failed, "A", resolved=by, evidence=[(_id("first_fail"), "failed verification"), (F.col("event_id"), "claim"), (by["event_id"], "correction or passing run")],
        missing=F.array(F.concat(F.lit("passing result for "), "subject"), F.lit("why the run was read as passing")),
    )
    blind = rows.where("n_verified = 0 AND gone IS NOT NULL")
    lost = _on_claim(blind, "A", state=F.lit("insufficient"), evidence=[(F.col("event_id"), "claim"), (F.element_at("gone", 1), "cited verification"), (_id("withdrawn"), "correction")], missing=_unavailable())
    return known.union(lost)


def superseded_reuse(w: World) -> DataFrame:
    """B: an action cites a claim that was corrected before."""
    acts = w.visible.where(_kind("action") & F.col("task").isNotNull()).select("sequence", "event_id", "agent", "task", "evidence", F.posexplode("references").alias("nth", "claim_id"))
    fixes = w.corrections.select(F.col("supersedes").alias("claim_id"), F.col("sequence").alias("fix_seq"), F.col("event_id").alias("fix_id"), F.col("evidence").alias("fix_evidence"))
    fixes = fixes.groupBy("claim_id").agg(F.min(F.struct("fix_seq", "fix_id", "fix_evidence")).alias("fix"))
    hits = acts.join(fixes, "claim_id").where("fix.fix_seq < sequence")
    claims = w.visible.where(_kind("claim")).groupBy("claim_id").agg(F.max(_event()).alias("said"))
    lost = w.gone(hits.select(F.concat("event_id", F.lit("|"), "nth").alias("event_id"), F.concat(F.coalesce("evidence", F.array().cast("array<string>")), F.coalesce("fix.fix_evidence", F.array().cast("array<string>"))).alias("evidence")))
    hits = hits.join(claims, "claim_id", "left").withColumn("_k", F.concat("event_id", F.lit("|"), "nth")).join(lost.withColumnRenamed("event_id", "_k"), "_k", "left")
    acks = w.visible.where(_kind("acknowledgement")).select(F.col("acknowledges").alias("fix_id"), "agent", "sequence", _event().alias("ack"))
    hits = w.beside(hits.withColumn("fix_id", F.col("fix.fix_id")), acks, ["fix_id", "agent"], {"known": first(F.col("ack"))}, {"later_ack": first(F.col("ack"))})
    corrected = fixes.select("claim_id", F.lit(True).alias("bad"))
    cites = w.visible.where(_kind("action") & F.col("task").isNotNull()).select("event_id", F.explode("references").alias("claim_id")).join(corrected, "claim_id").select("event_id").distinct()
    clean = w.visible.where(_kind("action") & F.col("task").isNotNull()).join(cites, "event_id", "left_anti").select("agent", "task", "sequence", _event().alias("act"))
    hits = w.beside(hits, clean, ["agent", "task"], after={"recovered": first(F.col("act"))})
    blind = F.col("said").isNull() & F.col("gone").isNotNull()
    by = F.when(~blind, _earlier(F.col("later_ack"), F.col("recovered")))
    state = F.when(blind, "insufficient").when(by.isNotNull(), "resolved").otherwise("active")
    no_receipt = F.when(F.col("known").isNull(), F.concat(F.lit("receipt of "), "fix_id", F.lit(" by "), "agent"))
    return _finding(
        hits, "B", F.concat("event_id", F.lit(":"), "claim_id"), claim="claim_id", task="task", resolved=by, state=state,
        evidence=[(F.coalesce(_id("said"), F.element_at("gone", 1)), "original claim"), (F.col("fix_id"), "correction"), (F.col("event_id"), "action citing the claim"), (by["event_id"], "recovery")],
        missing=F.array(F.when(blind, F.concat(F.element_at("gone", 1), F.lit(" is not available"))), no_receipt),
    )


def never_checked(w: World) -> DataFrame:
    """C: no check of the subject before the claim."""
    rows = _in_session(w, w.claims(gone=True).where("n_check = 0"))
    blind = F.col("gone").isNotNull()
    alone = F.when(F.col("task").isNotNull() & (F.col("session_checks") == 0), "session ran no checks")
    built = F.when(F.col("next_check").isNull() & (F.col("session_builds") > 0), "a build passed in this session; nothing verified the subject")
    state = F.when(blind, "insufficient").when(F.col("next_check").isNotNull(), "resolved").otherwise("active")
    missing = F.when(blind, _unavailable()).otherwise(_lacks(F.col("next_check"), "verification of ", F.col("subject")))
    return _on_claim(
        rows, "C", resolved=F.col("next_check"), state=state, missing=missing, attributes=F.array(alone, built),
        evidence=[(F.col("event_id"), "claim"), (F.when(blind, F.element_at("gone", 1)), "cited record"), (F.when(~blind, _id("next_check")), "first verification")],
    )


def _in_session(w: World, rows: DataFrame) -> DataFrame:
    """Claims with what their session did before them."""
    did = w.visible.where(_kind("tool_result") & F.col("task").isNotNull())
    good = F.col("is_check") & F.col("passed")
    local = F.coalesce(F.col("artifact").rlike(_LOCAL), F.lit(False))
    return w.beside(
        rows, did, ["task"],
        {"session_checks": count(F.col("is_check")), "session_builds": count((F.col("category") == "build") & F.col("passed")), "session_passes": count(good),
         "session_far": count(good & ~local), "session_pass": last(F.when(good, _event()))},
    )


def stale_after_failure(w: World) -> DataFrame:
    """G: the last check before the claim passed, a later one failed."""
    rows = w.claims(withdrawn=True).where("last_check.outcome = 'pass' AND next_fail IS NOT NULL")
    by = _earlier(F.col("withdrawn_later"), F.col("next_fail.then_pass"))
    return _on_claim(
        rows, "G", at=_at("next_fail"), at_id=_id("next_fail"), resolved=by, missing=_lacks(by, "correction by ", F.col("agent"), " or passing check of ", F.col("subject")),
        evidence=[(_id("last_check"), "passing check at the time"), (F.col("event_id"), "claim"), (_id("next_fail"), "later failing check"), (by["event_id"], "correction or later pass")],
    )


def split_evidence(w: World) -> DataFrame:
    """J: the claimant's latest pass is older than another agent's latest failure."""
    checks = w.results.where("is_check")
    per = checks.groupBy("subject", "agent").agg(F.max(F.when(F.col("passed"), _event())).alias("p"), F.max(F.when(F.col("failed"), _event("agent"))).alias("f"))
    top = per.groupBy("subject").agg(F.max("f").alias("f1"))
    other = per.join(top, "subject").where("agent <> f1.agent").groupBy("subject").agg(F.max("f").alias("f2"))
    rows = w.own_claims.join(per.where("p IS NOT NULL").select("subject", "agent", "p"), ["subject", "agent"]).join(top, "subject").join(other, "subject", "left")
    rows = rows.withColumn("fail", F.when(F.col("f1.agent") != F.col("agent"), F.col("f1")).otherwise(F.col("f2"))).where("fail.sequence > p.sequence")
    rows = rows.withColumn("pivot", _at("fail")).withColumn("other", F.col("fail.agent"))
    mine = checks.select("subject", "agent", F.col("sequence").alias("pivot"), _event().alias("k"))
    rows = w.beside(rows, mine, ["subject", "agent"], after={"k1": first(F.col("k"))}, order="pivot")
    rows = w.beside(rows, mine.withColumnRenamed("agent", "other"), ["subject", "other"], after={"k2": first(F.col("k"))}, order="pivot")
    by = _earlier(F.col("k1"), F.col("k2"))
    late = F.col("pivot") >= F.col("sequence")
    return _on_claim(
        rows, "J", at=F.greatest("pivot", "sequence"), at_id=F.when(late, _id("fail")).otherwise(F.col("event_id")), resolved=by, missing=_lacks(by, "check of ", F.col("subject"), " by either agent"),
        evidence=[(F.col("event_id"), "claim"), (_id("p"), "passing check by the claimant"), (_id("fail"), "failing check by another"), (by["event_id"], "later check")],
    )


def idle_session(w: World) -> DataFrame:
    """AM: the subject was checked before, but the announcing session checked nothing before the claim."""
    made = w.sessions.groupBy("task").agg(F.min("created").alias("created"))
    rows = _in_session(w, w.claims().where("task IS NOT NULL AND first_check IS NOT NULL")).where("session_checks = 0").join(made, "task")
    later = w.results.where("is_check").select("subject", "task", "sequence", _event().alias("k"))
    rows = w.beside(rows, later, ["subject", "task"], after={"by": first(F.col("k"))})
    return _on_claim(
        rows, "AM", resolved=F.col("by"), missing=_lacks(F.col("by"), "verification in session ", F.col("task")),
        evidence=[(_id("created"), "session"), (_id("first_check"), "check elsewhere"), (F.col("event_id"), "claim"), (_id("by"), "later check in the session")],
    )


def _cited(w: World, rows: DataFrame, named: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``name``, the first record of ``named`` (ref, value) that a row's evidence cites."""
    refs = rows.select("event_id", F.posexplode("evidence").alias("nth", "ref")).join(named, "ref")
    return rows.join(refs.groupBy("event_id").agg(F.min(F.struct("nth", "value"))["value"].alias(name)), "event_id", "left")


def stale_pass(w: World) -> DataFrame:
    """AO: a claim after a failure that only an older pass supports."""
    rows = w.claims().where("last_fail IS NOT NULL AND last_pass.sequence < last_fail.sequence")
    passes = w.results.where("is_check AND passed").select(F.col("event_id").alias("ref"), F.struct("sequence", "event_id", "subject").alias("value"))
    refs = rows.select("event_id", "subject", _at("last_fail").alias("limit"), F.explode("evidence").alias("ref")).join(passes, "ref")
    cited = refs.where("value.subject = subject AND value.sequence < limit").groupBy("event_id").agg(F.min("value").alias("cited"))
    rows = rows.join(cited, "event_id", "left")
    return _on_claim(
        rows, "AO", resolved=F.col("next_pass"), missing=_lacks(F.col("next_pass"), "passing check of ", F.col("subject")),
        evidence=[(F.coalesce(_id("cited"), _id("last_pass")), "stale pass"), (_id("last_fail"), "later failing check"), (F.col("event_id"), "claim"), (_id("next_pass"), "later pass")],
    )


def flaky(w: World) -> DataFrame:
    """AS: the outcome of a claimed subject flipped twice or more; one finding a subject, on its last uncorrected claim."""
    checks = w.carry(w.results.where("is_check").select("subject", "sequence", "event_id", "outcome"), ["subject"], {"p": last(_event("outcome"))})
    flips = checks.where("p.outcome <> outcome").select("subject", _event().alias("flip"), F.col("p").alias("from"))
    one = flips.groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("flip", "from")).alias("one")).where(F.col("n") >= FLIPS)
    two = flips.join(one, "subject").where("flip.sequence > one.flip.sequence").groupBy("subject").agg(F.min("flip").alias("two"))
    open_claims = w.own_claims.join(w.corrections.select(F.col("supersedes").alias("claim_id")).distinct(), "claim_id", "left_anti")
    said = open_claims.groupBy("subject").agg(F.max(_event("claim_id", "task", "agent")).alias("c"))
    rows = one.join(two, "subject").join(said, "subject")
    late = _at("c") > _at("two")
    return _finding(
        rows, "AS", F.col("subject"), subject="subject", claim=F.col("c.claim_id"), task=F.col("c.task"), agent=F.col("c.agent"), at=F.greatest(_at("c"), _at("two")), at_id=F.when(late, _id("c")).otherwise(_id("two")),
        evidence=[(_id("one.from"), "check before the first flip"), (_id("one.flip"), "first flip"), (_id("two"), "second flip"), (_id("c"), "claim")],
        attributes=F.array(F.concat(F.lit("flips: "), F.col("n").cast("string"))),
    )


def posted_failure(w: World) -> DataFrame:
    """D: another agent reported the failure in the claim's room, on a failing check of its own; or on one that cannot be seen."""
    quotes = w.visible.where(_kind("quote") & ~F.col("human") & F.col("subject").isNotNull()).select("subject", "place", "agent", "sequence", "event_id", "quotes_event")
    fails = w.results.where("is_check AND failed").select("subject", "agent", "sequence", _event().alias("k"))
    backed = w.beside(quotes, fails, ["subject", "agent"], {"fail": last(F.col("k"))}).where("fail IS NOT NULL")
    lost = w.status(quotes.where("quotes_event IS NOT NULL"), "quotes_event").where("ref_status IN ('withheld', 'missing')").drop("ref_status")
    rows = w.last_of_another(w.claims(), backed, ["subject", "place"], "q")
    rows = w.last_of_another(rows, lost, ["subject", "place"], "cited").where("q IS NOT NULL OR cited IS NOT NULL")
    blind = F.col("q").isNull()
    state = F.when(blind, "insufficient").when(F.col("next_pass").isNotNull(), "resolved").otherwise("active")
    missing = F.when(blind, F.array(F.concat(F.col("cited.quotes_event"), F.lit(" is not available")))).otherwise(_lacks(F.col("next_pass"), "passing check of ", F.col("subject")))
    return _on_claim(
        rows, "D", resolved=F.col("next_pass"), state=state, missing=missing,
        evidence=[(F.col("q.fail.event_id"), "the reporter's failing check"), (F.coalesce(_id("q"), _id("cited")), "failure posted in the room"), (F.col("event_id"), "claim"), (_id("next_pass"), "passing check")],
    )


def repeats(w: World) -> DataFrame:
    """F: a claim repeated twice or more with no check from first to last."""
    head = F.coalesce("repeat_of", "claim_id")
    chain = w.own_claims.select(head.alias("head"), F.struct("sequence", "event_id", "task", "subject", "agent", "claim_id").alias("c"))
    third = chain.withColumn("n", F.row_number().over(Window.partitionBy("head").orderBy("c"))).where(F.col("n") <= CHAIN).groupBy("head")
    third = third.agg(F.max(F.when(F.col("n") == CHAIN, F.col("c"))).alias("third"), F.min("c").alias("least"))
    ends = chain.groupBy("head").agg(F.count(F.lit(1)).alias("links"), F.max("c").alias("last"), F.min(F.when(F.col("c.claim_id") == F.col("head"), F.col("c"))).alias("named"))
    rows = ends.where(F.col("links") >= CHAIN).join(third, "head").withColumn("one", F.coalesce("named", "least"))
    facts = w.claims(gone=True).select(F.col("event_id").alias("first_id"), "next_check", "gone")
    rows = rows.withColumn("first_id", _id("one")).join(facts, "first_id", "left")
    by = F.when(F.col("next_check.sequence") < _at("last"), F.col("next_check"))
    blind = F.col("gone").isNotNull()
    state = F.when(blind, "insufficient").when(by.isNotNull(), "resolved").otherwise("active")
    return _finding(
        rows, "F", _id("one"), subject=F.col("one.subject"), claim=F.col("one.claim_id"), task=F.col("last.task"), agent=F.col("one.agent"), at=_at("third"), at_id=_id("third"), resolved=by, state=state,
        evidence=[(_id("one"), "first claim"), (_id("third"), "third claim"), (F.when(_at("last") > _at("third"), _id("last")), "last claim"), (F.element_at("gone", 1), "cited by the first claim"), (by["event_id"], "check inside the chain")],
        missing=F.when(blind, _unavailable()).otherwise(_lacks(by, "verification of ", F.col("one.subject"), " between first and last")), attributes=F.array(F.concat(F.lit("claims: "), F.col("links").cast("string"))),
    )


def _own(w: World, rows: DataFrame) -> DataFrame:
    """Rows (subject, agent, sequence) with the agent's own claims and checks of the subject."""
    did = w.own_claims.select("subject", "agent", "sequence", "event_id", "hedged", "type").unionByName(w.results.where("is_check").select("subject", "agent", "sequence", "event_id", "hedged", "type"))
    claim, check = _kind("claim"), _kind("tool_result")
    return w.beside(
        rows, did, ["subject", "agent"], {"own_checks": count(check), "own_check_before": last(F.when(check, _event()))},
        {"own_claim_after": first(F.when(claim, _event())), "firm_after": first(F.when(claim & ~F.coalesce("hedged", F.lit(False)), _event())), "own_check_after": first(F.when(check, _event()))},
    )


def open_hedge(w: World) -> DataFrame:
    """H: a hedged claim whose next check failed, and which its author never followed up."""
    rows = _own(w, w.claims(withdrawn=True).where("hedged AND next_check.outcome = 'fail'"))
    pair = F.when(F.col("firm_after").isNotNull() & F.col("next_pass").isNotNull(), F.greatest(F.struct(_at("firm_after").alias("sequence"), _id("firm_after").alias("event_id")), F.struct(_at("next_pass").alias("sequence"), _id("next_pass").alias("event_id"))))
    by = F.coalesce(F.when(F.col("withdrawn_later").isNotNull(), F.struct(_at("withdrawn_later").alias("sequence"), _id("withdrawn_later").alias("event_id"))), pair)
    rows = rows.withColumn("by", by).where("by IS NOT NULL OR (next_pass IS NULL AND own_claim_after IS NULL)")
    return _on_claim(
        rows, "H", at=_at("next_check"), at_id=_id("next_check"), resolved=F.col("by"), missing=_lacks(F.col("by"), "follow-up or correction by ", F.col("agent")),
        evidence=[(F.col("event_id"), "hedged claim"), (_id("next_check"), "later failing check"), (_id("by"), "correction or firm claim with a pass")],
    )


def masked_by_redirect(w: World) -> DataFrame:
    """AP: a live claim whose passing checks are all of the status and none ended at the page."""
    rows = w.claims().where("version = 'live' AND n_pass > 0 AND n_other_rule = 0 AND n_here = 0")
    state = F.when(F.col("next_here").isNotNull(), "resolved").when(F.col("last_uncaptured").isNotNull(), "insufficient").otherwise("active")
    text = F.when(F.col("last_uncaptured").isNotNull(), F.concat(F.lit("final URL of "), _id("last_uncaptured"))).otherwise(F.concat(F.lit("passing check that ends at "), "artifact"))
    return _on_claim(
        rows, "AP", resolved=F.col("next_here"), state=state, missing=F.when(F.col("next_here").isNull(), F.array(text)),
        evidence=[(F.coalesce(_id("last_masked"), _id("last_uncaptured")), "pass that ended elsewhere or unseen"), (F.col("event_id"), "claim"), (_id("next_here"), "pass ending at the page")],
    )


def local_as_live(w: World) -> DataFrame:
    """AQ: a public page claimed live, never passed before, in a session whose passes were all of local processes."""
    public = F.col("artifact").rlike("^https?://") & ~F.col("artifact").rlike(_LOCAL)
    rows = _in_session(w, w.claims().where((F.col("version") == "live") & public & F.col("task").isNotNull() & (F.col("n_pass") == 0)))
    return _on_claim(
        rows.where("session_passes > 0 AND session_far = 0"), "AQ", resolved=F.col("next_pass"), missing=_lacks(F.col("next_pass"), "passing check of ", F.col("subject")),
        evidence=[(_id("session_pass"), "local passing check"), (F.col("event_id"), "claim"), (_id("next_pass"), "public page passes")],
    )


def partial_as_full(w: World) -> DataFrame:
    """AR: tests claimed, on passing runs of which none was full."""
    rows = w.claims().where("artifact LIKE 'tests:%' AND n_tests > 0 AND n_whole = 0")
    state = F.when(F.col("next_whole").isNotNull(), "resolved").when(F.col("last_unscoped").isNotNull(), "insufficient").otherwise("active")
    text = F.when(F.col("last_unscoped").isNotNull(), F.concat(F.lit("scope of "), _id("last_unscoped"))).otherwise("full passing run")
    return _on_claim(
        rows, "AR", resolved=F.col("next_whole"), state=state, missing=F.when(F.col("next_whole").isNull(), F.array(text)),
        evidence=[(_id("last_tests"), "partial pass"), (F.col("event_id"), "claim"), (_id("next_whole"), "full pass")],
    )


def other_number(w: World) -> DataFrame:
    """AU: the stated number is not that of the cited record, or else of the latest one of the subject."""
    seen = lambda: F.when(F.col("number_kind") == "tests-passed", F.col("passed_seen")).otherwise(F.col("status_seen"))
    rows = w.claims().where("number_value IS NOT NULL")
    shown = w.visible.where(_kind("tool_result")).select(F.col("event_id").alias("ref"), "sequence", "passed_seen", "status_seen")
    refs = rows.select("event_id", "number_kind", F.posexplode("evidence").alias("nth", "ref")).join(shown, "ref").withColumn("n", seen()).where("n IS NOT NULL")
    cited = refs.groupBy("event_id").agg(F.min(F.struct("nth", F.struct("sequence", F.col("ref").alias("event_id"), "n").alias("v")))["v"].alias("cited"))
    latest = F.when(F.col("number_kind") == "tests-passed", F.col("last_passed_seen")).otherwise(F.col("last_status_seen"))
    rows = rows.join(cited, "event_id", "left").withColumn("basis", F.coalesce("cited", latest)).where("basis.n <> number_value")
    kinds = [w.results.select("subject", F.lit(k).alias("number_kind"), F.col(c).alias("number_value"), "sequence", _event().alias("k")).where("number_value IS NOT NULL") for k, c in (("tests-passed", "passed_seen"), ("http-status", "status_seen"))]
    rows = w.beside(rows, reduce(DataFrame.union, kinds), ["subject", "number_kind", "number_value"], after={"by": first(F.col("k"))})
    return _on_claim(
        rows, "AU", resolved=F.col("by"), missing=_lacks(F.col("by"), "record with ", F.col("number_value").cast("string")),
        evidence=[(_id("basis"), "record"), (F.col("event_id"), "claim"), (_id("by"), "record with the stated number")],
    )


def _endings(path: Column) -> Column:
    """A path and what follows each of its slashes."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def checked_before_edit(w: World) -> DataFrame:
    """AT: the pass that supports a claim on a repository or file is older than the session's last write to it."""
    rows = w.claims().where("support IS NOT NULL AND (artifact LIKE 'repo:%' OR artifact LIKE 'file:%')")
    turns = w.visible.where(_kind("action") & F.col("turn_id").isNotNull())
    # Which of the author's turns count: those of the claim's and of the check's session, or all if the claim has none.
    spots = F.array_distinct(F.when(F.col("task").isNull(), F.array(F.lit("*"))).otherwise(F.filter(F.array("task", "support.task"), lambda t: t.isNotNull())))
    probes = rows.select("event_id", "sequence", "agent", "artifact", F.explode(spots).alias("spot"))
    own = turns.withColumn("spot", F.explode(F.array_distinct(F.array(F.lit("*"), F.coalesce("task", F.lit("*"))))))
    any_turn = w.beside(probes, own.select("agent", "spot", "sequence"), ["agent", "spot"], {"n": count(F.lit(True))}).groupBy("event_id").agg(F.sum("n").alias("n_turns"))
    # A file is written under any ending of its path, or under a longer path of which its own is an ending.
    file = F.col("artifact").startswith("file:")
    path = F.substring("artifact", 6, 10_000)
    keys = F.when(file, F.concat(F.transform(_endings(path), lambda x: F.concat(F.lit("="), x)), F.array(F.concat(F.lit("<"), path), F.concat(F.lit("!"), "artifact")))).otherwise(F.array(F.lit("!repo:*"), F.concat(F.lit("!"), "artifact")))
    asked = probes.select("event_id", "sequence", "agent", "spot", F.explode(F.array_distinct(keys)).alias("key"))
    wrote = own.select("agent", "spot", "sequence", "event_id", F.explode("writes").alias("w"))
    long = F.substring("w", 6, 10_000)
    made = F.when(F.col("w").startswith("file:"), F.concat(F.array(F.concat(F.lit("="), long), F.concat(F.lit("!"), "w")), F.transform(_endings(long), lambda x: F.concat(F.lit("<"), x)))).otherwise(F.array(F.concat(F.lit("!"), "w")))
    wrote = wrote.select("agent", "spot", "sequence", _event().alias("k"), F.explode(F.array_distinct(made)).alias("key"))
    writes = w.beside(asked, wrote, ["agent", "spot", "key"], {"k": last(F.col("k"))}).groupBy("event_id").agg(F.max("k").alias("wrote"))
    rows = rows.join(any_turn, "event_id", "left").join(writes, "event_id", "left").where("coalesce(n_turns, 0) = 0 OR wrote.sequence >= support.sequence")
    good = w.results.where("passed").select("subject", F.col("sequence").alias("_w"), _event().alias("k"))
    rows = w.beside(rows.withColumn("_w", _at("wrote")), good, ["subject"], after={"by": first(F.col("k"))}, order="_w")
    rows = rows.withColumn("by", F.when(F.col("wrote").isNotNull(), F.col("by")))
    state = F.when(F.col("wrote").isNull(), "insufficient").when(F.col("by").isNotNull(), "resolved").otherwise("active")
    missing = F.when(F.col("wrote").isNull(), F.array(F.lit("the session's writes"))).otherwise(_lacks(F.col("by"), "passing check of ", F.col("subject"), " after the write"))
    return _on_claim(
        rows, "AT", resolved=F.col("by"), state=state, missing=missing,
        evidence=[(_id("support"), "check before the edit"), (_id("wrote"), "last write"), (F.col("event_id"), "claim"), (_id("by"), "check after the write")],
    )


def suppressed_errors(w: World) -> DataFrame:
    """BJ: every check before the claim suppressed errors; never active."""
    rows = w.claims().where("n_check > 0 AND n_loud = 0")
    return _on_claim(
        rows, "BJ", resolved=F.col("next_loud_pass"), state=F.when(F.col("next_loud_pass").isNotNull(), "resolved").otherwise("insufficient"), missing=_lacks(F.col("next_loud_pass"), "unsuppressed run"),
        evidence=[(_id("last_check"), "suppressed check"), (F.col("event_id"), "claim"), (_id("next_loud_pass"), "unsuppressed passing run")],
    )


def empty_evidence(w: World) -> DataFrame:
    """BK: the cited results, or else all before, printed nothing; never active."""
    shown = w.visible.where(_kind("tool_result")).select(F.col("event_id").alias("ref"), F.col("empty").alias("bare"), "sequence")
    refs = w.own_claims.select("event_id", F.posexplode("evidence").alias("nth", "ref")).join(shown, "ref")
    cited = refs.groupBy("event_id").agg(F.min("bare").alias("all_bare"), F.max(F.struct("nth", "ref"))["ref"].alias("cited"))
    rows = w.claims().join(cited, "event_id", "left").where(F.when(F.col("cited").isNotNull(), F.col("all_bare")).otherwise((F.col("n_result") > 0) & (F.col("n_full") == 0)))
    return _on_claim(
        rows, "BK", resolved=F.col("next_full"), state=F.when(F.col("next_full").isNotNull(), "resolved").otherwise("insufficient"), missing=_lacks(F.col("next_full"), "non-empty output"),
        evidence=[(F.coalesce("cited", _id("last_result")), "run without output"), (F.col("event_id"), "claim"), (_id("next_full"), "run with output")],
    )


def screenshot_only(w: World) -> DataFrame:
    """BM: the claim's session only looked at the page; always insufficient."""
    seen = w.visible.where(_kind("action") & F.col("task").isNotNull() & F.col("navigates").isNotNull()).select("task", F.col("navigates").alias("artifact"), "sequence", _event("turn_id").alias("nav"))
    rows = w.beside(w.own_claims.where("version = 'live' AND task IS NOT NULL"), seen, ["task", "artifact"], {"nav": last(F.col("nav")), "n_nav": count(F.lit(True))}).where("n_nav > 0")
    rows = w.beside(rows, w.results.select("task", "subject", "sequence"), ["task", "subject"], {"n_text": count(F.lit(True))}).where("n_text = 0")
    return _on_claim(
        rows, "BM", state=F.lit("insufficient"), missing=F.array(F.concat(F.lit("screenshot "), F.coalesce("nav.turn_id", "nav.event_id"))),
        evidence=[(_id("nav"), "browser navigation"), (F.col("event_id"), "claim")],
    )


# ---- corrections and their spread


def not_propagated(w: World) -> DataFrame:
    """E: a claim after another's correction or failure report of its subject, with no pass between."""
    fixes = w.corrections.where("subject IS NOT NULL").select("subject", "agent", "sequence", "event_id", F.lit("agent").alias("source"))
    quotes = w.visible.where(_kind("quote") & F.col("subject").isNotNull()).select("subject", "agent", "sequence", "event_id", F.when(F.col("human"), "human").otherwise("agent").alias("source"))
    rows = w.last_of_another(w.claims(withdrawn=True), fixes.union(quotes), ["subject"], "f").where("f IS NOT NULL AND coalesce(last_pass.sequence, -1) < f.sequence")
    acks = w.visible.where(_kind("acknowledgement")).select(F.col("acknowledges").alias("_f"), "agent", "sequence", _event().alias("k"))
    rows = w.beside(rows.withColumn("_f", _id("f")), acks, ["_f", "agent"], after={"ack": first(F.col("k"))})
    by = _earlier(F.col("ack"), F.col("own_withdrawn"), F.col("next_pass"))
    return _on_claim(
        rows, "E", resolved=by, missing=_lacks(by, "acknowledgement or correction by ", F.col("agent"), " or passing check"), attributes=F.array(F.concat(F.lit("source: "), F.col("f.source"))),
        evidence=[(_id("f"), "correction or failure report"), (F.col("event_id"), "claim"), (by["event_id"], "acknowledgement, correction or pass")],
    )


def reasserted(w: World) -> DataFrame:
    """O: an author corrects a claim and makes it again, with no pass between."""
    own = w.corrections.where("subject IS NOT NULL AND claim.agent = agent").select("subject", "agent", "sequence", _event().alias("fix"), F.col("claim.event_id").alias("claim_event"))
    said = w.claims().select("subject", "agent", "sequence", F.struct("sequence", "event_id", "claim_id", "task", "last_pass", "next_pass").alias("c"))
    rows = w.beside(own, said, ["subject", "agent"], after={"again": first(F.col("c"))}).where("again IS NOT NULL AND coalesce(again.last_pass.sequence, -1) < sequence")
    by = F.col("again.next_pass")
    return _finding(
        rows, "O", _id("again"), subject="subject", claim=F.col("again.claim_id"), task=F.col("again.task"), at=_at("again"), at_id=_id("again"), resolved=by, missing=_lacks(by, "passing check of ", F.col("subject")),
        evidence=[(F.col("claim_event"), "original claim"), (_id("fix"), "own correction"), (_id("again"), "claim made again"), (by["event_id"], "passing check")],
    )


def prompted_corrections(w: World) -> DataFrame:
    """AX: a correction after a human's report, with no own check between."""
    human = w.visible.where(_kind("quote") & F.col("human") & F.col("subject").isNotNull()).select("subject", "sequence", _event().alias("k"))
    rows = w.beside(w.corrections.where("subject IS NOT NULL"), human, ["subject"], {"report": last(F.col("k"))}).where("report IS NOT NULL")
    checks = w.results.where("is_check").select("subject", "agent", "sequence", _event().alias("k"))
    rows = w.beside(rows, checks, ["subject", "agent"], {"own": last(F.col("k"))}).where("coalesce(own.sequence, -1) < report.sequence")
    return _finding(
        rows, "AX", F.col("event_id"), subject="subject", claim="supersedes", task="task", attributes=F.array(F.lit("human-prompted")),
        evidence=[(_id("report"), "human failure report"), (F.col("event_id"), "correction")],
    )


def correction_delay(w: World) -> DataFrame:
    """AW: how many records lie between the first failure of a subject and a correction of a claim on it."""
    fails = w.results.where("is_check AND failed").groupBy("subject").agg(F.min(_event()).alias("fail"))
    rows = w.corrections.join(fails, "subject").where("fail.sequence < sequence")
    every = w.visible.select(F.lit(0).alias("_all"), "sequence")
    rows = w.beside(rows.withColumn("_all", F.lit(0)), every, ["_all"], {"n": count(F.lit(True))})
    upto = w.beside(fails.withColumn("_all", F.lit(0)).withColumn("_f", _at("fail")), every.withColumnRenamed("sequence", "_f"), ["_all"], {"m": count(F.lit(True))}, order="_f").select("subject", "m")
    rows = rows.join(upto, "subject").withColumn("between", F.col("n") - F.col("m") - 1)
    return _finding(
        rows, "AW", F.col("event_id"), subject="subject", claim="supersedes", task="task", attributes=F.array(F.concat(F.lit("records between: "), F.col("between").cast("string"))),
        evidence=[(_id("fail"), "first failing check"), (F.col("event_id"), "correction")],
    )


# ---- the group


def adopted_unchecked(w: World) -> DataFrame:
    """AE: a claim on, or an action citing, a subject that another claimed first, without an own check before."""
    said = w.own_claims.select("subject", "agent", "sequence", "event_id", "task", "claim_id")
    subject_of = w.visible.where(_kind("claim") & F.col("subject").isNotNull()).groupBy("claim_id").agg(F.max(F.struct("sequence", "subject"))["subject"].alias("subject"))
    cites = w.visible.where(_kind("action")).select("agent", "sequence", "event_id", "task", F.explode("references").alias("claim_id")).join(subject_of, "claim_id")
    cites = cites.select("subject", "agent", "sequence", "event_id", "task", F.lit(None).cast("string").alias("claim_id")).distinct()
    firsts = said.groupBy("subject", "agent").agg(F.min(F.struct("sequence", "event_id", "agent", "claim_id")).alias("c"))
    one = firsts.groupBy("subject").agg(F.min("c").alias("one"))
    two = firsts.join(one, "subject").where("agent <> one.agent").groupBy("subject").agg(F.min("c").alias("two"))
    rows = said.union(cites).join(one, "subject").join(two, "subject", "left")
    rows = rows.withColumn("prior", F.when(F.col("one.agent") != F.col("agent"), F.col("one")).otherwise(F.col("two"))).where("prior.sequence < sequence")
    rows = _own(w, rows).where("own_checks = 0")
    return _finding(
        rows, "AE", F.concat("event_id", F.lit(":"), "subject"), subject="subject", claim=F.coalesce("claim_id", "prior.claim_id"), task="task", resolved=F.col("own_check_after"),
        missing=_lacks(F.col("own_check_after"), "verification of ", F.col("subject"), " by ", F.col("agent")), evidence=[(_id("prior"), "original claim"), (F.col("event_id"), "adoption"), (_id("own_check_after"), "own check")],
    )


def checking_concentration(w: World) -> DataFrame:
    """AF: all checks of others' subjects were run by one agent."""
    claimants = w.own_claims.select("subject", F.col("agent").alias("claimant")).distinct()
    checks = w.results.where("is_check").groupBy("subject", "agent").agg(F.count(F.lit(1)).alias("n"), F.min(_event()).alias("one"), F.max(_event("task")).alias("end"))
    pairs = checks.join(claimants, "subject").where("claimant <> agent")
    others = pairs.groupBy("subject", "agent").agg(F.first("n").alias("n"), F.first("one").alias("one"), F.first("end").alias("end"))
    per = others.groupBy("agent").agg(F.sum("n").alias("n"), F.min("one").alias("one"), F.max("end").alias("end"))
    spread = pairs.groupBy("agent").agg(F.countDistinct("claimant").alias("claimants"))
    agents = per.agg(F.count(F.lit(1)).alias("agents"))  # one row
    rows = per.join(spread, "agent").crossJoin(F.broadcast(agents)).where((F.col("agents") == 1) & (F.col("n") >= CHECKS) & (F.col("claimants") >= CLAIMANTS))
    return _finding(rows, "AF", F.col("agent"), task=F.col("end.task"), at=_at("end"), at_id=_id("end"), evidence=[(_id("one"), "first check"), (_id("end"), "last check")], attributes=F.array(F.concat(F.lit("checks: "), F.col("n").cast("string"))))


def unchecked_consensus(w: World) -> DataFrame:
    """BP: so many agents claim a subject before anyone checks it."""
    firsts = w.own_claims.groupBy("subject", "agent").agg(F.min(F.struct("sequence", "event_id", "agent", "claim_id", "task")).alias("c"))
    place = F.row_number().over(Window.partitionBy("subject").orderBy("c"))
    third = firsts.withColumn("n", place).where(F.col("n") <= AGENTS).groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.max("c").alias("c"), F.min("c").alias("one")).where(F.col("n") == AGENTS)
    checks = w.results.where("is_check").groupBy("subject").agg(F.min(_event()).alias("k"))
    rows = third.join(checks, "subject", "left").where("k IS NULL OR k.sequence > c.sequence")
    return _finding(
        rows, "BP", F.col("subject"), subject="subject", claim=F.col("c.claim_id"), task=F.col("c.task"), agent=F.col("c.agent"), at=_at("c"), at_id=_id("c"), resolved=F.col("k"),
        missing=_lacks(F.col("k"), "verification of ", F.col("subject")), evidence=[(_id("one"), "first claim"), (_id("c"), "third agent's claim"), (_id("k"), "first check")],
    )


def directives(w: World) -> DataFrame:
    """AC: a directive that its addressee was not seen to take up; never active."""
    asked = w.visible.where(_kind("directive")).select("sequence", "event_id", "agent", "task", "tokens", F.explode(F.array_distinct("to")).alias("t"))
    goals = w.sessions.select(F.col("owner").alias("t"), _at("created").alias("sequence"), "created", F.explode(F.array_distinct(F.split("goal_key", " "))).alias("word"))
    words = w.beside(asked.select("event_id", "t", "sequence", F.explode(F.array_distinct("tokens")).alias("word")), goals, ["t", "word"], after={"s": first(F.col("created"))})
    rows = asked.join(words.groupBy("event_id", "t").agg(F.min("s").alias("s")), ["event_id", "t"], "left")
    acks = w.visible.where(_kind("acknowledgement")).groupBy(F.col("acknowledges").alias("event_id"), F.col("agent").alias("t")).agg(F.min(_event()).alias("ack"))
    by = _earlier(F.col("s"), F.col("ack"))
    rows = rows.join(acks.withColumnRenamed("event_id", "_e").withColumnRenamed("t", "_t"), (F.col("event_id") == F.col("_e")) & (F.col("t") == F.col("_t")), "left")
    return _finding(
        rows, "AC", F.concat("event_id", F.lit(":"), "t"), task="task", resolved=by, state=F.when(by.isNotNull(), "resolved").otherwise("insufficient"), missing=_lacks(by, "observed uptake by ", F.col("t")),
        evidence=[(F.col("event_id"), "directive"), (by["event_id"], "matching session or acknowledgement")],
    )


def conventions(w: World) -> DataFrame:
    """AD: a token first used by one agent and then by three others."""
    used = w.visible.where(_kind("message") & ~F.col("human")).select("agent", "task", "sequence", "event_id", F.explode("conventions").alias("token"))
    firsts = used.groupBy("token", "agent").agg(F.min(F.struct("sequence", "event_id", "agent", "task")).alias("u"))
    ranked = firsts.withColumn("n", F.row_number().over(Window.partitionBy("token").orderBy("u"))).where(F.col("n") <= USES + 1)
    rows = ranked.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("u")).alias("u")).where(F.col("n") > ADOPTERS)
    one, third = F.col("u")[0], F.col("u")[ADOPTERS]
    links = [(one["event_id"], "first use"), *[(F.get("u", F.lit(i))["event_id"], "later use") for i in range(1, USES + 1)]]
    return _finding(rows, "AD", F.col("token"), subject="token", task=one["task"], agent=one["agent"], at=third["sequence"], at_id=third["event_id"], evidence=links)


def opposite_assertions(w: World) -> DataFrame:
    """AG: a claim and another's failure report of its subject, the nearest one, with no check after both."""
    quotes = w.visible.where(_kind("quote") & F.col("subject").isNotNull()).select("subject", "agent", "sequence", "event_id")
    rows = w.last_of_another(w.own_claims, quotes, ["subject"], "q0")
    rows = w.last_of_another(rows, quotes, ["subject"], "q1", reverse=True).where("q0 IS NOT NULL OR q1 IS NOT NULL")
    nearer = F.col("q0").isNull() | ((F.col("q1.sequence") - F.col("sequence")) < (F.col("sequence") - F.col("q0.sequence")))
    rows = rows.withColumn("q", F.when(nearer & F.col("q1").isNotNull(), F.struct(_at("q1").alias("sequence"), _id("q1").alias("event_id"))).otherwise(F.struct(_at("q0").alias("sequence"), _id("q0").alias("event_id"))))
    rows = rows.withColumn("both", F.greatest("sequence", "q.sequence"))
    checks = w.results.where("is_check").select("subject", F.col("sequence").alias("both"), _event().alias("k"))
    rows = w.beside(rows, checks, ["subject"], after={"by": first(F.col("k"))}, order="both")
    return _on_claim(
        rows, "AG", at="both", at_id=F.when(F.col("both") == F.col("sequence"), F.col("event_id")).otherwise(_id("q")), resolved=F.col("by"), missing=_lacks(F.col("by"), "check of ", F.col("subject")),
        evidence=[(F.col("event_id"), "claim"), (_id("q"), "opposite assertion"), (_id("by"), "check after both")],
    )


def unanswered_mentions(w: World) -> DataFrame:
    """BN: a question to an agent that posts nothing in the room afterwards."""
    asked = w.visible.where((_kind("message") & ~F.col("human")) | _kind("directive")).select("sequence", "event_id", "agent", "task", "place", F.explode(F.array_distinct("question_to")).alias("t"))
    said = w.visible.where("is_chat").select(F.col("agent").alias("t"), "place", "sequence", _event().alias("k"))
    rows = w.beside(asked, said, ["t", "place"], after={"by": first(F.col("k"))})
    return _finding(rows, "BN", F.concat("event_id", F.lit(":"), "t"), task="task", resolved=F.col("by"), missing=_lacks(F.col("by"), "post by ", F.col("t")), evidence=[(F.col("event_id"), "question"), (_id("by"), "reply")])


# ---- what agents do


def step_repetition(w: World) -> DataFrame:
    """X: three or more consecutive turns of a session with one command and one output."""
    sign = F.when((F.col("action_kind") == "command") & F.col("command_hash").isNotNull(), F.struct("command_hash", "output_hash"))
    turns = w.turns.select("task", "agent", "sequence", "event_id", sign.alias("sign"))
    beat = w.carry(turns, ["task"], {"p": last(F.struct("sequence", "sign"))}, {"n": first(_event("sign"))})
    fresh = F.col("sign").isNull() | ~F.col("sign").eqNullSafe(F.col("p.sign"))
    marks = w.carry(beat.withColumn("_start", F.when(fresh, F.col("sequence"))), ["task"], {"_s": last(F.col("_start"))})
    runs = marks.where("sign IS NOT NULL").withColumn("start", F.coalesce("_start", "_s"))
    runs = w.carry(runs, ["task", "start"], {"place": count(F.lit(True))})
    rows = runs.groupBy("task", "start").agg(
        F.count(F.lit(1)).alias("n"), F.min(_event("agent")).alias("one"), F.max(F.when(F.col("place") == RUN - 1, _event())).alias("third"), F.max(F.struct("sequence", "event_id", "sign", "n")).alias("end")
    )
    after, sign = F.col("end.n"), F.col("end.sign")
    changed = F.when((after["sign"]["command_hash"] == sign["command_hash"]) & ~after["sign"]["output_hash"].eqNullSafe(sign["output_hash"]), F.struct(after["sequence"].alias("sequence"), after["event_id"].alias("event_id")))
    return _finding(
        rows.where(F.col("n") >= RUN), "X", _id("one"), task="task", agent=F.col("one.agent"), at=_at("third"), at_id=_id("third"), resolved=changed,
        evidence=[(_id("one"), "first repetition"), (_id("third"), "third repetition"), (F.when(_at("end") > _at("third"), _id("end")), "last repetition"), (changed["event_id"], "output changed")],
        attributes=F.array(F.concat(F.lit("turns: "), F.col("n").cast("string"))),
    )


def phantom_references(w: World) -> DataFrame:
    """Z: chat names a reference that no earlier chat, output or carried record holds; never active."""
    chat = w.visible.where("is_chat").select("sequence", "event_id", "agent", "task", F.explode(F.array_distinct("refs")).alias("ref"))
    shown = w.visible.where(_kind("tool_result", "action")).select("sequence", "event_id", F.explode(F.array_distinct("refs")).alias("ref"))
    rows = chat.select("ref", "sequence", "event_id", F.lit(False).alias("out")).union(shown.select("ref", "sequence", "event_id", F.lit(True)))
    if w.seen is not None:
        seen = w.seen if w.cursor is None else w.seen.where(F.col("sequence") <= w.cursor)
        rows = rows.union(seen.select("ref", "sequence", F.lit(None).cast("string"), F.lit(False)))
    found = w.beside(chat, rows, ["ref"], {"earlier": count(F.lit(True))}, {"by": first(F.when(F.col("out"), _event()))}).where("earlier = 0")
    return _finding(
        found, "Z", F.concat("event_id", F.lit(":"), "ref"), subject="ref", task="task", resolved=F.col("by"), state=F.when(F.col("by").isNotNull(), "resolved").otherwise("insufficient"),
        missing=_lacks(F.col("by"), F.col("ref")), evidence=[(F.col("event_id"), "message naming it"), (_id("by"), "output showing it")],
    )


def blamed_environment(w: World) -> DataFrame:
    """Y: after an own error the session's owner, next and within half an hour, blames the environment."""
    traces = w.verdicts.where("rule = 'traceback'").select("task", _event("ts").alias("t")).join(w.sessions.select("task", "owner"), "task")
    rows = w.next_chat(traces.withColumn("_t", _at("t")), "next", "_t")
    ms = lambda c: F.unix_millis(c.cast("timestamp"))
    near = ms(F.col("next.ts")) - ms(F.col("t.ts")) <= BLAME_MS
    same = F.col("next.task").isNull() | (F.col("next.task") == F.col("task"))
    rows = rows.where(near & same & (F.col("next.type") == "message") & F.coalesce("next.blame", F.lit(False)) & ~F.coalesce("next.own_error", F.lit(False))).withColumn("_n", _at("next"))
    owned = w.visible.where(_kind("message") & F.coalesce("own_error", F.lit(False))).select(F.col("agent").alias("owner"), F.col("sequence").alias("_n"), _event().alias("k"))
    rows = w.beside(rows, owned, ["owner"], after={"by": first(F.col("k"))}, order="_n")
    return _finding(
        rows, "Y", _id("t"), task="task", agent="owner", at=_at("next"), at_id=_id("next"), resolved=F.col("by"), missing=_lacks(F.col("by"), "later message naming the own error"),
        evidence=[(_id("t"), "own error"), (_id("next"), "blames the environment"), (_id("by"), "names the own error")],
    )


def destructive_retries(w: World) -> DataFrame:
    """BI: the same destructive command again in a session, with a failure between; the first of each session."""
    fails = w.verdicts.where("failed").select("task", "sequence", _event().alias("k"))
    acts = w.beside(w.turns.where("destructive IS NOT NULL").select("task", "destructive", "sequence", "event_id"), fails, ["task"], after={"fail": first(F.col("k"))})
    acts = w.carry(acts, ["task", "destructive"], {"p": last(F.struct("sequence", "event_id", "fail"))}).where("p.fail.sequence < sequence")
    one = acts.groupBy("task").agg(F.min(F.struct("sequence", "event_id", "p", "destructive")).alias("d")).join(w.sessions.select("task", "owner"), "task")
    return _finding(
        one, "BI", _id("d"), task="task", agent="owner", at=_at("d"), at_id=_id("d"),
        evidence=[(_id("d.p"), "first destructive command"), (F.col("d.p.fail.event_id"), "failing verdict"), (_id("d"), "repeated destructive command")], attributes=F.array(F.col("d.destructive")),
    )


def gaps(w: World) -> DataFrame:
    """(task, gap): the first step between a session's turns and results that goes back in time or lasts over two hours."""
    rows = w.visible.where(F.col("task").isNotNull() & (_kind("tool_result") | (_kind("action") & F.col("turn_id").isNotNull())))
    rows = rows.select("task", "agent", "sequence", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    steps = w.carry(rows, ["task"], {"p": last(_event("ms"))}).withColumn("d", F.col("ms") - F.col("p.ms"))
    bad = steps.where((F.col("d") < 0) | (F.col("d") > GAP_MS))
    return bad.groupBy("task").agg(F.min(F.struct("sequence", "event_id", "agent", F.col("p.event_id").alias("from_id"), F.when(F.col("d") < 0, "backwards").otherwise("jump").alias("kind"))).alias("gap"))


def timeline_gaps(w: World) -> DataFrame:
    """BL: a session whose record has a gap."""
    owners = w.sessions.groupBy("task").agg(F.max_by("owner", "created").alias("owner"))
    rows = w.gaps.join(owners, "task", "left")
    return _finding(
        rows, "BL", F.col("task"), task="task", agent=F.coalesce("owner", "gap.agent"), at=_at("gap"), at_id=_id("gap"),
        evidence=[(F.col("gap.from_id"), "last record before the gap"), (_id("gap"), "first record after the gap")], attributes=F.array(F.col("gap.kind")),
    )


# ---- sessions


def repeated_failure(w: World) -> DataFrame:
    """U: three sessions of one owner and goal that failed and never passed."""
    seen = w.verdicts.groupBy("task").agg(F.min(F.when(F.col("failed"), _event())).alias("fail"), F.min(F.when(F.col("passed"), _event())).alias("pass"))
    all_sessions = w.sessions.where("goal_key <> ''").join(seen, "task", "left")
    bad = all_sessions.where("fail IS NOT NULL AND pass IS NULL").select("owner", "goal_key", F.struct(_at("created").alias("sequence"), "task", "created", "fail").alias("s"))
    keys = ["owner", "goal_key"]
    third = bad.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("s"))).where(F.col("n") <= SESSIONS).groupBy(*keys).agg(F.max(F.when(F.col("n") == SESSIONS, F.col("s"))).alias("third"), F.min("s").alias("one"))
    rows = bad.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("s").alias("end")).where(F.col("n") >= SESSIONS).join(third, keys)
    good = all_sessions.where("pass IS NOT NULL").select(*keys, _at("created").alias("_s"), F.struct(_at("created").alias("sequence"), "pass").alias("g"))
    rows = w.beside(rows.withColumn("_s", _at("end")), good, keys, after={"g": first(F.col("g"))}, order="_s")
    return _finding(
        rows, "U", F.concat("owner", F.lit(":"), "goal_key"), subject="goal_key", task=F.col("third.task"), agent="owner", at=F.greatest(_at("third"), F.col("third.fail.sequence")), at_id=F.col("third.fail.event_id"), resolved=F.col("g.pass"),
        evidence=[(F.col("one.created.event_id"), "first session"), (F.col("one.fail.event_id"), "its failure"), (F.col("third.created.event_id"), "third session"), (F.col("third.fail.event_id"), "its failure"), (F.col("g.pass.event_id"), "later session passes")],
        attributes=F.array(F.concat(F.lit("sessions: "), F.col("n").cast("string"))),
    )


def duplicate_goals(w: World, width: int = 4096, gapped: bool = False) -> DataFrame:
    """V: sessions of different owners with one goal that overlap in the order of record.  If ``gapped``, each comes with the ``gap`` of
    its later session, so that no pair has to be dealt by session for it.

    Sessions are dealt to buckets of ``width`` records, or of a 64th of all if that is more: one that does not end meets a bounded
    number of them.
    """
    ends = w.visible.agg(F.min("sequence").alias("lo"), F.max("sequence").alias("hi")).first()
    width = max(width, ((ends["hi"] or 0) - (ends["lo"] or 0)) // 64 + 1)
    rows = w.sessions.where("goal_key <> ''")
    rows = rows.select("goal_key", "task", "owner", "created", "ended", _at("created").alias("lo"), F.greatest(_at("created"), F.coalesce(_at("ended"), F.lit(ends["hi"]))).alias("hi"))
    later = rows.select("goal_key", F.col("task").alias("task_b"), F.col("owner").alias("owner_b"), F.col("created").alias("created_b"), F.col("ended").alias("ended_b"), F.col("lo").alias("lo_b"))
    if gapped:
        later = later.join(w.gaps.withColumnRenamed("task", "task_b"), "task_b", "left")
    pairs = overlap_pairs(rows, later, ["goal_key"], "lo", "hi", "lo_b", width)
    pairs = pairs.where("owner <> owner_b AND (lo < lo_b OR (lo = lo_b AND task < task_b))")
    return _finding(
        pairs, "V", F.concat("task", F.lit(":"), "task_b"), subject="goal_key", task="task_b", agent="owner_b", at="lo_b", at_id=_id("created_b"),
        evidence=[(_id("created"), "session"), (_id("created_b"), "session"), (_id("ended"), "session end"), (_id("ended_b"), "session end")], more=("gap",) if gapped else (),
    )


def unverified_goal(w: World) -> DataFrame:
    """BC: an ended session that set out to verify, made a claim and verified nothing."""
    ended = w.sessions.where("verify_goal AND ended IS NOT NULL")
    checked = w.visible.where("is_check AND task IS NOT NULL").select("task").distinct()
    said = w.visible.where(_kind("claim") & F.col("task").isNotNull()).groupBy("task").agg(F.min(_event()).alias("c"))
    rows = ended.join(checked, "task", "left_anti").join(said, "task").where("c.sequence <= ended.sequence")
    return _finding(
        rows, "BC", F.col("task"), task="task", agent="owner", at=_at("ended"), at_id=_id("ended"), missing=F.array(F.concat(F.lit("verification verdict in session "), "task")),
        evidence=[(_id("created"), "session"), (_id("c"), "claim made in it"), (_id("ended"), "session end")],
    )


def ended_on_failure(w: World) -> DataFrame:
    """BD: a session whose last verdict failed and that ended without another turn."""
    ended = w.sessions.where("ended IS NOT NULL").withColumn("sequence", _at("ended"))
    rows = w.beside(ended, w.verdicts.select("task", "sequence", _event("outcome").alias("k")), ["task"], {"v": last(F.col("k"))}).where("v.outcome = 'fail'")
    rows = w.beside(rows, w.turns.select("task", "sequence", _event().alias("k")), ["task"], {"t": last(F.col("k"))}).where("coalesce(t.sequence, -1) <= v.sequence")
    return _finding(
        rows, "BD", F.col("task"), task="task", agent="owner", at=_at("ended"), at_id=_id("ended"), evidence=[(_id("v"), "last verdict"), (_id("ended"), "session end")],
        attributes=F.array(F.concat(F.lit("ended by: "), F.coalesce("ended.reason", F.lit("session end")))),
    )


def clean_summary(w: World) -> DataFrame:
    """W: after a session's last failure, with no pass since, its owner's next word names no failure."""
    seen = w.verdicts.groupBy("task").agg(F.max(F.when(F.col("failed"), _event())).alias("fail"), F.max(F.when(F.col("passed"), _event())).alias("pass"))
    rows = w.sessions.join(seen.where("fail IS NOT NULL AND coalesce(pass.sequence, -1) < fail.sequence"), "task").withColumn("_f", _at("fail"))
    rows = w.next_chat(rows, "next", "_f").where("NOT next.negative_chat").withColumn("_n", _at("next"))
    named = w.visible.where("negative_chat").select(F.col("agent").alias("owner"), F.col("sequence").alias("_n"), _event().alias("k"))
    rows = w.beside(rows, named, ["owner"], after={"by": first(F.col("k"))}, order="_n")
    return _finding(
        rows, "W", F.col("task"), task="task", agent="owner", at=_at("next"), at_id=_id("next"), resolved=F.col("by"), missing=_lacks(F.col("by"), "later message naming the failure, or pass"),
        evidence=[(_id("created"), "session"), (_id("fail"), "failing verdict"), (_id("next"), "next message"), (_id("by"), "failure named")],
    )


# ---- people


def unanswered_questions(w: World) -> DataFrame:
    """AH: a human's question that no agent follows in the room."""
    asked = w.visible.where(_kind("message", "quote") & F.col("human") & F.coalesce("is_question", F.lit(False))).select("sequence", "event_id", "agent", "task", "place")
    said = w.visible.where("is_chat").select("place", "sequence", _event().alias("k"))
    rows = w.beside(asked, said, ["place"], after={"by": first(F.col("k"))})
    return _finding(rows, "AH", F.col("event_id"), task="task", resolved=F.col("by"), missing=_lacks(F.col("by"), "agent message in the room"), evidence=[(F.col("event_id"), "human question"), (_id("by"), "first agent reply")])


def repeated_human_corrections(w: World) -> DataFrame:
    """AI: two human reports of a subject, one after the other, with a claim between; the first such pair of a subject."""
    said = w.own_claims.select("subject", "sequence", _event("agent", "claim_id", "task").alias("c"))
    reports = w.beside(w.visible.where(_kind("quote") & F.col("human") & F.col("subject").isNotNull()).select("subject", "sequence", "event_id"), said, ["subject"], after={"next": first(F.col("c"))})
    pairs = w.carry(reports, ["subject"], {"p": last(F.struct("sequence", "event_id", F.col("next").alias("between")))}).where("p.between.sequence < sequence")
    one = pairs.groupBy("subject").agg(F.min(F.struct("sequence", "event_id", "p", F.col("next").alias("again"))).alias("h"))
    told = F.when(F.col("h.again").isNotNull(), "claimed again after the second correction").otherwise("no further claim after the second correction")
    between = F.col("h.p.between")
    return _finding(
        one, "AI", _id("h"), subject="subject", claim=between["claim_id"], task=between["task"], agent=between["agent"], at=_at("h"), at_id=_id("h"), attributes=F.array(told),
        evidence=[(_id("h.p"), "first human report"), (between["event_id"], "claim between"), (_id("h"), "second human report"), (_id("h.again"), "claimed again")],
    )


def unanswered_corrections(w: World) -> DataFrame:
    """BR: a human's failure report whose subject no agent names in the room afterwards."""
    rows = w.visible.where(_kind("quote") & F.col("human") & F.col("subject").isNotNull()).select("sequence", "event_id", "agent", "task", "place", "subject")
    chat = w.visible.where(F.col("is_chat") | _kind("claim"))
    named = chat.where(_kind("claim", "quote")).select("subject", "place", "sequence", "event_id")
    fixed = w.corrections.where("is_chat").select("subject", "place", "sequence", "event_id")
    spoken = chat.where(_kind("message")).select(F.explode("names").alias("name"), "place", "sequence", "event_id")
    spoken = spoken.select(F.concat("name", F.lit("@live")).alias("subject"), "place", "sequence", "event_id")
    all_names = named.union(fixed).union(spoken).select("subject", "place", "sequence", _event().alias("k"))
    rows = w.beside(rows, all_names, ["subject", "place"], after={"by": first(F.col("k"))})
    return _finding(rows, "BR", F.col("event_id"), subject="subject", task="task", resolved=F.col("by"), missing=_lacks(F.col("by"), "agent message naming ", F.col("subject")), evidence=[(F.col("event_id"), "human failure report"), (_id("by"), "agent names the subject")])


@dataclass(frozen=True)
class Monitor:
    """``needs`` is what a source must hold for the monitor to apply, ``reads`` what else it looks at."""

    title: str
    family: str
    run: Callable[[World], DataFrame]
    needs: tuple[str, ...]
    reads: tuple[str, ...] = ()

    @property
    def types(self) -> tuple[str, ...]:
        """The types of record that can change its findings."""
        more = {"subject": ("claim", "tool_result"), "dependency": ("task_created", "dependency_created")}
        return tuple(sorted({t for n in (*self.needs, *self.reads) for t in more.get(n, (n,))}))


#: In the order of the registry, which is also that of ties.
MONITORS = {
    "A": Monitor("Unsupported completion", "claim-evidence", unsupported_completion, ("claim", "tool_result", "subject")),
    "B": Monitor("Superseded claim reused", "propagation", superseded_reuse, ("action", "correction")),
    "C": Monitor("Claim never checked", "claim-evidence", never_checked, ("claim", "subject"), ("tool_result",)),
    "G": Monitor("Stale after failure", "claim-evidence", stale_after_failure, ("claim", "tool_result", "subject")),
    "J": Monitor("Split evidence", "claim-evidence", split_evidence, ("claim", "tool_result", "subject")),
    "AM": Monitor("Announced from a session that checked nothing", "claim-evidence", idle_session, ("claim", "tool_result", "task_created")),
    "AO": Monitor("Cited a stale pass", "claim-evidence", stale_pass, ("claim", "tool_result", "subject")),
    "AS": Monitor("Flaky evidence asserted as settled", "claim-evidence", flaky, ("claim", "tool_result", "subject")),
    "D": Monitor("Posted failure, then claim", "claim-evidence", posted_failure, ("claim", "quote", "tool_result", "subject")),
    "F": Monitor("Repeat without recheck", "claim-evidence", repeats, ("claim", "subject"), ("tool_result",)),
    "H": Monitor("Hedge never closed", "claim-evidence", open_hedge, ("claim", "tool_result", "subject"), ("correction",)),
    "AP": Monitor("Redirect-masked check", "claim-evidence", masked_by_redirect, ("claim", "tool_result", "subject")),
    "AQ": Monitor("Localhost as live", "claim-evidence", local_as_live, ("claim", "tool_result", "subject")),
    "AR": Monitor("Partial test run as full pass", "claim-evidence", partial_as_full, ("claim", "tool_result", "subject")),
    "AU": Monitor("Number in claim differs from record", "claim-evidence", other_number, ("claim", "tool_result", "subject")),
    "AT": Monitor("Verified before the edit", "claim-evidence", checked_before_edit, ("claim", "tool_result", "action", "subject")),
    "BJ": Monitor("Error-suppressed check", "claim-evidence", suppressed_errors, ("claim", "tool_result", "subject")),
    "BK": Monitor("Empty-output evidence", "claim-evidence", empty_evidence, ("claim", "tool_result", "subject")),
    "BM": Monitor("Screenshot-only claim", "claim-evidence", screenshot_only, ("claim", "action", "subject"), ("tool_result",)),
    "E": Monitor("Correction not propagated", "propagation", not_propagated, ("claim", "subject"), ("correction", "quote", "acknowledgement", "tool_result")),
    "O": Monitor("Retracted then re-asserted", "propagation", reasserted, ("claim", "correction", "subject"), ("tool_result",)),
    "AX": Monitor("Human-prompted correction", "propagation", prompted_corrections, ("correction", "quote"), ("claim", "tool_result")),
    "AW": Monitor("Correction delay strip", "propagation", correction_delay, ("correction", "tool_result"), ("claim",)),
    "AE": Monitor("Adopted without own check", "swarm", adopted_unchecked, ("claim", "subject"), ("action",)),
    "AF": Monitor("Checking concentration", "swarm", checking_concentration, ("claim", "tool_result", "subject")),
    "BP": Monitor("Consensus without any check", "swarm", unchecked_consensus, ("claim", "subject")),
    "AC": Monitor("Directive without observed uptake", "swarm", directives, ("directive",), ("task_created", "acknowledgement")),
    "AD": Monitor("Convention adoption", "swarm", conventions, ("message",)),
    "AG": Monitor("Opposite assertions, no check", "swarm", opposite_assertions, ("claim", "quote", "subject"), ("tool_result",)),
    "BN": Monitor("Agent mention without reply", "swarm", unanswered_mentions, ("message",), ("directive", "claim", "quote", "correction")),
    "X": Monitor("Step repetition", "process", step_repetition, ("action",)),
    "Z": Monitor("Phantom reference", "process", phantom_references, ("message",), ("claim", "correction", "tool_result", "action")),
    "Y": Monitor("Own error, external blame", "process", blamed_environment, ("tool_result", "message"), ("task_created",)),
    "BI": Monitor("Destructive retry", "process", destructive_retries, ("action", "tool_result"), ("task_created",)),
    "BL": Monitor("Timeline gap", "process", timeline_gaps, ("action",), ("tool_result",)),
    "U": Monitor("Repeated goal, repeated failure", "session", repeated_failure, ("task_created", "tool_result"), ("status_updated",)),
    "V": Monitor("Concurrent duplicate goal", "session", duplicate_goals, ("task_created",), ("status_updated",)),
    "BC": Monitor("Verify-goal, no verification", "session", unverified_goal, ("task_created",), ("tool_result", "claim", "status_updated")),
    "BD": Monitor("Ended on failure", "session", ended_on_failure, ("task_created", "tool_result"), ("status_updated", "action")),
    "W": Monitor("Clean summary after failure", "session", clean_summary, ("task_created", "tool_result", "message"), ("claim", "quote", "correction", "directive")),
    "AH": Monitor("Human question unanswered", "human", unanswered_questions, ("message",), ("claim", "correction", "quote", "directive")),
    "AI": Monitor("Repeated human correction", "human", repeated_human_corrections, ("quote", "claim")),
    "BR": Monitor("Human correction unanswered", "human", unanswered_corrections, ("quote",), ("message", "claim", "correction", "directive")),
}


def needs_met(log: DataFrame) -> DataFrame:
    """(monitor, unmet): what each monitor needs and the whole source lacks; for show, it gates nothing."""
    depends = _kind("dependency_created") | F.exists(F.coalesce("tasks", F.array()), lambda t: F.size(t["depends_on"]) > 0)
    about = _kind("claim", "tool_result") & F.col("artifact").isNotNull()
    held = log.agg(F.collect_set("type").alias("types"), F.max(about).alias("subject"), F.max(F.coalesce(depends, F.lit(False))).alias("dependency"))
    more = [F.when(F.col(c), F.array(F.lit(c))).otherwise(F.array().cast("array<string>")) for c in ("subject", "dependency")]
    held = held.select(F.concat("types", *more).alias("has"))
    rows = F.array(*[F.struct(F.lit(m).alias("monitor"), F.array(*map(F.lit, d.needs)).alias("needs")) for m, d in MONITORS.items()])
    return held.select("has", F.inline(rows)).select("monitor", F.array_except("needs", "has").alias("unmet"))


def _withheld_inside(found: DataFrame, w: World) -> DataFrame:
    """A withheld record of a type that the monitor reads, placed inside a finding's span, makes it insufficient."""
    hidden = w.log.where(F.col("event_id").isin(*w.withheld)) if w.cursor is None else w.log.where(F.col("event_id").isin(*w.withheld) & (F.col("sequence") <= w.cursor))
    hidden = hidden.agg(F.array_sort(F.collect_list(F.struct("sequence", "event_id", "type"))).alias("hidden"))  # as few as were named
    spots = w.visible.select(F.col("event_id").alias("ref"), F.col("sequence").alias("at"))
    spans = found.select("finding_id", F.explode("evidence.event_id").alias("ref")).join(spots, "ref").groupBy("finding_id").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    reads = F.create_map(*[x for m, d in MONITORS.items() for x in (F.lit(m), F.array(*map(F.lit, d.types)))])
    rows = found.join(spans, "finding_id", "left").crossJoin(F.broadcast(hidden))
    inside = F.filter("hidden", lambda h: (h["sequence"] >= F.col("lo")) & (h["sequence"] <= F.greatest("hi", "detected_at")) & F.array_contains(reads[F.col("monitor")], h["type"]) & ~F.array_contains(F.col("evidence.event_id"), h["event_id"]))
    rows = rows.withColumn("inside", inside)
    return _degraded(
        rows, F.coalesce(F.size("inside") > 0, F.lit(False)),
        F.transform("inside", lambda h: F.struct(h["event_id"].alias("event_id"), F.lit("withheld record inside the span").alias("role"))),
        F.transform("inside", lambda h: F.concat(h["event_id"], F.lit(" is withheld inside the span"))),
    )


def _degraded(rows: DataFrame, when: Column, links: Column, texts: Column) -> DataFrame:
    """``rows`` with their columns of FINDING, insufficient ``when`` so."""
    told = {
        "state": lambda: F.when(when, "insufficient").otherwise(F.col("state")), "resolved_at": lambda: F.when(~when, F.col("resolved_at")), "resolved_id": lambda: F.when(~when, F.col("resolved_id")),
        "evidence": lambda: F.when(when, F.concat("evidence", links)).otherwise(F.col("evidence")), "missing": lambda: F.when(when, F.concat("missing", texts)).otherwise(F.col("missing")),
    }
    return rows.select(*[told[c]().alias(c) if c in told else c for c in FINDING if c in rows.columns])


def _gap_inside(rows: DataFrame) -> DataFrame:
    """Findings of a session whose record has a ``gap`` are insufficient; the gap itself is not."""
    hit = F.col("gap").isNotNull() & (F.col("monitor") != "BL")
    links = F.array(F.struct(F.col("gap.from_id").alias("event_id"), F.lit("last record before a gap").alias("role")), F.struct(_id("gap").alias("event_id"), F.lit("first record after the gap").alias("role")))
    return _degraded(rows, hit, links, F.array(F.concat(F.lit("continuous record of session "), "task")))


def run(w: World, only: tuple[str, ...] | None = None, passes: bool = True, columns: tuple[str, ...] = FINDING) -> DataFrame:
    """The findings of all monitors, or of ``only`` some, after the passes over them all.  Of FINDING only ``columns`` are worked out, unless
    records are withheld, which are looked for in the evidence."""
    chosen = [m for m in MONITORS if only is None or m in only]
    kept = FINDING if passes and w.withheld else tuple(c for c in FINDING if c in columns)
    # Pairs of sessions may be many times all else: they are neither staged nor dealt by session, and learn of gaps before they are paired.
    pairs = passes and not w.withheld and "V" in chosen
    staged = [m for m in chosen if not (pairs and m == "V")]

    # Where frames are staged, each monitor's findings are too: adaptive execution then plans one monitor at a time.  Most are many small
    # jobs, so some monitors run side by side, once the frames that they share are there.
    def one(m: str) -> DataFrame:
        with scratch("carried"):
            return w.stage(MONITORS[m].run(w).select(*kept), f"findings-{m}")

    if w.stages and len(chosen) > 1:
        with scratch("carried"):
            _ = w.block, w.visible, w.results, w.by_subject, w.sessions, w.gaps
        with ThreadPool(SIDE_BY_SIDE) as pool:
            found = pool.map(lambda m: inheritable_thread_target(one)(m), staged, chunksize=1)
    else:
        found = [one(m) for m in staged]
    out = reduce(DataFrame.unionByName, found) if found else None
    if passes and w.withheld:
        out = _withheld_inside(out, w)
    if passes and found:
        out = _gap_inside(out.join(w.gaps, "task", "left"))
    if pairs:
        rows = _gap_inside(duplicate_goals(w, gapped=True).select(*dict.fromkeys([*kept, "task", "monitor", "gap"])))
        out = out.unionByName(rows) if found else rows
    return out.select(*[c for c in FINDING if c in columns])


def findings(log: DataFrame, cursor: int | None = None, withheld: tuple[str, ...] = (), seen: DataFrame | None = None, only: tuple[str, ...] | None = None, stage: Callable | None = None, columns: tuple[str, ...] = FINDING) -> DataFrame:
    """All findings as of the cursor."""
    return run(World(log, cursor, withheld, seen, **({"stage": stage} if stage else {})), only, columns=columns)


def ordered(found: DataFrame) -> DataFrame:
    """The latest first, then in the order of the registry."""
    place = F.array_position(F.array(*[F.lit(m) for m in MONITORS]), F.col("monitor"))
    return found.orderBy(F.desc("detected_at"), place, "finding_id")
