"""Queries: world state, lineage, flow, incidents and counts over the typed log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import monitors, worldstate
from tracewell.operators.monitors import World
from tracewell.plans import store
from tracewell.plans.q_monitors import SQL as MONITOR_SQL
from tracewell.plans.q_monitors import VIEWS
from tracewell.plans.store import with_prelude
from tracewell.plans.typed import TYPED, typed_log
from tracewell.registry import query

_CLAIMS = """
standings AS (SELECT c.*, CASE WHEN claim_id IN (SELECT supersedes FROM v WHERE type = 'correction' AND supersedes IS NOT NULL) THEN 'superseded'
  WHEN asserts IN ('verification_passed', 'complete') AND EXISTS (SELECT 1 FROM results r WHERE r.subject = c.subject AND r.category = 'verification' AND r.outcome = 'pass') THEN 'supported'
  WHEN asserts IN ('verification_passed', 'complete') AND EXISTS (SELECT 1 FROM results r WHERE r.subject = c.subject AND r.category = 'verification' AND r.outcome = 'fail') THEN 'contradicted' ELSE 'unknown' END AS standing
  FROM v c WHERE type = 'claim')"""
_TASKS = """
told AS (SELECT x.*, CASE WHEN type = 'status_updated' THEN status ELSE status_after END AS step FROM v x JOIN sessions s ON s.session = x.task AND x.sequence > s.created),
states AS (SELECT session, owner, coalesce((SELECT arg_max(step, sequence) FROM told x WHERE x.task = s.session AND step IS NOT NULL), 'todo') AS status,
  (SELECT max(sequence) FROM told x WHERE x.task = s.session AND step IS NOT NULL) AS basis, 1 + (SELECT count(*) FROM told x WHERE x.task = s.session) AS records FROM sessions s)"""
_TOLD = "words AS (SELECT subject, sequence, agent, event_id, 'correction' AS word FROM fixes WHERE subject IS NOT NULL UNION ALL SELECT subject, sequence, agent, event_id, 'report' FROM v WHERE type = 'quote' AND subject IS NOT NULL)"
_HEADS = "heads AS (SELECT subject, min(sequence) AS head, arg_min(agent, sequence) AS announcer, arg_min(event_id, sequence) AS head_id FROM claims GROUP BY 1)"


def _sql(body: str, *views: str) -> str:
    return with_prelude(f"WITH {', '.join([TYPED, VIEWS, *views])}\n{body}")


def _world(spark: SparkSession, sf_dir: str) -> World:
    return World(typed_log(spark, sf_dir))


@query(_sql("SELECT claim_id, subject, standing FROM standings", _CLAIMS))
def world_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worldstate.claims(_world(spark, sf_dir)).select("claim_id", "subject", "standing")


@query(_sql("SELECT session AS task, owner, status, basis, records FROM states", _TASKS))
def world_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worldstate.tasks(_world(spark, sf_dir)).select("task", "owner", "status", F.col("basis.sequence").alias("basis"), "records")


@query(_sql("""
SELECT task, status, evidence_status, CASE WHEN evidence_status = 'contradicted' THEN 'conflict' WHEN evidence_status = 'unknown' AND status <> 'todo' THEN 'insufficient' ELSE 'agree' END AS difference FROM (
SELECT s.session AS task, s.status, CASE
  WHEN b.type IS NULL THEN 'unknown' WHEN b.type IN ('tool_result', 'acknowledgement') THEN 'supported'
  WHEN b.type = 'claim' THEN (SELECT CASE c.standing WHEN 'supported' THEN 'supported' WHEN 'unknown' THEN 'unknown' ELSE 'contradicted' END FROM standings c WHERE c.claim_id = b.claim_id)
  WHEN b.type = 'action' THEN CASE WHEN EXISTS (SELECT 1 FROM standings c WHERE list_contains(b.refs_claims, c.claim_id) AND c.standing IN ('superseded', 'contradicted')) THEN 'contradicted'
    WHEN EXISTS (SELECT 1 FROM standings c WHERE list_contains(b.refs_claims, c.claim_id)) AND NOT EXISTS (SELECT 1 FROM standings c WHERE list_contains(b.refs_claims, c.claim_id) AND c.standing <> 'supported') THEN 'supported' ELSE 'unknown' END
  WHEN b.type = 'correction' THEN CASE WHEN EXISTS (SELECT 1 FROM v x WHERE x.type = 'tool_result' AND x.outcome = 'fail' AND list_contains(b.evidence, x.event_id)) THEN 'supported' ELSE 'unknown' END
  ELSE CASE WHEN EXISTS (SELECT 1 FROM used u WHERE u.task = s.session AND u.agent = s.owner AND u.standing = 'contradicted') THEN 'contradicted'
    WHEN EXISTS (SELECT 1 FROM used u WHERE u.task = s.session AND u.agent = s.owner AND u.standing = 'unknown') THEN 'unknown' ELSE 'supported' END END AS evidence_status
FROM states s LEFT JOIN v b ON b.sequence = s.basis)""", _CLAIMS, _TASKS, """
used AS (SELECT x.task, c.agent, c.standing FROM v x JOIN standings c ON c.sequence = x.sequence WHERE x.task IS NOT NULL UNION ALL
  SELECT x.task, c.agent, c.standing FROM (SELECT task, unnest(refs_claims) AS r FROM v WHERE type = 'action' AND task IS NOT NULL) x JOIN standings c ON c.claim_id = x.r)"""))
def world_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = worldstate.evidence(_world(spark, sf_dir))
    return rows.select("task", "status", "evidence_status", worldstate.difference().alias("difference"))


@query(_sql("""
SELECT claim_id, task, 'refers' AS how, n FROM direct UNION ALL
SELECT DISTINCT d.claim_id, r.node, 'downstream', 0 FROM direct d JOIN r ON r.root = d.task WHERE NOT EXISTS (SELECT 1 FROM direct x WHERE x.claim_id = d.claim_id AND x.task = r.node)""", """
direct AS (SELECT claim_id, task, count(*) AS n FROM (SELECT claim_id, task, event_id FROM v WHERE type = 'claim' AND task IS NOT NULL UNION ALL SELECT DISTINCT unnest(refs_claims), task, event_id FROM v WHERE type = 'action' AND task IS NOT NULL) GROUP BY 1, 2),
edges AS (SELECT DISTINCT unnest(made_after) AS src, made_task AS dst FROM v WHERE type = 'task_created')""", """
r AS (SELECT root, node FROM (WITH RECURSIVE q(root, node) AS (SELECT src, dst FROM edges UNION SELECT q.root, e.dst FROM q JOIN edges e ON e.src = q.node) SELECT * FROM q) WHERE root <> node)"""))
def world_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worldstate.claim_impact(_world(spark, sf_dir))


@query(_sql("""
SELECT x.event_id AS correction, p.agent, list_contains(x.addressed_to, p.agent) AS addressed, (SELECT arg_min(event_id, sequence) FROM v k WHERE k.type = 'acknowledgement' AND k.acknowledges = x.event_id AND k.agent = p.agent) AS ack_id
FROM v x JOIN (SELECT DISTINCT agent FROM v WHERE agent <> 'humans') p ON p.agent <> x.agent WHERE x.type = 'correction'"""))
def world_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = typed_log(spark, sf_dir)
    return worldstate.correction_audience(World(log), log.where("agent <> 'humans'").select("agent").distinct())


@query(_sql("""
SELECT x.event_id AS correction, a.event_id, a.agent, EXISTS (SELECT 1 FROM v k WHERE k.type = 'acknowledgement' AND k.acknowledges = x.event_id AND k.agent = a.agent AND k.sequence < a.sequence) AS acked_before
FROM v x JOIN v a ON a.type = 'action' AND list_contains(a.refs_claims, x.supersedes) AND a.sequence > x.sequence WHERE x.type = 'correction'"""))
def world_stale_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worldstate.stale_actions(_world(spark, sf_dir))


@query(_sql("""
SELECT c.claim_id, 'evidence' AS step, x.event_id, x.sequence FROM c JOIN v x ON x.type = 'tool_result' AND list_contains(c.evidence, x.event_id) UNION ALL SELECT claim_id, 'introduced', event_id, sequence FROM c UNION ALL
SELECT c.claim_id, 'repeated', x.event_id, x.sequence FROM c JOIN claims x ON x.subject = c.subject AND x.sequence > c.sequence UNION ALL
SELECT c.claim_id, 'checked', x.event_id, x.sequence FROM c JOIN results x ON x.subject = c.subject AND x.category = 'verification' AND x.sequence > c.sequence UNION ALL
SELECT claim_id, 'correction', fix_id, fix FROM f UNION ALL SELECT f.claim_id, 'acknowledged', x.event_id, x.sequence FROM f JOIN v x ON x.type = 'acknowledgement' AND x.acknowledges = f.fix_id UNION ALL
SELECT claim_id, CASE WHEN sequence > fix THEN 'used_after' ELSE 'used' END, event_id, sequence FROM u UNION ALL
SELECT a.claim_id, 'changed', x.event_id, x.sequence FROM (SELECT *, (SELECT min(x.sequence) FROM v x WHERE x.agent = a.agent AND x.sequence > a.fix AND (
    (x.type = 'acknowledgement' AND x.acknowledges = a.fix_id AND x.status_after IS NOT NULL) OR (x.type = 'action' AND NOT list_contains(x.refs_claims, a.claim_id)))) AS at
  FROM (SELECT DISTINCT claim_id, agent, fix, fix_id FROM u WHERE sequence < fix AND agent <> fixer) a) a JOIN v x ON x.sequence = a.at WHERE x.type = 'action'""", """
c AS (SELECT * FROM v WHERE type = 'claim' AND sequence % 5 = 0)""", """
f AS (SELECT c.claim_id, min(x.sequence) AS fix, arg_min(x.event_id, x.sequence) AS fix_id, arg_min(x.agent, x.sequence) AS fixer FROM c JOIN v x ON x.type = 'correction' AND x.supersedes = c.claim_id GROUP BY 1)""", """
u AS (SELECT c.claim_id, x.event_id, x.sequence, x.agent, f.fix, f.fix_id, f.fixer FROM c JOIN v x ON x.type = 'action' AND list_contains(x.refs_claims, c.claim_id) LEFT JOIN f ON f.claim_id = c.claim_id)"""))
def world_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineage of a stated set of claims, with all their repetitions: every one whose sequence is divisible by five."""
    log = typed_log(spark, sf_dir)
    return worldstate.lineage(World(log), log.where("type = 'claim' AND sequence % 5 = 0"), max_repeats=None).select("claim_id", "step", "event_id", "sequence")


@query(_sql("SELECT claim_id, standing, (SELECT count(*) FROM (SELECT unnest(refs_claims) AS r FROM v WHERE type = 'action') x WHERE x.r = s.claim_id) AS cited FROM standings s", _CLAIMS))
def world_ranked_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worldstate.ranked_claims(_world(spark, sf_dir)).select("claim_id", "standing", "cited")


@query(_sql("""
SELECT src, dst, tone, label, count(DISTINCT event_id) AS n FROM (
SELECT 'agent:' || agent AS src, 'ev:' || subject AS dst, 'normal' AS tone, 'checked' AS label, event_id FROM shown UNION ALL
SELECT 'ev:' || c.subject, 'agent:' || c.agent, CASE WHEN standing IN ('superseded', 'contradicted') THEN 'unverified' ELSE 'normal' END, CASE WHEN EXISTS (SELECT 1 FROM shown x WHERE x.subject = c.subject AND list_contains(c.evidence, x.event_id)) THEN 'cited' ELSE 'claimed' END, c.event_id
  FROM standings c WHERE c.subject IN (SELECT subject FROM shown) UNION ALL
SELECT 'agent:' || r.agent, 'agent:' || e.agent,
  CASE WHEN e.type = 'acknowledgement' THEN 'ack' WHEN r.type = 'correction' THEN 'correction' WHEN r.type = 'claim' THEN CASE WHEN (SELECT standing FROM standings s WHERE s.sequence = r.sequence) IN ('superseded', 'contradicted') THEN 'unverified' ELSE 'normal' END
    WHEN e.type = 'action' AND EXISTS (SELECT 1 FROM standings s WHERE list_contains(e.refs_claims, s.claim_id) AND s.standing IN ('superseded', 'contradicted')) THEN 'unverified' ELSE 'normal' END,
  CASE WHEN e.type = 'acknowledgement' THEN 'acknowledged' WHEN r.type = 'correction' THEN 'correction' WHEN r.type = 'claim' THEN 'claim' ELSE 'reference' END, e.event_id
  FROM links l JOIN v e ON e.event_id = l.event_id JOIN v r ON r.event_id = l.ref WHERE r.agent <> e.agent AND r.type <> 'tool_result') GROUP BY 1, 2, 3, 4""", _CLAIMS, """
shown AS (SELECT * FROM results WHERE category = 'verification' AND (subject IN (SELECT subject FROM claims) OR subject IN (SELECT r.subject FROM results r WHERE r.category = 'verification' AND r.event_id IN (SELECT unnest(evidence) FROM v))))""", """
links AS (SELECT event_id, unnest(evidence) AS ref FROM v UNION SELECT event_id, acknowledges FROM v WHERE type = 'acknowledgement' UNION SELECT x.event_id, c.event_id FROM (SELECT event_id, unnest(refs_claims) AS r FROM v WHERE type = 'action') x JOIN standings c ON c.claim_id = x.r)"""))
def world_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worldstate.flow(_world(spark, sf_dir))


@query(_sql("""
SELECT subject, head_id AS first_claim, announcer, (SELECT count(*) FROM claims c WHERE c.subject = h.subject) - 1 AS repeats, (SELECT count(*) FROM results r WHERE r.subject = h.subject AND r.category = 'verification') AS checks,
  (SELECT count(*) FROM words w WHERE w.subject = h.subject AND word = 'report') AS reports, (SELECT count(*) FROM words w WHERE w.subject = h.subject AND word = 'correction') AS corrections,
  (SELECT count(DISTINCT agent) FROM claims c WHERE c.subject = h.subject AND c.agent <> h.announcer) AS cascade,
  (SELECT count(*) FROM linked l WHERE l.subject = h.subject AND l.sequence > h.head AND l.sequence < coalesce(h.first_check, 9e18)) AS to_first_check, first_check IS NOT NULL AS checked_after,
  (SELECT count(*) FROM linked l WHERE l.subject = h.subject AND l.sequence > h.head AND l.sequence < coalesce(h.first_word, 9e18)) AS to_correction, first_word IS NOT NULL AS corrected_after,
  CASE WHEN latest IS NULL THEN 'unchecked' WHEN (SELECT count(DISTINCT o) FROM (SELECT agent, arg_max(outcome, sequence) AS o FROM checks k WHERE k.subject = h.subject GROUP BY 1)) > 1 THEN 'split' WHEN latest = 'pass' THEN 'passing' ELSE 'failing' END AS standing
FROM (SELECT *, (SELECT min(sequence) FROM checks k WHERE k.subject = h.subject AND k.sequence > h.head) AS first_check, (SELECT min(sequence) FROM words w WHERE w.subject = h.subject AND w.sequence > h.head) AS first_word,
  (SELECT arg_max(outcome, sequence) FROM checks k WHERE k.subject = h.subject) AS latest FROM heads h) h""", _HEADS, _TOLD, "linked AS (SELECT subject, sequence FROM claims UNION ALL SELECT subject, sequence FROM words WHERE word = 'report')"))
def world_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worldstate.incidents(_world(spark, sf_dir))


_ROLES = """
later AS (SELECT c.*, NOT EXISTS (SELECT 1 FROM checks k WHERE k.subject = c.subject AND k.agent = c.agent AND k.sequence < c.sequence) AS blind FROM claims c JOIN heads h ON h.subject = c.subject AND c.sequence > h.head AND c.agent <> h.announcer),
roles AS (SELECT announcer AS agent, 'announcer' AS role, subject FROM heads UNION SELECT agent, 'repeater', subject FROM later UNION SELECT agent, 'adopter-without-check', subject FROM later WHERE blind
  UNION SELECT agent, 'verifier', subject FROM checks WHERE subject IN (SELECT subject FROM heads) UNION SELECT agent, 'corrector', subject FROM words WHERE subject IN (SELECT subject FROM heads))"""


@query(_sql("SELECT * FROM roles", _HEADS, _TOLD, _ROLES))
def world_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worldstate.roles(_world(spark, sf_dir))


@query(_sql("""
SELECT 'repeats_without_check' AS rate, count(*) FILTER (WHERE blind) AS n, count(*) AS total FROM later UNION ALL
SELECT 'consensus_without_check', count(*) FILTER (WHERE subject NOT IN (SELECT subject FROM checks)), count(*) FROM (SELECT subject FROM claims GROUP BY 1 HAVING count(DISTINCT agent) >= 3) UNION ALL
SELECT 'correction_reach', count(*) FILTER (WHERE again), count(*) FROM (SELECT DISTINCT w.event_id, c.agent, EXISTS (SELECT 1 FROM claims x WHERE x.subject = w.subject AND x.agent = c.agent AND x.sequence > w.sequence) AS again
  FROM words w JOIN claims c ON c.subject = w.subject AND c.sequence < w.sequence AND c.agent <> w.agent) UNION ALL
SELECT 'single_points', count(*) FILTER (WHERE k >= 3), count(*) FROM (SELECT who, count(*) AS k FROM (SELECT subject, min(agent) AS who FROM checks WHERE subject IN (SELECT subject FROM claims) GROUP BY 1 HAVING count(DISTINCT agent) = 1) GROUP BY 1)""", _HEADS, _TOLD, _ROLES))
def world_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worldstate.rates(_world(spark, sf_dir))


@query(_sql("""
SELECT subject, CASE standing WHEN 'failing' THEN announcer WHEN 'unchecked' THEN coalesce(neutral, announcer) ELSE neutral END AS agent, CASE standing WHEN 'failing' THEN 'correct the claim' WHEN 'unchecked' THEN 'verify' ELSE 'break the tie' END AS action
FROM (SELECT h.*, CASE WHEN NOT EXISTS (SELECT 1 FROM checks k WHERE k.subject = h.subject) THEN 'unchecked' WHEN (SELECT count(DISTINCT o) FROM (SELECT agent, arg_max(outcome, sequence) AS o FROM checks k WHERE k.subject = h.subject GROUP BY 1)) > 1 THEN 'split'
    WHEN (SELECT arg_max(outcome, sequence) FROM checks k WHERE k.subject = h.subject) = 'fail' THEN 'failing' ELSE 'passing' END AS standing,
  (SELECT arg_max(t.agent, t.rank) FROM tally t WHERE t.agent <> h.announcer AND NOT EXISTS (SELECT 1 FROM checks k WHERE k.subject = h.subject AND k.agent = t.agent AND k.outcome = 'fail')) AS neutral FROM heads h)
WHERE standing IN ('failing', 'unchecked') OR (standing = 'split' AND neutral IS NOT NULL)
UNION SELECT subject, agent, 'check it yourself' FROM roles WHERE role = 'adopter-without-check'
UNION SELECT c.subject, r.agent, 'share the failing record again' FROM claims c JOIN heads h ON h.subject = c.subject AND c.sequence > h.head JOIN (SELECT subject, min(sequence) AS s, arg_min(agent, sequence) AS agent FROM words WHERE word = 'report' GROUP BY 1) r ON r.subject = c.subject AND c.sequence > r.s AND c.agent <> r.agent""",
    _HEADS, _TOLD, _ROLES, "tally AS (SELECT agent, row_number() OVER (ORDER BY count(*), agent DESC) AS rank FROM v WHERE checking GROUP BY 1)"))
def world_rechecks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worldstate.rechecks(_world(spark, sf_dir))


_TRIAGED = ("A", "C", "J", "BP", "BJ")


@query(_sql(f"""
SELECT monitor, bucket, count(*) AS n FROM (SELECT monitor, CASE WHEN state = 'resolved' THEN 'resolved'
  WHEN monitor = 'C' AND NOT regexp_matches(subject, '^(pages:|pr:|tests:|https?://)') THEN 'count' WHEN monitor IN ('A', 'J') THEN CASE state WHEN 'active' THEN 'open' ELSE 'needs' END WHEN monitor IN ('C', 'BJ') THEN 'needs' ELSE 'patterns' END AS bucket
FROM ({' UNION ALL '.join(f'(SELECT monitor, subject, state FROM ({MONITOR_SQL[m]}))' for m in _TRIAGED)})) GROUP BY 1, 2"""))
def world_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = monitors.run(_world(spark, sf_dir), _TRIAGED, passes=False)
    return worldstate.triage(found).groupBy("monitor", "bucket").agg(F.count(F.lit(1)).alias("n"))


@query(_sql("""
SELECT agent, count(*) AS n FROM v WHERE type = 'claim' AND split_part(artifact, ':', 1) || version NOT IN (SELECT split_part(artifact, ':', 1) || version FROM results WHERE category = 'verification') GROUP BY 1"""))
def meta_unverifiable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worldstate.unverifiable(_world(spark, sf_dir))


@query(_sql("SELECT session AS task FROM sessions s WHERE verify AND ended IS NOT NULL AND NOT EXISTS (SELECT 1 FROM v x WHERE x.task = s.session AND (x.checking OR x.type = 'claim'))"))
def meta_verify_goals_unclaimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worldstate.unclaimed_verify_goals(_world(spark, sf_dir))


@query(_sql("""
SELECT session AS task, owner, turns FROM sessions JOIN (SELECT task, count(*) FILTER (WHERE type = 'action' AND turn_id IS NOT NULL) AS turns FROM v GROUP BY 1) t ON t.task = session
WHERE turns >= 2 AND EXISTS (SELECT 1 FROM v x WHERE x.task = session AND x.status = 'ended') AND NOT EXISTS (SELECT 1 FROM v x WHERE x.task = session AND (x.type = 'claim' OR x.task IN (SELECT task FROM verdicts)))"""))
def meta_long_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With two turns as long, so that the test log has some."""
    return worldstate.long_sessions(_world(spark, sf_dir), 2)


@query("""
WITH RECURSIVE g AS (SELECT c_nationkey AS agent, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS i, list_sort(list_distinct(string_split(lower(c_mktsegment) || ' x' || (c_custkey % 4) || ' y' || (c_custkey % 5), ' '))) AS w FROM customer),
t(agent, i, held, yes) AS (SELECT agent, 1::BIGINT, [w], 1 FROM g WHERE i = 1 UNION ALL
  SELECT g.agent, g.i, CASE WHEN len(list_filter(t.held, lambda p: len(list_intersect(p, g.w)) / len(list_distinct(list_concat(p, g.w)))::DOUBLE >= 0.3)) = 0 THEN list_append(t.held, g.w) ELSE t.held END, 1 FROM t JOIN g ON g.agent = t.agent AND g.i = t.i + 1)
SELECT 'a' || agent AS agent, max(len(held)) AS sessions FROM t GROUP BY 1 HAVING max(len(held)) >= 5""")
def meta_goal_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sessions of their nation, in order, with goals of three words."""
    c = F.col("c_custkey")
    goal = F.concat(F.lower("c_mktsegment"), F.lit(" x"), (c % 4).cast("string"), F.lit(" y"), (c % 5).cast("string"))
    made = F.array(F.struct(c.cast("string").alias("task"), F.concat(F.lit("a"), F.col("c_nationkey").cast("string")).alias("owner"), F.lit("").alias("title"), goal.alias("goal_key"), F.lit(False).alias("verify_goal"), F.array().cast("array<string>").alias("depends_on")))
    empty = spark.createDataFrame([], monitors.LOG)
    rows = store.table(spark, sf_dir, "customer").select(c.cast("long").alias("sequence"), c.cast("string").alias("event_id"), F.lit("task_created").alias("type"), F.lit("x").alias("agent"), made.alias("tasks"))
    return worldstate.goal_churn(World(empty.unionByName(rows, allowMissingColumns=True)))


@query("""
WITH RECURSIVE e(src, dst) AS (SELECT DISTINCT 't' || (user_id % 40), 't' || ((user_id * 3 + 1) % 40) FROM events WHERE user_id % 40 <> (user_id * 3 + 1) % 40),
r(root, node) AS (SELECT src, dst FROM e WHERE src IN ('t0', 't5') UNION SELECT root, dst FROM r JOIN e ON src = node)
SELECT root, count(DISTINCT node) AS reached FROM r WHERE node <> root GROUP BY 1""")
def world_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    task = lambda n: F.concat(F.lit("t"), (n % 40).cast("string"))
    edges = store.table(spark, sf_dir, "events").select(task(user).alias("src"), task(user * 3 + 1).alias("dst")).where("src <> dst").distinct()
    return worldstate.reach(edges, edges.where("src IN ('t0', 't5')").select(F.col("src").alias("root")).distinct()).groupBy("root").agg(F.countDistinct("node").alias("reached"))


@query(with_prelude(f"WITH {TYPED} SELECT cursor, count(*) AS n, count(*) FILTER (WHERE type = 'tool_result' AND outcome = 'fail') AS fails FROM typed JOIN (VALUES (250), (500), (5000)) c(cursor) ON sequence <= cursor GROUP BY 1"))
def world_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measure of the log at a series of cursors."""
    measure = lambda rows: rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when((F.col("type") == "tool_result") & (F.col("outcome") == "fail"), 1)).alias("fails"))
    return worldstate.at_cursors(typed_log(spark, sf_dir), [250, 500, 5000], measure)
