"""The events as a typed log.  Every column is a fixed function of the events, stated once in SQL that Spark and other
engines read alike, but for the form of lists.

Agents a0 to a6 claim, check, correct, quote, direct and chat about subjects of four kinds, some crowded and most sparse; a
session of an agent runs from one task_created record to its next.  The windows here make test input and are no part of any operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tracewell import staging
from tracewell.operators import monitors
from tracewell.plans import store

_LAYERS = """
t0 AS (
  SELECT event_id + 1 AS n, ts, event_type, user_id, k, 'a' || CAST(user_id % 7 AS STRING) AS a, 'a' || CAST((user_id + 1) % 7 AS STRING) AS b, 'a' || CAST((user_id + 3) % 7 AS STRING) AS c,
    CASE WHEN k < 45 THEN (user_id * 7 + k) % 41 ELSE 1000 + (user_id * 31 + k * 17) % 1500 END AS s,
    CASE event_type WHEN 'purchase' THEN 'claim' WHEN 'view' THEN 'tool_result' WHEN 'error' THEN 'tool_result'
      WHEN 'click' THEN CASE k % 8 WHEN 0 THEN 'message' WHEN 3 THEN 'status_updated' WHEN 4 THEN 'message' WHEN 7 THEN 'message' ELSE 'action' END
      ELSE CASE k % 8 WHEN 0 THEN 'correction' WHEN 1 THEN 'correction' WHEN 2 THEN 'quote' WHEN 3 THEN 'quote' WHEN 4 THEN 'directive' WHEN 5 THEN 'acknowledgement' WHEN 6 THEN 'task_created' ELSE 'message' END END AS type
  FROM ev),
t1 AS (
  SELECT *, CASE WHEN s % 20 = 5 THEN 'proc:' || CAST(s AS STRING) WHEN s % 20 = 9 THEN 'http://localhost:' || CAST(s AS STRING) || '/' WHEN s % 4 = 0 THEN 'tests:p' || CAST(s AS STRING)
      WHEN s % 4 = 1 THEN 'https://h' || CAST(s AS STRING) || '.example.org/p' WHEN s % 4 = 2 THEN 'repo:r' || CAST(s AS STRING) ELSE 'file:src/m/f' || CAST(s % 50 AS STRING) || '.py' END AS thing,
    CASE WHEN s % 20 = 5 THEN 'running' WHEN s % 4 = 0 THEN 'working-tree' WHEN s % 4 = 1 THEN 'live' WHEN s % 4 = 2 THEN 'built' ELSE 'exists' END AS state,
    type IN ('message', 'quote') AND user_id % 5 = 0 AS is_human,
    max(CASE WHEN type = 'task_created' THEN n END) OVER (PARTITION BY a ORDER BY n) AS made,
    max(CASE WHEN type = 'task_created' AND k % 3 = 0 THEN n END) OVER (PARTITION BY a ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS made_before,
    max(CASE WHEN type = 'claim' THEN n END) OVER (PARTITION BY a ORDER BY n) AS own_claim, max(CASE WHEN type = 'claim' THEN n END) OVER (PARTITION BY s % 5 ORDER BY n) AS any_claim,
    max(CASE WHEN type = 'tool_result' THEN n END) OVER (PARTITION BY a ORDER BY n) AS own_result, max(CASE WHEN event_type = 'error' THEN n END) OVER (PARTITION BY a ORDER BY n) AS own_fail,
    max(CASE WHEN type IN ('correction', 'quote', 'directive') THEN n END) OVER (PARTITION BY user_id % 3 ORDER BY n) AS any_word
  FROM t0),
t2 AS (SELECT *, min(CASE WHEN type = 'claim' THEN n END) OVER (PARTITION BY a, thing, state ORDER BY n) AS head FROM t1),
typed AS (
  SELECT n AS sequence, 'e' || CAST(n AS STRING) AS event_id, ts, CASE WHEN is_human THEN 'humans' ELSE a END AS agent,
    CASE WHEN k % 9 <> 4 AND type <> 'task_created' AND NOT is_human THEN 't' || CAST(made AS STRING) END AS task,
    CASE WHEN type IN ('message', 'quote', 'directive') OR (type IN ('claim', 'correction') AND k % 2 = 0) THEN 'room' || CAST(k % 3 AS STRING) END AS room, type, 'observed' AS provenance,
    CASE WHEN type = 'status_updated' THEN CASE WHEN k % 3 = 0 THEN 'blocked' ELSE 'ended' END END AS status,
    CASE WHEN type = 'claim' THEN 'done' WHEN type = 'action' AND k % 16 = 1 THEN 'ended' WHEN type = 'action' THEN 'in_progress' WHEN type = 'correction' THEN 'in_progress' END AS status_after,
    CASE WHEN type = 'status_updated' AND k % 3 > 0 THEN CASE WHEN k % 3 = 1 THEN 'stop' ELSE 'consolidate' END END AS end_reason,
    CASE WHEN type = 'claim' AND k % 13 = 5 THEN {one}'x' || CAST(n AS STRING){end} WHEN type = 'claim' AND k % 3 = 0 AND own_result IS NOT NULL THEN {one}'e' || CAST(own_result AS STRING){end}
      WHEN type = 'correction' AND own_fail IS NOT NULL THEN {one}'e' || CAST(own_fail AS STRING){end} ELSE {none} END AS evidence,
    CASE WHEN type = 'claim' THEN 'C' || CAST(n AS STRING) END AS claim_id,
    CASE WHEN type IN ('claim', 'quote') OR (type = 'tool_result' AND k % 12 <> 11) THEN thing END AS artifact,
    CASE WHEN type IN ('claim', 'quote') OR (type = 'tool_result' AND k % 12 <> 11) THEN state END AS version,
    CASE WHEN type = 'claim' THEN CASE state WHEN 'live' THEN 'live' WHEN 'working-tree' THEN 'verification_passed' WHEN 'exists' THEN 'exists' ELSE 'complete' END END AS asserts,
    type = 'claim' AND k % 6 = 0 AS hedged, CASE WHEN type = 'claim' AND head < n THEN 'C' || CAST(head AS STRING) END AS repeat_of,
    CASE WHEN type = 'claim' AND k % 5 = 0 AND state = 'working-tree' THEN CAST(40 + k % 3 AS DOUBLE) WHEN type = 'claim' AND k % 5 < 2 AND state = 'live' THEN CAST(200 + 204 * (k % 2) AS DOUBLE) END AS number_value,
    CASE WHEN type = 'claim' AND k % 5 = 0 AND state = 'working-tree' THEN 'tests-passed' WHEN type = 'claim' AND k % 5 < 2 AND state = 'live' THEN 'http-status' END AS number_kind,
    CASE WHEN type = 'tool_result' THEN 'run-' || CAST(n AS STRING) END AS run_id, CASE WHEN type = 'tool_result' THEN CASE k % 10 WHEN 0 THEN 'build' WHEN 1 THEN 'execution' ELSE 'verification' END END AS category,
    CASE WHEN type = 'tool_result' THEN CASE WHEN k % 10 = 1 THEN 'traceback' WHEN state = 'working-tree' THEN 'test-summary' WHEN state = 'live' AND k % 10 <> 7 THEN 'http-status' WHEN state = 'exists' THEN 'file-exists' ELSE 'build-result' END END AS rule,
    CASE WHEN type = 'tool_result' THEN CASE WHEN k % 11 = 10 THEN 'inconclusive' WHEN event_type = 'error' THEN 'fail' ELSE 'pass' END END AS outcome,
    CASE WHEN type = 'tool_result' AND state = 'working-tree' THEN CASE k % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'partial' END END AS scope,
    CASE WHEN type = 'tool_result' AND state = 'live' THEN CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN thing || '/login' WHEN 2 THEN thing || '/' ELSE thing END END AS final_url,
    type = 'tool_result' AND k % 7 < 2 AS suppressed, type = 'tool_result' AND k % 9 < 3 AS empty_output,
    CASE WHEN type = 'tool_result' AND state = 'working-tree' THEN CAST(40 + k % 3 AS DOUBLE) END AS passed_seen, CASE WHEN type = 'tool_result' AND state = 'live' THEN CAST(CASE WHEN event_type = 'error' THEN 404 ELSE 200 END AS DOUBLE) END AS status_seen,
    CASE WHEN type = 'correction' THEN 'C' || CAST(CASE WHEN k % 3 = 0 THEN any_claim ELSE own_claim END AS STRING) END AS supersedes,
    CASE WHEN type = 'correction' THEN {one}b{end} ELSE {none} END AS addressed_to, CASE WHEN type = 'acknowledgement' THEN 'e' || CAST(any_word AS STRING) END AS acknowledges,
    CASE WHEN type = 'quote' AND k % 5 = 3 THEN 'x' || CAST(n AS STRING) WHEN type = 'quote' THEN 'e' || CAST(own_fail AS STRING) END AS quotes_event,
    CASE WHEN type = 'action' AND k % 6 <> 5 THEN 'u' || CAST(n AS STRING) END AS turn_id, CASE WHEN type = 'action' THEN CASE WHEN k % 10 = 9 THEN 'computer' ELSE 'command' END END AS action_kind,
    CASE WHEN type = 'action' THEN 'make' END AS command, CASE WHEN type = 'action' AND k % 10 <> 9 THEN CASE WHEN k < 70 THEN 'c0' ELSE 'c1' END END AS command_hash, CASE WHEN type = 'action' THEN CASE WHEN k % 16 < 11 THEN 'o0' ELSE 'o1' END END AS output_hash,
    CASE WHEN type = 'action' AND k % 5 = 0 THEN {one}'repo:*'{end} WHEN type = 'action' AND k % 5 < 3 THEN {one}CASE WHEN k % 2 = 0 THEN 'file:m/f' ELSE 'file:app/src/m/f' END || CAST(s % 50 AS STRING) || '.py'{end} ELSE {none} END AS writes,
    CASE WHEN type = 'action' AND k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 'rm -rf' ELSE 'kill -9' END END AS destructive, CASE WHEN type = 'action' AND state = 'live' THEN thing END AS navigates,
    CASE WHEN type = 'action' AND any_claim IS NOT NULL THEN {one}'C' || CAST(any_claim AS STRING){end} ELSE {none} END AS refs_claims,
    is_human, type IN ('message', 'quote') AND k % 4 > 1 AS is_question, CASE WHEN type = 'message' AND state = 'live' THEN {one}thing{end} ELSE {none} END AS names,
    type = 'message' AND k % 8 = 7 AS negative, type = 'message' AND k % 5 < 3 AS blame, type = 'message' AND k % 13 = 0 AS own_error,
    CASE WHEN type = 'message' THEN {one}'#t' || CAST(user_id % 11 AS STRING){end} ELSE {none} END AS conventions,
    CASE WHEN type IN ('message', 'directive') AND k % 3 = 0 THEN {one}b{end} ELSE {none} END AS question_to,
    CASE WHEN type = 'directive' AND k % 16 = 4 THEN {one}b, c{end} WHEN type = 'directive' THEN {one}b{end} ELSE {none} END AS addressees,
    CASE WHEN type = 'directive' THEN {one}'w' || CAST(k % 6 AS STRING), 'deploy'{end} ELSE {none} END AS tokens,
    CASE WHEN type IN ('message', 'claim', 'tool_result', 'action') THEN {one}'/p/' || CAST((user_id * 3 + k) % 900 AS STRING){end} ELSE {none} END AS refs,
    CASE WHEN type = 'task_created' THEN 't' || CAST(n AS STRING) END AS made_task, a AS made_owner, 'fix w' || CAST((user_id + k) % 3 AS STRING) || ' now' AS made_goal, k % 3 = 0 AS made_verify,
    CASE WHEN type = 'task_created' AND k % 3 < 2 AND made_before IS NOT NULL THEN {one}'t' || CAST(made_before AS STRING){end} ELSE {none} END AS made_after
  FROM t2)"""
#: The log's columns for SQL, after the store's ``ev``.
TYPED = _LAYERS.format(one="[", end="]", none="CAST([] AS VARCHAR[])")
_SPARK = _LAYERS.format(one="array(", end=")", none="CAST(array() AS array<string>)")

_STAGED: dict[tuple[str, str], DataFrame] = {}


def typed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed log as a table, made once per application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STAGED:
        _STAGED[key] = staging.stage(derived_log(spark, sf_dir), "typed")
    return _STAGED[key]


def derived_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed log as the monitors read it."""
    rows = spark.sql(f"WITH {_SPARK.replace('FROM ev)', 'FROM {ev})', 1)} SELECT * FROM typed", ev=store.events(spark, sf_dir))
    made = F.struct(
        F.col("made_task").alias("task"), F.col("made_owner").alias("owner"), F.lit("session").alias("title"), F.col("made_goal").alias("goal_key"), F.col("made_verify").alias("verify_goal"),
        F.col("made_after").alias("depends_on"),
    )
    rows = rows.withColumn("tasks", F.when(F.col("made_task").isNotNull(), F.array(made)).otherwise(F.array().cast("array<struct<task: string, owner: string, title: string, goal_key: string, verify_goal: boolean, depends_on: array<string>>>")))
    rows = rows.withColumnsRenamed({"refs_claims": "references", "addressees": "to"}).withColumn("dep_from", F.lit(None).cast("string")).withColumn("dep_to", F.lit(None).cast("string")).withColumn("assignee", F.lit(None).cast("string"))
    return rows.select(*[f.name for f in StructType.fromDDL(monitors.LOG)])
