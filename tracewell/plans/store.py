"""The test tables as a store: agents, messages, actions, periods, artifacts and touches.

Every derived column is a fixed function of the tables, stated once here for Spark and once in
``PRELUDE`` for SQL.  Events make both the actions and the timed messages; a message's
text, if asked for, is the document of a tenth of its number (others have none); its recipients
follow from ``props``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE = "testdata"

PRELUDE = """
ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
messages AS (
  SELECT 'testdata:msg:' || event_id AS evidence_id, 'testdata' AS source, event_type AS channel,
         CASE WHEN user_id % 10 = 0 THEN 'human:' || user_id ELSE 'testdata:agent:' || user_id END AS author_id,
         CASE WHEN k % 3 = 0 THEN ['testdata:agent:' || ((user_id + k) % 150)]
              WHEN k % 7 = 0 THEN ['testdata:agent:' || ((user_id + k) % 150), 'testdata:agent:' || ((user_id + 1) % 150)]
              ELSE [] END AS recipient_ids,
         ts, event_id, user_id, value, k FROM ev),
agents AS (
  SELECT 'testdata:agent:' || user_id AS agent_id, min(ts) AS first_seen, max(ts) AS last_seen
  FROM ev WHERE user_id % 10 <> 0 GROUP BY user_id),
actions AS (
  SELECT 'testdata:event:' || event_id AS evidence_id, 'testdata' AS source, 'testdata:agent:' || user_id AS agent_id,
         ts, event_type AS kind, value, k, event_id, user_id FROM ev),
periods AS (
  SELECT 'testdata:period:' || i AS evidence_id, 'testdata' AS source, 'goal' AS kind, 'week ' || i AS label,
         TIMESTAMP '2024-01-01' + INTERVAL (7 * i) DAY AS start_ts,
         CASE WHEN i < 4 THEN TIMESTAMP '2024-01-01' + INTERVAL (7 * i + 7) DAY END AS end_ts
  FROM range(0, 5) t(i))"""


def with_prelude(sql: str) -> str:
    """``sql``, which may start with ``WITH``, after the store's views."""
    body = sql.strip()
    return f"WITH {PRELUDE},\n{body[4:].strip()}" if body.upper().startswith("WITH") else f"WITH {PRELUDE}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _agent(user: Column) -> Column:
    return F.concat(F.lit("testdata:agent:"), user.cast("string"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def messages(spark: SparkSession, sf_dir: str, text: bool = False) -> DataFrame:
    user, k = F.col("user_id"), F.col("k")
    named = _agent((user + k) % 150)
    out = events(spark, sf_dir).select(
        F.concat(F.lit("testdata:msg:"), F.col("event_id").cast("string")).alias("evidence_id"),
        F.lit(SOURCE).alias("source"),
        F.col("event_type").alias("channel"),
        F.when(user % 10 == 0, F.concat(F.lit("human:"), user.cast("string"))).otherwise(_agent(user)).alias("author_id"),
        F.when(k % 3 == 0, F.array(named))
        .when(k % 7 == 0, F.array(named, _agent((user + 1) % 150)))
        .otherwise(F.array().cast("array<string>"))
        .alias("recipient_ids"),
        "ts", "event_id", "user_id", "value", "k",
    )
    if text:
        docs = table(spark, sf_dir, "documents").select((F.col("doc_id") * 10).alias("event_id"), F.col("text").alias("content"))
        out = out.join(docs, "event_id", "left")
    return out


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").where(F.col("user_id") % 10 != 0)
    return rows.groupBy(_agent(F.col("user_id")).alias("agent_id")).agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        F.concat(F.lit("testdata:event:"), F.col("event_id").cast("string")).alias("evidence_id"),
        F.lit(SOURCE).alias("source"),
        _agent(F.col("user_id")).alias("agent_id"),
        "ts", F.col("event_type").alias("kind"), "value", "k", "event_id", "user_id",
    )


def periods(spark: SparkSession) -> DataFrame:
    day = lambda i: F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval({i}, 0, 0, 0)")
    return spark.range(5).select(
        F.concat(F.lit("testdata:period:"), F.col("id").cast("string")).alias("evidence_id"),
        F.lit(SOURCE).alias("source"),
        F.lit("goal").alias("kind"),
        F.concat(F.lit("week "), F.col("id").cast("string")).alias("label"),
        day("cast(7 * id as int)").alias("start_ts"),
        F.when(F.col("id") < 4, day("cast(7 * id + 7 as int)")).alias("end_ts"),
    )
