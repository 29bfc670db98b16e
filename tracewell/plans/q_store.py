"""Queries: sources, profiles, mappings, ingestion, exports, text and time functions, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell import staging
from tracewell.functions import extract, stats, text
from tracewell.functions.time import parse
from tracewell.operators import joins, records, timeline
from tracewell.plans import store
from tracewell.plans.store import with_prelude
from tracewell.registry import query
from tracewell.sources import ingest, mapping
from tracewell.streaming import live


@query("""
WITH p AS (SELECT 'user_id' AS field, count(*) AS "rows", count(*) - count(user_id) AS nulls, round(avg(length(user_id::VARCHAR)), 6) AS avg_length FROM events
UNION ALL SELECT 'event_type', count(*), count(*) - count(event_type), round(avg(length(event_type)), 6) FROM events UNION ALL SELECT 'props', count(*), count(*) - count(props), round(avg(length(props)), 6) FROM events)
SELECT * FROM p""")
def profile_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mapping.profile(store.table(spark, sf_dir, "events").select("user_id", "event_type", "props"))
    return out.select("field", "rows", "nulls", F.round("avg_length", 6).alias("avg_length"))


_CHAT = {
    "messages": {
        "from": "conversations", "where": [["role", "in", ["user", "assistant"]], ["text", "exists"]],
        "fields": {"evidence_id": "key", "channel": "conv_id", "author_id": {"path": "role", "values": {"user": "human:user", "assistant": "bot"}}, "content": "text", "msg_type": {"const": "chat"}},
    }
}


def _mapped(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = store.table(spark, sf_dir, "conversations").withColumn("key", F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")))
    return mapping.apply(_CHAT, {"conversations": rows.withColumn("conv_id", F.col("conv_id").cast("string"))}, "chat")


@query("""
SELECT 'chat:msg:' || conv_id || '-' || turn AS evidence_id, 'chat' AS source, conv_id::VARCHAR AS channel, CASE role WHEN 'user' THEN 'human:user' ELSE 'bot' END AS author_id, text AS content, 'chat' AS msg_type
FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL""")
def mapping_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir)["messages"].select("evidence_id", "source", "channel", "author_id", "content", "msg_type")


@query("SELECT 'chat:agent:bot' AS agent_id, 'chat' AS source, 'bot' AS display_name")
def mapping_derived_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mapped(spark, sf_dir)["agents"].select("agent_id", "source", "display_name")


@query("""SELECT 'messages' AS "table", 'time_missing' AS code, count(*) AS n FROM conversations WHERE role IN ('user', 'assistant')
UNION ALL SELECT 'messages', 'text_empty', count(*) FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) = '' HAVING count(*) > 0""")
def mapping_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.check({"messages": _mapped(spark, sf_dir)["messages"]})


@query("SELECT count(DISTINCT o_custkey) FILTER (WHERE o_custkey IN (SELECT c_custkey FROM customer)) / count(DISTINCT o_custkey)::DOUBLE AS overlap, count(DISTINCT o_custkey) AS values FROM orders")
def profile_foreign_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.foreign_key_overlap(store.table(spark, sf_dir, "orders"), "o_custkey", store.table(spark, sf_dir, "customer"), "c_custkey")


@query("SELECT l_orderkey, count(*) AS n, (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)) AS in_all FROM lineitem GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, l_orderkey LIMIT 5")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.duplicate_keys(store.table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey")


@query(with_prelude("SELECT channel, count(*) AS n FROM messages WHERE channel <> 'error' GROUP BY 1 UNION ALL SELECT 'all of both', count(*) FROM messages"))
def ingest_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources, one of them replaced, read back from the current version."""
    root = staging.new_path(spark, "store")
    rows = store.messages(spark, sf_dir).select("evidence_id", "channel", "author_id", "ts", "event_id")
    ingest.ingest(spark, root, "one", {"messages": rows}, "a")
    ingest.ingest(spark, root, "two", {"messages": rows.where("channel = 'error'")}, "b")
    ingest.ingest(spark, root, "one", {"messages": rows.where("channel <> 'error'")}, "a")
    held = ingest.read(spark, root)["messages"]
    return held.where("source = 'one'").groupBy("channel").agg(F.count(F.lit(1)).alias("n")).union(held.agg(F.lit("all of both").alias("channel"), F.count(F.lit(1)).alias("n")))


@query("SELECT 'chat' AS source, 'msg' AS kind, count(*) AS n, 0 AS problems FROM conversations WHERE role IN ('user', 'assistant') AND text IS NOT NULL")
def export_and_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging.new_path(spark, "export")
    rows = _mapped(spark, sf_dir)["messages"].select("evidence_id", "source", F.lit("msg").alias("kind"), "content")
    manifest = ingest.export(rows, path)
    problems = ingest.check_export(spark, path)
    return spark.createDataFrame([(c["source"], c["kind"], c["n"], len(problems)) for c in manifest["counts"]], "source string, kind string, n bigint, problems int")


@query("SELECT event_id, make_timestamp(epoch_us(ts)) AS from_us, make_timestamp((epoch_us(ts) // 1000000) * 1000000) AS from_s, ts AS from_iso FROM events")
def parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return store.table(spark, sf_dir, "events").select(
        "event_id", parse(us.cast("string")).alias("from_us"), parse(F.floor(us / 1_000_000).cast("string"), "epoch_s").alias("from_s"), parse(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "iso").alias("from_iso")
    )


@query("""
WITH c AS (SELECT p_partkey, unnest(regexp_extract_all(p_name, '.')) AS ch, length(p_name) AS n FROM part), f AS (SELECT p_partkey, ch, count(*) / max(n)::DOUBLE AS p FROM c GROUP BY 1, 2)
SELECT p_partkey, round(-sum(p * log2(p)), 6) AS bits FROM f GROUP BY 1""")
def entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.table(spark, sf_dir, "part").select("p_partkey", F.round(stats.entropy(F.col("p_name")), 6).alias("bits"))


@query("""
SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || ' …[+' || (length(text) - 100) || ' chars]' ELSE text END AS head,
       CASE WHEN strpos(lower(text), 'tion') > 0 THEN substr(text, greatest(1, strpos(lower(text), 'tion') - 8), 20) ELSE substr(text, 1, 20) END AS around FROM documents""")
def labels_and_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = store.table(spark, sf_dir, "documents").select("doc_id", text.truncated(F.col("text"), 100).alias("head"), text.snippet(F.col("text"), "tion", 20).alias("s"))
    return out.select("doc_id", "head", F.regexp_replace("s", "^…|…$", "").alias("around"))


@query(r"""SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS goal_key, NOT regexp_matches(text, '\bcheck\w*\s+(my |the |for |new |all )?(e-?mails?|messages?|chat|inbox|dashboards?)\b', 'i') AND (regexp_matches(text, '\b(run(ning)? (the )?tests|test suite|pytest|npm test|vitest)\b', 'i')
  OR (regexp_matches(text, '\b(verif\w*|validat\w*|confirm\w*|check\w*)\b', 'i') AND regexp_matches(text, '\b(urls?|deploy\w*|live|builds?|tests?|pages|prs?|pull requests?)\b', 'i'))) AS verify FROM documents""")
def goal_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.table(spark, sf_dir, "documents")
    return rows.select("doc_id", extract.goal_key(F.col("text")).alias("goal_key"), extract.verify_goal(F.col("text")).alias("verify"))


@query(with_prelude("""
WITH s AS (SELECT 's' || event_id AS session, user_id AS agent, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, 's' || event_id) AS nxt FROM ev WHERE event_type = 'signup'),
e AS (SELECT 's' || event_id AS session, ts + INTERVAL 2 HOUR AS t FROM ev WHERE event_type = 'signup' AND event_id % 2 = 0)
SELECT session, CASE WHEN t IS NOT NULL AND (nxt IS NULL OR t <= nxt) THEN t ELSE nxt END AS end_ts, CASE WHEN t IS NOT NULL AND (nxt IS NULL OR t <= nxt) THEN 'stop' WHEN nxt IS NOT NULL THEN 'next-start' END AS reason FROM s LEFT JOIN e USING (session)"""))
def session_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.events(spark, sf_dir).where("event_type = 'signup'")
    starts = rows.select(F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("session"), F.col("user_id").alias("agent"), "ts")
    stops = rows.where("event_id % 2 = 0").select(F.concat(F.lit("s"), F.col("event_id").cast("string")).alias("session"), (F.col("ts") + F.expr("interval 2 hours")).alias("ts"), F.lit("stop").alias("reason"))
    return extract.session_ends(starts, stops)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = store.table(spark, sf_dir, "events").schema
    name = "events.parquet"
    rows = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def _last_batch(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """What a stream over all that is there yields, written by each batch and read back."""
    out, checkpoint = staging.new_path(spark, name), staging.new_path(spark, f"{name}-checkpoint")
    live.drain_each(stream, lambda df, n: df.write.mode("overwrite").parquet(out), checkpoint, "complete")
    return spark.read.parquet(out)


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _last_batch(spark, live.counted(_stream(spark, sf_dir), "6 hours", ["event_type"]), "windows")
    return out.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "event_type", "n")


@query("""
WITH b AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
r AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT user_id, min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM r GROUP BY user_id, run""")
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _last_batch(spark, live.sessions(_stream(spark, sf_dir), key="user_id"), "sessions")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("SELECT user_id, event_type, count(*) AS n FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY 1, 2")
def stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, checkpoint = staging.new_path(spark, "dedup"), staging.new_path(spark, "dedup-checkpoint")
    live.drain(live.deduplicated(_stream(spark, sf_dir).select("ts", "user_id", "event_type"), ["user_id", "event_type"], "60 days"), out, checkpoint)
    return spark.read.parquet(out).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(with_prelude("""
WITH m AS (SELECT *, row_number() OVER (ORDER BY ts, evidence_id) AS r, length(to_json({'evidence_id': evidence_id, 'channel': channel})) AS size FROM messages)
SELECT evidence_id FROM (SELECT *, sum(size) OVER (ORDER BY r ROWS UNBOUNDED PRECEDING) AS total FROM m) WHERE total <= 50000 OR r = 1"""))
def response_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.messages(spark, sf_dir).select("evidence_id", "channel")
    fits = records.within_budget(rows, [F.split_part("evidence_id", F.lit(":"), F.lit(3)).cast("int")], 50_000)
    return fits.select("evidence_id")


@query(with_prelude("""
WITH p AS (SELECT evidence_id AS period, start_ts AS s, start_ts + INTERVAL 10 DAY AS e FROM periods)
SELECT period, author_id, count(*) AS n FROM p JOIN messages ON ts >= s AND ts < e GROUP BY 1, 2"""))
def overlapping_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods made to overlap, so that a message counts in each."""
    long = store.periods(spark).select(F.col("evidence_id").alias("period"), F.col("start_ts"), (F.col("start_ts") + F.expr("interval 10 days")).alias("end_ts"))
    held = joins.within_intervals(store.messages(spark, sf_dir).select("author_id", "ts"), long)
    return held.groupBy("period", "author_id").agg(F.count(F.lit(1)).alias("n"))


@query(with_prelude("SELECT evidence_id, date_diff('day', DATE '2024-01-01', CAST(timezone('America/Los_Angeles', ts AT TIME ZONE 'UTC') AS DATE)) + 1 AS day FROM messages"))
def local_day_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = timeline.day_number(F.col("ts"), F.lit("2024-01-01").cast("date"), "America/Los_Angeles")
    return store.messages(spark, sf_dir).select("evidence_id", day.alias("day"))
