"""Recordings as streams: ingestion with de-duplication, completed calls, windows, sessions, running state.

Watermarks bound the state; offsets live in checkpoints.  Every form has a batch twin among the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENT = "id bigint, ts timestamp, session_id string, agent_key string, event string, call_id string, tool string, text string"
RUNNING_SECONDS = 180


def events(spark: SparkSession, folder: str, schema: str = EVENT, files_per_trigger: int = 100) -> DataFrame:
    """Hook events from JSON-lines files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def deduplicated(stream: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Each key once; repetitions are told as long as the watermark reaches back."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def messages_once(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Messages, one for each agent and text."""
    said = stream.where("event = 'message'").withColumn("hash", F.sha2("text", 256))
    return deduplicated(said, ["agent_key", "hash"], late)


def counted(stream: DataFrame, width: str = "1 hour", keys: list[str] | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window and key; a window is final once the watermark passes it."""
    w = F.window("ts", width)
    out = stream.withWatermark("ts", late).groupBy(w, *(keys or [])).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("bucket"), *(keys or []), "n")


def sessions(stream: DataFrame, key: str = "agent_key", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions by key: events no more than ``gap`` apart."""
    w = F.session_window("ts", gap)
    out = stream.withWatermark("ts", late).groupBy(key, w).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def completed_calls(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Tool calls with their results: starts joined with ends of one call id within the watermark; calls still
    open when it passes come without an end."""
    start = stream.where("event = 'call'").select("call_id", "agent_key", "tool", F.col("ts").alias("ts")).withWatermark("ts", late)
    end = stream.where("event = 'result'").select(F.col("call_id").alias("end_id"), F.col("ts").alias("ts_end"), F.col("text").alias("output")).withWatermark("ts_end", late)
    on = (F.col("call_id") == F.col("end_id")) & (F.col("ts_end") >= F.col("ts")) & (F.col("ts_end") <= F.col("ts") + F.expr(f"interval {late}"))
    return start.join(end, on, "leftOuter").select("call_id", "agent_key", "tool", "ts", "ts_end", "output")


def running(batch: DataFrame, now, seconds: int = RUNNING_SECONDS) -> DataFrame:
    """Per agent: last event, whether it stopped, and whether it counts as running at ``now``."""
    at = F.lit(now).cast("timestamp")
    out = batch.groupBy("agent_key").agg(F.max("ts").alias("last_ts"), F.max(F.when(F.col("event") == "stop", F.col("ts"))).alias("stopped"))
    stopped = F.col("stopped").isNotNull() & (F.col("stopped") >= F.col("last_ts"))
    return out.withColumn("running", ~stopped & (F.col("last_ts") > at - F.expr(f"interval {seconds} seconds")))


def upsert(path: str, key: str, order: str = "ts") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: keep the last row of each key in a versioned Parquet folder.

    The new state goes to the batch's own folder, so a batch that is run again rewrites the same
    place from the same predecessor.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if batch_id:
            rows = spark.read.parquet(f"{path}/{batch_id - 1}").unionByName(batch, allowMissingColumns=True)
        others = [c for c in rows.columns if c != key]
        last = rows.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in others])
        last.select(rows.columns).write.mode("overwrite").parquet(f"{path}/{batch_id}")

    return run


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all that is there now to Parquet and stop; a later call goes on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def drain_each(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def watch(spark: SparkSession, path: str, schema: str, handle: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None):
    """Watch a folder of JSON lines and hand each new batch to ``handle``: every ``seconds``, or all there is now and then stop.  The
    checkpoint remembers what was seen, so a watch taken up again goes on where it ended."""
    lines = spark.readStream.schema(schema).json(path)
    writer = lines.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if seconds is None else writer.trigger(processingTime=f"{seconds} seconds").start()
