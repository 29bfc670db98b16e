"""Findings and sweeps: append-only logs, checks against the store, rubric verdicts and their precision."""

from __future__ import annotations

import json
import random
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.stats import wilson

VERDICTS = ("yes", "no", "unclear")
#: Other words for the verdicts.
SYNONYMS = {"yes": "yes", "true": "yes", "match": "yes", "positive": "yes", "no": "no", "false": "no", "negative": "no", "unclear": "unclear", "unsure": "unclear", "maybe": "unclear", "unknown": "unclear"}
RATIONALE_WORDS = 40
CHARS_PER_TOKEN = 4


def latest(log: DataFrame, key: str = "finding_id", line: str = "line") -> DataFrame:
    """The last line of each key, in the order in which keys first came."""
    w = Window.partitionBy(key)
    at = F.row_number().over(w.orderBy(F.desc(line)))
    return log.withColumn("_first", F.min(line).over(w)).withColumn("_at", at).where("_at = 1").orderBy("_first").drop("_first", "_at")


def check(findings: DataFrame, known: DataFrame) -> DataFrame:
    """(finding_id, problem, evidence_id) of findings that still stand: no evidence, malformed or missing ids."""
    live = findings.where(~F.col("status").isin("rejected", "retracted"))
    none = live.where(F.size(F.coalesce("evidence_ids", F.array().cast("array<string>"))) == 0).select("finding_id", F.lit("no evidence").alias("problem"), F.lit(None).cast("string").alias("evidence_id"))
    ids = live.select("finding_id", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id"))
    lost = ids.join(known.select("evidence_id").distinct(), "evidence_id", "left_anti")
    bad = F.when(F.col("evidence_id").rlike(r"^[A-Za-z0-9_.\-]+:[A-Za-z0-9_.\-]+:.+"), "missing").otherwise("malformed")
    return none.unionByName(lost.select("finding_id", bad.alias("problem"), "evidence_id"))


def accept(findings: DataFrame, known: DataFrame) -> DataFrame:
    """The findings that may be recorded: those all of whose ids resolve."""
    return findings.join(check(findings, known).select("finding_id").distinct(), "finding_id", "left_anti")


def sample_ids(ids: list[str], n: int, seed: int) -> list[str]:
    """A seeded sample of a small list of ids, in their order."""
    order = sorted(ids)
    chosen = set(random.Random(seed).sample(order, min(n, len(order))))
    return [i for i in ids if i in chosen]


def seeded(df: DataFrame, n: int, seed: int = 0, id_col: str = "evidence_id") -> DataFrame:
    """``n`` rows by the md5 of id and seed: the same in any engine."""
    return df.orderBy(F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")).cast("binary")), id_col).limit(n)


def estimate(records: DataFrame, rubric: str, text: str = "text") -> DataFrame:
    """One row: records, and tokens to send at four characters each."""
    return records.agg(F.count(F.lit(1)).alias("records"), F.ceil((F.sum(F.length(F.coalesce(text, F.lit("")))) + F.count(F.lit(1)) * len(rubric)) / CHARS_PER_TOKEN).alias("tokens"))


def parse_verdict(reply: str | None) -> tuple[str | None, float | None, str | None]:
    """(verdict, confidence, rationale) of a model's reply: the last JSON object that holds a verdict, else
    the first sentence's word; nulls if there is none."""
    if not reply:
        return None, None, None
    for m in reversed(list(re.finditer(r"\{[^{}]{0,4000}\}", reply))):
        try:
            got = json.loads(m[0])
        except ValueError:
            continue
        word = str(got.get("verdict", got.get("answer", ""))).strip().lower()
        if word in SYNONYMS:
            try:
                sure = min(1.0, max(0.0, float(got.get("confidence"))))
            except (TypeError, ValueError):
                sure = None
            why = " ".join(str(got.get("rationale", "")).split()[:RATIONALE_WORDS])
            return SYNONYMS[word], sure, why or None
    m = re.search(r"(?:verdict|answer)\W{1,5}(\w+)|^\W*(\w+)", reply, re.I)
    word = (m[1] or m[2]).lower() if m else ""
    return (SYNONYMS[word], None, " ".join(reply.split()[:RATIONALE_WORDS])) if word in SYNONYMS else (None, None, None)


def sweep(records: DataFrame, rubric: str, complete: Callable[[str], str], cap: int, errors: int = 3) -> DataFrame:
    """(event_id, verdict, confidence, rationale, error) of at most ``cap`` records, in order of time and id.

    ``complete`` takes a prompt and returns the reply; it must be picklable.  A task gives up after so many
    errors in a row; what it did not send has the error ``not sent``.
    """
    chosen = records.orderBy(F.asc_nulls_last("ts"), "evidence_id").limit(cap).select("evidence_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed = 0
        for batch in batches:
            rows = []
            for event_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if failed >= errors:
                    rows.append((event_id, None, None, None, "not sent"))
                    continue
                try:
                    rows.append((event_id, *parse_verdict(complete(f"{rubric}\n\n{text or ''}")), None))
                    failed = 0
                except Exception as e:  # noqa: BLE001  a client may fail in any way
                    failed += 1
                    rows.append((event_id, None, None, None, str(e)[:200]))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())],
                names=["event_id", "verdict", "confidence", "rationale", "error"],
            )

    return chosen.mapInArrow(run, "event_id string, verdict string, confidence double, rationale string, error string")


def last_verdicts(log: DataFrame) -> DataFrame:
    """(event_id, verdict) of a sweep's log: the last line counts, and drops the record if its call failed."""
    lines = log.where("type = 'verdict' AND event_id IS NOT NULL")
    return lines.groupBy("event_id").agg(F.max_by("verdict", "line").alias("verdict")).where("verdict IS NOT NULL")


def precision(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """Per verdict: labelled and correct records, accuracy with its Wilson interval, all records, and the
    number of true ones this suggests."""
    seen = labels.groupBy("event_id").agg(F.max_by("correct", "line").alias("correct")).where("correct IS NOT NULL") if "line" in labels.columns else labels
    both = verdicts.join(seen, "event_id", "left")
    out = both.groupBy("verdict").agg(F.count(F.lit(1)).alias("records"), F.count("correct").alias("labelled"), F.count(F.when(F.col("correct"), 1)).alias("correct"))
    low, high = wilson(F.col("correct").cast("double"), F.col("labelled"))
    accuracy = F.try_divide(F.col("correct").cast("double"), F.col("labelled").cast("double"))
    return out.select("verdict", "records", "labelled", "correct", accuracy.alias("accuracy"), low.alias("low"), high.alias("high"), (accuracy * F.col("records")).alias("estimated"))
