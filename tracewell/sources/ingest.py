"""The store on disk: replace-by-source ingestion, versions, exports with manifests, and their check.

A store is a folder of data and of catalogs.  Each source's tables are Parquet folders of their own, written once; a catalog, a small
JSON file with a number in its name, lists for every source its owner, digest and folders.  The catalog of the greatest number is
the current one, and readers resolve it once.  Ingesting a source writes that source's folders only, and then the next catalog
under a name that must not exist yet; so a reader or a crash in between finds the store before or after a change, never half of
it, and of two writers at once one fails.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions.redact import Rule, redact, rules

KEYS = {"agents": "agent_id", "messages": "evidence_id", "actions": "evidence_id", "periods": "evidence_id", "artifacts": "artifact_id", "touches": "touch_id"}
CATALOG = "catalog-"
#: Rows of a viewer's document.
PAYLOAD_ROWS = 50_000
#: Share of bytes no longer listed from which a store is compacted.
COMPACT_SHARE = 0.25


class SourceConflict(ValueError):
    """The source's name belongs to another dataset."""


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written aside, then renamed to a name that must be free: a reader finds nothing or all of it."""
    fs, to = _fs(spark, path)
    _, temp = _fs(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(temp, False)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(to) or not fs.rename(temp, to):
        fs.delete(temp, False)
        raise SourceConflict(f"{path} was written by someone else meanwhile")


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, where = _fs(spark, path)
    return "\n".join(r[0] for r in spark.read.text(path).collect()) if fs.exists(where) else None


def current(spark: SparkSession, root: str) -> tuple[int, dict]:
    """The number and content of the current catalog: 0 and nothing before the first."""
    fs, where = _fs(spark, root)
    if not fs.exists(where):
        return 0, {}
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    numbers = [int(n[len(CATALOG) : -5]) for n in names if n.startswith(CATALOG) and n.endswith(".json")]
    return (max(numbers), json.loads(_read_text(spark, f"{root}/{CATALOG}{max(numbers):08d}.json"))) if numbers else (0, {})


def read(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The store's tables, each the union of its sources' folders."""
    out: dict[str, DataFrame] = {}
    for source, entry in sorted(current(spark, root)[1].items()):
        for name, folder in entry["tables"].items():
            df = spark.read.parquet(f"{root}/{folder}").withColumn("source", F.lit(source))
            out[name] = df if name not in out else out[name].unionByName(df, allowMissingColumns=True)
    return out


def duplicate_keys(df: DataFrame, key: str, top: int = 5) -> DataFrame:
    """(key, n, in_all): the most repeated keys, and how many keys repeat."""
    many = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return many.withColumn("in_all", F.count(F.lit(1)).over(Window.partitionBy())).orderBy(F.desc("n"), key).limit(top)


def fingerprint(tables: dict[str, DataFrame]) -> str:
    """A digest of the tables' rows, whatever their order."""
    parts = {}
    for name, df in sorted(tables.items()):
        cols = sorted(c for c in df.columns if c != "source")
        row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*[F.col(c).cast("string") for c in cols]).cast("decimal(38,0)")).alias("h")).first()
        parts[name] = [row["n"], str(row["h"])]
    return hashlib.sha256(json.dumps(parts, sort_keys=True).encode()).hexdigest()


def ingest(spark: SparkSession, root: str, source: str, tables: dict[str, DataFrame], owner: str) -> str:
    """Replace the source's rows by ``tables``: ``new``, ``same`` or ``replaced``.  ``owner`` tells datasets apart."""
    number, catalog = current(spark, root)
    known = catalog.get(source)
    if known and known["owner"] != owner:
        raise SourceConflict(f"source {source!r} belongs to {known['owner']!r}")
    for name, df in tables.items():
        if bad := [r.asDict() for r in duplicate_keys(df, KEYS[name]).collect()]:
            raise ValueError(f"{bad[0]['in_all']} repeated keys in {name}, such as {bad}")
    digest = fingerprint(tables)
    if known and known["digest"] == digest:
        return "same"
    folders = {}
    for name, df in tables.items():
        folders[name] = f"data/{name}-{uuid.uuid4().hex}"
        df.drop("source").write.parquet(f"{root}/{folders[name]}")
    catalog[source] = {"owner": owner, "digest": digest, "tables": folders}
    _write_text(spark, f"{root}/{CATALOG}{number + 1:08d}.json", json.dumps(catalog, sort_keys=True))
    return "replaced" if known else "new"


def garbage(spark: SparkSession, root: str) -> tuple[list[str], float]:
    """Folders that the current catalog does not list, and their share of the store's bytes."""
    live = {f for entry in current(spark, root)[1].values() for f in entry["tables"].values()}
    fs, where = _fs(spark, f"{root}/data")
    held = {f"data/{s.getPath().getName()}": fs.getContentSummary(s.getPath()).getLength() for s in fs.listStatus(where)} if fs.exists(where) else {}
    dead = sorted(set(held) - live)
    return dead, sum(held[d] for d in dead) / max(1, sum(held.values()))


def compact(spark: SparkSession, root: str, least: float = COMPACT_SHARE, target_files: int = 1) -> str:
    """Once ``least`` of the store's bytes are no longer listed: ``compacted`` after the listed folders are rewritten with few files, the
    catalog is moved on and the unlisted folders and older catalogs are deleted; else ``kept``."""
    dead, share = garbage(spark, root)
    if share < least:
        return "kept"
    number, catalog = current(spark, root)
    old = [f for entry in catalog.values() for f in entry["tables"].values()]
    for entry in catalog.values():
        for name, folder in entry["tables"].items():
            entry["tables"][name] = f"data/{name}-{uuid.uuid4().hex}"
            spark.read.parquet(f"{root}/{folder}").coalesce(target_files).write.parquet(f"{root}/{entry['tables'][name]}")
    _write_text(spark, f"{root}/{CATALOG}{number + 1:08d}.json", json.dumps(catalog, sort_keys=True))
    fs, _ = _fs(spark, root)
    for path in [*dead, *old, *[f"{CATALOG}{n:08d}.json" for n in range(1, number + 1)]]:
        fs.delete(_fs(spark, f"{root}/{path}")[1], True)
    return "compacted"


def export(records: DataFrame, path: str, active: tuple[Rule, ...] | None = None) -> dict:
    """Write the records, redacted, as JSON lines, and a manifest: counts by source and kind, hits by rule, and a
    digest of the rows.  Written aside and then renamed."""
    spark = records.sparkSession
    active = active or rules()
    texts = [f.name for f in records.schema if f.dataType.simpleString() == "string"]
    at = [records.columns.index(t) for t in texts]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema) + ", _hits map<string,int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, hits = list(batch.columns), [{} for _ in range(batch.num_rows)]
            for i in at:
                done = [redact(t, active) for t in batch.column(i).to_pylist()]
                columns[i] = pa.array([d[0] for d in done], pa.string())
                for h, (_, counts) in zip(hits, done, strict=True):
                    for k, n in counts.items():
                        h[k] = h.get(k, 0) + n
            maps = pa.array([list(h.items()) for h in hits], pa.map_(pa.string(), pa.int32()))
            yield pa.RecordBatch.from_arrays([*columns, maps], names=[*batch.schema.names, "_hits"])

    temp = f"{path}.{uuid.uuid4().hex}"
    done = records.mapInArrow(run, schema)
    done.write.parquet(f"{temp}/staged")
    staged = spark.read.parquet(f"{temp}/staged")
    staged.drop("_hits").write.json(f"{temp}/events")
    counts = staged.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n")).orderBy("source", "kind").collect()
    hits = staged.select(F.explode("_hits")).groupBy("key").agg(F.sum("value").alias("n")).orderBy("key").collect()
    manifest = {"counts": [r.asDict() for r in counts], "redacted": {r["key"]: r["n"] for r in hits}, "rows": sum(r["n"] for r in counts), "sha256": content_digest(spark, f"{temp}/events")}
    fs, base = _fs(spark, temp)
    fs.delete(_fs(spark, f"{temp}/staged")[1], True)
    _write_text(spark, f"{temp}/manifest.json", json.dumps(manifest, sort_keys=True))
    fs.rename(base, _fs(spark, path)[1])
    return manifest


def content_digest(spark: SparkSession, path: str) -> str:
    """A digest of a folder's lines, whatever their order and files."""
    row = spark.read.text(path).agg(F.count(F.lit(1)), F.sum(F.xxhash64("value").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("value", F.lit(1)))).first()
    return hashlib.sha256(json.dumps([str(x) for x in row]).encode()).hexdigest()


def check_export(spark: SparkSession, path: str) -> list[str]:
    """What is wrong with an export: digest, row count, files that the manifest does not know, remaining hits."""
    manifest = json.loads(_read_text(spark, f"{path}/manifest.json") or "{}")
    problems = []
    if manifest.get("sha256") != content_digest(spark, f"{path}/events"):
        problems.append("the rows are not those of the manifest")
    lines = spark.read.text(f"{path}/events")
    if lines.count() != manifest.get("rows"):
        problems.append("the row count is not that of the manifest")
    fs, where = _fs(spark, path)
    problems += [f"unlisted: {n}" for n in sorted(s.getPath().getName() for s in fs.listStatus(where)) if n not in ("events", "manifest.json") and not n.startswith(".")]
    strict = rules()

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(redact(t, strict)[1].values()) for t in batch.column(0).to_pylist()], pa.int64())], names=["n"])

    hits = lines.mapInArrow(left, "n bigint").agg(F.sum("n")).first()[0] or 0
    if hits:
        problems.append(f"{hits} values that redaction should have found")
    return problems


def append_lines(rows: DataFrame, path: str) -> None:
    """Append rows as JSON lines to a log's folder: findings, sweeps and their summaries.  A log is read whole, and the last line of an id
    counts, so nothing in it is ever changed."""
    rows.write.mode("append").json(path)


def write_payload(rows: DataFrame, path: str, name: str = "rows", **meta) -> None:
    """One JSON document, the facts of ``meta`` and all rows as a list, for a viewer: what it shows is small by nature, and checked."""
    few = [r[0] for r in rows.limit(PAYLOAD_ROWS + 1).select(F.to_json(F.struct(*rows.columns))).collect()]
    if len(few) > PAYLOAD_ROWS:
        raise ValueError(f"a payload holds at most {PAYLOAD_ROWS} rows; narrow the filter")
    _write_text(rows.sparkSession, path, json.dumps({**meta, name: [json.loads(r) for r in few]}, sort_keys=True))
