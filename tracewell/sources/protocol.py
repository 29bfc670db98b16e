"""What an adapter is, which adapters there are, and the call that brings a source into a store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tracewell.sources import adapters, ingest, mapping, readers

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class Adapter:
    """``inspect`` tells whether a path is of this kind, and how sure it is (0 to 1); ``load`` makes the store's tables of it."""

    name: str
    inspect: Callable[[SparkSession, str], float]
    load: Callable[[SparkSession, str, str], Tables]


ADAPTERS: dict[str, Adapter] = {}


def register(adapter: Adapter) -> Adapter:
    if adapter.name in ADAPTERS:
        raise ValueError(f"adapter {adapter.name!r} exists already")
    ADAPTERS[adapter.name] = adapter
    return adapter


def _suffix(path: str, *ends: str) -> float:
    return 1.0 if path.endswith(ends) else 0.0


register(Adapter("recordings", lambda spark, path: _suffix(path, ".sqlite", ".db"), lambda spark, path, source: adapters.recordings(spark, path, source)))


def mapped(name: str, spec: dict, inspect: Callable[[SparkSession, str], float] = lambda spark, path: 0.5) -> Adapter:
    """An adapter of a mapping: any found tables, as the mapping says."""
    return register(Adapter(name, inspect, lambda spark, path, source: mapping.apply(spec, readers.tables(spark, path), source)))


def choose(spark: SparkSession, path: str) -> Adapter:
    """The surest adapter of a path (ties: by name)."""
    sure = sorted(((-a.inspect(spark, path), a.name) for a in ADAPTERS.values()), key=lambda x: x)
    if not sure or sure[0][0] == 0:
        raise ValueError(f"no adapter reads {path!r}")
    return ADAPTERS[sure[0][1]]


def sync(spark: SparkSession, root: str, path: str, source: str, adapter: str | None = None) -> str:
    """Read a source by its adapter and put it in the store in place of what the store has of it: new, same or replaced."""
    chosen = ADAPTERS[adapter] if adapter else choose(spark, path)
    tables = {name: df for name, df in chosen.load(spark, path, source).items() if name in ingest.KEYS}
    return ingest.ingest(spark, root, source, tables, f"{chosen.name}:{path}")


@dataclass
class Resolver:
    """Where records of an id's kind are found: providers by kind, asked in order of registration."""

    providers: dict[str, list[Callable[[DataFrame], DataFrame]]]

    def add(self, kind: str, provider: Callable[[DataFrame], DataFrame]) -> None:
        """``provider`` maps ids (evidence_id) to the records it knows (evidence_id, ...)."""
        self.providers.setdefault(kind, []).append(provider)

    def resolve(self, kind: str, ids: DataFrame) -> DataFrame:
        """(evidence_id, record): the first provider's record of each id, as JSON; null where none knows it."""
        from pyspark.sql import functions as F

        out = ids.select("evidence_id").distinct().withColumn("record", F.lit(None).cast("string"))
        for provider in self.providers.get(kind, []):
            known = provider(ids.select("evidence_id").distinct())
            rows = known.select(F.col("evidence_id").alias("_id"), F.to_json(F.struct(*known.columns)).alias("_r")).dropDuplicates(["_id"])
            out = out.join(rows, F.col("evidence_id") == F.col("_id"), "left").select("evidence_id", F.coalesce("record", "_r").alias("record"))
        return out
