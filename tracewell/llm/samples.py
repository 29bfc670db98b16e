"""Bounded samples of labelled rows, on which the scoring operators are fitted."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longer texts are not learned from (all are scored): so a sample of 2 * 2,500 texts holds 640 MB at most.
MAX_BYTES = 1 << 17


def labelled_ids(labels: DataFrame, label: str, rows_per_class: int, train: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of at most ``rows_per_class`` rows of each of the classes 0 and 1: those whose id
    hashes lowest, so the choice is the same at every run and partitioning."""
    known = labels.select(id_col, F.col(label).cast("int").alias("label")).where(F.col(id_col).isNotNull() & F.col("label").isin(0, 1) & train)
    one = known.groupBy(id_col).agg(F.max("label").alias("label"))
    parts = [one.where(F.col("label") == c).orderBy(F.xxhash64(id_col), id_col).limit(rows_per_class) for c in (0, 1)]
    return parts[0].union(parts[1])


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, rows_per_class: int, train: Column, id_col: str = "doc_id", max_bytes: int = MAX_BYTES) -> DataFrame:
    """(id, text, label) of the sample; the ids, at most twice ``rows_per_class``, are broadcast."""
    ids = labelled_ids(labels, label, rows_per_class, train, id_col)
    return short(documents.select(id_col, "text"), max_bytes).join(F.broadcast(ids), id_col).select(id_col, "text", "label")


def short(rows: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows that a fit may hold on one machine: those with texts of at most ``max_bytes`` bytes."""
    return rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= max_bytes)


def stream(sample: DataFrame) -> Iterator:
    """The sample's rows on the driver, a partition at a time, in a fixed order."""
    return iter(sample.orderBy("doc_id", F.xxhash64("text")).toLocalIterator())
