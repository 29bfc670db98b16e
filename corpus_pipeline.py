"""The corpus pipeline: five stages over ``documents``, each written and read again by its successor.

Defined results: rows are judged by their texts, whatever their ids, so rows with a null id or with one that others carry too
stay or go one by one.  Null texts, and texts without a letter, go in the language stage, and with them the empty ones.  Equal
texts are copies: one row stays, the one of the smallest id (a null id only where no copy has one).  Columns beyond those of
``documents`` go with their rows up to the last stage, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontaminate, language, minhash, piece_bpe, toxicity
from tracewell.llm.common import scratch, stage, unstage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    return toxicity.keep(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    return language.keep(docs, language.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return minhash.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of a benchmark item or more go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every document left."""
    rows = piece_bpe.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_copies", drop_near_copies),
    ("benchmark_leaks", drop_benchmark_leaks),
    ("piece_encoding", encode_pieces),
]

#: Learned lexicons and filters, signatures and tilings are beyond SQL; tests hold brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what earlier stages wrote is deleted as soon as their successors have read it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        before = docs
        with scratch() as spare:
            docs = stage(step(spark, before, sf_dir), f"pipeline-{name}")
            spare(docs)
        unstage(before)
    return STAGES[-1][1](spark, docs, sf_dir)
