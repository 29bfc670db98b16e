"""Connected components over an edge table, without collecting any of it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import stage, unstage


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Each row's smallest reachable row, for links between rows 0 to n-1 of one block."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, left, label[right])
        np.minimum.at(label, right, label[left])
        label = label[label]
        if (label == before).all():
            return label


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has an edge.

    Each round every node takes the smallest label among its own and its neighbours', then
    the label of that label (which halves long chains).  It ends when no label changed; the
    labels live in staged tables, so a lost executor repeats one round at most.  Messages are
    pre-aggregated before they are shuffled, hence a node with very many neighbours is no
    heavier than any other.
    """
    both = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = both.union(both.select(F.col("other").alias("node"), F.col("node").alias("other")))
    both = stage(both.where("node != other").distinct(), "edges")
    labels = stage(both.groupBy("node").agg(F.min("other").alias("o")).select("node", F.least("node", "o").alias("component")), "labels")
    while True:
        heard = (
            both.join(labels.select(F.col("node").alias("other"), "component"), "other")
            .groupBy("node")
            .agg(F.min("component").alias("heard"))
        )
        met = labels.join(heard, "node").select("node", F.col("component").alias("was"), F.least("component", "heard").alias("met"))
        roots = labels.select(F.col("node").alias("met"), F.col("component").alias("root"))
        new = met.join(roots, "met").select("node", F.least("met", "root").alias("component"), (F.least("met", "root") != F.col("was")).alias("changed"))
        new = stage(new, "labels")
        unstage(labels)
        labels = new.select("node", "component")
        labels._staged_at = new._staged_at
        if new.where("changed").limit(1).count() == 0:
            unstage(both)
            return labels
