"""Near-duplicate vectors by sorted projection passes.

Each pass draws random projections, cuts them into steps of three times the distance that the
similarity allows, and orders the vectors of a label lexicographically by the concatenated steps.
Vectors close to each other then tend to stand close together, so every vector is compared with
the next ``window`` ones only, in double precision.  Pairs verified in any pass are united.  The link
counts come from all pairs within groups: groups of up to ``wide`` + 1 different vectors in one
more pass, ordered by group, with a wide window; larger ones in cells of about ``block`` vectors,
each pair of cells a task.  Equal vectors are one class with a count, so copies are never compared.

The order is made by range partitioning; ranks cut it into blocks of a fixed size, each with the
first rows of the next as context.  Blocks are equally large whatever the data, and emit a
spanning forest of what they verified, not its pairs.

Defined results: vectors that are null, empty, zero or hold nulls or non-finite components, and
those with a null label, link with nothing and are their own component; vectors of different
lengths never link; a null id neither names a group nor is kept; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import maybe_broadcast, ranked, stage, unstage
from tracewell.llm.components import components, forest

PASSES = 12
HASHES = 16
BLOCK = 4096
WINDOW = 512
WIDE = 4096


def _segments(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of equal values."""
    n = len(columns[0])
    if n:
        new = np.zeros(n, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), n]
        yield from zip(cuts[:-1], cuts[1:], strict=True)


def near_pairs(x: np.ndarray, own: int, window: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with i < own, 0 < j - i <= window and cosine >= least; rows of ``x`` have length 1."""
    left, right = [], []
    step = 256
    for a in range(0, own, step):
        to = min(a + step, own)
        near = x[a:to] @ x[a : to + window].T >= least
        i, j = np.nonzero(near)
        keep = (j > i) & (j - i <= window)
        left.append(i[keep] + a)
        right.append(j[keep] + a)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def cell_pairs(rows: DataFrame, sizes: DataFrame, cell: int) -> DataFrame:
    """``rows`` (node, component, ...) of the components in ``sizes`` (component, members), dealt by hash into cells of
    about ``cell`` rows, with ``at``, their cell, once for each pair (i, j) of cells, i <= j, that theirs is part of."""
    cells = F.ceil(F.col("members") / cell)
    dealt = rows.join(maybe_broadcast(sizes), "component").withColumn("cells", cells).withColumn("at", F.pmod(F.xxhash64("node"), "cells"))
    facing = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("with"))
    return facing.select(*rows.columns, "at", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"))


def facing_links(table: pa.Table, least: float) -> pa.Table:
    """(node, links): the links of each row across a pair of cells, or within one."""
    node, copies, at = table["node"].to_numpy(), table["copies"].to_numpy().astype(np.float64), table["at"].to_numpy()
    two = np.flatnonzero(at == table["j"][0].as_py())
    one = np.flatnonzero(at != table["j"][0].as_py())
    within = table["i"][0].as_py() == table["j"][0].as_py()
    if within:
        one = two
    x = _matrix(table["v"], slice(0, len(node)))
    y = x[two]
    total = np.zeros(len(node))
    step = 256
    for a in range(0, len(one), step):
        rows = one[a : a + step]
        near = x[rows] @ y.T >= least
        if within:
            near &= np.arange(len(two)) > np.arange(a, a + len(rows))[:, None]
        near = near.astype(np.float64)
        total[rows] += near @ copies[two]
        total[two] += copies[rows] @ near
    return pa.table({"node": node, "links": total.astype(np.int64)})


def blocks(rows: DataFrame, order: list[str], block: int, window: int) -> DataFrame:
    """``rows`` with ``block``, ``rank`` and ``context``: every row in its own block, and the first
    ``window`` rows of a block also in the one before, as context."""
    ordered = ranked(rows, order)
    at = F.floor(F.col("rank") / block)
    # window <= block, so a row is context of at most one block
    copies = F.when((F.col("rank") % block < window) & (at > 0), F.array(at, at - 1)).otherwise(F.array(at))
    out = ordered.select("*", F.explode(copies).alias("block"))
    out = out.withColumn("context", F.col("block") != at)
    out._staged_at = ordered._staged_at
    return out


def _matrix(column: pa.ChunkedArray, rows: slice) -> np.ndarray:
    part = column.combine_chunks().slice(rows.start, rows.stop - rows.start)
    x = np.asarray(part.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(rows.stop - rows.start, -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("rank").combine_chunks()


def link(
    vectors: DataFrame,
    least: float = 0.98,
    passes: int = PASSES,
    window: int = WINDOW,
    wide: int = WIDE,
    block: int = BLOCK,
    seed: int = 7,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of ``vectors``."""
    usable = (
        F.col("label").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("v", lambda x: x != 0)
    )
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    rows = rows.withColumn("node", F.when(F.coalesce(usable, F.lit(False)), F.xxhash64("label", "v")))
    classes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("v").alias("v"))
    classes = stage(classes, "classes")
    label_type = classes.schema["label"].dataType.simpleString()
    step = 3 * math.sqrt(2 * (1 - least))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draws: dict[int, np.ndarray] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                vectors = pa.chunked_array([batch.column(2)])
                lengths = np.diff(batch.column(2).offsets.to_numpy())
                for a, b in _segments(lengths):
                    n = int(lengths[a])
                    if n not in draws:
                        draws[n] = np.random.default_rng([seed, n]).standard_normal((n, passes * HASHES))
                    shift = np.random.default_rng([seed, n, 1]).random(passes * HASHES)
                    cells = np.floor(_matrix(vectors, slice(a, b)) @ draws[n] / step + shift)
                    cells = np.clip(cells + 128, 0, 255).astype(np.uint8).reshape(b - a, passes, HASHES)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(batch.column(0).slice(a, b - a).to_numpy(), passes)),
                            batch.column(1).slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), passes))),
                            pa.array(np.full((b - a) * passes, n, np.int32)),
                            pa.array(np.tile(np.arange(passes, dtype=np.int32), b - a)),
                            pa.array([c.tobytes() for c in cells.reshape(-1, HASHES)], pa.binary()),
                        ],
                        names=["node", "label", "length", "pass", "key"],
                    )

    def verified(table: pa.Table) -> pa.Table:
        """A spanning forest of the links between a block's rows."""
        table = _sorted(table)
        node = table["node"].to_numpy()
        context = table["context"].to_numpy()
        found: list[np.ndarray] = []
        for a, b in _segments(*(table[c].to_numpy(zero_copy_only=False) for c in ("pass", "length", "label"))):
            own = int((~context[a:b]).sum())
            if own:
                left, right = near_pairs(_matrix(table["v"], slice(a, b)), own, window, least)
                if len(left):
                    root = forest(b - a, left, right)
                    i = np.flatnonzero(root != np.arange(b - a))
                    found.append(np.stack([node[a + root[i]], node[a + i]]))
        both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pa.table({"a": both[0], "b": both[1]})

    def counted(table: pa.Table) -> pa.Table:
        """Links of each row, as far as this block sees them: each pair is seen by one block."""
        table = _sorted(table)
        node, copies, context = table["node"].to_numpy(), table["copies"].to_numpy(), table["context"].to_numpy()
        total = np.zeros(len(node), np.int64)
        for a, b in _segments(table["component"].to_numpy()):
            own = int((~context[a:b]).sum())
            if own:
                left, right = near_pairs(_matrix(table["v"], slice(a, b)), own, wide, least)
                np.add.at(total, left + a, copies[right + a])
                np.add.at(total, right + a, copies[left + a])
        return pa.table({"node": node, "links": total})

    keyed = classes.select("node", "label", "v").mapInArrow(keys, f"node bigint, label {label_type}, length int, pass int, key binary")
    placed = blocks(keyed, ["pass", "length", "label", "key", "node"], block, window)
    facing = placed.select("node", "pass", "length", "label", "rank", "block", "context").join(classes.select("node", "v"), "node")
    links = facing.groupBy("block").applyInArrow(verified, "a bigint, b bigint")
    links = stage(links.distinct(), "links")
    unstage(placed)
    groups = components(links)

    grouped = stage(classes.select("node", "copies", "v").join(groups, "node"), "grouped")
    large = grouped.groupBy("component").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > wide + 1)
    large = stage(large, "large")
    across = cell_pairs(grouped, large, block).groupBy("component", "i", "j").applyInArrow(lambda t: facing_links(t, least), "node bigint, links bigint")
    tie = F.xxhash64("node")
    rest = grouped.join(maybe_broadcast(large), "component", "left_anti")
    placed = blocks(rest.select("node", "component", tie.alias("tie")), ["component", "tie", "node"], max(block, wide), wide)
    facing = placed.select("node", "component", "rank", "block", "context").join(grouped.select("node", "copies", "v"), "node")
    counts = facing.groupBy("block").applyInArrow(counted, "node bigint, links bigint")
    counts = stage(counts.union(across).groupBy("node").agg(F.sum("links").alias("links")), "counts")
    unstage(placed, grouped, large, links)

    named = classes.select("node", "id", "copies").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = named.join(names, "component").join(counts, "node", "left")
    named = stage(named.select("node", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "named")
    unstage(groups, counts, classes)
    out = [F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")]
    linked = rows.where("node IS NOT NULL").select("id", "node").join(named, "node").select(*out)
    alone = rows.where("node IS NULL").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")).select(*out)
    return linked.union(alone)
