"""What lies downstream of some nodes of a directed graph, without a row for each pair on the way."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names in a batch and in a row that a task hands on.
BATCH, ROW = 200_000, 4096


class Descent:
    """A directed graph in memory that grows with its links, not with its pairs.

    Nodes are placed in the order in which a search leaves them, those of a cycle together, so all that it first meets below a node
    is a range of places, [base, top).  Only links that leave that range are kept, by the place that they start from; a forest has none.
    """

    def __init__(self, src: pa.ChunkedArray, dst: pa.ChunkedArray):
        names = pa.chunked_array([*src.chunks, *dst.chunks], pa.string()).unique()
        n = len(names)
        a, b = (pc.index_in(x, names).to_numpy() for x in (src, dst))
        order = np.argsort(a, kind="stable")
        starts, ends = np.searchsorted(a[order], np.arange(n + 1)).tolist(), b[order].tolist()
        place, base, top = [-1] * n, [0] * n, [0] * n
        seen, low, first, turn, held, done = [-1] * n, [0] * n, [0] * n, starts[:n], [], 0
        # Those that nothing leads to come first: then a tree is one range, from wherever its nodes are asked.
        met, count = np.bincount(b, minlength=n), 0
        for start in np.argsort(met > 0, kind="stable").tolist():
            path = [start] if seen[start] < 0 else []
            while path:
                v = path[-1]
                if seen[v] < 0:
                    seen[v] = low[v] = count
                    first[v], count = done, count + 1
                    held.append(v)
                if turn[v] < starts[v + 1]:
                    u = ends[turn[v]]
                    turn[v] += 1
                    if seen[u] < 0:
                        path.append(u)
                    elif place[u] < 0:
                        low[v] = min(low[v], seen[u])
                    continue
                path.pop()
                if path:
                    low[path[-1]] = min(low[path[-1]], low[v])
                if low[v] == seen[v]:
                    cycle = [held.pop()]
                    while cycle[-1] != v:
                        cycle.append(held.pop())
                    for u in cycle:
                        place[u], done = done, done + 1
                    for u in cycle:
                        base[u], top[u] = first[v], done
        self.place, self.base, self.top = (np.array(x, np.int64) for x in (place, base, top))
        self.ids, self.names = names, names.take(pa.array(np.argsort(self.place)))
        out = np.flatnonzero((self.place[b] < self.base[a]) | (self.place[b] >= self.top[a]))
        out = out[np.argsort(self.place[a[out]], kind="stable")]
        self.at, self.to_base, self.to_top = self.place[a[out]], self.base[b[out]], self.top[b[out]]

    def below(self, nodes: np.ndarray) -> np.ndarray:
        """Places of all that is reachable from any of the nodes, but for themselves."""
        held = np.zeros(len(self.names), bool)
        todo = list(zip(self.base[nodes].tolist(), self.top[nodes].tolist(), strict=True))
        while todo:
            lo, hi = todo.pop()
            if len(self.at):
                i, j = np.searchsorted(self.at, [lo, hi])
                new = i + np.flatnonzero(~held[self.at[i:j]])
                todo.extend(set(zip(self.to_base[new].tolist(), self.to_top[new].tolist(), strict=True)))
            held[lo:hi] = True
        held[self.place[nodes]] = False
        return np.flatnonzero(held)


def downstream(edges: DataFrame, groups: DataFrame, key: str, node: str, tasks: int = 1024) -> DataFrame:
    """(key, node): what is reachable along ``edges`` (src, dst) from each group's nodes, less these; groups without a key are told
    only each node's own way, so one of them that lies below another is given.

    The graph, as arrays, is sent to all tasks, whatever its size; each takes some of the groups and hands on what lies below them, so
    neither pairs nor results are written, shuffled or compared.
    """
    spark = edges.sparkSession
    links = edges.where("src IS NOT NULL AND dst IS NOT NULL").toArrow()
    graph = spark.sparkContext.broadcast(Descent(links["src"], links["dst"]))
    parts = min(tasks, 1 + links.num_rows // 128)

    def some(nodes: np.ndarray, whole: bool) -> np.ndarray:
        if whole:
            return graph.value.below(nodes)
        return np.unique(np.concatenate([graph.value.below(nodes[i : i + 1]) for i in range(len(nodes))] or [nodes]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, found, size = [], [], 0

        def batch() -> pa.RecordBatch:
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.ListArray.from_arrays(ends, graph.value.names.take(pa.array(np.concatenate(found))))], names=[key, node])

        for b in batches:
            lists = b.column(1)
            ids = pc.index_in(lists.flatten(), graph.value.ids)
            bounds = np.cumsum([0, *pc.list_value_length(lists).to_pylist()])
            for i, k in enumerate(b.column(0).to_pylist()):
                nodes = ids[bounds[i] : bounds[i + 1]].drop_null().to_numpy()
                places = some(nodes, k is not None) if len(nodes) else nodes
                for lo in range(0, len(places), ROW):
                    keys.append(k)
                    found.append(places[lo : lo + ROW])
                    size += len(found[-1])
                    if size >= BATCH:
                        yield batch()
                        keys, found, size = [], [], 0
        if found:
            yield batch()

    # Dealt by key into a set number of tasks, as what goes in is small and says little of what comes out.
    grouped = groups.select(key, node).repartition(parts, key).groupBy(key).agg(F.collect_set(node).alias(node))
    return grouped.mapInArrow(run, f"{key} string, {node} array<string>").select(key, F.explode(node).alias(node))
