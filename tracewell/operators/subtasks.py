"""Subtasks: units of work, their signals, similarity, clusters at three granularities, handoffs, duplicates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.joins import first_ids, gap_runs
from tracewell.staging import stage

#: The blend of signals, neighbours kept, and the resolutions of the three levels.
WEIGHTS = {"code": 0.35, "title": 0.25, "files": 0.15, "refs": 0.15, "chat": 0.10}
NEIGHBOURS = 6
LEVELS = {"coarse": 1.0, "medium": 3.0, "fine": 6.0}
COMMON_SHARE, COMMON_FACTOR = 0.30, 0.2
DUPLICATE_DAYS, DUPLICATES_KEPT = 3, 3
#: Units of a cell, and columns of terms held at a time, when units are compared with all others.
BLOCK, COLUMNS = 2048, 4096
#: Edges of one packed value, and nodes of small parts of a graph that are clustered together.
PACK, PART = 1 << 17, 4096


def session_units(records: DataFrame, actor: str = "agent_id", gap_ms: int = 1_800_000) -> DataFrame:
    """Work sessions as units: (unit, actor, start_ts, end_ts, n)."""
    rows = gap_runs(records.where(F.col("ts").isNotNull()), [actor], gap_ms)
    units = rows.groupBy(F.col(actor).alias("actor"), "run").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count(F.lit(1)).alias("n"))
    return units.select(F.concat_ws("#", "actor", F.col("run").cast("string")).alias("unit"), "actor", "start_ts", "end_ts", "n")


#: Words of code, and of titles, that tell nothing about the work.
CODE_STOP = """const let var function return import export from default class this new null undefined true false if else
for while switch case break continue typeof instanceof await async try catch throw finally length push map filter
reduce foreach join slice concat includes keys values entries object array string number math floor round min max
console log document element innerhtml classname style div span button id data type html css px rem test tests
assert equal strict deep describe should expect node the and with that are not has get set""".split()
TITLE_STOP = """feat fix fixes chore docs doc test tests add adds added adding update updates updated with and the for into
from to of in on a an by pr prs merge merged pull request requests new system systems module modules integration
integrate integrated integrating wire wired wiring implement implemented implementation support use using via all
its it this that is are be as or vs our we i you please review approve approved approval lgtm thanks thank looks
good can will now just also ready done check checked scan scanned clean here there let lets
im ive ill should would could has have had was were been more some any no not yes ok okay main branch commit
commits rebase rebased conflict conflicts day issue issues comprehensive core basic initial""".split()
#: What each line, import and file name of a change counts.
LINE_WEIGHT, FILE_WEIGHT, IMPORT_WEIGHT = 1, 2, 3


def stem(word: Column) -> Column:
    """A word without its plural ending, of which three letters must be left."""
    n = F.length(word)
    cut = lambda k, end: F.concat(F.substring(word, F.lit(1), n - k), F.lit(end))
    return F.when(word.endswith("ies") & (n >= 6), cut(3, "y")).when(word.endswith("ses") & (n >= 6), cut(3, "s")).when(word.endswith("s") & (n >= 4), cut(1, "")).otherwise(word)


def letter_words(text: Column) -> Column:
    """The lower-cased words, of three letters or more, of identifiers and prose, cut at case changes and all but letters."""
    spaced = F.regexp_replace(F.regexp_replace(text, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), "[^A-Za-z]+"), lambda w: F.length(w) > 2)


def title_terms(units: DataFrame, title: str = "title") -> DataFrame:
    """(signal, unit, term) of a title's words, stemmed, without addresses, numbers of issues, a leading kind and empty words."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(title), r"https?://\S+", " "), r"#\d+", " "), r"^\s*\w+(\([^)]*\))?:\s*", "")
    words = F.transform(F.filter(letter_words(plain), lambda w: ~w.isin(*TITLE_STOP)), stem)
    return units.select(F.lit("title").alias("signal"), "unit", F.explode(words).alias("term"))


def file_words(path: Column) -> Column:
    """The stemmed words of a path's last part, without its ending."""
    base = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.(m?js|ts|json|md|css|html)$", "")
    return F.transform(F.filter(letter_words(base), lambda w: ~w.isin("test", "tests", "index", "spec")), stem)


def code_terms(changes: DataFrame) -> DataFrame:
    """(signal, unit, term), with repetitions, of what units added: words of identifiers in added lines once, of file names twice, of newly
    imported targets three times.  ``changes`` is (unit, artifact, lines, imports); a target that a unit imports again counts once."""
    idents = lambda line: F.regexp_extract_all(line, F.lit("[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0))
    lines = changes.select("unit", F.explode("lines").alias("line")).select("unit", F.explode(idents(F.col("line"))).alias("ident"))
    lines = lines.select("unit", F.explode(F.transform(F.filter(letter_words(F.col("ident")), lambda w: ~w.isin(*CODE_STOP)), stem)).alias("term"), F.lit(LINE_WEIGHT).alias("n"))
    files = changes.select("unit", F.explode(file_words(F.col("artifact"))).alias("term"), F.lit(FILE_WEIGHT).alias("n"))
    targets = changes.select("unit", F.explode("imports").alias("target")).distinct()
    imports = targets.select("unit", F.explode(file_words(F.col("target"))).alias("term"), F.lit(IMPORT_WEIGHT).alias("n"))
    every = lines.union(files).union(imports)
    return every.select(F.lit("code").alias("signal"), "unit", "term", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int")))).drop("col")


def tf_idf(terms: DataFrame) -> DataFrame:
    """(signal, unit, term, weight): (1 + ln n) * idf, terms of over 30 % of a signal's units damped, each unit's
    vector of length 1.  ``terms`` is (signal, unit, term), with repetitions."""
    counts = terms.groupBy("signal", "unit", "term").agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.groupBy("signal").agg(F.countDistinct("unit").alias("n"))
    df = counts.groupBy("signal", "term").agg(F.count(F.lit(1)).alias("df"))
    both = counts.join(df, ["signal", "term"]).join(F.broadcast(sizes), "signal")  # five signals at most
    idf = F.ln((1 + F.col("n")) / (1 + F.col("df"))) + 1
    raw = (1 + F.ln("c")) * idf * F.when(F.col("df") > COMMON_SHARE * F.col("n"), COMMON_FACTOR).otherwise(1.0)
    weighed = both.withColumn("raw", raw)
    norms = weighed.groupBy("signal", "unit").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return weighed.join(norms, ["signal", "unit"]).select("signal", "unit", "term", (F.col("raw") / F.col("norm")).alias("weight"), "df")


def _product(terms: pa.ChunkedArray, weights: pa.ChunkedArray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The dot products of the rows ``one`` with the rows ``two``, some columns of the terms at a time."""
    terms, weights = terms.combine_chunks(), weights.combine_chunks()
    owner = np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy()))
    words = terms.flatten().dictionary_encode()
    code, value = words.indices.to_numpy(), weights.flatten().to_numpy()
    place = np.full((2, len(terms)), -1)
    place[0, one], place[1, two] = np.arange(len(one)), np.arange(len(two))
    out = np.zeros((len(one), len(two)))
    for start in range(0, len(words.dictionary), COLUMNS):
        dense = []
        for at, n in zip(place, (len(one), len(two)), strict=True):
            here = (code >= start) & (code < start + COLUMNS) & (at[owner] >= 0)
            m = np.zeros((n, min(COLUMNS, len(words.dictionary) - start)))
            m[at[owner[here]], code[here] - start] = value[here]
            dense.append(m)
        out += dense[0] @ dense[1].T
    return out


def _best(sim: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's ``k`` largest positive values; ties by column."""
    sim = np.round(sim, 9)
    least = np.partition(sim, -k, axis=1)[:, -k] if sim.shape[1] > k else np.zeros(len(sim))
    row, col = np.nonzero((sim >= least[:, None]) & (sim > 0))
    order = np.lexsort((col, -sim[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, row)
    return row[np.arange(len(row)) - first < k], col[np.arange(len(row)) - first < k]


def _facing(vectors: DataFrame, block: int, choose: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(signal, a, b, sim), a < b, of the pairs that ``choose`` takes from the similarities of two cells of units.  Units
    are dealt by hash into cells of about ``block``, and each pair of cells, or cell with itself, is a task."""
    rows = vectors.where("unit IS NOT NULL AND term IS NOT NULL").groupBy("signal", "unit").agg(F.collect_list(F.struct("term", "weight")).alias("t"))
    cells = rows.groupBy("signal").agg(F.ceil(F.count(F.lit(1)) / block).alias("cells"))
    dealt = rows.join(F.broadcast(cells), "signal").withColumn("at", F.pmod(F.xxhash64("unit"), "cells"))  # five signals at most
    facing = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)).alias("with"))
    facing = facing.select("signal", "unit", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights"), "at", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("unit").combine_chunks()
        at, j = table["at"].to_numpy(), table["j"][0].as_py()
        two = np.flatnonzero(at == j)
        one = two if table["i"][0].as_py() == j else np.flatnonzero(at != j)
        sim = _product(table["terms"], table["weights"], one, two)
        if one is two:
            np.fill_diagonal(sim, 0)
        row, col = choose(sim)
        pairs = np.stack([one[row], two[col], row, col])
        pairs[:2].sort(axis=0)
        pairs = pairs[:, np.unique(pairs[0] * len(at) + pairs[1], return_index=True)[1]]
        unit = table["unit"]
        return pa.table({"signal": table["signal"].take(pairs[0]), "a": unit.take(pairs[0]), "b": unit.take(pairs[1]), "sim": sim[pairs[2], pairs[3]]})

    kind = vectors.schema["unit"].dataType.simpleString()
    return facing.groupBy("signal", "i", "j").applyInArrow(run, f"signal string, a {kind}, b {kind}, sim double")


def similarity(vectors: DataFrame, least: float = 1e-6, block: int = BLOCK) -> DataFrame:
    """(signal, a, b, sim) of all units that share a term, a < b.  Nearly every pair may do so: for the nearest
    alone there is ``nearest``."""
    return _facing(vectors, block, lambda sim: np.nonzero(sim >= least))


def nearest(vectors: DataFrame, k: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """(signal, a, b, sim), a < b: the pairs of which one is among the other's ``k`` nearest of all units (ties by id).

    Units of equal vectors are one class and are compared once: a unit's nearest are among the ``k + 1`` least ids of the ``k + 1`` nearest
    classes, its own included, so what is compared grows with the square of different vectors, not of units.
    """
    listed = vectors.where("unit IS NOT NULL AND term IS NOT NULL").groupBy("signal", "unit").agg(F.array_sort(F.collect_list(F.struct("term", "weight"))).alias("t"))
    # Weights that differ by the order of a sum only are equal; were they not, the results would be the same from more classes.
    key = F.sha2(F.to_json(F.transform("t", lambda x: F.struct(x["term"], F.round(x["weight"], 12).alias("w")))), 256)
    units = stage(listed.select("signal", "unit", key.alias("class"), "t"), "units")
    least = first_ids(units, ["signal", "class"], k + 1, "unit", "unit")
    heads = stage(units.select("signal", F.col("unit").alias("head"), "class", "t").join(least, ["signal", "class"]).where("head = ids[0]"), "heads")

    def choose(sim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        row, col = _best(sim, k + 1)
        other, own = _best(sim.T, k + 1)
        return np.concatenate([row, own]), np.concatenate([col, other])

    pairs = _facing(heads.select("signal", F.col("head").alias("unit"), F.explode("t").alias("x")).select("signal", "unit", "x.*"), block, choose)
    own = heads.select("signal", F.col("head").alias("a"), F.col("head").alias("b"), F.aggregate("t", F.lit(0.0), lambda acc, x: acc + x["weight"] * x["weight"]).alias("sim")).where("sim > 0")
    ways = pairs.union(pairs.select("signal", F.col("b").alias("a"), F.col("a").alias("b"), "sim")).union(own)
    first = lambda rows, by: rows.withColumn("at", F.row_number().over(Window.partitionBy("signal", "a").orderBy(F.desc(F.round("sim", 9)), by))).where(F.col("at") <= k + 1).drop("at")
    named = first(ways, "b").join(heads.select("signal", F.col("head").alias("b"), "ids"), ["signal", "b"])
    near = first(named.select("signal", "a", F.explode("ids").alias("n"), "sim"), "n")
    lists = near.groupBy("signal", F.col("a").alias("head")).agg(F.array_sort(F.collect_list(F.struct((-F.round("sim", 9)).alias("o"), "n", "sim"))).alias("near"))
    classes = heads.select("signal", "class", "head").join(lists.select("signal", "head", "near"), ["signal", "head"])
    each = units.select("signal", "unit", "class").join(classes.select("signal", "class", "near"), ["signal", "class"])
    # A unit's own list is its class's without itself.
    mine = F.slice(F.filter("near", lambda x: x["n"] != F.col("unit")), 1, k)
    out = each.select("signal", "unit", F.explode(mine).alias("x")).select("signal", F.least("unit", "x.n").alias("a"), F.greatest("unit", "x.n").alias("b"), "x.sim")
    return out.groupBy("signal", "a", "b").agg(F.max("sim").alias("sim"))


def reference_similarity(counts: DataFrame) -> DataFrame:
    """(signal, a, b, sim) from (a, b, r) reference counts: r / (r + 2)."""
    both = counts.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "r").where("a <> b").groupBy("a", "b").agg(F.sum("r").alias("r"))
    return both.select(F.lit("refs").alias("signal"), "a", "b", (F.col("r") / (F.col("r") + 2)).alias("sim"))


def blend(similarities: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(a, b, sim): the weighted sum over signals."""
    table = F.create_map(*[F.lit(x) for pair in (weights or WEIGHTS).items() for x in pair])
    return similarities.groupBy("a", "b").agg(F.sum(F.col("sim") * F.coalesce(F.try_element_at(table, F.col("signal")), F.lit(0.0))).alias("sim"))


def neighbours(sims: DataFrame, k: int = NEIGHBOURS, least: float = 0.0) -> DataFrame:
    """(a, b, sim) with a < b of pairs of which one is among the other's ``k`` nearest (ties by id)."""
    both = sims.select("a", "b", "sim").union(sims.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")).where(F.col("sim") > least)
    at = F.row_number().over(Window.partitionBy("a").orderBy(F.desc(F.round("sim", 9)), "b"))
    near = both.withColumn("at", at).where(F.col("at") <= k)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").distinct()


def _parts(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Each node's part of the graph, named by its smallest node.  Roots hook on to smaller roots until no link joins two."""
    label = np.arange(n)
    while True:
        one, two = label[a], label[b]
        apart = one != two
        if not apart.any():
            return label
        np.minimum.at(label, np.maximum(one, two)[apart], np.minimum(one, two)[apart])
        up = label[label]
        while (up != label).any():
            label, up = up, up[up]


def _merged(src: np.ndarray, dst: np.ndarray, w: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links between ``n`` nodes, each once, by source and then as they were first met."""
    key, first, at = np.unique(src * n + dst, return_index=True, return_inverse=True)
    order = np.lexsort((first, key // n))
    return (key // n)[order], (key % n)[order], np.bincount(at, w)[order]


def _communities(n: int, src: np.ndarray, dst: np.ndarray, w: np.ndarray, total: float, resolution: float) -> np.ndarray:
    """The community of each of ``n`` nodes.  Links are given both ways, ordered by source; ``total`` is their weight in the whole graph."""
    member = np.arange(n)
    while True:
        ends = np.searchsorted(src, np.arange(n + 1)).tolist()
        degree = np.bincount(src, w, n).tolist()
        home, weight = list(range(n)), degree.copy()
        moved_any = False
        for _ in range(100):
            moved = False
            for i in range(n):
                d, h, lo, hi = degree[i], home[i], ends[i], ends[i + 1]
                near: dict[int, float] = {}
                for m, x in zip(dst[lo:hi].tolist(), w[lo:hi].tolist(), strict=True):
                    if m != i:
                        c = home[m]
                        near[c] = near.get(c, 0.0) + x
                weight[h] -= d
                best, most = h, round(near.pop(h, 0.0) - resolution * d * weight[h] / total, 12)
                for c, x in near.items():
                    gain = round(x - resolution * d * weight[c] / total, 12)
                    if gain > most or (gain == most and best != h and c < best):
                        best, most = c, gain
                weight[best] += d
                if best != h:
                    home[i] = best
                    moved = moved_any = True
            if not moved:
                break
        if not moved_any:
            return member
        kept, place = np.unique(home, return_inverse=True)
        member = place[member]
        src, dst, w = _merged(place[src], place[dst], w, len(kept))
        n = len(kept)


def _louvain(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, resolution: float) -> np.ndarray:
    """The community of each node, numbered by their first nodes.  No community reaches beyond a part of the graph and no part's moves
    change another's, so a part, or some small ones, are worked on at a time."""
    part = _parts(n, a, b)
    by_part = np.argsort(part, kind="stable")
    place = np.empty(n, np.int64)
    place[by_part] = np.arange(n)
    a, b = place[a], place[b]
    order = np.argsort(a * n + b, kind="stable")
    a, b, w = a[order].astype(np.int32), b[order].astype(np.int32), w[order]
    total = 2 * float(w.sum())
    found = np.arange(n)
    starts = np.flatnonzero(np.diff(part[by_part], prepend=-1))
    ends = np.append(starts[1:], n)
    lo = 0
    while lo < n and total:
        # The parts that begin within so many nodes.
        hi = ends[np.searchsorted(starts, lo + PART, side="left") - 1]
        e = slice(*np.searchsorted(a, [lo, hi]))
        src, dst = np.stack([a[e], b[e]]).T.ravel().astype(np.int64) - lo, np.stack([b[e], a[e]]).T.ravel().astype(np.int64) - lo
        by_src = np.argsort(src, kind="stable")
        found[lo:hi] = lo + _communities(hi - lo, src[by_src], dst[by_src], np.repeat(w[e], 2)[by_src], total, resolution)
        lo = hi
    _, first, at = np.unique(found[place], return_index=True, return_inverse=True)
    return np.argsort(np.argsort(first))[at]


def louvain(edges: list[tuple[str, str, float]], resolution: float) -> dict[str, int]:
    """Greedy modularity: nodes in order of name move to the neighbouring community of largest gain (ties: the
    smallest), communities become nodes, until nothing moves.  Deterministic by construction."""
    names = sorted({n for a, b, _ in edges for n in (a, b)})
    number = {n: i for i, n in enumerate(names)}
    a, b = (np.array([number[e[i]] for e in edges], np.int64) for i in (0, 1))
    got = _louvain(len(names), a, b, np.array([w for _, _, w in edges], float), resolution)
    return dict(zip(names, got.tolist(), strict=True))


def clusters(edges: DataFrame, levels: dict[str, float] | None = None, method: str = "method") -> DataFrame:
    """(method, level, unit, cluster): one task per method and level.  The graph has at most k edges a unit; it travels packed, in
    a few bytes an edge, and a task holds it as arrays."""
    rows = edges if method in edges.columns else edges.withColumn(method, F.lit("blend"))
    pairs = [F.struct(F.lit(k).alias("level"), F.lit(float(v)).alias("resolution")) for k, v in (levels or LEVELS).items()]
    packed = rows.select(F.col(method).alias("method"), F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("sim").cast("double").alias("sim")).mapInArrow(_packed, "method string, edges binary")
    tasks = packed.select("method", F.explode(F.array(*pairs)).alias("l"), "edges").select("method", "l.level", "l.resolution", "edges")

    def run(part: pa.Table) -> pa.Table:
        method, level, resolution = (part[c][0].as_py() for c in ("method", "level", "resolution"))
        held = pa.concat_tables(pa.ipc.open_stream(x.as_buffer()).read_all() for x in part["edges"])
        names = pc.unique(pa.chunked_array([*held["a"].chunks, *held["b"].chunks]))
        names = names.take(pc.sort_indices(names))
        a, b = (pc.index_in(held[c], value_set=names).to_numpy() for c in ("a", "b"))
        w = held["sim"].to_numpy()
        del held
        got = _louvain(len(names), a, b, w, resolution)
        return pa.table({"method": pa.repeat(pa.scalar(method, pa.string()), len(names)), "level": pa.repeat(level, len(names)), "unit": names, "cluster": pa.array(got, pa.int32())})

    return tasks.groupBy("method", "level").applyInArrow(run, "method string, level string, unit string, cluster int")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(method, edges) of (method, a, b, sim): some edges of a method in one compressed value."""
    held: list[pa.RecordBatch] = []

    def out() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).sort_by([("method", "ascending"), ("a", "ascending")])
        for method in pc.unique(table["method"]):
            sink = pa.BufferOutputStream()
            mine = table.filter(pc.equal(table["method"], method) if method.is_valid else pc.is_null(table["method"])).select(["a", "b", "sim"])
            with pa.ipc.new_stream(sink, mine.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(mine.combine_chunks())
            yield pa.RecordBatch.from_arrays([pa.array([method.as_py()], pa.string()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["method", "edges"])

    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= PACK:
            yield from out()
            held.clear()
    if any(x.num_rows for x in held):
        yield from out()


def parents(assigned: DataFrame, child: str, parent: str) -> DataFrame:
    """(cluster, parent): for each cluster of one level the cluster of a coarser one that holds most of its units."""
    a = assigned.where(F.col("level") == child).select("unit", F.col("cluster").alias("c"))
    b = assigned.where(F.col("level") == parent).select("unit", F.col("cluster").alias("p"))
    n = a.join(b, "unit").groupBy("c", "p").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("c").agg(F.max_by("p", F.struct("n", (-F.col("p")).alias("o"))).alias("parent")).select(F.col("c").alias("cluster"), "parent")


def membership_key(assigned: DataFrame) -> DataFrame:
    """(level, cluster, key): a hash of the sorted members, under which a cluster's name is kept."""
    return assigned.groupBy("level", "cluster").agg(F.md5(F.array_join(F.array_sort(F.collect_set("unit")), "\n").cast("binary")).alias("key"), F.count(F.lit(1)).alias("units"))


def handoffs(touches: DataFrame, units: DataFrame, hub_share: float = 0.08, hub_least: int = 4) -> DataFrame:
    """(src, dst, kind, artifacts): a unit builds on the first creator of an artifact it modifies, integrates what
    it reads, and tests or fixes what its title says.  Artifacts that too many units touch are hubs and link nothing.

    ``touches`` is (unit, artifact, op, ts); ``units`` is (unit, actor, title, ...).
    """
    n = units.agg(F.greatest(F.lit(hub_least).cast("double"), hub_share * F.count(F.lit(1))).alias("most"))
    per = touches.groupBy("artifact").agg(F.countDistinct("unit").alias("u"), F.min_by("unit", F.struct("ts", "unit")).alias("src"))
    usable = per.crossJoin(F.broadcast(n)).where(F.col("u") <= F.col("most")).select("artifact", "src")  # one row
    later = touches.join(usable, "artifact").where(F.col("unit") != F.col("src"))
    title = F.lower(F.coalesce("title", F.lit("")))
    both = later.join(units.select("unit", title.alias("title")), "unit", "left")
    kind = F.when(F.col("title").rlike(r"\btest"), "tests").when(F.col("title").rlike(r"\b(fix|bug|repair)"), "fixes").when(F.col("op").isin("modify", "delete"), "builds_on").otherwise("integrates")
    rank = F.when(kind == "fixes", 1).when(kind == "tests", 2).when(kind == "builds_on", 3).otherwise(4)
    return both.withColumn("kind", kind).withColumn("rank", rank).groupBy("src", F.col("unit").alias("dst")).agg(F.min_by("kind", "rank").alias("kind"), F.countDistinct("artifact").alias("artifacts"))


def duplicates(sims: DataFrame, units: DataFrame, linked: DataFrame, least: float = 0.5) -> DataFrame:
    """(later, earlier, score): units by different actors, not linked, begun within three days, whose titles and code
    are alike; the three best per later unit.  ``sims`` is (signal, a, b, sim)."""
    part = lambda s: F.max(F.when(F.col("signal") == s, F.col("sim")))
    score = 0.6 * F.coalesce(part("title"), F.lit(0.0)) + 0.4 * F.coalesce(part("code"), F.lit(0.0))
    pairs = sims.groupBy("a", "b").agg(score.alias("score")).where(F.col("score") > least)
    u = units.select("unit", "actor", "start_ts")
    both = pairs.join(u.toDF("a", "actor_a", "start_a"), "a").join(u.toDF("b", "actor_b", "start_b"), "b")
    near = both.where((F.col("actor_a") != F.col("actor_b")) & (F.abs(F.unix_micros(F.col("start_a").cast("timestamp")) - F.unix_micros(F.col("start_b").cast("timestamp"))) < DUPLICATE_DAYS * 86_400_000_000))
    first = F.struct("start_a", "a") <= F.struct(F.col("start_b").alias("start_a"), F.col("b").alias("a"))
    named = near.select(F.when(first, F.col("b")).otherwise(F.col("a")).alias("later"), F.when(first, F.col("a")).otherwise(F.col("b")).alias("earlier"), "score")
    free = named.join(linked.select(F.col("src").alias("earlier"), F.col("dst").alias("later")), ["earlier", "later"], "left_anti")
    at = F.row_number().over(Window.partitionBy("later").orderBy(F.desc(F.round("score", 9)), "earlier"))
    return free.withColumn("at", at).where(F.col("at") <= DUPLICATES_KEPT).drop("at")


def cohesion(assigned: DataFrame, sims: DataFrame) -> DataFrame:
    """(level, cluster, cohesion): the mean similarity of linked pairs inside a cluster."""
    a = assigned.select("level", F.col("unit").alias("a"), "cluster")
    b = assigned.select("level", F.col("unit").alias("b"), F.col("cluster").alias("other"))
    return sims.join(a, "a").join(b, ["level", "b"]).where("cluster = other").groupBy("level", "cluster").agg(F.avg("sim").alias("cohesion"))


def cluster_links(assigned: DataFrame, handed: DataFrame) -> DataFrame:
    """(level, src, dst, n): handoffs between clusters."""
    a = assigned.select("level", F.col("unit").alias("src"), F.col("cluster").alias("c"))
    b = assigned.select("level", F.col("unit").alias("dst"), F.col("cluster").alias("d"))
    both = handed.join(a, "src").join(b, ["level", "dst"]).where("c <> d")
    return both.groupBy("level", F.col("c").alias("src"), F.col("d").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def stages(links: list[tuple[int, int]]) -> dict[int, int]:
    """The stage of each cluster: strongly connected ones share a stage, others come after all that feed them."""
    nodes = sorted({n for e in links for n in e})
    out: dict[int, list[int]] = {n: [] for n in nodes}
    back: dict[int, list[int]] = {n: [] for n in nodes}
    for a, b in links:
        out[a].append(b)
        back[b].append(a)
    order, seen = [], set()
    for root in nodes:  # finishing order, without recursion
        todo = [(root, iter(out[root]))] if root not in seen else []
        seen.add(root)
        while todo:
            node, it = todo[-1]
            nxt = next((m for m in it if m not in seen), None)
            if nxt is None:
                order.append(node)
                todo.pop()
            else:
                seen.add(nxt)
                todo.append((nxt, iter(out[nxt])))
    group: dict[int, int] = {}
    for root in reversed(order):
        todo = [root] if root not in group else []
        while todo:
            node = todo.pop()
            if node not in group:
                group[node] = root
                todo += [m for m in back[node] if m not in group]
    stage = dict.fromkeys(group.values(), 0)
    for node in reversed(order):
        for m in out[node]:
            if group[m] != group[node]:
                stage[group[m]] = max(stage[group[m]], stage[group[node]] + 1)
    for _ in stage:  # groups may be visited before those that feed them
        before = dict(stage)
        for a, b in links:
            if group[a] != group[b]:
                stage[group[b]] = max(stage[group[b]], stage[group[a]] + 1)
        if stage == before:
            break
    return {n: stage[group[n]] for n in nodes}


def mention_signals(units: DataFrame, messages: DataFrame, text: str = "content") -> tuple[DataFrame, DataFrame]:
    """(chat terms, references) from messages that name units by their key (a word such as ``#12``).

    A message that names exactly one unit lends it its words; one that names two to four makes each
    pair refer to the other once.  ``units`` is (unit, key).
    """
    words = messages.select("evidence_id", F.explode(F.array_distinct(F.split(F.lower(text), r"[\s,;()\[\]]+"))).alias("key"))
    named = words.join(units.select("unit", F.lower("key").alias("key")), "key").select("evidence_id", "unit").distinct()
    sizes = named.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("n"))
    one = named.join(sizes.where("n = 1"), "evidence_id").join(messages.select("evidence_id", text), "evidence_id")
    chat = one.select(F.lit("chat").alias("signal"), "unit", F.explode(F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: F.length(w) > 2)).alias("term"))
    few = named.join(sizes.where("n BETWEEN 2 AND 4"), "evidence_id").select("evidence_id", "unit")  # at most six pairs a message
    pairs = few.select("evidence_id", F.col("unit").alias("a")).join(few.select("evidence_id", F.col("unit").alias("b")), "evidence_id").where("a < b")
    return chat, pairs.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("r"))


def file_terms(touches: DataFrame) -> DataFrame:
    """(signal, unit, term): the files a unit touched, and the folders that hold them."""
    path = F.split("artifact", "/")
    folders = F.when(F.size(path) > 1, F.transform(F.sequence(F.lit(1), F.size(path) - 1), lambda i: F.concat(F.array_join(F.slice(path, 1, i), "/"), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    return touches.select(F.lit("files").alias("signal"), "unit", F.explode(F.concat(F.array("artifact"), folders)).alias("term"))


def clean_title(title: Column) -> Column:
    """A title without ticket numbers, prefixes such as ``fix(core):``, bracketed marks and a final stop; the first letter upper case."""
    out = F.regexp_replace(title, r"\s*\(?#\d+\)?|\[[^\]]*\]", "")
    out = F.regexp_replace(out, r"^(?i)(?:feat|fix|chore|docs|refactor|test|build|ci|wip)(?:\([^)]*\))?!?:\s*", "")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"\s+", " "), r"[.\s]+$", ""))
    return F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1 << 20))


def founders(assigned: DataFrame, units: DataFrame) -> DataFrame:
    """(level, cluster, unit, name): the first unit of each cluster, whose cleaned title names it."""
    both = assigned.join(units.select("unit", "title", "start_ts"), "unit")
    first = both.groupBy("level", "cluster").agg(F.min(F.struct(F.col("start_ts").isNull().alias("late"), "start_ts", "unit", "title")).alias("f"))
    return first.select("level", "cluster", "f.unit", clean_title(F.col("f.title")).alias("name"))


def keywords(assigned: DataFrame, vectors: DataFrame, top: int = 5) -> DataFrame:
    """(level, cluster, words): the terms of most weight in a cluster's titles."""
    sums = assigned.join(vectors.where("signal = 'title'"), "unit").groupBy("level", "cluster", "term").agg(F.sum("weight").alias("w"))
    at = F.row_number().over(Window.partitionBy("level", "cluster").orderBy(F.desc(F.round("w", 9)), "term"))
    best = sums.withColumn("at", at).where(F.col("at") <= top)
    return best.groupBy("level", "cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "term"))), lambda x: x["term"]).alias("words"))


def centrality(edges: DataFrame) -> DataFrame:
    """(unit, strength): the sum of a unit's similarities to its neighbours."""
    both = edges.select(F.col("a").alias("unit"), "sim").union(edges.select("b", "sim"))
    return both.groupBy("unit").agg(F.sum("sim").alias("strength"))
