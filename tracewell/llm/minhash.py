"""Near-duplicate documents: SuperMinHash signatures, banding, exact verification, grouping.

A document's set holds the 64-bit hashes of its distinct five-word shingles.  SuperMinHash
gives element e, for each level j = 0, 1, ..., a slot p_e[j] (a random permutation, drawn step
by step) and a rank j + r with r in [0, 1); a slot's value is the least rank that fell into
it.  Ranks of one element are correlated through the permutation, which lowers the variance,
and levels past the one at which every slot is filled cannot change anything, so the
work stops there: one level for a long document.

Flow, every step linear in what it reads:

1. documents -> (128-bit digest of the whole set, band keys), one pass; equal sets become one class;
2. band keys shared by two classes or more make buckets.  A bucket never emits its pairs:
   each member is paired with one centre only, the member that shares most with others;
3. pairs are verified on full sets (100 * intersection >= 75 * union), then grouped;
4. buckets whose members are still in several groups are taken up again: small ones list their
   pairs across groups, crowded ones are compared in blocks.  So no link between candidates is
   lost, and pairs within a group are never listed;
5. groups are mapped back to documents.

128 values in 32 bands of 4 miss a pair of similarity 0.75 with probability 6e-6.

Defined results: null and blank texts have an empty set and are linked with nothing; rows
with fewer than five words have their whole sequence as one shingle; repeated rows are
equal sets; a null id neither names a group nor is kept; an empty table gives an empty
table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import ROW, drop_ids, maybe_broadcast, numbered, ranked, slices, small, small_batches, stage, unstage
from tracewell.llm.components import components, forest

WIDTH = 5
BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
PERCENT = 75
#: Buckets of at most so many open members list their pairs; larger ones are compared in blocks.
FEW = 16
BLOCK = 512
#: Pairs of one node that are verified together.
PARTNERS = 256
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_VOCABULARY = 100_000


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Hashes of shingles, with a bounded table of the words' hashes."""

    def __init__(self, width: int = WIDTH):
        self.width = width
        self.known: dict[bytes, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        """A hash per word; bytes.lower and bytes.split know ASCII only, as asked for."""
        if not text:
            return np.zeros(0, np.uint64)
        words = text.encode("utf-8", "surrogatepass").lower().split()
        known = self.known
        if len(known) > _VOCABULARY:
            known.clear()
        for w in set(words):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        return np.array([known[w] for w in words], np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        """Sorted distinct shingle hashes."""
        words = self.words(text)
        n = len(words)
        if not n:
            return words
        k = min(self.width, n)
        out = np.full(n - k + 1, k, np.uint64)
        for i in range(k):
            out = mix((out + _GOLD) ^ words[i : n - k + 1 + i])
        return np.unique(out)


def signature(elements: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """The SuperMinHash of a non-empty set: per slot, level (high byte) and 56 bits of rank."""
    n = len(elements)
    best = np.full(slots, np.uint64(0xFFFFFFFFFFFFFFFF))
    seeds = elements
    perm = None
    for level in range(slots):
        seeds = seeds + _GOLD
        draw = mix(seeds)
        at = level + ((draw >> np.uint64(32)) * np.uint64(slots - level) >> np.uint64(32)).astype(np.int64)
        if level == 0:
            slot = at
        else:
            if perm is None:  # the first level swapped place 0 with place `first`
                perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (n, 1))
                rows = np.arange(n)
                perm[rows, first] = 0
                perm[:, 0] = first
            slot = perm[rows, at].astype(np.int64)
            perm[rows, at] = perm[:, level]
            perm[:, level] = slot
        if level == 0:
            first = at
        rank = np.uint64(level << 56) | (mix(draw ^ _M2) >> np.uint64(8))
        np.minimum.at(best, slot, rank)
        if (best < np.uint64((level + 1) << 56)).all():
            break
    return best


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = sig.reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows):
        out = mix((out + _GOLD) ^ parts[:, i])
    return out.view(np.int64)


def sketch(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, digest, keys): ``digest``, of 128 bits, stands for the whole set (null if it is empty)."""
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for whole in batches:
            for batch in slices(whole):
                counts, digests, keys = [], [], []
                for text in batch.column(1).to_pylist():
                    s = shingler.shingles(text)
                    counts.append(len(s))
                    digests.append(xxhash.xxh128_digest(s) if len(s) else None)
                    keys.append(band_keys(signature(s)) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=[id_col, "n_shingles", "digest", "keys"],
                )

    return small_batches(documents).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, n_shingles bigint, digest binary, keys array<bigint>")


def sets_of(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, elements) of the ``wanted`` (node, digest, doc_id): texts are read again, sets built once.  A node without an id
    is looked for among the texts without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for whole in batches:
            for batch in slices(whole, 2):
                sets = [shingler.shingles(t).view(np.int64) for t in batch.column(2).to_pylist()]
                digests = [xxhash.xxh128_digest(s) if len(s) else None for s in sets]
                # An id may carry other texts too; only the node's own set counts.
                own = [i for i, (has, wants) in enumerate(zip(digests, batch.column(1).to_pylist(), strict=True)) if wants in (None, has)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(own, pa.int64())), pa.array([digests[i] for i in own], pa.binary()), pa.array([sets[i] for i in own], pa.list_(pa.int64()))],
                    names=["node", "digest", "elements"],
                )

    schema = "node bigint, digest binary, elements array<bigint>"
    nameless = documents.where("doc_id IS NULL").select(F.lit(None).cast("long").alias("node"), F.lit(None).cast("binary").alias("digest"), "text")
    nameless = small_batches(nameless).mapInArrow(run, schema).select("digest", "elements")
    nameless = nameless.join(wanted.where("doc_id IS NULL").select("digest", "node"), "digest").select("node", "elements")
    if small(wanted):
        wanted = F.broadcast(wanted)
    rows = documents.select("doc_id", "text").join(wanted, "doc_id").select("node", "digest", "text")
    named = small_batches(rows).mapInArrow(run, schema).select("node", "elements")
    return named.union(nameless).dropDuplicates(["node"])  # the same text twice under one id


def _with_set(rows: DataFrame, pairs: DataFrame, sets: DataFrame, side: str, other: str) -> DataFrame:
    """``rows`` of the ``pairs`` with the set of each ``side``.  A node with many partners is the work of many tasks: its pairs are
    dealt by the partner into parts of about PARTNERS, and its set is copied to each part."""
    parts = pairs.groupBy(F.col(side).alias("node")).agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("parts")).where("parts > 1")
    parts = maybe_broadcast(parts)
    copied = sets.join(parts, "node", "left").select(
        F.col("node").alias(side), F.col("elements").alias(f"of_{side}"), F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    )
    dealt = rows.join(parts.withColumnRenamed("node", side), side, "left")
    dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64(other), "parts"), F.lit(0).cast("long"))).drop("parts")
    return dealt.join(copied, [side, "part"]).drop("part")


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The (a, b) of ``pairs``, a staged table, whose sets are similar enough."""
    both = _with_set(_with_set(pairs, pairs, sets, "a", "b"), pairs, sets, "b", "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(100 * shared >= percent * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")


def verify_blocks(rest: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) that unite the groups ``g`` of ``rest`` (key, node, g, centre_g) wherever two sets of a crowded
    bucket are similar enough.

    Overlapping buckets form crowds.  A crowd's nodes are ranked and cut into blocks, and each pair of
    blocks is one bounded task that counts intersections as a product of incidence matrices; so a crowd of m
    nodes moves m * m / BLOCK rows and emits a spanning forest, never its pairs.
    """
    # Groups, not nodes, are joined to crowds: a group's members need no comparison with one another.
    meets = stage(rest.where("g <> centre_g").select(F.col("g").alias("a"), F.col("centre_g").alias("b")).distinct(), "meets")
    crowds = components(meets).select(F.col("node").alias("g"), F.col("component").alias("crowd"))
    nodes = rest.select("node", "g").distinct().join(crowds, "g", "left").withColumn("crowd", F.coalesce("crowd", "g"))
    placed = ranked(nodes, ["crowd", "g", "node"]).withColumn("at", F.floor(F.col("rank") / BLOCK))
    ends = placed.groupBy("crowd").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    facing = placed.join(ends, "crowd").select(
        "node", "g", "crowd", "at", F.explode(F.sequence("first", "last")).alias("with")
    )
    facing = facing.select("node", "g", "crowd", "at", F.least("at", "with").alias("i"), F.greatest("at", "with").alias("j"))
    facing = facing.join(sets, "node")

    def compare(table: pa.Table) -> pa.Table:
        node, g, crowd, at = (table[c].to_numpy() for c in ("node", "g", "crowd", "at"))
        j = int(table["j"][0].as_py())
        two = np.flatnonzero(at == j)
        one = np.flatnonzero(at != j) if (at != j).any() else two
        column = table["elements"].combine_chunks()
        offsets, values = column.offsets.to_numpy(), column.values.to_numpy()
        size = np.diff(offsets)
        shared = intersections([values[offsets[r] : offsets[r + 1]] for r in one], [values[offsets[r] : offsets[r + 1]] for r in two])
        union = size[one][:, None] + size[two][None, :] - shared
        near = (100 * shared >= percent * union) & (crowd[one][:, None] == crowd[two][None, :]) & (g[one][:, None] != g[two][None, :])
        left, right = np.nonzero(near)
        root = forest(len(node), one[left], two[right])
        linked = np.flatnonzero(root != np.arange(len(node)))
        return pa.table({"a": node[root[linked]], "b": node[linked]})

    return facing.groupBy("i", "j").applyInArrow(compare, "a bigint, b bigint")


def intersections(one: list[np.ndarray], two: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of ``one`` with all of ``two``, some columns of the incidence matrices at a time."""
    out = np.zeros((len(one), len(two)), np.float32)
    flat = [np.concatenate(s) if s else np.zeros(0, np.int64) for s in (one, two)]
    owner = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (one, two)]
    both = np.intersect1d(flat[0], flat[1])
    if not len(both):
        return out.astype(np.int64)
    cells = []
    for values, rows in zip(flat, owner, strict=True):
        at = np.minimum(np.searchsorted(both, values), len(both) - 1)
        hit = both[at] == values
        order = np.argsort(at[hit], kind="stable")
        cells.append((at[hit][order], rows[hit][order]))
    for a in range(0, len(both), width):
        dense = []
        for (at, rows), n in zip(cells, (len(one), len(two)), strict=True):
            lo, hi = np.searchsorted(at, [a, a + width])
            m = np.zeros((n, width), np.float32)
            m[rows[lo:hi], at[lo:hi] - a] = 1
            dense.append(m)
        out += dense[0] @ dense[1].T
    return np.rint(out).astype(np.int64)


def _as_long(percent: int, n: str, m: str):
    """Sizes alone rule out a pair whose smaller set is under ``percent`` of the larger."""
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def link(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``documents``."""
    sketches = stage(sketch(documents), "sketches")
    classes = stage(
        sketches.where("digest IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("keys").alias("keys"))
        .withColumn("node", F.monotonically_increasing_id()),
        "classes",
    )
    keyed = classes.select("node", "n", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    shared = stage(keyed.join(sizes, "key"), "shared")
    # An original shares more and larger buckets than its copies share with one another.
    scored = shared.join(shared.groupBy("node").agg(F.sum("members").alias("score")), "node")
    members = stage(scored, "members")
    unstage(shared)
    centres = members.groupBy("key").agg(F.max(F.struct("score", "node", "n")).alias("c"))
    members = members.join(centres.select("key", F.col("c.node").alias("centre"), F.col("c.n").alias("centre_n")), "key")
    members = stage(members.drop("score"), "starred")
    pairs = members.where(F.col("node") != F.col("centre")).where(_as_long(percent, "n", "centre_n"))
    pairs = stage(pairs.select(F.least("centre", "node").alias("a"), F.greatest("centre", "node").alias("b")).distinct(), "pairs")

    touched = members.select("node").distinct()
    wanted = classes.select("node", "digest", "doc_id").join(touched, "node")
    sets = stage(sets_of(documents, wanted), "sets")
    links = stage(verify(pairs, sets, percent), "links")
    groups = components(links)

    # Pairs across groups within a bucket of three or more; the centre's own pairs are done.
    rest = members.where("members > 2").join(groups.withColumnRenamed("component", "g"), "node", "left").withColumn("g", F.coalesce("g", "node"))
    open_keys = rest.groupBy("key").agg(F.min("g").alias("g0"), F.max("g").alias("g1"), F.count(F.lit(1)).alias("left")).where("g0 != g1")
    of_centre = rest.where(F.col("node") == F.col("centre")).select("key", F.col("g").alias("centre_g"))
    rest = rest.where(F.col("node") != F.col("centre")).join(open_keys.select("key", "left").join(of_centre, "key"), "key")
    rest = stage(rest.select("key", "node", "n", "g", "centre_g", "left"), "rest")
    few = rest.where(F.col("left") <= FEW)
    other = few.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("g").alias("h"))
    across = few.join(other, "key").where((F.col("node") < F.col("b")) & (F.col("g") != F.col("h"))).where(_as_long(percent, "n", "m"))
    across = stage(across.select(F.col("node").alias("a"), "b").distinct().join(pairs, ["a", "b"], "left_anti"), "across")
    more = verify(across, sets, percent).union(verify_blocks(rest.where(F.col("left") > FEW), sets, percent))
    more = stage(more, "links")
    if more.limit(1).count():
        unstage(groups)
        groups = components(links.union(more))
    unstage(members, pairs, sets, rest, across)

    named = classes.select("node", "digest", "doc_id").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = stage(named.join(names, "component").select("digest", "component_id"), "named")
    unstage(links, more, groups, classes)
    out = ["doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")]
    linked = sketches.where("digest IS NOT NULL").join(named, "digest").select(*out)
    alone = sketches.where("digest IS NULL").withColumn("component_id", F.col("doc_id")).select(*out)
    return linked.union(alone)


def deduplicate(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of each group of ``documents``: that of the smallest id, where there is one.  Rows are told apart by number."""
    rows = numbered(documents)
    groups = link(rows.select(F.col(ROW).alias("doc_id"), "text"), percent).select(F.col("doc_id").alias(ROW), "component_id")
    groups = stage(groups.join(rows.select(ROW, "doc_id"), ROW), "groups")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", ROW))[ROW].alias("first"))
    dropped = stage(groups.join(first, "component_id").where(F.col(ROW) != F.col("first")).select(ROW), "dropped")
    unstage(groups)
    return drop_ids(rows, dropped, ROW).drop(ROW)


__all__ = ["Shingler", "band_keys", "deduplicate", "link", "signature", "sketch"]
