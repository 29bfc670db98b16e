"""Sharding by a hierarchical weighted hash tree, in DataFrame functions only.

The tree has three levels: region, rack, shard.  A row descends it: at each level every
child draws an exponential straw, ``-ln(u) / weight`` with ``u`` a hash of the key and the
child's own name, and the shortest straw wins.  A child's straw depends on nothing but the
key, its name and its weight, so when weights change a row moves only if a subtree whose
weight changed wins it (or loses it).  :func:`grow` adds shards as regions of their own: the other
regions keep their weights and straws, hence rows move into the new shard or stay.

Defined results: a null key hashes as the text ``null``; a null text has 0 bytes and crc32
0; repeated rows of one key share a shard and take neighbouring slots; an empty table gives
an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Offsets of (shard, bucket) are broadcast up to this many rows, which the parameters bound.
MAX_OFFSETS = 1_000_000
ROW_OVERHEAD = 16
#: Equal rows that one task lists at a time.
RUN = 1 << 16


@dataclass(frozen=True)
class Tree:
    """``regions[r][k]`` holds the (shard, weight) pairs of rack ``k`` of region ``r``."""

    regions: tuple[tuple[tuple[tuple[int, float], ...], ...], ...]

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)


def grid(n_shards: int, n_regions: int = 4, racks_per_region: int = 2) -> Tree:
    """Shards 0 to n-1 of weight 1, dealt evenly to the racks in natural order."""
    n_racks = n_regions * racks_per_region
    cut = [n_shards * i // n_racks for i in range(n_racks + 1)]
    racks = [tuple((s, 1.0) for s in range(cut[i], cut[i + 1])) for i in range(n_racks)]
    regions = [tuple(k for k in racks[r * racks_per_region : (r + 1) * racks_per_region] if k) for r in range(n_regions)]
    return Tree(tuple(r for r in regions if r))


def grow(tree: Tree, more: int = 1) -> Tree:
    """``tree`` and ``more`` new shards of weight 1, each a region of its own."""
    return replace(tree, regions=tree.regions + tuple((((tree.shards + i, 1.0),),) for i in range(more)))


def _uniform(key: Column, name: Column) -> Column:
    """In (0, 1): 32 bits of md5, which other engines compute alike."""
    digest = F.md5(F.concat(key, F.lit("/"), name).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)


def _draw(key: Column, level: str, children: Column) -> Column:
    """The child (struct of id, weight) with the shortest straw; ties go to the smaller id."""
    straws = F.transform(
        children,
        lambda c: F.struct(
            (-F.ln(_uniform(key, F.concat(F.lit(level), c["id"].cast("string")))) / c["weight"]).alias("straw"),
            c["id"].alias("id"),
        ),
    )
    return F.array_min(straws)["id"]


def _nodes(pairs) -> Column:
    return F.array(*[F.struct(F.lit(int(i)).alias("id"), F.lit(float(w)).alias("weight")) for i, w in pairs])


def _per(groups, make) -> Column:
    return F.array(*[make(g) for g in groups])


def place(key: Column, tree: Tree) -> Column:
    """The shard of ``key`` (a string column).  Racks are named by their number over all regions."""
    weight = lambda rack: sum(w for _, w in rack)
    regions, racks, shards, n = [], [], [], 0
    for r, region in enumerate(tree.regions):
        regions.append((r, sum(map(weight, region))))
        racks.append([(n + i, weight(rack)) for i, rack in enumerate(region)])
        shards += region
        n += len(region)
    region = _draw(key, "region", _nodes(regions))
    rack = _draw(key, "rack", F.get(_per(racks, _nodes), region))
    return _draw(key, "shard", F.get(_per(shards, _nodes), rack)).cast("int")


def assign(df: DataFrame, tree: Tree, grown: Tree | None = None, key: str = "doc_id", slot_buckets: int = 1024) -> DataFrame:
    """(key, shard, bucket, slot[, grown_shard]) and nothing else but ``key``'s row count kept.

    Slots run gapless from 0 within a shard, in the order (bucket, key).  A bucket is a hash
    of the key, so a shard of any size is numbered by many tasks: rows are counted per
    (shard, bucket), offsets are the running sums of those counts, and only the rows of one
    bucket are sorted together.
    """
    return number(with_shard(df.select(key), tree, grown, key, slot_buckets), tree, key, [key])


def with_shard(df: DataFrame, tree: Tree, grown: Tree | None, key: str, slot_buckets: int) -> DataFrame:
    text_key = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    out = df.withColumn("shard", place(text_key, tree))
    if grown is not None:
        out = out.withColumn("grown_shard", place(text_key, grown))
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit("slot/"), text_key).cast("binary")), 1, 8), 16, 10).cast("long") % slot_buckets
    return out.withColumn("bucket", bucket.cast("int"))


def number(rows: DataFrame, tree: Tree, key: str, order: list[str], slot_buckets: int = 1024, count: str | None = None) -> DataFrame:
    """``rows`` with a gapless ``slot`` per shard; a row that stands for ``count`` rows takes as many slots, and gets the first."""
    n = F.lit(1) if count is None else F.col(count)
    counts = rows.groupBy("shard", "bucket").agg(F.sum(n).alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    if tree.shards * slot_buckets <= MAX_OFFSETS:
        offsets = F.broadcast(offsets)
    within = Window.partitionBy("shard", "bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("at", F.coalesce(F.sum(n).over(within), F.lit(0)))
        .join(offsets, ["shard", "bucket"])
        .withColumn("slot", (F.col("offset") + F.col("at")).cast("long"))
        .drop("offset", "at")
    )


def shard_documents(
    documents: DataFrame, n_shards: int = 40, n_regions: int = 4, racks_per_region: int = 2, slot_buckets: int = 1024
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): all documents dealt by ``doc_id``.

    The law is ``key``: doc_id and the shard count decide, and one shard more takes rows only
    into itself.
    """
    tree = grid(n_shards, n_regions, racks_per_region)
    rows = documents.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_OVERHEAD).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    # Rows of one id and text are equal here: they are counted before they are shuffled and numbered as one, so an id that a third
    # of all rows carry is one row to sort; then they are dealt anew in bounded runs, each row with its slot.
    alike = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    alike = with_shard(alike, tree, grow(tree), "doc_id", slot_buckets)
    placed = number(alike, tree, "doc_id", ["doc_id", "text_crc32", "size"], slot_buckets, "n")
    last = F.col("n") - 1
    runs = placed.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(last / RUN))))
    runs = runs.repartition("doc_id", "text_crc32", "run")
    out = runs.withColumn("step", F.explode(F.sequence(F.col("run") * RUN, F.least(last, F.col("run") * RUN + (RUN - 1)))))
    out = out.withColumn("slot", F.col("slot") + F.col("step"))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
