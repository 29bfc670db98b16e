"""Benchmark decontamination by greedy string tiling.

Texts become words (lower-cased runs of letters, digits and marks).  Documents and items
are joined on shared five-word seeds; each joined pair is tiled: the longest non-overlapping
matches of at least five words are marked first, found by running Karp-Rabin, that is by hashing
windows of the unmarked words at a search length that shrinks to that of the longest match.  An item
is covered by the words its tiles mark, whatever their order in the document, so reordered
passages count in full.  A document is contaminated by an item if at least
``threshold`` of the item's words are covered.

Seeds are taken from the benchmark in blocks of bounded size, each sent to all tasks, matched
against all documents and released, so a benchmark of any size is handled in passes; a document is read
as a stream and never meets another document, hence no key can be hot.

Defined results: null and blank texts contain nothing; an item of fewer than five words
is matched as one window of its own length, and a null or blank item matches nothing; repeated
rows are judged alike; of equal item ids each text counts by itself; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from tracewell.llm.common import ROW, drop_ids, numbered, slices, small_batches, stage

MIN_MATCH = 5
THRESHOLD = 0.5
#: Items sent to the tasks at once; an item's words are bounded by BLOCK_WORDS in all.
BLOCK_WORDS = 2_000_000
#: A text's words are found in pieces of about so many characters, so that its words are never all held as strings.
_PIECE = 1 << 20
_SEGMENT = 1 << 18
_KNOWN = 100_000
_WORD = re.compile(r"\w+")
_BASE = 0x9E3779B97F4A7C15


def _pieces(text: str) -> Iterator[str]:
    """``text`` cut at spaces or line ends."""
    at = 0
    while len(text) - at > _PIECE:
        cut = max(text.rfind(" ", at, at + _PIECE), text.rfind("\n", at, at + _PIECE))
        if cut <= at:
            found = re.compile(r"[ \n]").search(text, at + _PIECE)
            cut = found.start() if found else len(text)
        yield text[at:cut]
        at = cut
    yield text[at:]


def words(text: str | None) -> np.ndarray:
    """A 64-bit hash per word."""
    known: dict[str, int] = {}
    out = []
    for piece in _pieces(text or ""):
        found = _WORD.findall(piece.lower())
        if len(known) > _KNOWN:
            known.clear()
        for w in set(found):
            if w not in known:
                known[w] = xxhash.xxh64_intdigest(w)
        out.append(np.array([known[w] for w in found], np.uint64))
    return np.concatenate(out)


class Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as they were needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            size = max(n, 1 << 12)
            for name, factor in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                table = np.full(size, factor, np.uint64)
                table[0] = 1
                setattr(cls, name, np.cumprod(table))


class Rolling:
    """Running Karp-Rabin hashes (modulo 2**64): one pass over the words, then any window of any size is the difference
    of two prefixes, scaled to its place."""

    def __init__(self, x: np.ndarray):
        Powers.reach(len(x) + 1)
        self.x = x
        self.prefix = np.zeros(len(x) + 1, np.uint64)
        np.cumsum(x * Powers.down[: len(x)], out=self.prefix[1:])

    def at(self, places: np.ndarray, size: int) -> np.ndarray:
        return (self.prefix[places + size] - self.prefix[places]) * Powers.up[places]


def windows(x: np.ndarray, size: int) -> np.ndarray:
    """The hashes of all windows of ``size`` words."""
    return Rolling(x).at(np.arange(max(0, len(x) - size + 1)), size)


def _stretches(places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a text whose windows of ``size`` at ``places`` occur in an item: the words that those windows cover, by place, and
    where in that list a new stretch begins.  No match reaches from one stretch into another."""
    apart = max(2, size)  # nearer windows touch or overlap, and stay together
    new = np.flatnonzero(np.diff(places, prepend=places[0] - apart) >= apart)
    first, last = places[new], places[np.append(new[1:], len(places)) - 1]
    length = last - first + size
    ends = np.cumsum(length)
    return np.repeat(first - (ends - length), length) + np.arange(ends[-1]), ends - length


class _Side:
    """The words of one side that may match, with marks: between stretches stands a word that is marked from the start."""

    def __init__(self, x: np.ndarray, places: np.ndarray, size: int):
        covered, begins = _stretches(places, size)
        self.back = np.insert(covered, begins, -1)
        self.marked = self.back < 0
        self.rolling = Rolling(np.where(self.marked, np.uint64(0), x[self.back]))
        self.starts = np.flatnonzero(np.isin(self.back, places, assume_unique=False) & ~self.marked)
        self.count()

    def count(self) -> None:
        self.before = np.concatenate([[0], np.cumsum(self.marked, dtype=np.int32)])

    def free(self, size: int) -> np.ndarray:
        """Where windows of ``size`` start that hold no mark."""
        at = self.starts[self.starts + size < len(self.before)]
        return at[self.before[at + size] == self.before[at]]

    def mark(self, at: int, size: int) -> None:
        self.marked[at : at + size] = True


def tile(item: np.ndarray, doc: np.ndarray, min_match: int = MIN_MATCH, places: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in item, place in doc, length), longest first.

    In turn the greatest length at which unmarked windows of both sides have equal hashes is searched for by halving, and
    the matches of that length are marked (earlier ones in the item first, then in the document), each window being tried
    once; so a text that repeats one word over and over costs no more than another.  ``places`` are those in the
    document whose windows of ``min_match`` occur in the item, if they are known.
    """
    min_match = min(min_match, len(item))
    if not min_match or len(doc) < min_match:
        return []
    seeds = windows(item, min_match)
    if places is None:
        places = np.flatnonzero(np.isin(windows(doc, min_match), seeds))
    if not len(places):
        return []
    one, two = _Side(item, np.arange(len(seeds)), min_match), _Side(doc, places, min_match)

    def shared(size: int) -> bool:
        i, d = one.free(size), two.free(size)
        return len(i) > 0 and len(d) > 0 and bool(np.isin(one.rolling.at(i, size), two.rolling.at(d, size)).any())

    tiles: list[tuple[int, int, int]] = []
    most = min(len(item), len(two.back))
    while most >= min_match and shared(min_match):
        low, high = min_match, most
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if shared(middle) else (low, middle - 1)
        tiles += _mark(one, two, low)
        one.count()
        two.count()
        most = low if shared(low) else low - 1
    return tiles


def _mark(one: _Side, two: _Side, size: int) -> list[tuple[int, int, int]]:
    """Marks the matches of ``size``, the longest there are."""
    i, d = one.free(size), two.free(size)
    hi, hd = one.rolling.at(i, size), two.rolling.at(d, size)
    order = np.argsort(hd, kind="stable")
    hd, d = hd[order], d[order]
    hit = np.isin(hi, hd)
    i, hi = i[hit].tolist(), hi[hit]
    turn = dict(zip(hi.tolist(), np.searchsorted(hd, hi, "left").tolist(), strict=True))
    end = dict(zip(hi.tolist(), np.searchsorted(hd, hi, "right").tolist(), strict=True))
    tiles, past = [], 0
    for at, h in zip(i, hi.tolist(), strict=True):
        if at < past:
            continue
        while turn[h] < end[h]:
            to = int(d[turn[h]])
            if two.marked[to : to + size].any():
                turn[h] += 1  # what is marked stays marked: this window is done for all
            elif not np.array_equal(one.rolling.x[at : at + size], two.rolling.x[to : to + size]):
                break  # another text of equal hash: this window of the item is given up
            else:
                one.mark(at, size)
                two.mark(to, size)
                tiles.append((int(one.back[at]), int(two.back[to]), size))
                past = at + size
                turn[h] += 1
                break
    return tiles


@dataclass(frozen=True)
class Block:
    """Some items: their words and a sorted table of their seeds."""

    ids: list
    items: list[np.ndarray]

    def seeds(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By window size: sorted seed hashes, and the item of each."""
        by_size: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for n, item in enumerate(self.items):
            size = min(MIN_MATCH, len(item))
            if size:
                h = np.unique(windows(item, size))
                by_size.setdefault(size, []).append((h, np.full(len(h), n)))
        out = {}
        for size, parts in by_size.items():
            h, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(h, kind="stable")
            out[size] = h[order], n[order]
        return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> Iterator[Block]:
    """The benchmark, streamed partition by partition and cut into bounded blocks."""
    ids, items, held = [], [], 0
    for row in benchmark.select(id_col, text_col).toLocalIterator():
        item = words(row[1])
        if held and held + len(item) > block_words:
            yield Block(ids, items)
            ids, items, held = [], [], 0
        ids.append(row[0])
        items.append(item)
        held += len(item)
    if ids:
        yield Block(ids, items)


def _candidates(doc: np.ndarray, size: int, hashes: np.ndarray, owners: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(item, places in the document) for every item that shares a seed of ``size`` words."""
    found, places = [], []
    for a in range(0, len(doc) - size + 1, _SEGMENT):
        h = windows(doc[a : a + _SEGMENT + size - 1], size)
        at = np.minimum(np.searchsorted(hashes, h, "left"), len(hashes) - 1)
        hit = np.flatnonzero(hashes[at] == h)
        found.append(h[hit])
        places.append(hit + a)
    if not found or not sum(map(len, found)):
        return
    h, d = np.concatenate(found), np.concatenate(places)
    order = np.argsort(h, kind="stable")
    h, d = h[order], d[order]
    new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    ends = np.append(new[1:], len(h))
    # Each different seed of the document belongs to one item or more; they are gathered by item.
    lo, hi = np.searchsorted(hashes, h[new], "left"), np.searchsorted(hashes, h[new], "right")
    seed = np.repeat(np.arange(len(new)), hi - lo)
    owner = owners[np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange(len(seed))]
    order = np.argsort(owner, kind="stable")
    owner, seed = owner[order], seed[order]
    cuts = np.flatnonzero(np.diff(owner)) + 1
    for n, seeds in zip(owner[np.concatenate([[0], cuts])].tolist(), np.split(seed, cuts), strict=True):
        yield n, np.sort(np.concatenate([d[new[x] : ends[x]] for x in seeds]))


def _scan(documents: DataFrame, shared: Broadcast, id_type: str, item_type: DataType) -> DataFrame:
    item_arrow = to_arrow_type(item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        seeds = block.seeds()
        for whole in batches:
            for batch in slices(whole):
                out = [[] for _ in range(6)]
                ids = batch.column(0).to_pylist()
                for doc_id, text in zip(ids, batch.column(1).to_pylist(), strict=True):
                    doc = words(text)
                    candidates = {n: places for size, (hashes, owners) in seeds.items() for n, places in _candidates(doc, size, hashes, owners)}
                    for n in sorted(candidates):
                        item = block.items[n]
                        tiles = sorted(tile(item, doc, places=candidates.pop(n)))
                        covered = sum(k for _, _, k in tiles)
                        for column, value in zip(
                            out,
                            (doc_id, block.ids[n], len(item), covered, covered / len(item), [{"item_at": i, "doc_at": d, "length": k} for i, d, k in tiles]),
                            strict=True,
                        ):
                            column.append(value)
                spans = pa.list_(pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("length", pa.int32())]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(out[0], batch.column(0).type),
                        pa.array(out[1], item_arrow),
                        pa.array(out[2], pa.int32()),
                        pa.array(out[3], pa.int32()),
                        pa.array(out[4], pa.float64()),
                        pa.array(out[5], spans),
                    ],
                    names=["doc_id", "item_id", "n_words", "n_covered", "coverage", "tiles"],
                )

    return small_batches(documents).select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {id_type}, item_id {item_type.simpleString()}, n_words int, n_covered int, coverage double, tiles array<struct<item_at: int, doc_at: int, length: int>>",
    )


def overlaps(documents: DataFrame, benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, n_words, n_covered, coverage, tiles) of every pair that shares a seed.

    A benchmark of one block is matched when the result is read.  Of a larger one each block's result is written before the
    next block is made, and the block is released; so neither the driver nor a task ever holds two.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()
    item_type = benchmark.schema["item_id"].dataType
    send = documents.sparkSession.sparkContext.broadcast
    out, ahead = None, blocks(benchmark, block_words=block_words)
    block = next(ahead, None)
    if block is None:
        return _scan(documents.limit(0), send(Block([], [])), id_type, item_type)
    while block is not None:
        shared = send(block)
        part = _scan(documents, shared, id_type, item_type)
        block = next(ahead, None)
        if out is None and block is None:
            return part
        part = stage(part, "overlaps")
        shared.destroy()
        out = part if out is None else out.union(part)
    return out


def contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The overlaps that cover at least ``threshold`` of their item."""
    return overlaps(documents, benchmark).where(F.col("coverage") >= threshold)


def clean(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` without the contaminated rows, which are told apart by number."""
    rows = numbered(documents)
    found = contaminated(rows.select(F.col(ROW).alias("doc_id"), "text"), benchmark, threshold)
    return drop_ids(rows, stage(found.select(F.col("doc_id").alias(ROW)), "contaminated"), ROW).drop(ROW)
