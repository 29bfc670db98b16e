"""Language identification by bit-sliced Bloom filters of n-grams.

Every language has a Bloom filter of the byte n-grams (of three and of five bytes) that its
training texts hold at least ``min_texts`` times; the filters are sliced, so that slot h of the
table is a bitmask of the languages whose filter has bit h.  The bitwise AND of an n-gram's slots
is the mask of all languages that contain it.  A text's masks are counted per language; a filter
filled to the share f claims a foreign n-gram with probability f ** hashes, which is taken
out again: (claimed - f**k * total) / (1 - f**k).  N-grams that all languages claim say
nothing and are left out.  The language with the largest corrected count wins (ties: the first by name);
the score is its share of the corrected counts' sum, one for each n-gram size, averaged.

Defined results: a text that is null or has no letter is ``und`` with score 0; texts are read whole at
any length; repeated rows are judged alike; without training rows all is ``und``; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm import samples
from tracewell.llm.common import fold as id_fold
from tracewell.llm.common import filter_rows, slices, small_batches

SIZES = (3, 5)
HASHES = 2
BITS = 20
MAX_ROWS = 4000
MIN_TEXTS = 2
#: N-grams that not every language claims, below which a low score is lack of evidence: about three short words.
MIN_TOLD = 16
_RUNS = re.compile(r"[^\W\d_]+")
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def normalise(text: str | None) -> bytes:
    """Lower-cased runs of letters (``str.isalpha``) between single spaces, as UTF-8; empty if there is no letter."""
    words = _RUNS.findall(text.lower()) if text else []
    if words and not "".join(words).isalpha():  # the pattern lets in numbers such as fractions and Roman numerals
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    return f" {' '.join(words)} ".encode("utf-8", "surrogatepass") if words else b""


def grams(raw: bytes, size: int) -> np.ndarray:
    """All n-grams of ``size`` <= 8 bytes, packed into integers (and the size, to keep sizes apart)."""
    x = np.frombuffer(raw, np.uint8).astype(np.uint64)
    n = len(x) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = x[:n].copy()
    for i in range(1, size):
        out |= x[i : i + n] << np.uint64(8 * i)
    return out


def slots(g: np.ndarray, size: int, hashes: int, bits: int) -> Iterator[np.ndarray]:
    salted = (g ^ (g >> np.uint64(29))) + np.uint64(size)
    for k in range(hashes):
        h = salted * _MULTIPLIERS[k]
        yield (h ^ (h >> np.uint64(32))) * _MULTIPLIERS[k] >> np.uint64(64 - bits)


def claims(cells: np.ndarray, n: int) -> np.ndarray:
    """Whether language ``n`` is in each bitmask."""
    width = 8 * cells.dtype.itemsize
    return (cells[:, n // width] >> cells.dtype.type(n % width)) & cells.dtype.type(1)


@dataclass
class Filters:
    """Languages by name, and per n-gram size the table of bitmasks, in the smallest integers that hold
    the languages (beyond 64, in several): 2 MB for up to eight."""

    languages: list[str]
    tables: dict[int, np.ndarray]
    hashes: int = HASHES
    bits: int = BITS

    def fill(self) -> dict[int, np.ndarray]:
        """Per size, the chance that a foreign n-gram is claimed, by language."""
        out = {}
        for size, table in self.tables.items():
            share = [float(claims(table, n).mean()) for n in range(len(self.languages))]
            out[size] = np.array(share) ** self.hashes
        return out

    def counts(self, raw: bytes, size: int) -> tuple[np.ndarray, int]:
        """N-grams each language claims, and all, leaving out those that every language claims."""
        g = grams(raw, size)
        table = self.tables[size]
        mask = None
        for at in slots(g, size, self.hashes, self.bits):
            here = table[at]
            mask = here if mask is None else mask & here
        n = len(self.languages)
        bits = np.stack([claims(mask, i) for i in range(n)]) if n else np.zeros((0, len(g)), np.uint8)
        told = bits.sum(axis=0, dtype=np.int64)
        kept = told < n
        return bits[:, kept].sum(axis=1, dtype=np.int64).astype(np.float64), int(kept.sum())

    def judge(self, text: str | None, fill: dict[int, np.ndarray]) -> tuple[str, float]:
        return self.measure(text, fill)[:2]

    def measure(self, text: str | None, fill: dict[int, np.ndarray]) -> tuple[str, float, int]:
        """The language, its score, and how many n-grams it rests on: those that not every language claims."""
        raw = normalise(text)
        if not raw or not self.languages:
            return "und", 0.0, 0
        if len(self.languages) == 1:
            return self.languages[0], 1.0, 0
        share = np.zeros(len(self.languages))
        seen = told = 0
        for size in self.tables:
            claimed, total = self.counts(raw, size)
            told += total
            corrected = np.maximum(0.0, (claimed - fill[size] * total) / np.maximum(1e-9, 1 - fill[size]))
            if corrected.sum() > 0:
                share += corrected / corrected.sum()
                seen += 1
        if not seen:
            return self.languages[0], 1 / len(self.languages), told
        best = int(np.argmax(share))
        return self.languages[best], float(share[best] / seen), told


class Tally:
    """How many texts hold each n-gram, merged whenever enough are pending."""

    def __init__(self, pending: int = 1_000_000):
        self.values, self.times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.texts = 0
        self.waiting: list[np.ndarray] = []
        self.room = self.most = pending

    def add(self, g: np.ndarray) -> None:
        self.texts += 1
        self.waiting.append(np.unique(g))
        self.room -= len(self.waiting[-1])
        if self.room < 0:
            self.merge()

    def merge(self) -> None:
        values = np.concatenate([self.values, *self.waiting])
        times = np.concatenate([self.times, np.ones(len(values) - len(self.values), np.int64)])
        order = np.argsort(values, kind="stable")
        values, times = values[order], times[order]
        new = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
        self.values, self.times = values[new], np.add.reduceat(times, new) if len(new) else times
        self.waiting, self.room = [], self.most

    def frequent(self, least: int) -> np.ndarray:
        self.merge()
        return self.values[self.times >= min(least, self.texts)]


def learn(sample: Iterator[tuple[str | None, str]], min_texts: int = MIN_TEXTS, hashes: int = HASHES, bits: int = BITS) -> Filters:
    """Filters from (text, language) rows, which must be few enough for one machine."""
    held: dict[tuple[str, int], Tally] = {}
    for text, lang in sample:
        raw = normalise(text)
        for size in SIZES:
            held.setdefault((lang, size), Tally()).add(grams(raw, size))
    languages = sorted({lang for lang, _ in held})
    cell = next((t for t in (np.uint8, np.uint16, np.uint32) if len(languages) <= 8 * t().itemsize), np.uint64)
    width = 8 * cell().itemsize
    tables = {size: np.zeros((1 << bits, max(1, -(-len(languages) // width))), cell) for size in SIZES}
    for n, lang in enumerate(languages):
        for size in SIZES:
            for at in slots(held[lang, size].frequent(min_texts), size, hashes, bits):
                tables[size][at, n // width] |= cell(1 << (n % width))
    return Filters(languages, tables, hashes, bits)


def fit(documents: DataFrame, train: Column | None = None, max_rows: int = MAX_ROWS) -> Filters:
    """Filters of at most ``max_rows`` rows with a language: those whose ids hash lowest, by default among
    ids whose crc32 modulo 5 is not 0."""
    train = id_fold("doc_id", 5) != 0 if train is None else train
    known = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & train)
    ids = known.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).distinct()
    sample = samples.short(known.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))).join(F.broadcast(ids), "doc_id")
    return learn((r["text"], r["lang"]) for r in samples.stream(sample))


def identify(documents: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score) per row; the filters, of a size that the number of languages fixes, are broadcast."""
    id_type = documents.schema["doc_id"].dataType.simpleString()
    shared = documents.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = shared.value
        fill = filters.fill()
        for whole in batches:
            for batch in slices(whole):
                judged = [filters.judge(t, fill) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([j[0] for j in judged], pa.string()), pa.array([j[1] for j in judged], pa.float64())],
                    names=["doc_id", "lang_pred", "score"],
                )

    return small_batches(documents).select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")


def keep(documents: DataFrame, filters: Filters, margin: float = 1.1) -> DataFrame:
    """``documents`` with all columns, less the rows of no known language: ``und``, and those whose score,
    over MIN_TOLD n-grams or more, is not ``margin`` times what a language gets by chance."""
    least = margin / len(filters.languages) if len(filters.languages) > 1 else 0.0
    shared = documents.sparkSession.sparkContext.broadcast(filters)

    def start():
        filters = shared.value
        fill = filters.fill()

        def test(texts):
            judged = [filters.measure(t, fill) for t in texts]
            return [lang != "und" and (share >= least or told < MIN_TOLD) for lang, share, told in judged]

        return test

    return filter_rows(documents, start)
