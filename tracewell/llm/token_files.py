"""Token ids in Parquet files that allow selective reads.

A folder holds rows (doc_id, n_tokens, ids) in ascending doc_id order over files in the order of their
numbers.  Ids are dictionary-encoded (a vocabulary's ids take 16 bits or less); doc_id and
n_tokens are delta-encoded, as format version 2 writes integers without dictionary.  Row
groups and pages are small enough for column and page indexes to serve reads of a few
documents, and (doc_id, n_tokens) can be read without touching ids.

Defined results: a null text is the empty one, so only the end id is written; a null doc_id
sorts first; rows of one doc_id are ordered by their text; an empty table writes an empty
folder; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.common import BATCH_ROWS, slices, small_batches

WRITE_OPTIONS = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
}
_CHUNKS = 300_000
_AT_ONCE = 4000
#: A space between two characters that are not white space always starts a pre-token, so
#: what stands on either side is encoded alike alone and in its text.
_BORDER = re.compile(r" (?<=\S )(?=\S)")
#: White space other than the space and the line feed.
_RARE_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_RARE_ASCII = sum(map(str.isascii, _RARE_SPACE))
#: Letters that every version of Unicode knows as such, and signs that end a run of letters and start no contraction.
_LETTERS, _SIGNS = r"[A-Za-zÀ-ÖØ-öø-ɏ]+", r"[!-&(-/:-@\[-`{-~]*"
#: A word and the signs after it, perhaps at the start of a line: in a byte-level tokenizer each of these parts, and the
#: line feed, is a pre-token.
_SIMPLE = re.compile(f"(\n?)({_LETTERS})({_SIGNS})")


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones stand for themselves, the
    others are numbered from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}


def plain(text: str | None) -> bool:
    """Whether every space and line feed stands alone between two characters that are not white space, save that two
    line feeds may follow each other (each is a pre-token then; a run of three is not)."""
    return (
        bool(text)
        and text[0] not in " \n"
        and text[-1] not in " \n"
        and not ("  " in text or " \n" in text or "\n " in text or "\n\n\n" in text)
        and not any(map(text.__contains__, _RARE_SPACE[:_RARE_ASCII] if text.isascii() else _RARE_SPACE))
    )


class ChunkEncoder:
    """The tokenizers library behind bounded tables of what was encoded before.

    Holds for byte-level BPE, which works within pre-tokens.  Texts are cut at spaces and before line feeds into chunks; a
    simple chunk is put together from its pre-tokens, which the library's model encodes as they are; any other goes through the
    library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():  # one character stands for one byte
            self.lengths[i] = len(token)
        self.cell = np.dtype("<u2" if len(self.lengths) <= 1 << 16 else "<i4")
        alphabet = byte_alphabet()
        self.to_alphabet = np.array([0x20 if b == 0x20 else ord(alphabet[b]) for b in range(256)], "<u2")
        self.space = alphabet[0x20]
        self.line_ids = np.array(self.tokenizer.encode("\n", add_special_tokens=False).ids, self.cell).tobytes()
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        before = stated.get("pre_tokenizer") or {}
        self.pieces = None
        if before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not stated.get("normalizer"):
            self.pieces = Tokenizer(self.tokenizer.model)  # one model in memory
            self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.rest: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bare: dict[str, bytes] = {}

    def _cut(self, ids: list[int], sizes: np.ndarray) -> list[bytes]:
        """``ids`` packed, and cut where texts of so many bytes end."""
        packed = np.array(ids, self.cell)
        cuts = self.cell.itemsize * (np.searchsorted(np.cumsum(self.lengths[packed]), np.cumsum(sizes)) + 1)
        raw = packed.tobytes()
        return [raw[a:b] for a, b in itertools.pairwise([0, *cuts.tolist()])]

    def _learn_pieces(self, found: dict[str, bytes], wanted: list[str], prefix: str) -> None:
        for a in range(0, len(wanted), _AT_ONCE):
            part = wanted[a : a + _AT_ONCE]
            text = " ".join(part)
            if not text.isascii():
                text = self.to_alphabet[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")
            if prefix:
                text = prefix + text.replace(" ", f" {prefix}")
            [encoded] = self.pieces.encode_batch_fast([text], add_special_tokens=False)
            sizes = np.fromiter(map(len, text.split(" ")), np.int64, len(part))
            found.update(zip(part, self._cut(encoded.ids, sizes), strict=True))

    def _learn_simple(self, chunks: list[str]) -> list[str]:
        """Learns the simple ones of ``chunks`` and returns the others."""
        whole, others, put_together = set(), [], []
        for c in chunks:
            if c.isascii() and c.isalpha():
                whole.add(c)
            elif m := _SIMPLE.fullmatch(c):
                put_together.append((c, *m.groups()))
            else:
                others.append(c)
        rest, bare = self.rest, self.bare
        if len(bare) > _CHUNKS:
            bare.clear()
        bare[""] = b""
        whole.update([word for _, line, word, _ in put_together if not line and word not in rest])
        self._learn_pieces(rest, list(whole), self.space)
        wanted = {word for _, line, word, _ in put_together if line} | {signs for *_, signs in put_together}
        self._learn_pieces(bare, [p for p in wanted if p not in bare], "")
        for c, line, word, signs in put_together:
            rest[c] = self.line_ids + bare[word] + bare[signs] if line else rest[word] + bare[signs]
        return others

    def _learn(self, chunks: list[str]) -> None:
        """Chunks that follow a space or begin with a line feed; of those not simple, the former are encoded as texts of bounded
        size and cut where each ends, the latter one by one."""
        if self.pieces is not None:
            chunks = self._learn_simple(chunks)
        lines = [c for c in chunks if c[0] == "\n"]
        encoded = self.tokenizer.encode_batch_fast([c[1:] for c in lines], add_special_tokens=False)
        self.rest.update((c, self.line_ids + np.array(e.ids, self.cell).tobytes()) for c, e in zip(lines, encoded, strict=True))
        chunks = [c for c in chunks if c[0] != "\n"]
        texts = [chunks[a : a + _AT_ONCE] for a in range(0, len(chunks), _AT_ONCE)]
        encoded = self.tokenizer.encode_batch_fast([" " + " ".join(t) for t in texts], add_special_tokens=False)
        for part, e in zip(texts, encoded, strict=True):
            sizes = np.fromiter([1 + (len(c) if c.isascii() else len(c.encode())) for c in part], np.int64, len(part))
            self.rest.update(zip(part, self._cut(e.ids, sizes), strict=True))

    def _look_up(self, chunks: list[str]) -> list[bytes]:
        """The ids of different chunks that each follow a space or begin with a line feed."""
        if len(self.rest) > _CHUNKS:  # chunks used since the last turn come back from the older table
            self.rest, self.older = {}, self.rest
        found = list(map(self.rest.get, chunks))
        lacking = [i for i, v in enumerate(found) if v is None]
        if lacking:
            older, new = self.older, []
            for i in lacking:
                known = older.get(chunks[i])
                if known is None:
                    new.append(i)
                else:
                    found[i] = self.rest[chunks[i]] = known
            self._learn([chunks[i] for i in new])
            rest = self.rest
            for i in new:
                found[i] = rest[chunks[i]]
        return found

    @staticmethod
    def _split(texts: pa.Array) -> pa.ListArray:
        return pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of a batch: texts are split and their different chunks numbered in Arrow, each of those is
        looked up once, and ids are gathered by number."""
        rows = texts.to_numpy(zero_copy_only=False).tolist()
        odd = [i for i, t in enumerate(rows) if not plain(t)]
        if odd:
            parts = [_BORDER.split(rows[i]) if rows[i] else [""] for i in odd]
            even = np.ones(len(rows), bool)
            even[odd] = False
            split = self._split(texts.filter(pa.array(even)))
            place = np.empty(len(rows), np.int64)
            place[even], place[odd] = np.arange(len(rows) - len(odd)), np.arange(len(rows) - len(odd), len(rows))
            split = pa.concat_arrays([split, pa.array(parts, split.type)]).take(pa.array(place))
        else:
            split = self._split(texts)
        offsets, values = split.offsets.to_numpy(), split.flatten()
        offsets = offsets - offsets[0]
        n, n_rows = len(values), len(rows)
        first = np.zeros(n, bool)
        first[offsets[:-1]] = True
        coded = values.filter(pa.array(~first)).dictionary_encode()
        found = self._look_up(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        heads = self.tokenizer.encode_batch_fast(values.filter(pa.array(first)).to_pylist(), add_special_tokens=False)
        end = b"" if end_id is None else np.array([end_id], self.cell).tobytes()
        blobs = [*found, *[np.array(e.ids, self.cell).tobytes() for e in heads], end]
        number = np.empty(n + n_rows, np.int32)  # every row's chunks, and its end
        last = offsets[1:] + np.arange(n_rows)
        body = np.ones(n + n_rows, bool)
        body[last] = False
        order = np.empty(n, np.int32)
        order[~first], order[first] = coded.indices.to_numpy(), len(found) + np.arange(n_rows)
        number[body], number[last] = order, len(blobs) - 1
        gathered = pa.array(blobs, pa.binary()).take(pa.array(number))
        width = self.cell.itemsize
        ends = np.frombuffer(gathered.buffers()[1], np.int32, n + n_rows + 1) // width
        data = gathered.buffers()[2]
        ids = np.frombuffer(data, self.cell, int(ends[-1])) if data is not None else np.zeros(0, self.cell)
        return np.concatenate([[0], ends[last + 1]]).astype(np.int32), ids.astype(np.int32)

    def encode_batch(self, texts: list[str | None], end_id: int | None = None) -> list[np.ndarray]:
        offsets, ids = self.encode(pa.array(texts, pa.string()), end_id)
        return np.split(ids, offsets[1:-1])


_ENCODERS: dict[str, ChunkEncoder] = {}


def _encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def write(documents: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text and write the files.  Rows are dealt by ranges of doc_id (ties by a hash
    of the text, so that no key fills a task) and sorted within them."""
    id_type = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for whole in batches:
            for batch in slices(whole, max_bytes=4 << 20):
                offsets, ids = encoder.encode(batch.column(1), end_id)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))],
                    names=["doc_id", "n_tokens", "ids"],
                )

    out = small_batches(rows).mapInArrow(run, f"doc_id {id_type}, n_tokens bigint, ids array<int>")
    out.write.options(**WRITE_OPTIONS).parquet(path)


def read(spark: SparkSession, path: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """The chosen columns, and (file, at): a row's place, whose order is that of the ids."""
    df = spark.read.parquet(path)
    return df.select(*columns, F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))


def starts(rows: DataFrame) -> DataFrame:
    """``rows`` with ``start``, the ids of all rows before: a sum per file, running over files in the order of
    their numbers (names of 100,000 files and more do not sort so), plus a running sum within each file
    (files have bounded sizes)."""
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")
    before = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .join(totals, "file")
        .withColumn("start", F.col("offset") + F.col("within"))
        .drop("offset", "within")
    )


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, file, at) of the files under ``path``: ids as read, digested as little-endian 32-bit integers.

    A task gets a file's bytes (a file holds one task's output) and reads it one row group after another.
    """
    schema = spark.read.parquet(path).schema
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("content", F.col("_metadata.file_name").alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _ENCODERS.clear()  # a worker that encoded before needs its tables no more
        for batch in batches:
            for content, name in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                at = 0
                for rows in pq.ParquetFile(pa.BufferReader(content.as_buffer())).iter_batches(BATCH_ROWS, columns=["doc_id", "ids"]):
                    ids = rows.column(1)
                    offsets = ids.offsets.to_numpy()
                    values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")
                    crcs = [zlib.crc32(values[a:b]) for a, b in itertools.pairwise(offsets.tolist())]
                    n = rows.num_rows
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(0), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64()), pa.array([name] * n), pa.array(np.arange(at, at + n))],
                        names=["doc_id", "n_tokens", "ids_crc32", "file", "at"],
                    )
                    at += n

    return files.mapInArrow(run, f"doc_id {schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_crc32 bigint, file string, at bigint")
