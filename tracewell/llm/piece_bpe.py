"""Encoding and decoding with a SentencePiece BPE model, without the library.

The model merges the adjacent pair whose joined piece scores highest, leftmost first.  A
sequence of tokens is what merging yields exactly if merging each token alone, and each two
neighbours joined, yields them again: no merge then crosses a border.  So a text is encoded by
search: take the longest piece that starts here (Aho-Corasick finds them all in one pass),
keep it if it is compatible with the token before it (found by re-merging the two, and
remembered), else try the next shorter one; where none is left, note the position as failed
and go back.  Each position fails at most once, so the search is linear in the text.

Where no piece holds two neighbouring characters side by side, no merge joins them.  So texts are cut
between words (no piece holds a space mark after another character), words within at such places,
mostly before punctuation, and the parts' ids are remembered in bounded tables.

Defined results: a null text encodes as the empty one, to no ids; texts are encoded whole
at any length; repeated rows encode alike; an empty table gives an empty table; other
columns are ignored.  Characters outside the vocabulary become UTF-8 byte pieces.
"""

from __future__ import annotations

import itertools
import re
import struct
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewell.llm.common import slices, small_batches

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
_WORDS = 250_000
_PAIRS = 150_000
_NONE = (1 << 21) - 1
_BORDER = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = buf[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def _fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protocol buffer message."""
    at = 0
    while at < len(buf):
        key, at = _varint(buf, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(buf, at)
        else:
            if kind == 2:
                size, at = _varint(buf, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value = buf[at : at + size]
            at += size
        yield key >> 3, value


class PieceModel:
    """A BPE model with identity normalisation, dummy prefix and byte fallback."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id = [0] * 256
        self.unk_surface = " ⁇ "
        for field, value in _fields(raw):
            if field == 1:
                self._add(dict(_fields(value)))
            elif field == 2:
                trainer = dict(_fields(value))
                if trainer.get(3, 1) != 2 or not trainer.get(35, 0):
                    raise ValueError("only BPE models with byte fallback are supported")
                self.unk_surface = trainer.get(44, self.unk_surface.encode()).decode()
            elif field == 3:
                norm = dict(_fields(value))
                if norm.get(2) or norm.get(4, 1) or not norm.get(3, 1) or not norm.get(5, 1):
                    raise ValueError("only identity normalisation with a dummy prefix is supported")
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("pieces that cross words are not supported")
        self.matcher = ahocorasick.Automaton()
        for piece, i in self.id.items():
            self.matcher.add_word(piece, (len(piece) - 1, i))
        self.matcher.make_automaton()
        self.size = [len(p) for p in self.pieces]
        #: By piece, the longest piece that it begins with; -1 if there is none.
        self.prefix = [next((self.id[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.id), -1) for p in self.pieces]
        self.joined = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.surface = [self._surface(i) for i in range(len(self.pieces))]
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _add(self, fields: dict) -> None:
        piece, kind = fields[1].decode(), fields.get(3, NORMAL)
        i = len(self.pieces)
        self.pieces.append(piece)
        self.kinds.append(kind)
        if kind == NORMAL:
            self.id[piece] = i
            self.score[piece] = struct.unpack("<f", fields.get(2, b"\0\0\0\0"))[0]
        elif kind == BYTE:
            self.byte_id[int(piece[3:5], 16)] = i
        elif kind not in (UNKNOWN, CONTROL):
            raise ValueError(f"pieces of kind {kind} are not supported")

    def _surface(self, i: int) -> bytes:
        kind, piece = self.kinds[i], self.pieces[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        if kind == CONTROL:
            return b""
        return self.unk_surface.encode() if kind == UNKNOWN else piece.replace(SPACE, " ").encode()

    def merge(self, text: str) -> list[str]:
        """What the merges alone make of ``text``: quadratic, for short strings."""
        parts = list(text)
        score = self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def text_of(self, token: int) -> str:
        """A token is a piece's id, or the number of pieces plus the code of a character outside the vocabulary."""
        return "" if token == _NONE else self.pieces[token] if token < len(self.pieces) else chr(token - len(self.pieces))

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the two (``left`` may be _NONE) yields the two again."""
        if len(self.pairs) >= _PAIRS:
            self.pairs.clear()
        a, b = self.text_of(left), self.text_of(right)
        found = self.pairs[left << 21 | right] = self.merge(a + b) == ([a, b] if a else [b])
        return found

    def tokens(self, text: str) -> list[int]:
        """``text`` (escaped) as tokens."""
        n = len(text)
        if not n:
            return []
        longest = [-1] * n
        for end, (back, i) in self.matcher.iter(text):
            longest[end - back] = i  # ends ascend, so the last is the longest
        size, prefix, get, outside = self.size, self.prefix, self.pairs.get, len(self.pieces)
        failed: bytearray | None = None  # one bit per position, once there is one
        out: list[int] = []
        pos, last = 0, _NONE
        token = longest[0]
        if token < 0:
            token = outside + ord(text[0])
        while True:
            end = pos + (size[token] if token < outside else 1)
            ok = get(last << 21 | token)
            if ok is None:
                ok = self.compatible(last, token)
            if ok and (failed is None or not failed[end >> 3] >> (end & 7) & 1):
                out.append(token)
                if end >= n:
                    return out
                pos, last = end, token
                token = longest[pos]
                if token < 0:
                    token = outside + ord(text[pos])
                continue
            shorter = self._shorter(token)
            while shorter < 0:
                if failed is None:
                    failed = bytearray(n // 8 + 1)
                failed[pos >> 3] |= 1 << (pos & 7)
                if not out:
                    raise ValueError(f"no sequence of compatible tokens: {text[:80]!r}")
                token = out.pop()
                pos -= size[token] if token < outside else 1
                last = out[-1] if out else _NONE
                shorter = self._shorter(token)
            token = shorter

    def _shorter(self, token: int) -> int:
        if token >= len(self.pieces):
            return -1
        if self.prefix[token] >= 0 or self.size[token] == 1:
            return self.prefix[token]
        return len(self.pieces) + ord(self.pieces[token][0])

    def _part(self, part: str) -> bytes:
        """Ids of ``part`` as little-endian 32-bit integers."""
        ids: list[int] = []
        for token in self.tokens(part):
            if token < len(self.pieces):
                ids.append(token)
            else:
                ids += [self.byte_id[b] for b in chr(token - len(self.pieces)).encode()]
        return array("i", ids).tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of space mark plus ``word``.  Parts used since the tables last turned come back from the older one;
        in them a word's first part stands without its mark, and others with a space before them."""
        if len(self.words) >= _WORDS:
            self.words, self.older = {}, self.words
        text, joined = SPACE + word, self.joined
        cuts = [i for i in range(1, len(text)) if text[i - 1 : i + 1] not in joined]
        found = []
        for a, b in itertools.pairwise([0, *cuts, len(text)]):
            key = f" {text[a:b]}" if a else text[1:b]
            got = self.words.get(key)
            if got is None:
                got = self.older.get(key)
                if got is None:
                    got = self._part(text[a:b])
                if b - a <= 64:
                    self.words[key] = got
            found.append(got)
        out = found[0] if len(found) == 1 else b"".join(found)
        if len(word) <= 64:
            self.words[word] = out
        return out

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        words = text.split(" ")
        if "" in words or SPACE in text:
            words = [w[1:] for w in _BORDER.split(SPACE + text.replace(" ", SPACE))]
        get, make = self.words.get, self._word
        return np.frombuffer(b"".join([get(w) or make(w) for w in words]), np.int32)

    def decode(self, ids) -> str:
        ids = list(ids)
        surface, kinds = self.surface, self.kinds
        raw = b"".join([surface[i] for i in ids])
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = None
        if ids and text is not None and kinds[ids[0]] == NORMAL:
            return text[1:] if self.pieces[ids[0]].startswith(SPACE) else text
        return self._decode_mixed(ids)

    def _decode_mixed(self, ids: list[int]) -> str:
        """Any sequence: runs of byte pieces by themselves, each malformed byte as U+FFFD; the
        dummy space goes from the first other piece while nothing precedes it."""
        out: list[str] = []
        run = bytearray()
        seen_mark = False

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + size]).decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids:
            if self.kinds[i] == BYTE:
                run += self.surface[i]
                continue
            flush()
            text = self.surface[i].decode()
            first = not seen_mark and not any(out)
            seen_mark = first and self.kinds[i] == NORMAL and text.startswith(" ")
            out.append(text[1:] if seen_mark else text)
        flush()
        return "".join(out)


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model per worker process and path."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(documents: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """(id, ids array<int>[, decoded]) per row.  ``model_path`` must exist on every executor."""
    id_type = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_path)
        for whole in batches:
            for batch in slices(whole):
                ids = [m.encode(t) for t in batch.column(1).to_pylist()]
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))]
                if decoded:
                    columns.append(pa.array([m.decode(x.tolist()) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "ids", "decoded"][: len(columns)])

    return small_batches(documents).select(id_col, text_col).mapInArrow(run, f"`{id_col}` {id_type}, ids array<int>" + ", decoded string" * decoded)
