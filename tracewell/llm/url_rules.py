"""URL rules as one bit-parallel wildcard automaton (Shift-And over many words).

Rules become anchored globs over the canonical URL, which is host plus path.  In a glob
``?`` takes one byte, ``*`` any run of bytes but ``/``, ``**`` any run.  A glob of m
consuming items owns m + 1 adjacent bits; bit i means that its first i items have taken what was
read.  One byte moves every glob of every URL of a batch at once:

    state = ((state << 1) & takes[byte]) | (state & loops[byte])

with the shift's carry passed from word to word.  ``loops`` holds the bits whose next item
is a star.

Defined results: a null URL and one without ``://`` have empty host and path and fit no
rule; URLs of any length are read to their end; repeated rows are judged alike; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def globs(self) -> tuple[str, str]:
        text = "".join(f"\\{c}" if c in "*?\\" else c for c in self.host + self.path)
        return f"{text}**", f"*.{text}**"


#: The rules that the query judges by.
RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path, as the module's docstring defines them."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    host_end = min(ends, default=len(rest))
    tail = rest[host_end:]
    path_end = min([i for i in (tail.find("?"), tail.find("#")) if i >= 0], default=len(tail))
    return rest[:host_end].encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass"), tail[:path_end]


class Automaton:
    """All globs simulated at once; the state is a row of 64-bit words per text."""

    def __init__(self, globs: list[str]):
        parsed = [self._parse(g) for g in globs]
        width = sum(len(items) + 1 for items, _ in parsed)
        n_words = max(1, -(-width // 64))
        takes = np.zeros((256, n_words), np.uint64)
        loops = np.zeros((256, n_words), np.uint64)
        start = np.zeros(n_words, np.uint64)
        self.accept: list[tuple[int, np.uint64]] = []
        base = 0
        for items, stars in parsed:
            start[base // 64] |= np.uint64(1 << (base % 64))
            for i, item in enumerate(items, base + 1):
                bit = np.uint64(1 << (i % 64))
                takes[slice(None) if item is None else item, i // 64] |= bit
            for i, crosses in stars.items():
                word, bit = (base + i) // 64, np.uint64(1 << ((base + i) % 64))
                loops[:, word] |= bit
                if not crosses:
                    loops[ord("/"), word] &= ~bit
            last = base + len(items)
            self.accept.append((last // 64, np.uint64(1 << (last % 64))))
            base += len(items) + 1
        self.takes, self.loops, self.start = takes, loops, start

    @staticmethod
    def _parse(glob: str) -> tuple[list[int | None], dict[int, bool]]:
        """Consuming items (a byte, or None for any) and, by items taken, whether a star there crosses ``/``."""
        items: list[int | None] = []
        stars: dict[int, bool] = {}
        i = 0
        while i < len(glob):
            c = glob[i]
            if c == "*":
                crosses = glob[i : i + 2] == "**"
                stars[len(items)] = crosses or stars.get(len(items), False)
                i += 1 + crosses
                continue
            if c == "\\" and i + 1 < len(glob):
                i += 1
                c = glob[i]
                items += c.encode()
            elif c == "?":
                items.append(None)
            else:
                items += c.encode()
            i += 1
        return items, stars

    def match(self, texts: list[bytes]) -> np.ndarray:
        """One row per text, one column per glob: whether the whole text fits."""
        n = len(texts)
        lengths = np.fromiter(map(len, texts), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        out = np.zeros((n, len(self.accept)), bool)
        buf = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
        starts = np.concatenate([[0], np.cumsum(lengths)])[:-1][order]
        lengths = lengths[order]
        state = np.tile(self.start, (n, 1))
        alive = n
        at = 0
        rows = np.arange(n)  # positions in `order` still being read
        while True:
            # texts that end here: longest first, so they are the last of those alive
            ended = alive - int(np.searchsorted(-lengths[:alive], -at, side="left"))
            if ended:
                final = state[alive - ended : alive]
                for g, (word, bit) in enumerate(self.accept):
                    out[order[rows[alive - ended : alive]], g] = (final[:, word] & bit) != 0
                alive -= ended
            if not alive:
                return out
            byte = buf[starts[:alive] + at]
            s = state[:alive]
            shifted = s << np.uint64(1)
            if s.shape[1] > 1:
                shifted[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:alive] = (shifted & self.takes[byte]) | (s & self.loops[byte])
            at += 1


def judge(urls: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) per row of ``urls``: the longest fitting rule's name and
    verdict, else a null rule and ``default``."""
    ranked = sorted(rules, key=lambda r: (-len(r.name.encode()), r.name))
    id_type = urls.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton([g for r in ranked for g in r.globs()])
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            fits = automaton.match([(h + p).encode("utf-8", "surrogatepass") for h, p in parts])
            fits = fits.reshape(len(parts), len(ranked), 2).any(axis=2) if ranked else np.zeros((len(parts), 1), bool)
            best = np.where(fits.any(axis=1), fits.argmax(axis=1), -1).tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([ranked[b].name if b >= 0 else None for b in best], pa.string()),
                    pa.array([ranked[b].verdict if b >= 0 else default for b in best], pa.string()),
                ],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    return urls.select(id_col, url_col).mapInArrow(run, f"`{id_col}` {id_type}, host string, path string, rule string, verdict string")
