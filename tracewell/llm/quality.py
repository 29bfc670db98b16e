"""Quality by a byte-level convolutional network, in numpy.

Bytes are embedded (learned), with one more channel that tells whether the last eight bytes
repeat what stood 2 to 32 bytes before.  Learned filters of 12 bytes, every 4 bytes, are rectified
and max-pooled in chunks of 256 bytes that overlap by half and cover the whole text.  Each
filter's maximum over the chunks and its mean over them are combined by a logistic unit into one
probability.  Texts are read in slabs, so that what is held beside a text does not grow with it.

Training minimises log loss by Adam on a bounded sample (rows and bytes a row), with gradients through the maxima.

Defined results: null and empty texts are scored as one chunk of padding; texts are read whole
at any length; repeated rows score alike; where the sample lacks a class the score is 0.5
throughout; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.llm import samples
from tracewell.llm.common import fold as id_fold
from tracewell.llm.common import slices, small_batches

STRIDE, TAPS = 4, 3  # a filter spans STRIDE * TAPS bytes
HALF = 32  # positions per half chunk: 128 bytes
LAGS = range(2, 33)
SLAB = 1 << 18
MAX_ROWS = 1500


def repeats(x: np.ndarray) -> np.ndarray:
    """Whether the eight bytes that end here also ended 2 to 32 bytes before."""
    out = np.zeros(len(x), bool)
    n = len(x) - 7
    if n <= LAGS[0]:
        return out
    g = x[:n].astype(np.uint64)
    for i in range(1, 8):
        g |= x[i : i + n].astype(np.uint64) << np.uint64(8 * i)
    hit = np.zeros(n, bool)
    for lag in LAGS:
        if lag < n:
            hit[lag:] |= g[lag:] == g[:-lag]
    out[7:] = hit
    return out


@dataclass
class Network:
    embed: np.ndarray  # (256, D)
    taps: np.ndarray  # (TAPS, STRIDE * (D + 1), F)
    bias: np.ndarray  # (F,)
    out: np.ndarray  # (2 F,)
    offset: float
    trained: bool = True

    @classmethod
    def fresh(cls, rng: np.random.Generator, dims: int = 6, filters: int = 24) -> Network:
        width = STRIDE * (dims + 1)
        return cls(
            rng.normal(0, 0.5, (256, dims)).astype(np.float32),
            rng.normal(0, 1 / np.sqrt(TAPS * width), (TAPS, width, filters)).astype(np.float32),
            np.zeros(filters, np.float32),
            rng.normal(0, 0.1, 2 * filters).astype(np.float32),
            0.0,
        )

    def _responses(self, x: np.ndarray, repeated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blocks = np.concatenate([self.embed[x], repeated[:, None]], axis=1).reshape(len(x) // STRIDE, -1)
        m = len(blocks) - TAPS + 1
        out = blocks[:m] @ self.taps[0]
        for j in range(1, TAPS):
            out += blocks[j : j + m] @ self.taps[j]
        out += self.bias
        return blocks, np.maximum(out, 0, out=out)

    def features(self, text: bytes) -> np.ndarray:
        """Maximum over chunks, and mean over chunks, of the chunks' maxima."""
        top = total = last = None
        chunks = 0
        for x, repeated in slabs(text, SLAB // (STRIDE * HALF) * STRIDE * HALF):
            _, r = self._responses(x, repeated)
            half = r.reshape(-1, HALF, r.shape[1]).max(axis=1)
            if last is not None:
                half = np.concatenate([last, half])
            last = half[-1:]
            if len(half) > 1:
                both = np.maximum(half[:-1], half[1:])
                top = both.max(axis=0) if top is None else np.maximum(top, both.max(axis=0))
                total = both.sum(axis=0, dtype=np.float64) + (0 if total is None else total)
                chunks += len(both)
        if not chunks:
            return np.concatenate([last[0], last[0]])
        return np.concatenate([top, (total / chunks).astype(np.float32)])

    def score(self, text: bytes) -> float:
        if not self.trained:
            return 0.5
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.out + self.offset, -40, 40))))


def slabs(text: bytes, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and repeat channel of ``step`` bytes' positions at a time, padded so that positions fill whole half chunks."""
    x = np.frombuffer(text, np.uint8)
    positions = max(1, -(-len(x) // STRIDE) - TAPS + 1)
    positions = -(-positions // HALF) * HALF
    size = (positions + TAPS - 1) * STRIDE
    reach = LAGS[-1] + 7  # how far back the repeat channel looks
    for a in range(0, positions * STRIDE, step):
        to = min(size, a + step + STRIDE * (TAPS - 1))
        full, repeated = np.zeros(to - a, np.uint8), np.zeros(to - a, bool)
        held = x[a:to]
        full[: len(held)] = held
        back = min(a, reach)
        repeated[: len(held)] = repeats(x[a - back : to])[back:] if len(held) else False
        yield full, repeated


def padded(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All of a text as one slab."""
    return next(slabs(text, max(1, len(text) + STRIDE * HALF)))


def _step(net: Network, x: np.ndarray, repeated: np.ndarray, label: int, grads: list[np.ndarray]) -> float:
    """Adds one text's gradients; returns its loss."""
    blocks, r = net._responses(x, repeated)
    f = r.shape[1]
    parts = r.reshape(-1, HALF, f)
    arg = parts.argmax(axis=1)
    half = np.take_along_axis(parts, arg[:, None, :], axis=1)[:, 0, :]
    place = arg + np.arange(len(half))[:, None] * HALF
    if len(half) > 1:
        later = half[1:] > half[:-1]
        chunks = np.where(later, half[1:], half[:-1])
        place = np.where(later, place[1:], place[:-1])
    else:
        chunks = half
    top = chunks.argmax(axis=0)
    cols = np.arange(f)
    feats = np.concatenate([chunks[top, cols], chunks.mean(axis=0)])
    logit = (feats @ net.out + net.offset).item()
    p = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
    d = p - label
    grads[3] += d * feats
    grads[4] += d
    dchunks = np.tile(d * net.out[f:] / len(chunks), (len(chunks), 1))
    dchunks[top, cols] += d * net.out[:f]
    dr = np.zeros_like(r)
    np.add.at(dr, (place, cols[None, :].repeat(len(place), 0)), dchunks)
    dr *= r > 0
    used = np.flatnonzero(dr.any(axis=1))
    dr = dr[used]
    grads[2] += dr.sum(axis=0)
    dims = net.embed.shape[1]
    for j in range(TAPS):
        grads[1][j] += blocks[used + j].T @ dr
        back = (dr @ net.taps[j].T).reshape(len(used), STRIDE, dims + 1)[:, :, :dims]
        where = x.reshape(-1, STRIDE)[used + j].ravel()
        for k in range(dims):
            grads[0][:, k] += np.bincount(where, back[:, :, k].ravel(), 256)
    return float(-np.log(max(1e-9, p if label else 1 - p)))


def learn(sample: Iterator[tuple[str | None, int]], epochs: int = 6, batch: int = 16, rate: float = 0.01, seed: int = 11) -> Network:
    """A network from (text, label) rows, which must be few enough for one machine."""
    rows = [(*padded((t or "").encode("utf-8", "surrogatepass")), int(y)) for t, y in sample]
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    if len({y for _, _, y in rows}) < 2:
        net.trained = False
        return net
    net.offset = np.zeros(1)
    params = [net.embed, net.taps, net.bias, net.out, net.offset]
    first = [np.zeros(p.shape) for p in params]
    second = [np.zeros(p.shape) for p in params]
    steps = 0
    total = epochs * -(-len(rows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), batch):
            grads = [np.zeros(p.shape) for p in params]
            chosen = order[a : a + batch]
            for n in chosen:
                _step(net, *rows[n], grads)
            steps += 1
            now = rate * (1 - steps / (total + 1))
            for i, p in enumerate(params):
                g = grads[i] / len(chosen)
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                p -= (now * (first[i] / (1 - 0.9**steps)) / (np.sqrt(second[i] / (1 - 0.99**steps)) + 1e-8)).astype(p.dtype)
    net.offset = float(net.offset[0])
    return net


def fit(documents: DataFrame, labels: DataFrame, train: Column | None = None, max_rows: int = MAX_ROWS) -> Network:
    """A network trained on at most ``max_rows`` labelled rows per class, by default of ids whose crc32 modulo 5 is not 0."""
    train = id_fold("doc_id", 5) != 0 if train is None else train
    sample = samples.labelled_texts(documents, labels, "quality", max_rows, train)
    return learn((r["text"], r["label"]) for r in samples.stream(sample))


def score(documents: DataFrame, network: Network) -> DataFrame:
    """(doc_id, score) per row."""
    id_type = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole):
                scores = [network.score((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return small_batches(documents).select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, score double")


def predicted(cut: float = 0.3) -> Column:
    return (F.col("score") >= cut).cast("int")
