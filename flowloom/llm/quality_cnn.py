"""A byte-level convolutional quality classifier in numpy.

Bytes are embedded, filters of 8 bytes move over the whole text two bytes at a time, and each filter keeps its maximum in
every chunk of 512 bytes; chunks overlap by half. The mean and the maximum over all chunks go through a small hidden layer
to one probability. Embedding, filters and layers are learned by back-propagation with Adam on a bounded sample.

Edge cases: null text counts as empty; an empty text has one chunk of padding and so a score as well; texts of any length
are scored whole, block by block; without labelled rows the score is 0.5; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from flowloom.llm import bytescan
from flowloom.llm.fitting import Adam, epochs, sample, sigmoid

DIM, WIDTH, FILTERS, HIDDEN, BLOCK, BLOCKS = 8, 8, 24, 16, 128, 4
#: Bounds of the sample to learn from.
FIT_ROWS, FIT_BYTES = 4000, 60_000
_NO_BLOCKS = np.zeros(0, np.int64)


class ByteCNN:
    def __init__(self, seed: int = 7):
        rng, f32 = np.random.default_rng(seed), np.float32
        self.p = {
            "embed": rng.normal(0, 0.5, (256, DIM)).astype(f32),
            "filters": rng.normal(0, 1 / np.sqrt(WIDTH * DIM), (WIDTH * DIM, FILTERS)).astype(f32),
            "bias": np.zeros(FILTERS, f32),
            "w1": rng.normal(0, 0.3, (2 * FILTERS, HIDDEN)).astype(f32),
            "b1": np.zeros(HIDDEN, f32),
            "w2": np.zeros(HIDDEN, f32),
            "b2": np.zeros(1, f32),
        }

    def _pad(self, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts one after another, each followed by WIDTH zeros or more up to a whole number of blocks; blocks before each."""
        blocks = -(-(np.diff(offsets) + WIDTH) // BLOCK)
        at = np.concatenate(([0], np.cumsum(blocks)))
        out = np.zeros(at[-1] * BLOCK, np.uint8)
        out[np.arange(len(b)) + np.repeat(at[:-1] * BLOCK - offsets[:-1], np.diff(offsets))] = b
        return out, at

    def _responses(self, padded: np.ndarray, last: np.ndarray = _NO_BLOCKS) -> np.ndarray:
        """Each filter's response at every second byte: [blocks, BLOCK / 2, FILTERS]; none where it would reach from a text's last block into the next text."""
        x = self.p["embed"][np.concatenate((padded, np.zeros(WIDTH, np.uint8)))].reshape(-1, 2 * DIM)
        n, out = len(padded) // 2, None
        for j in range(WIDTH // 2):
            part = x[j : j + n] @ self.p["filters"][2 * DIM * j : 2 * DIM * (j + 1)]
            out = part if out is None else np.add(out, part, out=out)
        out = out.reshape(-1, BLOCK // 2, FILTERS)
        out[last, 1 - WIDTH // 2 :] = -np.inf
        return out

    def _maxima(self, padded: np.ndarray, last: np.ndarray = _NO_BLOCKS) -> np.ndarray:
        """Maxima by block and filter. Each step sees the block after it too, so that its last filters meet the text and no zeros."""
        out, step = [], 512
        for lo in range(0, len(padded) // BLOCK, step):
            own = last[np.searchsorted(last, lo) : np.searchsorted(last, lo + step)] - lo
            out.append(self._responses(padded[lo * BLOCK : (lo + step + 1) * BLOCK], own)[:step].max(axis=1))
        return np.concatenate(out)

    @staticmethod
    def _chunks(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First block of each chunk, and chunks before each text: BLOCKS blocks every BLOCKS / 2."""
        n = np.maximum(1, -(-(np.diff(at) - BLOCKS // 2) // (BLOCKS // 2)))
        upto = np.concatenate(([0], np.cumsum(n)))
        return np.repeat(at[:-1], n) + (BLOCKS // 2) * (np.arange(upto[-1]) - np.repeat(upto[:-1], n)), upto

    def _pooled(self, maxima: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
        first, upto = self._chunks(at)
        last = np.repeat(at[1:], np.diff(upto)) - 1
        which = np.minimum(first[:, None] + np.arange(BLOCKS), last[:, None])
        raw = maxima[which].max(axis=1)
        return np.maximum(raw + self.p["bias"], 0), which, upto

    def _head(self, chunk: np.ndarray, upto: np.ndarray) -> tuple[np.ndarray, ...]:
        mean = np.add.reduceat(chunk, upto[:-1]) / np.diff(upto)[:, None]
        x = np.concatenate((mean, np.maximum.reduceat(chunk, upto[:-1])), axis=1).astype(np.float32)
        h = np.tanh(x @ self.p["w1"] + self.p["b1"])
        return x, h, sigmoid(h @ self.p["w2"] + self.p["b2"][0])

    def score(self, texts: pa.Array) -> np.ndarray:
        out = []
        for lo in range(0, len(texts), 64):
            padded, at = self._pad(*bytescan.text_bytes(texts.slice(lo, 64)))
            chunk, _, upto = self._pooled(self._maxima(padded, at[1:] - 1), at)
            out.append(self._head(chunk, upto)[2])
        return np.concatenate(out) if out else np.zeros(0)

    def fit(self, texts: list[str], y: np.ndarray, batch: int = 32, rate: float = 0.005) -> ByteCNN:
        """Six passes over the sample, more if it is small."""
        times = max(6, min(60, 20_000 // max(len(texts), 1)))
        adam = Adam(self.p, rate)
        for _, rows in epochs(len(texts), batch, times):
            adam.step(self._gradients(pa.array([texts[i] for i in rows]), y[rows]))
        return self

    def _gradients(self, texts: pa.Array, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        padded, at = self._pad(*bytescan.text_bytes(texts))
        r = self._responses(padded, at[1:] - 1)
        places = r.argmax(axis=1)
        maxima = np.take_along_axis(r, places[:, None], 1)[:, 0]
        chunk, which, upto = self._pooled(maxima, at)
        x, h, prob = self._head(chunk, upto)
        d = ((prob - y) / len(y)).astype(np.float32)
        g = {"w2": h.T @ d, "b2": d.sum(keepdims=True)}
        dh = d[:, None] * p["w2"] * (1 - h * h)
        g |= {"w1": x.T @ dh, "b1": dh.sum(axis=0)}
        dx = dh @ p["w1"].T
        n, doc = np.diff(upto), np.repeat(np.arange(len(y)), np.diff(upto))
        best = (chunk == x[doc, FILTERS:]) & (chunk > 0)
        ties = np.maximum(np.add.reduceat(best, upto[:-1]), 1)
        dchunk = (dx[:, :FILTERS] / n[:, None])[doc] + best * (dx[:, FILTERS:] / ties)[doc]
        dchunk *= chunk > 0
        g["bias"] = dchunk.sum(axis=0)
        block = np.take_along_axis(which, maxima[which].argmax(axis=1), 1)
        byte = block * BLOCK + 2 * places[block, np.arange(FILTERS)]
        seen = np.concatenate((padded, np.zeros(WIDTH, np.uint8)))[byte[..., None] + np.arange(WIDTH)]
        windows = p["embed"][seen].reshape(len(chunk), FILTERS, WIDTH * DIM)
        g["filters"] = np.einsum("cf,cfw->wf", dchunk, windows, optimize=True).astype(np.float32)
        dw = (dchunk[..., None] * p["filters"].T).reshape(-1, DIM)
        g["embed"] = np.stack([np.bincount(seen.ravel(), dw[:, k], 256) for k in range(DIM)], axis=1).astype(np.float32)
        return g


def fit(docs: DataFrame, labels: DataFrame, where: Column, label: str = "quality", id: str = "doc_id", text: str = "text", rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> ByteCNN:
    """Learn from at most `rows` labelled documents of at most most_bytes for which where holds."""
    return ByteCNN().fit(*sample(docs, labels, label, id, text, where, rows, most_bytes)[:2])
