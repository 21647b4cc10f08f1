"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

Tokens are runs of letters, digits and non-ASCII bytes, in lower case. A token's inputs are of words and of characters:
smoothed log-odds, learned from document counts, of the hashed whole token and of its first 4, 6 and 8 and last 5 bytes,
and the mean of its bytes' learned embeddings. A GRU reads each window of 16 tokens in both directions, attention weighs
its states, and a window has one logit. Windows overlap by half and cover the whole text; the text's score is that of its
most toxic window, and it is through that window that the network learns.

Edge cases: null text counts as empty; a text without tokens has the score of one window of zero inputs; texts of any
length are scored whole; without labelled rows the score is 0.5; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from flowloom.llm import bytescan
from flowloom.llm.fitting import Adam, epochs, sample, sigmoid

BUCKETS, AFFIXES, CHARS, HIDDEN, WINDOW, PRIOR = 1 << 18, (4, 6, 8, -5), 4, 8, 16, 10.0
INPUTS = 1 + len(AFFIXES) + CHARS
#: Bounds of the sample to learn from.
FIT_ROWS, FIT_BYTES, LIKELY = 3000, 40_000, 6


def _token_spans(b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = (b >= 0x80) | ((b >= 97) & (b <= 122)) | ((b >= 48) & (b <= 57))
    before, after = np.concatenate(([False], inside[:-1])), np.concatenate((inside[1:], [False]))
    before[cuts], after[cuts - 1] = False, False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


class WindowGRU:
    def __init__(self, seed: int = 11):
        rng, f32 = np.random.default_rng(seed), np.float32
        normal = lambda s, *shape: rng.normal(0, s, shape).astype(f32)
        self.rate = 0.5
        self.odds = np.zeros((1 + len(AFFIXES), BUCKETS), f32)
        self.p = {"chars": normal(0.1, 256, CHARS), "att": normal(0.3, 2 * HIDDEN), "out": normal(0.3, 2 * HIDDEN), "bias": np.zeros(1, f32)}
        for d in "fb":
            self.p |= {f"wx{d}": normal(0.3, INPUTS, 3 * HIDDEN), f"wh{d}": normal(0.3, HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, f32)}

    def tokens(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """Buckets of each token's whole and affixes, its mean character vector, tokens before each text, and byte spans for learning."""
        b, offsets = bytescan.text_bytes(texts)
        b = bytescan.lower(b)
        buckets, chars, places, spans = [], [], [], []
        for lo, hi in bytescan.segments(b, offsets):
            part = b[lo:hi]
            s, e = _token_spans(part, bytescan.inner_cuts(offsets, lo, hi))
            if not len(s):
                continue
            of = lambda i, j: (bytescan.span_hashes(part, i, j) & np.uint64(BUCKETS - 1)).astype(np.int32)  # noqa: E731, B023
            buckets.append(np.stack([of(s, e), *(of(s, np.minimum(e, s + n)) if n > 0 else of(np.maximum(s, e + n), e) for n in AFFIXES)]))
            each = np.add.reduceat(self.p["chars"][np.append(part, np.uint8(0))], np.stack((s, e), axis=1).ravel(), axis=0)[::2]  # a token's own bytes alone
            chars.append(each / (e - s)[:, None].astype(np.float32))
            places.append(s + lo)
            spans.append((s + lo, e + lo))
        if not places:
            return np.zeros((1 + len(AFFIXES), 0), np.int32), np.zeros((0, CHARS), np.float32), np.zeros(len(offsets), np.int64), (b, np.zeros(0, np.int64), np.zeros(0, np.int64))
        at = np.searchsorted(np.concatenate(places), offsets, "left")
        return np.concatenate(buckets, axis=1), np.concatenate(chars), at, (b, *(np.concatenate(x) for x in zip(*spans, strict=True)))

    @staticmethod
    def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token numbers of each window [windows, WINDOW], -1 where a text has no more; windows before each text."""
        half, size = WINDOW // 2, np.diff(at)
        n = np.maximum(1, -(-(size - half) // half))
        upto = np.concatenate(([0], np.cumsum(n)))
        first = np.repeat(at[:-1], n) + half * (np.arange(upto[-1]) - np.repeat(upto[:-1], n))
        which = first[:, None].astype(np.int32) + np.arange(WINDOW, dtype=np.int32)
        return np.where(which < np.repeat(at[1:], n)[:, None], which, np.int32(-1)), upto

    def _inputs(self, buckets: np.ndarray, chars: np.ndarray, odds: np.ndarray | None = None) -> np.ndarray:
        odds = np.stack([o[k] for o, k in zip(self.odds, buckets, strict=True)]) if odds is None else odds
        return np.concatenate((np.concatenate((odds.T, chars), axis=1), np.zeros((1, INPUTS), np.float32)))  # the last row pads

    def _direction(self, d: str, x: np.ndarray, which: np.ndarray, keep: bool):
        """States [WINDOW, windows, HIDDEN] in reading order of direction d."""
        proj = x @ self.p[f"wx{d}"] + self.p[f"c{d}"]
        h, states, memory = np.zeros((len(which), HIDDEN), np.float32), [], []
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            a, u = proj[which[:, t]], h @ self.p[f"wh{d}"]
            gates = sigmoid(a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(a[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            if keep:
                memory.append((t, h, z, r, new, u[:, 2 * HIDDEN :]))
            h = new + z * (h - new)
            states.append(h)
        return (states if d == "f" else states[::-1]), memory

    def _forward(self, x: np.ndarray, which: np.ndarray, keep: bool = False):
        sides = [self._direction(d, x, which, keep) for d in "fb"]
        s = np.concatenate([np.stack(side[0]) for side in sides], axis=2)
        e = np.exp(np.tanh(s @ self.p["att"]) * 3)
        a = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", a, s)
        return pooled @ self.p["out"] + self.p["bias"][0], (sides, s, a, pooled)

    def logits(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(x, which[lo : lo + 1024])[0] for lo in range(0, len(which), 1024)])

    def score(self, texts: pa.Array) -> np.ndarray:
        out = []
        for lo in range(0, len(texts), 128):
            buckets, chars, at, _ = self.tokens(texts.slice(lo, 128))
            which, upto = self.windows(at)
            out.append(sigmoid(np.maximum.reduceat(self.logits(self._inputs(buckets, chars), which), upto[:-1]).astype(np.float64)))
        return np.concatenate(out) if out else np.zeros(0)

    def _log_odds(self, toxic: np.ndarray, n: np.ndarray) -> np.ndarray:
        p = self.rate
        return (np.log((toxic + PRIOR * p) / (n - toxic + PRIOR * (1 - p))) - np.log(p / (1 - p))).astype(np.float32)

    def fit(self, texts: list[str], y: np.ndarray, prior: float, batch: int = 64, rate: float = 0.01) -> WindowGRU:
        """prior: the share of label 1 among all labelled documents, of which the sample may hold more. Eight passes, more if the sample is small."""
        times = max(8, min(40, 24_000 // max(len(texts), 1)))
        if not len(texts) or not 0 < y.mean() < 1:
            self.p["out"][:] = 0
            return self
        self.rate = float(y.mean())
        column = pa.array(texts)
        buckets, _, at, spans = self.tokens(column)
        doc = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(at))
        toxic, seen = (np.zeros((len(buckets), BUCKETS), np.float32) for _ in range(2))
        for k, own in enumerate(buckets):
            once = np.unique(doc.astype(np.int64) * BUCKETS + own)
            seen[k] = np.bincount(once % BUCKETS, minlength=BUCKETS)
            toxic[k] = np.bincount(once % BUCKETS, y[once // BUCKETS], BUCKETS)
        self.odds = self._log_odds(toxic, seen)
        # a document that is learned from doesn't count in its own odds
        odds = np.stack([self._log_odds(toxic[k, own] - y[doc], seen[k, own] - 1) for k, own in enumerate(buckets)])
        which, upto = self.windows(at)
        rank = np.concatenate((odds.sum(axis=0), [0]))[which].max(axis=1)
        order = np.lexsort((-rank, np.repeat(np.arange(len(y)), np.diff(upto))))
        likely = [order[lo : min(hi, lo + LIKELY)] for lo, hi in zip(upto[:-1], upto[1:], strict=True)]  # each text's most suspect windows
        best, adam, last = np.array([w[0] for w in likely]), Adam(self.p, rate), 0
        for e, rows in epochs(len(y), batch, times):
            if e != last:  # which of them is the most toxic, as seen now
                best, last = self._best(likely, which, odds, spans), e
            adam.step(self._gradients(which[best[rows]], odds, spans, y[rows]))
        self.p["bias"] += np.float32(np.log(prior / (1 - prior)) - np.log(self.rate / (1 - self.rate)))
        return self

    def _best(self, likely: list[np.ndarray], which: np.ndarray, odds: np.ndarray, spans: tuple) -> np.ndarray:
        flat, upto = np.concatenate(likely), np.concatenate(([0], np.cumsum([len(w) for w in likely])))
        logit = np.concatenate([self._forward(*self._window_inputs(which[flat[lo : lo + 1024]], odds, spans)[:2])[0] for lo in range(0, len(flat), 1024)])
        return np.array([flat[lo + int(np.argmax(logit[lo:hi]))] for lo, hi in zip(upto[:-1], upto[1:], strict=True)])

    def _window_inputs(self, tokens: np.ndarray, odds: np.ndarray, spans: tuple):
        """Inputs of windows [n, WINDOW] of token numbers, their rows by place, and each byte's row, value and weight."""
        (b, s, e), own = spans, tokens.ravel()
        live = np.flatnonzero(own >= 0)
        size = (e - s)[own[live]]
        owner = np.repeat(live, size)
        byte = b[np.arange(size.sum()) + np.repeat(s[own[live]] - np.cumsum(size) + size, size)]
        weight = (1 / np.repeat(size, size)).astype(np.float32)
        x = np.zeros((len(own) + 1, INPUTS), np.float32)
        x[live, : len(odds)] = odds[:, own[live]].T
        for k in range(CHARS):
            x[:-1, len(odds) + k] = np.bincount(owner, self.p["chars"][byte, k] * weight, len(own))
        return x, np.where(tokens >= 0, np.arange(len(own)).reshape(tokens.shape), len(own)), (owner, byte, weight)

    def _gradients(self, tokens: np.ndarray, odds: np.ndarray, spans: tuple, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log-loss of windows [n, WINDOW] of token numbers."""
        p = self.p
        x, which, (owner, byte, weight) = self._window_inputs(tokens, odds, spans)
        logit, (sides, st, a, pooled) = self._forward(x, which, True)
        d = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        g = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
        dpooled = d[:, None] * p["out"]
        dst = a[..., None] * dpooled
        da = np.einsum("tnh,nh->tn", st, dpooled)
        th = np.tanh(st @ p["att"])
        dth = 3 * a * (da - (a * da).sum(axis=0)) * (1 - th * th)
        g["att"] = np.einsum("tn,tnh->h", dth, st)
        dst = dst + dth[..., None] * p["att"]
        dx = np.zeros_like(x)
        for i, dname in enumerate("fb"):
            wh, side = p[f"wh{dname}"], dst[..., i * HIDDEN : (i + 1) * HIDDEN]
            dproj, dwh = np.zeros((len(x), 3 * HIDDEN), np.float32), np.zeros_like(wh)
            carry = np.zeros((len(y), HIDDEN), np.float32)
            for t, h, z, r, new, un in reversed(sides[i][1]):
                dh = side[t] + carry
                dn = dh * (1 - z) * (1 - new * new)
                dz = dh * (h - new) * z * (1 - z)
                dr = dn * un * r * (1 - r)
                da_ = np.concatenate((dz, dr, dn), axis=1)
                du = np.concatenate((dz, dr, dn * r), axis=1)
                np.add.at(dproj, which[:, t], da_)
                dwh += h.T @ du
                carry = dh * z + du @ wh.T
            g |= {f"wx{dname}": x.T @ dproj, f"wh{dname}": dwh, f"c{dname}": dproj.sum(axis=0)}
            dx += dproj @ p[f"wx{dname}"].T
        per_byte = dx[owner, len(odds) :] * weight[:, None]
        g["chars"] = np.stack([np.bincount(byte, per_byte[:, k], 256) for k in range(CHARS)], axis=1).astype(np.float32)
        return g


def fit(docs: DataFrame, labels: DataFrame, where: Column, label: str = "toxic", id: str = "doc_id", text: str = "text", rows: int = FIT_ROWS, most_bytes: int = FIT_BYTES) -> WindowGRU:
    """Learn from at most `rows` labelled documents of at most most_bytes for which where holds, half of them toxic if there are so many."""
    return WindowGRU().fit(*sample(docs, labels, label, id, text, where, rows, most_bytes, most_ones=rows // 2))
