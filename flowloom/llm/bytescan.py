"""Words of Arrow text columns found and hashed in bulk by numpy, in segments of bounded size."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are looked at together; a single word longer than that makes its segment longer.
SEGMENT = 1 << 20
#: Odd multiplier for combining hashes that are mixed already.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Spans of up to LONG bytes are hashed in lanes of 8 bytes, longer ones one by one.
LONG = 256
_LANES = np.random.default_rng(20250611).integers(0, 1 << 63, LONG // 8 + 1, np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the n+1 offsets of its texts; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets and len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def is_blank(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13))


def lower(b: np.ndarray) -> np.ndarray:
    """A-Z in lower case, other bytes as they are."""
    return np.where((b >= 65) & (b <= 90), b + np.uint8(32), b).astype(np.uint8)


def segments(b: np.ndarray, offsets: np.ndarray, size: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of about size bytes that cut neither texts' words nor, where a text is short, texts."""
    lo, total = 0, int(offsets[-1])
    while lo < total:
        hi = min(lo + size, total)
        if hi < total:
            edge = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
            if edge <= lo:
                blank = np.flatnonzero(is_blank(b[lo:hi]))
                if len(blank):
                    edge = lo + int(blank[-1]) + 1
                else:
                    ahead, edge = hi, total
                    while ahead < total and edge == total:
                        found = np.flatnonzero(is_blank(b[ahead : ahead + size]))
                        edge, ahead = (ahead + int(found[0]) if len(found) else total), ahead + size
                    later = offsets[np.searchsorted(offsets, hi, "left")]
                    edge = min(edge, int(later))
            hi = edge
        yield lo, hi
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """Final mixing of 64-bit hashes."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _loads(b: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number; zeros follow the end."""
    padded = np.concatenate((b, np.zeros(8, np.uint8)))
    return np.ndarray(len(b) + 1, "<u8", padded, strides=(1,))


def _lanes(size: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(lane, spans that reach into it, mask of their bytes in it) for spans of up to LONG bytes."""
    live = np.flatnonzero((size > 0) & (size <= LONG))
    lane = 0
    while len(live):
        yield lane, live, _MASKS[np.minimum(size[live] - 8 * lane, 8)]
        lane += 1
        live = live[size[live] > 8 * lane]


def span_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes hash equally wherever they stand.

    Every lane of 8 bytes goes through a mixing that is not linear, so texts with a regular structure don't collide by it.
    Other texts may, once in 2^64: whoever acts on equal hashes of different origin compares the bytes as well."""
    size = ends - starts
    h, eight = mix(size.astype(np.uint64) * BASE + np.uint64(1)), _loads(b)
    for lane, live, mask in _lanes(size):
        h[live] = mix(h[live] ^ (eight[starts[live] + 8 * lane] & mask) ^ _LANES[lane]) * BASE
    for k in np.flatnonzero(size > LONG):
        h[k] = int.from_bytes(hashlib.blake2b(b[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def same_spans(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, c: np.ndarray, from_: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether the bytes of each span of b equal those of the span of c at the same place of the list."""
    size = ends - starts
    same = size == to - from_
    one, two = _loads(b), _loads(c)
    for lane, live, mask in _lanes(np.where(same, size, 0)):
        same[live] &= ((one[starts[live] + 8 * lane] ^ two[from_[live] + 8 * lane]) & mask) == 0
    for k in np.flatnonzero(same & (size > LONG)):
        same[k] = np.array_equal(b[starts[k] : ends[k]], c[from_[k] : to[k]])
    return same


def kinds(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and first span of each distinct text among the spans, and each span's kind. Kinds are told apart by their bytes; two may have one hash."""
    hashes, first, which = np.unique(span_hashes(b, starts, ends), return_index=True, return_inverse=True)
    odd = np.flatnonzero(~same_spans(b, starts, ends, b, starts[first[which]], ends[first[which]]))
    if len(odd):
        other: dict[bytes, int] = {}
        own = hashes[which[odd]]
        for k in odd.tolist():
            place = other.setdefault(b[starts[k] : ends[k]].tobytes(), len(first))
            if place == len(first):
                first = np.append(first, k)
            which[k] = place
        hashes = np.concatenate((hashes, own[np.searchsorted(odd, first[len(hashes) :])]))
    return hashes, first, which


def word_spans(b: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in a segment; no word crosses a cut (0 < cut < len(b))."""
    blank = is_blank(b)
    before, after = np.concatenate(([True], blank[:-1])), np.concatenate((blank[1:], [True]))
    before[cuts], after[cuts - 1] = True, True
    return np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1


def inner_cuts(offsets: np.ndarray, lo: int, hi: int) -> np.ndarray:
    return offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, hi, "left")] - lo


def word_hashes(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, in order, and the n+1 positions at which each text's words begin."""
    hashes, places = [], []
    for lo, hi in segments(b, offsets):
        part = b[lo:hi]
        starts, ends = word_spans(part, inner_cuts(offsets, lo, hi))
        if len(starts):
            hashes.append(span_hashes(part, starts, ends))
            places.append(starts + lo)
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), offsets, "left")
