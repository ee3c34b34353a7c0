"""Vectorised word shingles over Arrow string arrays: no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
KEY_BITS = 48
KEY_MASK = U((1 << KEY_BITS) - 1)
SLICE_BYTES, SLICE_DOCS = 1 << 20, 1 << 16
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = [U(int(x) * 2 + 1) for x in _rng.integers(1, 2**62, 8)]
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD = np.zeros(256, dtype=bool)
_WORD[np.r_[48:58, 65:91, 97:123, 128:256]] = True
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose bits all depend on all (splitmix's finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, base, dtype=U)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of rows) of lower-cased consecutive rows, at most about a megabyte each. A null is an empty text."""
    low = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    if not len(low):
        return
    _, off, data = low.buffers()
    off = np.frombuffer(off, np.int64)[low.offset : low.offset + len(low) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(low):
        j = min(max(int(np.searchsorted(off, off[i] + SLICE_BYTES, "right")) - 1, i + 1), i + SLICE_DOCS - 1, len(low))
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def shingle_keys(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, keys, counts): each row's distinct shingles of ``n`` words with how often they occur, rows and then keys ascending.

    A word is a run of letters and digits. A text of fewer than n words, but
    one at least, has all its words as its one shingle. Keys have 48 bits.
    """
    size, rows = len(data), len(off) - 1
    none = np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
    if not size:
        return none
    power, inverse = _power_tables(size + 1)
    w = _WORD[data]
    edge = np.zeros(size + 1, dtype=bool)
    edge[off] = True
    before = np.empty(size, dtype=bool)
    before[0] = False
    np.logical_and(w[:-1], ~edge[1:size], out=before[1:])
    start = np.flatnonzero(w & ~before)
    if not len(start):
        return none
    after = np.empty(size, dtype=bool)
    after[-1] = False
    np.logical_and(w[1:], ~edge[1:size], out=after[:-1])
    end = np.flatnonzero(w & ~after) + 1
    total = np.empty(size + 1, dtype=U)
    total[0] = 0
    np.cumsum(_BYTE[data] * power[:size], out=total[1:])
    word = mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U))
    row = np.searchsorted(off, start, "right") - 1
    have = np.bincount(row, minlength=rows)
    whole = len(word) - n + 1
    if whole > 0:
        s = word[:whole] * _STEP[0]
        for k in range(1, n):
            s = mix(s) + word[k : k + whole] * _STEP[k]
        full = row[:whole] == row[n - 1 :]
        s, at = mix(s[full]), row[:whole][full]
    else:
        s, at = np.zeros(0, U), np.zeros(0, np.int64)
    few = np.flatnonzero((have > 0) & (have < n))
    if len(few):
        first = np.searchsorted(row, few)
        extra = np.array([mix(np.cumsum(word[f : f + have[r]] * np.array(_STEP[: have[r]], U))[-1:])[0] for f, r in zip(first, few)], dtype=U)
        s, at = np.concatenate([s, extra]), np.concatenate([at, few])
    tagged = (s & KEY_MASK) | (at.astype(U) << U(KEY_BITS))
    tagged.sort()
    fresh = np.flatnonzero(np.r_[True, tagged[1:] != tagged[:-1]])
    counts = np.diff(np.r_[fresh, len(tagged)])
    tagged = tagged[fresh]
    return (tagged >> U(KEY_BITS)).astype(np.int64), tagged & KEY_MASK, counts
