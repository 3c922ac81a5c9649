"""Vectorised byte helpers used inside tasks (numpy over Arrow buffers, in bounded blocks)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)
_pow = {"n": 0, "p": None, "i": None}

WS = np.zeros(256, bool)
WS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d, o


def blocks(offsets: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges [lo, hi) of at most ``most`` bytes each (a longer row stands alone)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def spaced(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows lo..hi in one buffer with a blank before each and at the end; and each row's first place."""
    o = offsets[lo:hi + 1] - offsets[lo]
    buf = np.full(int(o[-1]) + hi - lo + 1, 32, np.uint8)
    at = np.arange(int(o[-1])) + np.repeat(np.arange(1, hi - lo + 1), np.diff(o))
    buf[at] = data[offsets[lo]:offsets[hi]]
    return buf, o[:-1] + np.arange(1, hi - lo + 1)


def words(buf: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes."""
    w = np.zeros(len(buf) + 2, np.int8)
    w[1:-1] = is_word[buf]
    d = np.diff(w)
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        n = max(n, 1 << 16)
        for k, base in (("p", _R), ("i", _RINV)):
            a = np.full(n, base, U64)
            a[0] = 1
            _pow[k] = np.cumprod(a, dtype=U64)
        _pow["n"] = n
    return _pow["p"], _pow["i"]


def prefix_hash(buf: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial modulo 2**64; ``span_hash`` reads any substring's hash from them."""
    p, _ = _powers(len(buf) + 1)
    h = np.zeros(len(buf) + 1, U64)
    np.cumsum((buf.astype(U64) + U64(1)) * p[:len(buf)], out=h[1:])
    return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def span_hash(h: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [s, e); equal substrings agree in every buffer."""
    _, inv = _powers(len(h))
    return mix((h[e] - h[s]) * inv[s])


def gram_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all substrings of length k."""
    n = len(h) - k
    _, inv = _powers(len(h))
    return mix((h[k:] - h[:n]) * inv[:n])


def spans_to_indices(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total) + shift


def forest(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Component label (smallest member) of n local nodes under the edges (u, v)."""
    lab = np.arange(n)
    while len(u):
        a, b = lab[u], lab[v]
        keep = a != b
        if not keep.any():
            break
        u, v, a, b = u[keep], v[keep], a[keep], b[keep]
        np.minimum.at(lab, np.maximum(a, b), np.minimum(a, b))
        while True:
            nxt = lab[lab]
            if np.array_equal(nxt, lab):
                break
            lab = nxt
    return lab
