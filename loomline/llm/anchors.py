"""Winnowed anchors over token sequences, computed column-wise with NumPy.

A *window* is ``window`` consecutive tokens of one document.  Every window picks one
*anchor*: the leftmost smallest hash among its k-grams.  Equal windows pick the same
k-gram at the same offset, so equal windows always meet under one anchor hash although
only about ``2 / (window - k + 2)`` of all positions become anchors.

Consecutive windows with the same anchor form one *run*; its ``context`` is all tokens
that its windows cover.  Rows are (h, c, doc, meta): the anchor's hash, the context's
hash, the document and ``lo << 24 | n << 12 | off`` with the first window start, the number
of windows and the anchor's offset from ``lo``.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1
U64 = np.uint64
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse modulo 2**64, for i < n at least."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = pow(BASE, -1, 1 << 64)
        up, down = np.full(size, BASE, U64), np.full(size, inverse, U64)
        up[0] = down[0] = 1
        _POWERS[size] = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
    return _POWERS[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


class RollingHash:
    """Hashes of any slice of a token array in constant time each."""

    def __init__(self, tokens: np.ndarray):
        n = len(tokens)
        up, self.down = powers(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(tokens.astype(U64) * up[:n], dtype=U64, out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def fixed(self, k: int) -> np.ndarray:
        """Of every k tokens, in order of their start."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, U64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) + (end - start).astype(U64) * U64(0xC2B2AE3D27D4EB4F))


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hashes of words by their bytes: mixed 8-byte pieces, each with its place, then the length.

    A polynomial of the bytes modulo 2**64 has words that collide for every base (Thue-Morse order and its
    complement); pieces that are mixed before they are added have no such structure.
    """
    size = stops - starts
    pieces = (size + 7) >> 3
    first = np.cumsum(pieces) - pieces
    word = np.repeat(np.arange(len(size)), pieces)
    place = np.arange(len(word)) - first[word]
    at = starts[word] + 8 * place
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))[at]
    left = np.minimum(stops[word] - at, 8).astype(U64)
    eight &= U64(0xFFFFFFFFFFFFFFFF) >> (U64(64) - U64(8) * left)
    mixed = mix(eight ^ mix((place.astype(U64) + U64(1)) * U64(0xA0761D6478BD642F)))
    sums = np.add.reduceat(mixed, first) if len(first) else np.zeros(0, U64)
    return mix(sums + size.astype(U64) * U64(0xC2B2AE3D27D4EB4F))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of every w neighbours; doubling, so log2(w) passes."""
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    if span < w:
        out = np.minimum(out[: len(x) - w + 1], out[w - span : w - span + len(x) - w + 1])
    return out


def runs(tokens: np.ndarray, ends: np.ndarray, window: int, k: int):
    """Runs of windows with one anchor, over documents laid end to end.

    ``tokens``: all documents' tokens; ``ends``: where each document ends.
    Returns (document index, lo within the document, n, off, h, c) as arrays.
    """
    none = np.zeros(0, np.int64)
    if len(tokens) < window:
        return none, none, none, none, none.astype(U64), none.astype(U64)
    hashes = RollingHash(tokens)
    grams = hashes.fixed(k)
    at = np.arange(len(grams), dtype=U64)
    bits = max(1, int(len(grams)).bit_length())
    keys = (grams >> U64(bits) << U64(bits)) | at
    anchor = (sliding_min(keys, window - k + 1) & U64((1 << bits) - 1)).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    valid = np.zeros(len(anchor) + 1, np.int32)
    long = (ends - starts) >= window
    np.add.at(valid, starts[long], 1)
    np.add.at(valid, ends[long] - window + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    new = np.ones(len(anchor), bool)
    new[1:] = anchor[1:] != anchor[:-1]
    new[starts[long]] = True
    last = np.append(new[1:], True)
    last[(ends[long] - window)] = True
    first = np.flatnonzero(valid & (new | ~np.concatenate(([False], valid[:-1]))))
    final = np.flatnonzero(valid & (last | ~np.append(valid[1:], False)))
    a = anchor[first]
    doc = np.searchsorted(ends, first, side="right")
    n, off = final - first + 1, a - first
    c = mix(hashes.of(first, final + window) ^ (n.astype(U64) << U64(32)) ^ off.astype(U64))
    return doc, first - starts[doc], n, off, grams[a], c
