"""Hashes of whole Arrow string columns' words and word n-grams, in numpy.

A word is a run of bytes above 0x20 of the UTF-8 text.  Its hash is a polynomial
over random 64-bit byte values modulo 2**64, read off two prefix sums and mixed,
so cost is a few passes over the bytes whatever the number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=U) | U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
#: Bytes of text hashed at once; a longer text is hashed on its own.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INV)):
            steps = np.full(n, U(base), U)
            steps[0] = U(1)
            _POWERS[i] = np.multiply.accumulate(steps)
    return _POWERS[0], _POWERS[1]


class Words:
    """The words of some texts: ``hashes``, byte ``starts`` and ``ends``, and ``at``, where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(data)
        solid = np.zeros(n + 1, bool)
        solid[:n] = data > 32
        begins = solid[:n].copy()
        begins[1:] &= ~solid[: n - 1]
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        begins[firsts] = solid[firsts]
        finishes = solid[:n] & ~solid[1:]
        finishes[firsts[1:] - 1] = solid[firsts[1:] - 1] if len(firsts) > 1 else False
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(finishes) + 1
        up, down = _powers(n + 1)
        sums = np.zeros(n + 1, U)
        np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(U))
        self.at = np.searchsorted(self.starts, offsets)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all ``k``-word grams, their texts, and the index of their first words.

        A text with one to ``k - 1`` words has one gram, of all its words.
        """
        w = self.hashes
        n = np.diff(self.at)
        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        text = np.repeat(np.arange(len(n)), count)
        total = int(count.sum())
        first = self.at[:-1][text] + (np.arange(total) - np.repeat(np.cumsum(count) - count, count))
        out = np.zeros(total, U)
        last = self.at[1:][text]
        for j in range(k):
            here = first + j
            term = w[np.minimum(here, max(len(w) - 1, 0))] * U((2 * j + 3) * 0x9E3779B97F4A7C15 % 2**64 | 1) if len(w) else out
            out = mix(out + np.where(here < last, term, U(0)))
        return out, text, first


def pieces(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about ``most`` bytes; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if pa.types.is_large_string(texts.type):
        kind, width = np.int64, 8
    else:
        kind, width = np.int32, 4
    n = len(texts)
    if not n:
        return
    if texts.null_count:
        texts = texts.fill_null("")
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, kind, n + 1, texts.offset * width).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, raw[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
