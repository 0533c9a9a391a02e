"""Vectorised word and n-gram hashing over Arrow string columns.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the lower-cased
text; everything else separates.  Texts are hashed block by block with numpy over the Arrow
buffers, so no Python object is made per word.  SQL over the same rule:
``regexp_split(lower(text), '[^a-z0-9\\x80-...]+')``.

Nulls hash like empty texts: they have no words and no n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_pows: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    have = _pows.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK_BYTES + 1)
        p = np.full(size, base, dtype=U)
        p[0] = 1
        _pows[base] = have = np.cumprod(p, dtype=U)
    return have[:n]


def as_string(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a large_string array and the row offsets into them."""
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    if len(off) == 0 or arr.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Row slices of at most ``limit`` bytes of text (a longer text goes alone), with their first row."""
    arr = as_string(column)
    if len(arr) == 0:
        return
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, len(arr))
        yield lo, arr.slice(lo, hi - lo)
        lo = hi
    pa.default_memory_pool().release_unused()


class Words:
    """Words of a block: ``h`` 64-bit hashes, ``ptr[i]:ptr[i+1]`` the words of row i."""

    __slots__ = ("h", "ptr", "starts", "ends", "stems")

    def __init__(self, arr: pa.Array, lower: bool = True, table: np.ndarray = _WORD, stems: tuple[int, ...] = ()):
        """``stems``: lengths in bytes of word beginnings to hash too; a word no longer than that has 0."""
        self.stems: dict[int, np.ndarray] = {}
        data, off = raw(pc.utf8_lower(arr) if lower else arr)
        n = len(data)
        if n == 0:
            self.h = np.zeros(0, U)
            self.starts = self.ends = np.zeros(0, np.int64)
            self.ptr = np.zeros(len(off), np.int64)
            self.stems = {k: self.h for k in stems}
            return
        flag = np.zeros(n + 1, np.int8)
        flag[:n] = table[data]
        edge = np.empty(n + 1, bool)
        edge[0] = True
        np.not_equal(flag[1:], flag[:-1], out=edge[1:])
        edge[off] = True  # no word crosses a row
        at = np.flatnonzero(edge)
        runs = flag[at[:-1]] == 1
        self.starts, self.ends = at[:-1][runs], at[1:][runs]
        total = np.empty(n + 1, U)
        total[0] = 0
        np.cumsum((data.astype(U) + U(1)) * _powers(_BASE, n), out=total[1:])
        size = (self.ends - self.starts).astype(U)
        self.h = mix((total[self.ends] - total[self.starts]) * _powers(_INV, n)[self.starts] + size * U(0xD6E8FEB86659FD93))
        self.ptr = np.searchsorted(self.starts, off)
        for k in stems:
            longer = np.flatnonzero(size > k)
            at = self.starts[longer]
            self.stems[k] = np.zeros(len(size), U)
            self.stems[k][longer] = mix((total[at + k] - total[at]) * _powers(_INV, n)[at] + U(k * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF)) | U(1)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of ``n`` words inside a row and the row pointer; a row of 1 to n-1
        words has one gram of them all, a row without words none."""
        return roll(self.h, self.ptr, n)


def roll(h: np.ndarray, ptr: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.diff(ptr)
    k = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    out_ptr = np.concatenate([[0], np.cumsum(k)])
    if out_ptr[-1] == 0:
        return np.zeros(0, U), out_ptr
    pad = np.concatenate([h, np.zeros(n, U)])
    full = np.zeros(len(h), U)
    for i in range(n):
        full += mix(pad[i : i + len(h)] + U(i + 1)) * U((2 * i + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
    row = np.repeat(np.arange(len(k)), k)
    src = ptr[:-1][row] + np.arange(out_ptr[-1]) - out_ptr[:-1][row]
    g = mix(full[src])
    for r in np.flatnonzero((count > 0) & (count < n)):
        w = h[ptr[r] : ptr[r + 1]]
        g[out_ptr[r]] = mix(np.array([sum(int(x) * (2 * i + 3) for i, x in enumerate(w)) + len(w) & 0xFFFFFFFFFFFFFFFF], dtype=U))[0]
    return g, out_ptr


def hash_text(text: str, n: int) -> np.ndarray:
    """n-gram hashes of one text, as ``Words.grams`` makes them."""
    return Words(as_string(pa.array([text], pa.string()))).grams(n)[0]
