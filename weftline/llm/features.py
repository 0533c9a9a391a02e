"""Hashed indicator features of word uni- and bigrams, and a hinge-loss fit, shared by the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from weftline.llm.grams import U, Words, raw, roll

_MARKS = np.zeros(256, bool)
_MARKS[[*b"!#$%&*^|~"]] = True


EDGES = np.array([0.0, 0.02, 0.1, 0.3])
STYLES = 3 * (len(EDGES) + 1)


def indicators(arr: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct features of each row and the row pointer.

    Words, with their case, and runs of marks such as ``!!`` or ``|`` each give unigrams, words also bigrams, all
    hashed below ``2**bits``.  From there on each row has three style features: in which of five bins
    the share of words in capitals, of words that repeat the one before, and of mark runs per word lie.
    """
    words = Words(arr, lower=False, table=_CASED)
    marks = Words(arr, lower=False, table=_MARKS)
    parts = [(words.h, words.ptr), roll(words.h, words.ptr, 2), (marks.h ^ U(0xA5A5A5A5), marks.ptr)]
    n = len(arr)
    row = np.concatenate([np.repeat(np.arange(n), np.diff(p)) for _, p in parts])
    at = np.concatenate([(h >> U(64 - bits)).astype(np.int64) for h, _ in parts])
    key = np.sort((row << (bits + 1)) | at)
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    count = np.maximum(np.diff(words.ptr), 1)
    data, _ = raw(arr)
    capital = np.zeros(256, bool)
    capital[65:91] = True
    shout = (words.ends - words.starts > 1) & capital[data[words.starts]] & capital[data[words.ends - 1]] if len(words.h) else np.zeros(0, bool)
    again = np.append(False, words.h[1:] == words.h[:-1]) if len(words.h) else np.zeros(0, bool)
    again[words.ptr[:-1][np.diff(words.ptr) > 0]] = False
    shares = [per_row(shout, words.ptr) / count, per_row(again, words.ptr) / count, np.diff(marks.ptr) / count]
    for k, share in enumerate(shares):
        slot = (1 << bits) + k * (len(EDGES) + 1) + np.searchsorted(EDGES, share)
        key = np.concatenate([key, (np.arange(n) << (bits + 1)) | slot])
    key = np.sort(key, kind="stable")
    return (key & ((1 << (bits + 1)) - 1)).astype(np.int32), np.searchsorted(key, np.arange(n + 1) << (bits + 1))


def per_row(flag: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Number of flags in each row."""
    total = np.append(0, np.cumsum(flag, dtype=np.int64))
    return total[ptr[1:]] - total[ptr[:-1]]


_CASED = np.zeros(256, dtype=bool)
_CASED[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def scores(index: np.ndarray, ptr: np.ndarray, weight: np.ndarray, bias: float, whole: int) -> np.ndarray:
    """Weights of each row's features, over the root of their number below ``whole`` and in full from there on,
    plus the bias."""
    full = index >= whole
    hashed = np.append(0.0, np.cumsum(np.where(full, 0.0, weight[index])))
    rest = np.append(0.0, np.cumsum(np.where(full, weight[index], 0.0)))
    n = np.maximum(per_row(~full, ptr), 1)
    return (hashed[ptr[1:]] - hashed[ptr[:-1]]) / np.sqrt(n) + rest[ptr[1:]] - rest[ptr[:-1]] + bias


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, scale: np.ndarray, cost: np.ndarray, dim: int, epochs: int = 20, seed: int = 7, tolerance: float = 1e-3, whole: int | None = None) -> tuple[np.ndarray, float]:
    """Linear hinge-loss (L2-regularised L1-SVM) fit of scaled indicators; ``cost`` bounds each row's dual.

    Row i is ``scale[rows[i]] / sqrt(len(rows[i]))`` plus a constant 1; indicators from ``whole`` on count
    in full, whatever their number.  Returns weights to apply to plain
    indicators (the scale is folded in) and the bias.
    """
    w, bias = np.zeros(dim), 0.0
    alpha = np.zeros(len(rows))
    whole = dim if whole is None else whole
    values = [scale[r] / np.where(r < whole, np.sqrt(max(1, (r < whole).sum())), 1.0) for r in rows]
    norm = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            r, v = rows[i], values[i]
            gradient = y[i] * (float(w[r] @ v) + bias) - 1.0
            old = alpha[i]
            new = min(max(old - gradient / norm[i], 0.0), cost[i])
            if new != old:
                worst = max(worst, abs(new - old))
                step = (new - old) * y[i]
                w[r] += step * v
                bias += step
                alpha[i] = new
        if worst < tolerance:
            break
    return w * scale, bias
