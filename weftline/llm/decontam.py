"""Benchmark decontamination: n-gram seeds, a bound on the score, then Smith-Waterman alignment.

Every n-gram of every test item is a seed, however many documents hold it: whether a document is found
depends on its own text and the item's, never on how often either leaked.  A scan joins documents to
items by seeds and takes the words around each seed diagonal, as far as any alignment of ``min_score`` through it can
reach.  No alignment there can match more words than document and item have in common, so a window with too few of
them (a stock phrase met elsewhere) is left out without loss; the others are aligned with the item (match +2, mismatch
-1, gap -1), row by row in memory that grows with the window alone.
A document is contaminated by an item if the best score reaches ``min_score`` of the score of a verbatim copy of the item:
a copy of less than half of an item is none.

What seeds miss: an alignment without any three matching words in a row.  It has at most two matches for each
mismatch or gap, so its score is below 0.5 + 1 / (m + 2) for an item of m words.

The items are held by each task in slices of ``slice_grams`` seeds; a larger benchmark takes
more scans, never more memory.

Defined cases: null or empty texts and items never match; an item shorter than ``n`` words is one
seed of all its words, which only a document of just these words has; repeated rows each give their own row; a null
doc_id or item_id is carried through; of equal alignments the first in the text is reported.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.grams import Words, as_string, blocks

N = 3
MIN_SCORE = 0.5
SLICE_GRAMS = 2_000_000
PAIRS = 1_000_000
SCHEMA = "doc_id bigint, item_id bigint, score double, start_word int, end_word int, matched_words int"


def _slices(bench: DataFrame, n: int, limit: int) -> Iterator[tuple[list, list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, words of each item, sorted seeds, item of each seed, seed's word position) slice by slice."""
    ids, words, seeds, owner, place, held = [], [], [], [], [], 0

    def pack():
        g, o, p = np.concatenate(seeds), np.concatenate(owner), np.concatenate(place)
        order = np.lexsort((p, o, g))
        return ids, words, g[order], o[order], p[order]

    for row in bench.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).toLocalIterator():
        w = Words(as_string(pa.array([row[1]], pa.string())))
        if len(w.h) == 0:
            continue
        g, _ = w.grams(n)
        ids.append(row[0])
        words.append(w.h)
        seeds.append(g)
        owner.append(np.full(len(g), len(ids) - 1, np.int32))
        place.append(np.arange(len(g), dtype=np.int32))
        held += len(g)
        if held >= limit:
            yield pack()
            ids, words, seeds, owner, place, held = [], [], [], [], [], 0
    if ids:
        yield pack()


def align(doc: np.ndarray, item: np.ndarray) -> tuple[float, int, int, int]:
    """Best local alignment of two word-hash sequences: score / (2 * len(item)), first and past-last
    word of the document, matched words."""
    m, n = len(item), len(doc)
    ramp = np.arange(n + 1)
    score, begin, matched = np.zeros(n + 1, np.int64), ramp.copy(), np.zeros(n + 1, np.int64)
    best = (0, 0, 0, 0)
    for word in item:
        same = doc == word
        top = np.maximum(score - 1, 0)  # a gap along the item, or nothing
        old = score >= 1
        start, hits = np.where(old & (top > 0), begin, ramp), np.where(old & (top > 0), matched, 0)
        diagonal = score[:-1] + np.where(same, 2, -1)
        take = np.append(False, (diagonal >= top[1:]) & (diagonal > 0))
        top[1:] = np.where(take[1:], diagonal, top[1:])
        start[1:] = np.where(take[1:], begin[:-1], start[1:])
        hits[1:] = np.where(take[1:], matched[:-1] + same, hits[1:])
        reach = np.maximum.accumulate(top + ramp)  # gaps along the document
        source = np.maximum.accumulate(np.where(top + ramp == reach, ramp, 0))
        score = reach - ramp
        begin, matched = start[source], hits[source]
        j = int(score.argmax())
        if score[j] > best[0]:
            best = int(score[j]), int(begin[j]), j, int(matched[j])
    return best[0] / (2 * m), *best[1:]


def windows(pos: np.ndarray, place: np.ndarray, m: int, n: int) -> list[tuple[int, int]]:
    """Word ranges of the document that an alignment through these seeds can cover, merged."""
    lo = np.maximum(pos - place - m, 0)
    hi = np.minimum(pos - place + 2 * m, n)
    order = np.argsort(lo, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(lo[order].tolist(), hi[order].tolist()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def within_reach(doc: np.ndarray, item: np.ndarray, min_score: float) -> bool:
    """Whether the words that both have are enough for ``min_score``, were all of them matched."""
    if np.isin(doc, item).sum() / len(item) < min_score:
        return False
    return bool(np.isin(item, doc).sum() / len(item) >= min_score)


def _parts(reps: np.ndarray, row: np.ndarray, limit: int) -> Iterator[slice]:
    """Runs of hits, whole rows each, that stand for about ``limit`` pairs of a place in the text and one in an item."""
    ends = np.append(np.flatnonzero(np.diff(row)) + 1, len(row))
    total = np.cumsum(reps)
    lo = done = 0
    for hi in ends.tolist():
        if total[hi - 1] - done >= limit or hi == len(row):
            yield slice(lo, hi)
            lo, done = hi, total[hi - 1]


def _hits(g: np.ndarray, seeds: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``g`` that are seeds, and the index of the seed among the distinct sorted ones."""
    at = np.flatnonzero(sieve[(g >> np.uint64(42)).astype(np.int64)])
    k = np.searchsorted(seeds, g[at])
    k[k == len(seeds)] = 0
    ok = seeds[k] == g[at]
    return at[ok], k[ok]


def _sieve(seeds: np.ndarray) -> np.ndarray:
    s = np.zeros(1 << 22, bool)
    s[(seeds >> np.uint64(42)).astype(np.int64)] = True
    return s


def _matcher(ids, words, seeds, owner, place, n: int, min_score: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct, first = np.unique(seeds, return_index=True)
        last = np.append(first[1:], len(seeds))
        sieve = _sieve(distinct)
        for batch in batches:
            rows = []
            for base, arr in blocks(batch.column(1)):
                w = Words(arr)
                g, ptr = w.grams(n)
                at, k = _hits(g, distinct, sieve)
                if len(at) == 0:
                    continue
                held = np.searchsorted(ptr, at, "right") - 1
                for part in _parts(last[k] - first[k], held, PAIRS):
                    lo_seed, reps = first[k[part]], last[k[part]] - first[k[part]]
                    src = np.repeat(lo_seed, reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
                    row = np.repeat(held[part], reps)
                    pos = np.repeat(at[part], reps) - ptr[row]
                    order = np.lexsort((owner[src], row))
                    row, pos, item, where = row[order], pos[order], owner[src][order], place[src][order]
                    cut = np.flatnonzero(np.diff(row) | np.diff(item)) + 1
                    for a, b in zip(np.append(0, cut), np.append(cut, len(row))):
                        r, i = int(row[a]), int(item[a])
                        doc = w.h[w.ptr[r] : w.ptr[r + 1]]
                        best = None
                        for lo, hi in windows(pos[a:b], where[a:b], len(words[i]), len(doc)):
                            if not within_reach(doc[lo:hi], words[i], min_score):
                                continue
                            s, x, y, matched = align(doc[lo:hi], words[i])
                            if s >= min_score and (best is None or s > best[0]):
                                best = (s, lo + x, lo + y, matched)
                        if best:
                            rows.append((base + r, ids[i], *best))
            if rows:
                r, item, s, x, y, matched = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(r, pa.int64())), pa.array(item, pa.int64()), pa.array(s, pa.float64()), pa.array(x, pa.int32()), pa.array(y, pa.int32()), pa.array(matched, pa.int32())],
                    names=["doc_id", "item_id", "score", "start_word", "end_word", "matched_words"],
                )

    return run


def contaminated(docs: DataFrame, bench: DataFrame, n: int = N, min_score: float = MIN_SCORE, slice_grams: int = SLICE_GRAMS) -> DataFrame:
    """One row per (document row, item) that aligns: doc_id, item_id, score, word span, matched words."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for ids, words, seeds, owner, place in _slices(bench, n, slice_grams):
        found = texts.mapInArrow(_matcher(ids, words, seeds, owner, place, n, min_score), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def decontaminate(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with their columns, that no item contaminates.  Rows with a null doc_id
    are kept: they cannot be named by a finding."""
    bad = contaminated(docs, bench, **options).select(F.col("doc_id").alias("__bad")).where("__bad IS NOT NULL").distinct()
    return docs.join(bad, docs["doc_id"] == bad["__bad"], "left_anti")
