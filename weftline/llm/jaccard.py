"""Exact n-gram Jaccard self-join in the metric space of Jaccard distance d = 1 - J, radius r = 1 - ``threshold``.

Regions.  ``pivots`` documents, sampled by hash, create Voronoi regions of bounded width: a document within
``threshold / 2`` of a pivot lies in the region of the nearest one (ties: the first), all others in the far region.  By the
triangle inequality a partner of a document at distance d of its pivot lies within d + r of that pivot, so documents
up to ``threshold / 2`` + r away are replicated to the region as its window, and every linked pair meets in a region
of which one of the two is a member: the far region if both are far, otherwise the first of their two regions.
Sampled pivots hit what is frequent, so the regions take up the large groups of near copies; unrelated texts lie at distance 1
from all pivots, where no window prunes, and make up the far region (figures in the README).

Recursion.  Inside a region n-grams part the documents further.  n-grams with the same members are one cell of that
weight.  A document's cells are ordered, rarest first; two documents at similarity t share weight t|x| at least, so
their first common cell has that much weight left from there on in both, and each document is posted to such
cells only.  A document whose shared n-grams together weigh less than t|x| has no partner and goes at once.  Cells of up to
``hot`` documents are joined directly, larger ones in blocks.  In each, a pair counts only where the cell is its first common
one, so it is counted once.  All tests are exact: weights are summed over all n-grams of the whole text.

Links are counted where they are found; only counts and the edges of spanning trees leave a task, never all pairs of
a group.  Documents with equal n-gram sets (distance 0) are joined as one.

Sieve.  Before that, all documents count how many of their n-grams others may hold, from ``SPARE`` bits more of each n-gram's
hash than there are bits in the number of postings.  No linked document is lost, as equal n-grams always look alike; others that do,
and copies in several tasks, only let a document pass that the exact test drops later.  Of each class that passes, the document of the
least doc_id is posted with whole hashes and its class.  It is found again by a bitmap of at most ``WIDEST`` bits of doc_ids'
hashes, which likewise only errs by letting more pass.

Postings travel as arrays, a row for each slice of the n-grams' hash range and some millions of postings of a task; the number of
slices grows with the table, so that a slice holds about ``SLICE`` postings.  n-grams that many of a bounded
sample hold go to slices by document instead; their members are added up from these in a pass of their own first.

Defined cases: rows with a null doc_id take no part; texts without words are classes of their own without links; texts
shorter than ``n`` words have one n-gram of all their words; rows that repeat a doc_id are one document when
their text has the same n-grams, otherwise two; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.grams import Words, blocks, mix
from weftline.llm.store import drop, written

N = 3
THRESHOLD = 0.6
HOT = 64
BLOCK = 2048
PIVOTS = 64
PIVOT_GRAMS = 20_000
SAMPLE = 2048
COMMON = 0.01
BUCKET = 5_000
SLICE = 1_000_000
FLUSH = 1_000_000
SPARE = 6
WIDEST = 1 << 28
BATCH = 1 << 20
FIRST = 8
EPS = 1e-9
FOUND = "a bigint, b bigint, n bigint"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).where("id IS NOT NULL")


def _sets(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """(ids, sorted distinct n-gram hashes of each text) block by block."""
    for batch in batches:
        for base, arr in blocks(batch.column(1)):
            g, ptr = Words(arr).grams(n)
            sets = []
            for lo, hi in zip(ptr[:-1].tolist(), ptr[1:].tolist()):
                s = np.sort(g[lo:hi])
                sets.append(s[np.append(True, s[1:] != s[:-1])] if hi - lo > 1 else s)
            yield batch.column(0).slice(base, len(arr)), sets


def _key(s: np.ndarray) -> int:
    """The class of a set of n-grams."""
    return xxhash.xxh3_64_intdigest(s.tobytes(), 7) - (1 << 63)


def _signer(n: int):
    def run(batches):
        for ids, sets in _sets(n, batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array([_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32())], names=["id", "k", "size"])

    return run


def _setter(n: int):
    def run(batches):
        for _, sets in _sets(n, batches):
            yield pa.RecordBatch.from_arrays([pa.array([_key(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["k", "grams"])

    return run


class Pivots:
    """Overlaps of n-gram sets with up to 64 pivots."""

    def __init__(self, sets: list[np.ndarray], t: float):
        self.sizes, self.t = np.array([len(s) for s in sets], np.int64), t
        every = np.concatenate([np.zeros(0, np.uint64), *sets])
        bit = np.repeat(np.uint64(1) << np.arange(len(sets), dtype=np.uint64), self.sizes)
        order = np.argsort(every, kind="stable")
        self.grams, first = np.unique(every[order], return_index=True)
        self.masks = np.bitwise_or.reduceat(bit[order], first) if len(first) else bit

    def regions(self, s: np.ndarray) -> list[tuple[int, bool]]:
        """(region, whether a member) of the document; region -1 is the far one."""
        at = np.searchsorted(self.grams, s)
        at[at == len(self.grams)] = 0
        hit = at[self.grams[at] == s] if len(self.grams) else at[:0]
        if not len(hit):
            return [(-1, True)]
        both = np.unpackbits(self.masks[hit].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0)[: len(self.sizes)].astype(np.int64)
        near = both / (len(s) + self.sizes - both)
        own = int(near.argmax()) if near.max() >= 1 - self.t / 2 - EPS else -1
        # a pair of two regions counts in the first of them
        window = [(int(p), False) for p in np.flatnonzero(near >= self.t / 2 - EPS) if own < 0 or p < own]
        return [(own, True), *window]


def _planes(a: np.ndarray) -> bytes:
    """An array's bytes, the first ones of all numbers first, compressed."""
    data = np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes()
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _numbers(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


#: the copies (a document in a region) that a row's entries stand for: class, 2 * (region + 1) + member, n-grams
COPIES = "ks binary, tags binary, sizes binary"
POSTED = f"slice int, {COPIES}, at binary, g binary"
HELD = f"bucket int, {COPIES}, at binary, n binary, s binary, w binary"
WHOLE = "g binary, n binary, s binary"
PROFILE = "ck bigint, k bigint, size int, core boolean, n binary, s binary, w binary"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _batches(rows: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``BATCH`` bytes."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    lo = held = 0
    for i, row in enumerate(rows):
        held += sum(len(x) for x in row if isinstance(x, bytes))
        if held >= BATCH or i + 1 == len(rows):
            cols = zip(*rows[lo : i + 1])
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields)], names=[x for x, _ in fields])
            lo, held = i + 1, 0


def _table(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    return pa.Table.from_batches(_batches(rows, schema), pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")]))


def _copies(at: np.ndarray, ks: np.ndarray, tags: np.ndarray, sizes: np.ndarray) -> tuple[bytes, ...]:
    """The copies that ``at`` points to, and ``at`` as indexes of those."""
    used, inverse = np.unique(at, return_inverse=True)
    return _planes(ks[used]), _planes(tags[used]), _planes(sizes[used]), _planes(inverse.astype(np.uint32))


def _read(table: pa.Table, *entries: tuple[str, type]) -> list[np.ndarray]:
    """Class, tag and size of each entry of a table's rows, and the entries' own arrays."""
    out: list[list[np.ndarray]] = [[] for _ in range(3 + len(entries))]
    for row in table.to_pylist():
        at = _numbers(row["at"], np.uint32)
        for i, (c, kind) in enumerate((("ks", np.int64), ("tags", np.uint32), ("sizes", np.uint32))):
            out[i].append(_numbers(row[c], kind)[at])
        for i, (c, kind) in enumerate(entries):
            out[3 + i].append(_numbers(row[c], kind))
    return [np.concatenate(x) for x in out]


def _copy_hash(k: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """A hash of class and region."""
    return mix(k.view(np.uint64) ^ mix((tag >> 1).astype(np.uint64)))


#: rows -1: of a part of a task's texts, the text and the shortened hash of each posting in a slice; otherwise the part's
#: classes, sizes and numbers of common n-grams, and in how many rows it was sent
SENT = "slice int, part bigint, rows int, a binary, b binary, c binary"
#: rows -1: texts of a part and how many of their postings in a slice others may have; otherwise as above
SHARED = "part bigint, rows int, a binary, b binary, c binary"


def _sketcher(n: int, common: np.ndarray, slices: int, bits: int):
    """Postings by the first ``bits`` of their hash; common n-grams, known to be in several classes, are only counted."""
    bounds = np.array([(i << bits) // slices for i in range(slices)], np.uint64)

    def flush(task: int, classes: list[tuple[int, int]], cells: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ks, sizes = (np.array(c, kind) for c, kind in zip(zip(*classes), (np.int64, np.uint32)))
        g, at = np.concatenate(cells), np.repeat(np.arange(len(classes), dtype=np.uint32), sizes)
        hot = common[np.minimum(np.searchsorted(common, g), len(common) - 1)] == g if len(common) else np.zeros(len(g), bool)
        hots = np.bincount(at[hot], minlength=len(classes)).astype(np.uint32)
        f, at = g[~hot] >> np.uint64(64 - bits), at[~hot]
        order = np.argsort(f)
        f, at = f[order], at[order]
        part = xxhash.xxh3_64_intdigest(ks.tobytes(), task) - (1 << 63)
        edges = [*np.searchsorted(f, bounds).tolist(), len(f)]
        rows = [(i, part, -1, _planes(at[lo:hi]), _planes(np.diff(f[lo:hi], prepend=bounds[i]).astype(np.uint32)), b"") for i, (lo, hi) in enumerate(zip(edges, edges[1:])) if hi > lo]
        rows.append((part % slices, part, len(rows), _planes(ks), _planes(sizes), _planes(hots)))
        return _batches(rows, SENT)

    def run(batches):
        seen: set[int] = set()
        classes, cells, held, task = [], [], 0, TaskContext.get().partitionId()
        for _, sets in _sets(n, batches):
            for s in sets:
                if not len(s) or (k := _key(s)) in seen:
                    continue
                seen.add(k)
                classes.append((k, len(s)))
                cells.append(s)
                held += len(s)
            if held >= FLUSH:
                yield from flush(task, classes, cells)
                classes, cells, held = [], [], 0
        if held:
            yield from flush(task, classes, cells)

    return run


def _sharing(table: pa.Table) -> pa.Table:
    """How many postings of a slice each text of each part has that look like another's."""
    rows, parts = [], []
    for row in table.to_pylist():
        if row["rows"] >= 0:
            rows.append(tuple(row[c] for c in _names(SHARED)))
        else:
            parts.append((row["part"], _numbers(row["a"], np.uint32), np.cumsum(_numbers(row["b"], np.uint32), dtype=np.uint32)))
    f = np.concatenate([np.zeros(0, np.uint32), *(x for _, _, x in parts)])
    order = np.argsort(f, kind="stable")
    same = f[order][1:] == f[order][:-1]
    twice = np.zeros(len(f), bool)
    twice[order] = (np.append(False, same) | np.append(same, False))[: len(f)]
    lo = 0
    for part, at, _ in parts:
        texts, count = np.unique(at[twice[lo : lo + len(at)]], return_counts=True)
        rows.append((part, -1, _planes(np.diff(texts, prepend=np.uint32(0))), _planes(count.astype(np.uint32)), b""))
        lo += len(at)
    return _table(rows, SHARED)


def _sieved(t: float):
    """The classes of a part that may have a partner."""

    def run(table: pa.Table) -> pa.Table:
        sent = table.to_pylist()
        own = [row for row in sent if row["rows"] >= 0]
        if len(own) != 1 or own[0]["rows"] != len(sent) - 1:
            raise RuntimeError("a task that was run again met its texts in another order; documents must come in a fixed order")
        ks, sizes, hots = (_numbers(own[0][c], kind) for c, kind in (("a", np.int64), ("b", np.uint32), ("c", np.uint32)))
        count = hots.astype(np.int64)
        for row in sent:
            if row["rows"] < 0:
                count[np.cumsum(_numbers(row["a"], np.uint32))] += _numbers(row["b"], np.uint32)
        on = count >= np.ceil(t * sizes - EPS)
        return pa.table({"k": ks[on], "hot": hots[on].astype(np.int64)})

    return run


def _passing(bits: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows whose third column's bit is set."""
    for batch in batches:
        at = batch.column(2).to_numpy()
        yield batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))


def _poster(n: int, bits: np.ndarray, pivots: Pivots, common: np.ndarray, slices: int, hot_slices: int, only_common: bool = False):
    bounds = np.array([(i << 64) // slices for i in range(slices)], np.uint64)

    def flush(copies: list[tuple[int, int, int]], cells: list[np.ndarray], hots: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        ks, tags, sizes = (np.array(c, kind) for c, kind in zip(zip(*copies), (np.int64, np.uint32, np.uint32)))
        g, hot = np.concatenate(cells), np.concatenate(hots)
        at = np.repeat(np.arange(len(copies), dtype=np.int32), [len(c) for c in cells])
        rows = []

        def send(first: int, edges: list[int], g: np.ndarray, at: np.ndarray) -> None:
            rows.extend((first + i, *_copies(at[lo:hi], ks, tags, sizes), _planes(g[lo:hi])) for i, (lo, hi) in enumerate(zip(edges, edges[1:])) if hi > lo)

        if hot.any():
            many, whose = g[hot], at[hot]
            place = mix(ks.view(np.uint64))[whose] % np.uint64(hot_slices)
            order = np.lexsort((many, place))
            send(slices, np.searchsorted(place[order], np.arange(hot_slices + 1, dtype=np.uint64)).tolist(), many[order], whose[order])
            g, at = g[~hot], at[~hot]
        order = np.argsort(g)
        g, at = g[order], at[order]
        send(0, [*np.searchsorted(g, bounds).tolist(), len(g)], g, at)
        return _batches(rows, POSTED)

    def run(batches):
        seen: set[int] = set()  # a class is posted once by a task, however many copies it meets
        copies, cells, hots, held = [], [], [], 0
        for _, sets in _sets(n, _passing(bits, batches)):
            for s in sets:
                if not len(s) or (k := _key(s)) in seen:
                    continue
                seen.add(k)
                hot = np.isin(s, common, assume_unique=True) if len(common) else np.zeros(len(s), bool)
                regions = pivots.regions(s)
                if only_common:
                    s, hot = s[hot], hot[hot]
                for region, member in regions:
                    copies.append((k, 2 * (region + 1) + member, len(s)))
                    cells.append(s if region < 0 else mix(s ^ mix(np.full(1, region + 1, np.uint64))))
                    hots.append(hot)
                    held += len(s)
            if held >= FLUSH:
                yield from flush(copies, cells, hots)
                copies, cells, hots, held = [], [], [], 0
        if held:
            yield from flush(copies, cells, hots)

    return run


Whole = tuple[np.ndarray, np.ndarray, np.ndarray]


def _members(key: tuple, table: pa.Table) -> pa.Table:
    """Of each n-gram in a slice by documents, the members there: their number and their hashes' XOR."""
    k, tag, _, g = _read(table, ("g", np.uint64))
    h = _copy_hash(k, tag)
    order = np.lexsort((h, g))
    order = order[np.append(True, (g[order][1:] != g[order][:-1]) | (h[order][1:] != h[order][:-1]))[: len(order)]]
    g, h = g[order], h[order]
    first = np.flatnonzero(np.append(True, g[1:] != g[:-1])[: len(g)])
    if not len(first):
        return _table([], WHOLE)
    return _table([(_planes(g[first]), _planes(np.diff(np.append(first, len(g))).astype(np.uint64)), _planes(np.bitwise_xor.reduceat(h, first)))], WHOLE)


def _grouped(slices: int, buckets: int, whole: Whole):
    """A slice's postings, those of n-grams with two members or more, as entries (copy, members, cell, weight); ``whole``:
    n-grams in many documents, their members and cells."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        hot = key[0].as_py() >= slices
        k, tag, size, g = _read(table, ("g", np.uint64))
        if not hot:
            order = np.argsort(g)
            same = g[order][1:] == g[order][:-1]
            order = order[np.append(False, same) | np.append(same, False)]
            k, tag, size, g = k[order], tag[order], size[order], g[order]
        h = _copy_hash(k, tag)
        order = np.lexsort((h, g))
        order = order[np.append(True, (g[order][1:] != g[order][:-1]) | (h[order][1:] != h[order][:-1]))[: len(order)]]
        k, tag, size, g, h = k[order], tag[order], size[order], g[order], h[order]
        first = np.flatnonzero(np.append(True, g[1:] != g[:-1])[: len(g)])
        rows = []
        if len(g):
            count = np.diff(np.append(first, len(g)))
            cell = np.bitwise_xor.reduceat(h, first)
            if hot:
                at = np.searchsorted(whole[0], g)
                keep, n, s = whole[1][at] > 1, whole[1][at], whole[2][at]
                n, s = n[keep], s[keep]
            else:
                keep = np.repeat(count > 1, count)
                n, s = (np.repeat(x[count > 1], count[count > 1]) for x in (count.astype(np.uint64), cell))
            k, tag, size, h = k[keep], tag[keep], size[keep], h[keep]
            order = np.lexsort((n, s, h))
            k, tag, size, h, n, s = (x[order] for x in (k, tag, size, h, n, s))
            new = np.append(True, (h[1:] != h[:-1]) | (s[1:] != s[:-1]) | (n[1:] != n[:-1]))[: len(h)]
            first = np.flatnonzero(new)
            w = np.diff(np.append(first, len(h))).astype(np.uint32)
            k, tag, size, h, n, s = (x[first] for x in (k, tag, size, h, n, s))
            copy = np.cumsum(np.append(False, h[1:] != h[:-1])[: len(h)])
            lead = np.flatnonzero(np.append(True, copy[1:] != copy[:-1])[: len(h)])
            ks, tags, sizes = k[lead], tag[lead], size[lead]
            bucket = (h % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.append(np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)[: len(h)]), len(h)).tolist()
            for lo, hi in zip(edges, edges[1:]):
                part = order[lo:hi]
                rows.append((int(bucket[part[0]]), *_copies(copy[part], ks, tags, sizes), _planes(n[part]), _planes(s[part]), _planes(w[part])))
        return _table(rows, HELD)

    return run


def _profiler(t: float):
    """The cells of each copy of a bucket that may have a partner."""

    def run(table: pa.Table) -> pa.Table:
        k, tag, size, n, s, w = _read(table, ("n", np.uint64), ("s", np.uint64), ("w", np.uint32))
        h = _copy_hash(k, tag)
        order = np.lexsort((s, n, h))
        k, tag, size, n, s, w, h = (x[order] for x in (k, tag, size, n, s, w, h))
        first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (s[1:] != s[:-1]) | (n[1:] != n[:-1]))[: len(h)])
        w = np.add.reduceat(w, first, dtype=np.uint32) if len(first) else w
        k, tag, size, n, s, h = (x[first] for x in (k, tag, size, n, s, h))
        lo = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
        hi = np.append(lo[1:], len(h))
        total = np.add.reduceat(w, lo, dtype=np.int64) if len(lo) else np.zeros(0, np.int64)
        rows = []
        s, n = s.view(np.int64), n.astype(np.uint32)
        for a, b in zip(*(x[total >= np.ceil(t * size[lo] - EPS)].tolist() for x in (lo, hi))):
            member = int(tag[a]) & 1
            rows.append((int(h[a : a + 1].view(np.int64)[0]) & ~1 | member, int(k[a]), int(size[a]), bool(member), n[a:b].tobytes(), s[a:b].tobytes(), w[a:b].tobytes()))
        return _table(rows, PROFILE)

    return run


def _sampled(texts: DataFrame, classes: DataFrame, n: int, t: float, pivots: int) -> tuple[Pivots, np.ndarray]:
    """The pivots, and the n-grams that at least two, and ``COMMON`` of ``SAMPLE`` classes, those of the least hash, hold."""
    ids = classes.where(f"size <= {PIVOT_GRAMS}").orderBy("k").limit(SAMPLE).select(F.col("rep").alias("id"))
    sets = written(texts.join(F.broadcast(ids), "id").mapInArrow(_setter(n), "k bigint, grams array<bigint>").dropDuplicates(["k"]), "sample")
    chosen = sets.orderBy("k").limit(min(pivots, 64)).toArrow()["grams"].to_pylist()
    every = sets.select(F.explode("grams").alias("g")).groupBy("g").count()
    common = every.where(F.col("count") > max(1, COMMON * SAMPLE)).toArrow()
    drop(sets)
    g = common["g"].to_numpy().view(np.uint64)
    return Pivots([np.array(s, np.int64).view(np.uint64) for s in chosen if s], t), np.sort(g)


def _sieve(texts: DataFrame, classes: DataFrame, n: int, t: float, common: np.ndarray) -> tuple[DataFrame, np.ndarray, int, int]:
    """The texts with their bits' numbers, the bitmap that one text of each class that may have a partner passes, and the
    numbers of n-grams and of common ones that these classes hold."""
    total = classes.agg(F.sum("size")).first()[0] or 0
    slices, bits = max(1, math.ceil(total / SLICE)), min(63, SPARE + total.bit_length())
    sent = texts.mapInArrow(_sketcher(n, common, slices, bits), SENT)
    shared = sent.groupBy("slice").applyInArrow(_sharing, SHARED)
    passed = shared.groupBy("part").applyInArrow(_sieved(t), "k bigint, hot bigint").groupBy("k").agg(F.max("hot").alias("hot"))
    passed = written(passed.hint("merge").join(classes, "k").select("rep", "size", "hot"), "passed")
    count, grams, hot = passed.agg(F.count(F.lit(1)), F.sum("size"), F.sum("hot")).first()
    width = max(1 << 15, min(WIDEST, 1 << (16 * count).bit_length()))
    at = passed.selectExpr(f"pmod(xxhash64(rep), {width}) AS at").selectExpr("at div 32768 AS page", "at % 32768 AS at")
    pages = at.groupBy("page").agg(F.bitmap_construct_agg("at").alias("bits")).toArrow()
    bitmap = np.zeros((width >> 15, 4096), np.uint8)
    for page, own in zip(pages["page"].to_pylist(), pages["bits"].to_pylist()):
        bitmap[page] = np.frombuffer(own, np.uint8)
    drop(passed)
    return texts.selectExpr("id", "text", f"pmod(xxhash64(id), {width}) AS at"), bitmap.ravel(), grams or 0, hot or 0


def _profiles(texts: DataFrame, classes: DataFrame, n: int, t: float, pivots: int) -> DataFrame:
    """``PROFILE`` and ``mult`` of the documents, in each of their regions, that may have a partner: members, cell and weight
    of all that they share with others, rarest first."""
    chosen, common = _sampled(texts, classes, n, t, pivots)
    texts, bits, total, hot = _sieve(texts, classes, n, t, common)
    slices, hot_slices = max(1, math.ceil(total / SLICE)), max(1, math.ceil(2 * hot / SLICE))
    whole = (np.zeros(0, np.uint64),) * 3
    if len(common):
        some = texts.mapInArrow(_poster(n, bits, chosen, common, slices, hot_slices, only_common=True), POSTED)
        # as many numbers as there are common n-grams and regions that hold them, for each slice by documents
        parts = some.groupBy("slice").applyInArrow(_members, WHOLE).toArrow().to_pylist()
        gram, count, cell = (np.concatenate([whole[0], *(_numbers(x[c], np.uint64) for x in parts)]) for c in ("g", "n", "s"))
        order = np.argsort(gram, kind="stable")
        first = np.flatnonzero(np.append(True, gram[order][1:] != gram[order][:-1])[: len(gram)])
        if len(first):
            whole = gram[order][first], np.add.reduceat(count[order], first), np.bitwise_xor.reduceat(cell[order], first)
    buckets = max(1, math.ceil(slices / 2))
    posted = texts.mapInArrow(_poster(n, bits, chosen, common, slices, hot_slices), POSTED)
    held = posted.groupBy("slice").applyInArrow(_grouped(slices, buckets, whole), HELD)
    mine = held.groupBy("bucket").applyInArrow(_profiler(t), PROFILE)
    return written(mine.hint("merge").join(classes.select("k", "mult"), "k").select(*_names(PROFILE), "mult"), "profiles")


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, numbers) of a column of arrays as bytes."""
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[off[0] : off[-1]] if len(column) and off[-1] > off[0] else np.zeros(0, np.uint8)
    return (off - off[0]) // np.dtype(kind).itemsize if len(off) else np.zeros(1, np.int64), np.ascontiguousarray(data).view(kind)


def _lists(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, members, cells, weights) of the profiles."""
    if isinstance(batch, pa.Table):
        batch = batch.combine_chunks().to_batches()[0] if batch.num_rows else pa.RecordBatch.from_pylist([], batch.schema)
    off, s = _flat(batch.column("s"), np.int64)
    return off, _flat(batch.column("n"), np.uint32)[1], s, _flat(batch.column("w"), np.uint32)[1]


def _left(off: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weight from each cell of a list on."""
    before = np.append(0, np.cumsum(w, dtype=np.int64))
    return np.repeat(before[off[1:]], np.diff(off)) - before[:-1]


def _prefixes(t: float):
    """Postings of the documents in cells from which on enough weight is left."""

    def run(batches):
        for batch in (part.slice(lo, 500) for part in batches for lo in range(0, part.num_rows, 500)):
            off, n, s, w = _lists(batch)
            left = _left(off, w)
            row = np.repeat(np.arange(len(off) - 1), np.diff(off))
            size = batch.column("size").to_numpy(zero_copy_only=False)
            at = np.flatnonzero(left >= np.ceil(t * size[row] - EPS))
            first = [s[np.minimum(off[:-1] + i, off[1:] - 1)][row[at]] if len(s) else s for i in range(FIRST)]
            cols = batch.select(["ck", "size", "core"]).take(pa.array(row[at]))
            first = pa.FixedSizeListArray.from_arrays(pa.array(np.stack(first, 1).ravel()), FIRST).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(s[at]), pa.array(n[at].astype(np.int64)), cols.column("ck"), cols.column("size"), pa.array(left[at]), cols.column("core"), first], names=["s", "n", "ck", "size", "rest", "core", "e"])

    return run


def _trees(ids: np.ndarray, a: np.ndarray, b: np.ndarray, mult: np.ndarray) -> pd.DataFrame:
    """For each class with links (a, b: indexes), the least class of its tree and how many documents it is linked to."""
    n = np.bincount(a, mult[b], len(ids)) + np.bincount(b, mult[a], len(ids))
    label = np.arange(len(ids))
    while True:
        low = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(low, a, least)
        np.minimum.at(low, b, least)
        low = np.minimum(low, low[low])
        if (low == label).all():
            break
        label = low
    root = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(root, label, ids)
    on = np.flatnonzero(n)
    return pd.DataFrame({"a": ids[on], "b": root[label[on]], "n": n[on].astype(np.int64)})


def _bucket(t: float):
    """Pairs met in small cells, checked on whole profiles."""

    def run(pairs: pa.Table, docs: pa.Table) -> pa.Table:
        off, _, s, w = _lists(docs)
        ck, size, mult, ids = (docs[c].to_numpy() for c in ("ck", "size", "mult", "k"))
        order = np.argsort(ck)
        at = [order[np.searchsorted(ck, pairs[c].to_numpy(), sorter=order)] for c in ("x", "y")]
        known, code = np.unique(s, return_inverse=True)
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        key = row * len(known) + code
        sort = np.argsort(key)
        key, weight = key[sort], w[sort]
        good = np.zeros(len(at[0]), bool)
        swap = np.diff(off)[at[0]] > np.diff(off)[at[1]]
        at = [np.where(swap, at[1], at[0]), np.where(swap, at[0], at[1])]  # the shorter list is looked up in the longer
        length = np.diff(off)[at[0]]
        ends, step = np.cumsum(length), 0
        while step < len(good):  # about a million list entries at a time
            to = max(step + 1, int(np.searchsorted(ends, (ends[step - 1] if step else 0) + (1 << 20))))
            x, y, k = at[0][step:to], at[1][step:to], length[step:to]
            pair = np.repeat(np.arange(len(x)), k)
            src = np.repeat(off[x], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            want = np.repeat(y, k) * len(known) + code[src]
            pos = np.searchsorted(key, want)
            pos[pos == len(key)] = 0
            hit = key[pos] == want
            both = np.bincount(pair[hit], weight[pos[hit]], len(x))
            good[step:to] = both >= t * (size[x].astype(np.int64) + size[y] - both) - EPS
            step = to
        found = _trees(ids, at[0][good], at[1][good], mult)
        return pa.Table.from_pandas(found, pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())]), preserve_index=False)

    return run


def _open_pairs(t: float, cell: int, block: np.ndarray, cross: bool, size, rest, core, first, lo: int, hi: int) -> np.ndarray:
    """Of rows lo:hi with all rows after them, which may be linked and have this cell as their first common one."""
    n = len(size)
    x, y = slice(lo, hi), slice(lo, n)
    ok = np.minimum(rest[x, None], rest[None, y]) >= t / (1 + t) * (size[x, None] + size[None, y]) - 1e-6
    ok &= core[x, None] | core[None, y]
    ok &= np.arange(lo, hi)[:, None] < np.arange(lo, n)[None]
    if cross:
        ok &= block[x, None] != block[None, y]
    late = np.cumsum(first[x] == cell, axis=1) > 0  # from the cell itself on
    for i in range(first.shape[1]):
        for j in range(first.shape[1]):
            ok &= (first[x, i, None] != first[None, y, j]) | late[:, i, None]
    return ok


def _wanted(t: float):
    """The documents of a block of a full cell that have an open pair there."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cols = [pdf[c].to_numpy() for c in ("i", "size", "rest", "core")]
        first = np.stack(pdf["e"].to_numpy())[:, :4]
        on = np.zeros(len(pdf), bool)
        for lo in range(0, len(pdf), 256):
            ok = _open_pairs(t, key[0], cols[0], key[1] != key[2], *cols[1:], first, lo, min(lo + 256, len(pdf)))
            on[lo : lo + 256] |= ok.any(1)
            on[lo:] |= ok.any(0)
        return pdf.loc[on, ["s", "bi", "bj", "i", "ck"]]

    return run


def _block(t: float):
    """A block of a full cell, checked by products of weight matrices."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lists = [np.frombuffer(x, np.int64) for x in pdf["s"]]
        off = np.append(0, np.cumsum([len(c) for c in lists]))
        s = np.concatenate(lists)
        w = np.concatenate([np.frombuffer(x, np.uint32) for x in pdf["w"]]).astype(np.float32)
        left = _left(off, w.astype(np.int64))
        row = np.repeat(np.arange(len(lists)), np.diff(off))
        here = np.flatnonzero(s == key[0])
        place = np.zeros(len(lists), np.int64)
        place[row[here]] = here
        block, size, core = pdf["i"].to_numpy(), pdf["size"].to_numpy(np.int64), pdf["core"].to_numpy(bool)
        first = np.stack([s[np.minimum(off[:-1] + i, off[1:] - 1)] for i in range(4)], 1)
        known, code, count = np.unique(s, return_inverse=True, return_counts=True)
        shared = np.cumsum(count > 1) - 1
        keep = count[code] > 1
        early = np.arange(len(s)) < place[row]
        r, c, v, e = row[keep], shared[code[keep]], w[keep], early[keep]
        n = len(lists)
        pairs = [[], []]
        for lo in range(0, n, 512):
            hi = min(lo + 512, n)
            ok = _open_pairs(t, key[0], block, key[1] != key[2], size, left[place], core, first, lo, hi)
            if not ok.any():
                continue
            both, before = np.zeros(ok.shape, np.float32), np.zeros(ok.shape, np.float32)
            for k in range(0, int(shared[-1]) + 1, 1024):
                m = (c >= k) & (c < k + 1024) & (r >= lo)
                one, all_w, soon = (np.zeros((n - lo, 1024), np.float32) for _ in range(3))
                one[r[m] - lo, c[m] - k] = 1
                all_w[r[m] - lo, c[m] - k] = v[m]
                soon[r[m] - lo, c[m] - k] = e[m]
                both += all_w[: hi - lo] @ one.T
                before += soon[: hi - lo] @ soon.T
            ok &= (before == 0) & (both >= t * (size[lo:hi, None] + size[None, lo:] - both) - EPS)
            x, y = np.nonzero(ok)
            pairs[0].append(x + lo)
            pairs[1].append(y + lo)
        a, b = (np.concatenate([np.zeros(0, np.int64), *p]) for p in pairs)
        return _trees(pdf["k"].to_numpy(np.int64), a, b, pdf["mult"].to_numpy(np.int64))

    return run


def _links(profiles: DataFrame, t: float, hot: int, block: int) -> DataFrame:
    """(a, b, n): class a is linked to n documents that were met in one place, b the least class of its tree there."""
    posts = written(profiles.mapInArrow(_prefixes(t), "s bigint, n bigint, ck bigint, size int, rest bigint, core boolean, e array<bigint>"), "postings")
    small = posts.where(F.col("n") <= hot).groupBy("s").agg(F.collect_list(F.struct("ck", "size", "rest", "core", "e")).alias("m")).where("size(m) > 1")
    share = t / (1 + t)
    pairs = small.selectExpr("s", f"""explode(flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)),
        y -> (x.core OR y.core) AND least(x.rest, y.rest) >= {share}D * (x.size + y.size) - 1e-6D AND (x.e[0] <> y.e[0] OR x.e[0] = s)
        AND coalesce(get(array_intersect(x.e, y.e), 0), s) = s), y -> struct(least(x.ck, y.ck) AS x, greatest(x.ck, y.ck) AS y))))) AS p""").select("s", "p.x", "p.y")  # fmt: skip
    # small cells come first in every order: a pair that meets in one has its first common cell among them
    pairs = written(pairs.groupBy("x", "y").agg(F.min("s").alias("s")), "pairs")
    buckets = max(1, math.ceil(pairs.count() / BUCKET))
    at = F.expr(f"CAST(pmod(xxhash64(s), {buckets}) AS int)").alias("bucket")
    pairs_at = pairs.select(at, "x", "y")
    need = pairs.select(at, F.col("x").alias("ck")).union(pairs.select(at, F.col("y").alias("ck"))).distinct()
    lists = need.hint("merge").join(profiles, "ck").select("bucket", "ck", "k", "size", "mult", "n", "s", "w")
    out = pairs_at.groupBy("bucket").cogroup(lists.groupBy("bucket")).applyInArrow(_bucket(t), FOUND)
    # a full cell of n documents is joined in blocks, each with itself and each other
    full = posts.where(F.col("n") > hot).selectExpr("*", f"CAST(ceil(n / {block}) AS int) AS nb").selectExpr("*", "CAST(pmod(hash(ck), nb) AS int) AS i")
    full = full.selectExpr("*", "explode(sequence(0, nb - 1)) AS j").selectExpr("s", "least(i, j) AS bi", "greatest(i, j) AS bj", "i", "ck", "size", "rest", "core", "e")
    wanted = written(full.groupBy("s", "bi", "bj").applyInPandas(_wanted(t), "s bigint, bi int, bj int, i int, ck bigint"), "wanted")
    met = wanted.withColumnRenamed("s", "cell").hint("merge").join(profiles, "ck").groupBy("cell", "bi", "bj").applyInPandas(_block(t), FOUND)
    found = written(out.unionByName(met), "links")
    drop(posts, pairs, wanted)
    return found


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, label): the least id of each connected component of edges (a, b), by rounds of least-label propagation with
    pointer jumping."""
    ends = edges.select("a", "b")
    both = written(ends.union(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), label)
    now = last = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")), label)
    while True:
        near = both.hint("merge").join(now.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        step = written(now.hint("merge").join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label")), label)
        jump = step.select(F.col("id").alias("label"), F.col("label").alias("root"))
        done = written(step.hint("merge").join(jump, "label", "left").select("id", "old", F.least("label", "root").alias("label")), label)
        drop(step, last)
        now, last = done.select("id", "label"), done
        if done.where("label < old").isEmpty():
            drop(both)
            return now


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, hot: int = HOT, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """A row per document: doc_id, class_id (the least doc_id of all that links lead to), n_links (how many other documents
    are at n-gram Jaccard similarity ``threshold`` or more)."""
    texts = _texts(docs)
    signed = written(texts.mapInArrow(_signer(n), "id bigint, k bigint, size int").distinct(), "signed")
    classes = written(signed.where("size > 0").groupBy("k").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("size").alias("size")), "classes")
    profiles = _profiles(texts, classes, n, threshold, pivots)
    found = _links(profiles, threshold, hot, block)
    label = components(found)
    links = found.groupBy(F.col("a").alias("k")).agg(F.sum("n").alias("n"))
    top = classes.hint("merge").join(links, "k").join(label.withColumnRenamed("id", "k").hint("merge"), "k")
    top = written(top.selectExpr("k", "label", "rep", "n + mult - 1 AS n"), "linked")
    least = top.groupBy("label").agg(F.min("rep").alias("class_id"))
    top = top.hint("merge").join(least, "label").select("k", "class_id", "n")
    every = classes.hint("merge").join(top.hint("merge"), "k", "left").selectExpr("k", "coalesce(class_id, rep) AS class_id", "coalesce(n, mult - 1) AS n_links")
    out = signed.where("size > 0").hint("merge").join(every, "k").select(F.col("id").alias("doc_id"), "class_id", "n_links")
    none = signed.where("size = 0").selectExpr("id AS doc_id", "id AS class_id", "0L AS n_links")
    drop(profiles, found)
    return out.unionByName(none)


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without those whose document is in a class with a smaller doc_id.  Rows
    with a null doc_id or no words stay; rows that repeat one doc_id share its fate."""
    gone = jaccard_join(docs, **options).where("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.hint("merge").join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


ORACLE = f"""WITH RECURSIVE words AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {N} THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - {N - 2}), lambda i: array_to_string(w[i:i + {N - 1}], ' ')) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE k / (sa.n + sb.n - k) >= {THRESHOLD}),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS b FROM reach GROUP BY a), linked AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT doc_id::BIGINT AS doc_id, least(doc_id, coalesce(m.b, doc_id))::BIGINT AS class_id, coalesce(l.n, 0)::BIGINT AS n_links
FROM words LEFT JOIN least_of m ON m.a = doc_id LEFT JOIN linked l ON l.a = doc_id"""
