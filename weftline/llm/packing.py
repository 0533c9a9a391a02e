"""Order-preserving packing of documents into fixed windows by dynamic programming.

The documents are ranked by (doc_id, hash of the text).  Those of a shard (``shard`` consecutive ranks, whatever their
ids are) are laid end to end as sentences with token counts.  Windows are cut at sentence ends.  With S the running token
count, the least cost of packing the first i sentences is

    f(i) = penalty(i) + min over j with S(i) - S(j) <= window of f(j) + window - (S(i) - S(j))

where the rest of a window is padding and penalty(i) is 0 at a document's end and ``truncation`` inside one.
f(j) + S(j) over the admissible j is kept in a monotone queue, so a shard takes linear time.  A sentence
longer than a window is first cut into the longest pieces that fit one, each cut inside it costing
``hard_truncation``: between pre-tokens, inside a longer pre-token between tokens, and between
characters where a window's length of tokens all begin inside one.  Each piece has its own text's token count.  Of equal costs the earliest cut, the longest window, is taken.

A sentence ends at a newline, at . ! ? before white space, and at the full stops of other scripts, with one closing
mark after them.

Only counts travel: the text stays where it is, and each window lists the character spans it holds.  Ranks come from a
range partitioning of the counts and the row counts of its ranges, so no task sees more than its range.

Defined cases: null or empty texts take no part and no rank; rows with a null doc_id come first, ordered by their text's
hash, in shards of their own number as any others; rows that repeat a doc_id stay next to each other, ordered by that
hash; an empty table gives no windows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import fsm, vocab
from weftline.llm.grams import blocks, raw
from weftline.llm.store import drop, written

WINDOW = 2048
TRUNCATION = 64
HARD_TRUNCATION = 512
SHARD = 1024
STOPS = np.array([ord(c) for c in "。！？｡．…؟۔।॥։።፧፨᙮။‼⁇⁈⁉"], np.uint32)
CLOSERS = np.array([ord(c) for c in "\"')]}»”’」』）】》〉〕］"], np.uint32)
SIZED = "doc_id bigint, tie bigint, tokens array<int>, ends array<int>, hard array<int>"
COUNTED = "doc_id bigint, tokens array<int>, ends array<int>, hard array<int>, place int, at bigint"
SCHEMA = "shard bigint, window int, n_tokens int, padding int, cut string, doc_ids array<bigint>, starts array<int>, ends array<int>"


def cuts(counts: list[int], penalty: list[float], window: int) -> tuple[float, list[int]]:
    """(least cost, ends of the windows) over pieces of 1..window tokens; ``penalty[i]`` is that of a cut
    after piece i."""
    n = len(counts)
    total, cost, back = [0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])  # f(j) + S(j), rising
    for i in range(1, n + 1):
        s = total[i] = total[i - 1] + counts[i - 1]
        while s - total[queue[0][1]] > window:
            queue.popleft()
        key, j = queue[0]
        cost[i] = c = key + window - s + penalty[i - 1]
        back[i] = j
        c += s
        while queue and queue[-1][0] > c:
            queue.pop()
        queue.append((c, i))
    ends = []
    i = n
    while i:
        ends.append(i)
        i = back[i]
    return cost[n], ends[::-1]


def _sentences(data: np.ndarray, off: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Byte positions where a new sentence begins: after . ! ?, a stop of another script or a newline, at a pre-token border."""
    stop = np.zeros(len(data), bool)
    stop[1:] = np.isin(data[:-1], np.frombuffer(b".!?", np.uint8)) & np.isin(data[1:], np.frombuffer(b" \n\t\r", np.uint8))
    if (data >= 0xC2).any():
        points, at = fsm._decode(data)
        full = np.isin(points, STOPS)
        full[1:] |= full[:-1] & np.isin(points[1:], CLOSERS)
        stop[at[np.flatnonzero(full[:-1]) + 1]] = True
    stop |= data == 10
    stop[1:] &= ~((data[1:] == 10) & (data[:-1] == 10))
    stop &= mark
    stop[off[:-1][np.diff(off) > 0]] = True
    return np.flatnonzero(stop)


def _between_characters(data: np.ndarray, whole: np.ndarray, window: int, machine: fsm.Transducer) -> list[tuple[int, int]]:
    """(first byte, tokens) of the pieces of a run in which no token begins with a character."""
    out, lo = [], 0
    while lo < len(data):
        ends = np.flatnonzero(np.append(whole, True))
        ends = ends[(ends > lo) & (ends <= max(lo + 8 * window, ends[ends > lo][0]))]
        part = pa.array([data[lo : ends[-1]].tobytes().decode()], pa.large_string())
        total = np.cumsum(fsm.deltas(part, machine)[0], dtype=np.int64)[ends - lo - 1]  # of each prefix
        k = np.flatnonzero(total <= window)[-1]
        out.append((lo, int(total[k])))
        lo = int(ends[k])
    return out


def _pieces(data: np.ndarray, out: np.ndarray, mark: np.ndarray, window: int, machine: fsm.Transducer) -> list[tuple[int, int]]:
    """(first byte, tokens) of the longest pieces of at most ``window`` tokens, from the front, of a long sentence."""
    points, at = fsm._decode(data)
    space = fsm._class_table()[points] == fsm._SPACE
    whole = np.zeros(len(data), bool)
    whole[at] = True
    whole[at[1:][space[:-1] & ~space[1:]]] = False  # the end of a text takes in white space that a word would split
    begin = np.flatnonzero(mark & whole)
    done: list[tuple[int, int]] = []
    lo = size = 0

    def close(to: int) -> None:
        nonlocal lo, size
        if size:
            done.append((lo, size))
        lo, size = to, 0

    def add(a: int, n: int) -> None:
        nonlocal size
        if size + n > window:
            close(a)
        size += n

    for a, b, n in zip(begin.tolist(), np.append(begin[1:], len(data)).tolist(), np.add.reduceat(out, begin, dtype=np.int64).tolist()):
        if n <= window:
            add(a, n)
            continue
        edges = [*(np.flatnonzero(mark[a:b]) + a).tolist(), b]
        starts = np.cumsum([a, *(len(machine.token[t]) for x, y in zip(edges, edges[1:]) for t in machine._piece(data[x:y].tobytes()))])[:-1]
        # a contraction would begin a text that begins with its apostrophe
        free = whole[starts] & ~((data[starts] == 39) & ~mark[starts] & np.isin(data[np.minimum(starts + 1, len(data) - 1)], np.frombuffer(b"stmdrvl", np.uint8)))
        free[0] = True
        first = np.flatnonzero(free)
        for x, y, m in zip(starts[first].tolist(), np.append(starts[first[1:]], b).tolist(), np.diff(np.append(first, len(starts))).tolist()):
            if m <= window:
                add(x, m)
                continue
            close(x)
            done += [(x + c, m) for c, m in _between_characters(data[x:y], whole[x:y], window, machine)]
            close(y)
    close(len(data))
    return done


def _measure(blob: bytes, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = fsm.transducer(blob)
        for batch in batches:
            for base, arr in blocks(batch.column(2)):
                data, off = raw(arr)
                if len(data) == 0:
                    continue
                out, _ = fsm.deltas(arr, machine)
                mark = fsm.borders(data, off)
                at = _sentences(data, off, mark)
                tokens = np.add.reduceat(out, at, dtype=np.int32)
                inside = np.zeros(len(at), bool)  # the piece ends inside a sentence
                if (long := np.flatnonzero(tokens > window)).size:
                    ends = np.append(at[1:], len(data))
                    cut = [[(a + x, n) for x, n in _pieces(data[a:b], out[a:b], mark[a:b], window, machine)] for a, b in zip(at[long].tolist(), ends[long].tolist())]
                    more = np.ones(len(at), np.int64)
                    more[long] = [len(x) for x in cut]
                    last = np.cumsum(more) - 1
                    at, tokens = np.repeat(at, more), np.repeat(tokens, more)
                    inside = np.ones(len(at), bool)
                    inside[last] = False
                    for k, x in zip(long.tolist(), cut):
                        to = slice(last[k] + 1 - len(x), last[k] + 1)
                        at[to], tokens[to] = zip(*x)
                lead = np.append(0, np.cumsum((data & 0xC0) != 0x80))
                row = np.searchsorted(off, at, "right") - 1
                ends = lead[np.append(at[1:], len(data))] - lead[off[row]]
                first = np.searchsorted(at, off)
                held = np.flatnonzero(np.diff(first))
                ptr = pa.array(np.append(first[held], len(at)).astype(np.int32))
                hard = np.flatnonzero(inside)
                hard_ptr = pa.array(np.searchsorted(hard, np.append(first[held], len(at))).astype(np.int32))
                cols = batch.slice(base, len(arr)).take(pa.array(held))
                yield pa.RecordBatch.from_arrays(
                    [cols.column(0), cols.column(1), pa.ListArray.from_arrays(ptr, pa.array(tokens, pa.int32())), pa.ListArray.from_arrays(ptr, pa.array(ends, pa.int32())), pa.ListArray.from_arrays(hard_ptr, pa.array(hard - first[row[hard]], pa.int32()))],
                    names=["doc_id", "tie", "tokens", "ends", "hard"],
                )

    return run


def pack_shard(docs: list[tuple], window: int, truncation: float, hard: float) -> list[tuple]:
    """Windows of the ordered (doc_id, tokens, ends, pieces that end inside a sentence): n_tokens, padding, cut, doc_ids, starts, ends."""
    counts, penalty, piece = [], [], []  # piece: (document, start, end)
    for d, (_, tokens, ends, cut) in enumerate(docs):
        base = len(counts)
        counts += tokens
        penalty += [truncation] * (len(tokens) - 1) + [0.0]
        piece += [(d, lo, hi) for lo, hi in zip([0, *ends], ends)]
        for k in cut:
            penalty[base + k] = hard
    _, ends = cuts(counts, penalty, window)
    rows, i = [], 0
    for end in ends:
        n = sum(counts[i:end])
        spans: list[list[int]] = []
        for d, a, b in piece[i:end]:
            if spans and spans[-1][0] == d:
                spans[-1][2] = b
            else:
                spans.append([d, a, b])
        kind = "document" if penalty[end - 1] == 0 else "sentence" if penalty[end - 1] == truncation else "inside"
        rows.append((n, window - n, kind, [docs[d][0] for d, _, _ in spans], [a for _, a, _ in spans], [b for _, _, b in spans]))
        i = end
    return rows


def _packer(window: int, truncation: float, hard: float):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        ids = [None if pd.isna(x) else int(x) for x in pdf["doc_id"]]
        docs = [(i, t.tolist(), e.tolist(), c.tolist()) for i, t, e, c in zip(ids, pdf["tokens"], pdf["ends"], pdf["hard"])]
        rows = pack_shard(docs, window, truncation, hard)
        out = pd.DataFrame(rows, columns=["n_tokens", "padding", "cut", "doc_ids", "starts", "ends"])
        out.insert(0, "window", np.arange(len(out), dtype=np.int32))
        out.insert(0, "shard", key[0])
        return out

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their range and their number in it."""
    from pyspark import TaskContext

    place, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        at = np.arange(n, n + batch.num_rows)
        n += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, place), pa.int32()), pa.array(at, pa.int64())], names=[x.split()[0] for x in COUNTED.split(", ")])


def pack(docs: DataFrame, window: int = WINDOW, truncation: float = TRUNCATION, hard_truncation: float = HARD_TRUNCATION, shard: int = SHARD, vocabulary: str = vocab.DEFAULT) -> DataFrame:
    """Windows in order within each shard: the documents and character spans they hold, tokens and padding."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string").alias("text"))
    sized = written(rows.mapInArrow(_measure(vocab.read(vocabulary), window), SIZED), "sized")
    order = ["doc_id", "tie", "size", "uid"]
    # the range partitioner samples its input: it reads the written counts, not the tokenizer; uid parts equal rows
    ranged = sized.withColumn("uid", F.monotonically_increasing_id()).withColumn("size", F.size("tokens")).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.select("doc_id", "tokens", "ends", "hard").mapInArrow(_counted, COUNTED), "ranged")
    drop(sized)
    held = sorted((x["place"], x["count"]) for x in ranged.groupBy("place").count().collect())  # a row per range
    offsets = dict(zip((p for p, _ in held), np.append(0, np.cumsum([n for _, n in held])).tolist()))
    spark = docs.sparkSession
    before = F.broadcast(spark.createDataFrame([*offsets.items()], "place int, before bigint"))
    ranked = ranged.join(before, "place").withColumn("rank", F.col("before") + F.col("at"))
    sharded = ranked.select("rank", "doc_id", "tokens", "ends", "hard", F.expr(f"CAST(floor(rank / {shard}) AS bigint)").alias("shard"))
    return sharded.groupBy("shard").applyInPandas(_packer(window, truncation, hard_truncation), SCHEMA)
