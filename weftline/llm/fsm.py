"""A byte-level BPE tokenizer compiled to a deterministic finite-state transducer that counts tokens.

State.  After reading a prefix w of a pre-token, what later bytes can change is fixed by the longest
suffix v of w that begins some vocabulary token, and, for each position inside v from which a longer
token can still grow, the last token of the tokenization of the prefix that ends there and that prefix's
token count relative to w's.  That
list of (suffix, token, count) is the state; there are finitely many, and equal ones have equal futures.

Transition.  Reading byte b, the tokenization of wb ends in the one token t that is a suffix of vb and
whose predecessor, the last token of the prefix before t, keeps its border with t when the two are
merged together.  The transition is annotated with the emitted-token count, |BPE(wb)| - |BPE(w)|, which
may be negative.  States and transitions are compiled when first met and kept in dense tables.

Scan.  Text is cut into chunks.  A chunk's state map sends entry states to (exit state, count).  From
its first pre-token border on a chunk is independent of the entry state, so its map is
its head, the bytes before that border, and the count and exit of the rest.  All rests run side by side,
a byte a step.  A chunk without any border has a map proper.  Such maps are made for the entry states that can
occur: first for the start state, then, all chunks side by side, for every exit state of the chunk before that
is new, until the chain from the last border on is closed.  The maps are composed by a parallel prefix scan, pointers
over (chunk, entry state) doubling each round, which gives each chunk's entry state; with these all heads and
borderless chunks run side by side once more.
"""

from __future__ import annotations

import sys
from array import array

import numpy as np
import pyarrow as pa
import regex

from weftline.llm import vocab
from weftline.llm.grams import raw

CHUNK = 512
MAX_STATES = 250_000
MAX_PAIRS = 200_000
_compiled: dict[int, Transducer] = {}


class Transducer:
    """Lazily compiled transducer of one vocabulary.  State 0 is the start of a pre-token."""

    def __init__(self, blob: bytes):
        self.ranks = vocab.ranks(blob)
        self.token = {v: k for k, v in self.ranks.items()}
        self.heads = {t[:i] for t in self.ranks for i in range(len(t))}
        core = vocab.encoding(blob)._core_bpe
        self._piece = core.encode_single_piece
        self._fits: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        start = _pack(b"", [(0, -1, 0)])
        self.ids: dict[bytes, int] = {start: 0}
        self.states: list[bytes] = [start, b""]  # state 1 waits for a border, whatever it reads
        self.column = np.full(256, -1, np.int64)  # bytes met so far have a column each
        self.width = 0
        # next state * 128 + 64 + emitted count, 0 where not compiled; rows that aren't used take no memory
        self.cells = np.zeros((MAX_STATES + 1024, 128), np.int32)
        self.cells[1] = 1 * 128 + 64

    def _grow(self, rows: int, columns: int) -> None:
        used = min(len(self.states), len(self.cells))
        new = np.zeros((rows, columns), np.int32)
        new[:used, : self.cells.shape[1]] = self.cells[:used]
        new[1] = 1 * 128 + 64
        self.cells = new

    def fits(self, left: int, right: int) -> bool:
        """Whether tokens ``left``, ``right`` stay as they are when their bytes are tokenized together."""
        if left < 0:
            return True
        key = left << 32 | right
        if (ok := self._fits.get(key)) is None:
            if len(self._fits) >= MAX_PAIRS:
                self._fits.clear()
            ok = self._fits[key] = list(self._piece(self.token[left] + self.token[right])) == [left, right]
        return ok

    def compile(self, state: int, byte: int) -> None:
        v, opens = _unpack(self.states[state])
        ranks, heads, w, size = self.ranks, self.heads, v + bytes((byte,)), len(v)
        for length, last, count in opens:
            t = ranks.get(w[size - length :])
            if t is not None and self.fits(last, t):
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        emitted = count + 1
        # positions that no longer token can begin at say nothing about the future
        grown = [(n + 1, last, c - emitted) for n, last, c in opens if w[size - n :] in heads]
        target = _pack(w[len(w) - grown[0][0] :] if grown else b"", [*grown, (0, t, 0)])
        to = self.ids.get(target)
        if to is None:
            to = self.ids[target] = len(self.states)
            self.states.append(target)
            if to >= len(self.cells):
                self._grow(len(self.cells) * 3 // 2, self.cells.shape[1])
        self.cells[state, self.column[byte]] = to * 128 + 64 + emitted

    def columns(self, data: np.ndarray) -> None:
        """Gives the bytes of ``data`` their columns."""
        for b in np.flatnonzero(np.bincount(data, minlength=256) * (self.column < 0)):
            self.column[b] = self.width
            self.width += 1
        if self.width > self.cells.shape[1]:
            self._grow(len(self.cells), 256)

    def step(self, state: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and emitted counts of many lanes; bytes are given by their columns."""
        at = state * np.int32(self.cells.shape[1]) + column
        cell = self.cells.ravel().take(at)
        if not cell.all():
            byte_of = np.zeros(256, np.int64)
            byte_of[self.column[self.column >= 0]] = np.flatnonzero(self.column >= 0)
            missing = np.flatnonzero(cell == 0)
            for key in set((state[missing].astype(np.int64) * 256 + byte_of[column[missing]]).tolist()):
                self.compile(key >> 8, key & 255)
            at = state * np.int32(self.cells.shape[1]) + column
            cell = self.cells.ravel().take(at)
        return cell >> 7, (cell & 127) - 64


def _pack(v: bytes, opens: list[tuple[int, int, int]]) -> bytes:
    """A state as bytes: the suffix v and, for each open position, its distance from the end, last token and count."""
    return array("i", [x for o in opens for x in o]).tobytes() + v + bytes((len(v),))


def _unpack(state: bytes) -> tuple[bytes, list[tuple[int, int, int]]]:
    n = state[-1]
    flat = array("i", state[: -1 - n])
    return state[-1 - n : -1], list(zip(flat[::3], flat[1::3], flat[2::3]))


def transducer(blob: bytes) -> Transducer:
    key = hash(blob)
    if key not in _compiled:
        _compiled[key] = Transducer(blob)
    return _compiled[key]


# --- pre-tokens: the vocabulary's split pattern as borders over character classes ---

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0
_classes: np.ndarray | None = None


def _class_table() -> np.ndarray:
    global _classes
    if _classes is None:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
        table = np.zeros(sys.maxunicode + 1, np.uint8)
        for name, value in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _SPACE)):
            for m in regex.finditer(name + "+", every):
                lo, hi = m.start(), m.end()
                table[[ord(c) for c in every[lo:hi]]] = value
        _classes = table
    return _classes


def _decode(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and the byte position of each."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    if len(at) == len(data):
        return data.astype(np.uint32), at
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), at


def borders(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Flags of the bytes that begin a pre-token; texts are ``data[off[i]:off[i+1]]``."""
    flags = np.zeros(len(data), bool)
    if len(data) == 0:
        return flags
    points, at = _decode(data)
    kind = _class_table()[points]
    n = len(points)
    first = np.zeros(n + 1, bool)  # first character of a text
    first[np.searchsorted(at, off[:-1][np.diff(off) > 0])] = True
    first[n] = True
    change = np.append(True, kind[1:] != kind[:-1]) | first[:n]
    start = change.copy()
    space = kind == _SPACE
    # a run of white space gives its last character to what follows in the text: a blank joins it, any other stands alone
    follows = np.append(space[:-1] & ~space[1:], False) & ~first[1:]  # last white character before a non-white one
    start |= follows
    joined = follows & (points == 32)
    after = np.flatnonzero(joined) + 1
    start[after] = False
    _contractions(points, kind, start, first, joined)
    flags[at[start]] = True
    return flags


def _contractions(points, kind, start, first, joined) -> None:
    """'s 't 'm 'd 're 've 'll split off wherever a match may begin at the apostrophe."""
    n = len(points)
    for i in np.flatnonzero((points == 39) & start[:n]).tolist():
        pair = points[i + 1 : i + 3]
        if len(pair) == 0 or first[i + 1]:
            continue
        a = chr(pair[0])
        b = chr(pair[1]) if len(pair) > 1 and not first[i + 2] else ""
        size = 2 if a in "stmd" else 3 if a + b in ("re", "ve", "ll") else 0
        if not size:
            continue
        start[i + 1 : i + size] = False
        end = i + size
        if end < n and not first[end]:
            if not (kind[end] == _SPACE and kind[end - 1] == _SPACE):
                start[end] = True


def deltas(arr: pa.Array, machine: Transducer, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Tokens emitted at each byte of the texts (their sum over whole pre-tokens is the token count), and
    the texts' byte offsets."""
    data, off = raw(arr)
    n = len(data)
    out = np.zeros(n, np.int8)
    if n == 0:
        return out, off
    if len(machine.states) > MAX_STATES:
        machine.reset()
    machine.columns(data)
    mark = borders(data, off)
    column = machine.column[data].astype(np.uint8)
    lanes = -(-n // chunk)
    # all chunks side by side, a byte a step; a lane waits in state 1 for its first border
    wide = np.zeros(lanes * chunk, np.uint8)
    wide[:n] = column
    steps = np.ascontiguousarray(wide.reshape(lanes, chunk).T)
    flags = np.zeros(lanes * chunk, bool)
    flags[:n] = mark
    flags = flags.reshape(lanes, chunk)
    inside = np.ascontiguousarray(~flags.T).astype(np.int32)
    emitted = np.empty((chunk, lanes), np.int8)
    state = np.ones(lanes, np.int32)
    for i in range(chunk):
        state *= inside[i]
        state, emitted[i] = machine.step(state, steps[i])
    out[:] = emitted.T.ravel()[:n]
    # composition
    lo = np.arange(lanes) * chunk
    bordered = flags.any(1)
    head = np.where(bordered, lo + flags.argmax(1), np.minimum(lo + chunk, n))
    entry = np.append(-1, np.where(bordered, state, -1)[:-1])  # of the first chunk, which begins with a border, none is needed
    bare = np.flatnonzero(~bordered)
    if len(bare):
        exits = _scan(bare, entry, steps, machine)
        after = bare[bare + 1 < lanes] + 1
        entry[after] = exits[: len(after)]
    todo = np.flatnonzero(head > lo)
    order = todo[np.argsort(lo[todo] - head[todo], kind="stable")]  # longest first: those running are a prefix
    now, size = entry[order].astype(np.int32), (head - lo)[order]
    live, i = len(order), 0
    while True:
        live = int(np.searchsorted(-size[:live], -i))
        if not live:
            break
        at = lo[order[:live]] + i
        now[:live], out[at] = machine.step(now[:live], column[at])
        i += 1
    return out, off


def _scan(bare: np.ndarray, entry: np.ndarray, steps: np.ndarray, machine: Transducer) -> np.ndarray:
    """Exit states of the chunks without a border, whose entry state is that of ``entry`` or the exit of the chunk before."""
    node: dict[tuple[int, int], int] = {}  # (place in bare, entry state)
    into: list[int] = []  # exit state of each
    first = entry[bare] >= 0
    starts = [(int(k), int(entry[bare[k]])) for k in np.flatnonzero(first)]
    new = list(dict.fromkeys([*starts, *((int(k), 0) for k in range(len(bare)))]))
    while True:
        node |= {x: len(into) + i for i, x in enumerate(new)}
        where, state = bare[[k for k, _ in new]], np.array([s for _, s in new], np.int32)
        for row in steps:
            state, _ = machine.step(state, row[where])
        into += state.tolist()
        places, exits = np.array([k for k, _ in node]), np.array(into)
        last = np.append(first[1:], True)[places]  # no chunk without a border follows
        step = np.array([-1 if end else node.get((int(k) + 1, int(s)), -1) for k, s, end in zip(places, exits, last)])
        # prefix scan: what 2^r pointers reach from the first chunks, then 2^(r+1)
        on = np.zeros(len(step), bool)
        on[[node[x] for x in starts]] = True
        jump = step
        while (jump >= 0).any():
            reached = jump[on & (jump >= 0)]
            on[reached] = True
            jump = np.where(jump >= 0, jump[jump], -1)
        if not (on & (step < 0) & ~last).any():
            out = np.zeros(len(bare), np.int64)
            out[places[on]] = exits[on]
            return out
        new = list(dict.fromkeys((int(k) + 1, int(s)) for k, s, end in zip(places, exits, last) if not end and (int(k) + 1, int(s)) not in node))
