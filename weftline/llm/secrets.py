"""Secret scan by token efficiency.

Language packs several characters into a token of a BPE vocabulary; random strings don't.  Candidates are

* credential values: ``KEY_LENGTH`` or more characters without white space or quotes, marks included, that a credential
  word (token, secret, password, api key, ...) introduces by ``:``, ``=``, ``=>`` or ``is``;
* other maximal runs of at least ``MIN_LENGTH`` characters of ``[A-Za-z0-9+/=_-]``

in the whole text.  The token test comes first: a candidate with ``MAX_RATIO`` or more characters per token is no secret.
Of the rest, these known digests and identifiers are excluded:

* a number: no letters (phone, card, account and order numbers);
* a UUID;
* a known digest: hexadecimal of 32, 40, 56, 64, 96 or 128 digits that no credential word introduces;
* a word or identifier in one case (fewer than two changes between letters, digits and case) that no credential word
  introduces and whose ratio is ``ONE_CASE`` or more: long compounds of some languages come near the limit, random
  letters mostly lie below.

Defined cases: a null or empty text has no secrets; offsets count characters of the text as it is; where candidates
overlap the credential value counts; repeated rows are each reported; a null doc_id is carried through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import vocab
from weftline.llm.grams import blocks, raw

MIN_LENGTH = 20
KEY_LENGTH = 12
MAX_RATIO = 2.4
ONE_CASE = 1.9
MASK = "[SECRET]"
SCHEMA = "doc_id bigint, start int, end int, secret string, chars_per_token double, context string"

_RUN = np.zeros(256, bool)
_RUN[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/=_-"]] = True
_UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}", re.I)
_DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.I)
_NAMES = r"token|secret|passw(?:or)?d|passphrase|pwd|api[ _-]?key|access[ _-]?key|private[ _-]?key|credential|bearer|auth(?:orization)?"
_KEY = re.compile(rf"(?:{_NAMES})[\"']?\s*(?:[:=]|=>|is)?\s*[\"'`]?$", re.I | re.A)
_INLINE = re.compile(r"^(?:[\w-]*(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key)[\w-]*)=(?=.)", re.I | re.A)
_VALUE = rf"(?:{_NAMES})[\"'`]?\s*(?:[:=]|=>|is\s)\s*[\"'`]?([^\s\"'`<>]+)"
_VALUES = re.compile(_VALUE.encode(), re.I)
_TAIL = ".,;:)]}"


def _kinds(s: str) -> int:
    """Changes between lower case, upper case and digits; a capital at a part's start is none."""
    changes, last = 0, ""
    for i, c in enumerate(s):
        kind = "d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else ""
        if kind and last and kind != last and not (last == "u" and kind == "l" and (i < 2 or not s[i - 2].isalnum())):
            changes += 1
        last = kind
    return changes


def excluded(s: str, ratio: float, known: bool) -> str:
    """Why a run of a low ratio isn't random text, or ``''``; ``known``: a credential word introduces it."""
    core = s.strip("=-_+/")
    if not any(c.isalpha() for c in core):
        return "number"
    if _UUID.fullmatch(core):
        return "uuid"
    if not known and _DIGEST.fullmatch(core):
        return "digest"
    if not known and ratio >= ONE_CASE and _kinds(core) < 2:
        return "word"
    return ""


Spans = list[tuple[int, int]]


def find(text: str, encode, values: Spans, runs: Spans, min_length: int = MIN_LENGTH, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, str, float, str]]:
    """(start, end, secret, characters per token, context) of a text with the spans of its credential values and runs."""
    out: list[tuple[int, int, str, float, str]] = []

    def judge(start: int, s: str, least: int, known: bool) -> None:
        bare = s.rstrip("=") or s
        if len(bare) < least:
            return
        ratio = len(bare) / max(1, len(encode(bare)))
        if ratio < max_ratio and not excluded(bare, ratio, known):
            out.append((start, start + len(s), s, ratio, "credential" if known else "bare"))

    for start, end in values:
        judge(start, text[start:end].rstrip(_TAIL), KEY_LENGTH, True)
    taken = [(a, b) for a, b, *_ in out]
    for start, end in runs:
        s, before = text[start:end], text[max(0, start - 40) : start]
        if m := _INLINE.match(s):  # token=abc in one run
            before, start, s = before + m.group(0), start + m.end(), s[m.end() :]
        if not any(a < end and start < b for a, b in taken):
            judge(start, s, min_length, bool(_KEY.search(before)))
    return sorted(out)


def _candidates(arr: pa.Array, min_length: int) -> Iterator[tuple[int, str, Spans, Spans]]:
    """(row, text, character spans of its credential values, of its runs) of the rows that have any."""
    data, off = raw(arr)
    if len(data) == 0:
        return
    flag = np.zeros(len(data) + 1, np.int8)
    flag[:-1] = _RUN[data]
    edge = np.append(True, flag[1:] != flag[:-1])
    edge[off] = True
    at = np.flatnonzero(edge)
    keep = (flag[at[:-1]] == 1) & (np.diff(at) >= min_length)
    spans = [np.zeros((0, 2), np.int64), np.stack([at[:-1][keep], at[1:][keep]], 1)]
    body = data.tobytes()
    found = []
    for lo, hi in zip(off[:-1].tolist(), off[1:].tolist()):
        found += [m.span(1) for m in _VALUES.finditer(body, lo, hi)]
    if found:
        spans[0] = np.array(found, np.int64)
    rows = [np.searchsorted(off, x[:, 0], "right") - 1 for x in spans]
    for r in np.unique(np.concatenate(rows)).tolist():
        part = data[off[r] : off[r + 1]]
        lead = np.append(0, np.cumsum((part & 0xC0) != 0x80))  # characters before each byte
        values, runs = (list(map(tuple, lead[x[row == r] - off[r]].tolist())) for x, row in zip(spans, rows))
        yield r, part.tobytes().decode(), values, runs


def _finder(blob: bytes, min_length: int, max_ratio: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocab.encoding(blob).encode_ordinary
        for batch in batches:
            rows = []
            for base, arr in blocks(batch.column(1)):
                for r, text, values, runs in _candidates(arr, min_length):
                    rows += [(base + r, *x) for x in find(text, encode, values, runs, min_length, max_ratio)]
            if rows:
                r, *rest = zip(*rows)
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(r, pa.int64())), *(pa.array(x, k) for x, k in zip(rest, kinds))], names=["doc_id", "start", "end", "secret", "chars_per_token", "context"])

    return run


def secrets(docs: DataFrame, vocabulary: str = vocab.DEFAULT, min_length: int = MIN_LENGTH, max_ratio: float = MAX_RATIO) -> DataFrame:
    """One row per secret: doc_id, character span, the string, characters per token, ``credential`` or ``bare``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_finder(vocab.read(vocabulary), min_length, max_ratio), SCHEMA)


def redact(docs: DataFrame, vocabulary: str = vocab.DEFAULT, min_length: int = MIN_LENGTH, max_ratio: float = MAX_RATIO) -> DataFrame:
    """``docs`` with each secret replaced by ``[SECRET]``; ``n_chars`` follows where the table has it."""
    blob, at = vocab.read(vocabulary), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocab.encoding(blob).encode_ordinary
        for batch in batches:
            changed: dict[int, str] = {}
            for base, arr in blocks(batch.column(at)):
                for r, text, values, runs in _candidates(arr, min_length):
                    for start, end, _, _, _ in reversed(find(text, encode, values, runs, min_length, max_ratio)):
                        text = text[:start] + MASK + text[end:]
                        changed[base + r] = text
            if changed:
                column = batch.column(at)
                mask = np.zeros(len(column), bool)
                mask[list(changed)] = True
                order = sorted(changed)
                new = pa.compute.replace_with_mask(column, pa.array(mask), pa.array([changed[r] for r in order], column.type))
                batch = batch.set_column(at, batch.schema.field(at), new)
            yield batch

    done = docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.schema)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done
