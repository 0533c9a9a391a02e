"""Public byte-level BPE vocabularies in rank files, read once and handed to the tasks by value."""

from __future__ import annotations

import base64
import os

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DEFAULT = os.environ.get("WEFTLINE_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
_encodings: dict[int, object] = {}


def read(path: str = DEFAULT) -> bytes:
    """The rank file's bytes; only the driver needs the file."""
    with open(path, "rb") as f:
        return f.read()


def ranks(blob: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, blob.splitlines()) if a}


def encoding(blob: bytes):
    """The vocabulary's tiktoken encoding, made once in each process."""
    import tiktoken

    key = hash(blob)
    if key not in _encodings:
        _encodings[key] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks(blob), special_tokens={})
    return _encodings[key]
