"""WARC archives: a writer and a sequential reader.

Each record is a gzip member of its own.  The reader streams a file through an incremental zlib decompressor a
member at a time, at most ``PIECE`` bytes of output a step, frames the block by Content-Length, hashes it as it passes
and checks the block and payload digests (SHA-1, SHA-256, SHA-512 and MD5, in base 32 or hexadecimal); memory is bounded by
the largest record.  Files are read side by side, one task a file.

Statuses: ``ok``; ``digest`` (a stated digest doesn't match); ``length`` (block and Content-Length differ);
``header`` (no WARC header); ``corrupt`` (bad deflate data: the reader goes on at the next gzip member);
``truncated`` (the file ends inside a record).  ``digest_ok`` is null where no digest of a known kind is stated.

Defined cases: a null URL, id or body is written without its header, resp. as a null marker, and is null again
when read; a URL that a header can't hold as it is (line ends, blanks around it) is written percent-encoded, and as JSON in
a header of its own from which it is read back unchanged; empty bodies stay empty; repeated rows are separate records;
an empty table gives no files.  The archive of ``round_trip`` stays in the shared folder, as its result is read from it.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import Any, BinaryIO
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.store import shared_dir

READ = 1 << 18
PIECE = 1 << 20
ROLL = 256 << 20
LEVEL = 4
RECORDS = "path string, offset bigint, status string, record_type string, record_id string, target_uri string, warc_date string, content_type string, content_length bigint, digest_ok boolean, headers map<string,string>, payload binary"
_DIGESTS = ("sha1", "sha256", "sha512", "md5")
_MAGIC = b"\x1f\x8b\x08"


def sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(payload: bytes | None, uri: str | None = None, extra: dict[str, str] | None = None, date: str = "1970-01-01T00:00:00Z", level: int = LEVEL) -> bytes:
    """One response record as a gzip member."""
    body = payload or b""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body
    head = {"WARC-Type": "response", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{uri} {extra}')}>", "WARC-Date": date}
    if uri is not None:
        plain = uri == uri.strip() and not any(c in uri for c in "\r\n") and uri
        head["WARC-Target-URI"] = uri if plain else quote(uri, safe="")
        if not plain:
            head["WARC-X-Target-URI-JSON"] = json.dumps(uri)
    head |= {"WARC-Payload-Digest": sha1(body), "WARC-Block-Digest": sha1(block), "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))} | (extra or {})
    if payload is None:
        head["WARC-X-Null"] = "1"
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(text.encode() + block + b"\r\n\r\n") + z.flush()


def _members(f: BinaryIO) -> Iterator[tuple[int, Iterator[bytes]]]:
    """(offset, pieces of the decompressed member) one after the other; the pieces must be used up."""
    rest, offset = b"", 0
    while True:
        if not rest:
            rest = f.read(READ)
            if not rest:
                return
        start = offset

        def pieces() -> Iterator[bytes]:
            nonlocal rest, offset
            z = zlib.decompressobj(31)
            while True:
                data = z.unconsumed_tail or rest or f.read(READ)
                if not data:
                    raise EOFError
                if not z.unconsumed_tail:
                    rest = b""
                try:
                    out = z.decompress(data, PIECE)
                except zlib.error:
                    # go on at the next member's magic, in what is left of this piece or in later ones
                    at = data.find(_MAGIC, 1)
                    while at < 0:
                        offset += max(0, len(data) - 2)
                        more = f.read(READ)
                        if not more:
                            offset += min(2, len(data))
                            raise
                        data = data[-2:] + more
                        at = data.find(_MAGIC)
                    offset += at
                    rest = data[at:]
                    raise
                if z.eof:
                    rest = z.unused_data
                offset += len(data) - len(rest if z.eof else z.unconsumed_tail)
                if out:
                    yield out
                if z.eof:
                    return

        yield start, pieces()


def _parse(head: bytes) -> dict[str, str] | None:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return None
    out: dict[str, str] = {}
    last = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = name.strip().lower()
            out[last] = value.strip()
    return out


def _read_record(pieces: Iterator[bytes]) -> tuple[str, dict[str, str], bytes | None, bool | None]:
    """(status, headers, payload, digest_ok) of one member."""
    head, headers, size, got, tail = b"", None, 0, 0, 0
    hashes: dict[str, Any] = {}
    http, body = None, []
    status = "ok"
    is_http = False

    def take(data: bytes) -> None:
        nonlocal got, tail, http
        inside = data[: size - got]
        tail += len(data) - len(inside)
        got += len(inside)
        if "block" in hashes:
            hashes["block"].update(inside)
        if is_http and http is not None:
            http += inside
            at = http.find(b"\r\n\r\n")
            if at < 0:
                return
            inside, http = http[at + 4 :], None
        body.append(inside)
        if "payload" in hashes:
            hashes["payload"].update(inside)

    try:
        for data in pieces:
            if headers is None:
                head += data
                at = head.find(b"\r\n\r\n")
                if at < 0:
                    continue
                headers = _parse(head[:at])
                data, head = head[at + 4 :], b""
                if headers is None:
                    status, headers = "header", {}
                size = int(headers.get("content-length", "0")) if headers.get("content-length", "0").isdigit() else 0
                hashes = {part: hashlib.new(kind) for part in ("block", "payload") if (kind := headers.get(f"warc-{part}-digest", "").partition(":")[0].lower().replace("-", "")) in _DIGESTS}
                is_http = headers.get("content-type", "").startswith("application/http")
                http = b"" if is_http else None
            take(data)
    except EOFError:
        status = "truncated"
    except zlib.error:
        status = "corrupt"
    if headers is None:
        headers, status = {}, "header" if status == "ok" else status
    if status == "ok" and (got != size or tail != 4):
        status = "length"
    digests = []
    for part, h in hashes.items():
        stated = headers[f"warc-{part}-digest"].partition(":")[2].strip()
        digests.append(stated.lower() == h.hexdigest() or stated.upper().rstrip("=") == base64.b32encode(h.digest()).decode().rstrip("="))
    ok = all(digests) if digests else None
    if status == "ok" and ok is False:
        status = "digest"
    payload = None if headers.get("warc-x-null") or status == "header" else b"".join(body)
    return status, headers, payload, ok


def read_stream(f: BinaryIO, path: str = "") -> Iterator[tuple]:
    """Rows of ``RECORDS`` of one archive, in order."""
    for offset, pieces in _members(f):
        status, h, payload, ok = _read_record(pieces)
        size = h.get("content-length", "")
        uri = h.get("warc-target-uri")
        try:
            uri = json.loads(h["warc-x-target-uri-json"]) if "warc-x-target-uri-json" in h else uri
        except ValueError:
            pass  # not of this writer
        yield path, offset, status, h.get("warc-type"), h.get("warc-record-id"), uri, h.get("warc-date"), h.get("content-type"), int(size) if size.isdigit() else None, ok, h, payload


def _open(path: str) -> BinaryIO:
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)
    return system.open_input_stream(name, compression=None)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.bool_(), pa.map_(pa.string(), pa.string()), pa.binary()]
    cols = list(zip(*rows))
    cols[10] = [list(h.items()) for h in cols[10]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in RECORDS.replace("map<string,string>", "map").split(", ")])


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            rows, held = [], 0
            with _open(path) as f:
                for row in read_stream(f, path):
                    rows.append(row)
                    held += len(row[-1] or b"")
                    if held > 8 << 20 or len(rows) >= 2000:
                        yield _batch(rows)
                        rows, held = [], 0
            if rows:
                yield _batch(rows)


def read_warc(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The records of WARC files, a task for each file."""
    if not paths:
        return spark.createDataFrame([], RECORDS)
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInArrow(_reader, RECORDS)


def _writer(folder: str, roll: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        task = TaskContext.get()
        system, base = fs.FileSystem.from_uri(folder) if ":/" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        done: list[tuple[str, int]] = []
        out, size, n, name = None, 0, 0, ""

        def close() -> None:
            out.close()
            # a repeated attempt writes the same rows under the same name
            final = name.removesuffix(f".{task.taskAttemptId()}")
            system.move(name, final)
            done.append((folder.rstrip("/") + final[len(base.rstrip("/")) :], n))

        for batch in batches:
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if out is None:
                    name = f"{base.rstrip('/')}/part-{task.partitionId():06d}-{len(done):04d}.warc.gz.{task.taskAttemptId()}"
                    out, size, n = system.open_output_stream(name, compression=None), 0, 0
                extra = {} if page is None else {"WARC-X-Page-Id": str(page)}
                member = record(None if html is None else html.encode(), url, extra, level=level)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= roll:
                    close()
                    out = None
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done]), pa.array([k for _, k in done], pa.int64())], names=["path", "records"])

    return run


def write_warc(pages: DataFrame, folder: str, roll: int = ROLL, level: int = LEVEL) -> list[str]:
    """Writes page_id, url, html as response records, a file for each partition and ``roll`` bytes; returns the
    files' paths.  Only paths come to the driver."""
    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    return sorted(r["path"] for r in rows.mapInArrow(_writer(folder, roll, level), "path string, records bigint").collect())


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages archived into the shared folder and read back: page_id, url, html, n_bytes, digest_ok, status."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/weftline/warc-{uuid.uuid4().hex}"
    got = read_warc(spark, write_warc(pages, folder))
    return got.select(F.col("headers")["warc-x-page-id"].cast("bigint").alias("page_id"), F.col("target_uri").alias("url"), F.col("payload").cast("string").alias("html"), F.octet_length("payload").cast("bigint").alias("n_bytes"), "digest_ok", "status")


ORACLE = "SELECT page_id::BIGINT AS page_id, url, html, strlen(html)::BIGINT AS n_bytes, true AS digest_ok, 'ok' AS status FROM pages"
