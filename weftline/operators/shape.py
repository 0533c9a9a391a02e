"""Pages shaped in Arrow batches: one parse a page gives title, Markdown, chunks, links and metadata."""

from __future__ import annotations

import hashlib
import json
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import metadata, shaping
from weftline.functions.htmltree import parse
from weftline.functions.lazy import arrow_udf, by_row

CHUNK = "struct<text:string,heading_trail:array<string>,selector_path:string,byte_start:int,byte_end:int,chunk_hash:string>"
SHAPED = f"struct<kind:string,title:string,markdown:string,chunks:array<{CHUNK}>,data:string,links:array<string>,next_url:string,jsonld:array<string>,fields:map<string,string>,origins:map<string,string>,source:string,error:string>"


def _row(url: str | None, html: str | None, content_type: str | None, raw: bytes | None, main: bool, target: int, overlap: int) -> dict:
    try:
        s = shaping.shape(html, content_type or "", raw, main, target, overlap)
        root = s.root
        objects, flat, source, origins = metadata.collect(root) if root is not None else ([], {}, None, {})
        return {
            "kind": s.kind,
            "title": s.title,
            "markdown": s.markdown,
            "chunks": [
                {"text": c.text, "heading_trail": c.trail, "selector_path": ("markdown" if s.kind == "html" else s.kind) + "://" + ("/".join(c.trail) or "_root_"), "byte_start": c.start, "byte_end": c.end, "chunk_hash": c.digest()}
                for c in s.chunks
            ],
            "data": s.data,
            "links": shaping.links(root, url or "") if root is not None else [],
            "next_url": shaping.next_link(root, url or "") if root is not None else None,
            "jsonld": [json.dumps(o, ensure_ascii=False) for o in objects],
            "fields": [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in flat.items()],
            "origins": list(origins.items()),
            "source": source,
            "error": None,
        }
    except Exception as e:  # one page never fails the batch
        return {"kind": None, "title": None, "markdown": None, "chunks": [], "data": None, "links": [], "next_url": None, "jsonld": [], "fields": [], "origins": [], "source": None, "error": f"{type(e).__name__}: {e}"}


def shaper(main: bool = False, target: int = shaping.TARGET, overlap: int = shaping.OVERLAP):
    """The page UDF: (url, html, content_type, raw) -> ``SHAPED``."""

    return by_row(lambda url, html, kind, raw: _row(url, html, kind, raw, main, target, overlap), SHAPED)


def _or_null(pages: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in pages.columns else F.lit(None).cast(kind)


def shape(pages: DataFrame, main: bool = False, target: int = shaping.TARGET, overlap: int = shaping.OVERLAP) -> DataFrame:
    """``pages`` (url, html, and content_type, raw_content where present) with a ``shaped`` struct.  Projecting
    several of its fields still parses each page once."""
    run = shaper(main, target, overlap)
    kind = F.lower(F.trim(F.split_part(_or_null(pages, "content_type", "string"), F.lit(";"), F.lit(1))))
    return pages.withColumn("shaped", run(F.col("url"), F.col("html"), kind, _or_null(pages, "raw_content", "binary")))


def chunk_rows(pages: DataFrame, **options) -> DataFrame:
    """A row per chunk with its provenance."""
    return shape(pages, **options).select("url", "shaped.title", F.posexplode("shaped.chunks").alias("pos", "c")).select("url", "title", "pos", "c.*")


def distinct_chunks(chunks: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """First chunk, by URL and position, of each hash: over all documents, or within the columns named.  One pass over the
    chunks and one shuffle; of chunks equal in both the least row counts."""
    rest = [c for c in chunks.columns if c not in ("url", "pos")]
    first = chunks.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate((*within, "chunk_hash"))]).agg(F.min(F.struct("url", "pos", *rest)).alias("f"))
    return first.select(*[F.col(f"f.{c}").alias(c) for c in chunks.columns])


def token_estimate(chunks: Column) -> Column:
    """Characters of all chunks over four, rounded down."""
    return F.floor(F.aggregate(chunks, F.lit(0).cast("bigint"), lambda a, c: a + F.char_length(c["text"])) / 4)


@arrow_udf("string")
def main_content(html: pd.Series) -> pd.Series:
    return html.map(lambda h: shaping.main_content(h or ""))


@arrow_udf(f"array<{CHUNK}>")
def chunk_markdown(md: pd.Series) -> pd.Series:
    def one(t: str | None) -> list[dict]:
        return [{"text": c.text, "heading_trail": c.trail, "selector_path": "markdown://" + ("/".join(c.trail) or "_root_"), "byte_start": c.start, "byte_end": c.end, "chunk_hash": c.digest()} for c in shaping.chunks(t or "")]

    return md.map(one)


def list_extractor(container: str, fields: dict[str, str]):
    """UDF html -> rows of the repeated elements that ``container`` selects."""

    @F.pandas_udf("array<map<string,string>>")
    def run(html: pd.Series) -> pd.Series:
        return html.map(lambda h: shaping.list_rows(parse(h or ""), container, fields))

    return run


def run_id(url: Column, at: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", url, at.cast("string")), 256)


def html_hash(html: str) -> str:
    return hashlib.sha256(html.encode()).hexdigest()
