"""Frontiers: URL deduplication, scope, site maps and level-by-level crawls over a table of pages."""

from __future__ import annotations

import gzip
import logging
import xml.etree.ElementTree as ET
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions import policy, shaping, urls
from weftline.functions.htmltree import parse
from weftline.functions.lazy import arrow_udf, by_row
from weftline.sources.state import discard, stored


_log = logging.getLogger(__name__)


def dedup_first(pages: DataFrame, order: str) -> DataFrame:
    """First row, by ``order``, of each normalised URL.

    Only keys are aggregated: the first ``order`` of each URL, then a semi join by it takes the rows, so that no page body is
    held in a buffer.  Rows that are equal in URL and ``order`` count as one.
    """
    first = pages.select(urls.normalize(F.col("url")).alias("normalized_url"), F.col(order).alias("_first")).groupBy("normalized_url").agg(F.min("_first").alias("_first"))
    keyed = pages.withColumn("_n", urls.normalize(F.col("url")))
    return keyed.join(first, keyed["_n"].eqNullSafe(first["normalized_url"]) & keyed[order].eqNullSafe(first["_first"])).select("normalized_url", *[keyed[c] for c in pages.columns]).dropDuplicates(["normalized_url"])


def unseen(found: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct new rows that aren't in ``seen``."""
    return found.dropDuplicates(keys).join(seen.select(*keys), keys, "left_anti")


def in_scope(found: DataFrame, seeds: DataFrame) -> DataFrame:
    """Rows whose host is that of a seed; ``www.`` doesn't matter, the port does."""
    hosts = seeds.select(urls.canonical_host(F.col("url")).alias("_h")).distinct()
    return found.join(hosts, urls.canonical_host(found["url"]) == hosts["_h"], "left_semi")


def _out_links(url: str, html: str) -> Column:
    """Links and next page of the page in these columns."""

    def one(base: str | None, body: str | None) -> dict:
        root = parse(body or "")
        return {"links": shaping.links(root, base or ""), "next_url": shaping.next_link(root, base or "")}

    return by_row(one, "struct<links:array<string>,next_url:string>")(url, html)


def links(pages: DataFrame) -> DataFrame:
    """(url, link) of every http(s) link, in page order."""
    return pages.select("url", F.posexplode(_out_links("url", "html")["links"]).alias("pos", "link"))


def _edges(pages: DataFrame) -> DataFrame:
    """(parent, url, step) by normalised URL; a rel=next link has step 0, any other 1.  Only links are filtered.  A page is
    parsed once for both."""
    out = pages.select(urls.normalize(F.col("url")).alias("parent"), _out_links("url", "html").alias("o"))
    hop = lambda u, step: F.struct(u.alias("raw"), F.lit(step).alias("step"))
    both = F.concat(F.transform("o.links", lambda u: hop(u, 1)), F.array(hop(F.col("o.next_url"), 0)))
    found = out.select("parent", F.explode(both).alias("h")).select("parent", "h.*").where("raw IS NOT NULL")
    found = found.where((F.col("step") == 0) | (~urls.is_asset(F.col("raw")) & policy.fetchable(F.col("raw"))))
    return found.groupBy("parent", urls.normalize(F.col("raw")).alias("url")).agg(F.min("step").alias("step"))


def crawl(pages: DataFrame, seeds: DataFrame, max_depth: int = 2, same_host: bool = True, max_pages: int | None = None, sitemap: DataFrame | None = None, on_level: Callable[[int, DataFrame], None] | None = None) -> DataFrame:
    """The crawl's queue (url, depth, parent_url, status) over a table of pages that stands for the fetches.

    A level is one job: frontier joined to the edges, less what was seen.  rel=next links keep their parent's
    depth.  Each level is written once to the shared folder and never again: what was seen is the union of the levels, so
    the lineage stays short and survives lost executors.  ``status`` is done for pages in the table, else failed.
    ``max_pages`` keeps the first in (depth, url) order.
    """
    edges = stored(_edges(pages), "edges")
    start = seeds.select("url") if sitemap is None else seeds.select("url").unionByName(sitemap.select("url"))
    front = start.select(urls.normalize(F.col("url")).alias("url")).where("url IS NOT NULL").distinct()
    if same_host:
        front = in_scope(front, seeds)
    front = stored(front.select("url", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("parent_url")), "level")
    levels = [front]
    if on_level is not None:
        on_level(0, front)
    while True:
        # links of the level, then rel=next chains inside it
        step = front.join(edges.withColumnRenamed("parent", "_p").withColumnRenamed("url", "_u"), F.col("url") == F.col("_p")).select(F.col("_u").alias("url"), (F.col("depth") + F.col("step")).alias("depth"), F.col("_p").alias("parent_url"))
        step = step.where(F.col("depth") <= max_depth)
        if same_host:
            step = in_scope(step, seeds)
        new = step.groupBy("url").agg(F.min(F.struct("depth", "parent_url")).alias("m")).select("url", "m.*")
        for level in levels:
            new = new.join(level.select("url"), "url", "left_anti")
        new = stored(new, "level")
        if new.isEmpty():
            break
        if on_level is not None:
            on_level(len(levels), new)
        levels.append(new)
        front = new
    discard(edges)
    seen = levels[0]
    for level in levels[1:]:
        seen = seen.unionByName(level)
    known = pages.select(urls.normalize(F.col("url")).alias("url")).distinct().withColumn("_k", F.lit(True))
    out = seen.join(known, "url", "left").select("url", "depth", "parent_url", F.when(F.col("_k"), "done").otherwise("failed").alias("status"))
    return out if max_pages is None else out.orderBy("depth", "url").limit(max_pages)


def map_site(pages: DataFrame, seeds: DataFrame, max_urls: int | None = 5000, max_depth: int = 2, same_host: bool = True, sitemap: DataFrame | None = None) -> DataFrame:
    """Sorted URLs found from the seeds and the site map, the first ``max_urls`` of all or, if None, each; seeds are
    always followed."""
    out = crawl(pages, seeds, max_depth, same_host, None, sitemap).select("url").distinct().orderBy("url")
    return out if max_urls is None else out.limit(max_urls)


def _locs(body: bytes) -> tuple[bool, list[str]]:
    if body[:2] == b"\x1f\x8b":
        try:
            body = gzip.decompress(body)
        except (OSError, EOFError):
            return False, []
    if b"<!ENTITY" in body:
        return False, []
    try:
        root = ET.fromstring(body)
    except (ET.ParseError, ValueError):
        return False, []
    local = lambda e: e.tag.rpartition("}")[2]
    return local(root) == "sitemapindex", [t for e in root.iter() if local(e) == "loc" and (t := (e.text or "").strip())]


@arrow_udf("struct<index:boolean,locs:array<string>>")
def _sitemap(body: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_locs(bytes(b) if b is not None else b"") for b in body], columns=["index", "locs"])


def sitemap_urls(files: DataFrame, roots: DataFrame, max_urls: int = 5000, max_sitemaps: int = 50) -> DataFrame:
    """URLs of the site maps at ``roots`` (url), following indexes, from a table of files (url, body); gzip is unpacked."""
    read = stored(files.select("url", _sitemap(F.col("body").cast("binary")).alias("s")).select("url", "s.*"), "sitemaps")
    todo, seen = roots.select("url").distinct(), roots.select("url").limit(0)
    got, used = roots.select("url").limit(0), 0
    while used < max_sitemaps:
        todo = stored(todo.join(seen, "url", "left_anti").orderBy("url").limit(max_sitemaps - used), "sitemaps")
        n = todo.count()
        if not n:
            break
        used += n
        seen = seen.unionByName(todo)
        hit = read.join(todo, "url", "left_semi")
        got = got.unionByName(hit.where(~F.col("index")).select(F.explode("locs").alias("url")))
        todo = hit.where("index").select(F.explode("locs").alias("url")).distinct()
    return got.distinct().orderBy("url").limit(max_urls)


def robots_gate(requests: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """``requests`` with ``allowed`` and ``crawl_delay`` by the robots table (origin, body); none means allowed."""
    keyed = requests.withColumn("_origin", urls.origin(F.col("url")))
    joined = keyed.join(robots.select(F.col("origin").alias("_origin"), F.col("body").alias("_body")), "_origin", "left")
    checked = joined.withColumn("_r", policy.robots_check(F.col("url"), F.col("_body"), F.lit(agent)))
    return checked.withColumn("allowed", F.col("_r.allowed")).withColumn("crawl_delay", F.col("_r.delay")).select(*requests.columns, "allowed", "crawl_delay")


def crawl_levels(pages: DataFrame, seeds: DataFrame, max_depth: int, on_level: Callable[[int, DataFrame], None], **options) -> DataFrame:
    """A crawl whose levels (number, url, depth, parent_url) are handed on while it runs; errors of ``on_level`` are logged and
    don't stop it.  Returns the queue."""

    def handed(number: int, level: DataFrame) -> None:
        try:
            on_level(number, level)
        except Exception:
            _log.exception("level %d", number)

    return crawl(pages, seeds, max_depth, on_level=handed, **options)
