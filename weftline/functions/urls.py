"""URL columns.  All are built-in expressions, so filters on them stay in code generation and reach the scan.

Malformed or null URLs give null parts; none of these raises.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TRACKING = "fbclid gclid mc_cid mc_eid ref utm_".split()
ASSETS = "7z atom avi bmp bz2 css doc docx eot flac gif gz ico jpeg jpg js json mjs mov mp3 mp4 ogg otf pdf png ppt pptx rar rss svg tar ttf wav webm webp woff woff2 xls xlsx xml zip".split()
_SPLIT = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _SPLIT, group)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    """Lower-cased ``user@host:port``."""
    return F.lower(_part(url, 2))


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def host(url: Column) -> Column:
    """Host without user, port or case; ``[v6]`` keeps its brackets."""
    return F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), r":\d*$", "")


def canonical_host(url: Column) -> Column:
    """Authority without a leading ``www.``; the port counts."""
    return F.regexp_replace(authority(url), r"^www\.", "")


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def normalize(url: Column) -> Column:
    """Without fragment, default port and tracking parameters; scheme and authority in lower case, query
    pieces sorted, an empty path as ``/``."""
    s = scheme(url)
    a = F.when(s == "http", F.regexp_replace(authority(url), ":80$", "")).when(s == "https", F.regexp_replace(authority(url), ":443$", "")).otherwise(authority(url))
    keep = F.array_sort(F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~F.lower(F.split(p, "=")[0]).rlike("^(" + "|".join(TRACKING) + ")")))
    joined = F.array_join(keep, "&")
    return F.concat(s, F.lit("://"), a, F.when(path(url) == "", "/").otherwise(path(url)), F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""))


def path_template(url: Column) -> Column:
    """First two path segments, lower-cased, identifiers as ``:id``."""
    segments = F.slice(F.filter(F.split(path(url), "/"), lambda x: x != ""), 1, 2)
    ident = r"^([0-9]+|[0-9A-Fa-f]{8,}|.*[0-9].*-.*|[^/]{40,})$"
    return F.array_join(F.transform(segments, lambda x: F.when(x.rlike(ident), ":id").otherwise(F.lower(x))), "/")


def is_asset(url: Column) -> Column:
    return F.lower(path(url)).rlike(r"\.(" + "|".join(ASSETS) + ")$")


def source_rewrite(url: Column) -> Column:
    """Wiki article pages, by path or by ``index.php?title=``, as their REST endpoint; other URLs null.  Mobile
    hosts collapse, special and media namespaces are left alone."""
    h = F.regexp_replace(host(url), r"\.m\.", ".")
    title = F.regexp_extract(path(url), "^/wiki/(.+)$", 1)
    asked = F.regexp_extract(query(url), "(?:^|&)title=([^&]*)", 1)
    by_query = path(url) == "/w/index.php"
    plain = F.when(by_query, F.try_url_decode(asked)).otherwise(F.try_url_decode(F.regexp_replace(title, r"\+", "%2B")))
    quoted = F.regexp_replace(F.url_encode(plain), r"\+", "%20")
    ok = h.rlike(r"^[a-z\-]+\.(wikipedia|wiktionary|wikiquote|wikibooks|wikisource|wikinews|wikivoyage|wikiversity)\.org$") & (plain != "") & ~plain.rlike("(?i)^(special|media):")
    return F.when(ok, F.concat(F.lit("https://"), h, F.lit("/api/rest_v1/page/html/"), quoted))


def input_target(text: Column) -> Column:
    """``https://`` put before a bare host; other schemes than http(s) and blanks give null."""
    t = F.trim(text)
    return F.when(t.rlike("(?i)^https?://"), t).when((t == "") | t.rlike(r"(?i)^[a-z][a-z0-9+.\-]*:(?!\d)"), None).otherwise(F.concat(F.lit("https://"), t))
