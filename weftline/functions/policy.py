"""Policy columns: personal data, addresses that must not be fetched, regions and robots rules."""

from __future__ import annotations

import contextlib
import functools
import ipaddress
import re
from collections.abc import Iterator
from urllib import robotparser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import urls
from weftline.functions.lazy import arrow_udf

# --- personal data.  Kinds overlap freely in a scan; redaction merges what overlaps.

_L, _S = "a-z0-9_%+", "[ .-]"
PII = {
    "email": f"(?i)(?<![{_L}.-])[{_L}-]+(?:[.][{_L}-]+)*@(?:[a-z0-9-]+[.])+[a-z]{{2,}}",
    "phone": rf"[+]?\d{{0,3}}{_S}?(?:[(]\d{{1,4}}[)]{_S}?)?\d{{2,4}}(?:{_S}\d{{2,4}}){{1,4}}",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "credit_card": r"\b(?:[0-9][ -]*?){13,19}\b",
    "ipv4": r"\b(?:[0-9]{1,3}[.]){3}[0-9]{1,3}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}\b",
    "passport": r"\b[A-Z]{1,2}[0-9]{6,9}\b",
}
REDACTED = "[REDACTED]"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """Luhn check over 13 to 19 digits, separators ignored."""
    d = _digits(v)
    return F.char_length(d).between(13, 19) & F.coalesce(F.call_function("luhn_check", d), F.lit(False))


def pii_values(text: Column, kind: str) -> Column:
    """Values of one kind in the text, in order."""
    found = F.regexp_extract_all(text, F.lit(PII[kind]), F.lit(0))
    if kind == "phone":
        return F.filter(found, lambda v: F.char_length(_digits(v)).between(7, 15))
    return F.filter(found, luhn) if kind == "credit_card" else found


def pii_summary(text: Column) -> Column:
    """struct<kinds: sorted kinds that occur, n_hits>.  Each pattern runs once, and only on texts that hold what it needs."""
    digits = text.rlike("[0-9]{2}") | text.rlike("[0-9][^0-9]{1,8}[0-9]")
    held = {k: F.contains(text, F.lit("@")) if k == "email" else digits for k in PII}
    counts = F.struct(*[F.when(held[k], F.size(pii_values(text, k))).otherwise(0).alias(k) for k in PII])

    def summary(n: Column) -> Column:
        kinds = F.array_sort(F.filter(F.array(*[F.when(n[k] > 0, F.lit(k)) for k in PII]), lambda k: k.isNotNull()))
        return F.struct(kinds.alias("kinds"), functools.reduce(lambda a, b: a + b, [n[k] for k in PII]).alias("n_hits"))

    # a lambda's variable is computed once, whatever reads it
    return F.transform(F.array(counts), summary)[0]


def pii_kinds(text: Column) -> Column:
    """Sorted kinds that occur."""
    return pii_summary(text)["kinds"]


def pii_count(text: Column) -> Column:
    return pii_summary(text)["n_hits"]


_COMPILED = {k: re.compile(p, re.A if k != "email" else 0) for k, p in PII.items()}


def _luhn(value: str) -> bool:
    digits = list(map(int, re.findall("[0-9]", value)))
    if len(digits) not in range(13, 20):
        return False
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits))) % 10 == 0


def scan_pii(text: str) -> list[tuple[str, str, int, int]]:
    """(kind, value, start, end) by kind, then place; offsets count characters."""
    hits = []
    for kind, pattern in _COMPILED.items():
        for m in pattern.finditer(text):
            v = m.group(0)
            if kind == "phone" and not 7 <= sum(c.isdigit() for c in v) <= 15 or kind == "credit_card" and not _luhn(v):
                continue
            hits.append((kind, v, m.start(), m.end()))
    return hits


def redact_text(text: str, mask: str = REDACTED) -> str:
    out, at = [], 0
    for start, end in sorted((s, e) for _, _, s, e in scan_pii(text)):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


@arrow_udf("array<struct<kind:string,value:string,start:int,end:int>>")
def pii_hits(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [{"kind": k, "value": v, "start": s, "end": e} for k, v, s, e in scan_pii(t or "")])


@arrow_udf("string")
def redact(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else redact_text(t))


# --- addresses

_NAMES = ("ip6-localhost", "ip6-loopback", "localhost", "localhost.localdomain")
_SUFFIX = r"\.(home\.arpa|internal|intranet|lan|local|localhost)$"


def _address(host: str):
    with contextlib.suppress(ValueError):
        return ipaddress.ip_address(host)
    parts = re.split("[.]", host)
    if not 1 <= len(parts) <= 4:
        return None
    numbers = []
    for p in parts:
        if not re.fullmatch(r"0[xX][0-9a-fA-F]*|[0-9]+", p):
            return None
        try:
            numbers.append(int(p[2:] or "0", 16) if p[:2].lower() == "0x" else int(p, 8) if len(p) > 1 and p[0] == "0" else int(p))
        except ValueError:
            return None
    *heads, last = numbers
    if any(n > 255 for n in heads) or last >= 256 ** (4 - len(heads)):
        return None
    value = last
    for k, n in enumerate(heads):
        value += n << (8 * (3 - k))
    return ipaddress.ip_address(value)


def blocked_address(host: str) -> bool:
    """Whether the host is an address literal, also a disguised one, of a network that isn't public."""
    ip = _address(host.strip("[]").split("%")[0])
    if ip is None:
        return False
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return any(getattr(ip, f"is_{kind}") for kind in "link_local loopback multicast private reserved unspecified".split())


@arrow_udf("boolean")
def _is_blocked_address(host: pd.Series) -> pd.Series:
    return host.map(lambda h: blocked_address(h or ""))


def public_name(url: Column) -> Column:
    """The built-in part of the fetch guard: http(s), a host, and no local name.  Reaches the scan as a filter."""
    h = F.regexp_replace(F.trim(urls.host(url)), r"\.+$", "")
    return urls.scheme(url).isin("http", "https") & (h != "") & ~h.isin(*_NAMES) & ~h.rlike(_SUFFIX)


def fetchable(url: Column, allow_private: bool = False) -> Column:
    """Whether a URL may be fetched.  Only hosts that look like an address reach Python."""
    h = F.regexp_replace(F.trim(urls.host(url)), r"\.+$", "")
    if allow_private:
        return F.coalesce(urls.scheme(url).isin("http", "https") & (h != ""), F.lit(False))
    return F.coalesce(public_name(url), F.lit(False)) & ~_is_blocked_address(h)


# --- regions

EU = "AT BE BG CY CZ DE DK EE ES FI FR GR HR HU IE IT LT LU LV MT NL PL PT RO SE SI SK".split()


def region_allowed(region: Column, allowed: list[str] | None = None, denied: list[str] | None = None, require: bool = False) -> Column:
    """Deny first, then allow; an unknown region passes unless ``require``."""
    r = F.upper(region)
    out = F.when(r.isNull() | (r == ""), F.lit(not require))
    if denied:
        out = out.when(r.isin([x.upper() for x in denied]), False)
    if allowed is not None:
        return out.otherwise(r.isin([x.upper() for x in allowed]) if allowed else F.lit(False))
    return out.otherwise(True)


# --- robots


def robots_rules(body: str | None, content_type: str | None = None) -> robotparser.RobotFileParser:
    """Parsed rules; a missing body, or one that is HTML, allows all."""
    parser = robotparser.RobotFileParser()
    text = body or ""
    if "html" in (content_type or "").lower() or text.lstrip()[:1] == "<":
        text = ""
    parser.parse(text.splitlines())
    return parser


@arrow_udf("struct<allowed:boolean,delay:double>")
def robots_check(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """(allowed, crawl delay) of (url, robots body, user agent); rules are parsed once a batch and body."""
    for url, body, agent in batches:
        rules = {b: robots_rules(b) for b in set(body)}
        rows = []
        for u, b, a in zip(url, body, agent):
            d = rules[b].crawl_delay(a)
            rows.append((rules[b].can_fetch(a, u or ""), None if d is None else float(d)))
        yield pd.DataFrame(rows, columns=["allowed", "delay"])
