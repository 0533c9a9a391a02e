"""Page signals: block pages, thin pages, script shells and the tier decision, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_SIGNS = (
    ("cloudflare", "__cf_chl_|cf-browser-verification|cf-chl-bypass"),
    ("akamai", "akamai.*reference|ak-bm-"),
    ("perimeterx", "perimeterx|_pxhd|px-captcha"),
    ("datadome", "datadome"),
    ("distil", "distil.*captcha|distil_r"),
    ("js-required", "please enable javascript"),
    ("generic-block", "access denied|you have been blocked|blocked by"),
    ("captcha", "hcaptcha|recaptcha"),
    ("human-check", "are you a human|prove you are not a robot"),
)
SOURCE_SIGNS = (
    ("cloudflare", r"challenges\.cloudflare\.com"),
    ("captcha", r"hcaptcha\.com/captcha|js\.hcaptcha\.com"),
    ("captcha", r"recaptcha\.net|www\.google\.com/recaptcha"),
    ("captcha", "arkoselabs|funcaptcha"),
    ("datadome", r"geo\.captcha-delivery\.com|datadome"),
    ("perimeterx", r"captcha\.px-cdn|px-captcha|perimeterx"),
)
SCAN = 8192
_ROOT_IDS = ("___gatsby", "__next", "__nuxt", "app", "q-app", "root", "svelte")
_ROOT_MARKS = ("/@vite/", "<astro-", "__remixcontext", "__remixmanifest", "astro-island", "data-qwik", "data-reactroot", "ng-app", "q:container")
SHELL_ROOT = "(?i)id=[\"'](" + "|".join(_ROOT_IDS) + ")[\"']|" + "|".join(_ROOT_MARKS) + "|<script[^>]+type=[\"']module[\"'][^>]*\\ssrc="
TIERS = ("http", "impersonate", "browser", "browser_proxy", "agent")


def visible_text(html: Column) -> Column:
    """Text with scripts, styles and tags blanked; entities stay as they are."""
    bare = F.regexp_replace(html, r"(?is)<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"[ \t\n\r\f]+", " "))


def visible_length(html: Column) -> Column:
    return F.char_length(visible_text(html))


def is_thin(html: Column, least: int = 120) -> Column:
    return visible_length(html) < least


def is_shell(html: Column, least_html: int = 700, least_text: int = 220) -> Column:
    """A page of scripts with hardly any text: three scripts or a framework's root."""
    scripts = F.regexp_count(html, F.lit(r"(?i)<script[\s>]"))
    return (F.char_length(html) >= least_html) & (visible_length(html) < least_text) & ((scripts >= 3) | html.rlike(SHELL_ROOT))


def block_reason(html: Column, status: Column, has_body: Column | None = None) -> Column:
    """First sign that the page is a block page, or null; statuses first, then text, then script sources."""
    head = F.lower(F.substring(html, 1, SCAN))
    out = F.when(status.isin(401, 403, 407, 429, 503), F.concat(F.lit("http-"), status.cast("string")))
    out = out.when(~(F.lit(True) if has_body is None else has_body), None)
    out = out.when(F.coalesce(F.trim(head), F.lit("")) == "", "empty-body")
    for name, pattern in (*TEXT_SIGNS, *SOURCE_SIGNS):
        out = out.when(head.rlike(pattern), name)
    return out


def should_escalate(html: Column, status: Column, tier: Column, not_modified: Column | None = None, binary: Column | None = None) -> Column:
    """Whether a dearer fetch tier is called for: blocked or an error status; else, unless the body is
    binary, a thin page, or a script shell fetched without a browser.  Unchanged pages never."""
    same = F.lit(False) if not_modified is None else F.coalesce(not_modified, F.lit(False))
    raw = F.lit(False) if binary is None else F.coalesce(binary, F.lit(False))
    bad = block_reason(html, status).isNotNull() | F.coalesce(status >= 400, F.lit(False))
    text = F.coalesce(html, F.lit(""))
    return F.when(same, False).when(bad, True).when(raw, False).otherwise(is_thin(text) | ((tier < 2) & is_shell(text)))


def escalation_path(start: Column, most: Column) -> Column:
    """The tiers to try, in order, from ``start`` to the budget's dearest; none if that is below the start."""
    return F.when(most < start, F.array().cast("array<int>")).otherwise(F.sequence(start.cast("int"), F.least(most, F.lit(len(TIERS) - 1)).cast("int")))


def tier_label(tier: Column) -> Column:
    out = F.when(tier == 0, TIERS[0])
    for i, name in enumerate(TIERS[1:], 1):
        out = out.when(tier == i, name)
    return out


def block_text(reason: Column) -> Column:
    """A sentence for a block reason."""
    return (
        F.when(reason.isNull(), None)
        .when(reason.startswith("http-"), F.concat(F.lit("The server answered with status "), F.substring(reason, 6, 9), F.lit(".")))
        .when(reason == "empty-body", "The page is empty.")
        .when(reason == "captcha", "The page asks for a captcha.")
        .when(reason == "js-required", "The page needs scripts.")
        .otherwise(F.concat(F.lit("The page is held back by "), reason, F.lit(".")))
    )


def hard_block(status: Column, reason: Column) -> Column:
    """Blocks that count against the address used: refusals and bot walls, not missing pages."""
    return F.coalesce(status.isin(401, 403, 407, 429), F.lit(False)) | F.coalesce(reason.isin("cloudflare", "akamai", "perimeterx", "datadome", "distil", "captcha", "human-check"), F.lit(False))
