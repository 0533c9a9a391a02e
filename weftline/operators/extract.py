"""Typed extraction: a ladder of metadata, learned selectors and a model hook, each over what the rung before left.

The free rungs are one function that parses a page once and stops at the first that succeeds.  Its result is stored, then the
model is asked once for each row left, as far as the budget goes, and that is stored too: a paid call is never made twice,
whatever reads the result.  Selectors that an answer brings along are verified against the page and come back as
``learned``; ``rule_events`` turns them, and the successes and failures of known rules, into events of the rule log.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import schemas
from weftline.functions import metadata, urls
from weftline.functions.htmltree import Node, parse, select_all, select_first
from weftline.functions.lazy import by_row
from weftline.sources.state import stored

RESULT = "struct<data:string,method:string,source:string,fields:map<string,string>,learned:map<string,string>,tried:boolean>"
PROMPT_CHARS = 24_000


class PinError(ValueError):
    """The model at hand isn't the one that is pinned, or none is pinned where one must be."""


def require_pin(pin: str | None, provider: str, model_id: str, prompt_hash: str, strict: bool = False) -> None:
    """``pin`` is ``provider/model@hash``; provider and model compare without case, the hash as it is."""
    if pin is None:
        if strict:
            raise PinError("a pin provider/model@hash is required")
        return
    name, _, digest = pin.partition("@")
    if name.casefold() != f"{provider}/{model_id}".casefold() or digest != prompt_hash:
        raise PinError(f"{provider}/{model_id}@{prompt_hash} is not the pinned {pin}")



def _root(html: str | Node) -> Node:
    return parse(html) if isinstance(html, str) else html


def _validated(model: type, values: dict) -> str | None:
    try:
        return model.model_validate(values).model_dump_json()
    except ValueError:
        return None


def from_metadata(html: str | Node | None, model: type) -> dict | None:
    """The record from embedded metadata alone, if all required fields are there and it validates."""
    if not html:
        return None
    objects, flat, source, origins = metadata.collect(_root(html))
    if source is None:
        return None
    lists = schemas.list_fields(model)
    got, fields = {}, {}
    for name in model.model_fields:
        if name in lists:
            raw = metadata.listed(name, objects)
            value = metadata.rows(raw, list(lists[name].model_fields) if lists[name] else None) if raw else None
            origin = "json-ld"
        else:
            value = metadata.scalar(name, flat)
            origin = next((origins[k] for k in metadata.names(name) if k in origins), source)
        if value is not None and value != []:
            got[name], fields[name] = value, origin
    if not got or not set(schemas.required_fields(model)) <= set(got):
        return None
    data = _validated(model, got)
    return None if data is None else {"data": data, "method": "metadata", "source": source, "fields": fields}


def from_selectors(html: str | Node | None, model: type, rules: dict[str, str]) -> dict | None:
    """The record from a selector per field; a list field's selector is ``container | {"field": "selector"}``."""
    if not html or not rules:
        return None
    from weftline.functions.shaping import list_rows

    root, got = _root(html), {}
    for name in model.model_fields:
        css = rules.get(name)
        if not css:
            continue
        if " | {" in css:
            box, _, sub = css.partition(" | ")
            if rows := list_rows(root, box, json.loads(sub)):
                got[name] = rows
        elif (node := select_first(root, css)) is not None:
            value = (node.attrs.get("content") or "").strip() or re.sub(r"\s+", " ", node.text()).strip()
            if value:
                got[name] = value
    if not set(schemas.required_fields(model)) <= set(got):
        return None
    data = _validated(model, got)
    return None if data is None else {"data": data, "method": "selector", "source": "selector", "fields": {k: rules[k] for k in got}}


def _payload(text: str) -> dict | None:
    """The first JSON object of a model's answer: fences and talk around it don't matter."""
    at = text.find("{")
    while at >= 0:
        try:
            got, _ = json.JSONDecoder().raw_decode(text, at)
        except ValueError:
            at = text.find("{", at + 1)
            continue
        return got if isinstance(got, dict) else None
    return None


def _selector_block(text: str) -> dict[str, str]:
    """Rules out of an answer's ``SELECTORS: {...}``: a selector a field, or ``{"__list__": container, field: selector}``."""
    _, mark, rest = text.partition("SELECTORS:")
    out = {}
    for name, spec in ((_payload(rest) or {}) if mark else {}).items():
        if isinstance(spec, str) and spec.strip():
            out[name] = spec.strip()
        elif isinstance(spec, dict):
            box = next((spec[k] for k in ("__list__", "list", "container") if isinstance(spec.get(k), str) and spec[k].strip()), None)
            sub = {k: v.strip() for k, v in spec.items() if k not in ("__list__", "list", "container") and isinstance(v, str) and v.strip()}
            if box and sub:
                out[name] = f"{box.strip()} | {json.dumps(sub, sort_keys=True)}"
    return out


def verified(html: str | Node | None, rules: dict[str, str], values: dict) -> dict[str, str]:
    """The rules that find, on the page, what the answer says: the same text, in whole or in part, for strings, any
    element for other values, and an element with one of its fields for lists."""
    if not html or not rules:
        return {}
    root, good = _root(html), {}
    for name, css in rules.items():
        if " | {" in css:
            box, _, sub = css.partition(" | ")
            found = select_all(root, box)
            if found and any(select_first(found[0], x) is not None for x in json.loads(sub).values()):
                good[name] = css
        elif (node := select_first(root, css)) is not None and (value := values.get(name)) is not None:
            text = re.sub(r"\s+", " ", node.text()).strip().casefold()
            if not isinstance(value, str) or (want := value.strip().casefold()) and (want in text or text in want):
                good[name] = css
    return good


def mock_model(prompt: str, model: type) -> str:
    """A deterministic stand-in for a language model: fields are filled from lines ``name: value`` and the first heading."""
    out = {}
    heading = re.search(r"^#+ (.+)$", prompt, re.M)
    for name in model.model_fields:
        hit = re.search(rf"^\W*{re.escape(name)}\W*[:=]\s*(.+)$", prompt, re.I | re.M)
        if hit:
            out[name] = hit[1].strip()
        elif heading and metadata.norm(name) in ("title", "name", "headline"):
            out[name] = heading[1].strip()
    return json.dumps(out)


def from_model(markdown: str | None, model: type, answer: Callable[[str, type], str], html: str | None = None, chars: int = PROMPT_CHARS) -> dict | None:
    """The record from a model's answer over at most ``chars`` characters; one that doesn't validate is handed on raw.
    Selectors in the answer that hold on the page are in ``learned``."""
    text = answer((markdown or "")[:chars], model)
    got = _payload(text.partition("SELECTORS:")[0])
    if got is None:
        return None
    data = _validated(model, got)
    learned = verified(html, _selector_block(text), got) if data else {}
    return {"data": data or json.dumps(got), "method": "llm", "source": "llm" if data else "llm-unvalidated", "fields": dict.fromkeys(map(str, got), "llm"), "learned": learned}


_FIELDS = ["data", "method", "source", "fields", "learned", "tried"]


def _rung(fn: Callable):
    def one(*args) -> dict:
        try:
            r = fn(*args)
        except Exception:  # one page never fails the batch
            r = None
        r = dict.fromkeys(_FIELDS) | (r or {})
        return r | {k: list(r[k].items()) for k in ("fields", "learned") if r[k] is not None}

    return by_row(one, RESULT)


def from_page(html: str | None, model: type, rules: dict[str, str]) -> dict:
    """Metadata, then selectors, of a page parsed once; ``tried`` tells whether there were selectors to try."""
    if not html:
        return {}
    root = parse(html)
    if (got := from_metadata(root, model)) is not None:
        return got
    return (from_selectors(root, model, rules) or {}) | {"tried": bool(rules)}


def with_rules(pages: DataFrame, model: type, rules: DataFrame | None) -> DataFrame:
    """``pages`` with ``_rules``, the map field -> selector of their host and path template."""
    if rules is None:
        return pages.withColumn("_rules", F.expr("CAST(NULL AS map<string,string>)"))
    mine = rules.where(F.col("schema_hash") == schemas.schema_hash(model))
    per = mine.groupBy("host", "path_template").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("field_name", "selector")))).alias("_rules"))
    keyed = pages.withColumn("_h", urls.host(F.col("url"))).withColumn("_p", urls.path_template(F.col("url")))
    # rules are few beside pages; the planner broadcasts them if their measured size allows
    return keyed.join(per, (keyed["_h"] == per["host"]) & (keyed["_p"] == per["path_template"]), "left").select(*[keyed[c] for c in pages.columns], "_rules")


def extract(
    pages: DataFrame, model: type, rules: DataFrame | None = None, answer: Callable[[str, type], str] | None = None, max_calls: int | None = None, max_cost: float | None = None, call_cost: float = 0.0,
    pin: str | None = None, provider: str = "", model_id: str = "", prompt_hash: str = "", strict_pin: bool = False, chars: int = PROMPT_CHARS,
) -> DataFrame:
    """``pages`` (url, html, and ``markdown`` for the model rung) with ``extraction``; its method is null where no rung succeeded.

    ``max_calls`` model calls are made at most, and no more once ``max_cost`` is spent at ``call_cost`` a call: for the rows
    first by URL.  A pin that doesn't fit raises ``PinError`` before anything runs.
    """
    require_pin(pin, provider, model_id, prompt_hash, strict_pin)
    cols = pages.columns
    free = with_rules(pages, model, rules).withColumn("extraction", _rung(lambda html, r: from_page(html, model, dict(r or {})))(F.col("html"), F.col("_rules"))).select(*cols, "extraction")
    if answer is None:
        return free
    free = stored(free, "extraction")
    rest = free.where("extraction.data IS NULL")
    if max_cost is not None and call_cost > 0:
        max_calls = min(math.ceil(max_cost / call_cost - 1e-9), math.inf if max_calls is None else max_calls)
    ask = F.lit(True)
    if max_calls is not None:
        # rows that repeat a URL are told apart by their number in the stored table
        rest = rest.withColumn("_no", F.monotonically_increasing_id())
        first = rest.select("url", "_no").orderBy("url", "_no").limit(int(max_calls)).select("_no", F.lit(True).alias("_ask"))
        rest, ask = rest.join(first, "_no", "left"), F.col("_ask")
    reply = _rung(lambda md, html: from_model(md, model, answer, html, chars))
    # rows beyond the budget never reach the model's function
    third = rest.where(ask).withColumn("_got", reply(F.col("markdown"), F.col("html")))
    merged = F.when(F.col("_got.data").isNotNull(), F.col("_got").withField("tried", F.col("extraction.tried"))).otherwise(F.col("extraction"))
    asked = stored(third.select(*cols, merged.alias("extraction")), "answers")
    out = free.where("extraction.data IS NOT NULL").unionByName(asked)
    return out if max_calls is None else out.unionByName(rest.where("_ask IS NULL").select(*cols, "extraction"))


def rule_events(extractions: DataFrame, model: type, at: float) -> DataFrame:
    """Events for ``runs.selector_rules`` out of extractions: ``learn`` of verified selectors, ``success`` and ``fail`` of the
    rules that were tried."""
    base = extractions.select(urls.host(F.col("url")).alias("host"), urls.path_template(F.col("url")).alias("path_template"), F.lit(schemas.schema_hash(model)).alias("schema_hash"), "extraction")
    key = ["host", "path_template", "schema_hash"]
    learn = base.select(*key, F.explode("extraction.learned").alias("field_name", "selector"), F.lit("learn").alias("event"))
    used = base.where("extraction.method = 'selector'").select(*key, F.explode("extraction.fields").alias("field_name", "selector"), F.lit("success").alias("event"))
    missed = base.where("extraction.tried AND coalesce(extraction.method, '') <> 'selector'").select(*key, F.explode(F.array(*[F.lit(n) for n in model.model_fields])).alias("field_name"), F.lit(None).cast("string").alias("selector"), F.lit("fail").alias("event"))
    # a run fails a rule, or lets it pass, once, however many pages share its template
    return learn.unionByName(used).unionByName(missed).groupBy(*key, "field_name", "event").agg(F.min("selector").alias("selector")).withColumn("at", F.lit(at))


def typed(extractions: DataFrame, model: type) -> DataFrame:
    """``extraction.data`` as a struct of the model's type."""
    return extractions.withColumn("record", F.from_json("extraction.data", schemas.struct_type(model)))


def model_cost(rows: DataFrame, prices: DataFrame, fallback: tuple = (0.0, 0.0)) -> DataFrame:
    """USD of (model_id, input_tokens, output_tokens) by a price table per million tokens, with a fallback.

    The price list, a row a model, is broadcast: few models are called, so a shuffle by model would send all rows to as few tasks.
    """
    p = F.broadcast(prices.select("model_id", "input_usd", "output_usd"))
    j = rows.join(p, "model_id", "left")
    return j.withColumn("cost_usd", (F.col("input_tokens") * F.coalesce("input_usd", F.lit(fallback[0])) + F.col("output_tokens") * F.coalesce("output_usd", F.lit(fallback[1]))) / 1e6).drop("input_usd", "output_usd")
