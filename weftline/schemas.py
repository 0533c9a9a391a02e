"""Schemas of the state tables, and user record types compiled to Spark types."""

from __future__ import annotations

import hashlib
import json
import types
from typing import Any, Union, get_args, get_origin

from pyspark.sql import types as T

PAGES = "url string, final_url string, status int, html string, headers map<string,string>, tier_used int, raw_content binary, fetched_at double, proxy_region string"
RUNS = (
    "run_id string, url string, started_at double, finished_at double, tier_used int, proxy_region string, fetch_status int, extraction_method string, "
    "model_pinned string, schema_version string, cost_usd double, llm_calls int, error string, html_path string, headers_json string, extraction_json string, "
    "screenshot_path string, etag string, last_modified string, not_modified boolean"
)
QUEUE = "id bigint, crawl_id string, url string, depth int, parent_url string, metadata string, status string, attempts int, enqueued_at double, claimed_at double, finished_at double, error string"
SELECTORS = "host string, path_template string, schema_hash string, field_name string, selector string, selector_type string, extra string, success_count int, failure_count int, updated_at double"
WATCHES = "id string, url string, interval_seconds double, webhook_url string, label string, enabled boolean, last_run_id string, last_checked_at double, last_changed_at double, created_at double"

_SCALARS = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType()}


def _bare(annotation: Any) -> tuple[Any, bool]:
    """The annotation without None, and whether None was allowed."""
    if get_origin(annotation) in (Union, types.UnionType):
        rest = [a for a in get_args(annotation) if a is not type(None)]
        if len(rest) == 1:
            return rest[0], True
    return annotation, False


def spark_type(annotation: Any) -> T.DataType:
    kind, _ = _bare(annotation)
    if kind in _SCALARS:
        return _SCALARS[kind]
    if get_origin(kind) in (list, set, tuple, frozenset):
        return T.ArrayType(spark_type((get_args(kind) or (str,))[0]))
    if get_origin(kind) is dict:
        return T.MapType(T.StringType(), spark_type((get_args(kind) or (str, str))[1]))
    if hasattr(kind, "model_fields"):
        return struct_type(kind)
    return T.StringType()


def struct_type(model: type) -> T.StructType:
    """A record class (pydantic) as a struct; optional and defaulted fields are nullable."""
    return T.StructType([T.StructField(n, spark_type(f.annotation), not f.is_required() or _bare(f.annotation)[1]) for n, f in model.model_fields.items()])


def schema_hash(model: type) -> str:
    """Sixteen hexadecimal digits of the canonical JSON schema's SHA-256."""
    return hashlib.sha256(json.dumps(model.model_json_schema(), separators=(",", ":"), sort_keys=True).encode()).hexdigest()[:16]


def required_fields(model: type) -> list[str]:
    return list(model.model_json_schema().get("required", []))


def list_fields(model: type) -> dict[str, type | None]:
    """Fields that are lists, with their item record or None for scalars; an optional list is one too."""
    out = {}
    for name, f in model.model_fields.items():
        kind, _ = _bare(f.annotation)
        if get_origin(kind) in (list, set, tuple, frozenset):
            item = (get_args(kind) or (None,))[0]
            out[name] = item if hasattr(item, "model_fields") else None
    return out
