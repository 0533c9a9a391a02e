"""Streams: pages shaped as files arrive, and watches that keep each URL's last state and report changes."""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from weftline.functions import urls
from weftline.operators import runs

FIELDS = "array<struct<field:string,before:string,after:string>>"
CHANGES = f"url string, at double, run_id string, first boolean, changed boolean, not_modified boolean, before_hash string, after_hash string, field_changes {FIELDS}"
_STATE = "hash string, run_id string, at double, data string"
_log = logging.getLogger(__name__)


def page_stream(spark: SparkSession, path: str, schema: str, files: int = 16) -> DataFrame:
    """New Parquet files of pages, ``files`` a trigger at most: the stream's back-pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def _object(data: str | None) -> dict:
    try:
        got = json.loads(data or "{}")
    except ValueError:
        return {}
    return got if isinstance(got, dict) else {}


def field_changes(before: str | None, after: str | None) -> list[dict]:
    """Fields whose values differ between two JSON objects, sorted; missing and null are alike, and other values than strings
    are JSON."""
    x, y = _object(before), _object(after)
    cell = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, sort_keys=True)
    return [{"field": k, "before": cell(x.get(k)), "after": cell(y.get(k))} for k in sorted({*x, *y}) if x.get(k) != y.get(k)]


def _track(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(batches)).sort_values(["at", "run_id"])
    last = state.get if state.exists else None
    out = []
    for r in rows.itertuples(index=False):
        kept = last is not None and bool(r.not_modified)
        hash_, data = (last[0], last[3]) if kept else (r.hash, r.data)
        fields = [] if last is None or kept else field_changes(last[3], data)
        out.append((key[0], r.at, r.run_id, last is None, last is not None and (hash_ != last[0] or bool(fields)), bool(r.not_modified), None if last is None else last[0], hash_, fields))
        last = (hash_, r.run_id, float(r.at), data)
    state.update(last)
    yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])


def changes(pages: DataFrame) -> DataFrame:
    """Change feed of a stream of (url, html, at, run_id, not_modified, and ``data``, the extracted JSON, where there): state
    per URL is a hash, a run and the data.

    The first sight of a URL is no change, nor is an answer "not modified"; otherwise a new body or a field that differs is
    one.  Rows of one trigger are taken in order of ``at``.
    """
    data = F.col("data").cast("string") if "data" in pages.columns else F.lit(None).cast("string")
    keyed = pages.select(F.col("url"), F.sha2(F.coalesce("html", F.lit("")), 256).alias("hash"), F.col("at").cast("double").alias("at"), "run_id", F.coalesce("not_modified", F.lit(False)).alias("not_modified"), data.alias("data"))
    return keyed.groupBy("url").applyInPandasWithState(_track, CHANGES, _STATE, "append", GroupStateTimeout.NoTimeout)


def batch_changes(pages: DataFrame) -> DataFrame:
    """The same feed over a table, by ``lag``."""
    from pyspark.sql import Window

    w = Window.partitionBy("url").orderBy("at", "run_id")
    h = F.sha2(F.coalesce("html", F.lit("")), 256)
    data = F.from_json(F.col("data").cast("string"), "map<string,string>") if "data" in pages.columns else F.lit(None).cast("map<string,string>")
    p = pages.withColumn("after_hash", h).withColumn("before_hash", F.lag("after_hash").over(w)).withColumn("_y", F.coalesce(data, F.create_map().cast("map<string,string>"))).withColumn("_x", F.lag("_y").over(w))
    every = F.array_sort(F.array_union(F.map_keys("_x"), F.map_keys("_y")))
    pairs = F.transform(every, lambda k: F.struct(k.alias("field"), F.try_element_at("_x", k).alias("before"), F.try_element_at("_y", k).alias("after")))
    p = p.withColumn("field_changes", F.coalesce(F.filter(pairs, lambda x: ~x["before"].eqNullSafe(x["after"])), F.array().cast(FIELDS)))
    changed = F.coalesce((F.col("before_hash") != F.col("after_hash")) | (F.size("field_changes") > 0), F.lit(False))
    return p.select("url", F.col("at").cast("double").alias("at"), "run_id", F.col("before_hash").isNull().alias("first"), changed.alias("changed"), "before_hash", "after_hash", "field_changes")


def on_change(feed: DataFrame, notify: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True, seconds: int = 60) -> StreamingQuery:
    """Hands each trigger's changed rows to ``notify``; its errors are logged and don't stop the stream."""

    def run(batch: DataFrame, n: int) -> None:
        try:
            notify(batch.where("changed"), n)
        except Exception:
            _log.exception("notify of batch %d", n)

    w = feed.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=f"{seconds} seconds")).start()


def tick(watches: DataFrame, check: Callable[[DataFrame], DataFrame], now: float, notify: Callable[[DataFrame], None] | None = None) -> tuple[DataFrame, DataFrame]:
    """One scheduler round: due watches are checked, cursors moved, changes notified; returns (watches, outcomes).

    ``check`` maps due watches to (id, run_id, changed, error); a failed check moves the cursor too.
    """
    due = runs.watch_due(watches, F.lit(now))
    outcome = check(due).withColumn("at", F.lit(now))
    moved = runs.watch_state(watches, outcome)
    if notify is not None:
        try:
            notify(outcome.where("changed"))
        except Exception:
            _log.exception("notify at %s", now)
    return moved, outcome


def dedup_stream(pages: DataFrame, watermark: str = "1 day") -> DataFrame:
    """First arrival of each normalised URL within the watermark of ``ts``."""
    return pages.withColumn("normalized_url", urls.normalize(F.col("url"))).withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["normalized_url"])
