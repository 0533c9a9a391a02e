"""Run history: latest views over append-only logs, as-of lookups, diffs and conditional fetches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.sources.state import stored


def _newest(key: str) -> Window:
    return Window.partitionBy(key).orderBy(F.desc("started_at"), F.desc("run_id"))


def current(runs: DataFrame) -> DataFrame:
    """One row per run_id of the append-only log: that started last (an upsert's result)."""
    w = Window.partitionBy("run_id").orderBy(F.desc("started_at"), F.desc_nulls_last("finished_at"))
    return runs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest(runs: DataFrame, n: int = 1) -> DataFrame:
    """The last ``n`` runs of each URL."""
    return runs.withColumn("_n", F.row_number().over(_newest("url"))).where(F.col("_n") <= n).drop("_n")


def listing(runs: DataFrame, n: int = 50, url: str | None = None) -> DataFrame:
    """The last ``n`` runs, newest first."""
    return (runs if url is None else runs.where(F.col("url") == url)).orderBy(F.desc("started_at"), "run_id").limit(n)


def with_previous(runs: DataFrame) -> DataFrame:
    """Each run with the struct ``previous`` of the run of its URL before."""
    w = Window.partitionBy("url").orderBy("started_at", "run_id")
    return runs.withColumn("previous", F.lag(F.struct(*runs.columns)).over(w))


def as_of(requests: DataFrame, runs: DataFrame, at: str = "at") -> DataFrame:
    """Each request (url, ``at``) with the struct ``run`` of the last run of its URL started no later.

    Requests and runs are merged by one window over the URL, so no pair of them is ever formed.
    """
    row = F.struct(*[F.col(c) for c in runs.columns])
    r = runs.select("url", F.col("started_at").alias("_at"), F.lit(0).alias("_kind"), row.alias("_run"), F.lit(None).cast(requests.select(F.struct("*").alias("q")).schema["q"].dataType).alias("_req"))
    q = requests.select("url", F.col(at).cast("double").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(r.schema["_run"].dataType).alias("_run"), F.struct("*").alias("_req"))
    w = Window.partitionBy("url").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return r.unionByName(q).withColumn("run", F.last("_run", ignorenulls=True).over(w)).where("_kind = 1").select("_req.*", "run")


def conditional(pages: DataFrame, runs: DataFrame) -> DataFrame:
    """``pages`` with the validators a conditional fetch may send: those of the URL's last run, if that had no
    error, used a plain tier, kept its body and has a validator at all."""
    last = latest(runs).select("url", "etag", "last_modified", "html_path", F.expr("error IS NULL AND tier_used IN (0, 1) AND html_path IS NOT NULL AND (etag IS NOT NULL OR last_modified IS NOT NULL)").alias("ok"))
    joined = pages.join(last.where("ok").drop("ok").withColumnRenamed("html_path", "prior_path"), "url", "left")
    return joined.withColumn("conditional", F.col("prior_path").isNotNull())


def changed_only(pages: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Pages whose (url, content hash) isn't archived: only these need shaping again."""
    mine = pages.withColumn("html_hash", F.sha2(F.coalesce("html", F.lit("")), 256))
    return mine.join(snapshots.select("url", "html_hash"), ["url", "html_hash"], "left_anti")


def fields(runs: DataFrame) -> DataFrame:
    """(run_id, url, field, value) of the data in ``extraction_json``; values as JSON text or plain strings."""
    data = F.coalesce(F.get_json_object("extraction_json", "$.data"), F.col("extraction_json"))
    return runs.select("run_id", "url", F.explode(F.from_json(data, "map<string,string>")).alias("field", "value"))


def field_diff(a: DataFrame, b: DataFrame, key: str = "url") -> DataFrame:
    """Fields that differ between two (key, field, value) tables; missing and null are alike."""
    x, y = a.select(key, "field", F.col("value").alias("before")), b.select(key, "field", F.col("value").alias("after"))
    return x.join(y, [key, "field"], "full_outer").where("NOT (before <=> after)")


def diff_latest(runs: DataFrame) -> DataFrame:
    """A row per URL with two runs or more: the last two compared.

    same_html compares the hashes of the unpacked bodies where ``html_hash`` is a column.
    """
    w = _newest("url")
    has_hash = "html_hash" in runs.columns
    keep = ["run_id", "url", "extraction_method", "model_pinned", "schema_version", "tier_used", "extraction_json", *(["html_hash"] if has_hash else [])]
    both = runs.select(*keep, F.row_number().over(w).alias("_n"), F.lead(F.struct(*keep)).over(w).alias("_a")).where("_n = 1 AND _a IS NOT NULL")
    pair = both.select(*keep, *[F.col(f"_a.{c}").alias(f"a_{c}") for c in keep if c != "url"])
    parse = lambda c: F.from_json(F.coalesce(F.get_json_object(c, "$.data"), F.col(c)), "map<string,string>")
    pair = pair.withColumn("_x", F.coalesce(parse("a_extraction_json"), F.create_map().cast("map<string,string>"))).withColumn("_y", F.coalesce(parse("extraction_json"), F.create_map().cast("map<string,string>")))
    every = F.array_sort(F.array_union(F.map_keys("_x"), F.map_keys("_y")))
    changes = F.filter(F.transform(every, lambda k: F.struct(k.alias("field"), F.try_element_at("_x", k).alias("before"), F.try_element_at("_y", k).alias("after"))), lambda d: ~d["before"].eqNullSafe(d["after"]))
    note = lambda c, text: F.when(~F.col(c).eqNullSafe(F.col(f"a_{c}")), F.lit(text))
    notes = F.filter(F.array(note("model_pinned", "model changed"), note("schema_version", "schema changed"), note("tier_used", "tier changed")), lambda n: n.isNotNull())
    return pair.select(
        F.col("a_run_id").alias("run_a"), F.col("run_id").alias("run_b"), "url",
        (F.col("html_hash").eqNullSafe(F.col("a_html_hash")) if has_hash else F.lit(None).cast("boolean")).alias("same_html"),
        F.col("extraction_method").eqNullSafe(F.col("a_extraction_method")).alias("same_method"), changes.alias("field_changes"), notes.alias("notes"),
    )


def diff_text(diff: DataFrame) -> DataFrame:
    """``diff`` with a readable ``summary``."""
    line = F.transform("field_changes", lambda d: F.concat(F.lit("~ "), d["field"], F.lit(": "), F.coalesce(d["before"], F.lit("null")), F.lit(" -> "), F.coalesce(d["after"], F.lit("null"))))
    head = F.concat(F.lit("runs "), F.col("run_a"), F.lit(" -> "), F.col("run_b"))
    return diff.withColumn("summary", F.array_join(F.concat(F.array(head), F.transform("notes", lambda n: F.concat(F.lit("! "), n)), line), "\n"))


def merged_headers(prior: Column, fresh: Column) -> Column:
    """Headers of an unchanged page: the archived ones, the fresh ones winning; names in lower case."""
    low = lambda m: F.transform_keys(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, _: F.lower(k))
    return F.map_concat(F.map_filter(low(prior), lambda k, _: ~F.map_contains_key(low(fresh), k)), low(fresh))


def budget_prefix(rows: DataFrame, order: list[str], cost: str, cap: float, per: str | None = None) -> DataFrame:
    """Rows, in order, up to the one at which the running cost reaches ``cap``; that row is still in."""
    if per:
        w = Window.partitionBy(per).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("spent_before", F.coalesce(F.sum(cost).over(w), F.lit(0.0))).where(F.col("spent_before") < cap)
    # over all rows: ranges in order, each summed alone; a number per range is what goes before it
    ranged = stored(rows.repartitionByRange(*order).withColumn("_place", F.spark_partition_id()), "ranges")
    sums = sorted((r["_place"], r["s"] or 0.0) for r in ranged.groupBy("_place").agg(F.sum(cost).alias("s")).collect())
    before, total = [], 0.0
    for place, s in sums:
        before.append((place, float(total)))
        total += float(s)
    offsets = F.broadcast(rows.sparkSession.createDataFrame(before, "_place int, _before double"))
    w = Window.partitionBy("_place").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranged = ranged.join(offsets.where(F.col("_before") < cap), "_place")
    return ranged.withColumn("spent_before", F.col("_before") + F.coalesce(F.sum(cost).over(w), F.lit(0.0))).where(F.col("spent_before") < cap).select(*rows.columns, "spent_before")


def pinned(runs: DataFrame, provider: str, model: str, prompt_hash: str) -> Column:
    """Whether a run's pin ``provider/model@hash`` is the one required; names compare without case."""
    want = f"{provider}/{model}".lower()
    return (F.lower(F.split_part(F.col("model_pinned"), F.lit("@"), F.lit(1))) == want) & (F.split_part(F.col("model_pinned"), F.lit("@"), F.lit(2)) == prompt_hash)


# --- keyed state as event logs


def claim(queue: DataFrame, n: int, now: float) -> DataFrame:
    """The queue with its first ``n`` pending rows, by id, in flight: first in, first out."""
    first = queue.where("status = 'pending'").orderBy("id").limit(n).select("id", F.lit(True).alias("_mine"))
    mine = F.col("_mine").isNotNull()
    q = queue.join(first, "id", "left")
    return q.withColumns({"status": F.when(mine, "in_flight").otherwise(F.col("status")), "attempts": F.col("attempts") + mine.cast("int"), "claimed_at": F.when(mine, F.lit(now)).otherwise(F.col("claimed_at"))}).select(*queue.columns)


def queue_state(events: DataFrame, max_attempts: int = 2) -> DataFrame:
    """Queue rows from (crawl_id, url, event, at): enqueue, claim, complete, fail.  A failure goes back to pending
    while attempts are left; a claim without an end counts as in flight."""
    w = Window.partitionBy("crawl_id", "url").orderBy("at", "event")
    e = events.withColumn("attempts", F.sum(F.when(F.col("event") == "claim", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = e.groupBy("crawl_id", "url").agg(F.max(F.struct("at", "event")).alias("l"), F.max("attempts").alias("attempts"), F.min("at").alias("enqueued_at"))
    status = F.when(F.col("l.event") == "complete", "done").when((F.col("l.event") == "fail") & (F.col("attempts") >= max_attempts), "failed").when(F.col("l.event") == "claim", "in_flight").otherwise("pending")
    return last.select("crawl_id", "url", status.alias("status"), F.col("attempts").cast("int").alias("attempts"), "enqueued_at")


def queue_stats(queue: DataFrame, crawl_id: str | None = None) -> DataFrame:
    q = queue if crawl_id is None else queue.where(F.col("crawl_id") == crawl_id)
    return q.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def failures_since_success(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, success_count, failure_count) of (keys, ok, at): failures count from the last success on."""
    last = F.max(F.when(F.col("ok"), F.col("at")))
    w = Window.partitionBy(*keys)
    e = events.withColumn("_last", last.over(w))
    return e.groupBy(*keys).agg(F.count_if("ok").alias("success_count"), F.count_if(~F.col("ok") & (F.col("_last").isNull() | (F.col("at") > F.col("_last")))).alias("failure_count"))


def selector_rules(events: DataFrame, evict_at: int = 3) -> DataFrame:
    """Current selector rules of an event log (host, path_template, schema_hash, field_name, selector, event, at).

    ``learn`` sets a rule and clears its failures, ``success`` clears them, ``fail`` adds one, ``drop`` deletes;
    a rule is evicted at ``evict_at`` failures.
    """
    key = ["host", "path_template", "schema_hash", "field_name"]
    clear = F.max(F.when(F.col("event").isin("learn", "success", "drop"), F.col("at")))
    w = Window.partitionBy(*key)
    e = events.withColumn("_clear", clear.over(w)).withColumn("_set", F.max(F.when(F.col("event").isin("learn", "drop"), F.struct("at", "event", "selector"))).over(w))
    out = e.groupBy(*key).agg(F.first("_set").alias("s"), F.count_if((F.col("event") == "success") & (F.col("at") > F.col("_set.at"))).alias("success_count"), F.count_if((F.col("event") == "fail") & (F.col("at") > F.coalesce("_clear", F.lit(float("-inf"))))).alias("failure_count"), F.max("at").alias("updated_at"))
    return out.where((F.col("s.event") == "learn") & (F.col("failure_count") < evict_at)).select(*key, F.col("s.selector").alias("selector"), "success_count", "failure_count", "updated_at")


def watch_due(watches: DataFrame, now: Column) -> DataFrame:
    """Enabled watches that were never checked or whose interval is over, oldest first."""
    return watches.where(F.col("enabled") & (F.col("last_checked_at").isNull() | (F.col("last_checked_at") + F.col("interval_seconds") <= now))).orderBy("created_at", "id")


def watch_state(watches: DataFrame, checks: DataFrame) -> DataFrame:
    """Watches with their cursors moved by a log of checks (id, run_id, at, changed); a failed check moves
    ``last_checked_at`` only."""
    c = checks.groupBy("id").agg(F.max("at").alias("c_at"), F.max_by("run_id", F.when(F.col("run_id").isNotNull(), F.col("at"))).alias("c_run"), F.max(F.when(F.col("changed"), F.col("at"))).alias("c_changed"))
    j = watches.join(c, "id", "left")
    return j.withColumns({"last_checked_at": F.greatest("last_checked_at", "c_at"), "last_run_id": F.coalesce("c_run", "last_run_id"), "last_changed_at": F.greatest("last_changed_at", "c_changed")}).select(*watches.columns)


def host_slots(requests: DataFrame, delay: float, host: Column, order: list[str]) -> DataFrame:
    """``requests`` with ``slot_s``, the seconds after which each may go so that a host's stand ``delay`` apart."""
    w = Window.partitionBy("_host").orderBy(*order)
    return requests.withColumn("_host", host).withColumn("slot_s", F.lit(delay) * (F.row_number().over(w) - 1)).drop("_host")
