"""Command line over tables in Parquet: scrape, crawl, map, batch, list, replay, diff, audit and the watch commands."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import api, export, frontier, runs
from weftline.session import ship
from weftline.sources import state


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftline")
    sub = p.add_subparsers(dest="command", required=True)
    for name, args in {
        "scrape": ["pages", "out"], "crawl": ["pages", "seeds", "out"], "map": ["pages", "seeds", "out"], "batch": ["pages", "urls", "out"], "list": ["runs"], "replay": ["runs", "snapshots", "out"],
        "diff": ["runs"], "audit": ["log"], "watch-add": ["watches", "url"], "watch-list": ["watches"], "watch-remove": ["watches", "url"], "watch-due": ["watches", "now"],
    }.items():
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        c.add_argument("--limit", type=int, default=50)
        c.add_argument("--depth", type=int, default=2)
        c.add_argument("--main", action="store_true")
        c.add_argument("--redact", action="store_true")
        c.add_argument("--interval", type=float, default=3600.0)
        c.add_argument("--markdown", action="store_true")
    return p


def _write(df: DataFrame, out: str, markdown: bool) -> None:
    if out.endswith(".csv"):
        export.to_csv(df.withColumn("extraction_json", F.col("extraction.data")), out)
    elif out.endswith(".md"):
        export.markdown_files(df, out)
    else:
        export.to_jsonl(df, out, markdown)


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = ship(SparkSession.builder.appName("weftline").getOrCreate())
    read = spark.read.parquet
    if a.command == "scrape":
        _write(api.scrape(read(a.pages), main=a.main, redact=a.redact), a.out, a.markdown)
    elif a.command == "batch":
        _write(api.batch_scrape(read(a.urls), read(a.pages), main=a.main, redact=a.redact), a.out, a.markdown)
    elif a.command == "crawl":
        q = frontier.crawl(read(a.pages), read(a.seeds), a.depth)
        q.write.mode("overwrite").parquet(a.out)
        runs.queue_stats(q).show()
    elif a.command == "map":
        frontier.map_site(read(a.pages), read(a.seeds), max_depth=a.depth).write.mode("overwrite").text(a.out)
    elif a.command == "list":
        runs.listing(state.log(spark, a.runs), a.limit).show(a.limit, truncate=False)
    elif a.command == "replay":
        done = api.replay(state.log(spark, a.runs), state.snapshots(spark, a.snapshots), main=a.main)
        done.select("run_id", "url", "shaped.*").write.mode("overwrite").parquet(a.out)
    elif a.command == "diff":
        runs.diff_text(runs.diff_latest(state.log(spark, a.runs))).select("summary").show(a.limit, truncate=False)
    elif a.command == "audit":
        state.audit_tail(spark, a.log, "ts double, event string", a.limit).show(a.limit, truncate=False)
    elif a.command == "watch-add":
        row = [(a.url, a.url, a.interval, None, None, True, None, None, None, 0.0)]
        from weftline.schemas import WATCHES

        state.append(spark.createDataFrame(row, WATCHES), a.watches)
    elif a.command == "watch-list":
        state.log(spark, a.watches).orderBy("created_at", "id").show(a.limit, truncate=False)
    elif a.command == "watch-remove":
        # an append-only log: the newest row of an id counts, and a disabled one is removed
        gone = state.log(spark, a.watches).where(F.col("url") == a.url).withColumn("enabled", F.lit(False)).withColumn("created_at", F.col("created_at") + 1)
        state.append(state.stored(gone, "watches"), a.watches)
    elif a.command == "watch-due":
        runs.watch_due(state.log(spark, a.watches), F.lit(float(a.now))).show(a.limit, truncate=False)


if __name__ == "__main__":
    main()
