"""Exports: JSON lines, CSV with the union of extraction fields, and trimmed views for callers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = tuple("url run_id status tier_used kind title blocked block_reason cost_usd error".split())


def _has(results: DataFrame, name: str) -> Column:
    return F.col(name) if name in results.columns else F.lit(None).cast("string")


def json_lines(results: DataFrame, include_markdown: bool = False) -> DataFrame:
    """One JSON text per result; failed items are only url and error."""
    names = [*BASE, *(n for n in ("extraction", "data") if n in results.columns), *(["markdown"] if include_markdown else [])]
    full = F.to_json(F.struct(*[_has(results, n).alias(n) for n in names]), {"ignoreNullFields": "false"})
    short = F.to_json(F.struct("url", _has(results, "error").alias("error")), {"ignoreNullFields": "false"})
    return results.select(F.when(_has(results, "error").isNotNull() & _has(results, "run_id").isNull(), short).otherwise(full).alias("value"))


def to_jsonl(results: DataFrame, path: str, include_markdown: bool = False) -> None:
    json_lines(results, include_markdown).write.mode("overwrite").text(path)


def extraction_keys(results: DataFrame, column: str = "extraction_json") -> list[str]:
    """Sorted union of the top-level keys; only the distinct names come to the driver."""
    keys = results.select(F.explode(F.json_object_keys(column)).alias("k")).distinct().orderBy("k")
    return [r["k"] for r in keys.toLocalIterator() if r["k"] not in BASE]


def flat(results: DataFrame, column: str = "extraction_json") -> DataFrame:
    """Base columns and a column per extraction field; base columns win a clash, nested values stay JSON."""
    cells = F.from_json(column, "map<string,string>")
    row = results.select(*[_has(results, n).alias(n) for n in BASE], cells.alias("_cells"))
    return row.select(*BASE, *[F.try_element_at("_cells", F.lit(k)).alias(k) for k in extraction_keys(results, column)])


def to_csv(results: DataFrame, path: str, column: str = "extraction_json") -> None:
    flat(results, column).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def markdown_files(results: DataFrame, path: str) -> None:
    results.select(F.col("markdown").alias("value")).write.mode("overwrite").text(path)


def trimmed(results: DataFrame, field: str, most: int = 200_000, keep: int = 2000) -> DataFrame:
    """``field`` cut to ``keep`` characters, with ``truncated``, where the row's JSON has more than ``most`` bytes."""
    big = F.octet_length(F.to_json(F.struct("*"))) > most
    return results.withColumn("truncated", big).withColumn(field, F.when(F.col("truncated"), F.substring(field, 1, keep)).otherwise(F.col(field)))


def public_view(results: DataFrame, chunks: int = 100, chars: int = 3000) -> DataFrame:
    """Results without HTML and with at most ``chunks`` chunks of ``chars`` characters."""
    out = results.drop("html", "raw_content")
    if "chunks" in out.columns:
        out = out.withColumn("chunks", F.transform(F.slice("chunks", 1, chunks), lambda c: c.withField("text", F.substring(c["text"], 1, chars))))
    return out
