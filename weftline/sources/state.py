"""State tables, snapshots and archives on plain Parquet and text, in any file system Spark knows."""

from __future__ import annotations

import gzip
import tempfile
import uuid
import weakref

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; where it is unset, as in tests on one machine, a temporary one is set."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="weftline-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


_paths: dict[int, tuple[weakref.ref, str]] = {}


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` computed once: written as Parquet into the shared folder and read again, so that it survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weftline/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of ``stored`` tables that nothing will read any more."""
    for df in tables:
        ref, path = _paths.pop(id(df), (None, None))
        if ref is None or ref() is not df:
            continue
        sc = df.sparkSession.sparkContext
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def append(df: DataFrame, path: str) -> None:
    """Rows added to an append-only log; new columns are added to its schema when it is read."""
    df.write.mode("append").parquet(path)


def log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Archived bodies (path, html) of gzip or plain files."""

    @F.pandas_udf("string")
    def unpack(content: pd.Series) -> pd.Series:
        return content.map(lambda b: (gzip.decompress(b) if b[:2] == b"\x1f\x8b" else bytes(b)).decode("utf-8", "replace"))

    return spark.read.format("binaryFile").load(path).select("path", unpack("content").alias("html"))


def audit_append(events: DataFrame, path: str) -> None:
    events.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def audit_tail(spark: SparkSession, path: str, schema: str, n: int = 50) -> DataFrame:
    """The last ``n`` audit events by ``ts``; lines that aren't JSON are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).orderBy(F.desc("ts")).limit(n)
