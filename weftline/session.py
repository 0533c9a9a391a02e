"""Session helpers."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors, once per application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        root = Path(__file__).resolve().parent
        with tempfile.TemporaryDirectory() as tmp:
            stage = Path(tmp) / "stage" / root.name
            shutil.copytree(root, stage, ignore=shutil.ignore_patterns("__pycache__"))
            archive = shutil.make_archive(str(Path(tempfile.mkdtemp()) / root.name), "zip", stage.parent)
        spark.sparkContext.addPyFile(archive)
        _shipped.add(app)
    return spark


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores; a table in enough files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df._jdf.rdd().getNumPartitions() >= cores else df.repartition(cores)


#: Bytes of a table's files for each partition that ``dealt`` makes, and the most of these.
PART_BYTES, MOST_PARTS = 16_000_000, 20_000


def dealt(df: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` over partitions that grow in number, not in size, with the files of ``table`` that it is made of."""
    size = int(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(min(max(least, size // PART_BYTES + 1), max(least, MOST_PARTS)), *keys)
