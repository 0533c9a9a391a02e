"""Quality classifier: a linear support-vector model over naive-Bayes-scaled n-gram indicators.

Word uni- and bigrams (case kept) and runs of marks are hashed to ``2**bits`` indicators; shares of capitals, repeats
and marks give a few more.  From
the labelled sample the class log-count ratio r = log((p + a) / |p + a|) - log((q + a) / |q + a|) is taken,
indicators are scaled by r, and a hinge-loss model is fitted by dual coordinate descent, both classes
weighing the same.  Every document is then scored; ``keep`` is score > 0.

The fit uses at most ``sample`` labelled rows of each class, those of the least hash of their doc_id, with texts of at most
``SAMPLE_CHARS`` characters; scoring covers all documents and their whole texts.

Defined cases: null or empty texts have no features and score the bias; labels that are null or not 0
or 1, or without a document, are left out; of rows that repeat a doc_id each is scored alike; if a class has
no labelled row, nothing can be learned and every document is kept with score 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.features import STYLES, dual_coordinate_descent, indicators, scores
from weftline.llm.grams import as_string, blocks

BITS = 18
SAMPLE = 3000
SAMPLE_CHARS = 50_000


def sampled(docs: DataFrame, labels: DataFrame, label: str, sample: int, chars: int = SAMPLE_CHARS) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of at most ``sample`` labelled rows of each class with texts of at most ``chars``, ordered."""
    chosen = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").distinct()
    key = F.struct(F.xxhash64("id"), "id")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).where(f"text IS NULL OR length(text) <= {chars}")
    picks = rows = None
    for y in (0, 1):
        part = chosen.where(F.col("y") == y).orderBy(key).limit(sample)
        picks = part if picks is None else picks.union(part)
    met = texts.join(F.broadcast(picks), "id")  # 2 * sample rows
    for y in (0, 1):  # an id may have many rows
        part = met.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(sample)
        rows = part if rows is None else rows.union(part)
    got = rows.toArrow()
    return sorted({(i, t or "", y) for i, t, y in zip(*(got[c].to_pylist() for c in ("id", "text", "y")))})


def fit(rows: list[tuple[int, str, int]], bits: int = BITS, smooth: float = 1.0, cost: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights over indicators and bias, label 1 positive."""
    dim = (1 << bits) + STYLES
    y = np.array([1.0 if r[2] else -1.0 for r in rows])
    if not len(y) or abs(y.sum()) == len(y):
        return np.zeros(dim), 0.0
    feats: list[np.ndarray] = []
    for _, arr in blocks(as_string(pa.array([r[1] for r in rows], pa.string()))):
        index, ptr = indicators(arr, bits)
        feats += [index[ptr[i] : ptr[i + 1]] for i in range(len(arr))]
    count = {s: np.full(dim, smooth) for s in (1.0, -1.0)}
    for f, s in zip(feats, y):
        count[s][f] += 1
    ratio = np.log(count[1.0] / count[1.0].sum()) - np.log(count[-1.0] / count[-1.0].sum())
    weight = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum())) * cost
    return dual_coordinate_descent(feats, y, ratio, weight, dim, whole=1 << bits)


def _scorer(weight: np.ndarray, bias: float, bits: int):
    weight = weight.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.zeros(0)]
            for _, arr in blocks(batch.column(1)):
                index, ptr = indicators(arr, bits)
                out.append(scores(index, ptr, weight, bias, 1 << bits))
            s = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array(s > 0)], names=["doc_id", "score", "keep"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample: int = SAMPLE) -> DataFrame:
    """doc_id, score, keep of every document."""
    weight, bias = fit(sampled(docs, labels, "quality", sample), bits)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if not weight.any() and bias == 0:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(True).alias("keep"))
    return rows.mapInArrow(_scorer(weight, bias, bits), "doc_id bigint, score double, keep boolean")
