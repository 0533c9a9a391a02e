"""Token counts by the finite-state transducer of ``fsm``: exact counts of a byte-level BPE vocabulary.

Defined cases: a null text has a null count, an empty one 0; repeated rows are each counted; a null
doc_id is carried through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import fsm, vocab
from weftline.llm.grams import blocks


def _counter(blob: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = fsm.transducer(blob)
        for batch in batches:
            counts = [np.zeros(0, np.int64)]
            for _, arr in blocks(batch.column(1)):
                out, off = fsm.deltas(arr, machine)
                total = np.append(0, np.cumsum(out, dtype=np.int64))
                counts.append(total[off[1:]] - total[off[:-1]])
            n = pa.array(np.concatenate(counts), pa.int64(), mask=batch.column(1).is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str = vocab.DEFAULT) -> DataFrame:
    """doc_id, n_tokens of every row."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counter(vocab.read(vocabulary)), "doc_id bigint, n_tokens bigint")
