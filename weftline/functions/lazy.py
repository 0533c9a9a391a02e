"""Arrow UDFs that can be declared before there is a session."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Rows, and characters of their text, that go through Python at a time.
PIECE_ROWS, PIECE_CHARS = 128, 1_000_000


def arrow_udf(returns: str) -> Callable[[Callable], Callable[..., Column]]:
    """``pandas_udf`` made when it is first used: parsing its type needs a session."""

    def declare(f: Callable) -> Callable[..., Column]:
        def use(*columns) -> Column:
            return F.pandas_udf(returns)(f)(*columns)

        return use

    return declare


def pieces(columns: tuple[pa.Array, ...]) -> Iterator[list[tuple]]:
    """The rows of a batch, a few at a time."""
    held, size = [], 0
    for k in range(len(columns[0])):
        row = tuple(c[k].as_py() for c in columns)
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(held) >= PIECE_ROWS or size >= PIECE_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def by_row(f: Callable, returns: str) -> Callable[..., Column]:
    """UDF of a function of two or more values.  A batch may hold 10,000 pages: it stays in Arrow and goes through Python in
    pieces, so that what a worker holds beside it doesn't grow with the batch."""
    kind = to_arrow_type(DataType.fromDDL(returns))

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            for rows in pieces(columns):
                yield pa.array([f(*row) for row in rows], kind)

    return F.arrow_udf(run, returns)
