"""Sorted rows as Python streams: for ``mapInArrow`` over partitions that Spark has dealt and sorted."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of Arrow batches as tuples, one batch in memory at a time."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def runs_of(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Consecutive rows that agree in their first ``keys`` columns, as streams."""
    return groupby(rows_of(batches), key=lambda row: row[:keys])


def batches_of(rows: Iterable[tuple], schema: StructType, most: int = 2048,
               most_chars: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most ``most`` rows, cut early after about
    ``most_chars`` characters of text."""
    arrow, held, chars = to_arrow_schema(schema), [], 0
    for row in rows:
        held.append(row)
        chars += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= most or chars >= most_chars:
            yield _batch(held, arrow)
            held, chars = [], 0
    if held:
        yield _batch(held, arrow)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
