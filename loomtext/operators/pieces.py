"""Rows made of texts in Python, a piece of a batch at a time: a worker's memory hangs on neither the rows of a batch nor what they hold."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of the texts of a piece (a longer text comes alone), and rows that are sent back at once.
PIECE_BYTES, PIECE_ROWS = 1 << 20, 4096
#: Values of the lists of a piece.
PIECE_VALUES = 1 << 18
KINDS = {"int": pa.int32(), "string": pa.string()}


def pieces(batch: pa.RecordBatch, column: int = 1, limit: int = PIECE_BYTES) -> Iterable[pa.RecordBatch]:
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = size[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(size, before + limit, side="right")))
        yield batch.slice(lo, hi - lo)
        lo = hi


def list_pieces(batch: pa.RecordBatch, column: int = 1, values: int = PIECE_VALUES, rows: int = 1024) -> Iterable[pa.RecordBatch]:
    """Pieces of so many rows, and of so many values of a column of lists (a longer list comes alone)."""
    size = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = size[lo - 1] if lo else 0
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(size, before + values, side="right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def rows_of_texts(df: DataFrame, key: str, text: str, schema: str, rows_of: Callable[[str | None], Iterable[tuple]]) -> DataFrame:
    """key and the columns of schema (int and string): the rows that rows_of gives for each text."""
    names, kinds = zip(*(x.split() for x in schema.split(", ")))

    def batch_of(keys, at, rows):
        columns = [pa.array(c, KINDS[k]) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at, pa.int64())), *columns], names=[key, *names])

    def run(batches):
        for batch in batches:
            for some in pieces(batch):
                at, rows = [], []
                for i, t in enumerate(some.column(1).to_pylist()):
                    for r in rows_of(t):
                        at.append(i)
                        rows.append(r)
                        if len(rows) == PIECE_ROWS:
                            yield batch_of(some.column(0), at, rows)
                            at, rows = [], []
                if rows:
                    yield batch_of(some.column(0), at, rows)

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {schema}")
