"""Rows made of texts, a piece of a batch at a time."""

import pyarrow as pa

from loomtext.operators import pieces


def test_pieces_are_bounded_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["ab", None, "é" * 5, "x" * 30, "", "yz"])], names=["k", "t"])
    assert [p.column(0).to_pylist() for p in pieces.pieces(batch.slice(0), limit=12)] == [[0, 1, 2], [3], [4, 5]] and list(pieces.pieces(batch.slice(0, 0))) == []


def test_list_pieces_are_bounded_by_values_and_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array([[1, 2], None, [3] * 5, [4] * 30, [], [5]])], names=["k", "w"])
    assert [p.column(0).to_pylist() for p in pieces.list_pieces(batch, values=7)] == [[0, 1, 2], [3], [4, 5]]
    assert [p.num_rows for p in pieces.list_pieces(batch, rows=4)] == [4, 2] and list(pieces.list_pieces(batch.slice(0, 0))) == []


def test_rows_of_texts_come_in_pieces(spark):
    """A batch of many texts is sent back in many batches, with the rows in order; keys may be null."""
    rows = [(None if i == 7 else i, None if i == 5 else "w" * 1000) for i in range(4000)]
    df = spark.createDataFrame(rows, "k long, t string").coalesce(1)

    def rows_of(t):
        return ((j, (t or "")[: j + 1]) for j in range(3) if t)

    out = pieces.rows_of_texts(df, "k", "t", "n int, s string", rows_of)
    got = [tuple(r) for r in out.collect()]
    assert got == [(k, j, "w" * (j + 1)) for k, t in rows if t for j in range(3)]
