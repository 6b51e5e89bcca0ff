"""Token files: concatenated ids with Elias-Fano document boundaries.

A file is a Parquet table of segments in order. A segment is one blob (format EFT2): a header, two Elias-Fano sequences (low bits packed,
high bits in unary, a select sample for each 64th value) - the identifiers of its documents, as distances from the least one, and the ends of
its documents - and the ids, 2 or 4 bytes each. Select gives any document's bounds without a table of offsets: about 2 + log2(mean length)
bits a document. A part is what one task wrote; the manifest, a second small table with a row for each part, tells how many ids stand before.

Documents are range-partitioned by identifier, so their order is ascending over all parts. Ties of the identifier are ordered by a hash of
the text; null identifiers come first. A null or empty text has the end id alone. An empty table gives empty files.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import _delete, documents, scratch, shares

MAGIC = b"EFT2"
HEADER = "<4sBxxxQQQqQ"
SEQUENCE = "<QBxxxxxxxQ"
SAMPLE = 64


@dataclass
class EliasFano:
    """A sequence of n non-decreasing integers up to a bound, in n * (2 + log2(bound / n)) bits at most, plus the select samples."""

    n: int
    low_bits: int
    low: np.ndarray  # uint8, packed from the least bit on
    high: np.ndarray  # uint64 words
    samples: np.ndarray  # uint32: the place of each 64th one in high

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values).astype(np.uint64)
        n, bound = len(v), int(v[-1]) + 1 if len(v) else 1
        bits = max(0, (bound // max(n, 1)).bit_length() - 1)
        place = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        words = np.zeros((int(place[-1]) // 64 + 1) if n else 0, np.uint64)
        np.bitwise_or.at(words, place // 64, np.uint64(1) << (place % 64).astype(np.uint64))
        each = (v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1) if bits else np.zeros((n, 0))
        return cls(n, bits, np.packbits(each.astype(np.uint8).ravel(), bitorder="little"), words, place[::SAMPLE].astype(np.uint32))

    def _low(self, i: int) -> int:
        b, e = i * self.low_bits, (i + 1) * self.low_bits
        return (int.from_bytes(self.low[b // 8 : -(-e // 8)].tobytes(), "little") >> b % 8) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th value: from the sample before it, word by word to the i-th one."""
        at = int(self.samples[i // SAMPLE])
        left, w = i % SAMPLE, at // 64
        word = int(self.high[w]) >> at % 64 << at % 64
        while (ones := word.bit_count()) <= left:
            left, w = left - ones, w + 1
            word = int(self.high[w])
        for _ in range(left):
            word &= word - 1
        return ((w * 64 + (word & -word).bit_length() - 1 - i) << self.low_bits) | self._low(i)

    def pack(self) -> bytes:
        head = struct.pack(SEQUENCE, self.n, self.low_bits, len(self.high))
        return b"".join([head, self.low.tobytes(), self.high.astype("<u8").tobytes(), self.samples.astype("<u4").tobytes()])

    @classmethod
    def unpack(cls, blob: bytes, at: int) -> tuple[EliasFano, int]:
        """The sequence that begins at a place of the blob, and where it ends."""
        n, bits, words = struct.unpack_from(SEQUENCE, blob, at)
        at += struct.calcsize(SEQUENCE)
        parts = []
        for kind, count in (("u1", -(-n * bits // 8)), ("<u8", words), ("<u4", -(-n // SAMPLE))):
            parts.append(np.frombuffer(blob, kind, count, at))
            at += parts[-1].nbytes
        return cls(n, bits, *parts), at


class Segment:
    """keys: identifiers in ascending order after `nulls` documents without one, less `least`; start: ids of the part before this segment."""

    def __init__(self, nulls: int, least: int, keys: EliasFano, ends: EliasFano, ids: np.ndarray, start: int):
        self.nulls, self.least, self.keys, self.ends, self.ids, self.start = nulls, least, keys, ends, ids, start

    @staticmethod
    def pack(keys: list[int | None], lengths: np.ndarray, ids: np.ndarray, start: int) -> bytes:
        """keys: in ascending order, nulls first."""
        known = [k for k in keys if k is not None]
        least = known[0] if known else 0
        wide = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
        head = struct.pack(HEADER, MAGIC, wide, len(ids), start, len(keys) - len(known), least, 0)
        apart = np.array(known, np.int64).astype(np.uint64) - np.uint64(least % (1 << 64))  # modulo 2 ** 64, so that any two longs have a distance
        return b"".join([head, EliasFano.build(apart).pack(), EliasFano.build(np.cumsum(lengths)).pack(), ids.astype(f"<u{wide}").tobytes()])

    @classmethod
    def unpack(cls, blob: bytes) -> Segment:
        magic, wide, size, start, nulls, least, _ = struct.unpack_from(HEADER, blob)
        if magic != MAGIC:
            raise ValueError("not a segment of a token file")
        keys, at = EliasFano.unpack(blob, struct.calcsize(HEADER))
        ends, at = EliasFano.unpack(blob, at)
        return cls(nulls, least, keys, ends, np.frombuffer(blob, f"<u{wide}", size, at), start)

    def __len__(self) -> int:
        return self.ends.n

    def key(self, i: int) -> int | None:
        return None if i < self.nulls else self.least + self.keys.select(i - self.nulls)

    def bounds(self, i: int) -> tuple[int, int]:
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds(i)
        return self.ids[a:b]


SEGMENTS = "part int, segment int, n_docs long, n_ids long, blob binary"


def _write(tokenizer: str, end_id: int, segment_ids: int):
    def run(batches):
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), tokens.encoder(tokens.tokenizer_path(tokenizer))
        keys, lengths, ids, held, start, number = [], [], [], 0, 0, 0

        def sent():
            flat = np.concatenate(ids)
            blob = Segment.pack(keys, np.concatenate(lengths), flat, start)
            values = [[part], [number], [len(keys)], [len(flat)], [blob]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names=["part", "segment", "n_docs", "n_ids", "blob"])

        for batch in batches:
            for some in shares(batch, 1, rows=512):  # few rows at once, so that segments end near their size
                flat, starts = enc.encode(some.column(1), end_id)
                keys += some.column(0).to_pylist()
                lengths.append(np.diff(starts))
                ids.append(flat.astype(np.uint32))
                held += len(flat)
                if held >= segment_ids:
                    yield sent()
                    keys, lengths, ids, start, held, number = [], [], [], start + held, 0, number + 1
        if keys:
            yield sent()

    return run


class TokenFiles:
    """The token files in a folder: write() makes them, segments() has the blobs with the ids before each, digests() a row per document."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def write(cls, docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, segment_ids: int = 1 << 20) -> TokenFiles:
        out = cls(docs.sparkSession, path)
        rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
        rows = rows.repartitionByRange("key", "h").sortWithinPartitions("key", "h").select("key", "text")
        rows.mapInArrow(_write(tokenizer, end_id, segment_ids), SEGMENTS).write.option("compression", "zstd").parquet(f"{out.path}/segments")
        parts = out._blobs().groupBy("part").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_ids").alias("n_ids"))
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
        parts.coalesce(1).write.parquet(f"{out.path}/manifest")
        return out

    def _blobs(self) -> DataFrame:
        return self.spark.read.schema(SEGMENTS).parquet(f"{self.path}/segments")

    def segments(self) -> DataFrame:
        """The manifest has one row of two integers for each task that wrote: it is sent to all machines whatever the corpus."""
        manifest = self.spark.read.schema("part int, n_docs long, n_ids long, start long").parquet(f"{self.path}/manifest").select("part", "start")
        return self._blobs().join(F.broadcast(manifest), "part").select("part", "segment", "start", "blob")

    def digests(self) -> DataFrame:
        """A row per document, read back: its key and bounds by select, its ids between them."""

        def run(batches):
            for batch in batches:
                for base, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                    s = Segment.unpack(blob.as_py())
                    n = len(s)
                    keys = pa.array((s.key(i) for i in range(n)), pa.int64(), size=n)
                    starts = np.fromiter((s.ends.select(i) if i >= 0 else 0 for i in range(-1, n)), np.int64, n + 1)
                    values = [keys, pa.array(starts[:-1] + (base + s.start)), pa.array(np.diff(starts)), pa.array(tokens.crc32s(s.ids, starts))]
                    yield pa.RecordBatch.from_arrays(values, names=["doc_id", "start", "n_tokens", "ids_crc32"])

        return self.segments().select("start", "blob").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")

    def delete(self) -> None:
        _delete(self.spark, self.path)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files are read when the result is; they are deleted when the driver ends."""
    return TokenFiles.write(documents(spark, sf_dir), scratch(spark, "tokens")).digests()


QUERIES = {"op1_token_files": op1_token_files}
ORACLES: dict[str, str] = {}
