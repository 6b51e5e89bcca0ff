"""Media columns: audio features of 8-bit samples.

A text's UTF-8 bytes, with bytes 255 up to a positive multiple of 576, are 8-bit mono samples of a WAV file of 16 kHz, stored without loss in
a Parquet table in the shared folder and read back. From the stored bytes come: samples at 12 kHz (polyphase resampling by 3/4 with a
windowed sinc), log-mel frames (256 samples, every 128th, 24 bands), segments of sound (hysteresis between two levels above the clip's
floor), and clips of 64 frames as Arrow tensors of fixed shape with their time spans, in one Arrow IPC stream for each document. Streams and
segments are a table in the shared folder too; the line of features that the query gives is worked out from what is read back of it.

All is computed in blocks, so a very long text needs no more memory than its bytes and features. Values are rounded to quarter decibels, so
that equal texts have equal features. Nulls: a null text is empty, and has the 576 bytes of padding. Repeated rows are stored each. An empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, shares

UNIT, RATE = 576, 16_000
UP, DOWN, TAPS = 3, 4, 12
FRAME, HOP, BANDS, CLIP = 256, 128, 24, 64
BLOCK = 3 * 1024  # frames at once
#: Decibels above the floor at which a segment begins, and below which it ends.
ON, OFF = 6.0, 3.0


def wav(payload: bytes, rate: int = RATE) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def samples(media: bytes) -> memoryview:
    """The data chunk of an 8-bit mono WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            return memoryview(media)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def padded(text: bytes) -> bytes:
    n = max(1, -(-len(text) // UNIT)) * UNIT
    return text + b"\xff" * (n - len(text))


def _phases() -> np.ndarray:
    """The low-pass filter's taps by phase: a sinc that ends below half the lower rate, under a Hann window."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.hanning(n + 2)[1:-1]
    h *= UP / h.sum()
    return np.stack([h[p::UP] for p in range(UP)]).astype(np.float32)


def _mel() -> np.ndarray:
    """Triangular bands, evenly spaced in mel."""
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(rate / 2), BANDS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / rate)
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid))).T.astype(np.float32)


PHASES, MEL, WINDOW = _phases(), _mel(), np.hanning(FRAME).astype(np.float32)


def resampled(x: np.ndarray, begin: int, end: int) -> np.ndarray:
    """Samples begin to end at 3/4 of the rate; begin is a multiple of 3. Outside of x there is silence."""
    groups = -(-(end - begin) // UP)
    first = begin // UP * DOWN - (TAPS - 1)
    need = (groups - 1) * DOWN + UP + TAPS - 1
    part = np.zeros(need, np.float32)
    a, b = max(first, 0), min(first + need, len(x))
    if b > a:
        part[a - first : b - first] = (x[a:b].astype(np.float32) - 128) / 128
    out = np.empty((groups, UP), np.float32)
    for p in range(UP):
        windows = np.lib.stride_tricks.as_strided(part[p:], (groups, TAPS), (part.strides[0] * DOWN, part.strides[0]))
        out[:, p] = np.ascontiguousarray(windows) @ PHASES[p][::-1]
    return out.ravel()[: end - begin]


def log_mel(x: np.ndarray) -> np.ndarray:
    """Frames x bands in quarter decibels (integers); one frame at least. The last one is filled up with silence."""
    total = -(-len(x) * UP // DOWN)
    frames = max(1, 1 - (FRAME - total) // HOP)
    out = np.empty((frames, BANDS), np.int16)
    for lo in range(0, frames, BLOCK):
        hi = min(frames, lo + BLOCK)
        y = resampled(x, lo * HOP, (hi - 1) * HOP + FRAME)
        rows = np.lib.stride_tricks.as_strided(y, (hi - lo, FRAME), (y.strides[0] * HOP, y.strides[0]))
        power = np.abs(np.fft.rfft(rows * WINDOW, axis=1)).astype(np.float32) ** 2
        out[lo:hi] = np.rint(40 * np.log10(power @ MEL + 1e-6))
    return out


def segments(mel: np.ndarray) -> np.ndarray:
    """(first frame, frame after the last) of each segment of sound."""
    level = mel.astype(np.float64).mean(axis=1) / 4
    floor = np.sort(level)[len(level) // 10]
    state = np.where(level >= floor + ON, 1, np.where(level < floor + OFF, 0, -1))
    known = np.maximum.accumulate(np.where(state >= 0, np.arange(len(state)), -1))
    on = np.where(known >= 0, state[np.maximum(known, 0)], 0)
    edge = np.diff(np.concatenate([[0], on, [0]]))
    return np.column_stack([np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)])


TENSOR = pa.fixed_shape_tensor(pa.float16(), (CLIP, BANDS), dim_names=("frame", "band"))
CLIPS = pa.schema([("tensor", TENSOR), ("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32())])


def clips(mel: np.ndarray) -> pa.RecordBatch:
    """Clips of equal numbers of frames, the last one filled up with zeros; in decibels."""
    n = -(-len(mel) // CLIP)
    full = np.zeros((n * CLIP, BANDS), np.float16)
    full[: len(mel)] = mel / 4
    second = HOP * DOWN / (RATE * UP)
    at = np.arange(n) * CLIP
    frames = np.minimum(len(mel) - at, CLIP)
    end = (at + frames - 1) * second + FRAME * DOWN / (RATE * UP)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(full.ravel()), CLIP * BANDS)
    return pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(TENSOR, storage), pa.array(at * second), pa.array(end), pa.array(frames.astype(np.int32))], schema=CLIPS)


#: Seconds from one frame to the next.
STEP = HOP * DOWN / (RATE * UP)


def features(payload) -> tuple[bytes, list[tuple[float, float]]]:
    """The clips as an Arrow IPC stream, and the segments' time spans in seconds."""
    mel = log_mel(np.frombuffer(payload, np.uint8))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, CLIPS) as w:
        w.write_batch(clips(mel))
    return sink.getvalue().to_pybytes(), [(round(a * STEP, 6), round(b * STEP, 6)) for a, b in segments(mel).tolist()]


def frames_of(tensors: bytes) -> np.ndarray:
    """Frames x bands in quarter decibels, from a stream of clips. Quarters of this size are exact in 16 bits."""
    table = pa.ipc.open_stream(tensors).read_all().combine_chunks()
    full = table.column("tensor").chunk(0).storage.flatten().to_numpy().reshape(-1, CLIP, BANDS)
    return np.concatenate([t[:n] for t, n in zip(full, table.column("frames").to_pylist())]).astype(np.float32) * 4


def line(tensors: bytes, spans: list[tuple[float, float]]) -> str:
    """A line that sums up what is stored of a document."""
    mel = frames_of(tensors).astype(np.int16)
    means = ",".join(str(x) for x in (mel.astype(np.int64).sum(axis=0) // len(mel)).tolist())
    sound = sum(round((b - a) / STEP) for a, b in spans)
    return f"frames={len(mel)};bands={BANDS};segments={len(spans)};sound={sound};mean={means};crc={zlib.crc32(mel.astype('<i2').tobytes()):08x}"


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored media table: key, n_bytes (of the text), media (the WAV file)."""

    def run(batches):
        for batch in batches:
            for some in shares(batch, 1, rows=256):
                raw = [x or b"" for x in some.column(1).to_pylist()]
                media = pa.array([wav(padded(x)) for x in raw], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(x) for x in raw], pa.int64()), media], names=["key", "n_bytes", "media"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("binary").alias("text"))
    return materialize(rows.mapInArrow(run, "key long, n_bytes long, media binary"), "media")


SUMS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
STORED = f"{SUMS}, spans array<struct<start_s: double, end_s: double>>, tensors binary"
SPANS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))


def tensors(media: DataFrame) -> DataFrame:
    """The stored feature table, one row per stored file: sums of its bytes, the segments' spans, and the stream of tensors."""

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), SPANS, pa.binary()]
        names = [x.split()[0] for x in SUMS.split(", ")] + ["spans", "tensors"]
        for batch in batches:
            for some in shares(batch, 2, rows=256):
                rows = []
                for k, n, m in zip(*(c.to_pylist() for c in some.columns)):
                    payload = samples(m)
                    stream, spans = features(payload)
                    rows.append((k, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), [{"start_s": a, "end_s": b} for a, b in spans], stream))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return materialize(media.select("key", "n_bytes", "media").mapInArrow(run, STORED), "tensors")


def described(stored: DataFrame, keep: bool = False) -> DataFrame:
    """One row per stored row: the sums, and the features' line, from the tensors and spans that are read; these too if they are to be kept."""
    n = len(SUMS.split(", "))

    def run(batches):
        for batch in batches:
            for some in shares(batch, n + 1, rows=256):
                lines = [line(t, [(x["start_s"], x["end_s"]) for x in spans]) for spans, t in zip(some.column(n).to_pylist(), some.column(n + 1).to_pylist())]
                rest = some.columns[n:] if keep else []
                yield pa.RecordBatch.from_arrays([*some.columns[:n], pa.array(lines, pa.string()), *rest], names=[*some.schema.names[:n], "feature", *(some.schema.names[n:] if keep else [])])

    return stored.mapInArrow(run, f"{SUMS}, feature string" + (STORED.removeprefix(SUMS) if keep else ""))


def extract(media: DataFrame) -> DataFrame:
    """The stored features of stored files: sums, the features' line, spans and tensors."""
    return described(tensors(media), keep=True)


def op4_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(tensors(encode(documents(spark, sf_dir))))


QUERIES = {"op4_audio": op4_audio}
ORACLES: dict[str, str] = {}
