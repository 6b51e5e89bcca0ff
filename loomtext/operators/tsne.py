"""A map of vectors in two dimensions: t-SNE of a bounded sample, every other row placed by its neighbours there.

The sample (landmarks rows at most, those of least hash of their key) is laid out in numpy on the driver; a row is placed at the weighted mean of the
places of its nearest landmarks, the weights being those of a Gaussian whose width gives the same perplexity; a landmark stands where it was laid
out. Placing reads every row once and shuffles nothing. A null vector has null places; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .vector import ROWS, matrix


def affinities(square: np.ndarray, perplexity: float) -> np.ndarray:
    """Rows of probabilities of squared distances (infinite ones get none), by bisection of each row's width."""
    n, finite = len(square), np.isfinite(square)
    lo, hi, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
    near = np.where(finite, square, 0) - np.where(finite, square, np.inf).min(axis=1, keepdims=True)
    target = np.log(np.minimum(perplexity, np.maximum(finite.sum(axis=1), 1)))
    for _ in range(60):
        p = np.where(finite, np.exp(-np.maximum(near, 0) * beta[:, None]), 0)
        p /= np.maximum(p.sum(axis=1, keepdims=True), 1e-300)
        entropy = -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)
        wide = entropy > target
        lo, hi = np.where(wide, beta, lo), np.where(wide, hi, beta)
        beta = np.where(np.isinf(hi), beta * 2, (lo + hi) / 2)
    return p


def layout(x: np.ndarray, perplexity: float = 30.0, rounds: int = 400, seed: int = 3) -> np.ndarray:
    """Exact t-SNE of a few rows: from the two first components, with exaggeration in the first quarter."""
    n = len(x)
    if n < 3:
        return np.zeros((n, 2)) + np.arange(n)[:, None]
    s = (x * x).sum(axis=1)
    square = np.maximum(s[:, None] + s[None, :] - 2 * x @ x.T, 0)
    np.fill_diagonal(square, np.inf)
    p = affinities(square, min(perplexity, (n - 1) / 3))
    p = np.maximum((p + p.T) / (2 * n), 1e-12)
    c = x - x.mean(axis=0)
    y = c @ np.linalg.svd(c, full_matrices=False)[2][:2].T
    y = np.pad(y, ((0, 0), (0, 2 - y.shape[1])))
    y = y / max(y.std(), 1e-12) * 1e-4 + np.random.default_rng(seed).normal(0, 1e-6, y.shape)
    v, gain, rate = np.zeros_like(y), np.ones_like(y), max(n / 48, 50.0)
    for i in range(rounds):
        s = (y * y).sum(axis=1)
        q = 1 / (1 + np.maximum(s[:, None] + s[None, :] - 2 * y @ y.T, 0))
        np.fill_diagonal(q, 0)
        w = ((12 if i < rounds // 4 else 1) * p - q / q.sum()) * q
        g = 4 * (w.sum(axis=1)[:, None] * y - w @ y)
        gain = np.maximum(np.where(np.sign(g) != np.sign(v), gain + 0.2, gain * 0.8), 0.01)
        v = (0.5 if i < rounds // 4 else 0.8) * v - rate * gain * g
        y = y + v
        y -= y.mean(axis=0)
    return y


def tsne(df: DataFrame, key: str = "vec_id", vector: str = "embedding", landmarks: int = 800, perplexity: float = 30.0, neighbours: int = 15, seed: int = 3) -> DataFrame:
    """Adds x and y."""
    h = F.xxhash64(key, F.lit(seed))
    own = df.where(F.col(vector).isNotNull())
    n = own.count()
    some = own.where(h.cast("double") <= (min(1.0, (1.25 * landmarks + 50) / max(n, 1)) - 0.5) * float(1 << 64))
    got = some.select(F.col(vector).cast("array<double>").alias("v"), h.alias("h")).toArrow().combine_chunks().sort_by("h").slice(0, landmarks)
    points = matrix(got.column(0).combine_chunks()) if got.num_rows else np.zeros((0, 1))
    points = np.unique(points, axis=0)  # rows that are the same share a place
    sent = df.sparkSession.sparkContext.broadcast((points, layout(points, perplexity)))
    names = df.columns

    def run(batches):
        points, places = sent.value
        k = min(neighbours, len(points))
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                known = np.flatnonzero(~np.array(part.column(len(names)).is_null()))
                out = np.full((part.num_rows, 2), np.nan)
                if len(known) and k:
                    x = matrix(part.column(len(names)).take(pa.array(known)))
                    square = np.maximum((x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1)[None, :] - 2 * x @ points.T, 0)
                    near = np.argpartition(square, k - 1, axis=1)[:, :k]
                    d = np.take_along_axis(square, near, 1)
                    w = affinities(d, max(1.0, k / 3))
                    w = np.where((d.min(axis=1) < 1e-12)[:, None], d == d.min(axis=1, keepdims=True), w)
                    out[known] = (w[:, :, None] * places[near]).sum(axis=1) / w.sum(axis=1, keepdims=True)
                columns = [pa.array(out[:, j], mask=np.isnan(out[:, j])) for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[*names, "x", "y"])

    schema = T.StructType([*df.schema.fields, T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    return df.select("*", F.col(vector).cast("array<double>").alias("_v")).mapInArrow(run, schema)
