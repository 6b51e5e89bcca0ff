"""A scorer of (query, passage) pairs, fitted to labelled pairs by distributed gradients.

A pair's features: how much of the query's words and word pairs the passage has, their Jaccard similarity, the passage's length, and by hash each
word of the query that the passage has or lacks. The model is logistic. In each round tasks sum the gradient of their own pairs, the sums are
added feature by feature, and a vector of fixed length (FEATURES) comes to the driver, whatever the number of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import stored
from .lexical import terms

#: Features that stand for themselves, then cells of words that both have and that the passage lacks.
PLAIN, CELLS = 6, 1 << 11
FEATURES = PLAIN + 2 * CELLS
ROWS = "label double, at array<int>, x array<double>"


def _features(query: list[str], cells: list[int], passage: list[str]) -> tuple[list[int], list[float]]:
    own, other = dict(zip(query, cells)), set(passage)
    both = [w for w in own if w in other]
    pairs, others = set(zip(query, query[1:])), set(zip(passage, passage[1:]))
    n = max(len(own), 1)
    x = [1.0, len(both) / n, len(pairs & others) / max(len(pairs), 1), len(both) / max(len(own) + len(other) - len(both), 1), min(np.log1p(len(passage)) / 10, 1.0), float(not own)]
    at = list(range(PLAIN))
    for w, c in own.items():
        at.append(PLAIN + c + (0 if w in other else CELLS))
        x.append(1 / n)
    return at, x


def features(pairs: DataFrame, query: str, passage: str, label: str | None, keep: list[str]) -> DataFrame:
    """The columns to keep, label (0 without one), and the features as places and values; places can repeat."""
    q = terms(F.coalesce(F.col(query), F.lit("")))
    rows = pairs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keep)], (F.lit(0.0) if label is None else F.col(label).cast("double")).alias("label"), q.alias("q"),
                        F.transform(q, lambda w: F.pmod(F.xxhash64(w), F.lit(CELLS)).cast("int")).alias("cells"), terms(F.coalesce(F.col(passage), F.lit(""))).alias("p"))
    schema = T.StructType([*rows.schema.fields[: len(keep)], *T._parse_datatype_string(ROWS).fields])

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [_features(*x) for x in zip(*(part.column(c).to_pylist() for c in ("q", "cells", "p")))]
                lists = [pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep) + 1], *lists], names=schema.names)

    return rows.mapInArrow(run, schema)


def _products(batch: pa.RecordBatch, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size = batch.column("at").value_lengths().to_numpy()
    row, at, x = np.repeat(np.arange(len(size)), size), batch.column("at").flatten().to_numpy(), batch.column("x").flatten().to_numpy()
    return row, at, x, np.bincount(row, w[at] * x, len(size))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


class PairModel:
    def __init__(self, weights: np.ndarray):
        self.weights = weights

    @classmethod
    def train(cls, pairs: DataFrame, query: str, passage: str, label: str = "label", rounds: int = 40, l2: float = 1e-4) -> PairModel:
        """Nesterov's accelerated steps on the mean loss; both labels weigh the same. Pairs without a label teach nothing."""
        rows = stored(features(pairs.where(F.col(label).isNotNull()), query, passage, label, []), "pairs")
        n = {r["label"]: r["n"] for r in rows.groupBy((F.col("label") > 0.5).alias("label")).agg(F.count("*").alias("n")).collect()}
        if not (n.get(True) and n.get(False)):
            return cls(np.concatenate([[(40.0 if n.get(True) else -40.0)], np.zeros(FEATURES - 1)]))
        share = {True: 0.5 / n[True], False: 0.5 / n[False]}
        w = at = np.zeros(FEATURES)
        t, step = 1.0, 4 / (1 + PLAIN + l2)  # a row's features have a square sum of PLAIN + 1 at most
        for _ in range(rounds):
            g = gradient(rows, at, share) + l2 * at
            new, t2 = at - step * g, (1 + np.sqrt(1 + 4 * t * t)) / 2
            at, w, t = new + (t - 1) / t2 * (new - w), new, t2
        return cls(w)

    def score(self, pairs: DataFrame, query: str, passage: str, keep: list[str]) -> DataFrame:
        """The columns to keep and score, a probability."""
        rows = features(pairs, query, passage, None, keep)
        schema = T.StructType([*rows.schema.fields[: len(keep)], T.StructField("score", T.DoubleType())])
        w = self.weights

        def run(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(np.round(sigmoid(_products(batch, w)[3]), 6))], names=schema.names)

        return rows.mapInArrow(run, schema).toDF(*keep, "score")


def gradient(rows: DataFrame, w: np.ndarray, share: dict[bool, float]) -> np.ndarray:
    """The sum over all pairs of the loss's gradient, each pair by its label's share."""

    def run(batches):
        g = np.zeros(FEATURES)
        for batch in batches:
            row, at, x, z = _products(batch, w)
            y = batch.column("label").to_numpy() > 0.5
            d = (sigmoid(z) - y) * np.where(y, share[True], share[False])
            g += np.bincount(at, d[row] * x, FEATURES)
        on = np.flatnonzero(g)
        yield pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array(g[on])], names=["at", "g"])

    got = rows.mapInArrow(run, "at int, g double").groupBy("at").agg(F.sum("g").alias("g")).toArrow()
    out = np.zeros(FEATURES)
    out[got.column("at").to_numpy()] = got.column("g").to_numpy()
    return out
