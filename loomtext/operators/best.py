"""The best rows of many queries at once, kept within a task, so that k rows for each query and task are all that is shuffled."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Halves go up, as SQL rounds what is positive."""
    return np.floor(x * 10**digits + 0.5) / 10**digits


class Best:
    """For each query the k rows with the highest scores, ties by the lesser key, of all that were added."""

    def __init__(self, queries: int, k: int):
        self.k, self.limit = k, np.full(queries, -np.inf)
        self.query, self.score, self.key = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, scores: np.ndarray, keys: np.ndarray, first: int = 0) -> None:
        """scores: queries (from the first one on) x rows; minus infinity leaves a row out."""
        n, k = scores.shape[1], self.k
        if not scores.size:
            return
        own = slice(first, first + scores.shape[0])
        limit = self.limit[own]
        if n > k:  # k rows of these reach the k-th best of them
            limit = np.maximum(limit, np.partition(scores, n - k, axis=1)[:, n - k])
        q, r = np.nonzero((scores >= limit[:, None]) & (scores > -np.inf))
        if not len(q):
            return
        query, score = np.concatenate([self.query, q + first]), np.concatenate([self.score, scores[q, r]])
        key = keys[r] if self.key is None else np.concatenate([self.key, keys[r]])
        code = key if key.dtype != object else np.unique(key, return_inverse=True)[1]
        order = np.lexsort((code, -score, query))
        query = query[order]
        place = np.arange(len(order)) - np.searchsorted(query, query)
        order = order[place < k]
        self.query, self.score, self.key = query[place < k], score[order], key[order]
        last = place[place < k] == k - 1
        self.limit[self.query[last]] = self.score[last]

    def batch(self, ids: pa.Array, kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
        """Query, key and score of what is kept."""
        key = pa.array([] if self.key is None else self.key, kind)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(self.query)), key, pa.array(self.score)], names=names)


def ranked(found: DataFrame, by: list[str], key: str, k: int | None) -> DataFrame:
    """Adds rank over what the tasks have kept."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), key)
    out = found.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)
