"""Toxicity by a classifier chain.

Categories are predicted one after the other: each has a sparse logistic model over the words that a text has (in lower case, by hash), and
over the probabilities of the categories before it. While a later model is trained, those are out-of-fold predictions, so that it learns how
far to trust them. L1 penalties leave a few hundred words with a weight, so that a long clean text gathers no weight by its length.

The models are fitted on the driver on a bounded, documented sample of labelled rows (per_group rows of each combination of labels, those with
the least hashes of the identifier, and of those as many as have most_features features together); scoring reads every row and whole texts,
in one pass without a shuffle. Nulls: a null text has no words; rows of labels with a null category or identifier teach nothing. Without
labels, or with one class only, a category's probability is its share of the rows (0 without rows). Repeated rows of labels count once, with a
category that any of them has; of several documents with one identifier, the one whose text has the least hash teaches. Empty tables give
empty results. Columns of any other name stay as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import AT_ONCE, LOWER, documents, hash_spans, least_hashed, materialize, mix64, release, shares, slices, text_bytes, word_spans

BITS = 18
#: Words end at any ASCII character but letters, digits and the apostrophe.
BREAK = np.array([b < 128 and not chr(b).isalnum() and b != 0x27 for b in range(256)])


#: Besides whole words, their first bytes are features: inflected and compound words share them.
PREFIXES = (3, 4, 5, 6, 7)


def _words(data: np.ndarray, at: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the words of each text and of their beginnings, with repeats: each at one of 2 ** 18 places by its hash (words that
    share a place share a weight)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s, e, texts = word_spans(data, at, BREAK)
    data, row = LOWER[data], np.repeat(np.arange(len(at) - 1), np.diff(texts))
    rows, places = [], []
    for k in (0, *PREFIXES):
        some = np.flatnonzero(e - s > k) if k else slice(None)
        h = hash_spans(data, s[some], s[some] + k if k else e)
        f = (mix64(h + np.uint64(k)) >> np.uint64(64 - BITS)).astype(np.int64)
        own = row[some]
        if wanted is not None:
            hit = wanted[f]
            own, f = own[hit], f[hit]
        rows.append(own)
        places.append(f)
    return np.concatenate(rows), np.concatenate(places)


def features(column: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of each different feature of each text, in order; wanted keeps some features only."""
    data, at = text_bytes(column)
    out = [np.zeros(0, np.int64)]
    for lo, hi in slices(at):
        begin, end = int(at[lo]), int(at[hi])
        while begin < end:  # a very long text comes in parts, cut between words
            stop = end
            if hi == lo + 1 and end - begin > 2 * AT_ONCE:
                stop = begin + AT_ONCE
                while stop < end and not BREAK[data[stop]]:
                    stop += 1
            row, f = _words(data[begin:stop], np.clip(at[lo : hi + 1], begin, stop) - begin, wanted)
            out.append(np.unique((row + lo) << BITS | f))
            begin = stop
    both = np.unique(np.concatenate(out))
    return both >> BITS, both & ((1 << BITS) - 1)


#: Numbers that are worked on at once; the driver holds the whole sample once only.
PIECE = 1 << 20


def _those(row: np.ndarray, f: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where f is one of the places (sorted): the row, and which place."""
    rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lo in range(0, len(f) if len(places) else 0, PIECE):
        part = f[lo : lo + PIECE]
        i = np.minimum(np.searchsorted(places, part), len(places) - 1)
        hit = places[i] == part
        rows.append(row[lo : lo + PIECE][hit].astype(np.int64))
        found.append(i[hit])
    return np.concatenate(rows), np.concatenate(found)


@dataclass
class Linear:
    """Weights of words (place, weight), of the earlier categories' probabilities, and the bias."""

    places: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    bias: float

    def logits(self, row: np.ndarray, f: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        out = np.full(n, self.bias) + earlier @ self.chain
        if len(self.places):
            row, i = _those(row, f, self.places)
            out += np.bincount(row, self.weights[i], n)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit(row: np.ndarray, f: np.ndarray, n: int, earlier: np.ndarray, y: np.ndarray, l1: float = 2e-3, steps: int = 250, most: int = 1000, least_z: float = 4.0) -> Linear:
    """L1-penalised logistic regression by accelerated proximal steps, over the features (most at most) whose shares differ most
    significantly between the classes; classes weigh the same, and neither bias nor chain is penalised."""
    share = float(y.mean()) if n else 0.0
    if not 0 < share < 1:
        return Linear(np.zeros(0, np.int64), np.zeros(0), np.zeros(earlier.shape[1]), 40.0 if share else -40.0)
    count, positive = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS)
    for lo in range(0, len(f), PIECE):
        count += np.bincount(f[lo : lo + PIECE], minlength=1 << BITS)
        positive += np.bincount(f[lo : lo + PIECE], y[row[lo : lo + PIECE]], 1 << BITS)
    used = np.flatnonzero(count)
    count, positive = count[used], positive[used]
    n1, p = y.sum(), count / n
    z = np.abs(positive / n1 - (count - positive) / (n - n1)) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n1 + 1 / (n - n1)))
    chosen = np.sort(np.argsort(np.where(count >= 5, -z, 0), kind="stable")[:most])
    chosen = chosen[(count[chosen] >= 5) & (z[chosen] >= least_z)]
    used = used[chosen]
    row, col = _those(row, f, used)
    m, k = len(used), earlier.shape[1]
    weight = np.where(y > 0, 0.5 / n1, 0.5 / (n - n1))

    scale = 1 / np.sqrt(np.maximum(np.bincount(col, weight[row], m), 1e-9))  # rare words move as fast as common ones

    def times(v):
        return np.bincount(row, (v[:m] * scale)[col], n) + earlier @ v[m : m + k] + v[-1]

    def back(r):
        return np.concatenate([np.bincount(col, r[row], m) * scale, earlier.T @ r, [r.sum()]])

    v = np.ones(m + k + 1)
    for _ in range(20):  # the largest curvature, by powers
        v = back(weight * times(v / np.linalg.norm(v)))
    step = 3.6 / np.linalg.norm(v)
    w, at, t = np.zeros(m + k + 1), np.zeros(m + k + 1), 1.0
    for _ in range(steps):
        new = at - step * back(weight * (sigmoid(times(at)) - y))
        new[:m] = np.sign(new[:m]) * np.maximum(np.abs(new[:m]) - step * l1, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, w, t = new + (t - 1) / t2 * (new - w), new, t2
    on = np.flatnonzero(w[:m])
    return Linear(used[on], (w[:m] * scale)[on], w[m : m + k], float(w[-1]))


class Chain:
    def __init__(self, categories: list[str], models: list[Linear], shares: list[float | None]):
        self.categories, self.models, self.shares = categories, models, shares
        self.wanted = np.zeros(1 << BITS, bool)
        for m in models:
            self.wanted[m.places] = True

    @classmethod
    def train(cls, categories: list[str], row: np.ndarray, f: np.ndarray, labels: np.ndarray, fold: np.ndarray, folds: int = 3) -> Chain:
        """labels: a column of 0 and 1 for each category; fold: each row's fold."""
        n, models, shares = len(labels), [], []
        earlier = np.zeros((n, 0))
        for c in range(len(categories)):
            y = labels[:, c].astype(float)
            models.append(fit(row, f, n, earlier, y))
            shares.append(float(y.mean()) if n and 0 < y.mean() < 1 else None if n else 0.0)
            if c + 1 == len(categories):
                break
            out = np.zeros(n)
            for k in range(folds):
                rest, own = fold != k, fold == k
                place = np.cumsum(rest) - 1
                inside = rest[row]
                m = fit(place[row[inside]], f[inside], int(rest.sum()), earlier[rest], y[rest])
                out[own] = sigmoid(m.logits(row, f, n, earlier))[own]
            earlier = np.column_stack([earlier, out])
        return cls(categories, models, shares)

    def predict(self, column: pa.Array) -> np.ndarray:
        """A column of probabilities for each category."""
        n = len(column)
        row, f = features(column, self.wanted)
        p = np.zeros((n, 0))
        for m, share in zip(self.models, self.shares):
            own = sigmoid(m.logits(row, f, n, p)) if share is None or 0 < share < 1 else np.full(n, share)
            p = np.column_stack([p, own])
        return p


def train(docs: DataFrame, labels: DataFrame, categories: list[str], key: str = "doc_id", text: str = "text", per_group: int = 1500, folds: int = 3, seed: int = 11, most_features: int = 8_000_000) -> Chain:
    """labels: key and a column of 0 and 1 for each category. The sample is bounded by per_group rows of each combination of labels, and what
    it brings to the driver by most_features numbers of 4 bytes."""
    good = F.lit(True)
    for c in [key, *categories]:
        good = good & F.col(c).isNotNull()
    rows = labels.where(good).select(F.col(key).cast("long").alias("k"), *[(F.col(c) > 0).cast("int").alias(f"y{i}") for i, c in enumerate(categories)])
    ys = [f"y{i}" for i in range(len(categories))]
    rows = rows.groupBy("k").agg(*[F.max(y).alias(y) for y in ys]).withColumn("h", F.xxhash64("k", F.lit(seed)))
    sample = least_hashed(rows, ys, per_group)

    def run(batches):
        for batch in batches:
            for some in shares(batch, 1):
                row, f = features(some.column(1))
                at = np.searchsorted(row, np.arange(some.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(f.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([some.column(0), *some.columns[2:], lists], names=["k", "h", *ys, "f"])

    chosen = F.broadcast(docs.sparkSession.createDataFrame(sample.to_pylist() or [], "h long, k long, " + ", ".join(f"{y} int" for y in ys)))
    texts = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).join(chosen, "k")
    texts = texts.groupBy("k", "h", *ys).agg(F.min(F.struct(F.xxhash64("t").alias("th"), "t")).alias("t")).select("k", "t.t", "h", *ys)
    found = materialize(texts.mapInArrow(run, ", ".join(["k long, h long", *[f"{y} int" for y in ys], "f array<int>"])), "features")
    sizes = sorted((r["h"], r["k"], r["n"]) for r in found.select("h", "k", F.size("f").alias("n")).collect())
    within = np.cumsum([n for _, _, n in sizes]) <= most_features
    last = sizes[int(within.sum()) - 1][0] if within.any() else None
    got = found.where(F.lit(False) if last is None else F.col("h") <= F.lit(last)).toArrow().combine_chunks().sort_by([("k", "ascending")])
    release(found)
    n = got.num_rows
    y = np.column_stack([got.column(c).to_numpy() for c in ys]) if n else np.zeros((0, len(ys)))
    lists = got.column("f").combine_chunks() if n else None
    row = np.repeat(np.arange(n, dtype=np.int32), lists.value_lengths().to_numpy()) if n else np.zeros(0, np.int32)
    f = lists.flatten().to_numpy() if n else np.zeros(0, np.int32)
    fold = np.array([(k * 2654435761 >> 7) % folds for k in got.column("k").to_pylist()], np.int64)
    return Chain.train(categories, row, f, y, fold, folds)


def score(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: key, a probability p_<category> for each category, and whether the last one's reaches the threshold."""

    def run(batches):
        for batch in batches:
            for some in shares(batch, 1):
                p = chain.predict(some.column(1))
                columns = [some.column(0), *[pa.array(np.round(p[:, i], 6)) for i in range(p.shape[1])], pa.array(p[:, -1] >= threshold)]
                yield pa.RecordBatch.from_arrays(columns, names=["k", *names, "toxic"])

    names = [f"p_{c}" for c in chain.categories]
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    schema = T.StructType([rows.schema["k"], *[T.StructField(x, T.DoubleType()) for x in names], T.StructField("toxic", T.BooleanType())])
    return rows.mapInArrow(run, schema).withColumnRenamed("k", key)


def drop_toxic(docs: DataFrame, chain: Chain, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents below the threshold, with all their columns."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            for some in shares(batch, at):
                p = chain.predict(some.column(at))
                yield some.filter(pa.array(p[:, -1] < threshold))

    return docs.mapInArrow(run, docs.schema)


#: The categories of the table labels, in the chain's order.
CATEGORIES = ["low_quality", "toxic"]


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, train(docs, labelled(spark, sf_dir), CATEGORIES))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
