"""Language identification by a convolutional network over bytes.

Texts are cut into windows of equal length. Filters of several widths slide over a window's bytes, each gives its greatest response, and a
softmax over these tells the languages apart; a text's answer is the mean over all its windows, weighted by their bytes. The network is
trained in numpy on the driver by gradient descent (Adam), on a bounded, documented sample of windows of labelled texts; prediction reads
every window of every text, in one pass without a shuffle. There a filter's responses come from tables over pairs of byte classes.

Nulls: a null text, or one without letters, is `und` with score 0; a null label teaches nothing. Without labelled texts all are `und`.
Equal texts get equal answers; repeated rows are answered each. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, least_hashed, text_bytes

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 12
#: Classes of bytes: 0 for ASCII that is no letter, letters without case, and each byte of other characters.
CLASS = np.zeros(256, np.int64)
CLASS[97:123] = np.arange(1, 27)
CLASS[65:91] = np.arange(1, 27)
CLASS[128:] = np.arange(27, 155)
CLASSES = 155


class Network:
    """tables[w][k]: classes x filters, what class of byte adds to a filter of width w at its k-th place."""

    def __init__(self, languages: list[str], seed: int = 5):
        r = np.random.default_rng(seed)
        self.languages = languages
        self.tables = [[r.normal(0, 0.3, (CLASSES, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS]
        n = len(WIDTHS) * FILTERS
        self.dense, self.bias = r.normal(0, 0.1, (n, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
        self.shift = np.zeros(n, np.float32)

    def train(self, windows: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 0.02, seed: int = 6) -> None:
        """windows: classes of bytes, a row for each window; y: the place of its language."""
        r = np.random.default_rng(seed)
        flat = [t for w in self.tables for t in w] + [self.dense, self.bias, self.shift]
        m, v, step = [np.zeros_like(t) for t in flat], [np.zeros_like(t) for t in flat], 0
        for _ in range(epochs):
            order = r.permutation(len(y))
            for lo in range(0, len(order), batch):
                i = order[lo : lo + batch]
                g = self._gradient(windows[i], y[i])
                step += 1
                for t, a, b, d in zip(flat, m, v, g):
                    a += 0.1 * (d - a)
                    b += 0.001 * (d * d - b)
                    t -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-7)

    def _gradient(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        n, pooled, where = len(x), [], []
        for w, tables in zip(WIDTHS, self.tables):
            p = WINDOW - w + 1
            a = sum(t[x[:, k : k + p]] for k, t in enumerate(tables))
            at = a.argmax(axis=1)
            pooled.append(np.take_along_axis(a, at[:, None, :], 1)[:, 0])
            where.append(at)
        z = np.concatenate(pooled, axis=1) + self.shift
        h = np.maximum(z, 0)
        p = softmax(h @ self.dense + self.bias)
        p[np.arange(n), y] -= 1
        p /= n
        back = (p @ self.dense.T) * (z > 0)
        out = []
        for j, (tables, at) in enumerate(zip(self.tables, where)):
            own = back[:, j * FILTERS : (j + 1) * FILTERS]
            for k in range(len(tables)):
                g = np.zeros_like(tables[k])
                np.add.at(g, (np.take_along_axis(x, at + k, 1), np.arange(FILTERS)[None, :]), own)
                out.append(g)
        return [*out, h.T @ p, p.sum(axis=0), back.sum(axis=0)]

    def pair_tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For widths 2, 3 and 4: what a pair of classes adds as the first two places, a class as the third one, a pair as the last two."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(CLASSES * CLASSES, FILTERS)
        two, three, four = self.tables
        return np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1])], axis=1), three[2], pair(four[2], four[3])

    def predict(self, windows: np.ndarray, tables) -> np.ndarray:
        """A row of probabilities for each window. The last three bytes of a window begin no filter of width 4, and so on."""
        first, third, last = tables
        out, f = [], FILTERS
        for lo in range(0, len(windows), 128):
            x = windows[lo : lo + 128]
            pair = x[:, :-1] * CLASSES + x[:, 1:]
            a = first[pair]  # windows x 255 x (3 * filters)
            z = np.concatenate([a[:, :, :f].max(axis=1), (a[:, :-1, f : 2 * f] + third[x[:, 2:]]).max(axis=1), (a[:, :-2, 2 * f :] + last[pair[:, 2:]]).max(axis=1)], axis=1)
            out.append(softmax(np.maximum(z + self.shift, 0) @ self.dense + self.bias))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(raw: bytes) -> np.ndarray:
    x = np.zeros(max(1, -(-len(raw) // WINDOW)) * WINDOW, np.int64)
    x[: len(raw)] = CLASS[np.frombuffer(raw, np.uint8)]
    return x.reshape(-1, WINDOW)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = 600, seed: int = 3) -> Network | None:
    """docs: the rows to learn from. per_language texts at most of each language (those with the least hashes of key and text; repeated rows
    once), and two windows of each text, reach the driver."""
    t = F.col(text)
    spot = lambda s: F.substring(t, F.pmod(F.xxhash64(F.col(key), F.lit(s)), F.greatest(F.length(t) - WINDOW, F.lit(1))).cast("int") + 1, F.lit(WINDOW))
    rows = docs.where(F.col(lang).isNotNull() & t.rlike("\\p{L}"))
    rows = rows.select(F.col(lang).alias("lang"), F.xxhash64(F.col(key), t, F.lit(seed)).alias("h"), spot(seed).alias("a"), spot(seed + 1).alias("b"))
    got = least_hashed(rows, ["lang"], per_language).to_pylist()
    languages = sorted({r["lang"] for r in got})
    if not languages:
        return None
    x = [windows_of(w.encode())[0] for r in got for w in (r["a"], r["b"])]
    y = [languages.index(r["lang"]) for r in got for _ in range(2)]
    net = Network(languages)
    net.train(np.array(x), np.array(y))
    return net


def identify(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: key, the columns to keep, lang_pred, score."""

    def run(batches):
        tables = net.pair_tables() if net else None
        names = np.array([*(net.languages if net else []), "und"], object)
        for batch in batches:
            column = batch.column(0)
            letters = pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False)
            best, score = np.full(len(column), len(names) - 1), np.zeros(len(column))
            if net and len(column):
                data, at = text_bytes(column)
                for lo, hi in groups_of(at):
                    n = at[lo + 1 : hi + 1] - at[lo:hi]
                    each = np.maximum(1, -(-n // WINDOW))
                    x = np.zeros(each.sum() * WINDOW, np.int64)
                    to = (np.cumsum(each) - each) * WINDOW
                    x[np.repeat(to - (at[lo:hi] - at[lo]), n) + np.arange(n.sum())] = CLASS[data[at[lo] : at[hi]]]
                    weight = np.full(each.sum(), float(WINDOW))
                    weight[np.cumsum(each) - 1] = n - (each - 1) * WINDOW
                    sums = np.add.reduceat(net.predict(x.reshape(-1, WINDOW), tables) * weight[:, None], np.cumsum(each) - each, axis=0)
                    p = sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-9)
                    best[lo:hi], score[lo:hi] = p.argmax(axis=1), np.clip(p.max(axis=1), 0, 1)
                best[~letters], score[~letters] = len(names) - 1, 0
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names[best], pa.string()), pa.array(np.round(score, 6))], names=[*batch.schema.names[1:], "lang_pred", "score"])

    rows = docs.select(F.col(text).alias("t"), *[F.col(c).alias(f"c{i}") for i, c in enumerate((key, *keep))])
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema).toDF(key, *keep, "lang_pred", "score")


def groups_of(at: np.ndarray) -> list[tuple[int, int]]:
    from .common import slices

    return slices(at, 2 << 20)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    net = train(docs.where(~F.col("held_out")))
    return identify(docs, net, keep=("held_out",))


QUERIES = {"op5_language_id": op5_language_id}
ORACLES: dict[str, str] = {}
