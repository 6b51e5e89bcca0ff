"""A stored index of vectors: an inverted file of cells, and product-quantised codes beside the full vectors.

A coarse quantiser (spherical k-means) and a codebook for each sub-space are fitted in numpy on a bounded sample of rows (those of least hash of
their key). Rows are written by cell, large cells in several files; a search asks each query's nearest cells, and the scan reads the folders of
asked cells alone. With codes=True only the codes are read: a table of each query's dot products with the codebooks gives approximate scores, and
rerank times k candidates of each query can be scored again by their full vectors. How many cells are asked can be measured: calibrate() takes the
least number that reaches a recall on sampled rows, against exact search over all rows.

Scores are cosines; a vector of zeros has cosine 0 with all. Null vectors and keys are left out; repeated rows are rows of their own. An empty table
gives an index without rows. Every query row is answered from the cells it asks, with fewer than k rows if these have no more.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .best import Best, ranked, rounded
from .vector import BLOCK_BYTES, QUERIES, ROWS, knn, matrix

#: Centres of a sub-space: a code is one byte.
CODES = 256


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def centres(x: np.ndarray, k: int, spherical: bool, rounds: int = 15, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds from random rows; an empty centre takes the row that is farthest from its own."""
    r = np.random.default_rng(seed)
    if len(x) <= k:
        return x.copy()
    c = x[r.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near, far = nearest(x, c)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        new = sums / np.maximum(n, 1)[:, None]
        for i, j in zip(np.flatnonzero(n == 0), np.argsort(-far)):
            new[i] = x[j]
        new = unit(new) if spherical else new
        if np.allclose(new, c):
            break
        c = new
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row and the square of its distance."""
    near, far = np.empty(len(x), np.int64), np.empty(len(x))
    for lo in range(0, len(x), 4096):
        d = (c * c).sum(axis=1)[None, :] - 2 * x[lo : lo + 4096] @ c.T
        near[lo : lo + 4096] = d.argmin(axis=1)
        far[lo : lo + 4096] = d.min(axis=1) + (x[lo : lo + 4096] ** 2).sum(axis=1)
    return near, far


class Books:
    """The coarse quantiser and the codebooks: cells x dimensions; sub-spaces x codes x dimensions of each."""

    def __init__(self, cells: np.ndarray, books: list[np.ndarray]):
        self.cells, self.books = cells, books

    @classmethod
    def fit(cls, x: np.ndarray, cells: int, subspaces: int) -> Books:
        x = unit(x)
        return cls(centres(x, cells, True), [centres(part, CODES, False, seed=i) for i, part in enumerate(np.array_split(x, subspaces, axis=1))])

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A row of bytes for each vector."""
        parts = np.array_split(unit(x), len(self.books), axis=1)
        return np.column_stack([nearest(p, b)[0] for p, b in zip(parts, self.books)]).astype(np.uint8)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """For each sub-space: queries x codes, the part of the dot product."""
        return [p @ b.T for p, b in zip(np.array_split(unit(q), len(self.books), axis=1), self.books)]

    def order(self, q: np.ndarray) -> np.ndarray:
        """The cells of each query, the nearest first."""
        return np.argsort(-(unit(q) @ self.cells.T), axis=1, kind="stable")


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str, key: str = "vec_id", vector: str = "embedding"):
        self.spark, self.path, self.key, self.vector = spark, path.rstrip("/"), key, vector

    def build(self, rows: DataFrame, cells: int | None = None, subspaces: int = 16, sample: int = 20_000, file_rows: int = 1 << 20) -> None:
        """cells: about four times the square root of the rows if it isn't given, and 4,096 at most. file_rows: rows of a cell in one file."""
        rows = rows.where(F.col(self.vector).isNotNull() & F.col(self.key).isNotNull()).select(F.col(self.key).alias("key"), F.col(self.vector).cast("array<double>").alias("v"))
        n = rows.count()
        h = F.xxhash64("key")
        limit = F.lit((min(1.0, (1.25 * sample + 50) / max(n, 1)) - 0.5) * float(1 << 64))
        some = rows.where(h.cast("double") <= limit).select("v", h.alias("h"), "key").toArrow().combine_chunks().sort_by([("h", "ascending"), ("key", "ascending")]).slice(0, sample)
        x = matrix(some.column(0).combine_chunks()) if some.num_rows else np.zeros((0, 1))
        books = Books.fit(x, cells or max(1, min(4096, int(4 * np.sqrt(n)))), min(subspaces, max(x.shape[1], 1))) if len(x) else Books(np.zeros((1, 1)), [np.zeros((1, 1))])
        model = [(-1, i, c.tolist()) for i, c in enumerate(books.cells)] + [(s, i, c.tolist()) for s, b in enumerate(books.books) for i, c in enumerate(b)]
        self.spark.createDataFrame(model, "part int, i int, x array<double>").coalesce(1).write.parquet(f"{self.path}/books")
        sent = self.spark.sparkContext.broadcast(books)

        def place(batches):
            b = sent.value
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    part = batch.slice(lo, ROWS)
                    own = matrix(part.column(1))
                    cell = (unit(own) @ b.cells.T).argmax(axis=1) if len(own) else np.zeros(0, int)
                    codes = pa.array([c.tobytes() for c in b.codes(own)], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1).cast(pa.list_(pa.float32())), codes, pa.array(cell, pa.int32())], names=["key", "v", "code", "cell"])

        kind = rows.schema["key"].dataType.simpleString()
        placed = rows.mapInArrow(place, f"key {kind}, v array<float>, code binary, cell int")
        # a cell's rows go to as many tasks as it has files
        files = {r["cell"]: -(-r["n"] // file_rows) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > file_rows).collect()}  # cells are 4,096 at most
        salt = F.lit(0).cast("long")
        for cell, m in files.items():
            salt = F.when(F.col("cell") == cell, F.pmod(F.xxhash64("key"), F.lit(m))).otherwise(salt)
        placed.repartition("cell", salt).write.partitionBy("cell").option("compression", "zstd").parquet(f"{self.path}/rows")

    def books(self) -> Books:
        got = self.spark.read.parquet(f"{self.path}/books").toArrow().to_pylist()
        part = lambda p: np.array([r["x"] for r in sorted((r for r in got if r["part"] == p), key=lambda r: r["i"])])
        return Books(part(-1), [part(s) for s in range(1 + max(r["part"] for r in got))])

    def rows(self, kind: str = "bigint") -> DataFrame:
        return self.spark.read.schema(f"key {kind}, v array<float>, code binary, cell int").parquet(f"{self.path}/rows")

    def search(self, queries: DataFrame, k: int, probes: int, codes: bool = False, rerank: int = 0, query_key: str = "query_id") -> DataFrame:
        """query_key, key, score, rank: the best k rows of the probes nearest cells of each query."""
        found = self._near(queries, k * max(rerank, 1), probes, codes, query_key)
        if not (codes and rerank):
            return ranked(found, [query_key], self.key, k)
        best = ranked(found, [query_key], self.key, k * rerank).select(query_key, self.key)
        full = self.rows(found.schema[self.key].dataType.simpleString()).select(F.col("key").alias(self.key), F.col("v").cast("array<double>").alias("_v"))
        dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        both = best.join(queries.select(query_key, F.col(self.vector).cast("array<double>").alias("_q")), query_key).join(full, self.key)
        norm = F.sqrt(dot("_q", "_q") * dot("_v", "_v"))
        exact = both.select(query_key, self.key, F.when(norm > 0, F.round(dot("_q", "_v") / norm, 4)).otherwise(0.0).alias("score"))
        return ranked(exact, [query_key], self.key, k)

    def _near(self, queries: DataFrame, k: int, probes: int, codes: bool, query_key: str) -> DataFrame:
        books = self.books()
        asked = queries.where(F.col(self.vector).isNotNull()).select(query_key, F.col(self.vector).cast("array<double>"))
        size = asked.agg(F.count("*").alias("n")).first()["n"]
        width = books.cells.shape[1] + len(books.cells) // 8 + (CODES * len(books.books) if codes else 0)
        blocks = max(1, -(-size * width * 8 // BLOCK_BYTES))
        kind = self.spark.read.parquet(f"{self.path}/rows").schema["key"].dataType if size else T.LongType()
        schema = T.StructType([T.StructField(query_key, queries.schema[query_key].dataType), T.StructField(self.key, kind), T.StructField("score", T.DoubleType())])
        out = None
        for b in range(blocks):
            own = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b)).toArrow().combine_chunks()
            if not own.num_rows:
                continue
            q = matrix(own.column(1).combine_chunks())
            order = books.order(q)[:, :probes]
            asks = np.zeros((len(q), len(books.cells)), bool)
            np.put_along_axis(asks, order, True, axis=1)
            cells = np.flatnonzero(asks.any(axis=0)).tolist()
            sent = self.spark.sparkContext.broadcast((own.column(0).combine_chunks(), unit(q), asks, books.tables(q) if codes else None))
            rows = self.rows(kind.simpleString()).where(F.col("cell").isin(cells)).select("key", "cell", "code" if codes else "v")
            found = rows.mapInArrow(_scores(sent, k, schema.names), schema)
            out = found if out is None else out.unionByName(found)
        return self.spark.createDataFrame([], schema) if out is None else out

    def probed(self, queries: DataFrame, probes: int, query_key: str = "query_id") -> DataFrame:
        """query_key, rows of the cells that its search reads, rows of the index."""
        books = self.books()
        sizes = {r["cell"]: r["n"] for r in self.rows().groupBy("cell").agg(F.count("*").alias("n")).collect()}
        size = np.array([sizes.get(i, 0) for i in range(len(books.cells))])

        def run(batches):
            for batch in batches:
                q = matrix(batch.column(1))
                read = size[books.order(q)[:, :probes]].sum(axis=1) if len(q) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(read, pa.int64()), pa.array(np.full(len(q), size.sum()), pa.int64())], names=[query_key, "rows_read", "rows"])

        asked = queries.where(F.col(self.vector).isNotNull()).select(query_key, F.col(self.vector).cast("array<double>"))
        return asked.mapInArrow(run, f"{query_key} {queries.schema[query_key].dataType.simpleString()}, rows_read long, rows long")

    def calibrate(self, recall: float = 0.9, k: int = 5, sampled: int = 200, seed: int = 23) -> int:
        """The least number of cells that finds so large a share of the k true neighbours of sampled rows (those of least hash)."""
        kind = self.spark.read.parquet(f"{self.path}/rows").schema
        if "key" not in kind.names:
            return 1
        rows = self.rows(kind["key"].dataType.simpleString()).select("key", "cell", F.col("v").cast("array<double>").alias("v"))
        n = rows.count()
        h = F.xxhash64("key", F.lit(seed))
        some = rows.where(h.cast("double") <= (min(1.0, (1.25 * sampled + 50) / max(n, 1)) - 0.5) * float(1 << 64)).select(F.col("key").alias("query_id"), "v", h.alias("h")).orderBy("h", "query_id").limit(sampled)
        true = knn(some, rows, k, key="key", vector="v").select("query_id", "key").join(rows.select("key", "cell"), "key")
        got = true.join(some.select("query_id", "v"), "query_id").select("cell", "v").toArrow().combine_chunks()  # k rows of each sampled one
        if not got.num_rows:
            return 1
        place = np.argsort(self.books().order(matrix(got.column(1).combine_chunks())), axis=1)[np.arange(got.num_rows), got.column(0).to_numpy()]
        return 1 + int(np.quantile(place, recall, method="higher"))


def _scores(sent, k: int, names: list[str]):
    def run(batches):
        ids, q, asks, tables = sent.value
        best, kind = Best(len(q), k), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                keys, cell = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy()
                if tables is None:
                    x = unit(matrix(part.column(2)))
                else:
                    code = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint8).reshape(len(keys), -1)
                for first in range(0, len(q), QUERIES):
                    own = slice(first, first + QUERIES)
                    s = q[own] @ x.T if tables is None else sum(t[own][:, code[:, m]] for m, t in enumerate(tables))
                    best.add(np.where(asks[own][:, cell], rounded(s, 4), -np.inf), keys, first)
        if kind is not None:
            yield best.batch(ids, kind, names)

    return run
