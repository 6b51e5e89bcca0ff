"""Nearest neighbours, diversity, clusters and statistics of vectors.

Queries are a table too. They are taken in blocks of bounded size; each block is sent to all tasks, which multiply it with their own rows and
keep their best k for each query, so that what is shuffled is k rows for each query and task, whatever the number of rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors as V
from .best import Best, ranked, rounded

#: Bytes of the queries that are sent to all tasks for one scan of the rows.
BLOCK_BYTES = 64 << 20
#: Queries and rows of a matrix product.
QUERIES, ROWS = 512, 2048
#: Queries of a tile of sums of differences, which has eight times as many rows.
TILE = 64
#: Bytes of the vectors that are gathered for pairs.
PAIR_BYTES = 16 << 20


def scores(q: np.ndarray, x: np.ndarray, metric: str) -> np.ndarray:
    """queries x rows; larger is nearer, distances are negative, but for the cosine's (distance)."""
    if metric == "ip":
        return q @ x.T
    if metric == "cosine":
        n = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :]
        return np.divide(q @ x.T, n, out=np.zeros_like(n), where=n > 0)
    if metric == "l2":
        square = (q * q).sum(axis=1)[:, None] + (x * x).sum(axis=1)[None, :] - 2 * (q @ x.T)
        return -np.sqrt(np.maximum(square, 0))
    if metric == "l1":
        out, own, other = np.zeros((len(q), len(x))), np.ascontiguousarray(q.T), np.ascontiguousarray(x.T)
        for lo in range(0, len(q), TILE):  # dimension by dimension over tiles that stay in the cache
            for at in range(0, len(x), 8 * TILE):
                tile = out[lo : lo + TILE, at : at + 8 * TILE]
                far = np.empty_like(tile)
                for a, b in zip(own[:, lo : lo + TILE, None], other[:, None, at : at + 8 * TILE]):
                    np.subtract(a, b, out=far)
                    np.abs(far, out=far)
                    tile -= far
        return out
    if metric == "distance":
        return 1 - scores(q, x, "cosine")
    raise ValueError(f"unknown metric {metric}")


def matrix(column: pa.Array) -> np.ndarray:
    """A column of lists of one length (none of them null) as rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def knn(queries: DataFrame, rows: DataFrame, k: int | None, metric: str = "cosine", query_key: str = "query_id", key: str = "vec_id", vector: str = "embedding", where: Column | None = None, least: float | None = None, digits: int = 4, per: str | None = None, asks: str | None = None) -> DataFrame:
    """query_key, key, score, rank (and per): the k best rows for each query, or for each query and value of per; all of them, ranked, if k is
    None (pairs() gives them without ranks, extremes() and score_counts() what is mostly wanted of them).

    asks: a column of the queries, the list of the values of per that a query wants; all without it.
    Scores are rounded, and ties are ordered by key. where holds before the ranking; least leaves out lower scores. Null vectors and keys are
    left out. An empty table on either side gives an empty result.
    """
    rows = rows.where(where) if where is not None else rows
    rows = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(vector).alias("v"), F.col(key).alias("key"), *([F.col(per).alias("per")] if per else []))
    fields = [T.StructField(query_key, queries.schema[query_key].dataType), T.StructField(key, rows.schema["key"].dataType), T.StructField("score", T.DoubleType())]
    schema = T.StructType(fields + ([T.StructField(per, rows.schema["per"].dataType)] if per else []))
    out = _held(queries, rows, query_key, vector, lambda sent: _near(sent, k, metric, schema.names, least, digits, per is not None), schema, asks)
    return ranked(out, [query_key, *([per] if per else [])], key, k)


def _held(queries: DataFrame, rows: DataFrame, query_key: str, vector: str, run, schema, asks: str | None = None) -> DataFrame:
    """What run(sent) makes of the rows, for each block of the queries: sent holds a block's keys and vectors, and the lists in asks."""
    asked = queries.where(F.col(vector).isNotNull()).select(query_key, vector, *([asks] if asks else []))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("dim")).first()
    blocks = max(1, -(-size["n"] * size["dim"] * 8 // BLOCK_BYTES))
    out = None
    for b in range(blocks):
        own = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b)).toArrow()
        lists = [x or [] for x in own.column(2).to_pylist()] if asks else None
        sent = rows.sparkSession.sparkContext.broadcast((own.column(0).combine_chunks(), matrix(own.column(1).combine_chunks()), lists))
        found = rows.mapInArrow(run(sent), schema)
        out = found if out is None else out.unionByName(found)
    return out


def _parts(sent, batches):
    """Blocks of queries against blocks of rows: where the queries begin, their vectors, the rows' keys and vectors."""
    q = sent.value[1]
    for batch in batches:
        for lo in range(0, batch.num_rows if len(q) else 0, ROWS):
            part = batch.slice(lo, ROWS)
            x = matrix(part.column(0))
            for first in range(0, len(q), QUERIES):
                yield first, q[first : first + QUERIES], part.column(1), x


def _plain(rows: DataFrame, key: str, vector: str) -> DataFrame:
    return rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(vector).alias("v"), F.col(key).alias("key"))


def pairs(queries: DataFrame, rows: DataFrame, metrics: tuple[str, ...] = ("cosine",), query_key: str = "query_id", key: str = "vec_id", vector: str = "embedding", digits: int = 4) -> DataFrame:
    """query_key, key and a column for each metric (distances are positive): every query with every row, in one pass. The result is as large as
    that; nothing is shuffled or held but a block of it."""

    def run(sent):
        def each(batches):
            for first, q, keys, x in _parts(sent, batches):
                n = len(q)
                found = [rounded(np.abs(s) if m in ("l1", "l2") else s, digits) for m in metrics for s in [scores(q, x, m)]]
                ids = sent.value[0].slice(first, n).take(pa.array(np.repeat(np.arange(n), len(x))))
                yield pa.RecordBatch.from_arrays([ids, keys.take(pa.array(np.tile(np.arange(len(x)), n))), *[pa.array(f.ravel()) for f in found]], names=schema.names)

        return each

    own = _plain(rows, key, vector)
    schema = T.StructType([T.StructField(query_key, queries.schema[query_key].dataType), T.StructField(key, own.schema["key"].dataType), *[T.StructField(m, T.DoubleType()) for m in metrics]])
    return _held(queries, own, query_key, vector, run, schema)


def extremes(queries: DataFrame, rows: DataFrame, metric: str = "cosine", query_key: str = "query_id", key: str = "vec_id", vector: str = "embedding", digits: int = 4) -> DataFrame:
    """query_key, most_similar, most, least_similar, least: the rows at both ends, but for those of the query's own key; ties by the lesser key.
    Each task keeps one row for each query and end."""

    def run(sent):
        def each(batches):
            ends, kind = [Best(len(sent.value[0]), 1), Best(len(sent.value[0]), 1)], None
            own = sent.value[0].to_numpy(zero_copy_only=False)
            for first, q, keys, x in _parts(sent, batches):
                kind, names = keys.type, keys.to_numpy(zero_copy_only=False)
                s = rounded(scores(q, x, metric), digits)
                other = own[first : first + len(q), None] != names[None, :]
                for best, sign in zip(ends, (1, -1)):
                    best.add(np.where(other, sign * s, -np.inf), names, first)
            if kind is not None:
                for i, best in enumerate(ends):
                    got = best.batch(sent.value[0], kind, schema.names[:3])
                    yield pa.RecordBatch.from_arrays([*got.columns, pa.array([i] * got.num_rows, pa.int32())], names=schema.names)

        return each

    own = _plain(rows, key, vector)
    schema = T.StructType([T.StructField(query_key, queries.schema[query_key].dataType), T.StructField(key, own.schema["key"].dataType), T.StructField("score", T.DoubleType()), T.StructField("end", T.IntegerType())])
    found = _held(queries, own, query_key, vector, run, schema)
    best = found.groupBy(query_key, "end").agg(F.max("score").alias("score")).join(found, [query_key, "end", "score"]).groupBy(query_key, "end", "score").agg(F.min(key).alias(key))
    at = lambda c, e: F.max(F.when(F.col("end") == e, F.col(c)))
    return best.groupBy(query_key).agg(at(key, 0).alias("most_similar"), at("score", 0).alias("most"), at(key, 1).alias("least_similar"), (-at("score", 1)).alias("least"))


def score_counts(queries: DataFrame, rows: DataFrame, steps: list[float], metric: str = "cosine", query_key: str = "query_id", key: str = "vec_id", vector: str = "embedding", digits: int = 4) -> DataFrame:
    """query_key, step, n: how many rows reach each of the falling steps and none above (its place; one more for those that reach none). Tasks
    count."""

    def run(sent):
        def each(batches):
            n = np.zeros((len(sent.value[0]), len(steps) + 1), np.int64)
            for first, q, _, x in _parts(sent, batches):
                place = np.searchsorted(-np.array(steps), -rounded(scores(q, x, metric), digits), side="left")
                for i in range(len(steps) + 1):
                    n[first : first + len(q), i] += (place == i).sum(axis=1)
            i, j = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([sent.value[0].take(pa.array(i)), pa.array(j, pa.int32()), pa.array(n[i, j])], names=schema.names)

        return each

    schema = T.StructType([T.StructField(query_key, queries.schema[query_key].dataType), T.StructField("step", T.IntegerType()), T.StructField("n", T.LongType())])
    return _held(queries, _plain(rows, key, vector), query_key, vector, run, schema).groupBy(query_key, "step").agg(F.sum("n").alias("n"))


def text_search(queries: DataFrame, docs: DataFrame, embed, k: int, query_key: str = "query_id", key: str = "doc_id", text: str = "text", metric: str = "cosine") -> DataFrame:
    """knn() over texts by an embedding of one's own: embed(df, key, text) gives key and embedding, a list of one length, for each row of df."""
    return knn(embed(queries, query_key, text), embed(docs, key, text), k, metric, query_key=query_key, key=key)


def _near(sent, k, metric, names, least, digits, grouped):
    def run(batches):
        ids, q, asks = sent.value
        best: dict = {}
        wants: dict = {}
        kinds = None
        for batch in batches:
            kinds = [f.type for f in batch.schema][1:]
            for lo in range(0, batch.num_rows if len(q) else 0, ROWS):
                part = batch.slice(lo, ROWS)
                x, keys = matrix(part.column(0)), part.column(1).to_numpy(zero_copy_only=False)
                groups = [(None, np.arange(len(x)))]
                if grouped:
                    coded = part.column(2).dictionary_encode(null_encoding="encode")
                    code = coded.indices.to_numpy()
                    groups = [(v, np.flatnonzero(code == i)) for i, v in enumerate(coded.dictionary.to_pylist())]
                for first in range(0, len(q), QUERIES):
                    s = rounded(scores(q[first : first + QUERIES], x, metric), digits)
                    if least is not None:
                        s[s < least] = -np.inf
                    for v, own in groups:
                        if asks is not None and v not in wants:
                            wants[v] = np.array([v in a for a in asks])
                        near = s[:, own] if asks is None else np.where(wants[v][first : first + QUERIES, None], s[:, own], -np.inf)
                        if k is not None:
                            if v not in best:
                                best[v] = Best(len(q), k)
                            best[v].add(near, keys[own], first)
                            continue
                        i, j = np.nonzero(near > -np.inf)
                        columns = [ids.take(pa.array(i + first)), part.column(1).take(pa.array(own[j])), pa.array(s[:, own][i, j])]
                        yield pa.RecordBatch.from_arrays([*columns, *([pa.array([v] * len(i), kinds[1])] if grouped else [])], names=names)
        for v, b in best.items():
            got = b.batch(ids, kinds[0], names[:3])
            yield got if not grouped else pa.RecordBatch.from_arrays([*got.columns, pa.array([v] * got.num_rows, kinds[1])], names=names)

    return run


def mmr(candidates: DataFrame, k: int = 5, weight: float = 0.7, query_key: str = "query_id", key: str = "vec_id", vector: str = "embedding", score: str = "score") -> DataFrame:
    """Of each query's candidates (a bounded list, as knn() gives), k by maximal marginal relevance: the score, less likeness to those taken."""

    def pick(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values([score, key], ascending=[False, True]).reset_index(drop=True)
        x = np.array([np.asarray(v, float) for v in f[vector]])
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        taken, nearest = [], np.full(len(f), -np.inf)
        relevance = f[score].to_numpy()
        while len(taken) < min(k, len(f)):
            gain = weight * relevance - (1 - weight) * np.where(np.isinf(nearest), 0, nearest)
            gain[taken] = -np.inf
            i = int(np.argmax(np.round(gain, 9)))
            taken.append(i)
            nearest = np.maximum(nearest, x @ x[i])
        return pd.DataFrame({query_key: f[query_key][taken].to_numpy(), key: f[key][taken].to_numpy(), "score": relevance[taken], "rank": np.arange(1, len(taken) + 1)})

    kinds = {c: candidates.schema[c].dataType.simpleString() for c in (query_key, key)}
    return candidates.groupBy(query_key).applyInPandas(pick, f"{query_key} {kinds[query_key]}, {key} {kinds[key]}, score double, rank int")


def drop_redundant(candidates: DataFrame, threshold: float = 0.8, query_key: str = "query_id", key: str = "vec_id", vector: str = "embedding", score: str = "score") -> DataFrame:
    """Of each query's candidates, best first, those that are no nearer than the threshold to one already kept."""

    def pick(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values([score, key], ascending=[False, True]).reset_index(drop=True)
        x = np.array([np.asarray(v, float) for v in f[vector]])
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        kept: list[int] = []
        for i in range(len(f)):
            if not kept or (x[kept] @ x[i]).max() <= threshold:
                kept.append(i)
        return f.loc[kept, [query_key, key, score]]

    kinds = {c: candidates.schema[c].dataType.simpleString() for c in (query_key, key)}
    return candidates.groupBy(query_key).applyInPandas(pick, f"{query_key} {kinds[query_key]}, {key} {kinds[key]}, {score} double")


def dimension_stats(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """A row for each dimension: min, max, mean, standard deviation."""
    rows = df.select(F.posexplode(V.doubles(F.col(vector))).alias("dim", "x"))
    return rows.groupBy("dim").agg(F.min("x").alias("least"), F.max("x").alias("most"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def pca(df: DataFrame, n: int = 2, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Adds the first n principal components. Each task sums its rows' products; these are summed cell by cell over tasks, and a table of the
    dimension's square comes to the driver, however many tasks there are. Null vectors stay, with null components; an empty table stays empty."""

    def partial(batches):
        total, square, count = None, None, 0
        for batch in batches:
            x = matrix(batch.column(0))
            if len(x):
                total = x.sum(0) if total is None else total + x.sum(0)
                square = x.T @ x if square is None else square + x.T @ x
                count += len(x)
        if count:
            d = len(total)
            cell = np.arange(-1 - d, d * d)  # the rows, the sums, the sums of products
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.concatenate([[float(count)], total, square.ravel()]))], names=["cell", "x"])

    sums = df.where(F.col(vector).isNotNull()).select(vector).mapInArrow(partial, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x"))
    got = sums.toArrow().combine_chunks().sort_by("cell")
    if not got.num_rows:
        return df.select("*", *[F.lit(None).cast("double").alias(f"pc{i + 1}") for i in range(n)])
    x = got.column("x").to_numpy()
    d = -1 - got.column("cell")[0].as_py()
    mean = x[1 : d + 1] / x[0]
    cov = x[d + 1 :].reshape(d, d) / x[0] - np.outer(mean, mean)
    axes = np.linalg.eigh(cov)[1][:, ::-1][:, :n]
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(n)] < 0, -1, 1)
    v = V.doubles(F.col(vector))
    return df.select("*", *[(V.dot(v, F.array(*[F.lit(float(a)) for a in axes[:, i]])) - float(mean @ axes[:, i])).alias(f"pc{i + 1}") for i in range(n)])


def kmeans(df: DataFrame, k: int, rounds: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Adds cluster: Lloyd's rounds from the first k vectors by hash of the key; k centres at a time are on the driver. An empty table stays
    empty."""
    first = df.where(F.col(vector).isNotNull()).select(vector, key).orderBy(F.xxhash64(key), key).limit(k).toArrow().combine_chunks()
    if not first.num_rows:
        return df.withColumn("cluster", F.lit(None).cast("int"))
    centers = matrix(first.column(0).combine_chunks())

    for _ in range(rounds):

        def partial(batches, centers=centers):
            n, total = np.zeros(len(centers)), np.zeros_like(centers)
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    x = matrix(batch.column(0).slice(lo, ROWS))
                    c = (scores(x, centers, "l2")).argmax(axis=1)
                    np.add.at(total, c, x)
                    n += np.bincount(c, minlength=len(n))
            c, d = np.indices(total.shape).reshape(2, -1)
            on = n[c] > 0
            yield pa.RecordBatch.from_arrays([pa.array(c[on], pa.int32()), pa.array(d[on], pa.int32()), pa.array(total.ravel()[on]), pa.array(n[c][on])], names=["c", "d", "x", "n"])

        sums = df.where(F.col(vector).isNotNull()).select(vector).mapInArrow(partial, "c int, d int, x double, n double")
        sums = sums.groupBy("c", "d").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).toPandas()
        new = centers.copy()
        new[sums["c"], sums["d"]] = sums["x"] / sums["n"]
        done = np.allclose(new, centers)
        centers = new
        if done:
            break
    table = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centers])
    d = F.transform(table, lambda c: V.l2(F.col(vector), c, squared=True))
    return df.withColumn("_d", d).withColumn("cluster", (F.array_position("_d", F.array_min("_d")) - 1).cast("int")).drop("_d")


def pair_products(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The inner product of q[i] and x[j] for each pair; the vectors of PAIR_BYTES are gathered at once."""
    out, step = np.empty(len(i)), max(1, PAIR_BYTES // max(16 * q.shape[1], 1))
    for lo in range(0, len(i), step):
        out[lo : lo + step] = np.einsum("ij,ij->i", q[i[lo : lo + step]], x[j[lo : lo + step]])
    return out


def lsh_search(queries: DataFrame, rows: DataFrame, k: int, planes: int = 6, tables: int = 24, seed: int = 1, probes: int = 2, query_key: str = "query_id", key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Approximate knn(): rows that share a bucket of random hyperplanes with the query in any of several tables, ranked by cosine. In each
    table a query also asks the buckets across each of the few planes (probes) that it is nearest to. As with knn(), queries are sent to all
    tasks in blocks; a task finds the buckets of its own rows, and compares only what meets there."""
    rows = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(vector).alias("v"), F.col(key).alias("key"))
    asked = queries.where(F.col(vector).isNotNull()).select(query_key, vector)
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("dim")).first()
    blocks = max(1, -(-size["n"] * size["dim"] * 8 // BLOCK_BYTES))
    normals = np.random.default_rng(seed).normal(size=(tables, planes, max(size["dim"], 1)))
    schema = T.StructType([T.StructField(query_key, queries.schema[query_key].dataType), T.StructField(key, rows.schema["key"].dataType), T.StructField("score", T.DoubleType())])

    def buckets(x):
        side = np.einsum("nd,tpd->ntp", x, normals)
        return side, (side > 0) @ (1 << np.arange(planes))

    def near(sent):
        def run(batches):
            ids, q = sent.value
            if not len(q):
                return
            probed = np.empty((len(q), tables, 1 + min(probes, planes)), np.min_scalar_type((1 << planes) - 1))  # queries x tables x buckets asked
            for first in range(0, len(q), QUERIES):
                side, own = buckets(q[first : first + QUERIES])
                across = np.argsort(np.abs(side), axis=2)[:, :, :probes]
                probed[first : first + QUERIES] = np.concatenate([own[:, :, None], own[:, :, None] ^ (1 << across)], axis=2)
            length, best, kind = np.linalg.norm(q, axis=1), Best(len(q), k), None
            for batch in batches:
                kind = batch.schema.field(1).type
                for lo in range(0, batch.num_rows, ROWS):
                    part = batch.slice(lo, ROWS)
                    x, keys = matrix(part.column(0)), part.column(1).to_numpy(zero_copy_only=False)
                    bucket, norm = buckets(x)[1].astype(probed.dtype), np.linalg.norm(x, axis=1)
                    for first in range(0, len(q), QUERIES):
                        some = probed[first : first + QUERIES]
                        meet = np.zeros((len(some), len(x)), bool)
                        for t in range(tables):
                            for p in range(some.shape[2]):
                                meet |= some[:, t, p, None] == bucket[None, :, t]
                        i, j = np.nonzero(meet)
                        n = length[first + i] * norm[j]
                        dot = pair_products(q, x, first + i, j)
                        s = np.full(meet.shape, -np.inf)
                        s[i, j] = rounded(np.divide(dot, n, out=np.zeros_like(n), where=n > 0), 4)
                        best.add(s, keys, first)
            if kind is not None:
                yield best.batch(ids, kind, schema.names)

        return run

    out = None
    for b in range(blocks):
        own = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(query_key), F.lit(blocks)) == b)).toArrow()
        sent = rows.sparkSession.sparkContext.broadcast((own.column(0).combine_chunks(), matrix(own.column(1).combine_chunks())))
        found = rows.mapInArrow(near(sent), schema)
        out = found if out is None else out.unionByName(found)
    return ranked(out, [query_key], key, k)
