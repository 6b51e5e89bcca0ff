"""Lexical ranking: postings, TF-IDF, BM25, keyword counts. Queries are a table, so that many cost one job.

Documents are ranked where they are read: the queries' terms are sent to all tasks, a pass over the documents keeps what they have of these terms
as a table, and from that frequencies are counted and each task scores its own documents against all queries by matrix products, keeping its best
k for each query. So documents are tokenised once, and no text is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..sources.shared import stored
from .best import Best, ranked, rounded
from .pieces import list_pieces


def terms(t: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(t), F.lit(X.WORDS), F.lit(0))


def postings(df: DataFrame, key: str, text: str, tokens=terms) -> DataFrame:
    """term, key, tf; partial sums are made before the shuffle."""
    return df.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy("term", key).agg(F.count("*").alias("tf"))


def top(df: DataFrame, query_key: str, key: str, k: int, score: str = "score") -> DataFrame:
    w = Window.partitionBy(query_key).orderBy(F.desc(score), key)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Bytes of the queries' terms that are held against all documents in one scan; more queries take several.
ASKED_BYTES = 64 << 20
#: Queries of a matrix product, and cells of its largest matrix.
BLOCK, CELLS = 256, 1 << 22


class _Asked:
    """The queries' terms, sparse: ids; for each block of queries its (term, query, times) in the order of terms."""

    def __init__(self, rows: pa.Table):
        self.ids = rows.column(0).combine_chunks()
        words = rows.column(1).combine_chunks()
        size = words.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        flat = words.flatten().dictionary_encode() if len(words) else pa.array([], pa.string()).dictionary_encode()
        self.terms = {t: i for i, t in enumerate(flat.dictionary.to_pylist())}
        query, term, n = np.repeat(np.arange(len(size)), size), flat.indices.to_numpy().astype(np.int64), max(len(self.terms), 1)
        both, times = np.unique((query // BLOCK * n + term) * BLOCK + query % BLOCK, return_counts=True)
        cell, q = both // BLOCK, both % BLOCK
        self.blocks = []
        for first in range(0, len(size), BLOCK):
            lo, hi = np.searchsorted(cell, [first // BLOCK * n, (first // BLOCK + 1) * n])
            self.blocks.append((first, (cell[lo:hi] % n).astype(np.int32), q[lo:hi].astype(np.int16), times[lo:hi].astype(np.int32)))

    def counts(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of documents' word lists: (document, term, number) of the terms that are asked for."""
        flat = words.flatten().dictionary_encode()
        code = np.array([self.terms.get(t, -1) for t in flat.dictionary.to_pylist()], np.int64)
        size = words.value_lengths().fill_null(0).to_numpy()
        term = code[flat.indices.to_numpy()] if len(flat) else np.zeros(0, np.int64)
        doc = np.repeat(np.arange(len(words)), size)[term >= 0]
        both, n = np.unique(doc * max(len(self.terms), 1) + term[term >= 0], return_counts=True)
        return both // max(len(self.terms), 1), both % max(len(self.terms), 1), n

    def scores(self, docs: int, doc: np.ndarray, term: np.ndarray, value: np.ndarray):
        """For each block: its first query, and the sums of value * times of queries x documents. Only terms that these documents have, and that the
        block asks for, are cells of the matrices; of more terms than CELLS allow, so many at a time."""
        for first, asked, q, times in self.blocks:
            width = min(BLOCK, len(self.ids) - first)
            out = np.zeros((width, docs))
            present = np.intersect1d(asked, term)
            step = max(1, CELLS // max(docs, width))
            for lo in range(0, len(present), step):
                some = present[lo : lo + step]
                at, own = np.searchsorted(some, term), np.searchsorted(some, asked)
                hit, wanted = some[np.minimum(at, len(some) - 1)] == term, some[np.minimum(own, len(some) - 1)] == asked
                m, t = np.zeros((docs, len(some))), np.zeros((width, len(some)))
                m[doc[hit], at[hit]] = value[hit]
                t[q[wanted], own[wanted]] = times[wanted]
                out += t @ m.T
            yield first, out


class Way:
    """A ranking: how many rows, digits of the score, a document's length as a column (or None for the number of its words), and weigh(tf, lengths,
    df, documents, total length), each term's part of a score."""

    def __init__(self, k: int, digits: int, length: Column | None, weigh):
        self.k, self.digits, self.length, self.weigh = k, digits, length, weigh


def rank(queries: DataFrame, docs: DataFrame, ways: list[Way], query_key: str = "query_id", key: str = "doc_id", text: str = "text", tokens=terms) -> list[DataFrame]:
    """query_key, key, score, rank for each way. The documents are tokenised once, whatever the number of ways: what they have of the asked terms
    is kept as a table, from which frequencies are counted and scores worked out. Null texts have no words; rows without key are counted but not
    found."""
    spark = docs.sparkSession
    plain = [(w.k, w.digits, w.length is None, w.weigh) for w in ways]  # what tasks are sent: no columns
    asked = queries.select(query_key, tokens(F.col(text)).alias("words"))
    size = asked.agg(F.coalesce(F.sum(F.size("words").cast("long") * 16 + F.length(F.array_join("words", ""))), F.lit(0)).alias("n")).first()["n"]
    scans = max(1, -(-size // ASKED_BYTES))
    given = [w.length.cast("long") for w in ways if w.length is not None]
    words = docs.select(F.col(key).alias("key"), tokens(F.col(text)).alias("words"), *[c.alias(f"n{i}") for i, c in enumerate(given)])
    kinds = [queries.schema[query_key].dataType, docs.schema[key].dataType]
    schema = T.StructType([T.StructField(query_key, kinds[0]), T.StructField(key, kinds[1]), T.StructField("score", T.DoubleType()), T.StructField("way", T.IntegerType())])
    lengths = [T.StructField(f"n{i}", T.LongType()) for i in range(len(ways))]
    counted = T.StructType([T.StructField("key", kinds[1]), *lengths, T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])
    names, out = counted.names, None
    for scan in range(scans):
        some = asked if scans == 1 else asked.where(F.pmod(F.xxhash64(query_key), F.lit(scans)) == scan)
        sent = spark.sparkContext.broadcast(_Asked(some.toArrow()))

        def count(batches, sent=sent):
            for batch in batches:
                for part in list_pieces(batch):
                    doc, term, n = sent.value.counts(part.column(1))
                    ends = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)), pa.int32())
                    own, k = [], 2
                    for _, _, counted_words, _ in plain:
                        own.append(part.column(1).value_lengths().cast(pa.int64()) if counted_words else part.column(k))
                        k += not counted_words
                    lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (term, n)]
                    yield pa.RecordBatch.from_arrays([part.column(0), *[x.fill_null(0) for x in own], *lists], names=names)

        rows = stored(words.mapInArrow(count, counted), "counts")
        sums = rows.agg(F.count("*"), *[F.coalesce(F.sum(f.name), F.lit(0)) for f in lengths]).first()
        found = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).toArrow()  # a row for each asked term
        df = np.ones(max(len(sent.value.terms), 1))
        df[found.column("term").to_numpy()] = found.column("n").to_numpy()

        def score(batches, sent=sent, stats=(df, sums)):
            q, (df, sums) = sent.value, stats
            best, kind = [Best(len(q.ids), k) for k, _, _, _ in plain], None
            for batch in batches:
                kind = batch.schema.field(0).type
                for lo in range(0, batch.num_rows, 1024):
                    part = batch.slice(lo, 1024)
                    size = part.column("terms").value_lengths().to_numpy()
                    doc, term, tf = np.repeat(np.arange(part.num_rows), size), part.column("terms").flatten().to_numpy(), part.column("tfs").flatten().to_numpy().astype(float)
                    keys = part.column(0).to_numpy(zero_copy_only=False)
                    for i, ((_, digits, _, weigh), b) in enumerate(zip(plain, best)):
                        n = part.column(f"n{i}").to_numpy().astype(float)
                        value = weigh(tf, n[doc], df[term], sums[0], sums[1 + i])
                        for first, s in q.scores(part.num_rows, doc, term, value):
                            s = rounded(s, digits)
                            b.add(np.where(s > 0, s, -np.inf), keys, first)
            if kind is not None:
                for i, b in enumerate(best):
                    got = b.batch(q.ids, kind, schema.names[:3])
                    yield pa.RecordBatch.from_arrays([*got.columns, pa.array([i] * got.num_rows, pa.int32())], names=schema.names)

        part = rows.where(F.col("key").isNotNull()).mapInArrow(score, schema)
        out = part if out is None else out.unionByName(part)
    if len(ways) == 1:
        return [ranked(out.drop("way"), [query_key], key, ways[0].k)]
    best = stored(out, "best")  # k rows of each query, way and task
    return [ranked(best.where(F.col("way") == i).drop("way"), [query_key], key, w.k) for i, w in enumerate(ways)]


def bm25_way(k: int = 10, k1: float = 1.5, b: float = 0.75) -> Way:
    def weigh(tf, n, df, docs, total):
        return np.log(1 + (docs - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / max(total / max(docs, 1), 1e-300)))

    return Way(k, 4, None, weigh)


def tf_idf_way(k: int = 5, text: str = "text") -> Way:
    def weigh(tf, n, df, docs, total):
        return tf / np.maximum(n, 1) * np.log(docs / df)

    return Way(k, 6, F.greatest(F.size(X.words(F.col(text))), F.lit(0)), weigh)


def bm25(queries: DataFrame, docs: DataFrame, k: int = 10, query_key: str = "query_id", key: str = "doc_id", text: str = "text", k1: float = 1.5, b: float = 0.75, tokens=terms) -> DataFrame:
    """query_key, key, score, rank with idf ln(1 + (N - df + 0.5) / (df + 0.5)), which is never negative; rows without a common term don't
    occur. A word that a query repeats counts as often. A null text has no words, a row without key is counted but not found."""
    return rank(queries, docs, [bm25_way(k, k1, b)], query_key, key, text, tokens)[0]


def tf_idf(queries: DataFrame, docs: DataFrame, k: int = 5, query_key: str = "query_id", key: str = "doc_id", text: str = "text", tokens=terms) -> DataFrame:
    """tf is a term's count over the words between white space, idf is ln(N / df)."""
    return rank(queries, docs, [tf_idf_way(k, text)], query_key, key, text, tokens)[0]


def keyword_count(df: DataFrame, words: list[str], text: str = "text") -> DataFrame:
    """Adds score: how many of the words the text has, whatever the case; rows with none go."""
    low = F.lower(F.col(text))
    return df.withColumn("score", sum((F.contains(low, F.lit(w.lower())).cast("int") for w in words), F.lit(0))).where("score > 0")


def mean_similarity(vectors: DataFrame, group: str, vector: str = "embedding") -> DataFrame:
    """{group}_a, {group}_b, mean, bucket: the mean cosine over all pairs of unit vectors from two groups, by the groups' sums; a vector of
    zeros counts with cosine 0."""
    cells = vectors.where(F.col(group).isNotNull() & F.col(vector).isNotNull())
    n = cells.groupBy(group).agg(F.count("*").alias("n"))
    sums = cells.select(group, F.posexplode(vector).alias("i", "x")).where("x <> 0").groupBy(group, "i").agg(F.sum("x").alias("x"))
    a = sums.select(F.col(group).alias(f"{group}_a"), "i", F.col("x").alias("x_a"))
    b = sums.select(F.col(group).alias(f"{group}_b"), "i", F.col("x").alias("x_b"))
    dots = a.join(b, "i").where(F.col(f"{group}_a") < F.col(f"{group}_b")).groupBy(f"{group}_a", f"{group}_b").agg(F.sum(F.col("x_a") * F.col("x_b")).alias("dot"))
    n_a = n.select(F.col(group).alias(f"{group}_a"), F.col("n").alias("n_a"))
    n_b = n.select(F.col(group).alias(f"{group}_b"), F.col("n").alias("n_b"))
    # every pair of groups, also two without a common cell
    pairs = n_a.crossJoin(n_b).where(F.col(f"{group}_a") < F.col(f"{group}_b")).join(dots, [f"{group}_a", f"{group}_b"], "left")
    out = pairs.withColumn("mean", F.round(F.coalesce("dot", F.lit(0.0)) / F.col("n_a") / F.col("n_b"), 4))
    bucket = F.when(F.col("mean") > 0.8, "high").when(F.col("mean") > 0.6, "medium").otherwise("low")
    return out.select(f"{group}_a", f"{group}_b", "mean", bucket.alias("bucket"))


def hashed_vectors(df: DataFrame, key: str, text: str, dim: int = 256, tokens=terms) -> DataFrame:
    """key, embedding: the stand-in for a model's vectors. A word's cell is its md5 modulo dim, cells hold counts, and the norm is one. A text
    without words has zeros only. Words and cells are found in the JVM, counting is done on Arrow batches, and nothing is shuffled."""

    def run(batches):
        for batch in batches:
            for part in list_pieces(batch):
                lists = part.column(1)
                row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
                n = np.bincount(row * dim + lists.flatten().to_numpy(), minlength=part.num_rows * dim).reshape(-1, dim).astype(float)
                n /= np.maximum(np.sqrt((n * n).sum(axis=1, keepdims=True)), 1e-300)
                at = pa.array(np.arange(0, n.size + 1, dim, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(at, pa.array(n.ravel()))], names=[key, "embedding"])

    cell = lambda w: (F.conv(F.substring(F.md5(w), 1, 2 if dim <= 256 else 8), 16, 10).cast("long") % dim).cast("int")
    cells = F.transform(F.coalesce(tokens(F.col(text)), F.array().cast("array<string>")), cell).alias("cells")
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("embedding", T.ArrayType(T.DoubleType()))])
    return df.select(key, cells).mapInArrow(run, schema)


def nearest_patterns(requests: DataFrame, patterns: DataFrame, k: int = 5, request_key: str = "request_id", key: str = "pattern_id", text: str = "text") -> DataFrame:
    """request_key, key, similarity (one less the cosine distance), rank: the known phrases nearest to each request. A request's key can be a
    struct of several columns."""
    from .vector import knn

    found = knn(hashed_vectors(requests, request_key, text), hashed_vectors(patterns, key, text), k, query_key=request_key, key=key)
    return found.select(request_key, key, F.col("score").alias("similarity"), "rank")
