"""Importance resampling towards a target distribution.

Every text becomes a row of counts: its runs of one to n words (A-Z in lower case, joined by one space) fall into buckets by their crc32. The
rows are persisted as small blocks of a sparse matrix in CSR form, a Parquet row for each block (about 4 KB of text, or one longer text). Column sums of the blocks give the distribution of
the corpus, those of the target's blocks that of the target; the gain of a bucket is the logarithm of the two smoothed shares' ratio, in
thousandths. The product of each block with the vector of gains gives the sums behind the documents' weights, and Gumbel noise drawn from the
identifiers by sha256 turns weights into a draw without replacement: the documents of highest score.

Only vectors of one number a bucket reach the driver. Ranks are numbered over range partitions, never in one task.

Nulls: a null text has no words; of a null identifier the noise is that of an empty one, and it comes after others of its score. Ties go to the
smaller identifier, then to the smaller number of features; repeated rows are drawn each. A document without words weighs 0. Without documents
the result is empty; without a target all its shares are equal. Columns of other names take no part.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AT_ONCE, LOWER, coded_words, documents, materialize, parts, release, running, slices, text_bytes

BUCKETS = 10_000
#: Words end at any ASCII character but letters and digits.
BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Bytes of text that a stored block has; Spark reads some thousand rows at once, whatever they hold, so rows have to be small. Blocks that numpy
#: works on at once.
STORED = 4 << 10
BLOCKS_AT_ONCE = 512
BLOCK = "ids array<long>, indptr array<int>, indices array<int>, counts array<long>"


def _cells(data: np.ndarray, at: np.ndarray, n: int, buckets: int, known: int = 0) -> np.ndarray:
    """text * buckets + bucket of each run of one to n words. Runs that end within the first known words are left out."""
    row, code, words = coded_words(data, at, BREAK)
    if not len(row):
        return np.zeros(0, np.int64)
    of = np.array([zlib.crc32(w) % buckets for w in words], np.int64)
    out = [(row * buckets + of[code])[known:]]
    if n > 1:
        each = pa.array(words, pa.large_binary()).take(pa.array(code))
        runs = each
        for k in range(2, min(n, len(row)) + 1):
            runs = pc.binary_join_element_wise(runs.slice(0, len(runs) - 1), each.slice(k - 1), pa.scalar(b" ", pa.large_binary()))
            whole = (row[k - 1 :] == row[: len(row) - k + 1]) & (np.arange(k - 1, len(row)) >= known)
            coded = runs.filter(pa.array(whole)).dictionary_encode()
            of = np.array([zlib.crc32(w) % buckets for w in coded.dictionary.to_pylist()], np.int64)
            out.append(row[k - 1 :][whole] * buckets + of[coded.indices.to_numpy()] if len(of) else np.zeros(0, np.int64))
    return np.concatenate(out)


def _long(data: np.ndarray, n: int, buckets: int, limit: int) -> np.ndarray:
    """The counts of one very long text, part by part; each part begins with the last n - 1 words of the one before."""
    sums, before = np.zeros(buckets, np.int64), []
    for part in parts(data, BREAK, limit):
        head = np.frombuffer(b"".join(w + b" " for w in before), np.uint8)
        own = np.concatenate([head, part])
        sums += np.bincount(_cells(own, np.array([0, len(own)]), n, buckets, len(before)), minlength=buckets)
        if n > 1:
            _, code, words = coded_words(own, np.array([0, len(own)]), BREAK)
            before = [words[c] for c in code[-(n - 1) :].tolist()]
    return sums


def block(column: pa.Array, lo: int, hi: int, data: np.ndarray, at: np.ndarray, n: int, buckets: int, limit: int = AT_ONCE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pointers, column indices and counts of the texts lo to hi."""
    some = LOWER[data[at[lo] : at[hi]]]
    if hi == lo + 1 and len(some) > 2 * limit:
        sums = _long(some, n, buckets, limit)
        cells, counts = np.flatnonzero(sums), sums[sums > 0]
    else:
        cells, counts = np.unique(_cells(some, at[lo : hi + 1] - at[lo], n, buckets), return_counts=True)
    ends = np.searchsorted(cells, np.arange(hi - lo + 1) * buckets)
    return ends, cells % buckets, counts


def matrix(docs: DataFrame, key: str | None = "doc_id", text: str = "text", n: int = 1, buckets: int = BUCKETS, limit: int = AT_ONCE) -> DataFrame:
    """The documents by buckets, as CSR blocks of about STORED bytes of text each; so many texts as hold limit bytes are counted at once."""
    lists = lambda at, x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), x)

    def run(batches):
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            for lo, hi in slices(at, limit):
                ends, cells, counts = block(batch.column(1), lo, hi, data, at, n, buckets, limit)
                cuts = np.array([0, *(b for _, b in slices(at[lo : hi + 1], STORED))])
                size = np.diff(cuts) + 1  # a block has one pointer more than texts
                own = np.repeat(cuts[:-1] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
                pointers = ends[own] - np.repeat(ends[cuts[:-1]], size)
                columns = [
                    lists(cuts, batch.column(0).slice(lo, hi - lo)), lists(np.concatenate([[0], np.cumsum(size)]), pa.array(pointers, pa.int32())),
                    lists(ends[cuts], pa.array(cells, pa.int32())), lists(ends[cuts], pa.array(counts, pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["ids", "indptr", "indices", "counts"])

    own = F.lit(None) if key is None else F.col(key)
    return docs.select(own.cast("long").alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(run, BLOCK)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all rows: summed block by block in each task, then over tasks."""

    def run(batches):
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCKS_AT_ONCE):
                some = batch.slice(lo, BLOCKS_AT_ONCE)
                np.add.at(sums, some.column(0).flatten().to_numpy(), some.column(1).flatten().to_numpy())
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    got = blocks.select("indices", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the target's smoothed share over the corpus's, rounded down."""
    s, t, k = corpus.tolist(), target.tolist(), len(corpus)
    all_s, all_t = float(sum(s)), float(sum(t))
    return np.array([math.floor(1000 * math.log((y + 1.0) * (all_s + k) / ((x + 1.0) * (all_t + k)))) for x, y in zip(s, t)], np.int64)


def noise(seed: int, key: int | None) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of a sha256."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(blocks: DataFrame, gain: np.ndarray, seed: int = 2024) -> DataFrame:
    """id, n_features, weight and score of each row, by the product of its block with the gains."""
    sent = blocks.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        g = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCKS_AT_ONCE):
                ids, ends, cells, counts = (c.slice(lo, BLOCKS_AT_ONCE) for c in batch.columns)
                base = np.concatenate([[0], np.cumsum(cells.value_lengths().to_numpy())])[:-1]
                size = ends.value_lengths().to_numpy()
                at, inner = ends.flatten().to_numpy() + np.repeat(base, size), np.ones(size.sum(), bool)
                inner[np.cumsum(size) - size] = False  # a block's first pointer ends no text
                ids, c = ids.flatten(), counts.flatten().to_numpy()
                total = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[at])[inner[1:]]
                n, sums = total(c), total(g[cells.flatten().to_numpy()] * c)
                w = np.where(n > 0, sums // np.maximum(n, 1), 0)
                score = w + np.array([noise(seed, k) for k in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(w), pa.array(score)], names=["id", "n_features", "weight", "score"])

    return blocks.mapInArrow(run, "id long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", n: int = 1, buckets: int = BUCKETS, seed: int = 2024, least: int = 20, percent: int = 10) -> DataFrame:
    """One row per document: key, n_features, weight, score and rank: 1, 2, ... for the percent of the documents with least words at least that
    have the highest scores, null for others. (least counts words: of runs up to n words, a text of w words has fewer than n * w.)"""
    blocks, wanted = materialize(matrix(docs, key, text, n, buckets), "csr"), matrix(target, None, target_text, n, buckets)
    gain = gains(column_sums(blocks, buckets), column_sums(wanted, buckets))
    scored = materialize(weights(blocks, gain, seed), "scored")
    release(blocks)
    words = least * n - n * (n - 1) // 2 if least >= n else least * (least + 1) // 2  # the features of a text of so many words
    fit = F.col("n_features") >= words
    drawn = scored.where(fit).count() * percent // 100
    own = scored.where(fit).select("*", (-F.col("score")).alias("o1"), F.col("id").isNull().alias("o2"), F.monotonically_increasing_id().alias("o3"))
    ranked = running(own, None, ["o1", "o2", "id", "n_features", "weight", "o3"], "n_features", "ranks")
    rank = F.when(F.col("before_rows") < drawn, F.col("before_rows") + 1)
    columns = ["id", "n_features", "weight", "score"]
    out = ranked.select(*columns, rank.alias("rank")).unionByName(scored.where(~fit).select(*columns, F.lit(None).cast("long").alias("rank")))
    return out.withColumnRenamed("id", key)


def drawn_documents(docs: DataFrame, target: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The documents whose identifier was drawn, with all their columns. Rows that share a drawn identifier come together."""
    ids = resample(docs, target, key, **how).where("rank IS NOT NULL").select(F.col(key).cast("long").alias("_drawn")).distinct()
    return docs.join(ids, F.col(key).cast("long").eqNullSafe(F.col("_drawn")), "left_semi")


def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text"))


QUERIES = {"op13_target_resampling": op13_target_resampling}
_CRC = "xor(list_reduce(list_transform(regexp_extract_all(hex(w), '..'), lambda x: ('0x' || x)::BIGINT), lambda a, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda s, k: xor(s >> 1, 3988292384 * (s & 1)), xor(a, x)), 4294967295::BIGINT), 4294967295)"
_WORDS = "unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w"
#: The buckets are worked out once for each different word; numbers are doubles where the logarithms are taken.
ORACLES = {
    "op13_target_resampling": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
dw AS (SELECT r, {_WORDS} FROM d), bw AS (SELECT {_WORDS} FROM benchmark),
dc AS (SELECT r, w, count(*) AS n FROM dw GROUP BY r, w), bc AS (SELECT w, count(*) AS n FROM bw GROUP BY w),
k AS (SELECT w, {_CRC} % 10000 AS b FROM (SELECT w FROM dc UNION SELECT w FROM bc)),
s AS (SELECT b, sum(n)::DOUBLE AS s FROM dc JOIN k USING (w) GROUP BY b), t AS (SELECT b, sum(n)::DOUBLE AS t FROM bc JOIN k USING (w) GROUP BY b),
a AS (SELECT coalesce((SELECT sum(s) FROM s), 0) AS alls, coalesce((SELECT sum(t) FROM t), 0) AS allt),
g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1) * (alls + 10000) / ((s + 1) * (allt + 10000))))::BIGINT AS g FROM s LEFT JOIN t USING (b), a),
x AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight FROM dc JOIN k USING (w) JOIN g USING (b) GROUP BY r),
y AS (SELECT d.r, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
      FROM d LEFT JOIN x USING (r)),
z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n FROM y WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank FROM y LEFT JOIN z USING (r)"""
}
