"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a row of slots of equal numbers of words. Slot i's golden-ratio point frac((i + 1/2) * phi) is mapped through the cumulative
shares of the sources: any run of slots holds each source nearly in proportion. The slots of a source are ranked, and slot of rank r takes
the r-th block of the source's stream: its documents in an order shuffled by a hash, laid end to end and begun again when they end. Blocks
are cut at multiples of the block size, the last where the source's target ends, so that each source gives its target to the word.

Sources are few rows (one for each, on the driver and in each worker: tens of thousands, not one for each page of a web); documents, blocks and slots never leave the executors, and running sums are
taken over range partitions, so a source that holds a third of all rows is spread over many tasks.

Nulls: a null text has no words; documents without source form one source, which comes last. Rows repeated in full (same identifier, source
and text) are laid side by side and take equal numbers of words each, rounded down. Sources without words, and empty tables, take nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_JAVA, documents, materialize, renamed, running

WEIGHTS = (5.0, 2.0, 1.0)
CHUNK = 1 << 16


def source_targets(sizes: list[tuple[str | None, int]], share: float = 1.5, limit: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> list[tuple[str | None, int, float]]:
    """(source, size, target) by code point, null last. What a source can't take beyond limit times its size goes to the others by weight."""
    rows = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    w = [weights[i % len(weights)] for i in range(len(rows))]
    target = [0.0] * len(rows)
    left, free = share * sum(n for _, n in rows), set(range(len(rows)))
    while free:
        total = sum(w[i] for i in sorted(free))
        over = [i for i in sorted(free) if left * w[i] / total > limit * rows[i][1]]
        if not over:
            for i in free:
                target[i] = left * w[i] / total
            break
        for i in over:
            target[i] = limit * rows[i][1]
        left -= sum(target[i] for i in over)
        free -= set(over)
    return [(s, n, t) for (s, n), t in zip(rows, target)]


def golden_points(start: int, n: int) -> np.ndarray:
    """frac((i + 1/2) * phi) for n slots from start on, exact to 53 bits."""
    i = np.arange(start, start + n, dtype=np.uint64)
    x = i * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x9E3779B97F4A7C15 // 2)
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def schedule(spark: SparkSession, takes: list[int], block: int) -> DataFrame:
    """(slot, src, rank): which source's block each slot takes; takes: the words to take from each source.

    The points leave a source a few slots short or over at the end: what is over is left out, what is short follows after the last slot.
    """
    need = np.array([-(-t // block) for t in takes], np.int64)
    slots = int(need.sum())
    empty = spark.createDataFrame([], "slot long, src int, rank long")
    if not slots:
        return empty
    cumulative = np.cumsum(np.array(takes, float)) / sum(takes)
    # a source without words has no width, so that the right side of its step is never met
    pick = lambda c: np.minimum(np.searchsorted(cumulative, golden_points(c * CHUNK, min(CHUNK, slots - c * CHUNK)), side="right"), len(takes) - 1)

    def counts(batches):
        for batch in batches:
            for c in batch.column(0).to_pylist():
                n = np.bincount(pick(c), minlength=len(takes))
                src = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(src), c)), pa.array(src.astype(np.int32)), pa.array(n[src])], names=["chunk", "src", "n"])

    chunks = -(-slots // CHUNK)
    counted = materialize(spark.range(0, chunks, 1, max(1, min(chunks, 4096))).mapInArrow(counts, "chunk long, src int, n long"), "slots")
    w = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    based = counted.withColumn("base", F.coalesce(F.sum("n").over(w), F.lit(0)))
    by_chunk = based.groupBy("chunk").agg(F.collect_list("src").alias("src"), F.collect_list("base").alias("base"))

    def ranks(batches):
        for batch in batches:
            for c, src, base in zip(*(x.to_pylist() for x in batch.columns)):
                own = pick(c)
                order = np.argsort(own, kind="stable")
                n = np.bincount(own, minlength=len(takes))
                first = np.concatenate([[0], np.cumsum(n)[:-1]])
                rank = np.empty(len(own), np.int64)
                rank[order] = np.arange(len(own)) - np.repeat(first, n)
                bases = np.zeros(len(takes), np.int64)
                bases[src] = base
                rank += bases[own]
                keep = rank < need[own]
                yield pa.RecordBatch.from_arrays([pa.array((np.arange(len(own)) + c * CHUNK)[keep]), pa.array(own[keep].astype(np.int32)), pa.array(rank[keep])], names=["slot", "src", "rank"])

    drawn = by_chunk.mapInArrow(ranks, "slot long, src int, rank long")
    had = np.zeros(len(takes), np.int64)
    for r in counted.groupBy("src").agg(F.sum("n").alias("n")).collect():  # a row for each source
        had[r["src"]] = r["n"]
    short = np.maximum(need - had, 0)
    if not short.sum():
        return drawn
    starts = np.concatenate([[0], np.cumsum(short)])
    tail = spark.createDataFrame([(int(i), int(short[i]), int(had[i]), int(starts[i])) for i in np.flatnonzero(short)], "src int, n long, had long, at long")
    tail = tail.select("src", "had", "at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    return drawn.unionByName(tail.select((F.lit(slots) + F.col("at") + F.col("j")).alias("slot"), "src", (F.col("had") + F.col("j")).alias("rank")))


UNIT = ["key", "source", "size", "text_hash"]


class Mix:
    """targets: (source, size, target) of each source; units: one row for each different document with its place in its source's stream;
    spans(): the mix itself, in slots; taken(): words by document."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", share: float = 1.5, limit: float = 2.0, weights: tuple[float, ...] = WEIGHTS, block: int = 256, seed: int = 7):
        self.spark, self.block = docs.sparkSession, block
        size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_JAVA)), F.lit(0)).cast("long")
        self.rows = materialize(docs.select(F.col(key).cast("long").alias("key"), F.col(source).cast("string").alias("source"), size.alias("size"), F.xxhash64(F.col(text)).alias("text_hash")), "sizes")
        per_source = [(r["source"], r["n"]) for r in self.rows.groupBy("source").agg(F.sum("size").alias("n")).collect()]
        self.targets = source_targets(per_source, share, limit, weights)
        self.takes = [min(math.floor(t + 1e-6), math.floor(limit * n)) for _, n, t in self.targets]
        table = [(i, s, n, t, k) for i, ((s, n, t), k) in enumerate(zip(self.targets, self.takes))]
        self.sources = self.spark.createDataFrame(table, "src int, source_name string, source_size long, target double, take long")
        units = self.rows.groupBy(*UNIT).agg(F.count("*").alias("copies"))
        units = units.join(self.sources, F.col("source").eqNullSafe(F.col("source_name"))).drop("source_name").withColumn("words", F.col("size") * F.col("copies"))
        shuffled = F.conv(F.substring(F.md5(F.concat_ws("/", F.col("key").cast("string"), F.lit(str(seed)))), 1, 15), 16, 10).cast("long")
        self.units = running(units.withColumn("shuffled", shuffled), "src", ["shuffled", "key", "text_hash"], "words", "stream").drop("before_rows", "shuffled")

    def spans(self) -> DataFrame:
        """(slot, key, source, size, text_hash, copies, from_word, to_word): slot after slot, the words of documents; from_word is counted
        over a document's copies laid end to end. Begins within a slot in the order of at."""
        n, t, a = F.col("source_size"), F.col("take"), F.col("before_value")
        epochs = F.expr("CASE WHEN words > 0 AND take > before_value THEN sequence(0L, (take - before_value - 1) DIV source_size) END")
        laid = self.units.withColumn("epoch", F.explode(epochs))
        laid = laid.withColumn("begin", F.col("epoch") * n + a).withColumn("end", F.least(F.col("begin") + F.col("words"), t))
        b = F.lit(self.block).cast("long")
        laid = laid.withColumn("rank", F.explode(F.expr(f"sequence(begin DIV {self.block}L, (end - 1) DIV {self.block}L)")))
        cut = laid.withColumn("at", F.greatest(F.col("begin"), F.col("rank") * b)).withColumn("stop", F.least(F.col("end"), (F.col("rank") + 1) * b))
        cut = cut.select("src", "rank", "at", *UNIT, "copies", (F.col("at") - F.col("begin")).alias("from_word"), (F.col("stop") - F.col("begin")).alias("to_word"))
        return cut.join(schedule(self.spark, self.takes, self.block), ["src", "rank"]).select("slot", "at", *UNIT, "copies", "from_word", "to_word")

    def taken_units(self) -> DataFrame:
        """One row for each different document that the mix takes: words taken from each of its copies."""
        words = F.sum(F.col("to_word") - F.col("from_word"))
        sums = self.spans().groupBy(*UNIT, "copies").agg(words.alias("_w")).withColumn("words_taken", F.expr("_w DIV copies"))
        return sums.where("words_taken > 0").select(*UNIT, "words_taken")

    def taken(self) -> DataFrame:
        """One row per document of the input: doc_id, size, source_size, target, taken."""
        sums = self.taken_units()
        rows = self.rows.join(self.sources, F.col("source").eqNullSafe(F.col("source_name"))).alias("r")
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in UNIT]
        out = rows.join(sums.alias("s"), same[0] & same[1] & same[2] & same[3], "left")
        return out.select(F.col("r.key").alias("doc_id"), F.col("r.size").alias("size"), "source_size", "target", F.coalesce("words_taken", F.lit(0).cast("long")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The documents of the mix with all their columns: a document that is taken more than once comes as often; the last take of one that is
    taken in part has its first words only. Documents that the mix doesn't take are gone."""
    mix = Mix(docs, key, text, source, **options)
    own = renamed(docs)
    names, at = own.columns, docs.columns.index
    takes = mix.taken_units().select("key", "source", "size", "text_hash", "words_taken")
    body = own.select(*names, F.col(names[at(key)]).cast("long").alias("own_key"), F.col(names[at(source)]).cast("string").alias("own_source"), F.xxhash64(F.col(names[at(text)])).alias("own_hash"))
    same = F.col("own_key").eqNullSafe(F.col("key")) & F.col("own_source").eqNullSafe(F.col("source")) & (F.col("own_hash") == F.col("text_hash"))
    times = F.expr("transform(sequence(0L, (words_taken - 1) DIV size), i -> least(size, words_taken - i * size))")
    rows = body.join(takes, same).select(*names, F.explode(times).alias("words"), "size")
    return rows.mapInArrow(_cut(at(text)), own.schema).toDF(*docs.columns)


def _cut(at: int):
    import re

    word = re.compile(r"[^\x20\x09-\x0D]+")

    def first_words(t: str, n: int) -> str:
        for i, m in enumerate(word.finditer(t), 1):
            if i == n:
                return t[: m.end()]
        return t

    def run(batches):
        for batch in batches:
            columns = list(batch.columns[:-2])
            words, sizes = batch.column(batch.num_columns - 2).to_numpy(zero_copy_only=False), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            short = np.flatnonzero(words < sizes)
            if len(short):
                texts = columns[at].to_pylist()
                for i in short:
                    texts[i] = first_words(texts[i], int(words[i]))
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-2])

    return run


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(documents(spark, sf_dir, "doc_id", "text", "source")).taken()


QUERIES = {"op7_mixing": op7_mixing}
#: Sources are full in the order of their limits by weight. Each gives its take from a stream that begins again: whole rounds, and what the
#: last round has of a document. The schedule decides when words are taken, not which.
ORACLES = {
    "op7_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, ('0x' || substr(md5(doc_id || '/7'), 1, 15))::BIGINT AS shuffled FROM documents),
n AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT source, n, 2.0 * n AS most, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM n),
o AS (SELECT *, 1.5 * sum(n) OVER () AS total, coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
f AS (SELECT *, (total - before) * w / rest > most AS full_up FROM o),
t AS (SELECT source, n, (CASE WHEN full_up THEN most ELSE (total - coalesce(sum(CASE WHEN full_up THEN most END) OVER (), 0)) * w / sum(CASE WHEN full_up THEN 0 ELSE w END) OVER () END)::DOUBLE AS target FROM f),
k AS (SELECT *, least(floor(target + 0.000001), 2 * n)::BIGINT AS take FROM t),
p AS (SELECT d.*, k.n, k.target, k.take, (sum(size) OVER (PARTITION BY d.source ORDER BY shuffled, doc_id) - size)::BIGINT AS a FROM d JOIN k ON k.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, n AS source_size, target, CASE WHEN n = 0 THEN 0 ELSE take // n * size + least(greatest(take % n - a, 0), size) END AS taken FROM p"""
}
