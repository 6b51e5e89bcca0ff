"""Audit of how filters interact, over all orders in which they could be applied.

A scan finds which filters a document fails, as a mask of five bits. A table of 32 masks by 120 orders, made once, gives the step at which each
order removes a document of that mask. Tasks look their documents up in it and count removals by part, order, step and label with np.bincount;
one array for each part and task is left, and these are summed.

The filters: A, fewer than 200 words; B, fewer than half of the words differ; C, more than 3 % capital letters A-Z; D, a character of #$%&*|;
E, the text is that of a smaller identifier. Words are runs of anything but ASCII white space, and case counts. Whether two texts are the same
is told by their sha256.

Nulls: a null text is empty; a null part is the empty string; a null identifier is neither smaller nor larger than any, and has no labels.
Repeated rows count each, and do not remove each other; labels of repeated rows hold if any row has them. An empty text fails A alone (0 words
of 0 differ, so B, C and D hold). An empty table gives an empty result. Columns of other names take no part.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AT_ONCE, SPACE, coded_words, documents, hot_keys, materialize, parts, slices, text_bytes

FILTERS = "ABCDE"
ORDERS = list(permutations(range(len(FILTERS))))
STEPS = len(FILTERS)
MARKS = np.zeros(256, bool)
MARKS[list(b"#$%&*|")] = True


def first_failures() -> np.ndarray:
    """[mask, order]: the step, from 0, at which the order removes a document that fails the filters of the mask; 5 if none does."""
    fails = (np.arange(1 << STEPS)[:, None] >> np.arange(STEPS) & 1).astype(bool)
    by_step = fails[:, np.array(ORDERS)]
    return np.where(by_step.any(axis=2), by_step.argmax(axis=2), STEPS)


def _words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of each text and the different ones among them."""
    n = len(at) - 1
    if n == 1 and len(data) > 2 * AT_ONCE:  # a very long text, part by part
        count, seen = 0, set()
        for part in parts(data):
            _, code, words = coded_words(part, np.array([0, len(part)]))
            count += len(code)
            seen.update(words)
        return np.array([count]), np.array([len(seen)])
    row, code, words = coded_words(data, at)
    k = max(len(words), 1)
    return np.bincount(row, minlength=n), np.bincount(np.unique(row * k + code) // k, minlength=n)


def masks(column: pa.Array) -> np.ndarray:
    """Bits of the filters A to D, the lowest is A."""
    data, at = text_bytes(column)
    out = np.zeros(len(column), np.int32)
    for lo, hi in slices(at):
        some, begin = data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        total = lambda hit: np.diff(np.concatenate([[0], np.cumsum(hit, dtype=np.int64)])[begin])
        words, different = _words(some, begin)
        capitals, points, marks = total((some >= 65) & (some <= 90)), total((some & 0xC0) != 0x80), total(MARKS[some])
        fails = (words < 200, 100 * different < 50 * words, 100 * capitals > 3 * points, marks > 0)
        out[lo:hi] = sum(f.astype(np.int32) << i for i, f in enumerate(fails))
    return out


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per document: id, part, mask (filters A to E)."""

    def run(batches):
        turn = 0
        for batch in batches:
            data, at = text_bytes(batch.column(2))
            view, ends = memoryview(data), at.tolist()
            sha = [hashlib.sha256(view[a:b]).digest() for a, b in zip(ends, ends[1:])]
            columns = [*batch.columns[:2], pa.array(masks(batch.column(2))), pa.array(sha, pa.binary()), pa.array(np.arange(turn, turn + batch.num_rows))]
            turn += batch.num_rows
            yield pa.RecordBatch.from_arrays(columns, names=["id", "part", "mask", "sha", "turn"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").alias("t"))
    rows = materialize(rows.mapInArrow(run, "id long, part string, mask int, sha binary, turn long"), "masks")
    found = rows.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    twice = materialize(found.where("n > 1"), "twice")
    # texts that many rows share are dealt to salts; a text that has no second row need not meet its row again, but rows are small
    hot = F.broadcast(hot_keys(twice, ["sha"]))
    salted = twice.select("sha", "first").join(hot, "sha", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)))
    dealt = rows.join(hot, "sha", "left").withColumn("salt", F.coalesce(F.pmod("turn", "salts"), F.lit(0).cast("long"))).drop("salts")
    out = dealt.join(salted.drop("salts"), ["sha", "salt"], "left")
    later = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return out.select("id", "part", (F.col("mask") + F.when(later, 1 << FILTERS.index("E")).otherwise(0)).alias("mask"), "turn")


AUDIT = "part string, o int, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
MEASURES = [x.split()[0] for x in AUDIT.split(", ")[3:]]
#: Parts that a task counts at once: 2,880 numbers each.
PARTS_AT_ONCE = 256


def audit(rows: DataFrame) -> DataFrame:
    """rows: part, mask, label (1: good, 2: toxic) and n, how many rows it stands for. A row for each part, order (its place in ORDERS) and step."""
    first, orders = first_failures(), np.arange(len(ORDERS))
    cells = len(ORDERS) * (STEPS + 1) * 4
    by_step, fails = np.array(ORDERS), (np.arange(1 << STEPS)[:, None] >> np.arange(STEPS) & 1).astype(bool)

    def measures(part: str, a: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        """a: order x step x label; m: rows by mask."""
        removed = a[:, :STEPS].sum(axis=2)
        kept = a.sum(axis=(1, 2))[:, None] - removed.cumsum(axis=1)
        failing, only = (m[:, None] * fails).sum(axis=0), m[1 << np.arange(STEPS)]
        share = np.bincount(by_step.ravel(), removed.ravel(), STEPS).astype(np.int64)
        good, toxic = a[:, :STEPS, 1::2].sum(axis=2), a[:, :STEPS, 2:].sum(axis=2)
        numbers = [kept, removed, failing[by_step] - removed, only[by_step], good, toxic, share[by_step]]
        o, step = np.repeat(orders, STEPS), np.tile(np.arange(1, STEPS + 1), len(ORDERS))
        columns = [pa.array([part] * len(o), pa.string()), pa.array(o, pa.int32()), pa.array(step, pa.int32()), *[pa.array(x.ravel().astype(np.int64)) for x in numbers]]
        return pa.RecordBatch.from_arrays(columns, names=["part", "o", "step", *MEASURES])

    def run(batches):
        sums: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            code, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            mask, label, n = (batch.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3))
            for lo in range(0, len(names), PARTS_AT_ONCE):
                hi = min(lo + PARTS_AT_ONCE, len(names))
                own = np.flatnonzero((code >= lo) & (code < hi))
                p = code[own].astype(np.int64) - lo
                at = ((p[:, None] * len(ORDERS) + orders) * (STEPS + 1) + first[mask[own]]) * 4 + label[own][:, None]
                a = np.bincount(at.ravel(), np.repeat(n[own], len(ORDERS)), (hi - lo) * cells).astype(np.int64).reshape(hi - lo, len(ORDERS), STEPS + 1, 4)
                m = np.bincount((p << STEPS) + mask[own], n[own], (hi - lo) << STEPS).astype(np.int64).reshape(hi - lo, -1)
                for name, x, y in zip(names[lo:hi], a, m):
                    if name in sums:
                        sums[name][0] += x
                        sums[name][1] += y
                    else:
                        sums[name] = [x.copy(), y.copy()]
                if len(sums) > PARTS_AT_ONCE:
                    yield from (measures(name, *x) for name, x in sums.items())
                    sums = {}
        yield from (measures(name, *x) for name, x in sums.items())

    partial = rows.select("part", "mask", "label", "n").mapInArrow(run, AUDIT)
    return partial.groupBy("part", "o", "step").agg(*[F.sum(x).alias(x) for x in MEASURES])


def labelled(rows: DataFrame, labels: DataFrame, key: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """part, mask, label, n: the rows of judged() with their documents' labels. Rows of one identifier are added up before they move, and rows
    without one are dealt by their turn."""
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("at"))
    bit = lambda c, b: F.max(F.when(F.col(c) == 1, b).otherwise(0))
    known = known.agg((bit(good, 1) + bit(toxic, 2)).alias("label")).withColumn("none", F.lit(False))
    unknown = F.col("id").isNull()
    own = rows.withColumn("at", F.coalesce("id", "turn")).withColumn("none", unknown).groupBy("at", "none", "part", "mask").agg(F.count("*").alias("n"))
    return own.join(known, ["at", "none"], "left").select("part", "mask", F.coalesce("label", F.lit(0)).alias("label"), "n")


def filter_audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step."""
    out = audit(labelled(judged(docs, key, text, part), labels, key))
    names = F.array(*[F.lit("".join(FILTERS[i] for i in o)) for o in ORDERS])
    return out.select("part", names[F.col("o")].alias("filter_order"), "step", *MEASURES)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir, "doc_id", "text", "lang"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op11_filter_audit": op11_filter_audit}
ORACLES = {
    "op11_filter_audit": """
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
             [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(body) - length(regexp_replace(body, '[A-Z]', '', 'g'))) > 3 * length(body),
              regexp_matches(body, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), false)] AS fails
      FROM t LEFT JOIN l USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
i AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
m AS (SELECT g.*, o.o, coalesce(list_position(list_transform(o.o, lambda k: fails[k]), true), 6) AS first FROM g, o),
r AS (SELECT part, o, i AS step, o[i] AS k, sum(n * (first > i)::INT) AS kept, sum(n * (first = i)::INT) AS removed, sum(n * (fails[o[i]] AND first < i)::INT) AS redundant,
             sum(n * (fails[o[i]] AND len(list_filter(fails, lambda x: x)) = 1)::INT) AS unique_fails, sum(good * (first = i)::INT) AS good_lost, sum(toxic * (first = i)::INT) AS toxic_lost
      FROM m, i GROUP BY part, o, i)
SELECT part, list_reduce(list_transform(o, lambda k: substr('ABCDE', k, 1)), lambda a, b: a || b) AS filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
       redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM r"""
}
