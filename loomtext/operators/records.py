"""Analytics of plain tables: profiles, searches, rates, schedules, message windows, sessions."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBERS = ("int", "bigint", "double", "float", "smallint", "tinyint")


def matching(df: DataFrame, conditions: dict) -> DataFrame:
    """Strings hold where they contain the value, whatever the case; numbers where they are equal; unknown columns are passed over."""
    kinds = dict(df.dtypes)
    parts = [F.contains(F.lower(F.col(c)), F.lit(v.lower())) if isinstance(v, str) else F.col(c) == F.lit(v) for c, v in conditions.items() if c in kinds]
    return df.where(reduce(lambda a, b: a & b, parts, F.lit(True)))


def any_column_has(df: DataFrame, words: list[str]) -> DataFrame:
    """Rows of which any column, written as text, has one of the words of more than two characters."""
    words = [w.lower() for w in words if len(w) > 2]
    line = F.lower(F.concat_ws("\u0001", *[F.col(c).cast("string") for c in df.columns]))
    return df.where(reduce(lambda a, b: a | b, [F.contains(line, F.lit(w)) for w in words], F.lit(False)))


def search_tables(tables: dict[str, tuple[DataFrame, str]], words: list[str], k: int = 10) -> DataFrame:
    """source, key, row (as JSON): of each table (by its name, with the column of its key) the first k rows by key of which any column has one of
    the words."""
    found = [any_column_has(df, words).orderBy(key).limit(k).select(F.lit(name).alias("source"), F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("row")) for name, (df, key) in tables.items()]
    return reduce(DataFrame.unionByName, found)


def profile(df: DataFrame) -> DataFrame:
    """A row for each column: rows, nulls, distinct values; least, most and mean of numbers or of the lengths of texts. One scan gives the sums, a
    row for each task; another one gives all columns' values at once, and of these the different ones alone are shuffled."""
    kinds = dict(df.dtypes)
    aggregates, parts = [F.count("*").alias("n")], []
    for i, c in enumerate(df.columns):
        x = F.col(c).cast("double") if kinds[c] in NUMBERS else F.length(F.col(c).cast("string")).cast("double")
        aggregates += [F.sum(F.col(c).isNull().cast("int")).alias(f"nulls{i}"), F.min(x).alias(f"least{i}"), F.max(x).alias(f"most{i}"), F.round(F.avg(x), 4).alias(f"mean{i}")]
        parts.append(F.struct(F.lit(c).alias("column"), "n", *[F.col(f"{m}{i}").alias(m) for m in ("nulls", "least", "most", "mean")]))
    sums = df.agg(*aggregates).select(F.explode(F.array(*parts)).alias("r")).select("r.*")
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in df.columns])).alias("r")).select("r.*")
    each = values.groupBy("column", "v").agg(F.lit(1).alias("one")).groupBy("column").agg(F.count("v").alias("distinct_values"))
    return sums.join(F.broadcast(each), "column", "left").select("column", "n", "nulls", F.coalesce("distinct_values", F.lit(0).cast("long")).alias("distinct_values"), "least", "most", "mean")


def frequent_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    """column, value, n, place: the k most frequent values of each column, ties by value. Values are counted before any is ranked."""
    each = [df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k).select(F.lit(c).alias("column"), "value", "n") for c in columns]
    place = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("n"), "value"))
    return reduce(DataFrame.unionByName, each).withColumn("place", place)


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def free_hours(df: DataFrame, day: str, hour: str, first: int = 9, last: int = 18) -> DataFrame:
    """For each day the hours from first to last in which nothing begins."""
    days = df.select(day).distinct().select(day, F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("hour"))
    return days.join(df.select(day, F.col(hour).alias("hour")).distinct(), [day, "hour"], "left_anti")


def success_stats(df: DataFrame, by: str, good: Column, value: str) -> DataFrame:
    return df.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(good.cast("int")) * 100, 2).alias("success_percent"), F.round(F.avg(value), 4).alias("mean"))


def last_rows(df: DataFrame, by: str, order: str, n: int) -> DataFrame:
    """The n last rows of each group."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def message_window(df: DataFrame, by: str, order: str, role: str, most: int) -> DataFrame:
    """All system rows of a conversation, and of the others as many of the last as the window has room for."""
    system = F.col(role) == "system"
    room = F.greatest(F.lit(most) - F.count_if(system).over(Window.partitionBy(by)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(by, system).orderBy(F.desc(order)))
    return df.withColumn("_room", room).withColumn("_place", place).where(system | (F.col("_place") <= F.col("_room"))).drop("_room", "_place")


def sessions(df: DataFrame, user: str, ts: str, gap: str) -> DataFrame:
    """A row for each run of a user's rows without a longer gap."""
    return df.groupBy(user, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n")).select(user, F.col("s.start").alias("begin"), F.col("s.end").alias("end"), "n")


def cache_hits(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Adds hit and expired: a row within so many seconds of its key's last fetch is a hit; any other fetches anew, and expired says that an older
    fetch was there. A hit does not prolong an entry. Rows of a key are taken in the order of their time in one task, of which no more is kept than
    the last fetch; rows without a time are neither."""
    live, at = seconds * 1_000_000, len(df.columns)
    names = df.columns

    def run(batches):
        last, fetched = object(), None
        for batch in batches:
            keys, t = batch.column(at + 1), batch.column(at).to_numpy(zero_copy_only=False)
            known = ~np.array(batch.column(at).is_null())
            hit, expired = np.zeros(len(t), bool), np.zeros(len(t), bool)
            code = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(t)] if len(t) else [0]
            for lo, hi in zip(cuts, cuts[1:]):
                name = keys[lo].as_py()
                if name != last:
                    last, fetched = name, None
                lo += int((~known[lo:hi]).sum())  # nulls come first
                own = t[lo:hi].astype(np.int64)
                i = 0
                while i < len(own):
                    if fetched is None or own[i] - fetched >= live:
                        expired[lo + i] = fetched is not None
                        fetched = int(own[i])
                        i += 1
                    j = int(np.searchsorted(own, fetched + live))
                    hit[lo + i : lo + max(j, i)] = True
                    i = max(j, i)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(hit), pa.array(expired)], names=[*names, "hit", "expired"])

    rows = df.select("*", F.unix_micros(F.col(ts).cast("timestamp")).alias("_at"), F.col(key).alias("_key"))
    schema = T.StructType([*df.schema.fields, T.StructField("hit", T.BooleanType()), T.StructField("expired", T.BooleanType())])
    return rows.repartition("_key").sortWithinPartitions("_key", "_at").mapInArrow(run, schema)


def bid_score(cost: Column, weeks: Column, risk: Column, performance: Column, weights: tuple[float, float, float, float] = (0.3, 0.2, 0.25, 0.25)) -> Column:
    """The less the better: cost by 500, weeks by 12, risk by 10, and what performance lacks of 10."""
    return weights[0] * cost / 500 + weights[1] * weeks / 12 + weights[2] * risk / 10 + weights[3] * (1 - performance / 10)


def delivery(base: Column, factor: Column) -> Column:
    return F.least(F.coalesce(base, F.lit(0.85)) * F.coalesce(factor, F.lit(1.0)), F.lit(1.0))
