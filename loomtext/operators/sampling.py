"""Exact shares of every stratum, without a sort or a window over a whole one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

#: Bits of a hash that one histogram tells apart, and how many histograms it takes.
BITS, LEVELS = 15, 4


def hash60(key: Column) -> Column:
    """60 bits of a key's md5."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 15), 16, 10).cast("long")


def stratified_split(df: DataFrame, key: str, stratum: str, share: float = 0.1, names: tuple[str, str] = ("test", "train")) -> DataFrame:
    """Adds split: of each stratum's different keys exactly floor(share * n + 1/2) are of the first name, those of least hash (ties by the lesser
    key); all rows of a key and stratum go together. A null stratum is one; rows without key are of the second name and aren't counted.

    A histogram of the hashes' first bits says in which cell of a stratum the last chosen key lies; histograms of that cell alone refine it, so that
    in the end a threshold for each stratum decides. Counts are summed before they move, and a stratum that holds all rows is as good as any.
    """
    keys = df.where(F.col(key).isNotNull()).select(F.col(stratum).alias("s"), F.col(key).alias("k")).distinct().withColumn("h", hash60(F.col("k")))
    keys = stored(keys, "keys")
    # of each stratum: how many are still to be chosen from the cell, whose first bits are `cell`
    want = keys.groupBy("s").agg(F.floor(F.count("*") * share + 0.5).alias("rest"), F.lit(0).cast("long").alias("cell")).where("rest > 0")
    inside, same = keys, lambda d: d["s"].eqNullSafe(F.col("of"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        counts = inside.groupBy("s", F.shiftright("h", shift).alias("bin")).agg(F.count("*").alias("n"))
        before = Window.partitionBy("s").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        w = want.select(F.col("s").alias("of"), "rest")
        found = counts.join(w, same(counts)).where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest")))
        want = stored(found.select("s", (F.col("rest") - F.col("before")).alias("rest"), F.col("bin").alias("cell")), "cells")
        w = want.select(F.col("s").alias("of"), "cell")
        inside = inside.join(w, same(inside)).where(F.shiftright("h", shift) == F.col("cell")).drop("of", "cell")
    # keys of one and the same hash: next to none
    last = inside.withColumn("place", F.row_number().over(Window.partitionBy("s").orderBy("k"))).join(want.select(F.col("s").alias("of"), "rest"), same(inside))
    last = last.where(F.col("place") <= F.col("rest")).select(F.col("s").alias("of"), F.col("k").alias("of_k"), F.lit(True).alias("tied"))
    limits = want.select(F.col("s").alias("of"), F.col("cell").alias("limit"))
    rows = df.withColumn("_h", hash60(F.col(key)))
    rows = rows.join(limits, rows[stratum].eqNullSafe(F.col("of")), "left").drop("of")
    rows = rows.join(last, rows[stratum].eqNullSafe(F.col("of")) & (rows[key] == F.col("of_k")), "left")
    first = (F.col("_h") < F.col("limit")) | F.coalesce("tied", F.lit(False))
    return rows.select(*df.columns, F.when(F.coalesce(first, F.lit(False)), names[0]).otherwise(names[1]).alias("split"))
