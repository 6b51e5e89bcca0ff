"""Made-up documents with metadata, for measuring: every value follows from the row's number, so that any engine makes the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TOPICS = ["storage", "search", "streams", "models", "security"]
AUTHORS = ["Ada", "Ben", "Cho", "Dee"]
WORDS = ["table", "index", "query", "node", "batch", "field", "cache", "block", "merge", "graph", "score", "token", "shard", "cloud", "event", "frame"]


def _pick(values: list[str], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int") + 1)


def number(key: Column, salt: str) -> Column:
    """A whole number from 0 to 65535 that follows from key and salt."""
    return F.conv(F.substring(F.md5(F.concat_ws("/", key.cast("string"), F.lit(salt))), 1, 4), 16, 10).cast("long")


def documents(spark: SparkSession, n: int, words: int = 40) -> DataFrame:
    """id, title, category, author, importance (1 to 10), day, text of so many words."""
    i = F.col("id")
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(words)), lambda j: _pick(WORDS, number(i, "w") + j * number(i, "s"))), " ")
    return spark.range(n).select(
        i, F.concat(F.lit("Notes on "), _pick(TOPICS, i), F.lit(" "), i.cast("string")).alias("title"), _pick(TOPICS, i).alias("category"), _pick(AUTHORS, number(i, "a")).alias("author"),
        (number(i, "i") % 10 + 1).alias("importance"), F.date_add(F.to_date(F.lit("2024-01-01")), (number(i, "d") % 366).cast("int")).alias("day"), text.alias("text"),
    )
