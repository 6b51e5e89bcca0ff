"""Streams: sessions with a watermark, windowed counts, and ingest that keeps an index of postings up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lexical import postings


def session_stream(events: DataFrame, user: str, ts: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A row for each closed session; rows later than the watermark are dropped."""
    e = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return e.groupBy(user, F.session_window("_ts", gap).alias("s")).agg(F.count("*").alias("n")).select(user, F.col("s.start").alias("begin"), F.col("s.end").alias("end"), "n")


def windowed_counts(events: DataFrame, ts: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    e = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    return e.groupBy(F.window("_ts", width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("begin"), by, "n")


#: Parts of the table of known keys; a batch reads those that its own keys fall in.
PARTS = 256


def ingest(stream: DataFrame, path: str, checkpoint: str, key: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Each batch's new documents and their postings are appended under its number, so that a batch which is run again replaces itself;
    documents that are stored already are passed over. Known keys are a table of their own, in parts by hash: a batch reads no documents."""

    part = F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int").alias("part")

    def batch(df: DataFrame, n: int) -> None:
        spark = df.sparkSession
        new = df.dropDuplicates([key])
        try:
            parts = [r["part"] for r in new.select(part).distinct().collect()]
            known = spark.read.parquet(f"{path}/keys").where(F.col("part").isin(parts) & (F.col("batch") != n)).select(key)
            new = new.join(known, key, "left_anti").select(df.columns)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        new.write.mode("overwrite").parquet(f"{path}/documents/batch={n}")
        stored = spark.read.schema(new.schema).parquet(f"{path}/documents/batch={n}")
        postings(stored, key, text).write.mode("overwrite").parquet(f"{path}/postings/batch={n}")
        stored.select(key, part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{path}/keys/batch={n}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
