"""Folders that all machines of a cluster share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; unset, a temporary one on a single machine, and an error elsewhere."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        app = spark.sparkContext.applicationId
        known = _OWN.setdefault(app, _OWN.get(app) or f"file://{tempfile.mkdtemp(prefix='loomtext-')}")
    return known.rstrip("/")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is there is deleted when the driver ends."""
    path = f"{shared_dir(spark)}/loomtext-{tag}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _forget(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone by now; the folder is the cluster's to clean then
        pass


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: what follows reads the table, whatever becomes of the executors."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
