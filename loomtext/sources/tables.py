"""Tables of records that change: catalog, typed rows, changes, batches with counters, directories, exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What each typed collection holds besides its text; the tags are kept as JSON.
TYPES = {"intents": "intent", "conversations": "role", "knowledge": "category", "apis": "endpoint"}


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """table, column, type, place for each column; reads schemas only."""
    rows = [(t, f.name, f.dataType.simpleString(), i) for t, df in tables.items() for i, f in enumerate(df.schema.fields, 1)]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "table string, column string, type string, place int")


def samples(tables: dict[str, tuple[DataFrame, str]], n: int = 3) -> DataFrame:
    """table, place, row (as JSON): the first rows of each table by its key."""
    each = [df.orderBy(key).limit(n).select(F.lit(t).alias("table"), F.row_number().over(Window.orderBy(key)).alias("place"), F.to_json(F.struct("*")).alias("row")) for t, (df, key) in tables.items()]
    return reduce(DataFrame.unionByName, each)


def exported(df: DataFrame, path: str, kind: str) -> DataFrame:
    """Writes a table as csv (with a header, quoted where a value needs it) or json files, and gives what a reader of these files has."""
    if kind not in ("csv", "json"):
        raise ValueError(f"kind is csv or json, not {kind}")
    out = df.write.mode("error").option("escape", '"')
    (out.option("header", "true").csv(path) if kind == "csv" else out.json(path))
    read = df.sparkSession.read.schema(df.schema)
    return read.option("header", "true").option("escape", '"').option("multiLine", "true").csv(path) if kind == "csv" else read.json(path)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n, state (active or empty)."""
    each = [df.agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n") for t, df in tables.items()]
    return reduce(DataFrame.unionByName, each).withColumn("state", F.when(F.col("n") > 0, "active").otherwise("empty"))


def changed(df: DataFrame, changes: DataFrame, key: str, deleted: str = "deleted", order: str = "at") -> DataFrame:
    """df after changes: rows with its columns, a flag and an order; of one key's changes the last counts. New keys are added, known ones
    replaced, flagged ones taken out. One shuffle on the key, which partial aggregation precedes; no row of df is joined with another."""
    columns = df.columns
    both = df.select(*columns, F.lit(False).alias("_gone"), F.lit(None).cast(changes.schema[order].dataType).alias("_at"))
    both = both.unionByName(changes.select(*columns, F.coalesce(F.col(deleted), F.lit(False)).alias("_gone"), F.col(order).alias("_at")))
    last = both.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*columns, "_gone"), F.struct(F.col("_at").isNotNull(), "_at")).alias("r"))
    return last.select("r.*").where(~F.col("_gone")).select(*columns)


def typed(df: DataFrame, kind: str, key: Column, text: Column, value: Column, tags: Column, most: int = 500) -> DataFrame:
    """id, text (cut), metadata of a typed collection: its kind, its own field (general where missing), the tags as JSON."""
    metadata = F.create_map(F.lit("type"), F.lit(kind), F.lit(TYPES[kind]), F.coalesce(value, F.lit("general")), F.lit("tags"), F.to_json(F.coalesce(tags, F.array().cast("array<string>"))))
    return df.select(F.concat(F.lit(f"{kind}_"), key.cast("string")).alias("id"), F.substring(text, 1, most).alias("text"), metadata.alias("metadata"))


def batch_counters(df: DataFrame, batch: Column, good: Column, chunks: Column) -> DataFrame:
    """batch, success, failed, chunks; rows that fail bring no chunks."""
    ok = F.coalesce(good, F.lit(False))
    return df.groupBy(batch.alias("batch")).agg(F.count_if(ok).alias("success"), F.count_if(~ok).alias("failed"), F.coalesce(F.sum(F.when(ok, chunks)), F.lit(0)).cast("long").alias("chunks"))


def directory(files: DataFrame, folder: str, path: str = "path", size: str = "size") -> DataFrame:
    """Files and bytes directly below each folder within one (that one too): folder, files, size."""
    top = "/" + folder.strip("/")
    inside = files.where(F.startswith(F.col(path), F.lit(top if top == "/" else top + "/")))
    return inside.groupBy(F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"), F.sum(size).cast("long").alias("size"))


def sample_where_short(t: Column, sample: str, least: int = 2000) -> Column:
    return F.when(F.coalesce(F.length(t), F.lit(0)) < least, F.lit(sample)).otherwise(t)


def content_of(t: Column) -> Column:
    """The `content` of a JSON object; other JSON, and what is no JSON, as it is."""
    return F.coalesce(F.get_json_object(t, "$.content"), t)


def histories(df: DataFrame, by: str, order: str, columns: list[str]) -> DataFrame:
    """by, history: the group's rows in order as one JSON array."""
    return df.groupBy(by).agg(F.to_json(F.sort_array(F.collect_list(F.struct(order, *[c for c in columns if c != order])))).alias("history"))


def preferences(df: DataFrame, by: str, order: list[str], name: str, value: str) -> DataFrame:
    """by, name, value: of each of a group's settings the last one."""
    return df.groupBy(by, name).agg(F.max_by(value, F.struct(*order)).alias(value))


def counters(df: DataFrame, by: str, good: Column, took: str) -> DataFrame:
    """Requests, successes, failures, mean and longest time."""
    return df.groupBy(by).agg(F.count("*").alias("requests"), F.count_if(good).alias("good"), F.count_if(~good).alias("bad"), F.round(F.avg(took), 4).alias("mean"), F.round(F.max(took), 4).alias("longest"))


def latest(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The last row of each group."""
    w = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
