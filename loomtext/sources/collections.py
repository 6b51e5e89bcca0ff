"""Collections: named tables of (id, text, embedding, metadata) in one folder, and file readers.

A change writes a part with what is new, or a list of what goes, and then a version that names the parts and lists of every collection. A version
can be made once: readers never see half of a change, and of two writers at the same time the second one fails. Nothing is written again but by
compact(). Folders are reached through Spark alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "ip")
SCHEMA = "id string, text string, embedding array<float>, metadata map<string, string>"
VERSION = "version long, collections array<struct<name:string,metric:string,parts:array<string>,gone:array<string>>>"


class Collections:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _state(self) -> tuple[int, dict[str, dict]]:
        try:
            rows = self.spark.read.schema(VERSION).json(f"{self.path}/_versions").orderBy(F.desc("version")).limit(1).collect()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = []
        return (rows[0]["version"], {c["name"]: c.asDict() for c in rows[0]["collections"]}) if rows else (0, {})

    def _commit(self, version: int, known: dict[str, dict]) -> None:
        rows = [(version + 1, [tuple(c[k] for k in ("name", "metric", "parts", "gone")) for c in known.values()])]
        self.spark.createDataFrame(rows, VERSION).coalesce(1).write.mode("error").json(f"{self.path}/_versions/at={version + 1}")

    def _put(self, name: str, **changes) -> None:
        version, known = self._state()
        self._commit(version, known | {name: {"name": name, "metric": "cosine", "parts": [], "gone": []} | known.get(name, {}) | changes})

    def names(self) -> list[str]:
        return sorted(self._state()[1])

    def create(self, name: str, metric: str = "cosine", reset: bool = False) -> None:
        """A collection that is there stays as it is, unless it is to be made anew, with this metric."""
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric}")
        if name not in self._state()[1] or reset:
            self._put(name, metric=metric, parts=[], gone=[])

    def delete_collection(self, name: str) -> None:
        version, known = self._state()
        del known[name]
        self._commit(version, known)

    def metric(self, name: str) -> str:
        return self._state()[1][name]["metric"]

    def update_metric(self, name: str, metric: str) -> None:
        """Changes how a collection is searched; its rows stay."""
        if metric not in METRICS:
            raise ValueError(f"unknown metric {metric}")
        self.metric(name)
        self._put(name, metric=metric)

    def _rows(self, c: dict, numbered: bool = False) -> DataFrame:
        """The rows of all parts but those that a later list takes out; numbered: with the place of their part."""
        own = self.spark.createDataFrame([], f"{SCHEMA}, _part int")
        if c["parts"]:
            number = F.element_at(F.create_map(*[F.lit(x) for i, p in enumerate(c["parts"]) for x in (p, i)]), F.element_at(F.split(F.input_file_name(), "/"), -2))
            own = self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{c['name']}/{p}" for p in c["parts"]]).withColumn("_part", number)
        if c["gone"]:
            gone = self.spark.read.schema("id string, upto int").parquet(*[f"{self.path}/{c['name']}/{g}" for g in c["gone"]]).groupBy("id").agg(F.max("upto").alias("upto")).alias("g")
            own = own.alias("r").join(gone, (F.col("r.id") == F.col("g.id")) & (F.col("_part") < F.col("upto")), "left_anti")
        return own if numbered else own.drop("_part")

    def get(self, name: str, ids: list[str] | None = None) -> DataFrame:
        df = self._rows(self._state()[1][name])
        return df if ids is None else df.where(F.col("id").isin(ids))

    def count(self, name: str) -> int:
        return self.get(name).count()

    def _write(self, name: str, rows: DataFrame) -> str:
        part = uuid.uuid4().hex
        rows.write.parquet(f"{self.path}/{name}/{part}")
        return part

    def add(self, name: str, rows: DataFrame, skip_known: bool = True) -> None:
        """Adds rows as a part; known identifiers are passed over, or replaced."""
        c = self._state()[1][name]
        new, gone = rows.select("id", "text", F.col("embedding").cast("array<float>").alias("embedding"), "metadata").dropDuplicates(["id"]), []
        if c["parts"]:
            if skip_known:
                new = new.join(self._rows(c).select("id"), "id", "left_anti").select(new.columns)
            else:
                gone = [self._write(name, new.select("id", F.lit(len(c["parts"])).alias("upto")))]
        part = self._write(name, new)
        self._put(name, parts=[*c["parts"], part], gone=[*c["gone"], *gone])

    def delete(self, name: str, ids: DataFrame) -> None:
        c = self._state()[1][name]
        if c["parts"]:
            self._put(name, gone=[*c["gone"], self._write(name, ids.select(F.col("id").cast("string").alias("id"), F.lit(len(c["parts"])).alias("upto")))])

    def clear(self, name: str) -> None:
        """Takes all rows out; the collection and its metric stay."""
        self.metric(name)
        self._put(name, parts=[], gone=[])

    def compact(self, name: str) -> None:
        """One part with the rows that are left."""
        c = self._state()[1][name]
        self._put(name, parts=[self._write(name, self._rows(c))], gone=[])

    def documents(self, name: str) -> DataFrame:
        """doc_id, filename, chunks, characters of the documents whose chunks are stored, by the chunks' metadata."""
        m = F.col("metadata")
        rows = self.get(name).select(m["doc_id"].alias("doc_id"), m["filename"].alias("filename"), F.length("text").alias("n"))
        return rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("filename").alias("filename"), F.count("*").alias("chunks"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("characters"))

    def delete_document(self, name: str, doc_id: str) -> bool:
        """Takes a document's chunks out; says whether there were any."""
        own = self.get(name).where(F.col("metadata")["doc_id"] == doc_id).select("id")
        if not own.limit(1).count():
            return False
        self.delete(name, own)
        return True

    def footprint(self, name: str) -> tuple[int, int]:
        """Files and bytes of the parts and lists that are read now."""
        c = self._state()[1][name]
        paths = [f"{self.path}/{name}/{p}" for p in (*c["parts"], *c["gone"])]
        if not paths:
            return 0, 0
        files = self.spark.read.format("binaryFile").load(paths).select("length")
        r = files.agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("b")).first()
        return r["n"], r["b"]

    def stats(self) -> DataFrame:
        """name, metric, rows, state of all collections, in one job."""
        out = self.spark.createDataFrame([(c["name"], c["metric"]) for c in self._state()[1].values()], "name string, metric string")
        rows = None
        for c in self._state()[1].values():
            own = self._rows(c).select(F.lit(c["name"]).alias("name"))
            rows = own if rows is None else rows.unionByName(own)
        if rows is None:
            return out.select("name", "metric", F.lit(0).cast("long").alias("rows"), F.lit("empty").alias("state"))
        n = F.coalesce("rows", F.lit(0).cast("long"))
        return out.join(rows.groupBy("name").agg(F.count("*").alias("rows")), "name", "left").select("name", "metric", n.alias("rows"), F.when(n > 0, "active").otherwise("empty").alias("state"))


KINDS = {"txt": "text", "text": "text", "md": "text", "markdown": "text", "json": "json", "html": "page", "htm": "page"}


def loaded(files: DataFrame, path: str = "path", content: str = "content", pretty: bool = False) -> DataFrame:
    """path, extension, text of files given as bytes; files of other kinds go. Bytes that are no UTF-8 are replaced; a page gives its title and
    its main text; JSON gives its `content`, else itself (with pretty, laid out by two spaces). Null bytes are an empty text."""
    import json

    import pandas as pd

    from ..operators import html

    ext = F.lower(F.regexp_extract(path, "\\.([A-Za-z0-9]+)$", 1))
    rows = files.select(F.col(path).alias("path"), ext.alias("extension"), F.coalesce(F.expr(f"make_valid_utf8({content})"), F.lit("")).alias("text"))
    rows = rows.where(F.col("extension").isin(list(KINDS)))
    body = F.get_json_object("text", "$.content")
    rows = rows.withColumn("text", F.when(F.col("extension") == "json", F.coalesce(body, F.col("text"))).otherwise(F.col("text")))

    def laid_out(t):
        try:
            return json.dumps(json.loads(t), ensure_ascii=False, indent=2)
        except ValueError:
            return t

    def run(frames):
        for f in frames:
            pages = f["extension"].map(KINDS) == "page"
            f.loc[pages, "text"] = [b if b.startswith(a) else f"{a}\n{b}".strip() for a, b in (html.page(x, ["title", "text"]) for x in f.loc[pages, "text"])]
            if pretty:
                whole = (f["extension"] == "json") & f["text"].str.startswith(("{", "["))
                f.loc[whole, "text"] = [laid_out(t) for t in f.loc[whole, "text"]]
            yield pd.DataFrame(f)

    return rows.mapInPandas(run, "path string, extension string, text string")


def processed(files: DataFrame, size: int = 500, overlap: int = 50, path: str = "path", content: str = "content") -> DataFrame:
    """doc_id, filename, file_type, chunk, total_chunks, text of uploaded files: loaded, white space collapsed, cut at boundaries."""
    from pyspark.sql import Window

    from ..functions import text as X
    from ..operators import chunk

    name = F.regexp_extract("path", "([^/]*)$", 1)
    rows = loaded(files, path, content).withColumn("text", X.collapse_runs(F.col("text")))
    rows = rows.select(F.struct(X.document_key(name, F.col("text")).alias("doc_id"), name.alias("filename"), F.col("extension").alias("file_type")).alias("file"), "text")
    cut = chunk.chunked(rows, lambda t: chunk.boundary(t, size, overlap), "file", "text")
    total = F.count("*").over(Window.partitionBy("file"))
    return cut.select("file.*", "chunk", total.alias("total_chunks"), F.col("content").alias("text"))


def read_texts(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("txt", "md", "html", "json")) -> DataFrame:
    """path, extension, text of files with known endings, pages as their markup; bytes that are no UTF-8 are replaced, JSON gives its `content`
    or itself."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", "\\.([A-Za-z0-9]+)$", 1))
    rows = files.select("path", ext.alias("extension"), F.expr("make_valid_utf8(content)").alias("text")).where(ext.isin(list(extensions)))
    body = F.when(F.col("extension") == "json", F.coalesce(F.get_json_object("text", "$.content"), F.col("text"))).otherwise(F.col("text"))
    return rows.select("path", "extension", body.alias("text"))


def append_feedback(rows: DataFrame, path: str) -> None:
    """Adds rows as JSON lines; a reader of the folder sees all that were ever added."""
    rows.write.mode("append").json(path)


def json_strings(df: DataFrame, key: str, column: str, least: int = 10) -> DataFrame:
    """key, path, value: the strings of JSON objects, at any depth, that are longer than least."""
    import json

    import pandas as pd

    def walk(x, path):
        if isinstance(x, dict):
            for k, v in x.items():
                yield from walk(v, f"{path}.{k}" if path else k)
        elif isinstance(x, list):
            for i, v in enumerate(x):
                yield from walk(v, f"{path}[{i}]")
        elif isinstance(x, str) and len(x) > least:
            yield path, x

    def run(frames):
        for f in frames:
            rows = []
            for k, t in zip(f[key], f[column]):
                try:
                    rows += [(k, p, v) for p, v in walk(json.loads(t), "")]
                except (TypeError, ValueError):
                    continue
            yield pd.DataFrame(rows, columns=[key, "path", "value"])

    return df.select(key, column).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, path string, value string")
