"""Hierarchical weighted hash tree: shards below racks below regions, reached by weighted hash draws.

The descent goes level by level. At a node each child draws an exponential variate from the hash of (key, child) at the rate of the child's
whole weight, and the child with the least draw is taken: with probability in proportion to its weight. Only the children of the nodes on the
way are drawn, so a row takes as many hashes as its path has siblings. A draw depends on nothing but the key, the child and its weight: if the
weight of a shard changes, so do those of its rack and region, and keys move only into or out of these subtrees, and among the children of
nodes on the way to it. A shard that joins a rack therefore also moves keys between its siblings. One that stands in a region of its own does
not: it takes keys for itself only, which is how a tree grows here beyond the shards it was planned with.
Plain column expressions; no row leaves the JVM.

Nulls: a null key is its own key (the text "null"); a null text has no bytes. Rows repeated in full get the same shard and slots of their
own. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, running


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


#: Shards that a tree is planned with where nothing else is said; with fewer it is planned with these.
PLANNED = 8


def topology(shards: int, per_rack: int = 2, racks: int = 2, planned: int | None = None) -> list[Shard]:
    """The planned shards (all, unless told otherwise) fill racks, and racks fill regions; each later one has a region of its own."""
    planned = shards if planned is None else planned
    last = -(-planned // (per_rack * racks))
    own = [Shard(i // (per_rack * racks), i // per_rack, i) for i in range(min(shards, planned))]
    return own + [Shard(last + i - planned, i, i) for i in range(planned, shards)]


#: Bits of a draw: 52 of md5's, so that other engines give the same draws.
HEX_DIGITS = 13


def draw(key: Column, level: str, child: int, weight: float) -> Column:
    name = F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("null")), F.lit(level), F.lit(str(child)))
    u = (F.conv(F.substring(F.md5(name), 1, HEX_DIGITS), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**HEX_DIGITS))
    return -F.log(u) / F.lit(float(weight))


LEVELS = ("region", "rack", "shard")


def place(df: DataFrame, key: str, shards: list[Shard], out: str) -> DataFrame:
    """Adds the column out: the shard that the descent reaches. Shards with no weight get nothing."""
    return df.withColumn(out, descent(F.col(key), shards))


def descent(key: Column, shards: list[Shard], level: int = 0) -> Column:
    below: dict[int, list[Shard]] = {}
    for s in shards:
        if s.weight > 0:
            below.setdefault(getattr(s, LEVELS[level]), []).append(s)
    if not below:
        raise ValueError("no shard has a weight")
    children = sorted(below)
    if level + 1 == len(LEVELS):
        ends = [F.lit(c) for c in children]
    else:
        ends = [descent(key, below[c], level + 1) for c in children]
    if len(children) == 1:
        return ends[0].cast("int")
    draws = [draw(key, LEVELS[level], c, sum(s.weight for s in below[c])) for c in children]
    # the place of the least draw, by one array, so that each is drawn once; of equal draws the first
    taken = F.transform(F.array(F.array(*draws)), lambda d: F.array_position(d, F.array_min(d)))[0]
    out = F.transform(F.array(taken), lambda i: _branch(i, ends))[0]
    return out.cast("int")


def _branch(i: Column, ends: list[Column]) -> Column:
    """Only the branch that is taken is computed."""
    out = ends[-1]
    for n in range(len(ends) - 1, 0, -1):
        out = F.when(i == n, ends[n - 1]).otherwise(out)
    return out


def assign(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", planned: int | None = None) -> DataFrame:
    """One row per document: key, size, text_crc32, law, shard, its place (slot) in the shard in key order, grown_shard with one more shard.
    planned: of how many shards the tree was made, if it has grown since; PLANNED at most unless it is given. So from that number on, the shards
    of one more are always the grown_shard of this many."""
    planned = min(shards, PLANNED) if planned is None else planned
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("crc"))
    rows = place(place(rows, "key", topology(shards, planned=planned), "shard"), "key", topology(shards + 1, planned=planned), "grown_shard")
    ranked = running(rows, "shard", ["key", "crc", "size"], "size", "shards")
    return ranked.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("key").alias("law"), "shard", F.col("before_rows").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 8, key: str = "doc_id", text: str = "text", file_bytes: int = 128 << 20, planned: int | None = None) -> None:
    """The documents themselves, a folder shard=0, shard=1, ... of Parquet files for each shard, of about file_bytes of text each: a large
    shard is written by as many tasks. planned: as for assign(), so that folders of more shards are those of fewer but for what the new ones take.
    Rows with a null key go to that key's shard, null and empty texts are written as they are. A table that has a column named shard already is
    refused."""
    if "shard" in [c.lower() for c in docs.columns]:
        raise ValueError("the table has a column named shard already")
    own = docs.withColumn("shard", descent(F.col(key), topology(shards, planned=min(shards, PLANNED) if planned is None else planned)))
    sums = own.groupBy("shard").agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 64).alias("n")).collect()  # a row for each shard
    files = {r["shard"]: -(-r["n"] // file_bytes) for r in sums}
    count = F.lit(1)
    for s, n in files.items():
        count = F.when(F.col("shard") == s, F.lit(int(n))).otherwise(count)
    part = F.pmod(F.xxhash64(key, text), count)
    own.repartition(max(1, sum(files.values())), "shard", part).write.partitionBy("shard").parquet(path)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(documents(spark, sf_dir), 8)


QUERIES = {"op9_sharding": op9_sharding}
_DRAW = "-ln((('0x' || substr(md5(doc_id || '/{}/' || {}), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)"
#: crc32 bit by bit; the tree of eight shards level by level, where siblings weigh the same, and the ninth in a region of its own.
ORACLES = {
    "op9_sharding": f"""
WITH b AS (SELECT doc_id, coalesce(text, '') AS body, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes FROM documents),
c AS (SELECT doc_id, strlen(body) + 1 AS size, xor(list_reduce(bytes, lambda a, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda s, k: xor(s >> 1, 3988292384 * (s & 1)), xor(a, x)), 4294967295::BIGINT), 4294967295) AS crc FROM b),
r AS (SELECT *, {_DRAW.format('region', 0)} AS r0, {_DRAW.format('region', 1)} AS r1, {_DRAW.format('region', 2)} AS r2 FROM c),
g AS (SELECT *, CASE WHEN r0 <= r1 THEN 0 ELSE 1 END AS region FROM r),
k AS (SELECT *, CASE WHEN {_DRAW.format('rack', '(2 * region)')} <= {_DRAW.format('rack', '(2 * region + 1)')} THEN 2 * region ELSE 2 * region + 1 END AS rack FROM g),
s AS (SELECT *, CASE WHEN {_DRAW.format('shard', '(2 * rack)')} <= {_DRAW.format('shard', '(2 * rack + 1)')} THEN 2 * rack ELSE 2 * rack + 1 END AS shard FROM k)
SELECT doc_id, size, crc AS text_crc32, 'key' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot,
       (CASE WHEN r2 < least(r0, r1) / 4 THEN 8 ELSE shard END)::INTEGER AS grown_shard FROM s"""
}
