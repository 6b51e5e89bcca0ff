"""Exact dedup by Patricia-trie owners.

Documents go by their length and content hash to partitions. A partition inserts whole byte strings into a compressed radix trie, whose
terminal nodes hold the owner (the smallest or largest identifier) and the number of rows. Each scan task first inserts its own rows into a
trie, so that a text which a third of all rows share reaches the next step once for each scan task; a trie over its budget in the second
step spills whole subtrees to files of its task (they are the task's own, and made again if it is run again) and takes them up one at a time.

Nulls: a null text counts as empty; a row without identifier never owns others' texts (its group's owner is null only if all are). Ties:
rows with equal identifiers and texts are one row, repeated: each counts in group_size, all are shown as kept, and drop_copies() leaves one of
them. Rows that share an identifier but not the text are rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, hot_keys, materialize, renamed, shares


class Node:
    __slots__ = ("label", "children", "owner", "count")

    def __init__(self, label: bytes):
        self.label, self.children, self.owner, self.count = label, None, None, 0


def _common(a: bytes, b: bytes, at: int) -> int:
    """How many first bytes of a equal those of b from at on."""
    lo, n = 0, min(len(a), len(b) - at)
    if b.startswith(a[:n], at):
        return n
    step = 64
    while True:  # the blocks grow until one differs, and are then halved
        if a[lo : lo + step] == b[at + lo : at + lo + step]:
            lo, step = lo + step, step * 2
        elif step == 1:
            return lo
        else:
            step //= 2


class PatriciaTrie:
    """Byte strings to (owner, number). With a budget, the largest subtree below the root goes to a file whenever the labels outgrow it."""

    def __init__(self, larger: bool = True, budget: int | None = None, folder: str | None = None, prefix: bytes = b""):
        self.root, self.larger, self.budget, self.folder, self.prefix = Node(b""), larger, budget, folder, prefix
        self.skip, self.held, self.strings, self.by_first, self.spilled = len(prefix), 0, 0, {}, {}

    def better(self, a, b):
        if a is None or b is None:
            return b if a is None else a
        return max(a, b) if self.larger else min(a, b)

    def insert(self, key: bytes, owner, count: int = 1) -> None:
        first = key[self.skip : self.skip + 1]
        if first in self.spilled:
            _record(self.spilled[first], key, owner, count)
            return
        node, at = self.root, self.skip
        while at < len(key):
            children = node.children
            child = children.get(key[at]) if children else None
            if child is None:
                child = Node(key[at:])
                if children is None:
                    node.children = {}
                node.children[key[at]] = child
                self.held += len(child.label) + 200
                self.by_first[first] = self.by_first.get(first, 0) + len(child.label) + 200
                node, at = child, len(key)
                break
            n = _common(child.label, key, at)
            if n < len(child.label):  # the edge ends within its label: a node comes between
                middle = Node(child.label[:n])
                child.label = child.label[n:]
                middle.children = {child.label[0]: child}
                node.children[key[at]] = middle
                self.held += 200
                child = middle
            node, at = child, at + n
        self.strings += not node.count
        node.owner = self.better(node.owner, owner) if node.count else owner
        node.count += count
        if self.budget and self.held > self.budget and self.strings > 1 and self.by_first:
            self._spill()

    def _spill(self) -> None:
        first = max(self.by_first, key=self.by_first.get)
        self.spilled[first] = f = tempfile.TemporaryFile(dir=self.folder)
        child = self.root.children.pop(first[0])
        for key, owner, count in self._walk(child, self.prefix):
            _record(f, key, owner, count)
            self.strings -= 1
        self.held -= self.by_first.pop(first)

    def _walk(self, node: Node, before: bytes) -> Iterator[tuple[bytes, object, int]]:
        stack = [(node, before)]
        while stack:
            node, before = stack.pop()
            key = before + node.label
            if node.count:
                yield key, node.owner, node.count
            if node.children:
                stack += [(c, key) for c in node.children.values()]

    def items(self) -> Iterator[tuple[bytes, object, int]]:
        """All strings; the spilled subtrees last, each as a trie of its own that branches one byte further on."""
        yield from self._walk(self.root, self.prefix)
        self.root = Node(b"")
        for first, f in self.spilled.items():
            f.seek(0)
            sub = PatriciaTrie(self.larger, self.budget, self.folder, self.prefix + first)
            for key, owner, count in _records(f):
                sub.insert(key, owner, count)
            f.close()
            for key, owner, count in sub.items():
                yield key, owner, count


def _record(f, key: bytes, owner, count: int) -> None:
    f.write(struct.pack("<I?qq", len(key), owner is None, owner or 0, count) + key)


def _records(f) -> Iterator[tuple[bytes, int | None, int]]:
    size = struct.calcsize("<I?qq")
    while head := f.read(size):
        n, null, owner, count = struct.unpack("<I?qq", head)
        yield f.read(n), None if null else owner, count


PARTIAL = "length long, hash long, body binary, owner long, n long"


def _texts(batch: pa.RecordBatch, column: int = 1) -> list[bytes]:
    """bytes.lower() changes A-Z only."""
    return [(x or b"").lower() for x in batch.column(column).cast(pa.large_binary()).to_pylist()]


def partial_owners(larger: bool, budget: int):
    """The scan's own step: a trie of what the task has read; beyond the budget it is sent on and begun anew."""

    def sent(trie: PatriciaTrie) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for key, owner, n in trie.items():
            rows.append((len(key), xxhash.xxh64_intdigest(key) - (1 << 63), key, owner, n))
            held += len(key)
            if held > 8 << 20:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["length", "hash", "body", "owner", "n"])

    def run(batches):
        trie = PatriciaTrie(larger)
        for batch in batches:
            for some in shares(batch, 1):
                for owner, key in zip(some.column(0).to_pylist(), _texts(some)):
                    trie.insert(key, owner)
                    if trie.held > budget:
                        yield from sent(trie)
                        trie = PatriciaTrie(larger)
        yield from sent(trie)

    return run


def final_owners(larger: bool, budget: int):
    """All strings of a partition; length and hash lead each key, so that what meets in a subtree has both in common."""

    def run(batches):
        trie = PatriciaTrie(larger, budget)
        for batch in batches:
            for length, h, body, owner, n in zip(*(c.to_pylist() for c in batch.columns)):
                trie.insert(struct.pack(">Q", h + (1 << 63)) + struct.pack(">Q", length) + body, owner, n)
        rows = []
        for key, owner, n in trie.items():
            rows.append((hashlib.sha256(memoryview(key)[16:]).digest(), owner, n))
            if len(rows) == 20_000:
                yield _out(rows)
                rows = []
        if rows:
            yield _out(rows)

    def _out(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64()))], names=["sha", "keep_id", "group_size"])

    return run


def _digests(batches):
    """turn numbers the task's rows: it deals the rows of a hot text."""
    n = 0
    for batch in batches:
        for some in shares(batch, 1):
            sha = pa.array([hashlib.sha256(x).digest() for x in _texts(some)], pa.binary())
            turn = pa.array(range(n, n + some.num_rows), pa.int64())
            n += some.num_rows
            yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), sha, turn], names=["id", "sha", "turn"])


def owners(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "largest", partial_bytes: int = 64 << 20, trie_bytes: int = 192 << 20) -> DataFrame:
    """One row for each different text: its sha256, the identifier of the row that stays, the number of rows."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep is largest or smallest, not {keep}")
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
    partial = rows.mapInArrow(partial_owners(keep == "largest", partial_bytes), PARTIAL)
    return partial.repartition("length", "hash").mapInArrow(final_owners(keep == "largest", trie_bytes), "sha binary, keep_id long, group_size long")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """One row per document: key, keep_id, group_size, kept and the sha256 of its text in lower case (A-Z only)."""
    found = materialize(owners(docs, key, text, keep), "owners")
    hot = F.broadcast(hot_keys(found.select("sha", F.col("group_size").alias("n")), ["sha"]))
    salted = found.join(hot, "sha", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)))
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text")).mapInArrow(_digests, "id long, sha binary, turn long")
    rows = rows.join(hot, "sha", "left").withColumn("salt", F.coalesce(F.pmod("turn", "salts"), F.lit(0).cast("long")))
    out = rows.select("id", "sha", "salt").join(salted.drop("salts"), ["sha", "salt"])
    return out.select(F.col("id").alias(key), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "largest") -> DataFrame:
    """Of each text, the row with the owner's identifier, with all its columns; of several such (repeated rows), one."""
    own, at = renamed(docs), docs.columns.index(text)
    names = own.columns
    tagged = own.select(*names, F.col(names[docs.columns.index(key)]).cast("long").alias("id"), F.col(names[at]).cast("binary").alias("body"))

    def run(batches):
        seen: set[tuple] = set()
        for batch in batches:
            for some in shares(batch, len(names) + 1):
                sha = [hashlib.sha256(x).digest() for x in _texts(some, len(names) + 1)]
                fresh = []
                for x in zip(some.column(len(names)).to_pylist(), sha):  # repeats within the task go here
                    fresh.append(x not in seen)
                    seen.add(x)
                if len(seen) > 500_000:
                    seen = set()
                rows = pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(sha, pa.binary())], names=[*names, "id", "sha"])
                yield rows.filter(pa.array(fresh, pa.bool_()))

    schema = T.StructType([*own.schema.fields, T.StructField("id", T.LongType()), T.StructField("sha", T.BinaryType())])
    unknown = lambda c: [F.coalesce(c, F.lit(0)).alias("id0"), F.col(c).isNull().alias("unknown")]
    rows = tagged.mapInArrow(run, schema).select(*names, "sha", *unknown("id"))
    kept = rows.join(owners(docs, key, text, keep).select("sha", *unknown("keep_id")), ["sha", "id0", "unknown"], "left_semi")
    # the join has brought equal rows together and in order: numbering them moves nothing
    again = Window.partitionBy("sha", "id0", "unknown").orderBy("sha")
    return kept.withColumn("again", F.row_number().over(again)).where("again = 1").select(*names).toDF(*docs.columns)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir))


QUERIES = {"op8_exact_dedup": op8_exact_dedup}
ORACLES = {
    "op8_exact_dedup": """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM t"""
}
