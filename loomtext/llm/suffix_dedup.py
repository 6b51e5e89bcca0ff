"""Suffix-array dedup by longest previous factors.

A byte goes if a string of 100 bytes (by default) that covers it also starts earlier: in a document with a smaller identifier, or earlier in
the same one. Starts whose longest previous factor reaches 100 are found exactly, without sorting all suffixes of the corpus in one place:

1. Equal texts are one class, by their whole sha256; all of a class but its smallest identifier go whole.
2. Every string of 100 bytes has one anchor: the leftmost of its 24-byte strings with the least hash. Equal strings have the same anchor at
   the same place, so runs of starts with one anchor are dealt by the anchor's hash, and anchors that occur once are dropped. A scan task sends
   the first run of an anchor by that hash alone; the others that it meets are known to repeat, and are dealt to many tasks.
3. Runs that are equal as a whole (anchor, place, bytes) keep the first; the others go without being looked at again.
4. Where an anchor still has several different runs, their bytes are sent to one task, which sorts the suffixes of all starts (by their first
   100 bytes) and takes from the previous and next smaller positions in suffix order each start's longest previous factor, up to 100 bytes: a
   start that reaches all of them has an earlier match. An anchor with more runs than a task should hold is dealt on by the strings' own hashes.
5. The covered bytes of each class are cut out of its text.

Whole runs are compared by two independent 64-bit hashes (the anchor's and XXH3 of the run), strings in 4. by their bytes. Classes are
numbered by 8 bytes of their sha256; numbers that two texts share are found and replaced. Nulls: a null text is empty; a null identifier is
larger than any other. Repeated rows (equal identifier and text) are one document and get the same result. Rows that share an identifier but
not the text are documents of their own, in the order of their numbers. Texts below 100 bytes stay whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BYTE_KEYS, documents, likely, materialize, mix64, powers, release, shares, slices, text_bytes

#: Positions that numpy works on at once; places within a block have 16 bits.
BLOCK = 1 << 16

def number(digest: bytes, bits: int, others: dict[bytes, int]) -> int:
    """A class's number: the first bits of its text's sha256, unless another text has the same ones."""
    return others.get(digest, (int.from_bytes(digest[:8], "little") & ((1 << bits) - 1)) - (1 << bits - 1))


def anchors(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: for each run of starts with one anchor its hash, the hash of its bytes (with the anchor's place and the number
    of starts), the first start, the anchor's place after it, and the number of starts."""
    w = length - gram + 1
    out: list[tuple[np.ndarray, ...]] = []
    up, down = powers(BLOCK + length + 1)
    ends = at[1:]
    for lo in range(0, len(data) - length + 1, BLOCK - length):
        part = data[lo : lo + BLOCK]
        starts = min(len(part) - length + 1, BLOCK - length)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(BYTE_KEYS[part] * up[: len(part)], out=sums[1:])
        g = mix64((sums[gram:] - sums[:-gram]) * down[: len(part) - gram + 1])
        c = (g & np.uint64(0xFFFFFFFFFFFF0000)) | np.arange(len(g), dtype=np.uint64)
        size = 1
        while 2 * size <= w:
            c = np.minimum(c[:-size], c[size:])
            size *= 2
        if size < w:
            c = np.minimum(c[: len(c) - (w - size)], c[w - size :])
        place = (c[:starts] & np.uint64(0xFFFF)).astype(np.int64)
        first, last = np.searchsorted(ends, [lo, lo + starts], side="right")
        if first == last and lo + starts - 1 + length <= ends[min(first, len(ends) - 1)]:
            s = np.arange(starts)
            p = place
        else:
            text_end = np.repeat(ends[first : last + 1], np.diff(np.concatenate([[lo], np.clip(ends[first : last + 1], lo, lo + starts)])))
            s = np.flatnonzero(np.arange(lo, lo + len(text_end)) + length <= text_end)
            p = place[s]
        if not len(s):
            continue
        new = np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)])
        begin = np.flatnonzero(new)
        count = np.diff(np.concatenate([begin, [len(s)]]))
        out.append((g[p[begin]], s[begin] + lo, p[begin] + lo, count))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h, a, p, count = (np.concatenate(x) for x in zip(*out))
    # a run that a block's end cut is made one again: where a text's runs begin must not hang on what lies before it
    first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (a[1:] != a[:-1] + count[:-1])]))
    h, a, p, count = h[first], a[first], p[first] - a[first], np.add.reduceat(count, first)
    raw, ends, mark = memoryview(data), (a + count - 1 + length).tolist(), (p << 8 | count).tolist()
    seg = np.fromiter((xxhash.xxh3_64_intdigest(raw[x:y], z) for x, y, z in zip(a.tolist(), ends, mark)), np.uint64, len(a))
    return h, seg, a, p, count


#: packed holds the first start (48 bits), the anchor's place after it (8), the number of starts less one (8). deal is 0 for an anchor that a
#: task has met once, 1 for the first of several, more for the others: those are known to repeat.
ANCHORS = "h long, deal int, seg long, cls long, packed long"
#: Parts of the runs of an anchor that are known to repeat.
PARTS = 1024


def _anchor_rows(length: int, gram: int, bits: int, others: dict, at_once: int = 200_000):
    names = ["h", "deal", "seg", "cls", "packed"]

    def dealt(held):
        h, seg, cls, packed = (np.concatenate(c) for c in zip(*held))
        order = np.argsort(h, kind="stable")
        new = np.concatenate([[True], h[order][1:] != h[order][:-1]])
        several = ~new
        several[:-1] |= ~new[1:]
        deal = np.empty(len(h), np.int32)
        deal[order] = np.where(~several, 0, np.where(new, 1, 2 + (packed[order] >> 16) % PARTS))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (h, deal, seg, cls, packed)], names=names)

    def run(batches):
        seen: set[bytes] = set()
        held, size = [], 0
        for batch in batches:
            for some in shares(batch, 0):
                raw = some.column(0)
                sha = [hashlib.sha256(x.as_buffer() if x.is_valid else b"").digest() for x in raw]
                fresh = np.zeros(len(sha), bool)
                for i, c in enumerate(sha):
                    if c not in seen:
                        seen.add(c)
                        fresh[i] = True
                if len(seen) > 500_000:
                    seen = set()
                cls = np.array([number(x, bits, others) for x, y in zip(sha, fresh) if y], np.int64)
                data, at = text_bytes(raw.filter(pa.array(fresh)))
                for lo, hi in slices(at):
                    own = at[lo : hi + 1] - at[lo]
                    h, seg, s, p, n = anchors(data[at[lo] : at[hi]], own, length, gram)
                    if len(h):
                        row = np.searchsorted(own, s, side="right") - 1
                        held.append((h.view(np.int64), seg.view(np.int64), cls[lo + row], ((s - own[row]) << 16) | (p << 8) | (n - 1)))
                        size += len(h)
                    if size >= at_once:
                        yield from dealt(held)
                        held, size = [], 0
        if held:
            yield from dealt(held)

    return run


def _repeated(batches):
    """Of rows sorted by h and deal: those that repeat, by their own task's word or by another's."""
    last, waiting = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        h, deal = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        same = h[1:] == h[:-1]
        keep = np.concatenate([[last is not None and h[0] == last], same]) | (deal > 0)
        keep[:-1] |= same
        if waiting is not None and h[0] == last:
            yield waiting
        waiting = None
        if keep.any():
            yield batch.filter(pa.array(keep))
        if not keep[-1]:
            waiting = batch.slice(batch.num_rows - 1)
        last = h[-1]


def smaller_before(order: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of a suffix order (positions of the text): the nearest place before it whose position is smaller (-1: none), and how
    many bytes the two suffixes share; common[i] is what the suffixes at places i - 1 and i share. Places jump over each other's answers, all
    at once, until each has found a smaller position."""
    n = len(order)
    at, low = np.arange(n) - 1, common.copy()
    todo = np.flatnonzero(at >= 0)
    todo = todo[order[at[todo]] > order[todo]]
    while len(todo):
        over = at[todo]  # a place with a greater position: whatever it jumps over is greater too
        low[todo] = np.minimum(low[todo], low[over])
        at[todo] = at[over]
        todo = todo[(at[todo] >= 0)]
        todo = todo[order[at[todo]] > order[todo]]
    return at, np.where(at >= 0, low, 0)


def previous_factor(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """windows: strings of one length in the order of their positions, the beginnings of suffixes. For each position, the longest previous
    factor (how many first bytes an earlier one shares with it at most) and the earlier position that has it (-1 if nothing is shared).

    Suffixes are sorted by these strings, equal ones by position. The longest common prefix with any smaller position is that with the
    previous or the next smaller position in suffix order."""
    n, length = len(windows), windows.dtype.itemsize
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(windows, kind="stable")
    row = windows[order].view(np.uint8).reshape(n, length)
    common = np.zeros(n, np.int64)
    for lo in range(1, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        same = row[lo:hi] == row[lo - 1 : hi - 1]
        common[lo:hi] = np.where(same.all(axis=1), length, same.argmin(axis=1))
    before, a = smaller_before(order, common)
    after, b = smaller_before(order[::-1], np.concatenate([common[:1] * 0, common[:0:-1]]))
    after, b = np.where(after[::-1] >= 0, n - 1 - after[::-1], -1), b[::-1]
    best, place = np.maximum(a, b), np.where(a >= b, before, after)
    factor, source = np.empty(n, np.int64), np.empty(n, np.int64)
    factor[order] = best
    source[order] = np.where(best > 0, order[place], -1)
    return factor, source


def _factors(length: int, at_once: int = 200_000):
    """Rows (h, rep, cls, packed, bytes) sorted by h, rep, cls, packed: the runs of starts that have an earlier match."""

    def found(rep, cls, packed, body):
        data = np.frombuffer(b"".join(body), np.uint8)
        size = np.fromiter(map(len, body), np.int64, len(body))
        n = (packed & 0xFF) + 1
        begin = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(n)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        windows = np.lib.stride_tricks.sliding_window_view(data, length)[begin[owner] + step]
        gone = np.flatnonzero(previous_factor(np.ascontiguousarray(windows).view(f"S{length}").ravel())[0] >= length)
        if not len(gone):
            return None
        new = np.concatenate([[True], (gone[1:] != gone[:-1] + 1) | (owner[gone[1:]] != owner[gone[:-1]])])
        first = np.flatnonzero(new)
        i = gone[first]
        count = np.diff(np.concatenate([first, [len(gone)]]))
        own = owner[i]
        values = [rep[own], cls[own], (packed[own] >> 16) + step[i], count]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names=["rep", "cls", "start", "count"])

    def run(batches):
        held, size = [], 0  # whole anchors only are worked on
        for batch in batches:
            h = batch.column(0).to_numpy()
            if not len(h):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(h[1:] != h[:-1]) + 1, [len(h)]])
            starts = np.concatenate([[0], np.cumsum((batch.column(3).to_numpy() & 0xFF) + 1)])
            lo = 0
            if held and held[-1].column(0)[held[-1].num_rows - 1].as_py() != h[0] and size > at_once:
                out = _joined(held, found)
                if out is not None:
                    yield out
                held, size = [], 0
            for c in cuts[1:-1]:
                if size + starts[c] - starts[lo] > at_once:
                    out = _joined([*held, batch.slice(lo, c - lo)], found)
                    if out is not None:
                        yield out
                    held, size, lo = [], 0, c
            held.append(batch.slice(lo))
            size += int(starts[-1] - starts[lo])
        if held and (out := _joined(held, found)) is not None:
            yield out

    return run


def _joined(batches, found):
    t = pa.Table.from_batches(batches).combine_chunks()
    return found(*(t.column(c).to_numpy() for c in ("rep", "cls", "packed")), t.column("body").to_pylist())


def merged(start: list[int], count: list[int], length: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that strings at these starts cover."""
    out: list[list[int]] = []
    for s, e in sorted((s, s + n - 1 + length) for s, n in zip(start, count)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(a, b) for a, b in out]


def _digests(batches):
    for batch in batches:
        for some in shares(batch, 1):
            raw = [x.as_buffer() if x.is_valid else b"" for x in some.column(1)]
            sha = pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(x) for x in raw], pa.int64()), sha], names=["id", "n_bytes", "sha256"])


class SuffixDedup:
    """documents(): a row per document with the spans that go; removed(): those spans by class."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 100, gram: int = 24, hot: int = 50_000, bits: int = 64):
        """hot: different runs of an anchor that one task holds at most; bits: of the sha256 that number the classes."""
        if not 0 < gram < length or length - gram > 200:
            raise ValueError("gram is below length, by 200 at most")
        self.length, self.gram, self.hot, self.bits = length, gram, hot, bits
        self.docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("binary").alias("text"))
        digests = materialize(self.docs.mapInArrow(_digests, "id long, n_bytes long, sha256 binary"), "rows")
        last = F.coalesce("id", F.lit((1 << 63) - 1))
        classes = digests.groupBy("sha256").agg(F.min(last).alias("rep"), F.first("n_bytes").alias("n_bytes"))
        self.others = {}
        numbered = materialize(self._numbered(classes), "classes")
        # two of n texts share a number about n * n / 2 ** 65 times: 3 times among ten thousand million
        shared = numbered.groupBy("cls").agg(F.count("*").alias("n"), F.collect_list("sha256").alias("sha")).where("n > 1")
        for r in shared.collect():
            for sha in sorted(map(bytes, r["sha"]))[1:]:
                self.others[sha] = int.from_bytes(sha[8:16], "little", signed=True)
        if self.others:
            release(numbered)
            numbered = materialize(self._numbered(classes), "classes")
            if numbered.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
                raise RuntimeError("texts share their numbers still")
        self.classes = numbered
        self.rows = digests

    def _numbered(self, digests: DataFrame) -> DataFrame:
        """Adds cls to rows that begin with sha256 and have longs only after it."""
        bits, others = self.bits, self.others

        def run(batches):
            for batch in batches:
                cls = pa.array([number(x.as_buffer().to_pybytes(), bits, others) for x in batch.column(0)], pa.int64())
                yield pa.RecordBatch.from_arrays([*batch.columns, cls], names=[*batch.schema.names, "cls"])

        return digests.mapInArrow(run, T.StructType([*digests.schema.fields, T.StructField("cls", T.LongType())]))

    def _texts(self, wanted: DataFrame) -> DataFrame:
        """(cls, text) of the classes in wanted, from their first documents. Repeated rows are made one before they are sent, by task."""
        owners = materialize(wanted.join(self.classes.select("cls", "rep"), "cls").select("cls", F.col("rep").alias("id")), "wanted")
        bits, others = self.bits, self.others

        def numbered(batches):
            seen = set()
            for batch in batches:
                for some in shares(batch, 1):
                    cls = [number(hashlib.sha256(x.as_buffer() if x.is_valid else b"").digest(), bits, others) for x in some.column(1)]
                    fresh = []
                    for x in zip(some.column(0).to_pylist(), cls):
                        fresh.append(x not in seen)
                        seen.add(x)
                    if len(seen) > 500_000:
                        seen = set()
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(cls, pa.int64()), some.column(1)], names=["id", "cls", "text"]).filter(pa.array(fresh, pa.bool_()))

        near = likely(self.docs.select(F.coalesce("id", F.lit((1 << 63) - 1)).alias("id"), "text"), owners, ["id"], numbered, "id long, cls long, text binary")
        return near.join(owners, ["cls", "id"]).select("cls", "text").dropDuplicates(["cls"])

    def removed(self) -> DataFrame:
        """(cls, start, count): runs of starts whose strings have an earlier match, of the classes' first documents."""
        length = self.length
        dealt = self.docs.select("text").mapInArrow(_anchor_rows(length, self.gram, self.bits, self.others), ANCHORS)
        dealt = dealt.repartition("h", F.greatest("deal", F.lit(1))).sortWithinPartitions("h", "deal")
        again = dealt.mapInArrow(_repeated, ANCHORS).join(self.classes.select("cls", "rep"), "cls")
        again = materialize(again.select("h", "seg", "rep", "cls", "packed"), "anchors")
        place = F.struct("rep", "cls", "packed")
        first = again.groupBy("h", "seg").agg(F.min(place).alias("first"), F.count("*").alias("n"))
        first = materialize(first.select("h", "seg", "first.*", "n"), "firsts")
        lead = first.where("n > 1").select("h", "seg", F.col("rep").alias("r"), F.col("cls").alias("c"), F.col("packed").alias("p"))
        run = [F.shiftright("packed", 16).alias("start"), (F.col("packed").bitwiseAND(0xFF) + 1).alias("count")]
        whole = again.join(lead, ["h", "seg"]).where("cls <> c OR packed <> p").select("cls", *run).distinct()
        several = first.groupBy("h").agg(F.count("*").alias("runs")).where("runs > 1")
        todo = materialize(first.join(several, "h").select("h", "rep", "cls", "packed", "runs"), "todo")
        places = todo.groupBy("cls").agg(F.collect_list(F.struct("h", "rep", "packed", (F.col("runs") > self.hot).alias("hot"))).alias("places"))
        texts = self._texts(todo.select("cls").distinct())

        def cut(batches):
            for batch in batches:
                for some in shares(batch, 1, rows=64):
                    rows = []
                    for cls, text, own in zip(*(c.to_pylist() for c in some.columns)):
                        for x in own:
                            s, n = x["packed"] >> 16, (x["packed"] & 0xFF) + 1
                            rows.append((x["h"], x["rep"], cls, x["packed"], text[s : s + n - 1 + length], x["hot"]))
                    kinds = [pa.int64()] * 4 + [pa.binary(), pa.bool_()]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["h", "rep", "cls", "packed", "body", "hot"])

        bodies = texts.join(places, "cls").select("cls", "text", "places").mapInArrow(cut, "h long, rep long, cls long, packed long, body binary, hot boolean")
        very = todo.where(F.col("runs") > self.hot).limit(1).count() > 0
        if very:
            bodies = materialize(bodies, "bodies")
        sorted_bodies = bodies.where("NOT hot").drop("hot").repartition("h").sortWithinPartitions("h", "rep", "cls", "packed")
        matched = sorted_bodies.mapInArrow(_factors(length), "rep long, cls long, start long, count long").select("cls", "start", "count")
        out = whole.unionByName(matched)
        if very:
            # an anchor of very many different runs: its strings are dealt by their own bytes, and each scan task sends the first one only
            at = F.explode(F.sequence(F.lit(0).cast("long"), F.col("packed").bitwiseAND(0xFF)))
            strings = bodies.where("hot").withColumn("i", at).withColumn("start", F.shiftright("packed", 16) + F.col("i"))
            strings = strings.select("rep", "cls", "start", F.sha2(F.substring("body", F.col("i").cast("int") + 1, F.lit(length)), 256).alias("s"))
            lead = strings.groupBy("s").agg(F.min(F.struct("rep", "cls", "start")).alias("first"), F.count("*").alias("n")).where("n > 1").select("s", "first")
            later = strings.join(lead, "s").where("cls <> first.cls OR start <> first.start")
            out = out.unionByName(later.select("cls", "start", F.lit(1).cast("long").alias("count")))
        return out

    def kept(self) -> DataFrame:
        """(cls, spans, kept): classes whose first document loses bytes; the maximal runs of bytes that go, and the bytes that stay."""
        length = self.length
        runs = materialize(self.removed(), "removed").groupBy("cls").agg(F.collect_list("start").alias("start"), F.collect_list("count").alias("count"))
        runs = materialize(runs, "runs")
        texts = self._texts(runs.select("cls"))

        def cut(batches):
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            for batch in batches:
                for some in shares(batch, 1, rows=256):
                    rows = []
                    for cls, text, start, count in zip(*(c.to_pylist() for c in some.columns)):
                        spans = merged(start, count, length)
                        edges = [0, *(x for s in spans for x in s), len(text)]
                        rows.append((cls, [{"start": a, "end": b} for a, b in spans], b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), span, pa.binary()))], names=["cls", "spans", "kept"])

        return texts.join(runs, "cls").select("cls", "text", "start", "count").mapInArrow(cut, "cls long, spans array<struct<start: long, end: long>>, kept binary")

    def documents(self) -> DataFrame:
        """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
        sums = self.kept().select("cls", F.size("spans").cast("long").alias("spans"), F.octet_length("kept").cast("long").alias("left"), F.sha2("kept", 256).alias("sha"))
        rows = self.rows.join(self.classes.select("sha256", "cls", "rep"), "sha256").join(sums, "cls", "left")
        mine = F.coalesce("id", F.lit((1 << 63) - 1)) == F.col("rep")
        copy = ~mine & (F.col("n_bytes") >= self.length)
        pick = lambda whole, cut, none: F.when(copy, whole).when(mine & F.col("sha").isNotNull(), cut).otherwise(none)
        zero = F.lit(0).cast("long")
        return rows.select(
            F.col("id").alias("doc_id"), "n_bytes", pick(F.col("n_bytes"), F.col("n_bytes") - F.col("left"), zero).alias("n_removed"), pick(F.lit(1).cast("long"), F.col("spans"), zero).alias("n_spans"),
            pick(F.lit(hashlib.sha256(b"").hexdigest()), F.col("sha"), F.lower(F.hex("sha256"))).alias("kept_sha256"),
        )


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SuffixDedup(documents(spark, sf_dir)).documents()


QUERIES = {"op6_suffix_dedup": op6_suffix_dedup}
ORACLES: dict[str, str] = {}
