"""N-gram Jaccard join with adaptive multi-match prefixes.

A document's set holds its distinct runs of five words (by 64-bit hash). All sets are ordered alike, frequent shingles last. If two sets are
similar enough to link, they share at least l of their first n - ceil(0.8 n) + l shingles, for any l. Each document picks the l (1 to 4) at
which its estimated cost is least: rows to shuffle, postings to read by the shingles' frequencies, and candidates to verify, which grow rarer
as l grows. A pair must share k shingles within both prefixes for k, k being the lesser l of the two.

Groups of copies would make as many candidates as the square of their size. So:
1. documents with equal sets are one class (by 128 bits of the whole set), and stand for one another;
2. in each posting list, members are first held against one pivot only (the one whose prefix is most shared, as a group's original is), which
   takes as many pairs as the list has rows; verified links give components;
3. then only pairs of different components that still share enough of their prefixes are verified. What two documents share is at most what
   others have of their prefixes before a common token, and what both have from it on: pairs for which this is too little don't meet at it.
Links are verified on whole texts. Components need no more. The links that 2. and 3. pass over are those within one component of the pivots:
whoever asks for links has all pairs of such a component held against one another, in cells of two blocks of its members each, so that a large
component is dealt to many tasks and a text is sent once a block, not once a pair.

Hot keys: a posting list that is known to be long is dealt to several tasks, whose pivots are then replaced by the least of them; the rows of
a token that is still asked for in step 3 meet in cells of two blocks; a pivot of many pairs is sent once for each of its parts.

Frequent shingles: each scan task counts its own, those it met twice are summed over tasks, and the most frequent ones (a fixed number at
most, chosen by a threshold) are broadcast. They decide the order alone; the result doesn't depend on them.

Nulls: a null or empty text, or one without words, has an empty set and links with nothing; a row without identifier takes part like others,
but is nobody's smallest one (a component of such rows only has none). Rows that are equal in identifier and text are one document, repeated.
Rows that share an identifier but not the text are documents of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, hot_keys, likely, materialize, mix64, release, renamed, shares, shingle_hashes, word_hashes
from .components import components

#: Rows that numpy works on at once.
ROWS = 1000
#: The most prefix tokens beyond the first that a document can ask for.
MOST = 4
HEAVY = 1 << 18
#: Tokens of a prefix that its rows carry along.
LISTED = 64
#: Members of a component that meet in a cell, about.
BLOCK = 256
#: Rows of a token that meet in a cell of step 3, about.
TOKEN_BLOCK = 1024
#: Rows of a posting list that one task reads, about; the most frequent shingles' lists are dealt to more.
LONG = 500_000


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, at = word_hashes(column)
    h, s = shingle_hashes(words, at, k)
    out = []
    for a, b in zip(s[:-1].tolist(), s[1:].tolist()):
        x = np.sort(h[a:b])
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x)
    return out


def signature(x: np.ndarray) -> tuple[int, int]:
    """128 bits of the whole set; equal sets, equal signatures."""
    if not len(x):
        return 0, 0
    both = [mix64(x + np.uint64(c)).sum(dtype=np.uint64) for c in (0x632BE59BD9B4E019, 0x9E3779B97F4A7C15)]
    return tuple(int(v.astype(np.int64)) for v in both)


class Prefixes:
    """The order of shingles, and what sets send to the posting lists."""

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, num: int, den: int):
        self.tokens, self.counts, self.num, self.den = tokens, counts, num, den

    def of(self, sets: list[np.ndarray]) -> list[tuple[np.ndarray, int, int, np.ndarray]]:
        """For each set (none is empty): the tokens of its prefix in order, the chosen l, how little others share the prefix (the less, the
        better a pivot), and how many rows the tokens' lists are known to have."""
        n = np.array([len(x) for x in sets], np.int64)
        x, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        df = np.zeros(len(x))
        if len(self.tokens):
            i = np.minimum(np.searchsorted(self.tokens, x), len(self.tokens) - 1)
            df = np.where(self.tokens[i] == x, self.counts[i], 0).astype(float)
        level = np.log2(df + 1).astype(np.int64)
        order = np.argsort(row * 64 + level, kind="stable")
        x, df, level = x[order], df[order], level[order]
        start = np.cumsum(n) - n
        first = n - -(-self.num * n // self.den) + 1
        # a shingle that isn't known as frequent is in another document now and then
        reads = np.concatenate([[0], np.cumsum(np.maximum(df - 1, 0.01))])
        own, least = np.ones(len(sets), np.int64), np.full(len(sets), np.inf)
        for el in range(1, MOST + 1):
            size = first + el - 1
            read = reads[np.minimum(start + size, start + n)] - reads[start]
            cost = np.where(size <= n, first + el + read + 20 * read / el**2, np.inf)
            own, least = np.where(cost < least, el, own), np.minimum(cost, least)
        size = first + own - 1
        levels = np.concatenate([[0], np.cumsum(level)])
        rank = np.maximum(0, 32767 - 1000 * (levels[start + size] - levels[start]) // size)
        return [(x[a : a + k], el, r, df[a : a + k]) for a, k, el, r in zip(start.tolist(), size.tolist(), own.tolist(), rank.tolist())]


def _scan(k: int, flush: int = 4_000_000):
    """Rows (kind, x, y, z, n, body): 0, identifier, signature (y and z), set size, the text's md5; 1, shingle that this task met more than
    once, times."""
    names = ["kind", "x", "y", "z", "n", "body"]

    def counted(held):
        u, n = np.unique(np.concatenate(held), return_counts=True)
        u, n = u[n > 1], n[n > 1]
        if len(u):
            none = pa.nulls(len(u), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(u), 1, np.int32)), pa.array(u.view(np.int64)), pa.array(n), none, none, pa.nulls(len(u), pa.string())], names=names)

    def run(batches):
        held, size, seen = [], 0, set()
        for batch in batches:
            for some in shares(batch, 1, rows=ROWS):
                sets = shingle_sets(some.column(1), k)
                sig = [signature(x) for x in sets]
                columns = [pa.array(np.zeros(len(sets), np.int32)), some.column(0), *(pa.array([x[i] for x in sig], pa.int64()) for i in (0, 1)), pa.array([len(x) for x in sets], pa.int64()), some.column(2)]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                for s, x in zip(sig, sets):
                    if s not in seen and len(x):
                        seen.add(s)
                        held.append(x)
                        size += len(x)
                if size > flush:
                    yield from counted(held)
                    held, size, seen = [], 0, set()
        if held:
            yield from counted(held)

    return run


def heavy_shingles(counts: DataFrame, most: int = HEAVY, least: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """The shingles with the highest sums of y (most of them at most: a threshold is taken from a table of 64 rows), sorted."""
    sums = materialize(counts.groupBy("x").agg(F.sum("y").alias("n")).where(F.col("n") >= least), "heavy")
    by_level = {r["l"]: r["c"] for r in sums.groupBy(F.floor(F.log2("n") * 4).alias("l")).agg(F.count("*").alias("c")).collect()}
    level, total = 1 << 20, 0
    for v in sorted(by_level, reverse=True):
        if total + by_level[v] > most:
            break
        level, total = v, total + by_level[v]
    got = sums.where(F.floor(F.log2("n") * 4) >= level).toArrow()
    release(sums)
    tokens, n = got.column("x").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(tokens)
    return tokens[order], n[order]


#: part: 0, or one of the parts of a long list. sig, n: the class, by 64 bits of its signature and its set size (two classes that agree in
#: both stand for each other until texts are compared). meta holds the token's place in the document's order, its l (4 bits) and its rank as a
#: pivot (16 bits).
POSTINGS = "token long, part int, sig long, n long, meta long"


def _postings(k: int, prefixes, long: int):
    def run(batches):
        p, seen = prefixes.value, set()
        for batch in batches:
            for some in shares(batch, 0, rows=ROWS):
                out, keys, sets = [], [], []
                for x in shingle_sets(some.column(0), k):
                    key = signature(x) if len(x) else None
                    if key is not None and key not in seen:
                        seen.add(key)
                        keys.append(key)
                        sets.append(x)
                for key, x, (token, own, rank, df) in zip(keys, sets, p.of(sets) if sets else ()):
                    n = len(token)
                    part = np.where(df > long, 1 + (key[1] & 0xFFFFFFFF) % np.maximum(np.ceil(df / long), 1).astype(np.int64), 0).astype(np.int32)
                    out.append((token.view(np.int64), part, np.full(n, key[0], np.int64), np.full(n, len(x), np.int64), (np.arange(n) << 20) | (own << 16 | rank)))
                if len(seen) > 500_000:
                    seen = set()
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["token", "part", "sig", "n", "meta"])

    return run


def _shared(batches):
    """Of postings sorted by token, part, pivot rank and signature: those whose token has several classes (all, in parts of a long list), with
    the list's first one as pivot."""
    names = ["token", "part", "sig", "n", "meta", "pivot", "pivot_n"]
    rows = lambda *c: pa.RecordBatch.from_arrays([pa.array(x) for x in c], names=names)
    token = part = pivot = pivot_n = sig = None
    waiting = None  # the first row of a list that has one class so far
    for batch in batches:
        t, q, s, z, m = (c.to_numpy() for c in batch.columns)
        if not len(t):
            continue
        again = np.zeros(len(t), bool)
        again[1:] = (t[1:] == t[:-1]) & (s[1:] == s[:-1])
        again[0] = token is not None and t[0] == token and s[0] == sig
        t, q, s, z, m = t[~again], q[~again], s[~again], z[~again], m[~again]
        if not len(t):
            continue
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (q[1:] != q[:-1])
        new[0] = token is None or t[0] != token or q[0] != part
        at = np.maximum.accumulate(np.where(new, np.arange(len(t)), -1))
        first = np.maximum(at, 0)
        p = np.where(at >= 0, s[first], pivot if pivot is not None else 0)
        pn = np.where(at >= 0, z[first], pivot_n if pivot_n is not None else 0)
        several = ~new | (q > 0)
        several[:-1] |= ~new[1:]
        if not new[0] and waiting is not None:
            yield rows(*(np.array([x], y) for x, y in zip((*waiting, waiting[2], waiting[3]), (np.int64, np.int32, *[np.int64] * 5))))
        waiting = None
        if several.any():
            yield rows(*(c[several] for c in (t, q, s, z, m, p, pn)))
        token, part, sig, pivot, pivot_n = int(t[-1]), int(q[-1]), int(s[-1]), int(p[-1]), int(pn[-1])
        if new[-1] and not part:
            waiting = (token, part, sig, int(z[-1]), int(m[-1]))


def _verify(k: int, num: int, den: int):
    """Rows (a, part, b, text) sorted by a, part and b, each a's own text first, without b: those b that link with a, with the sizes of
    intersection and union."""

    def run(batches):
        own = None
        for batch in batches:
            for some in shares(batch, 3, rows=256):
                a, b = some.column(0).to_numpy(), some.column(2).to_pylist()
                keep, both, total = [], [], []
                for i, y in enumerate(shingle_sets(some.column(3), k)):
                    if b[i] is None:
                        own = y
                        continue
                    x, y = (own, y) if len(own) <= len(y) else (y, own)
                    n = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                    u = len(x) + len(y) - n
                    if n and den * n >= num * u:
                        keep.append(i)
                        both.append(n)
                        total.append(u)
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array([b[i] for i in keep], pa.int64()), pa.array(both, pa.int64()), pa.array(total, pa.int64())], names=["a", "b", "n_both", "n_union"])

    return run


def _within(k: int, num: int, den: int):
    """Of texts sorted by cell (x and y are the cell's blocks, z the text's own): the links between block x and block y, or within x if x = y."""

    def linked(cell):
        ids, own, sets = zip(*cell)
        ids, own, n = np.array(ids, np.int64), np.array(own), np.array([len(x) for x in sets])
        tokens, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
        order = np.argsort(tokens, kind="stable")
        tokens, row = tokens[order], row[order]
        for i, x in enumerate(sets):
            lo, hi = np.searchsorted(tokens, x, "left"), np.searchsorted(tokens, x, "right")
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
            both = np.bincount(row[at], minlength=len(sets))
            total = n[i] + n - both
            # each pair once: from the lesser block to the other one, or in a block of itself from the lesser identifier
            other = (own > own[i]) if own.min() < own.max() else (ids > ids[i])
            j = np.flatnonzero(other & (both > 0) & (den * both >= num * total))
            if len(j):
                a = np.full(len(j), ids[i])
                yield np.minimum(a, ids[j]), np.maximum(a, ids[j]), both[j], total[j]

    def run(batches):
        at, cell = None, []

        def done():
            # a cell of two blocks has nothing to do if one of them is empty
            if len(cell) > 1 and (at[1] == at[2] or len({c[1] for c in cell}) == 2):
                found = list(linked(cell))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found)], names=["a", "b", "n_both", "n_union"])

        for batch in batches:
            for some in shares(batch, 5, rows=256):
                label, x, y, z, ids = (some.column(c).to_pylist() for c in range(5))
                for key, own, i, s in zip(zip(label, x, y), z, ids, shingle_sets(some.column(5), k)):
                    if key != at:
                        yield from done()
                        at, cell = key, []
                    cell.append((i, own, s))
        yield from done()

    return run


def _identity(key: str, text: str) -> list:
    """id0 and unknown (the identifier, null-safe), body (the text's md5): what tells documents apart."""
    return [F.coalesce(key, F.lit(0).cast("long")).alias("id0"), F.col(key).isNull().alias("unknown"), F.md5(F.coalesce(text, F.lit("")).cast("binary")).alias("body")]


IDENTITY = ["id0", "unknown", "body"]


class NgramJoin:
    """documents(): a row per document with its set size, class, number of links and component; components(): the same without links, which
    takes fewer pairs; links: all verified pairs (a < b) of classes of different texts, found when first asked for; kept(): the identity of
    one document of each component. Classes are numbered inside; outside, a class is known by its smallest identifier."""

    def __init__(self, docs: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100, long: int = LONG):
        self.k, self.num, self.den = k, num, den
        self.docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
        spark, body = docs.sparkSession, _identity("id", "text")[2]
        self.scanned = materialize(self.docs.select("id", "text", body).mapInArrow(_scan(k), "kind int, x long, y long, z long, n long, body string"), "scanned")
        self.rows = self.scanned.where("kind = 0").select(F.col("x").alias("id"), F.col("y").alias("sig"), F.col("z").alias("sig2"), "n", "body")
        tokens, counts = heavy_shingles(self.scanned.where("kind = 1"))
        first = F.min(F.struct(F.col("id").isNull().alias("unknown"), F.coalesce("id", F.lit(0).cast("long")).alias("id0"), "body")).alias("first")
        classes = self.rows.where("n > 0").groupBy("sig", "sig2", "n").agg(first).select("sig", "sig2", "n", "first.*")
        self.classes = materialize(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
        prefixes = spark.sparkContext.broadcast(Prefixes(tokens, counts, num, den))
        lists = self.docs.select("text").mapInArrow(_postings(k, prefixes, long), POSTINGS)
        rank = F.col("meta").bitwiseAND(0xFFFF)
        lists = lists.repartition("token", "part").sortWithinPartitions("token", "part", rank, "sig").mapInArrow(_shared, POSTINGS + ", pivot long, pivot_n long")
        if (counts > long).any():
            lists = self._of_long_lists(lists, rank)
        pivots = self.classes.select(F.col("sig").alias("pivot"), F.col("n").alias("pivot_n"), F.col("cls").alias("pivot_cls"))
        # these joins are sort-merge joins at every size, so that a small table tells what a large one will shuffle
        shared = lists.join(self.classes.select("sig", "n", "cls").hint("merge"), ["sig", "n"]).join(pivots.hint("merge"), ["pivot", "pivot_n"])
        own, place = F.shiftright("meta", 16).bitwiseAND(0xF).cast("int").alias("own"), F.shiftright("meta", 20).alias("place")
        # of a document's prefix only what others have too is left: its number before a token bounds how much can be shared before it
        before = (F.row_number().over(Window.partitionBy("cls").orderBy("place", "token")) - 1).alias("before")
        self.shared = materialize(shared.select("token", "cls", "n", own, place, "pivot_cls", "pivot_n").select("*", before), "shared")
        star = self.shared.where("cls <> pivot_cls").select(F.col("pivot_cls").alias("a"), F.col("cls").alias("b"), F.col("pivot_n").alias("na"), F.col("n").alias("nb"))
        star = materialize(star.where(self._sizes("na", "nb")).select("a", "b").distinct(), "star")
        wanted = materialize(self.shared.select("cls").distinct().join(self.classes, "cls").select("cls", *IDENTITY), "wanted")
        self.texts = materialize(self._texts(wanted), "texts")
        found = materialize(self._verified(star), "links")
        self.near = components(found)
        rest = materialize(self._rest(star, self.near), "pairs")
        self.rest = materialize(self._verified(rest, few=True), "links")
        self.far = self._joined(self.rest, self.near)
        release(star, rest, found, wanted)

    def _of_long_lists(self, lists: DataFrame, rank) -> DataFrame:
        """Parts of a list get one pivot: the first of their first ones. The lists in parts are among the frequent shingles, whose number is
        bounded, so a row for each is broadcast."""
        lists = materialize(lists, "lists")
        first = F.min(F.struct(rank.alias("rank"), "sig", "n")).alias("first")
        whole = lists.where("part > 0").groupBy("token").agg(first, (F.min(F.struct("sig", "n")) < F.max(F.struct("sig", "n"))).alias("several"))
        whole = F.broadcast(whole.select("token", F.col("first.sig").alias("first_sig"), F.col("first.n").alias("first_n"), "several"))
        pivot = [F.coalesce("first_sig", "pivot").alias("pivot"), F.coalesce("first_n", "pivot_n").alias("pivot_n")]
        return lists.join(whole, "token", "left").where("several OR several IS NULL").select("token", "sig", "n", "meta", *pivot)

    @cached_property
    def _links(self) -> DataFrame:
        apart = self.rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "n_both", "n_union")
        return materialize(apart.unionByName(self._inside()).dropDuplicates(["a", "b"]), "links")

    @property
    def links(self) -> DataFrame:
        """a, b, n_both, n_union: those of different components of the pivots, and those within one, the pivots' own among them. A class is
        given by its smallest identifier (null if it has none)."""
        rep = self.classes.select("cls", F.when(~F.col("unknown"), F.col("id0")).alias("rep"))
        at = lambda c: rep.select(F.col("cls").alias(c), F.col("rep").alias(f"{c}_rep"))
        both = self._links.join(at("a"), "a").join(at("b"), "b")
        return both.select(F.least("a_rep", "b_rep").alias("a"), F.greatest("a_rep", "b_rep").alias("b"), "n_both", "n_union")

    def _inside(self) -> DataFrame:
        """All links within components of the pivots. Whatever links two of a component's members, a common prefix or not, its cell holds both."""
        sizes = self.near.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
        members = self.near.join(sizes, "label").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
        texts = members.join(self.texts, members["node"] == self.texts["cls"])
        cells = texts.select("label", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"), "own", "cls", "text")
        cells = cells.select("label", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "cls", "text")
        cells = cells.repartition("label", "x", "y").sortWithinPartitions("label", "x", "y")
        return cells.mapInArrow(_within(self.k, self.num, self.den), "a long, b long, n_both long, n_union long")

    def _sizes(self, a: str, b: str):
        return F.least(a, b) * self.den >= F.greatest(a, b) * self.num

    def _texts(self, wanted: DataFrame) -> DataFrame:
        """(cls, text) of the classes in wanted: their first documents'. Repeated rows are made one before they are sent."""
        near = likely(self.docs.select(*_identity("id", "text"), F.coalesce("text", F.lit("")).alias("text")), wanted, ["id0", "body"])
        return near.groupBy(*IDENTITY).agg(F.first("text").alias("text")).join(wanted, IDENTITY).select("cls", "text")

    def _verified(self, pairs: DataFrame, few: bool = False) -> DataFrame:
        """Of pairs (a, b), those that link. A text is sent to a's own place once for each part of a's pairs, and once for each b; few: most
        texts are in no pair."""
        hot = F.broadcast(hot_keys(pairs.groupBy("a").agg(F.count("*").alias("n")), ["a"]))
        part = F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")), F.lit(0).cast("long")).alias("part")
        dealt = pairs.join(hot, "a", "left").select("a", part, "b")
        heads = dealt.select("a", "part").distinct().select(F.col("a").alias("cls"), "a", "part", F.lit(None).cast("long").alias("b"))
        places = heads.unionByName(dealt.select(F.col("b").alias("cls"), "a", "part", "b"))
        texts = self.texts
        if few:
            wanted = materialize(places.select("cls").distinct(), "wanted")
            texts = likely(texts, wanted, ["cls"])
            release(wanted)
        rows = texts.hint("merge").join(places, "cls").select("a", "part", "b", "text")
        rows = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.asc_nulls_first("b"))
        return rows.mapInArrow(_verify(self.k, self.num, self.den), "a long, b long, n_both long, n_union long")

    def _rest(self, star: DataFrame, near: DataFrame) -> DataFrame:
        """Pairs of different components that share enough of their prefixes, without those already verified."""
        rows = self.shared.join(near, self.shared["cls"] == near["node"], "left").select("token", "cls", "n", "own", "place", "before", F.coalesce("label", "cls").alias("label"))
        mixed = rows.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("m"))
        mixed = mixed.where("lo < hi").select("token", F.ceil(F.col("m") / TOKEN_BLOCK).cast("long").alias("blocks"))
        rows = rows.join(mixed.hint("merge"), "token").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")))
        rows = rows.join(self._lists().hint("merge"), "cls")
        # the rows of a token meet in cells of two blocks each, a pair in the one of its own two blocks
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
        rows = rows.select("*", other).withColumns({"lower": F.least("block", "other"), "upper": F.greatest("block", "other")}).drop("other", "blocks")
        x, y = rows.alias("x"), rows.alias("y")
        cell = (F.col("x.token") == F.col("y.token")) & (F.col("x.lower") == F.col("y.lower")) & (F.col("x.upper") == F.col("y.upper"))
        cell = cell & (F.least("x.block", "y.block") == F.col("x.lower")) & (F.greatest("x.block", "y.block") == F.col("x.upper"))
        # a pair meets at its first common token: none is in both lists before it. Then they share it and what both have after it at most.
        # Lists hold the first LISTED tokens only; beyond that a pair may meet again, and what precedes the token counts as shared.
        earlier = F.arrays_overlap(F.expr("slice(x.list, 1, CAST(x.before AS INT))"), F.expr("slice(y.list, 1, CAST(y.before AS INT))"))
        before = F.least("x.before", "y.before")
        known = F.when(F.greatest("x.before", "y.before") <= LISTED, 0).otherwise(before)
        most = known + 1 + F.least(F.expr("x.n - x.place - 1"), F.expr("y.n - y.place - 1"))
        enough = most * (self.num + self.den) >= (F.col("x.n") + F.col("y.n")) * self.num
        meet = x.join(y, cell & (F.col("x.label") < F.col("y.label")) & self._sizes("x.n", "y.n") & enough & ~earlier)
        k = F.least("x.own", "y.own")
        mx, my = F.element_at("x.within", k), F.element_at("y.within", k)
        both = F.size(F.array_intersect(F.slice("x.list", F.lit(1), mx), F.slice("y.list", F.lit(1), my)))
        pairs = meet.where((F.greatest(mx, my) > LISTED) | (both >= k)).select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b")).distinct()
        done = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        return pairs.join(done, ["a", "b"], "left_anti")

    def _lists(self) -> DataFrame:
        """(cls, list, within): the first tokens of a prefix that others have too, in order, and how many of all such are in the prefix for
        1, 2, ... common tokens; the prefix for l has n - ceil(n * num / den) + l tokens."""
        level = F.expr(f"place + 1 - n + (n * {self.num} + {self.den - 1}) DIV {self.den}")
        within = F.array(*[F.sum((level <= k).cast("int")).cast("int") for k in range(1, MOST + 1)]).alias("within")
        first = F.array_sort(F.collect_list(F.when(F.col("before") < LISTED, F.struct("place", "token"))))
        return self.shared.groupBy("cls").agg(F.transform(first, lambda t: t["token"]).alias("list"), within)

    def _joined(self, rest: DataFrame, near: DataFrame) -> DataFrame:
        """Components of the components that the later links join."""
        at = lambda c: near.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label"))
        links = rest.join(at("a"), "a", "left").join(at("b"), "b", "left")
        return components(links.select(F.coalesce("a_label", "a").alias("a"), F.coalesce("b_label", "b").alias("b")))

    def _labelled(self) -> DataFrame:
        """classes with the label of their component."""
        near = self.near.select(F.col("node").alias("cls"), F.col("label").alias("near"))
        far = self.far.select(F.col("node").alias("near"), F.col("label").alias("far"))
        out = self.classes.join(near, "cls", "left").withColumn("near", F.coalesce("near", "cls")).join(far, "near", "left")
        return out.withColumn("label", F.coalesce("far", "near")).drop("near", "far")

    def documents(self) -> DataFrame:
        """One row per document: doc_id, n_shingles, class_id, n_links of its class with other classes, component_id."""
        ends = self._links.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
        out = self._documents().join(ends, "cls", "left")
        return out.select("doc_id", "n_shingles", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), "component_id")

    def components(self) -> DataFrame:
        """One row per document: doc_id, n_shingles, class_id, component_id."""
        return self._documents().drop("cls")

    def _documents(self) -> DataFrame:
        rep = F.when(~F.col("unknown"), F.col("id0"))
        classes = materialize(self._labelled().select("sig", "sig2", "n", "cls", "label", rep.alias("rep")), "labelled")
        least = materialize(classes.groupBy("label").agg(F.min("rep").alias("least"), F.count("*").alias("n")), "least")
        # a component of very many classes is told by a broadcast row, the others by a join; a class that is told already joins with nothing
        hot = F.broadcast(hot_keys(least, ["label"]).join(least.select("label", F.struct("least").alias("told")), "label").select("label", "told"))
        other = least.where("n > 1").select(F.col("label").alias("key"), F.struct("least").alias("joined"))
        classes = classes.join(hot, "label", "left").withColumn("key", F.when(F.col("told").isNull(), F.col("label")).otherwise(-1 - F.col("cls")))
        component = F.when(F.col("told").isNotNull(), F.col("told.least")).when(F.col("joined").isNotNull(), F.col("joined.least")).otherwise(F.col("rep"))
        classes = classes.join(other, "key", "left").withColumn("component", component)
        out = self.rows.join(classes.select("sig", "sig2", "n", "cls", "rep", "component"), ["sig", "sig2", "n"], "left")
        alone = F.col("cls").isNull()  # no words
        return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "cls", F.when(alone, F.col("id")).otherwise(F.col("rep")).alias("class_id"), F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component_id"))

    def kept(self) -> DataFrame:
        """The identity of each component's first document (the smallest identifier; of equal ones, by the texts' md5), and of each document
        without words."""
        first = self._labelled().groupBy("label").agg(F.min(F.struct("unknown", "id0", "body")).alias("first")).select("first.*")
        empty = self.rows.where("n = 0").select(*[F.col("id").isNull().alias("unknown"), F.coalesce("id", F.lit(0).cast("long")).alias("id0")], "body").distinct()
        return first.unionByName(empty).select(*IDENTITY)

    def release(self) -> None:
        """Deletes what components() and kept() don't need; links can't be asked for any more."""
        release(self.shared, self.texts)


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One document of each component, that with the smallest identifier, with all its columns; of repeated rows, one."""
    join = NgramJoin(docs, key, text, **options)
    kept = materialize(join.kept(), "kept")
    join.release()
    own = renamed(docs)
    names = own.columns
    body = own.select(*names, F.col(names[docs.columns.index(key)]).cast("long").alias("id"), F.col(names[docs.columns.index(text)]).cast("string").alias("text"))
    rows = body.select(F.struct(*names).alias("row"), *_identity("id", "text")).groupBy(*IDENTITY).agg(F.first("row").alias("row"))
    return rows.join(kept, IDENTITY, "left_semi").select("row.*").toDF(*docs.columns)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = NgramJoin(documents(spark, sf_dir))
    join.release()
    return join.components().select("doc_id", "n_shingles", "component_id")


def op2_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return NgramJoin(documents(spark, sf_dir)).documents()


QUERIES = {"op2_ngram_join": op2_ngram_join, "op2_ngram_links": op2_ngram_links}
_LINKED = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, hash(list_slice(words, i, i + 4)) AS g FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v)"""
ORACLES = {
    "op2_ngram_join": f"""{_LINKED}
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.v) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r ON r.u = d.doc_id GROUP BY d.doc_id, n.n""",
    "op2_ngram_links": f"""{_LINKED},
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sig) AS class_id FROM (SELECT doc_id, md5(string_agg(g::VARCHAR, ',' ORDER BY g)) AS sig FROM s GROUP BY doc_id)),
o AS (SELECT x.class_id AS c, count(DISTINCT y.class_id) AS n_links FROM e JOIN k x ON x.doc_id = e.u JOIN k y ON y.doc_id = e.v WHERE x.class_id <> y.class_id GROUP BY x.class_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(k.class_id, d.doc_id) AS class_id, coalesce(any_value(o.n_links), 0)::BIGINT AS n_links, min(r.v) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN o ON o.c = k.class_id JOIN r ON r.u = d.doc_id GROUP BY d.doc_id, n.n, k.class_id""",
}
