"""A stored text index: segments of postings in blocks with score bounds, changed by appending, searched for the best k by BM25.

Documents are numbered within ranges of a few dozen, in the task that reads them. Each range is a row of the table `ranges` (keys, lengths,
terms and counts of its documents); `postings`, sorted by term, has a row for each term and range: the documents' places, counts and lengths, and
the block's maxima: of its (count, length) pairs those that no other one beats. From these follows the most that the block can add to a score,
whatever the corpus's mean length is by then. A change appends a segment and, for documents that go, rows of `gone`; numbers of documents and
frequencies of terms are kept exact, so a search equals one over the documents as they are. merge() makes one segment of all.

A search reads the bounds of the asked terms' blocks, adds them up for each query and range, scores the most promising ranges first, and then
only the ranges whose bound reaches the k-th score found there; other ranges' blocks are not read.

Nulls: a null text has no words; a document without key is counted, but never found and never updated. Repeated keys in one batch are documents
of their own. Queries without a known word have no rows. An index without documents gives an empty result.
"""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import stored
from .lexical import terms

RANGE = "seg int, range long, keys array<{key}>, lens array<int>, starts array<int>, terms array<string>, tfs array<int>"
POSTING = "term string, seg int, range long, n int, slots array<int>, tfs array<int>, lens array<int>, top_tfs array<int>, top_lens array<int>"
STATE = "version long, segments array<struct<seg:int,folder:string,docs:long,words:long>>, gone array<string>"
#: Words after which a range is closed, even if it has fewer documents.
RANGE_WORDS = 1 << 20
#: Bytes of the queries' weights that are sent to all tasks at once; more queries take several rounds.
ASKED_BYTES = 64 << 20
#: Bytes of terms, up to which they are sent to all tasks to be looked up there.
SENT_BYTES = 16 << 20
#: Numbers that a task holds for ranges by queries (and documents), and rows that it spreads over their terms' queries at once.
CELLS, SPREAD = 1 << 22, 4096
#: Tasks at most that get the blocks of a term.
DEALT = 8
#: The most terms whose values are handed to the scan of the postings; with more, a join alone finds them.
PUSHED = 1000


class TextIndex:
    """An index in a folder. span: documents in a range, as many as a block can have."""

    def __init__(self, spark: SparkSession, path: str, key_type: str = "bigint", span: int = 16, tokens=terms, k1: float = 1.5, b: float = 0.75):
        self.spark, self.path, self.key_type, self.span, self.tokens, self.k1, self.b = spark, path.rstrip("/"), key_type, span, tokens, k1, b

    # state

    def _state(self) -> dict:
        try:
            rows = self.spark.read.schema(STATE).json(f"{self.path}/versions").orderBy(F.desc("version")).limit(1).collect()
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            rows = []
        return rows[0].asDict(recursive=True) if rows else {"version": 0, "segments": [], "gone": []}

    def _commit(self, old: dict, segments: list[dict], gone: list[str]) -> None:
        """A version is a folder that can be made once: of two writers at the same time, the second one fails and has changed nothing."""
        new = self.spark.createDataFrame([(old["version"] + 1, [tuple(s[c] for c in ("seg", "folder", "docs", "words")) for s in segments], gone)], STATE)
        new.coalesce(1).write.mode("error").json(f"{self.path}/versions/at={old['version'] + 1}")

    def _read(self, state: dict, table: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{s['folder']}/{table}" for s in state["segments"]]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _gone(self, state: dict) -> DataFrame:
        schema = "seg int, range long, slot int, len int, terms array<string>"
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{g}" for g in state["gone"]]) if state["gone"] else self.spark.createDataFrame([], schema)

    def _ranges(self, state: dict) -> DataFrame:
        return self._read(state, "ranges", RANGE.format(key=self.key_type))

    # changes

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Appends the documents as a segment, whatever keys there are already."""
        state = self._state()
        self._commit(state, [*state["segments"], self._segment(state, self._words(docs, key, text), _counted)], state["gone"])

    def update(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> None:
        """Appends the documents; older ones of their keys go."""
        state = self._state()
        gone = self._drop(state, docs.select(F.col(key).alias("key")))
        self._commit(state, [*state["segments"], self._segment(state, self._words(docs, key, text), _counted)], [*state["gone"], *gone])

    def delete(self, keys: DataFrame, key: str = "doc_id") -> None:
        state = self._state()
        self._commit(state, state["segments"], [*state["gone"], *self._drop(state, keys.select(F.col(key).alias("key")))])

    def merge(self) -> None:
        """One segment of all documents that are left."""
        state = self._state()
        rows = self._ranges(state).select("seg", "range", F.posexplode("keys").alias("slot", "key"), "lens", "starts", "terms", "tfs")
        rows = rows.join(self._gone(state).select("seg", "range", "slot"), ["seg", "range", "slot"], "left_anti")
        part = lambda c: F.slice(c, self._at("starts") + 1, self._at("starts", 1) - self._at("starts"))
        left = rows.select("key", self._at("lens").alias("len"), part("terms").alias("terms"), part("tfs").alias("tfs"))
        self._commit(state, [self._segment({"segments": []}, left)], [])

    @staticmethod
    def _at(c: str, more: int = 0) -> Column:
        return F.element_at(c, F.col("slot") + 1 + more)

    def _drop(self, state: dict, keys: DataFrame) -> list[str]:
        """Marks the documents of these keys; their terms are kept with the marks, to be taken off the frequencies."""
        if not state["segments"]:
            return []
        rows = self._ranges(state).select("seg", "range", F.posexplode("keys").alias("slot", "key"), "lens", "starts", "terms")
        rows = rows.join(keys.where("key IS NOT NULL").distinct(), "key", "left_semi").join(self._gone(state).select("seg", "range", "slot"), ["seg", "range", "slot"], "left_anti")
        own = F.slice("terms", self._at("starts") + 1, self._at("starts", 1) - self._at("starts"))
        folder = f"gone/{uuid.uuid4().hex}"
        rows.select("seg", "range", "slot", self._at("lens").alias("len"), own.alias("terms")).write.parquet(f"{self.path}/{folder}")
        return [folder]

    def _words(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        return docs.select(F.col(key).cast(self.key_type).alias("key"), self.tokens(F.col(text)).alias("w"))

    def _segment(self, state: dict, rows: DataFrame, counted=lambda batches: batches) -> dict:
        """Writes a segment's ranges, and from these its postings, dealt by term and sorted by it: a scan for some terms reads the row groups that
        can have them. counted: what makes key, len and a document's different terms with their counts of the rows, in the task that numbers them."""
        seg, folder, span = 1 + max((s["seg"] for s in state["segments"]), default=-1), f"segments/{uuid.uuid4().hex}", self.span
        schema = RANGE.format(key=self.key_type)

        def ranges(batches):
            from pyspark import TaskContext

            made, open_rows = 0, {False: [], True: []}
            first = TaskContext.get().partitionId() << 32

            def closed(unknown: bool):
                nonlocal made
                rows, open_rows[unknown] = pa.concat_batches(open_rows[unknown]), []
                number = first + made
                made += 1
                starts = np.concatenate([[0], np.cumsum(rows.column(2).value_lengths().to_numpy())])
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (rows.column(0), rows.column(1), pa.array(starts, pa.int32()), rows.column(2).flatten(), rows.column(3).flatten())]
                # documents without key have numbers below zero: they are counted and never scored
                return pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([-1 - number if unknown else number], pa.int64()), *lists], names=["seg", "range", "keys", "lens", "starts", "terms", "tfs"])

            held = {False: [0, 0], True: [0, 0]}
            for batch in counted(batches):
                batch = _alike(batch)
                null = np.array(batch.column(0).is_null())
                for unknown in (False, True):
                    own = batch.filter(pa.array(null == unknown)) if null.any() or unknown else batch
                    size = own.column(1).to_numpy()
                    lo = 0
                    while lo < own.num_rows:
                        room, words = span - held[unknown][0], RANGE_WORDS - held[unknown][1]
                        take = max(1, min(room, int(np.searchsorted(np.cumsum(size[lo : lo + room], dtype=np.int64), words, side="right"))))
                        part = own.slice(lo, take)
                        open_rows[unknown].append(part)
                        held[unknown] = [held[unknown][0] + part.num_rows, held[unknown][1] + int(size[lo : lo + take].sum())]
                        lo += take
                        if held[unknown][0] >= span or held[unknown][1] >= RANGE_WORDS:
                            yield closed(unknown)
                            held[unknown] = [0, 0]
            for unknown in (False, True):
                if open_rows[unknown]:
                    yield closed(unknown)

        rows.mapInArrow(ranges, schema).write.option("compression", "zstd").parquet(f"{self.path}/{folder}/ranges")
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{folder}/ranges")
        blocks = rows.select("seg", "range", "lens", "starts", "terms", "tfs").mapInArrow(_blocks, POSTING)
        # by hash, since sampled bounds would make all blocks twice; the blocks of a term go to a few tasks, by the task that has numbered their range
        blocks = blocks.repartition("term", F.pmod(F.shiftright("range", 32), F.lit(DEALT))).sortWithinPartitions("term", "range")
        blocks.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).option("parquet.bloom.filter.enabled#term", "true").parquet(f"{self.path}/{folder}/postings")
        total = F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x)
        n = rows.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)), F.coalesce(F.sum(total), F.lit(0))).first()
        return {"seg": seg, "folder": folder, "docs": n[0], "words": n[1]}

    # search

    def statistics(self) -> tuple[int, int]:
        """Documents and words of the index as it is."""
        state = self._state()
        gone = self._gone(state).agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        return sum(s["docs"] for s in state["segments"]) - gone[0], sum(s["words"] for s in state["segments"]) - gone[1]

    def documents(self) -> DataFrame:
        """key, words, terms (different ones) and segment of the documents as they are."""
        state = self._state()
        rows = self._ranges(state).select("seg", "range", F.posexplode("keys").alias("slot", "key"), "lens", "starts")
        rows = rows.join(self._gone(state).select("seg", "range", "slot"), ["seg", "range", "slot"], "left_anti")
        return rows.select("key", self._at("lens").alias("words"), (self._at("starts", 1) - self._at("starts")).alias("terms"), F.col("seg").alias("segment"))

    def search(self, queries: DataFrame, k: int = 10, query_key: str = "query_id", key: str = "doc_id", text: str = "text") -> DataFrame:
        """query_key, key, score, rank: as lexical.bm25() over the documents as they are."""
        hits, _, _ = self._search(queries, k, query_key, text)
        return hits.select(F.col("q").alias(query_key), F.col("key").alias(key), "score", "rank")

    def blocks_read(self, queries: DataFrame, k: int = 10, query_key: str = "query_id", text: str = "text") -> DataFrame:
        """query_key, blocks of the query's terms, blocks_read by its search."""
        _, bounds, chosen = self._search(queries, k, query_key, text)
        read = bounds.join(chosen, ["q", "seg", "range"], "left_semi").groupBy("q").agg(F.sum("blocks").alias("blocks_read"))
        return bounds.groupBy("q").agg(F.sum("blocks").alias("blocks")).join(read, "q", "left").select(F.col("q").alias(query_key), "blocks", F.coalesce("blocks_read", F.lit(0)).alias("blocks_read"))

    def _search(self, queries: DataFrame, k: int, query_key: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        state = self._state()
        docs, words = self.statistics()
        asked = queries.select(F.col(query_key).alias("q"), F.explode(self.tokens(F.col(text))).alias("term")).groupBy("q", "term").agg(F.count("*").alias("times"))
        asked = stored(asked, "asked")
        postings = self._asked_postings(state, asked)
        gone = self._gone(state)
        less = gone.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("less"))
        df = postings.groupBy("term").agg(F.sum("n").alias("df")).join(less, "term", "left").withColumn("df", F.col("df") - F.coalesce("less", F.lit(0)))
        idf = F.log(1 + (F.lit(float(docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighed = stored(asked.join(df.where("df > 0"), "term").select("q", "term", (F.col("times") * idf).alias("w")), "weights")
        mean = max(words / max(docs, 1), 1e-300)
        size = weighed.agg(F.coalesce(F.sum(F.length("term") + 32), F.lit(0)).alias("n")).first()["n"]
        rounds = max(1, -(-size // ASKED_BYTES))
        parts = [self._asked_part(state, weighed.where(F.pmod(F.xxhash64("q"), F.lit(rounds)) == i), postings, gone, mean, k) for i in range(rounds)]
        return tuple(reduce(DataFrame.unionByName, x) for x in zip(*parts))

    def _asked_part(self, state: dict, weighed: DataFrame, postings: DataFrame, gone: DataFrame, mean: float, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The search for some queries, whose terms' weights are sent to all tasks: a block of postings moves once to where its range is worked out,
        however many queries have its term."""
        sent = self.spark.sparkContext.broadcast(_Weights(weighed.toArrow()))
        kind, k1, b = weighed.schema["q"].dataType.simpleString(), self.k1, self.b
        part = lambda tf, n: tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean))
        live = postings.where("range >= 0")
        most = F.array_max(F.zip_with("top_tfs", "top_lens", part))
        blocks = live.select("term", "seg", "range", most.alias("most")).mapInArrow(_coded(sent), "code int, seg int, range long, most double")
        blocks = blocks.repartition("seg", "range").sortWithinPartitions("seg", "range").mapInArrow(_bounds(sent), f"q {kind}, at int, seg int, range long, bound double, blocks long")
        bounds = stored(blocks, "bounds")

        def scored(chosen: DataFrame) -> DataFrame:
            """q, seg, range, slot, score of all documents of chosen ranges that have a term. A range's list of queries goes with its blocks."""
            lists = "code int, seg int, range long, slots array<int>, tfs array<int>, lens array<int>"
            none = F.lit(None).cast("array<int>")
            who = chosen.groupBy("seg", "range").agg(F.collect_list("at").alias("slots")).select(F.lit(-1).alias("code"), "seg", "range", "slots", none.alias("tfs"), none.alias("lens"))
            rows = live.join(chosen.select("seg", "range").distinct(), ["seg", "range"], "left_semi").select("term", "seg", "range", "slots", "tfs", "lens")
            rows = rows.mapInArrow(_coded(sent), lists).unionByName(who).repartition("seg", "range").sortWithinPartitions("seg", "range", "code")
            sums = rows.mapInArrow(_scores(sent, part), f"q {kind}, seg int, range long, slot int, score double")
            return sums.join(gone.select("seg", "range", "slot"), ["seg", "range", "slot"], "left_anti") if state["gone"] else sums

        # the most promising ranges of each query: k of them give k documents in most cases
        first = Window.partitionBy("q").orderBy(F.desc("bound"), "seg", "range")
        seeds = stored(bounds.withColumn("place", F.row_number().over(first)).where(F.col("place") <= k).select("q", "at", "seg", "range"), "seeds")
        found = stored(scored(seeds), "found")
        best = Window.partitionBy("q").orderBy(F.desc("score"))
        least = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        least = stored(least.where(F.col("n") == k).select("q", "least"), "least")
        reach = bounds.join(least, "q", "left").where(F.col("least").isNull() | (F.col("bound") + 1e-4 >= F.col("least")))
        rest = stored(reach.join(seeds, ["q", "seg", "range"], "left_anti").select("q", "at", "seg", "range"), "rest")
        every = found.unionByName(scored(rest)).join(least, "q", "left").where(F.col("least").isNull() | (F.col("score") >= F.col("least"))).drop("least")
        keys = self._ranges(state).select("seg", "range", "keys")
        named = every.join(keys, ["seg", "range"]).select("q", self._at("keys").alias("key"), "score")
        top = Window.partitionBy("q").orderBy(F.desc("score"), "key")
        return named.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k), bounds, seeds.unionByName(rest)

    def _asked_postings(self, state: dict, asked: DataFrame) -> DataFrame:
        """The postings of the asked terms as a table: the index is scanned once, and no other term's rows leave the JVM."""
        known = asked.select("term").distinct()
        size = known.agg(F.coalesce(F.sum(F.length("term") + 32), F.lit(0)).alias("n")).first()["n"]
        postings = self._pruned(self._read(state, "postings", POSTING), asked)
        return stored(postings.join(F.broadcast(known) if size <= SENT_BYTES else known, "term", "left_semi"), "hits")

    def _pruned(self, postings: DataFrame, asked: DataFrame) -> DataFrame:
        """A few terms are handed to the scan as filters, ten at a time, so that statistics and Bloom filters of row groups can rule them out."""
        known = [r["term"] for r in asked.select("term").distinct().limit(PUSHED + 1).collect()]
        if not known or len(known) > PUSHED:
            return postings
        return postings.where(reduce(lambda x, y: x | y, (F.col("term").isin(known[i : i + 10]) for i in range(0, len(known), 10))))


def _counted(batches):
    """Of keys and words: key, len, and each document's different terms with their counts."""
    for batch in batches:
        words = batch.column(1)
        size = words.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        flat = words.flatten().dictionary_encode()
        k = max(len(flat.dictionary), 1)
        both, n = np.unique(np.repeat(np.arange(len(words)), size) * k + flat.indices.to_numpy(), return_counts=True)
        ends = pa.array(np.searchsorted(both, np.arange(len(words) + 1) * k), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, x) for x in (flat.dictionary.take(pa.array(both % k)), pa.array(n, pa.int32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int32()), *lists], names=["key", "len", "terms", "tfs"])


class _Weights:
    """Queries by their numbers, terms by their codes, and for each term its queries and weights."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        q = (rows.column("q").combine_chunks() if rows.num_rows else pa.array([], rows.schema.field("q").type)).dictionary_encode()
        term = (rows.column("term").combine_chunks() if rows.num_rows else pa.array([], pa.string())).dictionary_encode()
        order = np.argsort(term.indices.to_numpy(), kind="stable")
        self.ids, self.terms = q.dictionary, {t: i for i, t in enumerate(term.dictionary.to_pylist())}
        self.ends = np.searchsorted(term.indices.to_numpy()[order], np.arange(len(self.terms) + 1))
        self.q, self.w = q.indices.to_numpy()[order].astype(np.int64), rows.column("w").to_numpy()[order].astype(float)

    def spread(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each row of codes with each of its term's queries: row, query, weight."""
        n = self.ends[code + 1] - self.ends[code]
        row = np.repeat(np.arange(len(code)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.ends[code][row]
        return row, self.q[at], self.w[at]


def _coded(sent):
    """The rows of known terms, with the term's code in its place."""

    def run(batches):
        for batch in batches:
            term = batch.column(0).dictionary_encode()
            of = np.array([sent.value.terms.get(t, -1) for t in term.dictionary.to_pylist()], np.int32)
            code = of[term.indices.to_numpy()] if len(term) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(code, pa.int32()), *batch.columns[1:]], names=["code", *batch.schema.names[1:]]).filter(pa.array(code >= 0))

    return run


def _whole_ranges(batches, cells: int):
    """Sorted rows as batches of whole ranges, so many at a time that a number for each range and cell stays below CELLS: the batch, each row's range
    among the batch's, and where each range begins."""
    held = None
    for batch in batches:
        batch = batch if held is None else pa.concat_batches([held, batch])
        if not batch.num_rows:
            continue
        seg, number = batch.column("seg").to_numpy(), batch.column("range").to_numpy()
        first = np.flatnonzero(np.concatenate([[True], (seg[1:] != seg[:-1]) | (number[1:] != number[:-1])]))
        held = batch.slice(int(first[-1]))
        yield from _portions(batch, first[:-1], int(first[-1]), cells)
    if held is not None and held.num_rows:
        yield from _portions(held, np.zeros(1, np.int64), held.num_rows, cells)


def _portions(batch: pa.RecordBatch, first: np.ndarray, end: int, cells: int):
    step = max(1, CELLS // max(cells, 1))
    for lo in range(0, len(first), step):
        own = first[lo : lo + step]
        stop = int(first[lo + step]) if lo + step < len(first) else end
        starts = own - own[0]
        yield batch.slice(int(own[0]), stop - int(own[0])), np.repeat(np.arange(len(own)), np.diff(np.append(starts, stop - int(own[0])))), starts


def _bounds(sent):
    def run(batches):
        w = sent.value
        nq = len(w.ids)
        for part, group, starts in _whole_ranges(batches, nq):
            code, most = part.column("code").to_numpy(), part.column("most").to_numpy()
            bound, blocks = np.zeros(len(starts) * nq), np.zeros(len(starts) * nq, np.int64)
            for lo in range(0, len(code), SPREAD):
                row, q, weight = w.spread(code[lo : lo + SPREAD])
                cell = group[lo + row] * nq + q
                bound += np.bincount(cell, weight * most[lo + row], len(bound))
                blocks += np.bincount(cell, minlength=len(bound))
            on = np.flatnonzero(blocks)
            g, q = starts[on // nq], on % nq
            take = lambda c: part.column(c).take(pa.array(g))
            yield pa.RecordBatch.from_arrays([w.ids.take(pa.array(q)), pa.array(q, pa.int32()), take("seg"), take("range"), pa.array(bound[on]), pa.array(blocks[on])], names=["q", "at", "seg", "range", "bound", "blocks"])

    return run


def _scores(sent, weigh):
    def run(batches):
        w = sent.value
        nq = len(w.ids)
        for part, group, starts in _whole_ranges(batches, nq * 64):
            code = part.column("code").to_numpy()
            size = part.column("slots").value_lengths().to_numpy()
            slot = part.column("slots").flatten().to_numpy()
            row = np.repeat(np.arange(len(code)), size)
            who, own = code[row] < 0, code[row] >= 0
            wanted = np.zeros((len(starts), nq), bool)
            wanted[group[row[who]], slot[who]] = True
            row, slot = row[own], slot[own].astype(np.int64)
            value = weigh(part.column("tfs").flatten().to_numpy().astype(float), part.column("lens").flatten().to_numpy().astype(float))
            width = int(slot.max(initial=0)) + 1
            sums = np.zeros(len(starts) * nq * width)
            for lo in range(0, len(row), SPREAD):
                i, q, weight = w.spread(code[row[lo : lo + SPREAD]])
                g = group[row[lo + i]]
                hit = wanted[g, q]
                i, q, weight, g = i[hit], q[hit], weight[hit], g[hit]
                sums += np.bincount((g * nq + q) * width + slot[lo + i], weight * value[lo + i], len(sums))
            score = np.floor(sums * 10**4 + 0.5) / 10**4
            on = np.flatnonzero(score > 0)
            g, q = starts[on // (nq * width)], on // width % nq
            take = lambda c: part.column(c).take(pa.array(g))
            yield pa.RecordBatch.from_arrays([w.ids.take(pa.array(q)), take("seg"), take("range"), pa.array(on % width, pa.int32()), pa.array(score[on])], names=["q", "seg", "range", "slot", "score"])

    return run


def _alike(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch's documents by their most frequent term and their length: where those of a range are alike, its bounds are tight."""
    at = batch.column(2).value_lengths().to_numpy()
    ends = np.cumsum(at)
    tfs, words = batch.column(3).flatten().to_numpy(), batch.column(2).flatten().dictionary_encode()
    row = np.repeat(np.arange(len(at)), at)
    by_count = np.lexsort((words.indices.to_numpy(), -tfs.astype(np.int64), row))
    rank = np.argsort(np.argsort(np.array(words.dictionary.to_pylist(), object)))
    first = np.full(len(at), -1)
    first[at > 0] = rank[words.indices.to_numpy()[by_count[(ends - at)[at > 0]]]]
    return batch.take(pa.array(np.lexsort((batch.column(1).to_numpy(), first))))


def _blocks(batches):
    """A row for each term and range: places, counts, lengths, and the (count, length) pairs that no other pair of the block beats."""
    for batch in batches:
        for seg, number, lens, starts, words, tfs in zip(*batch.columns):
            lens, starts, tfs = (x.values.to_numpy().astype(np.int64) for x in (lens, starts, tfs))
            coded = words.values.dictionary_encode()
            code, slot = coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(lens)), np.diff(starts))
            if not len(code):
                continue
            order = np.lexsort((slot, code))
            code, slot, tf = code[order], slot[order], tfs[order]
            ends = np.searchsorted(code, np.arange(len(coded.dictionary) + 1))
            n = lens[slot]
            best = np.lexsort((n, -tf, code))  # the most frequent first, and of these the shortest
            far = n[best] + (len(coded.dictionary) - code[best]) * (int(n.max()) + 2)
            before = np.concatenate([[np.iinfo(np.int64).max], np.minimum.accumulate(far)[:-1]])
            kept = best[far < before]
            top = np.searchsorted(code[kept], np.arange(len(coded.dictionary) + 1))
            lists = lambda at, x: pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(x, pa.int32()))
            m = len(coded.dictionary)
            columns = [coded.dictionary, pa.array([seg.as_py()] * m, pa.int32()), pa.array([number.as_py()] * m, pa.int64()), pa.array(np.diff(ends), pa.int32())]
            columns += [lists(ends, slot), lists(ends, tf), lists(ends, n), lists(top, tf[kept]), lists(top, n[kept])]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in POSTING.split(", ")])
