"""What the operators of this subpackage share: tables in the cluster's shared folder, global prefix sums, hashes of words."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a longest run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WORD_JAVA = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder in spark.checkpoint.dir. Where that is unset, a temporary one on a single machine, as in tests; elsewhere
    an error, since executors would each write to a disk of their own."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        known = _own_dir(spark)
    return known.rstrip("/")


_OWN: dict[str, str] = {}


def _own_dir(spark: SparkSession) -> str:
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='loomtext-')}"
    return _OWN[app]


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; what is there is deleted when the driver ends, if not before."""
    path = f"{shared_dir(spark)}/loomtext-{tag}-{uuid.uuid4().hex}"
    atexit.register(_forget, spark, path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as a Parquet table into the shared folder and reads it back: lineage ends there, and any executor can be lost."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loom_path = path
    return out


def _forget(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session may be gone by now; the folder is the cluster's to clean then
        pass


def release(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing reads any more."""
    for df in tables:
        _delete(df.sparkSession, df._loom_path)


def least_hashed(rows: DataFrame, by: list[str], n: int, h: str = "h") -> pa.Table:
    """The n rows of each group whose 64-bit hash h is least, on the driver, in the order of groups and hashes; of rows that share a hash one
    stays. Where a group has more, its rows are those below the hash that about 1.25 n + 50 of them stay below, by a count of its different
    hashes: so a group's size decides nothing but a threshold, and no task holds a group together. Groups are few (label values)."""
    sizes = rows.groupBy(*by).agg(F.approx_count_distinct(h, 0.02).alias("_n"))
    share = F.least(F.lit(1.0), F.lit(1.25 * n + 50) / F.col("_n"))
    limits = sizes.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], ((share - 0.5) * float(1 << 64)).alias("_limit"))
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    on = same[0]
    for x in same[1:]:
        on = on & x
    near = rows.join(F.broadcast(limits), on).where(F.col(h).cast("double") <= F.col("_limit")).select(*rows.columns).dropDuplicates([*by, h])
    got = near.toArrow().combine_chunks().sort_by([*[(c, "ascending") for c in by], (h, "ascending")])
    keep, seen = [], {}
    for i, g in enumerate(zip(*(got.column(c).to_pylist() for c in by))):
        seen[g] = seen.get(g, 0) + 1
        if seen[g] <= n:
            keep.append(i)
    return got.take(pa.array(keep, pa.int64()))


def shares(batch: pa.RecordBatch, column: int, limit: int = 4 << 20, rows: int = 1024):
    """Slices of a batch whose texts in a column hold limit bytes together at most (a longer text comes alone), of so many rows at most."""
    at = _offsets(batch.column(column))
    for lo, hi in slices(at, limit):
        for a in range(lo, hi, rows):
            yield batch.slice(a, min(rows, hi - a))


def hot_keys(counts: DataFrame, keys: list[str], parts: int = 1000) -> DataFrame:
    """counts: keys and n, their rows. Keys that hold more than one part in 1000 of all rows, and into how many salts their rows are to be
    dealt, so that none has more than that. They are fewer than 1000, whatever the table, so this one may be broadcast."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counts.where(F.col("n") * parts > total).select(*keys, F.ceil(F.col("n") * parts / float(max(total, 1))).cast("long").alias("salts"))


#: The least and the most bits of a Bloom filter, as powers of two; in between it has 12 for each member.
BLOOM_BITS = (16, 28)


def likely(rows: DataFrame, wanted: DataFrame, keys: list[str], then=None, schema: str | None = None) -> DataFrame:
    """The rows whose keys are in wanted, and a few others: a Bloom filter (32 MB at most) keeps most others from being shuffled. Beyond some
    hundred million keys it lets all rows pass. Joins that follow are exact. then: what the same worker does with the batches that are left,
    which gives rows of the schema."""
    bits = min(BLOOM_BITS[1], max(BLOOM_BITS[0], (12 * wanted.count()).bit_length()))
    h = [F.xxhash64(*keys), F.xxhash64(*keys, F.lit(1))]
    cells = wanted.select(F.explode(F.array(*h)).alias("h"))
    cells = cells.select(F.shiftrightunsigned("h", 64 - bits + 6).alias("word"), F.shiftrightunsigned("h", 64 - bits).bitwiseAND(63).cast("int").alias("bit"))
    words = cells.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()
    table = np.zeros(1 << (bits - 6), np.uint64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    sent, n = rows.sparkSession.sparkContext.broadcast(table), len(rows.columns)

    def passing(batches):
        t = sent.value
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for c in batch.columns[n:]:
                cell = c.to_numpy().view(np.uint64) >> np.uint64(64 - bits)
                keep &= (t[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63)) & np.uint64(1)).astype(bool)
            yield pa.RecordBatch.from_arrays(batch.columns[:n], names=batch.schema.names[:n]).filter(pa.array(keep))

    run = passing if then is None else lambda batches: then(passing(batches))
    return rows.select("*", h[0].alias("h1"), h[1].alias("h2")).mapInArrow(run, schema or rows.schema)


def renamed(df: DataFrame) -> DataFrame:
    """The same columns as c0, c1, ...: no name of a caller's column clashes with one of ours."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def running(df: DataFrame, group: str | None, order: list[str], value: str, tag: str) -> DataFrame:
    """Adds the columns before_value and before_rows: the sum of value and the number of rows before each row, in the given order of
    columns within each group (an integer column without nulls, or None for one group).

    Rows are range-partitioned by (group, order), so a group that holds a third of all rows is spread over many tasks; each task adds up
    its own rows, and only one row for each task and group takes part in the sums over tasks. Rows that are equal in every order column
    must be interchangeable.
    """
    if group is None:
        df, group = df.withColumn("_one", F.lit(0)), "_one"
    extra = [T.StructField("_part", T.IntegerType()), T.StructField("_v", T.LongType()), T.StructField("_n", T.LongType())]
    schema = T.StructType([*df.schema.fields, *extra])

    def local(batches):
        from pyspark import TaskContext

        part, last, v0, n0 = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            g = batch.column(group).to_numpy(zero_copy_only=False).astype(np.int64)
            v = batch.column(value).to_numpy(zero_copy_only=False).astype(np.int64)
            new = np.empty(n, bool)
            new[0] = g[0] != last
            new[1:] = g[1:] != g[:-1]
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            before = np.concatenate([[0], np.cumsum(v)])
            own = start >= 0
            at = np.maximum(start, 0)
            sums = before[:-1] - np.where(own, before[at], 0) + np.where(own, 0, v0)
            rows = np.arange(n) - np.where(own, at, 0) + np.where(own, 0, n0)
            last, v0, n0 = g[-1], int(sums[-1] + v[-1]), int(rows[-1] + 1)
            columns = [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(sums), pa.array(rows)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_part", "_v", "_n"])

    keys = [group, *order]
    rows = materialize(df.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(local, schema), tag)
    w = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("_part", group).agg(F.sum(value).alias("_t"), F.count("*").alias("_c"))
    base = base.select("_part", group, F.coalesce(F.sum("_t").over(w), F.lit(0)).alias("_bt"), F.coalesce(F.sum("_c").over(w), F.lit(0)).alias("_bc"))
    out = rows.join(base, ["_part", group]).withColumn("before_value", F.col("_bt") + F.col("_v")).withColumn("before_rows", F.col("_bc") + F.col("_n"))
    return out.drop("_part", "_v", "_n", "_bt", "_bc", "_one")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose bits all depend on all bits of x (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _inverse(p: int) -> int:
    return pow(p, -1, 1 << 64)


#: Base of the polynomial hashes: odd, and 5 modulo 8, so that its powers repeat as late as they can.
BASE = 0x9E3779B97F4A7C15 - 0x9E3779B97F4A7C15 % 8 + 5
BYTE_KEYS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and BASE ** -i modulo 2 ** 64 for i < n at least; kept by the worker up to 16 million."""
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
        for out, b in ((up, BASE), (down, _inverse(BASE))):
            out[0] = 1
            done, step = 1, b
            while done < size:
                out[done : 2 * done] = out[:done] * np.uint64(step)
                step = step * step % (1 << 64)
                done *= 2
        if size > 1 << 24:
            return up, down
        _POWERS["up"], _POWERS["down"] = up, down
    return _POWERS["up"], _POWERS["down"]


def _offsets(column: pa.Array) -> np.ndarray:
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column as one array, and where each text starts (one more entry than rows); null counts as empty."""
    import pyarrow.compute as pc

    column = pc.fill_null(column, "") if column.null_count else column
    at, data = _offsets(column), column.buffers()[2] if len(column) else None
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


#: Bytes of text that numpy works on at once.
AT_ONCE = 4 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def dictionary(body: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different strings among those laid end to end in body, laid end to end; where each begins (one more entry); and each string's
    place among them. Bytes are compared, not hashes."""
    ends = pa.py_buffer(np.append(starts, len(body)).astype(np.int32))
    coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, ends, pa.py_buffer(np.ascontiguousarray(body))]).dictionary_encode()
    data, at = text_bytes(coded.dictionary)
    return data, at, coded.indices.to_numpy()


def coded_words(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Of texts laid end to end: the text and the code of each word, and the different words by their codes. Words are compared, not hashed."""
    s, e, texts = word_spans(data, at, space) if len(data) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64))
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), []
    body, bounds, codes = dictionary(data[~space[data]], np.cumsum(e - s) - (e - s))
    raw, bounds = body.tobytes(), bounds.tolist()
    return np.repeat(np.arange(len(at) - 1), np.diff(texts)), codes.astype(np.int64), [raw[a:b] for a, b in zip(bounds, bounds[1:])]


def parts(data: np.ndarray, space: np.ndarray = SPACE, limit: int = AT_ONCE):
    """A very long text in parts of about limit bytes, cut before a byte that ends words."""
    cut = 0
    while cut < len(data):
        stop = min(len(data), cut + limit)
        while stop < len(data) and not space[data[stop]]:
            stop += 1
        yield data[cut:stop]
        cut = stop


#: Masks of the first n bytes of 8.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def hash_spans(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings data[s:e]: 8 bytes at a time are added to a state that mix64() then scatters, so strings of up to 8
    bytes and equal length never agree. What is longer than 64 bytes is left to XXH3."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the 8 bytes from each place on
    n = e - s
    h = mix64((eight[s] & FIRST[np.minimum(n, 8)]) + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    todo = np.flatnonzero(n > 8)
    for done in range(8, 64, 8):
        if not len(todo):
            break
        h[todo] = mix64(h[todo] + (eight[s[todo] + done] & FIRST[np.minimum(n[todo] - done, 8)]))
        todo = todo[n[todo] > done + 8]
    if len(todo):
        raw = data.tobytes()
        h[todo] = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(s[todo].tolist(), e[todo].tolist())]
    return h


def word_spans(data: np.ndarray, at: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts laid end to end: where each word begins and ends, and where each text's words begin among the words."""
    word = ~space[data]
    edge = np.empty(len(data) + 1, bool)
    edge[1:-1] = word[1:] != word[:-1]
    edge[0] = edge[-1] = True
    inner = at[(at > 0) & (at < len(data))]
    edge[inner] = True  # a text's end is a word's end
    cuts = np.flatnonzero(edge)
    own = word[cuts[:-1]]
    s, e = cuts[:-1][own], cuts[1:][own]
    return s, e, np.searchsorted(s, at)


def hash_words(data: np.ndarray, at: np.ndarray, lower: bool = True, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of texts laid end to end, and where each text's words start among them."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    s, e, texts = word_spans(data, at, space)
    return hash_spans(LOWER[data] if lower else data, s, e), texts


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words that stay within a text (of the whole text if it has fewer words, but one at least), and starts."""
    n = np.diff(at)
    count = np.where(n > 0, np.maximum(n - k + 1, 1), 0)
    starts = np.concatenate([[0], np.cumsum(count)])
    if not starts[-1]:
        return np.zeros(0, np.uint64), starts
    weights = [np.uint64(pow(BASE, k - 1 - j, 1 << 64)) for j in range(k)]
    out = np.empty(starts[-1], np.uint64)
    if len(words) >= k and (n >= k).any():
        m = len(words) - k + 1
        h = words[k - 1 :].copy()
        for j in range(k - 1):
            h += words[j : j + m] * weights[j]
        inside = np.ones(m, bool)  # runs that begin in the last words of a text leave it
        ends = at[1:][n > 0]
        last = (ends[:, None] - np.arange(1, k)[None, :]).ravel()
        inside[last[(last >= 0) & (last < m)]] = False
        for a, b in zip(at[:-1][(n > 0) & (n < k)].tolist(), at[1:][(n > 0) & (n < k)].tolist()):
            inside[a:b] = False
        out[np.repeat(n >= k, count)] = h[inside]
    for i in np.flatnonzero((n > 0) & (n < k)).tolist():
        h = int(n[i])
        for w in words[at[i] : at[i + 1]].tolist():
            h = (h * BASE + w) % (1 << 64)
        out[starts[i]] = h
    return mix64(out), starts


def slices(at: np.ndarray, limit: int = AT_ONCE) -> list[tuple[int, int]]:
    """Runs of rows whose texts hold limit bytes together at most; a longer text is a run of its own."""
    out, lo, n = [], 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        out.append((lo, min(hi, n)))
        lo = out[-1][1]
    return out


def word_hashes(column: pa.Array, lower: bool = True, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """hash_words() for a column, in parts of bounded size; a very long text is cut before white space."""
    data, at = text_bytes(column)
    words, starts, done = [], [np.zeros(1, np.int64)], 0
    for lo, hi in slices(at):
        part = data[at[lo] : at[hi]]
        if hi == lo + 1 and len(part) > 2 * AT_ONCE:
            n, cut = 0, 0
            while cut < len(part):
                stop = min(len(part), cut + AT_ONCE)
                while stop < len(part) and not space[part[stop]]:
                    stop += 1
                w, _ = hash_words(part[cut:stop], np.array([0, stop - cut]), lower, space)
                words.append(w)
                n, cut = n + len(w), stop
            starts.append(np.array([done + n]))
            done += n
        else:
            w, s = hash_words(part, at[lo : hi + 1] - at[lo], lower, space)
            words.append(w)
            starts.append(s[1:] + done)
            done += len(w)
    return (np.concatenate(words) if words else np.zeros(0, np.uint64)), np.concatenate(starts)
