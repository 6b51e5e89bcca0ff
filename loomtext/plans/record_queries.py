"""Queries of record analytics and of windows over events and conversations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import records as R
from ..sources.shared import scratch
from ..streaming import timed

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def take(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return take


def t(spark, sf, name):
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if k == "timestamp_ntz" else F.col(c) for c, k in df.dtypes])


@query("a1_filtered_rows", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE contains(lower(o_orderpriority), 'urg') AND o_orderstatus = 'F'")
def a1(spark, sf):
    return R.matching(t(spark, sf, "orders"), {"o_orderpriority": "URG", "o_orderstatus": "f", "unknown": 1}).where("o_orderstatus = 'F'").select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("a1_keyword_rows", "SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'nation_1') OR contains(lower(n_name), 'n_7')")
def a1b(spark, sf):
    """Words of two characters are passed over."""
    return R.any_column_has(t(spark, sf, "nation"), ["NATION_1", "n_", "N_7"]).select("n_nationkey", "n_name")


def _profile(table: str, columns: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, min({x})::DOUBLE AS least, max({x})::DOUBLE AS most, round(avg({x}), 4) AS mean FROM {table}" for c, x in columns.items())


@query("a2_profile", _profile("customer", {"c_custkey": "c_custkey", "c_name": "length(c_name)", "c_nationkey": "c_nationkey", "c_acctbal": "c_acctbal", "c_mktsegment": "length(c_mktsegment)"}))
def a2(spark, sf):
    return R.profile(t(spark, sf, "customer"))


@query("a2_top_values", "WITH v AS (SELECT 'c_mktsegment' AS \"column\", c_mktsegment AS value FROM customer UNION ALL SELECT 'c_name', c_name FROM customer), n AS (SELECT \"column\", value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL), r AS (SELECT *, (row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value))::INTEGER AS place FROM n) SELECT * FROM r WHERE place <= 5")
def a2_values(spark, sf):
    return R.frequent_values(t(spark, sf, "customer"), ["c_mktsegment", "c_name"])


def _ten(table: str, key: str, columns: list[str]) -> str:
    hit = " OR ".join(f"contains(lower({c}), '{w}')" for c in columns for w in ("lier#00000001", "bolt", "machin", "brand#4"))
    return f"(SELECT '{table}' AS source, {key}::VARCHAR AS key FROM {table} WHERE {hit} ORDER BY {key} LIMIT 10)"


@query("a3_cross_table", " UNION ALL ".join([_ten("supplier", "s_suppkey", ["s_name"]), _ten("part", "p_partkey", ["p_name", "p_brand", "p_type"]), _ten("customer", "c_custkey", ["c_name", "c_mktsegment"])]))
def a3(spark, sf):
    """All columns of three tables, ten rows of each at most."""
    tables = {name: (t(spark, sf, name), key) for name, key in (("supplier", "s_suppkey"), ("part", "p_partkey"), ("customer", "c_custkey"))}
    return R.search_tables(tables, ["lier#00000001", "BOLT", "machin", "Brand#4", "at"]).select("source", "key")


@query("a4_top_tags", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10")
def a4(spark, sf):
    return R.top_values(t(spark, sf, "part"), "p_brand", 10)


@query("a5_size_stats", "SELECT lang, count(*) AS n, sum(strlen(text))::BIGINT AS bytes, round(avg(strlen(text)), 4) AS mean, round(sum(strlen(text)) / 1048576, 4) AS mb FROM documents GROUP BY lang")
def a5(spark, sf):
    n = F.octet_length("text")
    return t(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(n).alias("bytes"), F.round(F.avg(n), 4).alias("mean"), F.round(F.sum(n) / 1048576, 4).alias("mb"))


@query("a6_newest", "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS n FROM events) WHERE n <= 20")
def a6(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), "event_id")
    return t(spark, sf, "events").withColumn("n", F.row_number().over(w)).where("n <= 20").select("event_type", "event_id")


@query("a7_success_rates", "SELECT event_type, count(*) AS n, round(avg((value > 50)::INTEGER) * 100, 2) AS success_percent, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def a7(spark, sf):
    return R.success_stats(t(spark, sf, "events"), "event_type", F.col("value") > 50, "value")


@query("a8_channels_by_recipients", "SELECT r_name, n_name FROM region, nation")
def a8(spark, sf):
    return t(spark, sf, "nation").select("n_name").crossJoin(F.broadcast(t(spark, sf, "region").select("r_name")))


@query("a9_delivery", "SELECT p_partkey, round(least(coalesce(CASE WHEN p_size % 3 > 0 THEN 0.9 END, 0.85) * CASE WHEN p_size % 2 = 0 THEN 1.2 ELSE 1.0 END, 1.0), 4)::DOUBLE AS p FROM part")
def a9(spark, sf):
    base, factor = F.when(F.col("p_size") % 3 > 0, 0.9), F.when(F.col("p_size") % 2 == 0, 1.2)
    return t(spark, sf, "part").select("p_partkey", F.round(R.delivery(base, factor), 4).alias("p"))


@query("a10_free_hours", "SELECT d.day, h.hour::INTEGER AS hour FROM (SELECT DISTINCT ts::DATE AS day FROM events WHERE event_type = 'purchase') d CROSS JOIN (SELECT unnest(range(9, 18)) AS hour) h WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'purchase' AND e.ts::DATE = d.day AND hour(e.ts) = h.hour)")
def a10(spark, sf):
    e = t(spark, sf, "events").where("event_type = 'purchase'").select(F.to_date("ts").alias("day"), F.hour("ts").alias("at"))
    return R.free_hours(e, "day", "at")


@query("a11_schedule", "SELECT o_orderdate::DATE AS day, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL")
def a11(spark, sf):
    return t(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("a12_last_five", "SELECT user_id, count(*) AS n, round(avg(value), 4) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r <= 5 GROUP BY user_id")
def a12(spark, sf):
    return R.last_rows(t(spark, sf, "events"), "user_id", "event_id", 5).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


@query("a13_conversations", "SELECT role, count(*) AS n, round(count(*) / (SELECT count(*) FROM conversations), 4) AS share, round(avg(length(text)), 4) AS mean FROM conversations GROUP BY role")
def a13(spark, sf):
    c = t(spark, sf, "conversations")
    total = c.agg(F.count("*").alias("total"))  # one row
    return c.groupBy("role").agg(F.count("*").alias("n"), F.round(F.avg(F.length("text")), 4).alias("mean")).crossJoin(F.broadcast(total)).select("role", "n", F.round(F.col("n") / F.col("total"), 4).alias("share"), "mean")


@query("a14_durations", "WITH d AS (SELECT user_id, date_diff('second', min(ts), max(ts)) AS s FROM events GROUP BY user_id) SELECT user_id, CASE WHEN s < 3600 THEN 'minutes' WHEN s < 86400 THEN 'hours' ELSE 'days' END AS duration FROM d")
def a14(spark, sf):
    s = F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))
    d = t(spark, sf, "events").groupBy("user_id").agg(s.alias("s"))
    return d.select("user_id", F.when(F.col("s") < 3600, "minutes").when(F.col("s") < 86400, "hours").otherwise("days").alias("duration"))


@query("a15_last_turns", "SELECT conv_id, md5(string_agg(role || ': ' || substr(text, 1, 50), E'\\n' ORDER BY turn)) AS summary FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3 GROUP BY conv_id")
def a15(spark, sf):
    c = R.last_rows(t(spark, sf, "conversations"), "conv_id", "turn", 3)
    line = F.concat("role", F.lit(": "), F.substring("text", 1, 50))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))).alias("x"))
    return g.select("conv_id", F.md5(F.array_join(F.transform("x", lambda x: x["l"]), "\n")).alias("summary"))


@query("a16_system_stats", "SELECT count(DISTINCT conv_id) AS sessions, round(count(*) / count(DISTINCT conv_id), 4) AS mean_turns, max(turn) AS most FROM conversations")
def a16(spark, sf):
    n = F.count_distinct("conv_id")
    return t(spark, sf, "conversations").agg(n.alias("sessions"), F.round(F.count("*") / n, 4).alias("mean_turns"), F.max("turn").alias("most"))


@query("a17_histogram", "SELECT floor(value / 20)::BIGINT AS rating, count(*) AS n FROM events GROUP BY ALL")
def a17(spark, sf):
    return t(spark, sf, "events").groupBy(F.floor(F.col("value") / 20).alias("rating")).agg(F.count("*").alias("n"))


@query("a18_running", "SELECT user_id, event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id), 4) AS running FROM events")
def a18(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("event_id")
    return t(spark, sf, "events").select("user_id", "event_id", F.round(F.sum("value").over(w), 4).alias("running"))


@query("a20_blend", "SELECT doc_id, round(0.4 * quality + 0.6 * toxic, 4)::DOUBLE AS blended FROM labels")
def a20(spark, sf):
    return t(spark, sf, "labels").select("doc_id", F.round(0.4 * F.col("quality") + 0.6 * F.col("toxic"), 4).alias("blended"))


@query("a21_topics", "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 5 GROUP BY conv_id")
def a21(spark, sf):
    c = R.last_rows(t(spark, sf, "conversations"), "conv_id", "turn", 5)
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return g.select("conv_id", F.array_join(F.transform("x", lambda x: x["role"]), ",").alias("topics"))


@query("a24_bids", "SELECT l_orderkey, l_suppkey FROM (SELECT l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(0.3 * l_extendedprice / 500 + 0.2 * l_quantity / 12 + 0.25 * l_discount * 10 / 10 + 0.25 * (1 - l_tax * 100 / 10), 6), l_suppkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def a24(spark, sf):
    s = F.round(R.bid_score(F.col("l_extendedprice"), F.col("l_quantity"), F.col("l_discount") * 10, F.col("l_tax") * 100), 6)
    return t(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.min_by("l_suppkey", F.struct(s, "l_suppkey", "l_linenumber")).alias("l_suppkey"))


@query("a26_costs", "SELECT lang, round(sum(length(text) // 4) * 0.15 / 1000000, 8) AS cost FROM documents GROUP BY lang")
def a26(spark, sf):
    return t(spark, sf, "documents").groupBy("lang").agg(F.round(F.sum(F.floor(F.length("text") / 4)) * 0.15 / 1000000, 8).alias("cost"))


@query("a27_latency", "SELECT event_type, round(min(value), 4) AS least, round(max(value), 4) AS most, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std FROM events GROUP BY event_type")
def a27(spark, sf):
    v = F.col("value")
    return t(spark, sf, "events").groupBy("event_type").agg(*[F.round(f(v), 4).alias(n) for f, n in ((F.min, "least"), (F.max, "most"), (F.avg, "mean"), (F.stddev_pop, "std"))])


@query("w1_sessions", """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS id FROM g)
 SELECT user_id, epoch_us(min(ts)) AS begin_us, count(*) AS n FROM s GROUP BY user_id, id""")
def w1(spark, sf):
    return R.sessions(t(spark, sf, "events"), "user_id", "ts", "30 minutes").select("user_id", F.unix_micros("begin").alias("begin_us"), "n")


@query("w2_bounded_turns", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 4")
def w2(spark, sf):
    return R.last_rows(t(spark, sf, "conversations"), "conv_id", "turn", 4).select("conv_id", "turn")


@query("w3_message_window", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC) AS p, greatest(4 - count(*) FILTER (WHERE role = 'system') OVER (PARTITION BY conv_id), 0) AS room FROM conversations) SELECT conv_id, turn, role FROM r WHERE role = 'system' OR p <= room")
def w3(spark, sf):
    return R.message_window(t(spark, sf, "conversations"), "conv_id", "turn", "role", 4).select("conv_id", "turn", "role")


_DAY = 86_400_000_000
_FETCHES = f"""m AS (SELECT user_id, min(us) AS us FROM e GROUP BY user_id UNION ALL SELECT m.user_id, min(e.us) FROM m JOIN e ON e.user_id = m.user_id AND e.us >= m.us + {_DAY} GROUP BY m.user_id, m.us),
 n AS (SELECT user_id, count(*) AS n FROM e GROUP BY user_id)"""


@query("w4_cache", f"WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us FROM events), {_FETCHES} SELECT user_id, n - count(*) AS hits, count(*) AS misses, count(*) - 1 AS expired FROM m JOIN n USING (user_id) GROUP BY user_id, n")
def w4(spark, sf):
    """Entries live for a day from their fetch."""
    h = R.cache_hits(t(spark, sf, "events"), "user_id", "ts", 86_400)
    return h.groupBy("user_id").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count_if("expired").alias("expired"))


def _ended(spark, sf, of) -> DataFrame:
    """What a stream over the events gives when all that the watermark has passed is taken."""
    kind = spark.read.parquet(f"{sf}/events.parquet").schema
    out, checkpoint = scratch(spark, "stream"), scratch(spark, "checkpoint")
    timed.run_to_end(of(spark.readStream.schema(kind).parquet(f"{sf}/events.parquet*")), out, checkpoint)
    return spark.read.parquet(out)


_PASSED = "e AS (SELECT user_id, epoch_us(ts) AS us, wm FROM events, (SELECT (max(epoch_us(ts)) // 1000 - 600000) * 1000 AS wm FROM events) WHERE epoch_us(ts) <= wm)"


@query("w4_cache_stream", f"WITH RECURSIVE {_PASSED}, {_FETCHES} SELECT user_id, n - count(*) AS hits, count(*) AS misses, count(*) FILTER (WHERE us + {_DAY} <= (SELECT any_value(wm) FROM e)) AS expired FROM m JOIN n USING (user_id) GROUP BY user_id, n")
def w4_stream(spark, sf):
    """The same cache as state of a stream; entries expire by timers."""
    h = _ended(spark, sf, lambda s: timed.cache_stream(s, "user_id", "ts", 86_400))
    return h.groupBy("user_id").agg(*[F.count_if(F.col("outcome") == o).alias(c) for o, c in (("hit", "hits"), ("miss", "misses"), ("expired", "expired"))])


@query("w1_registry", f"""WITH {_PASSED}, g AS (SELECT *, (us - lag(us) OVER (PARTITION BY user_id ORDER BY us) < 14400000000) IS NOT TRUE AS new FROM e), s AS (SELECT *, count(*) FILTER (WHERE new) OVER (PARTITION BY user_id ORDER BY us, new DESC) AS s FROM g)
 SELECT user_id, min(us) AS begin, max(us) AS last, count(*) AS n FROM s GROUP BY user_id, s, wm HAVING max(us) + 14400000000 <= wm""")
def w1_registry(spark, sf):
    """Sessions that were idle for four hours, ended by their timers."""
    return _ended(spark, sf, lambda s: timed.session_registry(s, "user_id", "ts", 14_400))


@query("w5_old", "SELECT count(*) FILTER (WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 30 DAY) AS old, count(*) AS n FROM events")
def w5(spark, sf):
    e = t(spark, sf, "events")
    last = e.agg(F.max("ts").alias("last"))  # one row
    return e.crossJoin(F.broadcast(last)).agg(F.count_if(F.col("ts") < F.col("last") - F.expr("INTERVAL 30 DAYS")).alias("old"), F.count("*").alias("n"))


@query("s9_export", "SELECT r_regionkey, r_regionkey || ',' || r_name AS line FROM region")
def s9(spark, sf):
    return t(spark, sf, "region").select("r_regionkey", F.to_csv(F.struct("r_regionkey", "r_name")).alias("line"))


@query("s16_restored", "SELECT source, count(*) AS chunks, min(doc_id) AS first_id, arg_min(lang, doc_id) AS lang FROM documents GROUP BY source")
def s16(spark, sf):
    return t(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("chunks"), F.min("doc_id").alias("first_id"), F.min_by("lang", "doc_id").alias("lang"))


@query("s15_new_only", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def s15(spark, sf):
    return t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id", "left_anti").select("doc_id")


@query("z13_combined", "SELECT user_id, count(*) FILTER (WHERE value > 50) AS good, count(*) FILTER (WHERE value <= 50) AS bad, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id")
def z13(spark, sf):
    v = F.col("value")
    return t(spark, sf, "events").groupBy("user_id").agg(F.count_if(v > 50).alias("good"), F.count_if(v <= 50).alias("bad"), F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("z25_categories", "SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents WHERE source = 'src1' GROUP BY lang")
def z25(spark, sf):
    return t(spark, sf, "documents").where("source = 'src1'").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))
