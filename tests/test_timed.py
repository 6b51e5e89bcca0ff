"""State with timers against plain folds, over several batches, with late rows and after a restart; the same rules on tables."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from loomtext.operators import html, records
from loomtext.streaming import timed

SCHEMA = "user string, ts timestamp, at string"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def moment(seconds):
    return START + timedelta(seconds=seconds)


def micros(seconds):
    return int(moment(seconds).timestamp()) * 1_000_000 + round(seconds % 1 * 1e6)


def fold(rows, live, passed):
    """(user, seconds, outcome) of rows that the watermark has passed."""
    out, held = [], {}
    for user, at in sorted(rows, key=lambda x: (x[0] or "", x[1])):
        if at > passed:
            continue
        if user in held and held[user] + live <= at:
            out.append((user, held.pop(user) + live, "expired"))
        out.append((user, at, "hit" if user in held else "miss"))
        held.setdefault(user, at)
    return out + [(u, a + live, "expired") for u, a in held.items() if a + live <= passed]


def sessions(rows, idle, passed):
    out, open_ = [], {}
    for user, at in sorted(rows, key=lambda x: (x[0] or "", x[1])):
        if at > passed:
            continue
        if user in open_ and at - open_[user][1] >= idle:
            out.append((user, *open_.pop(user)))
        b, _, n = open_.get(user, (at, at, 0))
        open_[user] = (b, at, n + 1)
    return out + [(u, *x) for u, x in open_.items() if x[1] + idle <= passed]


@pytest.fixture(scope="module")
def batches():
    r = random.Random(3)
    out = []
    for i in range(3):  # each batch reaches ten minutes further, and mixes with the one before
        rows = [(r.choice(["a", "b", "c", None]), i * 1500 + r.randrange(-300, 1500) + 0.25) for _ in range(60)]
        out.append([(u, max(t, 0.25)) for u, t in rows])
    out[0] += [("burst", 0.5), ("burst", 400.5), ("burst", 800.5)]
    out[2] += [("a", 0.75), ("late", 100.75)]  # the watermark has passed these
    out.append([("far", 9000.5)])
    return out


@pytest.mark.parametrize("kind", ["cache", "sessions"])
def test_streams_equal_plain_folds(spark, batches, tmp_path, kind):
    folder, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    late = 600
    kept, mark = [], None
    for rows in batches:
        kept += [x for x in rows if mark is None or x[1] > mark]
        mark = max([*([] if mark is None else [mark]), max(t for _, t in rows) - late])
    assert len(kept) == sum(map(len, batches)) - 2
    for n, rows in enumerate(batches):  # each run starts from what the one before has left
        spark.createDataFrame([(u, moment(t), "x") for u, t in rows] + [("none", None, "x")], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SCHEMA).parquet(folder)
        got = timed.cache_stream(stream, "user", "ts", 600) if kind == "cache" else timed.session_registry(stream, "user", "ts", 120)
        timed.run_to_end(got, f"file://{out}", f"file://{checkpoint}")
    found = sorted(map(tuple, spark.read.parquet(out).collect()), key=repr)
    if kind == "cache":
        want = [(u, micros(t), o) for u, t, o in fold(kept, 600, mark)]
        assert [x[1:] for x in found if x[0] == "burst" and x[2] != "expired"] == [(micros(0.5), "miss"), (micros(400.5), "hit"), (micros(800.5), "miss")]
    else:
        want = [(u, micros(b), micros(e), n) for u, b, e, n in sessions(kept, 120, mark)]
    assert found == sorted(want, key=repr)


def test_cache_on_tables(spark, batches):
    rows = [x for b in batches for x in b]
    df = spark.createDataFrame([(u, moment(t), "x") for u, t in rows] + [("none", None, "x"), ("a", None, "y")], SCHEMA).repartition(3)
    got = records.cache_hits(df, "user", "ts", 600)
    assert got.columns == ["user", "ts", "at", "hit", "expired"]
    out = got.withColumn("us", F.unix_micros("ts")).collect()
    plain = fold(rows, 600, 1e9)
    assert sorted((repr(r["user"]), r["us"]) for r in out if r["hit"]) == sorted((repr(u), micros(t)) for u, t, o in plain if o == "hit")
    last = len({u for u, _ in rows})  # the end of a key's last entry is no row
    assert sum(r["expired"] for r in out) == sum(o == "expired" for _, _, o in plain) - last
    assert not any(r["hit"] or r["expired"] for r in out if r["ts"] is None) and len(out) == len(rows) + 2
    assert records.cache_hits(df.limit(0), "user", "ts", 600).count() == 0


def test_cache_over_many_batches_of_arrow(spark):
    df = spark.range(25_000).select((F.col("id") % 2).alias("k"), (F.lit(START) + F.make_interval(secs=F.col("id"))).alias("ts")).coalesce(1)
    got = records.cache_hits(df, "k", "ts", 100).agg(F.count_if("hit"), F.count_if("expired")).first()
    assert tuple(got) == (25_000 - 500, 498)  # every hundred seconds a fetch


def test_tables_within_tables(spark):
    deep = "<table><tr><td>l1"
    for i in range(2, 7):
        deep += f"<table><tr><td>l{i}"
    deep += "</td></tr></table>" * 6
    two = "<table><tr><td>a<table><tr><td>b1</td></tr></table><p><table><tr><td>b2<table><tr><td>c</td></tr></table></td></tr></table></td><td><table><tr><td>b3</td></tr></table></td></tr></table><table><tr><td>z</td></tr></table>"
    many = "<table><tr><td>x" * 3000
    df = spark.createDataFrame([(1, deep), (2, two), (3, many), (4, None), (5, "<p>none</p>")], "page_id int, html string")
    got = {}
    for r in html.nested(df).orderBy("page_id", "line").collect():
        got.setdefault(r["page_id"], []).append(r["value"])
    assert got[1] == ["  " * i + f"- l{i + 1}" for i in range(6)]
    assert got[2] == ["- a", "  - b1", "  - b2", "    - c", "  - b3", "- z"]
    assert len(got[3]) == 3000 and set(got) == {1, 2, 3}


def test_search_and_profile(spark):
    a = spark.createDataFrame([(i, f"name {i}", None if i % 2 else "Bolt") for i in range(40)], "k int, n string, t string")
    b = spark.createDataFrame([(7, "bolted"), (3, "nothing")], "id int, x string")
    got = [(r["source"], r["key"]) for r in records.search_tables({"a": (a, "k"), "b": (b, "id")}, ["BOLT", "of"]).collect()]
    assert got == [("a", str(i)) for i in range(0, 20, 2)] + [("b", "7")]
    p = {r["column"]: (r["n"], r["nulls"], r["distinct_values"]) for r in records.profile(a).collect()}
    assert p == {"k": (40, 0, 40), "n": (40, 0, 40), "t": (40, 20, 1)}
    none = {r["column"]: r["distinct_values"] for r in records.profile(a.limit(0)).collect()}
    assert none == {"k": 0, "n": 0, "t": 0}


def test_few_questions_to_the_state():
    """A key's rows, and a timer, cost one reading and one writing of the state besides the timer, however many rows wait."""
    asked, values = [], {}

    class State:
        def __init__(self, name):
            self.name = name

        def exists(self):
            asked.append("exists")
            return self.name in values

        def get(self):
            asked.append("get")
            return values.get(self.name)

        def clear(self):
            asked.append("clear")
            values.pop(self.name, None)

        def update(self, value):
            asked.append("update")
            values[self.name] = value

        put = update

    class Handle:
        def getValueState(self, name, schema):
            return State(name)

        getListState = getValueState

        def registerTimer(self, at):
            asked.append(f"at {at}")

        def deleteTimer(self, at):
            asked.append(f"not at {at}")

    class Mark:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    s = timed.Sessions(1_000_000)
    s.names = ("k", "begin", "last", "n")
    s.init(Handle())
    assert not list(s.handleInputRows((7,), iter([{"at": 1000 * i} for i in (900, 100, 3000, 400)]), Mark(0)))
    assert len(asked) == 3 and asked[1] == "at 100"
    asked.clear()
    assert [tuple(x) for x in s.handleExpiredTimer((7,), Mark(2000), None)] == [(7, 100_000, 900_000, 3)]
    assert len(asked) == 3 and asked[1] == "at 3000"
    asked.clear()
    assert [tuple(x) for x in s.handleExpiredTimer((7,), Mark(9000), None)] == [(7, 3_000_000, 3_000_000, 1)]
    assert len(asked) == 2 and not values
