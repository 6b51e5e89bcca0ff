"""Requests, changing tables and page structure: nulls, ties, empty tables, texts at the limits."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from loomtext.functions import bpe, registered
from loomtext.functions import requests as Q
from loomtext.operators import fusion, html, lexical
from loomtext.sources import collections as C
from loomtext.sources import tables as S


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first()["x"]


def test_requests_of_nothing(spark):
    t = F.col("t")
    got = [one(spark, c, t=None) for c in (Q.day(t, F.lit(2025)), Q.clock(t), Q.file_kind(t), Q.alias(t, Q.CHANNELS, "slack", partial=True), Q.channel_in(t), Q.search_words(t), Q.rubric_score(t), Q.judged_score(t), Q.intent(t), Q.tool(t))]
    assert got == ["today", "09:00", "other", "slack", "slack", "", 5.0, 0.5, "general_conversation", None]


def test_requests(spark):
    t = F.col("t")
    assert one(spark, Q.clock(t), t="99시") == "99:00" and one(spark, Q.clock(t), t="at 0 am") == "00:00"
    assert one(spark, Q.intent_parameters(t), t="날씨 알려줘").asDict() == {"city": "서울", "channel": None, "action": "query"}
    assert one(spark, Q.rubric_score(t, F.lit(2.5)), t="품질 점수: 11") == 2.5
    assert one(spark, Q.routed(t, ["a", "general"]), t='{"scores": {"a": {"score": "x"}}}').asDict() == {"agent": "general", "confidence": 0.0}
    assert one(spark, Q.summary(t, ["m"]), t="x" * 50) == "x" * 50 and one(spark, Q.summary(t, ["m"]), t="m" + "x" * 100) == "m" + "x" * 99 + "..."


#: Requests and what they mean.
MEANT = {
    "day": [("내일", "tomorrow"), (" Today ", "today"), ("2024-03-01", "2024-03-01"), ("03-05", "2025-03-05"), ("someday", "today"), ("", "today"), ("다음주", "next_week")],
    "clock": [("14:30", "14:30"), ("3시", "03:00"), ("오후 11 시", "11:00"), ("3pm", "15:00"), ("12 PM", "12:00"), ("12am", "00:00"), ("7", "07:00"), ("25", "09:00"), ("later", "09:00"), ("", "09:00")],
    "city": [("서울", "seoul"), ("Busan", "busan"), ("서울시 강남", "seoul"), ("Paris", "paris"), (" daegu ", "daegu")],
    "kind": [(".PDF", "document"), ("이미지", "image"), ("mkv", "video"), ("rs", "code"), ("zip", "other"), ("", "other"), ("xlsx", "document")],
    "words": [("프로젝트 문서 찾아줘", "프로젝트"), ("이 파일 보여줘", "이 파일"), ("README please", "readme"), ("API 명세서 검색", "API 명세서"), ("nothing here", ""), ("설정", "설정")],
    "channel": [("팀에게 메일로 보내줘", "email"), ("문자 부탁", "sms"), ("슬랙으로 slack에", "slack"), ("hello", "slack"), ("SMS로", "sms")],
    "judged": [('Sure: {"score": 0.8, "explanation": "fits"} done', 0.8), ("no braces", 0.5), ("{broken", 0.5), ('{"explanation": "x"}', 0.5), ('{"score": "1"}', 1.0)],
    "api": [("Weather API", "weather"), ("날씨_api", "weather"), ("문서 검색", "file"), ("FILE_API", "file"), ("Billing", "billing")],
    "place": [("대구 인천", "대구"), ("인천에서", "인천"), ("독도 가는 길", "독도"), ("날씨", "서울"), ("안녕", None)],
}
ITEMS = "구조/논리: {}/2점\n정량 데이터: 1/2\n구체적 도구/기술: 2/2\n실제 사례: 0.5/2\n전문성 / 깊이: 1/2\n**품질 점수:** 9"
MEANT["rubric"] = [(ITEMS.format(2), 6.5), ("**품질 점수**: 8", 8.0), ("품질 점수: **7.5**", 7.5), ("품질 점수: 42", 3.0), ("none", 3.0), ("구조/논리: 2/2\n품질 점수 : 4", 4.0)]


def test_what_requests_mean(spark):
    t = F.col("t")
    rules = {
        "day": Q.day(t, F.lit(2025)), "clock": Q.clock(t), "city": Q.city(t), "kind": Q.file_kind(t), "words": Q.search_words(t), "channel": Q.channel_in(t),
        "judged": Q.judged_score(t), "api": Q.api(t), "place": Q.intent_parameters(t)["city"], "rubric": Q.rubric_score(t, F.lit(3.0)),
    }
    for name, cases in MEANT.items():
        df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, t string")
        assert [r["x"] for r in df.select("i", rules[name].alias("x")).orderBy("i").collect()] == [y for _, y in cases], name


def test_stop_reason(spark):
    cases = [(1, 9.0, None, "threshold"), (5, 3.0, 3.0, "maximum"), (2, 3.0, 4.0, "regress"), (2, 4.2, 4.0, "plateau"), (1, 4.2, 4.0, None), (2, 5.0, 4.0, None), (1, 1.0, None, None), (None, None, None, None)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, n int, s double, p double, want string")
    got = df.select("i", "want", Q.stop_reason(F.col("n"), F.col("s"), F.col("p")).alias("got")).orderBy("i").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_changes(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, v string")
    none = spark.createDataFrame([], "k int, v string, deleted boolean, at int")
    assert sorted(map(tuple, S.changed(rows, none, "k").collect())) == [(1, "a"), (2, "b"), (3, None)]
    more = spark.createDataFrame([(1, "x", None, 2), (1, "y", True, 1), (2, None, True, 1), (4, "d", False, 1), (3, None, False, 1)], none.schema)
    assert sorted(map(tuple, S.changed(rows, more, "k").collect())) == [(1, "x"), (3, None), (4, "d")]
    assert S.changed(rows.limit(0), none, "k").count() == 0


def test_directory_and_batches(spark):
    files = spark.createDataFrame([("/a/x", 1), ("/a/b/y", 2), ("/ab/z", 4), (None, 8)], "path string, size long")
    assert sorted(map(tuple, S.directory(files, "a/").collect())) == [("/a", 1, 1), ("/a/b", 1, 2)]
    b = spark.createDataFrame([(1, None, 3), (1, True, 2), (2, False, None)], "b int, ok boolean, n int")
    assert sorted(map(tuple, S.batch_counters(b, F.col("b"), F.col("ok"), F.col("n")).collect())) == [(1, 1, 1, 2), (2, 0, 1, 0)]


def test_hashed_vectors(spark):
    df = spark.createDataFrame([(1, "one two one"), (2, None), (3, "")], "k int, t string")
    got = {r["k"]: r["embedding"] for r in lexical.hashed_vectors(df, "k", "t", 16).collect()}
    assert [len(v) for v in got.values()] == [16] * 3 and sum(got[2]) == sum(got[3]) == 0 and abs(sum(x * x for x in got[1]) - 1) < 1e-9


def parts(cell):
    return html.cell_parts(html.parse(f"<td>{cell}</td>").first("td"))


def test_cell_parts():
    assert parts("") == [] and parts("short") == ["short"] and parts("x" * 500) == ["x" * 500]
    line = "a line of more than twenty characters"
    assert parts("<br>".join([line + " " * 3] * 20)) == [line] * 20
    p = "w" * 60
    assert parts(f"<p>{p}</p><p>tiny</p>" + f"<p>{p}</p>" * 9) == [p] * 10
    text = " ".join(f"word{i}" for i in range(400))
    assert " ".join(parts(text)) == text and all(len(x) <= 600 for x in parts(text))
    assert parts("before the list stands this line<ul>" + f"<li>{line} {'y' * 500}</li></ul>")[0] == "before the list stands this line"


def test_clean_and_nested(spark):
    df = spark.createDataFrame([(1, "<div class='ad'>x</div><p onclick='y'>a &lt; b<script>z</script></p>"), (2, None)], "page_id int, html string")
    got = dict(map(tuple, html.cleaned(df).collect()))
    assert got == {1: "<p>a &lt; b</p>", 2: ""}
    assert html.cells(df).count() == html.parts(df).count() == html.tree(df).count() == html.nested(df).count() == 0


def test_structure_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.html").write_text("<title>T</title><body><h1>Head</h1><p>Some words</p></body>")
    (tmp_path / "in" / "b.txt").write_text("no page")
    got = html.structure_files(spark, str(tmp_path / "in"), str(tmp_path / "out")).collect()
    assert len(got) == 1 and got[0]["title"] == "T" and got[0]["blocks"][0]["data"] == '"Some words"'


def test_deep_and_wide_pages(spark):
    """Thousands of elements within each other, and a cell that claims millions of columns."""
    deep = "<div>" * 5000 + "in" + "</div>" * 5000
    lists = "<div class='pagetree'>" + "<ul><li><a href='/x'>x</a>" * 3000
    wide = "<table><tr><td colspan='30000000' rowspan='99999999'>a</td><td>b</td></tr></table>"
    df = spark.createDataFrame([(1, deep), (2, lists), (3, wide)], "page_id int, html string")
    got = {r["page_id"]: r for r in html.pages(df).collect()}
    assert got[1]["text"] == "in" and got[3]["n_tables"] == 1
    assert html.cells(df).count() == 1001 and html.tree(df).count() == 3000 and html.cleaned(df).count() == 3


def test_loaded_files(spark):
    files = [("/a/x.TXT", b"plain \xff"), ("/a/y.json", b'{"content": "inner"}'), ("/a/z.json", b'{"k": [1]}'), ("/a/p.html", b"<title>T</title><p>body</p>"), ("/a/q.exe", b"no"), ("/a/n.md", None)]
    df = spark.createDataFrame(files, "path string, content binary")
    got = {r["path"][3:]: r["text"] for r in C.loaded(df).collect()}
    assert got["y.json"] == "inner" and got["z.json"] == '{"k": [1]}' and got["p.html"] == "T\nbody" and got["n.md"] == "" and got["x.TXT"].startswith("plain ") and "q.exe" not in got
    assert {r["path"]: r["text"] for r in C.loaded(df, pretty=True).collect()}["/a/z.json"] == '{\n  "k": [\n    1\n  ]\n}'
    parts = C.processed(spark.createDataFrame([("/a/x.txt", b"word " * 300), ("/b/x.txt", b"")], df.schema)).orderBy("chunk").collect()
    assert [r["chunk"] for r in parts] == [0, 1, 2, 3] and {r["total_chunks"] for r in parts} == {4} and parts[0]["filename"] == "x.txt" and len(parts[0]["doc_id"]) == 12
    assert C.loaded(df.limit(0)).count() == 0


def test_documents_of_a_collection(spark, tmp_path):
    c = C.Collections(spark, f"file://{tmp_path}/c")
    c.create("kb")
    rows = [(f"d{i // 2}_{i}", "x" * i, [1.0], {"doc_id": f"d{i // 2}", "filename": "f"}) for i in range(4)] + [("free", "y", [1.0], {})]
    c.add("kb", spark.createDataFrame(rows, "id string, text string, embedding array<double>, metadata map<string,string>"))
    assert sorted(map(tuple, c.documents("kb").collect())) == [("d0", "f", 2, 1), ("d1", "f", 2, 5)]
    assert c.delete_document("kb", "d0") and not c.delete_document("kb", "d0") and c.count("kb") == 3
    files, size = c.footprint("kb")
    assert files > 0 and size > 0
    c.clear("kb")
    assert c.count("kb") == 0 and c.metric("kb") == "cosine" and c.names() == ["kb"]
    for n in (1, 2):
        C.append_feedback(spark.createDataFrame([(n, "good")], "rating int, note string"), f"file://{tmp_path}/f")
    assert spark.read.json(f"file://{tmp_path}/f").count() == 2


def test_token_counts_and_cuts(spark):
    texts = ["one two three", "", None, "é ñ 日本", "x" * 3000, "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    v = bpe.vocabulary()
    want = [len(v.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [r["tokens"] for r in bpe.with_tokens(df, "t").orderBy("i").collect()] == want
    cut = [r["cut"] for r in bpe.truncated(df, "t", 2).orderBy("i").collect()]
    assert cut[0] == "one two" and cut[1] == "" and cut[2] is None and texts[4].startswith(cut[4]) and len(cut[4]) < 3000


def test_training_pairs(spark):
    p = spark.range(400).withColumnRenamed("id", "passage")
    q = spark.range(400).selectExpr("id", "0 AS j")
    rows = fusion.training_pairs(q, p, ["id", "j"], "id", "passage", 3).collect()
    per = {}
    for r in rows:
        per.setdefault(r["id"], []).append((r["passage"], r["label"]))
    assert all(len(set(v)) == len(v) and [x for x in v if x[1] == 1] == [(k, 1)] and k not in [x for x, y in v if y == 0] for k, v in per.items())
    assert all(len(v) == 4 for v in per.values())
    few = fusion.training_pairs(q.limit(9), p.limit(9), ["id", "j"], "id", "passage", 20).groupBy("id").count().collect()
    assert {r["count"] for r in few} == {9}  # all others there are
    again = fusion.training_pairs(q.repartition(3), p.repartition(5), ["id", "j"], "id", "passage", 3).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert fusion.training_pairs(q.limit(0), p.limit(0), ["id", "j"], "id", "passage").count() == 0


def test_only_heads_of_long_texts_are_encoded(spark, monkeypatch):
    """Cuts of odd texts equal those of the whole texts' tokens, and a long text is not encoded whole."""
    v, r, seen = bpe.vocabulary(), random.Random(3), []
    texts = ["".join(r.choice(a) for _ in range(r.randrange(600))) for a in ("ab1'. \n\t\r\xa0\u00e9\u3000!?  's\x0b\u200b\ud55c", "ab  '\n.1\u00e9\ud55cs") for _ in range(150)]
    texts += ["x" * 900, " " * 900, "a " * 900, "hello <|endoftext|> " * 90, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(3)
    got = [x["cut"] for x in bpe.truncated(df, "t", 9).orderBy("i").collect()]
    ids = [v.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert got == [t if len(e) <= 9 else v.decode(e[:9], skip_special_tokens=False) for t, e in zip(texts, ids)]

    class Spy:
        def __getattr__(self, name):
            return getattr(v, name)

        def encode(self, t, **kw):
            seen.append(len(t))
            return v.encode(t, **kw)

        def encode_batch(self, some, **kw):
            seen.extend(map(len, some))
            return v.encode_batch(some, **kw)

    class Table:
        columns, schema = ["t"], df.select("t").schema

        def mapInArrow(self, run, _):
            return list(run([pa.RecordBatch.from_arrays([pa.array(["some plain words " * 5000])], names=["t"])]))

    monkeypatch.setattr(bpe, "vocabulary", lambda name: Spy())
    (batch,) = bpe.truncated(Table(), "t", 9)
    assert batch.column(1).to_pylist() == ["some plain words" * 1 + " some plain words" * 2] and max(seen) < 1000


def test_counts_are_sums_over_chunks_met_once(spark, monkeypatch):
    """Counts of odd texts equal those of the whole texts' tokens, in parts and with few chunks kept."""
    v, r = bpe.vocabulary(), random.Random(5)
    texts = ["".join(r.choice(a) for _ in range(r.randrange(300))) for a in ("ab1'. \n\t\r\xa0\u00e9\u3000!?,  's\x0b\u200b\ud55c", "ab  '\n.,1\u00e9\ud55cs") for _ in range(200)]
    texts += ["x" * 900, " " * 900, "a " * 900, "hello <|endoftext|> " * 9, "", ".", "It's, well. (so),  \n\n and... 3.5", " lead", "tail \n", "\nline"]
    want = [len(v.encode(t, add_special_tokens=False).ids) for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").repartition(3)
    assert [x["tokens"] for x in bpe.with_tokens(df, "t").orderBy("i").collect()] == want
    monkeypatch.setattr(bpe, "AT_ONCE", 50)
    monkeypatch.setattr(bpe, "KEPT", 7)
    assert bpe.Counter(v).count(texts) == want


def test_plain_texts_are_not_counted_whole(spark, monkeypatch):
    v, seen = bpe.vocabulary(), []

    class Spy:
        def __getattr__(self, name):
            return getattr(v, name)

        def encode(self, t, **kw):
            seen.append(len(t))
            return v.encode(t, **kw)

        def encode_batch(self, some, **kw):
            seen.extend(map(len, some))
            return v.encode_batch(some, **kw)

    class Table:
        columns, schema = ["t"], spark.createDataFrame([], "t string").schema

        def mapInArrow(self, run, _):
            return list(run([pa.RecordBatch.from_arrays([pa.array(["some plain words " * 5000, None])], names=["t"])]))

    monkeypatch.setattr(bpe, "vocabulary", lambda name: Spy())
    (batch,) = bpe.with_tokens(Table(), "t")
    assert batch.column(1).to_pylist() == [len(v.encode("some plain words " * 5000, add_special_tokens=False).ids), 0] and not seen


def test_chunkers_in_sql_hold_few_texts(spark):
    """A chunker that gives its worker's memory in MB as the place: 180 MB of texts in one task are not held at once."""

    def memory(_):
        import psutil

        mb = psutil.Process().memory_info().rss >> 20
        return [(mb, mb)]

    registered.register_chunker(spark, "loom_memory", memory)
    texts = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("ab "), 20_000).alias("text"))
    n, mb = spark.sql("SELECT count(*), max(c.start) FROM {d} d, LATERAL loom_memory(d.text) c", d=texts).first()
    assert n == 3000 and mb < 200
