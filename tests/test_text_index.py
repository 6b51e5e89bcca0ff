"""The stored index against BM25 over the documents as they are, through changes and merges."""

import random
import re

import pytest

from loomtext.operators import lexical, text_index
from loomtext.operators.text_index import TextIndex

SCHEMA = "doc_id long, text string, note string"
WORDS = "the of and to river stone light cloud winter paper engine garden silver window market bridge forest candle".split()


def prose(r, n):
    return " ".join(r.choice(WORDS[: r.choice([4, 10, 18])]) + (str(r.randrange(9)) if r.random() < 0.3 else "") for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = [(i, prose(r, r.choice([3, 10, 30, 120])), "n") for i in range(180)]
    out[7], out[8], out[9] = (7, None, "n"), (8, "", "n"), (9, "river " * 3000, "n")
    return [*out, out[20], (20, "another river of one key", "n"), (None, "river stone of no key", "n")]


@pytest.fixture(scope="module")
def asked(spark):
    r = random.Random(6)
    texts = [prose(r, n) for n in (1, 2, 4, 8, 16)] + ["unheard words", None, "", "river river stone", "Winter RIVER7"]
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def same(index, asked, live, k):
    got = sorted(map(tuple, index.search(asked, k).collect()))
    assert got == sorted(map(tuple, lexical.bm25(asked, live, k).collect())) and got
    return got


def test_search_equals_bm25_through_changes(spark, rows, asked, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index = TextIndex(spark, f"file://{tmp_path}/index", span=4)
    assert index.search(asked).count() == 0 and index.statistics() == (0, 0)
    index.add(docs.where("doc_id % 2 = 0"))
    index.add(docs.where("doc_id % 2 = 1 OR doc_id IS NULL"))
    for k in (1, 5, 500):
        same(index, asked, docs, k)
    new = docs.where("doc_id % 10 = 3 OR doc_id = 20").selectExpr("doc_id", "concat('silver ', coalesce(text, '')) AS text", "note")
    index.update(new)
    live = docs.where("doc_id IS NULL OR NOT (doc_id % 10 = 3 OR doc_id = 20)").unionByName(new)
    same(index, asked, live, 5)
    index.update(new.withColumn("text", new["note"]))  # a document that was replaced can be replaced again
    live = live.where("doc_id IS NULL OR NOT (doc_id % 10 = 3 OR doc_id = 20)").unionByName(new.withColumn("text", new["note"]))
    index.delete(docs.where("doc_id % 10 = 4").select("doc_id"))
    live = live.where("doc_id IS NULL OR doc_id % 10 <> 4")
    before = same(index, asked, live, 5)
    assert index.statistics()[0] == live.count()
    known = index.documents()
    assert sorted(((r["key"], r["words"], r["terms"]) for r in known.collect()), key=repr) == sorted(((r["doc_id"], len(w := re.findall("[a-z0-9]+", (r["text"] or "").lower())), len(set(w))) for r in live.collect()), key=repr)
    index.merge()
    assert same(index, asked, live, 5) == before and len(index._state()["segments"]) == 1 and not index._state()["gone"]
    again = TextIndex(spark, f"file://{tmp_path}/index", span=4)  # opened anew
    assert sorted(map(tuple, again.search(asked, 5).collect())) == before


def test_blocks_are_left_unread(spark, asked, tmp_path):
    r = random.Random(8)
    docs = spark.createDataFrame([(i, prose(r, r.choice([5, 40])) + (" candle17 lamp" if i % 40 == 0 else "")) for i in range(1500)], "doc_id long, text string")
    index = TextIndex(spark, f"file://{tmp_path}/index", span=4)
    index.add(docs)
    q = spark.createDataFrame([(0, "lamp of the river"), (1, "the and")], "query_id long, text string")
    same(index, q, docs, 3)
    read = {r["query_id"]: (r["blocks"], r["blocks_read"]) for r in index.blocks_read(q, 3).collect()}
    assert read[0][1] < read[0][0] / 2 and read[1][1] < read[1][0]


def test_bounds_are_what_blocks_can_add(spark, rows, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/index", span=8)
    index.add(spark.createDataFrame(rows, SCHEMA))
    for b in index._read(index._state(), "postings", text_index.POSTING).collect():
        pairs, top = set(zip(b["tfs"], b["lens"])), list(zip(b["top_tfs"], b["top_lens"]))
        assert b["n"] == len(b["slots"]) and b["slots"] == sorted(set(b["slots"]))
        assert sorted(top) == sorted(p for p in pairs if not any(q != p and q[0] >= p[0] and q[1] <= p[1] for q in pairs))


def test_many_terms_and_two_writers(spark, rows, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "PUSHED", 3)
    monkeypatch.setattr(text_index, "RANGE_WORDS", 200)
    docs = spark.createDataFrame(rows, SCHEMA)
    index = TextIndex(spark, f"file://{tmp_path}/index", span=50)
    index.add(docs)
    same(index, asked, docs, 4)
    old = index._state()
    index.delete(docs.where("doc_id = 1"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        index._commit(old, [], [])
    assert index.statistics()[0] == docs.count() - 1


def test_blocks_are_made_once_and_only_asked_terms_leave_the_scan(spark, rows, tmp_path, monkeypatch):
    """Sampled bounds made all blocks of a segment twice, and each pass of a search sent every term's postings to Python."""
    made, seen = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)
    blocks, coded = text_index._blocks, text_index._coded

    def counting(count, run):
        def each(batches):
            for batch in batches:
                count.add(batch.num_rows)
                yield batch

        return lambda batches: run(each(batches))

    monkeypatch.setattr(text_index, "_blocks", counting(made, blocks))
    monkeypatch.setattr(text_index, "_coded", lambda sent: counting(seen, coded(sent)))
    index = TextIndex(spark, f"file://{tmp_path}/index", span=4)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index.add(docs)
    assert made.value == index._ranges(index._state()).count()
    q = spark.createDataFrame([(i, w) for i, w in enumerate(["candle7", "lamp", "market3"])], "query_id long, text string")
    monkeypatch.setattr(text_index, "PUSHED", 1)
    same(index, q, docs, 4)
    own = index._read(index._state(), "postings", text_index.POSTING).where("term IN ('candle7', 'lamp', 'market3')").count()
    assert 0 < seen.value <= 3 * own
