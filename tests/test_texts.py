"""Summaries against a plain walk, learnt vectors against numpy's decomposition."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.operators import learnt_vectors, summary
from loomtext.operators.learnt_vectors import TextVectors

WORDS = "river stone light cloud winter paper engine garden silver window market bridge forest candle".split()


def prose(r, n, of=WORDS):
    out = []
    for _ in range(n):
        out.append(" ".join(r.choice(of) for _ in range(r.randrange(2, 9))) + r.choice([". ", "! ", "?\n", ".\n\n", " \n"]))
    return "".join(out)


def plain_summary(text, share=0.2):
    if text is None:
        return None
    own = [s for s in (re.sub(r"^[ \t\r]+|[ \t\r]+$", "", x) for x in re.sub(r"([.!?])[ \t\n\r]+", "\\1\n", text).split("\n")) if s]
    words = [set(re.findall("[가-힣a-zA-Z0-9]+", s.lower())) for s in own]
    n = len(own)
    r = [1 / max(n, 1)] * n
    for _ in range(20):
        new = [0.15 / max(n, 1)] * n
        for i in range(n):
            for w in words[i]:  # to each sentence that has the word
                others = [j for j in range(n) if w in words[j]]
                for j in others:
                    new[j] += 0.85 * r[i] / len(words[i]) / len(others)
        r = new
    room, used, taken = max(1, int(len(text) * share + 1e-9)), 0, []
    order = sorted(range(n), key=lambda j: (-round(r[j], 9), j))
    for j in order:
        used += len(own[j])
        if used > room:
            break
        taken.append(j)
    return " ".join(own[j] for j in sorted(taken)) if taken or not own else own[order[0]][:room]


def test_summaries_equal_a_plain_walk(spark):
    r = random.Random(2)
    texts = [prose(r, n) for n in (1, 2, 5, 9, 14, 20, 33) for _ in range(4)] + [None, "", " \n ", "...", "one sentence alone", "a. b. c. d.", "same words. same words. same words."]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id int, text string, summary2 string").repartition(3)
    for share in (0.2, 0.6):
        got = summary.summarize(df, "text", share, at_once=5)
        assert got.columns == ["id", "text", "summary2", "summary"]
        assert {x["id"]: x["summary"] for x in got.collect()} == {i: plain_summary(t, share) for i, t in enumerate(texts)}
    assert summary.summarize(df.limit(0), "text").count() == 0


def test_a_very_long_text_takes_linear_time(spark):
    r = random.Random(3)
    df = spark.createDataFrame([(1, prose(r, 30_000))], "id int, text string")  # every pair of sentences would be 900 million
    got = summary.summarize(df, "text", 0.01).first()
    assert 0 < len(got["summary"]) <= len(got["text"]) * 0.01 * 1.1


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(4)
    topics = [[f"t{k}w{i}" for i in range(25)] for k in range(6)]
    rows = [(i, " ".join(r.choice(topics[i % 6]) if r.random() < 0.8 else r.choice(WORDS) for _ in range(r.randrange(5, 60)))) for i in range(300)]
    return spark.createDataFrame([*rows, (300, None), (301, ""), (5, "one key twice t1w1")], "id long, text string").repartition(5)


def plain_matrix(df, cells, idf):
    rows = {}
    for r in learnt_vectors.counted(df, "id", "text", cells).collect():
        x = np.zeros(cells)
        x[r["at"]] = (1 + np.log(np.array(r["tf"], float))) * idf[r["at"]] if r["at"] else 0
        rows.setdefault(r["key"], []).append(x / max(np.linalg.norm(x), 1e-300))
    return rows


@pytest.mark.parametrize("group", [64, 2])
def test_singular_values_equal_numpy(texts, monkeypatch, group):
    monkeypatch.setattr(learnt_vectors, "GROUP", group)
    monkeypatch.setattr(learnt_vectors, "BLOCK", 17)
    learnt = TextVectors.fit(texts, "id", "text", dim=12, cells=256, rounds=8)
    rows = plain_matrix(texts, 256, learnt.idf)
    whole = np.array([x for v in rows.values() for x in v])
    _, values, right = np.linalg.svd(whole, full_matrices=False)
    # six topics stand out; what follows is nearly flat, where directions are found less sharply
    assert np.allclose(learnt.values[:6], values[:6], rtol=1e-9) and np.allclose(learnt.values, values[:12], rtol=5e-3)
    assert np.allclose(np.abs((learnt.directions[:, :4] * right[:4].T).sum(axis=0)), 1, atol=1e-3)
    got = {}
    for r in learnt.vectors(texts, "id", "text").collect():
        got.setdefault(r["id"], []).append(r["embedding"])
    for k, own in rows.items():
        want = sorted((v / max(np.linalg.norm(v), 1e-300)).tolist() for v in (x @ learnt.directions for x in own))
        assert np.allclose(sorted(got[k]), want, atol=1e-9)
    assert not any(got[300][0]) and not any(got[301][0])


def test_vectors_tell_topics_apart_and_take_new_texts(spark, texts):
    learnt = TextVectors.fit(texts, "id", "text", dim=8, cells=1024)
    new = spark.createDataFrame([(0, "t3w1 t3w2 t3w3"), (1, "never heard")], "q long, text string")
    q = {r["q"]: np.array(r["embedding"]) for r in learnt.vectors(new, "q", "text").collect()}
    v = {r["id"]: np.array(r["embedding"]) for r in learnt.vectors(texts.where("id BETWEEN 6 AND 299"), "id", "text").collect()}
    near = sorted(v, key=lambda i: -q[0] @ v[i])[:20]
    assert all(i % 6 == 3 for i in near)
    none = TextVectors.fit(texts.limit(0), "id", "text", dim=4, cells=64)
    assert not any(none.values) and none.vectors(texts, "id", "text").where(F.exists("embedding", lambda x: x != 0)).count() == 0


def test_learnt_texts_are_placed_without_reading_them_again(spark, texts, monkeypatch):
    """Vectors from the stored cells equal those from the texts; a block of rows is a dense matrix of 256 at most."""
    assert learnt_vectors.BLOCK <= 256
    monkeypatch.setattr(learnt_vectors, "BLOCK", 13)
    learnt = TextVectors.fit(texts, "id", "text", dim=8, cells=256)
    got = [sorted(((r["id"], r["embedding"]) for r in df.collect()), key=repr) for df in (learnt.fitted("id"), learnt.vectors(texts, "id", "text"))]
    assert [k for k, _ in got[0]] == [k for k, _ in got[1]] and np.allclose([v for _, v in got[0]], [v for _, v in got[1]])


@pytest.mark.parametrize("asked", [2048, 1])
def test_holding_loses_no_text_that_holds_a_query(spark, monkeypatch, asked):
    monkeypatch.setattr(learnt_vectors, "ASKED", asked)
    d = [(1, "the red fox ran"), (2, "red fox"), (3, "fox red red"), (4, None), (5, "a red red fox sat"), (6, ""), (None, "red red fox")]
    q = [(0, "Red fox"), (1, "red red fox"), (2, None), (3, "never"), (4, "...")]
    learnt = TextVectors.fit(spark.createDataFrame(d, "id long, text string").repartition(3), "id", "text", dim=4, cells=4096)
    got = sorted(tuple(r) for r in learnt.holding(spark.createDataFrame(q, "q long, text string"), "q", "text").collect())
    assert got == [(0, 1), (0, 2), (0, 3), (0, 5), (1, 3), (1, 5)]
