"""Many and long queries in bounded memory."""

import pickle
import random

import numpy as np
import pyarrow as pa

from loomtext.operators import lexical


def test_twenty_thousand_long_queries_stay_sparse():
    r = np.random.default_rng(1)
    words = np.array([f"word{i}" for i in range(30_000)])
    lists = [words[r.integers(0, 30_000, 300)].tolist() for _ in range(20_000)]
    asked = lexical._Asked(pa.table({"q": pa.array(range(20_000)), "w": pa.array(lists, pa.list_(pa.string()))}))
    assert len(pickle.dumps(asked, 5)) < 12 * 20_000 * 300 + (2 << 20)  # ten bytes a term of a query, and the terms
    doc, term, n = asked.counts(pa.array([["word1", "word2", "word1", "unheard"], None, []], pa.list_(pa.string())))
    assert doc.tolist() == [0, 0] and sorted(n.tolist()) == [1, 2]
    first, s = next(iter(asked.scores(3, doc, term, n.astype(float))))
    want = [sum(2 * (w == "word1") + (w == "word2") for w in lists[q]) for q in range(lexical.BLOCK)]
    assert first == 0 and s[:, 0].tolist() == want and not s[:, 1:].any()


def test_scans_and_cells_change_nothing(spark, monkeypatch):
    r = random.Random(2)
    text = lambda n: " ".join(f"w{min(int(r.expovariate(0.05)), 80)}" for _ in range(n))
    docs = spark.createDataFrame([(i, text(r.randrange(60))) for i in range(400)] + [(None, text(9)), (401, None)], "doc_id long, text string").repartition(3)
    queries = spark.createDataFrame([(i, text(r.randrange(1, 30))) for i in range(300)] + [(300, None), (301, "unheard")], "query_id long, text string")
    ways = [lexical.tf_idf_way(5), lexical.bm25_way(7)]
    whole = [sorted(map(tuple, x.collect())) for x in lexical.rank(queries, docs, ways)]
    assert whole[0] == sorted(map(tuple, lexical.tf_idf(queries, docs, 5).collect())) and whole[1] == sorted(map(tuple, lexical.bm25(queries, docs, 7).collect()))
    monkeypatch.setattr(lexical, "ASKED_BYTES", 20_000)
    assert [sorted(map(tuple, x.collect())) for x in lexical.rank(queries, docs, ways)] == whole
    none = docs.limit(0)
    assert lexical.bm25(queries, none).count() == 0 and lexical.bm25(none.withColumnRenamed("doc_id", "query_id"), docs).count() == 0


def test_few_cells_at_a_time(monkeypatch):
    r = np.random.default_rng(3)
    lists = [[f"t{x}" for x in r.integers(0, 50, 20)] for _ in range(600)]
    asked = lexical._Asked(pa.table({"q": pa.array(range(600)), "w": pa.array(lists)}))
    doc, term, n = asked.counts(pa.array(lists[:40]))
    whole = [s for _, s in asked.scores(40, doc, term, n.astype(float))]
    monkeypatch.setattr(lexical, "CELLS", 700)
    assert all(np.allclose(a, b) for a, b in zip(whole, (s for _, s in asked.scores(40, doc, term, n.astype(float)))))


def test_methods_share_their_scans(spark, monkeypatch):
    """Vectors of all documents are made once for all methods, later ones of the found documents alone; each method gives what it gives alone."""
    from loomtext.plans import lexical_queries as Q

    sf, made, methods = "/root/testdata/sf0.001", [], ("mmr", "multi_query", "compression", "threshold", "ensemble")
    hashed = Q.lexical.hashed_vectors
    monkeypatch.setattr(Q.lexical, "hashed_vectors", lambda df, *a: made.append(df) or hashed(df, *a))
    whole = sorted((r["method"], r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in Q._all(spark, sf, methods).collect())
    n = Q.docs(spark, sf).count()
    assert sum("doc_id" in df.columns and df.count() == n for df in made) == 1
    alone = [(m, r["query_id"], r["rank"], r["doc_id"], r["score"]) for m in methods[:3] for r in Q.search(spark, sf, m).collect()]
    assert sorted(alone) == [r for r in whole if r[0] in methods[:3]]
