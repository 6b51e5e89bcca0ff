"""Inverted file and product quantisation against plain versions; one-pass operators on pairs."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.operators import vector
from loomtext.operators.vector_index import Books, VectorIndex, centres, unit


@pytest.fixture(scope="module")
def points():
    r = np.random.default_rng(2)
    middle = r.normal(size=(12, 16))
    x = middle[r.integers(0, 12, 600)] + r.normal(0, 0.4, (600, 16))
    x[5] = 0
    x[7] = x[6]
    return np.round(x, 3)


@pytest.fixture(scope="module")
def rows(spark, points):
    made = [(i, [float(v) for v in x], i % 3, "other") for i, x in enumerate(points)] + [(None, [1.0] * 16, 0, "n"), (900, None, 0, "n"), (6, [float(v) for v in points[6]], 0, "again")]
    return spark.createDataFrame(made, "vec_id long, embedding array<double>, label int, cell string").repartition(4)


@pytest.fixture(scope="module")
def asked(rows):
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    out = VectorIndex(spark, f"file://{tmp_path_factory.mktemp('ivf')}/i")
    out.build(rows, cells=24, subspaces=4, file_rows=20)
    return out


def test_all_cells_give_the_exact_search(rows, asked, index):
    exact = sorted(map(tuple, vector.knn(asked, rows, 5).collect()))
    assert sorted(map(tuple, index.search(asked, 5, 24).collect())) == exact
    assert index.rows().count() == 601 and index.rows().select("cell").distinct().count() <= 24


def test_few_cells_reach_the_recall_and_read_less(rows, asked, index):
    probes = index.calibrate(0.95)
    true = {tuple(r) for r in vector.knn(asked, rows, 5).select("query_id", "vec_id").collect()}
    found = {tuple(r) for r in index.search(asked, 5, probes).select("query_id", "vec_id").collect()}
    read = index.probed(asked, probes).agg(F.sum("rows_read"), F.sum("rows")).first()
    assert len(true & found) / len(true) >= 0.9 and read[0] < read[1] / 2 and read[1] == 601 * 30
    one = asked.limit(1)
    cells = index.books().order(np.array(one.first()["embedding"])[None, :])[0, :probes].tolist()
    plan = index._near(one, 5, probes, False, "query_id")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan  # the scan reads the asked cells' folders alone
    assert index.rows().where(F.col("cell").isin(cells)).count() == index.probed(one, probes).first()["rows_read"]


def test_codes_equal_plain_tables(rows, asked, index, points):
    books = index.books()
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in index.search(asked, 700, 24, codes=True).collect()}
    for q in (0, 20, 40):
        for i in (1, 5, 33, 599):
            parts = np.array_split(unit(points[q][None, :])[0], 4), np.array_split(unit(points[i][None, :])[0], 4)
            want = sum(float(a @ b[((b - x) ** 2).sum(axis=1).argmin()]) for a, x, b in zip(*parts, books.books))
            assert abs(got[q, i] - want) < 1.1e-4
    assert index.rows().agg(F.max(F.length("code"))).first()[0] == 4


def test_reranked_codes_find_more(rows, asked, index):
    true = {tuple(r) for r in vector.knn(asked, rows, 5).select("query_id", "vec_id").collect()}
    share = [len(true & {tuple(r) for r in index.search(asked, 5, 24, codes=True, rerank=n).select("query_id", "vec_id").collect()}) / len(true) for n in (0, 12)]
    assert share[1] >= max(share[0], 0.95)


def test_indexes_of_few_rows(spark, rows, tmp_path):
    none = rows.limit(0)
    index = VectorIndex(spark, f"file://{tmp_path}/none")
    index.build(none)
    q = rows.limit(3).select(F.col("vec_id").alias("query_id"), "embedding")
    assert index.search(none.select(F.col("vec_id").alias("query_id"), "embedding"), 3, 1).count() == 0
    few = VectorIndex(spark, f"file://{tmp_path}/few")
    few.build(rows.where("vec_id < 3"), cells=10)
    assert few.search(q, 5, 10).where("rank > 3").count() == 0 and few.calibrate() >= 1


def test_centres_fall_and_fill():
    r = np.random.default_rng(1)
    x = r.normal(size=(300, 3))
    c = centres(x, 20, False)
    near = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert len(np.unique(near.argmin(axis=1))) == 20
    assert near.min(axis=1).sum() < ((x[:, None] - x[:20][None]) ** 2).sum(axis=2).min(axis=1).sum()
    assert np.allclose(Books.fit(x, 5, 3).codes(x[:4]), Books.fit(x, 5, 3).codes(2 * x[:4]))


def test_operators_on_all_pairs(rows, asked, points):
    own = [*enumerate(points), (6, points[6])]
    got = {(r["query_id"], r["vec_id"]): r for r in vector.pairs(asked, rows, ("l2", "l1", "cosine", "ip")).collect()}
    assert len(got) == 30 * 600
    cosine = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) if a.any() and b.any() else 0.0
    for q, i in random.Random(1).sample(sorted(got), 200):
        a, b = points[q], points[i]
        want = [np.linalg.norm(a - b), np.abs(a - b).sum(), cosine(a, b), a @ b]
        assert np.allclose([got[q, i][m] for m in ("l2", "l1", "cosine", "ip")], want, atol=6e-5)
    for r in vector.extremes(asked, rows).collect():
        s = sorted((round(cosine(points[r["query_id"]], x), 4), i) for i, x in own if i != r["query_id"])
        assert abs(r["most"] - s[-1][0]) < 1.1e-4 and abs(r["least"] - s[0][0]) < 1.1e-4
        assert abs(cosine(points[r["query_id"]], points[r["most_similar"]]) - s[-1][0]) < 1.1e-4
    counts = {(r["query_id"], r["step"]): r["n"] for r in vector.score_counts(asked, rows, [0.8, 0.4, 0.0]).collect()}
    for q in (0, 20):
        s = [round(cosine(points[q], x), 4) for _, x in own]
        assert counts.get((q, 0), 0) == sum(x >= 0.8 for x in s) and sum(counts.get((q, i), 0) for i in range(4)) == 601


def test_only_the_asked_groups_are_ranked(rows, asked):
    q = asked.withColumn("wants", F.when(F.col("query_id") % 40 == 0, F.array(F.lit(0), F.lit(2))))
    got = vector.knn(q, rows, 3, per="label", asks="wants")
    every = vector.knn(asked, rows, 3, per="label")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.where("query_id % 40 = 0 AND label <> 1").collect()))


def test_components_equal_numpy(rows, points):
    got = {r["vec_id"]: (r["pc1"], r["pc2"]) for r in vector.pca(rows.where("cell <> 'again' AND vec_id IS NOT NULL")).collect()}
    x = points - points.mean(axis=0)
    axes = np.linalg.svd(x, full_matrices=False)[2][:2].T
    axes = axes * np.where(axes[np.abs(axes).argmax(0), np.arange(2)] < 0, -1, 1)
    assert got[900] == (None, None)
    assert np.allclose([got[i] for i in range(600)], x @ axes, atol=1e-8)


def test_pairs_of_a_bucket_search_are_gathered_in_pieces():
    r = np.random.default_rng(3)
    q, x = r.normal(size=(512, 64)), r.normal(size=(1024, 64))
    i, j = np.nonzero(np.ones((512, 1024), bool))
    tracemalloc.start()
    got = vector.pair_products(q, x, i, j)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6
    assert (got[:3000] == np.einsum("ij,ij->i", q[i[:3000]], x[j[:3000]])).all() and len(got) == len(i)


def test_distances_hold_small_tiles(monkeypatch):
    """Sums of differences are made dimension by dimension: no more memory than a few results, whatever the number of dimensions."""
    import tracemalloc

    import numpy as np

    from loomtext.operators import vector

    r = np.random.default_rng(2)
    q, x = r.normal(size=(100, 64)), r.normal(size=(1100, 64))
    tracemalloc.start()
    got = vector.scores(q, x, "l1")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(got, [[-np.abs(a - b).sum() for b in x] for a in q]) and peak < 4 << 20
    assert np.allclose(vector.scores(q, x, "distance"), 1 - vector.scores(q, x, "cosine"))
