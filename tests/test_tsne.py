"""The map keeps neighbours: trustworthiness against exact neighbours."""

import numpy as np

from loomtext.operators import tsne


def trustworthiness(x, y, k):
    n = len(x)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    e = ((y[:, None] - y[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    np.fill_diagonal(e, np.inf)
    rank = np.argsort(np.argsort(d, axis=1), axis=1) + 1
    near = np.argsort(e, axis=1)[:, :k]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * np.maximum(np.take_along_axis(rank, near, 1) - k, 0).sum()


def test_map_of_clusters(spark):
    r = np.random.default_rng(1)
    middle = r.normal(0, 4, (8, 20))
    x = middle[np.arange(900) % 8] + r.normal(0, 1, (900, 20))
    x[10] = x[2]
    rows = [(i, [float(v) for v in p], "other") for i, p in enumerate(x)] + [(900, None, "null")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, note string").repartition(3)
    got = {m["vec_id"]: (m["x"], m["y"]) for m in tsne.tsne(df, landmarks=250).collect()}
    assert got[900] == (None, None) and got[10] == got[2] and len(got) == 901
    y = np.array([got[i] for i in range(900)])
    placed = trustworthiness(x, y, 10)
    plain = trustworthiness(x, (x - x.mean(axis=0)) @ np.linalg.svd(x - x.mean(axis=0))[2][:2].T, 10)
    assert placed > 0.9 and placed > plain  # most rows were no landmarks; two components keep fewer neighbours
    home = np.array([y[np.arange(900) % 8 == c].mean(axis=0) for c in range(8)])
    assert (((y[:, None] - home[None]) ** 2).sum(axis=2).argmin(axis=1) == np.arange(900) % 8).mean() > 0.95


def test_few_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.5]), (3, None)], "vec_id long, embedding array<double>")
    assert tsne.tsne(df).where("x IS NOT NULL").count() == 2 and tsne.tsne(df.limit(0)).count() == 0 and tsne.tsne(df.where("vec_id = 3")).count() == 1


def test_affinities_have_the_perplexity():
    d = np.random.default_rng(2).random((20, 50)) * 9
    d[:, 7] = np.inf
    p = tsne.affinities(d, 8)
    assert np.allclose(np.exp(-(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)), 8, rtol=1e-3) and not p[:, 7].any()
