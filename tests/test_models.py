"""The exact stratified split and the scorer of pairs."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.operators import fusion, pair_model, sampling
from loomtext.operators.pair_model import PairModel


def plain_split(rows, share):
    out, strata = {}, {}
    for k, s in {(k, s) for k, s, _ in rows if k is not None}:
        strata.setdefault(s, []).append((int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16), k))
    for s, keys in strata.items():
        for i, (_, k) in enumerate(sorted(keys)):
            out[k, s] = "test" if i < int(len(keys) * share + 0.5) else "train"
    return sorted(((k, s, x, out.get((k, s), "train")) for k, s, x in rows), key=repr)


@pytest.mark.parametrize("bits", [15, 2])
def test_split_takes_exact_shares(spark, monkeypatch, bits):
    """Few bits a level leave many keys in the last cell, as equal hashes would."""
    r = random.Random(4)
    rows = [(i, r.choice(["a"] * 9 + ["b", None]), r.randrange(5)) for i in range(700)] + [(5000 + i, "c", 0) for i in range(4)] + [(None, "a", 1), (None, None, 2)]
    rows += rows[10:30]
    df = spark.createDataFrame(rows, "id long, label string, h int").repartition(3)
    if bits == 2:
        monkeypatch.setattr(sampling, "hash60", lambda c: F.lit(7).cast("long"))  # all hashes the same
        got = sampling.stratified_split(df, "id", "label", 0.3)
        n = {tuple(x)[:2]: x["n"] for x in got.where("id IS NOT NULL").select("label", "split", "id").distinct().groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
        all_keys = Counter(s for _, s in {(k, s) for k, s, _ in rows if k is not None})
        assert all(n[s, "test"] == int(c * 0.3 + 0.5) for s, c in all_keys.items())
        return
    for share in (0.1, 0.5, 0.0, 1.0):
        got = sampling.stratified_split(df, "id", "label", share)
        assert got.columns == ["id", "label", "h", "split"]
        assert sorted(map(tuple, got.collect()), key=repr) == plain_split(rows, share)
    assert sampling.stratified_split(df.limit(0), "id", "label").count() == 0


@pytest.fixture(scope="module")
def pairs(spark):
    """A passage belongs to a question whose rare words it has; others share more of its common words."""
    r = random.Random(5)
    common = "the of and to in is was for on with as by at from".split()
    rows = []
    for i in range(240):
        rare = [f"term{r.randrange(400)}" for _ in range(3)]
        question = " ".join(r.sample(common, 6) + rare)
        rows.append((i, 0, question, " ".join(rare + [f"filler{r.randrange(99)}" for _ in range(30)]), 1))
        rows += [(i, j, question, " ".join(r.sample(common, 9) + [f"term{r.randrange(400)}" for _ in range(3)]), 0) for j in (1, 2, 3)]
    return spark.createDataFrame([*rows, (900, 0, None, None, None)], "q int, p int, question string, passage string, label int").repartition(4)


def test_trained_scorer_beats_overlap_on_held_out_pairs(pairs):
    model = PairModel.train(pairs.where("q < 160"), "question", "passage")
    held = pairs.where("q BETWEEN 160 AND 899")
    by_model = model.score(held, "question", "passage", ["q", "p", "label"]).toPandas()
    by_words = held.select("q", "p", "label", fusion.jaccard(F.col("question"), F.col("passage")).alias("score")).toPandas()
    first = [f.sort_values(["score", "p"], ascending=[False, True]).groupby("q").first()["label"].mean() for f in (by_model, by_words)]
    chosen = by_model[by_model["score"] >= 0.5]
    assert first[0] > 0.95 > 0.5 > first[1] and chosen["label"].mean() > 0.95 and len(chosen) >= 0.9 * by_model["label"].sum()
    assert model.score(pairs.where("q = 900"), "question", "passage", ["q"]).count() == 1 and model.score(pairs.limit(0), "question", "passage", ["q"]).count() == 0


def test_gradient_equals_differences(pairs):
    rows = pair_model.features(pairs.where("q < 20"), "question", "passage", "label", []).cache()
    r = np.random.default_rng(0)
    w = r.normal(0, 0.5, pair_model.FEATURES)
    share = {True: 0.5 / 20, False: 0.5 / 60}
    g = pair_model.gradient(rows, w, share)
    made = [(x["label"] > 0.5, np.bincount(x["at"], x["x"], pair_model.FEATURES)) for x in rows.collect()]

    def loss(w):
        return sum(share[y] * (np.logaddexp(0, w @ x) - y * (w @ x)) for y, x in made)

    assert all((x * x).sum() <= pair_model.PLAIN + 1 for _, x in made)
    for i in [*range(pair_model.PLAIN), *np.flatnonzero(g)[-5:]]:
        d = np.zeros(len(w))
        d[i] = 1e-5
        assert abs((loss(w + d) - loss(w - d)) / 2e-5 - g[i]) < 1e-6


def test_one_label_alone(pairs):
    all_wrong = PairModel.train(pairs.where("label = 0"), "question", "passage")
    assert all_wrong.score(pairs.where("q = 1"), "question", "passage", ["q"]).agg(F.max("score")).first()[0] < 0.01
