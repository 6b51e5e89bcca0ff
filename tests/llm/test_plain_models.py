"""Models against plain versions of themselves: the chain's logistic regressions, the network's convolutions and gradients; stored tensors."""

import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from loomtext.llm import audio, language_id, toxicity


def test_line_of_stored_tensors_equals_that_of_the_frames():
    r = np.random.default_rng(8)
    for n in (576, 576 * 40, 576 * 500):
        x = (128 + 100 * np.sin(np.arange(n) / 7) * (np.arange(n) // 3000 % 2)).astype(np.uint8) ^ r.integers(0, 2, n).astype(np.uint8)
        mel = audio.log_mel(x)
        stream, spans = audio.features(x.tobytes())
        assert np.array_equal(audio.frames_of(stream).astype(np.int16), mel)
        own = audio.segments(mel)
        got = dict(p.split("=") for p in audio.line(stream, spans).split(";"))
        assert int(got["frames"]) == len(mel) and int(got["segments"]) == len(own) and int(got["sound"]) == int((own[:, 1] - own[:, 0]).sum())


# the chain


def plain_fit(x, earlier, y, l1, steps):
    """Proximal gradient steps, without acceleration, over all features: rows of 0 and 1, and the earlier probabilities."""
    n1, n = sum(y), len(y)
    weight = [0.5 / n1 if v else 0.5 / (n - n1) for v in y]
    scale = [1 / math.sqrt(max(sum(w for w, row in zip(weight, x) if row[j]), 1e-9)) for j in range(len(x[0]))]
    m = np.array([[v * s for v, s in zip(row, scale)] + list(e) + [1.0] for row, e in zip(x, earlier)])
    w = np.zeros(m.shape[1])
    step = 4 / np.linalg.eigvalsh((m * np.array(weight)[:, None]).T @ m)[-1]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(m @ w)))
        w = w - step * (m.T @ (np.array(weight) * (p - np.array(y))))
        for j in range(len(scale)):
            w[j] = math.copysign(max(abs(w[j]) - step * l1, 0), w[j])
    return w, scale


def chain_data(n=160, features=12, seed=1):
    r = np.random.default_rng(seed)
    x = (r.random((n, features)) < 0.3).astype(int)
    low = ((x[:, 0] + x[:, 1] + (r.random(n) < 0.1)) > 0).astype(int)
    toxic = (((x[:, 2] == 1) & (low == 1)) | (r.random(n) < 0.05)).astype(int)
    row, f = np.nonzero(x)
    return x, row, f * 17, np.column_stack([low, toxic])


def test_one_model_equals_plain_proximal_steps():
    x, row, f, labels = chain_data()
    got = toxicity.fit(row, f, len(x), np.zeros((len(x), 0)), labels[:, 0].astype(float), l1=2e-3, steps=3000, least_z=0.0)
    w, scale = plain_fit(x.tolist(), [()] * len(x), labels[:, 0].tolist(), 2e-3, 20_000)
    want = {17 * j: w[j] * scale[j] for j in range(x.shape[1]) if abs(w[j]) > 1e-9}
    assert set(got.places.tolist()) == set(want) and np.allclose([want[p] for p in got.places.tolist()], got.weights, atol=1e-3) and abs(got.bias - w[-1]) < 1e-3


def test_chain_equals_plain_chain():
    x, row, f, labels = chain_data(n=240, seed=2)
    fold = np.arange(len(x)) % 3
    chain = toxicity.Chain.train(["low", "toxic"], row, f, labels, fold)
    part = lambda rows: (np.searchsorted(rows, row[np.isin(row, rows)]), f[np.isin(row, rows)])
    none = np.zeros((len(x), 0))
    out = np.zeros(len(x))  # each row's first probability by a model that has not seen its fold
    for k in range(3):
        rest = np.flatnonzero(fold != k)
        m = toxicity.fit(*part(rest), len(rest), none[rest], labels[rest, 0].astype(float))
        weights = dict(zip(m.places.tolist(), m.weights.tolist()))
        for i in np.flatnonzero(fold == k):
            out[i] = 1 / (1 + math.exp(-(m.bias + sum(weights.get(17 * j, 0.0) for j in np.flatnonzero(x[i])))))
    last = toxicity.fit(row, f, len(x), out[:, None], labels[:, 1].astype(float))
    assert np.allclose(last.weights, chain.models[1].weights) and np.allclose(last.chain, chain.models[1].chain) and chain.models[1].chain[0] > 0


def test_probabilities_of_texts_follow_the_chain():
    r = random.Random(3)
    good, bad = [f"word{i}" for i in range(30)], ["vile", "nasty", "awful", "spam"]
    texts, labels = [], []
    for i in range(300):
        low, toxic = i % 2, i % 2 and i % 4 == 1
        texts.append(" ".join(r.sample(good, 8) + (["spam"] if low else []) + (r.sample(bad[:3], 2) if toxic else [])))
        labels.append([low, int(bool(toxic))])
    row, f = toxicity.features(pa.array(texts))
    chain = toxicity.Chain.train(["low", "toxic"], row, f, np.array(labels), np.arange(300) % 3)
    got = chain.predict(pa.array([*texts[:12], None, ""]))
    for i, t in enumerate([*texts[:12], "", ""]):
        _, own = toxicity.features(pa.array([t]))
        p = []
        for m in chain.models:
            weights = dict(zip(m.places.tolist(), m.weights.tolist()))
            z = m.bias + sum(c * v for c, v in zip(m.chain.tolist(), p)) + sum(weights.get(x, 0.0) for x in own.tolist())
            p.append(1 / (1 + math.exp(-z)))
        assert np.allclose(got[i], p, atol=1e-9)
    assert ((got[:12] > 0.5) == np.array(labels[:12]).astype(bool)).all()


# the network


@pytest.fixture(scope="module")
def net():
    return language_id.Network(["de", "en", "fr"])


def plain_forward(net, window):
    pooled = []
    for w, tables in zip(language_id.WIDTHS, net.tables):
        for f in range(language_id.FILTERS):
            pooled.append(max(sum(float(tables[k][window[i + k], f]) for k in range(w)) for i in range(len(window) - w + 1)))
    h = [max(z + float(s), 0.0) for z, s in zip(pooled, net.shift)]
    z = [sum(a * float(b) for a, b in zip(h, net.dense[:, j])) + float(net.bias[j]) for j in range(len(net.languages))]
    e = [math.exp(v - max(z)) for v in z]
    return [v / sum(e) for v in e]


def test_prediction_equals_a_plain_convolution(net):
    texts = ["The river and the stone.", "Über die Straße, große Häuser", "x" * 400, "éàü" * 50, ""]
    for t in texts:
        for window in language_id.windows_of(t.encode()):
            assert np.allclose(net.predict(window[None, :], net.pair_tables())[0], plain_forward(net, window.tolist()), atol=1e-5)


def test_gradient_equals_finite_differences():
    net = language_id.Network(["a", "b"], seed=2)
    for i, t in enumerate(net.tables):
        net.tables[i] = [x.astype(np.float64) for x in t]
    net.dense, net.bias, net.shift = net.dense.astype(np.float64), net.bias.astype(np.float64), net.shift.astype(np.float64) + 0.05
    r = np.random.default_rng(1)
    x, y = r.integers(1, 27, (6, language_id.WINDOW)), r.integers(0, 2, 6)
    flat = [t for w in net.tables for t in w] + [net.dense, net.bias, net.shift]
    got = net._gradient(x, y)

    def loss():
        return -np.mean([math.log(plain_forward(net, row.tolist())[k]) for row, k in zip(x, y)])

    for t, g in zip(flat, got):
        assert t.shape == g.shape
        on = np.flatnonzero(np.abs(g.ravel()) > 1e-4)
        for i in (r.choice(on, min(2, len(on)), replace=False) if len(on) else []):
            was = t.flat[i]
            t.flat[i] = was + 1e-5
            up = loss()
            t.flat[i] = was - 1e-5
            down = loss()
            t.flat[i] = was
            assert abs((up - down) / 2e-5 - g.flat[i]) < 1e-4


def test_training_holds_its_sample_once():
    """What is worked out over the whole sample comes in pieces, so the driver needs little beside the sample itself."""
    rng = np.random.default_rng(5)
    n, each = 3000, 1000
    row = np.repeat(np.arange(n, dtype=np.int32), each)
    f = rng.integers(1000, 1 << toxicity.BITS, n * each).astype(np.int32)
    y = (np.arange(n) % 3 == 0).astype(float)
    f[::each] = np.where(y > 0, 7, 8)
    tracemalloc.start()
    model = toxicity.fit(row, f, n, np.zeros((n, 0)), y, steps=20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {7, 8} & set(model.places.tolist()) and ((model.logits(row, f, n, np.zeros((n, 0))) > 0) == (y > 0)).all()
    assert peak < 70e6
