"""Filter audit, personal data and importance resampling against plain versions, on small tables with nulls, ties, repeats and long texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from loomtext.llm import filter_audit, importance, personal_data, sharding

SCHEMA = "doc_id long, text string, lang string, id long, part string, mask string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(r, n):
    return " ".join(r.choice("the of and river stone light Cloud WINTER paper engine garden silver été straße".split()) + str(r.randrange(30)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    shared = prose(r, 230)
    texts = [None, "", " \t\n", "one two", "ONE TWO # three", shared, shared, shared, prose(r, 9000), "a " * 250, "x" * 3000, "\x00 \x0b é|ü", "12.34 " * 40]
    texts += [prose(r, r.randrange(5, 400)) + r.choice(["", "", " 50%", " LOUD" * 60]) for _ in range(60)]
    out = [(i * 5 % 97, t, [None, "", "en", "de"][i % 4], i, "p", "m") for i, t in enumerate(texts)]
    return [*out, out[5], (None, shared, "en", 1, None, None), (None, shared, "fr", 1, None, None), (out[20][0], "another text of one identifier", "en", 2, "q", "z")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def labels(spark):
    r = random.Random(2)
    made = [(i, r.randrange(2), r.randrange(2), "x") for i in range(0, 97, 2)] + [(10, 1, 0, "y"), (10, 0, 1, "y"), (None, 1, 1, "n"), (12, None, 1, "n")]
    return spark.createDataFrame(made, "doc_id long, quality int, toxic int, lang string"), made


def fails(rows):
    first = {}
    for d, t, *_ in rows:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    for d, t, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        yield {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": d is not None and t in first and first[t] < d,
        }


def plain_audit(rows, labels):
    good = {d for d, q, _, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t, _ in labels if t == 1 and d is not None}
    failing, out = list(fails(rows)), {}
    parts = [x[2] or "" for x in rows]
    for part in set(parts):
        share = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = [i for i, p in enumerate(parts) if p == part]
            gone: list[int] = []
            for step, f in enumerate(order, 1):
                removed = [i for i in left if failing[i][f]]
                redundant = sum(failing[i][f] for i in gone)
                gone += removed
                left = [i for i in left if not failing[i][f]]
                share[f] += len(removed)
                only = sum(failing[i][f] and sum(failing[i].values()) == 1 for i in range(len(rows)) if parts[i] == part)
                out[part, order, step] = [len(left), len(removed), redundant, only, sum(rows[i][0] in good for i in removed), sum(rows[i][0] in toxic for i in removed)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(share[order[step - 1]])
    return out


def test_filter_audit(spark, docs, rows, labels):
    table, made = labels
    got = filter_audit.filter_audit(docs, table)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    found = {tuple(r)[:3]: list(tuple(r)[3:]) for r in got.collect()}
    assert found == plain_audit(rows, made) and len(found) == 4 * 600
    empty = spark.createDataFrame([], SCHEMA)
    assert filter_audit.filter_audit(empty, table).count() == 0
    unlabelled = filter_audit.filter_audit(docs, table.limit(0)).agg({"good_lost": "sum", "toxic_lost": "sum"}).first()
    assert tuple(unlabelled) == (0, 0)


def test_first_failures_of_all_masks():
    table = filter_audit.first_failures()
    assert table.shape == (32, 120)
    for mask in range(32):
        for o, order in enumerate(permutations(range(5))):
            assert table[mask, o] == next((i for i, f in enumerate(order) if mask >> f & 1), 5)


def test_audit_with_many_parts(spark, monkeypatch):
    """More parts than a task counts at once are sent on in between."""
    monkeypatch.setattr(filter_audit, "PARTS_AT_ONCE", 3)
    rows = spark.createDataFrame([(f"p{i % 11}", i % 32, i % 4, 1 + i % 3) for i in range(400)], "part string, mask int, label int, n long").repartition(2)
    got = filter_audit.audit(rows)
    assert got.count() == 11 * 600
    n = {r["part"]: r["n"] for r in rows.groupBy("part").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n").collect()}
    assert {r["part"]: r["kept"] + r["removed"] for r in got.where("o = 0 AND step = 1").collect()} == n


def test_masks_of_a_long_text_in_parts(monkeypatch):
    text = "one two #" + " three four" * 400 + " FIVE" * 10
    whole = filter_audit.masks(pa.array([text, None]))
    monkeypatch.setattr(filter_audit, "AT_ONCE", 50)
    monkeypatch.setattr(filter_audit, "slices", lambda at: [(i, i + 1) for i in range(len(at) - 1)])
    assert filter_audit.masks(pa.array([text, None])).tolist() == whole.tolist() == [0b1010, 0b00001]


# importance resampling


def grams(text, n):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)], len(w)


def plain_resample(rows, target, n=1, buckets=10_000, seed=2024, least=20, percent=10):
    of = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for x in rows:
        s.update(map(of, grams(x[1], n)[0]))
    for x in target:
        t.update(map(of, grams(x, n)[0]))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
    out = []
    for x in rows:
        g, words = grams(x[1], n)
        weight = math.floor(Fraction(sum(gain(of(f)) for f in g), len(g))) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if x[0] is None else x[0]}".encode()).hexdigest()[:8], 16)
        out.append([x[0], len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), words])
    fit = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    rank = {id(x): i + 1 for i, x in enumerate(fit[: len(fit) * percent // 100])}
    return sorted(([*x[:4], rank.get(id(x))] for x in out), key=repr)


@pytest.mark.parametrize("how", [{}, {"n": 3, "buckets": 500, "least": 5, "percent": 60}, {"n": 2, "least": 1, "percent": 100, "seed": 3}])
def test_resampling_equals_plain_version(spark, docs, rows, how):
    target = ["river light stone1", None, "silver Silver garden3 garden3 the of and", ""]
    got = importance.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"), **how)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((list(r) for r in got.collect()), key=repr) == plain_resample(rows, target, **how)


def test_resampling_without_rows(spark, docs, rows):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, docs).count() == 0
    assert sorted((list(r) for r in importance.resample(docs, none).collect()), key=repr) == plain_resample(rows, [])


def test_blocks_are_a_sparse_matrix(docs, rows):
    seen = Counter()
    for b in importance.matrix(docs, n=2, buckets=64, limit=3000).collect():
        assert b["indptr"][0] == 0 and b["indptr"][-1] == len(b["indices"]) == len(b["counts"]) and len(b["indptr"]) == len(b["ids"]) + 1
        for k, lo, hi in zip(b["ids"], b["indptr"], b["indptr"][1:]):
            assert b["indices"][lo:hi] == sorted(set(b["indices"][lo:hi]))  # each bucket once, also where a long text came in parts
            seen[k, tuple(zip(b["indices"][lo:hi], b["counts"][lo:hi]))] += 1
    want = Counter((x[0], tuple(sorted(Counter(zlib.crc32(g.encode()) % 64 for g in grams(x[1], 2)[0]).items()))) for x in rows)
    assert seen == want


def test_drawn_documents(spark, docs):
    target = spark.createDataFrame([("river stone light",)], "text string")
    got = importance.drawn_documents(docs, target, least=5, percent=20)
    ids = {r["doc_id"] for r in importance.resample(docs, target, least=5, percent=20).where("rank IS NOT NULL").collect()}
    assert got.columns == docs.columns and {r["doc_id"] for r in got.collect()} == ids


# personal data


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m.group())
        out += [(m.start(), 2, m.end())] if 12 <= len(digits) <= 19 and luhn(digits) else []
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


PIECES = ["a", "b.c", "@", "@", "+1", "+", "1", "22", "256", "300", ".", "..", "-", " ", "  ", "(", ")", "\n", "é", "4242", "4242 4242 4242 4242", "12-34", "1.2.3.4", "555", "at", "dot", " at ", " dot ", ":", "ab:cd:", "::", "%", "_", "x@y.z", "00", "é@b.c"]


def test_strict_spans_of_made_up_texts():
    r = random.Random(4)
    texts = ["".join(r.choice(PIECES) for _ in range(r.randrange(60))) for _ in range(8000)] + [None, ""]
    for t, d in zip(texts, personal_data.examine(pa.array(texts))):
        assert d.base == plain_spans(t or ""), t
        assert all(0 <= a < b <= len(t or "") for a, _, b in d.candidates) and len(d.features) == len(d.candidates)


def test_texts_that_would_take_square_time():
    texts = ["1" * 300_000, "1." * 100_000, "a" * 300_000 + "@", "@" * 5000 + "a@b.c", "+1" + " " * 300_000, "1-" * 100_000, "a@b." * 3000, "ab:" * 50_000, " at a dot" * 20_000]
    found = list(personal_data.examine(pa.array(texts)))
    assert len(found[1].base) == 25_000 and found[3].base == [(5000, 0, 5005)]


def test_reliabilities_equal_plain_expectation_maximisation():
    r = np.random.default_rng(3)
    truth = r.random(3000) < 0.3
    right = np.array([0.95, 0.8, 0.7, 0.6, 0.5, 0.9])
    votes = np.where(r.random((3000, 6)) < right, truth[:, None], ~truth[:, None]) * 2
    votes[r.random((3000, 6)) < 0.2] = 1
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p, tables, share = personal_data.reliabilities(patterns, counts.astype(float))
    known = np.where(votes == 1, 0, (votes - 1) * np.log(right / (1 - right))).sum(axis=1) + math.log(0.3 / 0.7) > 0  # by the true reliabilities
    assert ((p[at.ravel()] > 0.5) == truth).mean() > (known == truth).mean() - 0.01 and abs(share - 0.3) < 0.03
    assert tables[1][0, 2] > tables[1][1, 2] > tables[1][3, 2]
    q = [1 / (1 + math.exp(-sum(v - 1 for v in row))) for row in patterns.tolist()]  # row by row
    for _ in range(100):
        table = [[[personal_data.PRIOR[y, v] + sum(c * (x if y else 1 - x) for row, c, x in zip(patterns.tolist(), counts, q) if row[j] == v) for v in range(3)] for j in range(6)] for y in (0, 1)]
        table = [[[x / sum(t) for x in t] for t in own] for own in table]
        s = (sum(c * x for c, x in zip(counts, q)) + 5) / (counts.sum() + 10)
        new = []
        for row in patterns.tolist():
            a, b = s, 1 - s
            for j, v in enumerate(row):
                a, b = a * table[1][j][v], b * table[0][j][v]
            new.append(a / (a + b))
        q, moved = new, max(abs(x - y) for x, y in zip(q, new))
        if moved < 1e-9:
            break
    assert np.allclose(p, q, atol=1e-6)


def test_classifier_has_no_slope_left():
    r = np.random.default_rng(5)
    x = np.column_stack([personal_data.FIRST_OF[i] + r.integers(0, 3, 400) for i in range(personal_data.WIDTH)])
    y = np.clip(0.2 + 0.3 * (x[:, 0] - personal_data.FIRST_OF[0]) + r.normal(0, 0.05, 400), 0, 1)
    w = personal_data.fit(x, y, l2=1e-2, steps=4000)

    def loss(w):
        z = w[x].sum(axis=1) + w[-1]
        return np.mean(np.logaddexp(0, z) - y * z) + 0.5e-2 * (w[:-1] ** 2).sum()

    for i in [*x[0].tolist(), personal_data.FEATURES]:
        up, down = w.copy(), w.copy()
        up[i] += 1e-4
        down[i] -= 1e-4
        assert abs(loss(up) - loss(down)) / 2e-4 < 1e-4


@pytest.fixture(scope="module")
def private(spark):
    r = random.Random(9)
    card = lambda: next(x for x in iter(lambda: "4" + "".join(r.choice("0123456789") for _ in range(15)), None) if luhn(x))
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    kinds = [
        lambda: f"mail {r.choice('abcdef')}{number(2)}@site{number(1)}.example.com today", lambda: f"call +49 30 {number(3)} {number(4)} now", lambda: f"pay card {card()} please",
        lambda: f"host 10.{r.randrange(256)}.3.{r.randrange(256)} is up", lambda: f"order {number(16)} was sent", lambda: f"token = \"{number(3)}ab{number(8)}ef{number(9)}\" here",
        lambda: f"write to jo{number(2)} [at] site{number(1)} [dot] com soon", lambda: f"phone 00{r.choice(['49', '33', '44'])} ({number(2)}) {number(3)}-{number(4)} tonight",
    ]
    rows = [(i, prose(r, 12) + " " + kinds[i % 8]() + "\n" + prose(r, 8), i % 8) for i in range(800)]
    rows += [(None, None, 8), (900, "", 8), (3, rows[3][1], 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, spans int").repartition(3), rows


def test_personal_data_keeps_strict_spans_and_adds_others(spark, private):
    docs, rows = private
    got = personal_data.personal_data(docs).collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in rows}
    added = Counter()
    for r in got:
        text, kind = (by_id[r["doc_id"]][1] or "", by_id[r["doc_id"]][2])
        base = plain_spans(text)
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for _, k, _ in base) for i in range(4)]
        want = [f"{personal_data.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(want) <= set(spans)
        added[kind] += len(spans) > len(want)
    assert added[6] >= 90 and added[7] >= 90  # spelt addresses, numbers without a plus sign
    assert added[4] <= 10 and added[5] == 0 and not any(added[k] for k in (0, 1, 2, 3, 8))  # orders that miss the checksum, tokens


def test_redacted_texts(spark, private):
    docs, rows = private
    model = personal_data.train(personal_data.scan(docs))
    got = {r["doc_id"]: r for r in personal_data.redacted(docs, model).collect()}
    assert got[None]["text"] is None and got[900]["text"] == "" and got[0]["spans"] == 0
    assert "[EMAIL]" in got[0]["text"] and "[PHONE]" in got[1]["text"] and "[CARD]" in got[2]["text"] and "[IP]" in got[3]["text"] and got[5]["text"] == rows[5][1]


def test_personal_data_of_no_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert personal_data.personal_data(none).count() == 0
    plain = spark.createDataFrame([(1, "nothing here"), (1, None)], "doc_id long, text string")
    assert {r["spans"] for r in personal_data.personal_data(plain).collect()} == {""}


def test_shards_grow_without_moving_others(spark, docs, tmp_path):
    """Beyond the planned number each shard takes rows only into itself, in tables and in folders."""
    at = {n: {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.assign(docs, n).collect()} for n in (8, 9, 10, 11)}
    for n in (8, 9, 10):
        assert all(at[n][k][1] == at[n + 1][k][0] for k in at[n])
        assert all(was == now or now == n for was, now in at[n].values())
    own = docs.select("doc_id", "text", "lang")
    for n in (9, 10):
        sharding.write_shards(own, f"file://{tmp_path}/{n}", n)
        assert {(r["doc_id"], r["shard"]) for r in spark.read.parquet(f"file://{tmp_path}/{n}").collect()} == {(k, v[0]) for k, v in at[n].items()}
    sharding.write_shards(own, f"file://{tmp_path}/p", 5, planned=4)
    assert spark.read.parquet(f"file://{tmp_path}/p").count() == own.count()


def test_stored_blocks_are_small(spark):
    """Spark reads thousands of rows at once: a row holds a few texts, or one long one, however many are counted together."""
    r = random.Random(31)
    rows = [(i, " ".join(r.choice(["river", "light", "stone1", "the"]) for _ in range(r.randrange(400)))) for i in range(300)] + [(300, "word " * 3000)]
    blocks = importance.matrix(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    sizes = dict((i, len(t)) for i, t in rows)
    held = [[sizes[k] for k in b["ids"]] for b in blocks]
    assert sum(map(len, held)) == 301 and all(len(x) == 1 or sum(x) <= importance.STORED for x in held)
