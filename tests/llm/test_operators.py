"""The ten operators against plain versions, on small tables with nulls, empty and long texts, ties, repeated rows and other columns."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from loomtext.llm import audio, common, components, exact_dedup, language_id, mixing, ngram_join, packing, sharding, suffix_dedup, token_files, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, h long, label string"
WORDS = "the of and to river stone light cloud winter paper engine garden silver window market bridge forest candle".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    passage = prose(r, 40)
    base = prose(r, 120)
    texts = [None, "", " \n\t ", "A", "a", "one two three", "One TWO three", base, base.upper().lower(), base, prose(r, 5000), "é ñ ü " + prose(r, 60), "x" * 700, "ab " * 400]
    for i in range(30):
        w = base.split()
        for _ in range(r.randrange(1, 9)):
            w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
        texts.append(" ".join(w))
        texts.append(prose(r, r.randrange(3, 150)) + "\n" + passage + ". " + prose(r, r.randrange(3, 150)))
    out = [(i * 3, t, ["en", "de", None][i % 3], None if i % 7 == 0 else f"s{i % 4 if i % 3 else 0}", i, "x") for i, t in enumerate(texts)]
    return [*out, (21, base, "en", "s1", 1, "y")]  # one row again, with other columns


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def low(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


def fresh_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


def test_token_files(spark, docs, rows, none, tmp_path):
    got = sorted(tuple(r) for r in token_files.TokenFiles.write(docs, f"file://{tmp_path}/t", segment_ids=500).digests().collect())
    tok = fresh_tokenizer()
    at, want = 0, []
    for d, ids in sorted((x[0], tok.encode(x[1] or "", add_special_tokens=False).ids + [0]) for x in rows):
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.TokenFiles.write(none, f"file://{tmp_path}/e").digests().count() == 0


def test_elias_fano_select():
    r = np.random.default_rng(0)
    for values in ([0], [5] * 300, np.sort(r.integers(0, 10**7, 1000)), np.arange(200), [0, 1, 2**63, 2**64 - 1]):
        ef = token_files.EliasFano.build(np.array(values, np.uint64))
        again, end = token_files.EliasFano.unpack(b"xx" + ef.pack() + b"yy", 2)
        assert [int(v) for v in values] == [again.select(i) for i in range(len(values))] and end == 2 + len(ef.pack())
    blob = token_files.Segment.pack([None, -(2**63), 7, 7, 2**63 - 1], np.array([2, 0, 3, 0, 1]), np.array([9, 70000, 1, 2, 3, 4]), 4)
    s = token_files.Segment.unpack(blob)
    assert [s.key(i) for i in range(len(s))] == [None, -(2**63), 7, 7, 2**63 - 1] and s.start == 4
    assert [s.document(i).tolist() for i in range(5)] == [[9, 70000], [], [1, 2, 3], [], [4]]
    lengths = r.integers(1, 2000, 5000)
    ef = token_files.EliasFano.build(np.cumsum(lengths))
    assert 8 * len(ef.pack()) < 5000 * (2 + np.log2(lengths.mean()) + 1)


@pytest.mark.parametrize("text", ["", "  a  b ", "\n\n foo\n", "it's I'll don't", "3.5 a.b,c x.. ,,", "x　 y", "    z", "日本語 テキスト。", "<|endoftext|> q", "12,345.67 $5", " \t\r\n"])
def test_chunked_encoding_is_whole_encoding(text):
    e = tokens.encoder(tokens.tokenizer_path())
    ids, at = e.encode(pa.array([text, None, text]))
    assert ids.tolist() == 2 * fresh_tokenizer().encode(text, add_special_tokens=False).ids and len(at) == 4


def test_chunks_of_one_hash_are_told_apart(monkeypatch):
    """Hashes of four bits: whatever is found has to be compared. Few chunks are kept, so that all are forgotten now and then."""
    plain = common.hash_spans
    monkeypatch.setattr(tokens, "hash_spans", lambda *x: plain(*x) & np.uint64(15))
    e, tok = tokens.Encoder(tokens.tokenizer_path(), words=50), fresh_tokenizer()
    r = random.Random(1)
    for _ in range(30):
        texts = [prose(r, r.randrange(1, 30)) + " é, ñ. 3.5" for _ in range(3)]
        ids, at = e.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def thue_morse(n):
    """Two strings on which polynomial hashes modulo a power of two agree, whatever their base."""
    x = "".join("ab"[bin(i).count("1") % 2] for i in range(n))
    return x, x.translate({97: 98, 98: 97})


@pytest.mark.parametrize("n, parts", [(1024, 1), (2048, 2)])
def test_like_strings_are_told_apart(spark, tmp_path, n, parts):
    x, y = thue_morse(n)
    rows = [(1, x), (2, y), (3, f"{x} one two three four"), (4, f"{y} one two three four")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id").cache()
    tok = fresh_tokenizer()
    want = {d: np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4") for d, t in rows}
    got = token_files.TokenFiles.write(docs.coalesce(parts), f"file://{tmp_path}/t").digests().collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in got} == {d: (len(v), zlib.crc32(v.tobytes())) for d, v in want.items()}
    packed = packing.pieces(docs.coalesce(parts)).collect()
    assert {r["doc_id"]: r["length"] for r in packed if not r["piece"]} == {d: (len(v) - 1) % 2048 + 1 for d, v in want.items()}
    joined = ngram_join.NgramJoin(docs).components().collect()
    assert {r["doc_id"]: r["component_id"] for r in joined} == {1: 1, 2: 2, 3: 3, 4: 4}
    doubled = docs.unionByName(docs.selectExpr("doc_id + 10 AS doc_id", "text"))
    cut = suffix_dedup.SuffixDedup(doubled).documents().collect()
    assert sorted(tuple(r) for r in cut) == brute_removed([*rows, *((d + 10, t) for d, t in rows)])


def test_very_long_texts(spark):
    """One text of more than two blocks is worked on in parts, with the results of the whole."""
    r = random.Random(8)
    text = " ".join(r.choice(WORDS) + r.choice(["", ",", ".", " é"]) for _ in range(1_400_000)) + " vilest"
    assert len(text.encode()) > 2 * common.AT_ONCE
    column = pa.array(["one two", text, None, "three"])
    ids, at = tokens.encoder(tokens.tokenizer_path()).encode(column)
    tok = fresh_tokenizer()
    halves = text[: len(text) // 2].rfind(" ")
    want = tok.encode(text[:halves], add_special_tokens=False).ids + tok.encode(text[halves:], add_special_tokens=False).ids
    assert ids[at[1] : at[2]].tolist() == want and at[3] - at[2] == 0
    h, s = common.word_hashes(column)
    words = text.split()
    first = dict(zip(words, h[s[1] : s[2]].tolist()))
    assert s.tolist() == [0, 2, 2 + len(words), 2 + len(words), 3 + len(words)] and h[s[1] : s[2]].tolist() == [first[w] for w in words] and len(set(first.values())) == len(first)
    row, f = toxicity.features(column)
    short = pa.array([" ".join(dict.fromkeys(text.split()))])
    assert f[row == 1].tolist() == toxicity.features(short)[1].tolist()


def brute_components(rows, k=5):
    def shingles(t):
        w = [x for x in __import__("re").findall(r"[^\x20\x09-\x0D]+", low(t))]
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    sets = [(x[0], shingles(x[1])) for x in rows]
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return sorted((d, len(s), find(d)) for d, s in sets)


def test_ngram_join(spark, docs, rows, none):
    got = ngram_join.NgramJoin(docs).documents().select("doc_id", "n_shingles", "component_id")
    assert sorted(tuple(r) for r in got.collect()) == brute_components(rows)
    assert ngram_join.drop_near_copies(none).count() == 0 and ngram_join.NgramJoin(none).documents().count() == 0


def test_ngram_join_deals_hot_lists(spark, docs, rows, monkeypatch):
    """Lists of more than two rows are dealt to several parts, tokens to cells of two blocks, and pivots to parts."""
    monkeypatch.setattr(ngram_join, "TOKEN_BLOCK", 2)
    hot = common.hot_keys
    monkeypatch.setattr(ngram_join, "hot_keys", lambda counts, keys: hot(counts, keys, 10**6))
    more = [(10_000 + i, t) for i, (_, t, *_) in enumerate(rows) if t and i % 2 for _ in [0]]
    all_rows = [(x[0], x[1]) for x in rows] + [(d, t + " and more") for d, t in more]
    table = spark.createDataFrame(all_rows, "doc_id long, text string").repartition(3)
    got = ngram_join.NgramJoin(table, long=2).components().select("doc_id", "n_shingles", "component_id")
    assert sorted(tuple(r) for r in got.collect()) == brute_components(all_rows)


def brute_links(rows, k=5):
    """Classes are documents with equal sets, by their smallest identifier."""
    sets = {}
    for d, t in rows:
        w = low(t).split()
        if w:
            s = frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))
            sets[s] = min(d, sets.get(s, d))
    got = [(min(a, b), max(a, b), len(s & t), len(s | t)) for i, (s, a) in enumerate(sets.items()) for t, b in list(sets.items())[:i]]
    return sorted(x for x in got if 100 * x[2] >= 80 * x[3])


def test_ngram_join_has_all_links(spark, monkeypatch):
    """Near copies of a text link with one another, not with the pivot of their posting lists alone."""
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    r = random.Random(11)
    rows = [(1000, prose(r, 50)), (1001, None), (1002, "")]
    for g in range(3):
        base = prose(r, 200).split()
        for i in range(12):
            w = list(base)
            for _ in range(r.randrange(4) if i else 0):
                w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
            rows.append((100 * g + i, " ".join(w)))
    rows += [(500 + i, t) for i, (_, t) in enumerate(rows[5:8])]
    want = brute_links(rows)
    assert len(want) > 90
    j = ngram_join.NgramJoin(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(tuple(x) for x in j.links.select("a", "b", "n_both", "n_union").collect()) == want
    ends = [d for x in want for d in x[:2]]
    got = j.documents().collect()
    assert len(got) == len(rows) and all(x["n_links"] == ends.count(x["class_id"]) for x in got)


def test_prefixes_find_every_link():
    """Any two sets above the threshold share enough of their prefixes, whatever is known about frequencies."""
    r = np.random.default_rng(1)
    for trial in range(200):
        x = np.unique(r.integers(0, 400, 80).astype(np.uint64))
        y = np.unique(np.concatenate([x[r.random(len(x)) < 0.93], r.integers(0, 400, 4).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both):
            continue
        heavy = np.unique(r.integers(0, 400, 100).astype(np.uint64))
        p = ngram_join.Prefixes(heavy, r.integers(8, 5000, len(heavy)), 80, 100)
        (a, la, _, _), (b, lb, _, _) = p.of([x, y])
        k = min(la, lb)
        cut = lambda s, t: s[: len(t) - -(-80 * len(t) // 100) + k]
        assert len(np.intersect1d(cut(a, x), cut(b, y))) >= k


@pytest.mark.parametrize("n", [300, 576, 700, 1000, 4608, 5000])
def test_audio_frames_reach_the_end(n):
    x = np.random.default_rng(n).integers(0, 256, n).astype(np.uint8)
    y = x.copy()
    y[-20:] = 255 - y[-20:]
    assert not np.array_equal(audio.log_mel(x), audio.log_mel(y))
    total = -(-n * audio.UP // audio.DOWN)
    assert len(audio.log_mel(x)) == max(1, 1 + -(-(total - audio.FRAME) // audio.HOP))


def test_components(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (202, 201), (5, 5)]
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 1, 200: 200, 201: 200, 202: 200}


def test_least_hashed(spark):
    """The least hashes of each group, one row for each hash, however large the group and however often a row is repeated."""
    rows = spark.range(5000).repartition(7).selectExpr("id", "CASE WHEN id < 4800 THEN 0 WHEN id < 4990 THEN 1 END AS g", "xxhash64(id) AS h")
    again = rows.unionByName(rows.where("id % 3 = 0").limit(10**6)).unionByName(rows.where("id = 7").crossJoin(spark.range(300).selectExpr("id AS j")).select("id", "g", "h"))
    got = common.least_hashed(again, ["g"], 30).to_pylist()
    for g in (0, 1, None):
        want = sorted((r for r in rows.collect() if r["g"] == g), key=lambda r: r["h"])[:30]
        assert [r["id"] for r in got if r["g"] == g] == [r["id"] for r in want]


def test_toxicity(spark, none):
    r = random.Random(5)
    bad = ["vilest", "vilely", "grubbo"]
    rows, labels = [], []
    for i in range(600):
        rude, rough = i % 5 == 0, i % 4 == 0
        words = prose(r, r.randrange(20, 200)).split()
        if rude:
            words.insert(r.randrange(len(words)), bad[i % 3] + r.choice(["", "s", "en"]))
        if rough:
            words.insert(0, "spamword")
        rows.append((i, " ".join(words)))
        if i < 400:
            labels.append((i, int(rough), int(rude)))
    labels += [(1, 0, 0), (None, 1, 1), (599, None, 1)]
    docs = spark.createDataFrame(rows + [(1000, None), (1001, "")], "doc_id long, text string")
    names = ["rough", "rude"]
    chain = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, rough int, rude int"), names)
    got = {x["doc_id"]: x for x in toxicity.score(docs, chain).collect()}
    assert len(got) == 602 and not got[1000]["toxic"] and not got[1001]["toxic"]
    held = [(got[i]["toxic"], i % 5 == 0) for i in range(400, 600)]
    assert sum(a == b for a, b in held) >= 0.97 * len(held)
    assert chain.models[1].chain.shape == (1,)  # the second category's model sees the first one's probability
    kept = toxicity.drop_toxic(docs.selectExpr("*", "doc_id AS p"), chain)
    assert kept.columns == ["doc_id", "text", "p"] and kept.count() == sum(not x["toxic"] for x in got.values())
    empty = toxicity.train(none, spark.createDataFrame([], "doc_id long, rude int"), ["rude"])
    assert [x["toxic"] for x in toxicity.score(docs, empty).limit(3).collect()] == [False] * 3 and toxicity.score(none, empty).count() == 0


def test_toxicity_of_held_out_documents(spark):
    """On the given tables: a third of the labelled texts, copies of a text together, are kept from the training."""
    import zlib as z

    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").cache()
    labels = toxicity.labelled(spark, sf)
    first_words = {r["doc_id"]: " ".join((r["text"] or "").lower().split()[:8]) for r in docs.join(labels.select("doc_id"), "doc_id").collect()}
    held = {d for d, w in first_words.items() if z.crc32(w.encode()) % 3 == 0}
    names = spark.createDataFrame([(d,) for d in held], "doc_id long")
    chain = toxicity.train(docs, labels.join(names, "doc_id", "left_anti"), toxicity.CATEGORIES)
    got = {r["doc_id"]: r["toxic"] for r in toxicity.score(docs.join(names, "doc_id"), chain).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect() if r["doc_id"] in got}
    toxic, clean = [got[d] for d, t in truth.items() if t], [got[d] for d, t in truth.items() if not t]
    print("held out:", sum(toxic), "of", len(toxic), "toxic found,", sum(clean), "of", len(clean), "clean flagged")
    assert len(toxic) > 80 and sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.01 * len(clean)
    docs.unpersist()


def test_toxicity_gathers_a_bounded_sample(spark):
    """Repeated rows of an identifier bring one row; the features' number is bounded too."""
    docs = spark.createDataFrame([(i % 20, f"word{i % 20} other words {'bad' if i % 2 else 'fine'}") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] * 50, "doc_id long, toxic int")
    seen = []
    train = toxicity.Chain.train.__func__
    try:
        toxicity.Chain.train = classmethod(lambda cls, c, row, f, y, *a: seen.append((len(y), len(f))) or train(cls, c, row, f, y, *a))
        toxicity.train(docs, labels, ["toxic"], per_group=3)
        toxicity.train(docs, labels, ["toxic"], most_features=40)
    finally:
        toxicity.Chain.train = classmethod(train)
    assert seen[0][0] == 6 and 0 < seen[1][1] <= 40


def test_audio(spark, docs, rows, none):
    got = audio.extract(audio.encode(docs)).collect()
    texts = {}
    for x in rows:
        texts.setdefault(x[0], []).append((x[1] or "").encode())
    assert sorted(r["doc_id"] for r in got) == sorted(x[0] for x in rows)
    by_text = {}
    for r in got:
        b = texts[r["doc_id"]][0]
        p = b + b"\xff" * (max(1, -(-len(b) // 576)) * 576 - len(b))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert r["media_sha256"] == hashlib.sha256(audio.wav(p)).hexdigest() and r["media_bytes"] == len(p) + 44
        assert by_text.setdefault(b, r["feature"]) == r["feature"]
        with pa.ipc.open_stream(r["tensors"]) as s:
            t = s.read_all()
        assert t.schema.field("tensor").type.shape == [audio.CLIP, audio.BANDS] and sum(t.column("frames").to_pylist()) == int(r["feature"].split(";")[0][7:])
    assert audio.extract(audio.encode(none)).count() == 0


def plain_audio(payload):
    """Frames x bands in decibels by plain sums: the upsampled signal, its low-pass filter, every fourth sample, a discrete Fourier sum and
    triangular bands, in the definitions' own terms."""
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    n = audio.UP * audio.TAPS
    t = np.arange(n) - (n - 1) / 2
    taps = np.sinc(t / 4) * np.hanning(n + 2)[1:-1]
    taps *= audio.UP / taps.sum()
    up = np.zeros(len(x) * 3)
    up[::3] = x
    total = -(-len(x) * 3 // 4)
    frames = max(1, -(-(total - 256) // 128) + 1)
    full = np.convolve(np.concatenate([up, np.zeros(4 * 128 * 4 + 4 * 256)]), taps)[::4][: (frames - 1) * 128 + 256]
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(6000), audio.BANDS + 2) / 2595) - 1)
    window = np.hanning(256)
    out = []
    for f in range(frames):
        y = full[f * 128 : f * 128 + 256] * window
        power = [abs((y * np.exp(-2j * np.pi * k * np.arange(256) / 256)).sum()) ** 2 for k in range(129)]
        row = []
        for b in range(audio.BANDS):
            lo, mid, hi = edges[b : b + 3]
            tri = [max(0, min((k * 12000 / 256 - lo) / (mid - lo), (hi - k * 12000 / 256) / (hi - mid))) for k in range(129)]
            row.append(10 * np.log10(np.dot(power, tri) + 1e-6))
        out.append(row)
    return np.array(out)


@pytest.mark.parametrize("n", [1, 576, 700, 5000])
def test_audio_features_against_plain_sums(n):
    payload = audio.padded(bytes(np.random.default_rng(n).integers(32, 122, n).astype(np.uint8)))
    mel = audio.log_mel(np.frombuffer(payload, np.uint8))
    want = plain_audio(payload)
    assert mel.shape == want.shape and np.abs(mel / 4 - want).max() < 0.2
    level = mel.mean(axis=1) / 4
    floor, on, spans = np.sort(level)[len(level) // 10], False, []
    for i, v in enumerate([*level, -np.inf]):  # the hysteresis, frame by frame
        was, on = on, v >= floor + audio.ON or (on and v >= floor + audio.OFF)
        if on and not was:
            spans.append([i, 0])
        if was and not on:
            spans[-1][1] = i
    assert audio.segments(mel).tolist() == spans


def test_audio_by_parts_is_audio_as_a_whole():
    r = np.random.default_rng(2)
    x = (128 + 90 * np.sin(np.arange(700_000) * 2 * np.pi * 440 / 16000)).astype(np.uint8)
    whole, block = audio.log_mel(x), audio.BLOCK
    try:
        audio.BLOCK = 3 * 100
        assert np.abs(whole.astype(int) - audio.log_mel(x)).max() <= 1
    finally:
        audio.BLOCK = block
    y = audio.resampled(x, 0, 1200)
    want = 90 / 128 * np.sin((np.arange(1200) * 4 / 3 - (audio.UP * audio.TAPS - 1) / 2 / audio.UP + 0) * 2 * np.pi * 440 / 16000)
    assert np.abs(y[100:1000] - want[100:1000]).max() < 0.05
    mel = np.zeros((100, audio.BANDS), np.int16)
    mel[20:40] = 4 * 10
    mel[40:45] = 4 * 4  # between the levels: the segment goes on
    assert audio.segments(mel).tolist() == [[20, 45]] and audio.segments(mel[:15]).tolist() == []
    del r


def test_language_id(spark, none):
    r = random.Random(9)
    own = {"aa": ["kato", "mura", "soki", "tane"], "bb": ["schlend", "grück", "zwolf", "pfrun"], "cc": ["oiseau", "çavre", "quelle", "être"]}
    rows = [(i, " ".join(r.choice(own[k]) for _ in range(r.randrange(10, 300))), k) for i in range(240) for k in [["aa", "bb", "cc"][i % 3]]]
    rows += [(300, None, "aa"), (301, "12 34", "bb"), (302, "", None), (303, rows[0][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.train(docs.where("doc_id % 4 <> 2"))
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in language_id.identify(docs, net).collect()}
    held = [got[i][0] == k for i, _, k in rows[:240] if i % 4 == 2]
    assert sum(held) >= 0.97 * len(held)
    assert got[300] == got[301] == got[302] == ("und", 0.0) and got[303] == got[0] and all(0 <= s <= 1 for _, s in got.values())
    assert language_id.train(none) is None and {x["lang_pred"] for x in language_id.identify(docs, None).collect()} == {"und"}
    assert language_id.identify(none, net).count() == 0
    clash = language_id.identify(docs.selectExpr("doc_id", "text", "lang", "'x' AS _text", "1 AS c0", "2 AS t"), net, keep=("_text", "c0", "t"))
    assert clash.columns == ["doc_id", "_text", "c0", "t", "lang_pred", "score"] and {tuple(r)[1:4] for r in clash.collect()} == {("x", 1, 2)}


def brute_removed(rows, length=100):
    seen, out = {}, []
    for d, t in sorted({(x[0], x[1] or "") for x in rows}):
        b = t.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if seen.setdefault(w, (d, s)) != (d, s):
                gone[s : s + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out += [(d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())] * sum((x[0], x[1] or "") == (d, t) for x in rows)
    return sorted(out)


@pytest.mark.parametrize("hot, bits", [(50_000, 64), (2, 64), (50_000, 4)])
def test_suffix_dedup(spark, docs, rows, none, hot, bits):
    """With 4 bits most texts share their number with others."""
    got = suffix_dedup.SuffixDedup(docs, hot=hot, bits=bits).documents()
    assert sorted(tuple(r) for r in got.collect()) == brute_removed(rows)
    assert suffix_dedup.SuffixDedup(none).documents().count() == 0


def test_runs_do_not_hang_on_what_lies_before(spark):
    """A copy whose runs a block's end cuts elsewhere is no earlier match of its own text."""
    r = random.Random(21)
    texts = ["".join(r.choice("abcdefghijklmnop") for _ in range(700)) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)]
    runs = []
    for before in (b"", b"x" * 7, b"y" * 12_345):
        data = np.frombuffer(before + "".join(texts).encode(), np.uint8)
        at = np.concatenate([[0], len(before) + np.arange(len(texts) + 1) * 700])
        h, seg, s, p, n = suffix_dedup.anchors(data, at, 100, 24)
        own = s >= len(before)
        runs.append(list(zip(*(x[own].tolist() for x in (h, seg, s - len(before), p, n)))))
    assert runs[0] == runs[1] == runs[2]
    copies = [(1000, "z" * 20_000), *((d + 2000, t) for d, t in rows)]
    halves = [spark.createDataFrame(x, "doc_id long, text string").coalesce(1) for x in (rows, copies)]
    got = suffix_dedup.SuffixDedup(halves[0].unionByName(halves[1])).documents().collect()
    assert sorted(tuple(x) for x in got) == brute_removed([*rows, *copies])


@pytest.mark.parametrize("text", [b"banana_bandana_banana", b"a" * 40, b"abcdefgh", bytes(np.random.default_rng(1).integers(97, 99, 300, np.uint8)), b"zyxwvu" * 9])
def test_previous_factor(text):
    w = np.array([text[i : i + 3] for i in range(len(text) - 2)], "S3")
    factor, source = suffix_dedup.previous_factor(w)
    common_prefix = lambda a, b: next((k for k in range(3) if a[k] != b[k]), 3)
    for i in range(len(w)):
        best = max((common_prefix(w[i], w[j]) for j in range(i)), default=0)
        assert factor[i] == best
        assert source[i] == -1 if not best else source[i] < i and common_prefix(w[i], w[source[i]]) == best


def test_mixing(spark, docs, rows, none):
    sizes = [(1, "a", 1000), (2, "b", 10), (3, None, 400), (4, "c", 0)]
    t = mixing.source_targets([(s, n) for _, s, n in sizes])
    assert [x[0] for x in t] == ["a", "b", "c", None]
    assert abs(sum(x[2] for x in t) - 1.5 * 1410) < 1e-6 and all(x[2] <= 2 * x[1] + 1e-9 for x in t)
    mix = mixing.Mix(docs, block=16)
    got = mix.taken().collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    by = {}
    for r in got:
        by[r["source_size"], r["target"]] = by.get((r["source_size"], r["target"]), 0) + r["taken"]
    alike = [(n, t) for _, n, t in mix.targets]
    assert all(abs(by.get(x, 0) - alike.count(x) * x[1]) <= 4 for x in alike)
    again = mixing.Mix(docs.repartition(2), block=16).taken().collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    mixed = mixing.mixed_documents(docs, block=16)
    assert mixed.columns == docs.columns and sum(len((r["text"] or "").split()) for r in mixed.collect()) == sum(r["taken"] for r in got)
    assert mixing.Mix(none).taken().count() == 0 and mixing.mixed_documents(none).count() == 0


def plain_mix(rows, block, share=1.5, limit=2, weights=(5, 2, 1), seed=7):
    """Words taken from each document, by lists: slots by golden-ratio points, blocks of each source's shuffled stream, begun again at its end.
    rows: (doc_id, source, words, shuffled), one for each document, in no order."""
    sources = sorted({r[1] for r in rows}, key=lambda x: (x is None, x or ""))
    size = {c: sum(r[2] for r in rows if r[1] == c) for c in sources}
    weight = {c: weights[i % 3] for i, c in enumerate(sources)}
    target, left, free = {}, share * sum(size.values()), list(sources)
    while free:
        over = [c for c in free if left * weight[c] / sum(weight[x] for x in free) > limit * size[c]]
        if not over:
            target |= {c: left * weight[c] / sum(weight[x] for x in free) for c in free}
            break
        target |= {c: limit * size[c] for c in over}
        left, free = left - sum(limit * size[c] for c in over), [c for c in free if c not in over]
    take = {c: min(int(target[c] + 1e-6), limit * size[c]) for c in sources}
    taken = {}
    for c in sources:
        stream = [r[0] for r in sorted((r for r in rows if r[1] == c), key=lambda r: (r[3], r[0])) for _ in range(r[2])]
        for i in range(take[c]):
            taken[stream[i % len(stream)]] = taken.get(stream[i % len(stream)], 0) + 1
    return size, target, taken


def test_mixing_against_lists(spark):
    """What each document gives follows from its source's target and its place in the shuffled stream alone; 300 documents of 5 sources."""
    r = random.Random(6)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 5, 40, 300])), r.choice(["a", "b", "c", None, "d" if i < 20 else "a"])) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    order = {d: int(hashlib.md5(f"{d}/7".encode()).hexdigest()[:15], 16) for d, _, _ in rows}
    size, target, taken = plain_mix([(d, s, len(t.split()), order[d]) for d, t, s in rows], 16)
    got = mixing.Mix(docs, block=16).taken().collect()
    source = {d: s for d, _, s in rows}
    assert {(x["doc_id"], x["source_size"], round(x["target"], 6), x["taken"]) for x in got} == {(d, size[s], round(target[s], 6), taken.get(d, 0)) for d, s in source.items()}


def test_mixed_documents_with_columns_of_our_names(spark, rows):
    names = {"_key": 1.5, "t_key": "x", "words": "y", "text_hash": 3, "size": None, "own_key": 2}
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, SCHEMA).withColumns({k: F.lit(v) for k, v in names.items()})
    plain = spark.createDataFrame(rows, SCHEMA)
    mixed, want = mixing.mixed_documents(docs, block=16), mixing.mixed_documents(plain, block=16)
    assert mixed.columns == docs.columns
    assert sorted(map(str, mixed.select(plain.columns).collect())) == sorted(map(str, want.collect()))
    assert {(r["_key"], r["t_key"], r["words"]) for r in mixed.collect()} == {(1.5, "x", "y")}


def test_mix_slots_are_spread(spark):
    got = mixing.schedule(spark, [50_000, 30_000, 0, 20_000], 10).collect()
    assert len({r["slot"] for r in got}) == len(got) == 10_000
    for src, n in ((0, 5000), (1, 3000), (3, 2000)):
        own = sorted((r["slot"], r["rank"]) for r in got if r["src"] == src)
        assert [r for _, r in own] == list(range(n)) and max(abs(s * n / 10_000 - r) for s, r in own) < 8


def test_exact_dedup(spark, docs, rows, none):
    groups = {}
    for x in rows:
        groups.setdefault(low(x[1]), []).append(x[0])
    want = sorted((x[0], max(g), len(g), x[0] == max(g), hashlib.sha256(low(x[1]).encode()).hexdigest()) for x in rows for g in [groups[low(x[1])]])
    assert sorted(tuple(r) for r in exact_dedup.exact_groups(docs).collect()) == want
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {max(g) for g in groups.values()}
    assert {r["keep_id"] for r in exact_dedup.exact_groups(docs, keep="smallest").collect()} == {min(g) for g in groups.values()}
    assert exact_dedup.exact_groups(none).count() == 0


TIES = [(1, "X x x", 1), (1, "Y y y", 2), (5, "Y Y Y", 3), (7, "Z z", 4), (7, "Z z", 5), (None, "Y y y", 6), (None, "only here", 7), (None, "only here", 8), (3, None, 9), (4, "", 10), (None, "", 11)]


@pytest.mark.parametrize("parts", [1, 4])
def test_drop_copies_leaves_one_of_each_text(spark, parts):
    """Shared, missing and repeated identifiers; columns of our names."""
    docs = spark.createDataFrame(TIES, "doc_id long, text string, sha int").repartition(parts).selectExpr("*", "doc_id AS id0", "text AS c0")
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    kept = sorted((low(r["text"]), r["doc_id"], r["sha"]) for r in got.collect())
    assert [(t, d) for t, d, _ in kept] == [("", 4), ("only here", None), ("x x x", 1), ("y y y", 5), ("z z", 7)] and kept[1][2] in (7, 8) and kept[4][2] in (4, 5)
    assert sorted((r["keep_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs).collect() if r["doc_id"] == 1) == [(1, 1), (5, 3)]


def test_exact_groups_deal_a_hot_text(spark, monkeypatch):
    """Texts with more than a part in 3 of the rows are dealt to several salts, with the same result."""
    hot = common.hot_keys
    monkeypatch.setattr(exact_dedup, "hot_keys", lambda counts, keys: hot(counts, keys, 3))
    rows = [(i, "hot" if i % 2 else f"text {i // 4}") for i in range(60)] + [(None, "HOT")] * 20
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == 80 and {(r["keep_id"], r["group_size"]) for r in got if r["doc_id"] is None or r["doc_id"] % 2} == {(59, 50)}


def test_drop_near_copies_leaves_one_of_each_component(spark):
    """A near copy goes whatever identifiers it and others have; texts without words and different texts of one identifier stay."""
    r = random.Random(2)
    a, b = prose(r, 100), prose(r, 100)
    near = lambda t: t + " more"
    rows = [(2, a, 1), (None, near(a), 2), (None, b, 3), (9, near(b), 4), (9, near(b), 5), (None, "lonely text", 6), (1, "one", 7), (1, "two", 8), (6, "", 9), (6, None, 10), (None, " ", 11), (None, None, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, body int").repartition(4)
    got = ngram_join.drop_near_copies(docs)
    assert got.columns == docs.columns
    kept = sorted(x["body"] for x in got.collect())
    assert [x for x in kept if x not in (4, 5, 9, 10)] == [1, 6, 7, 8, 11, 12] and len(set(kept) & {4, 5}) == 1 and len(set(kept) & {9, 10}) == 1
    join = ngram_join.NgramJoin(docs)
    parts_of = [(x["doc_id"], x["component_id"]) for x in join.components().collect()]
    assert sorted(parts_of, key=str) == sorted([(2, 2), (None, 2), (None, 9), (9, 9), (9, 9), (None, None), (1, 1), (1, 1), (6, 6), (6, 6), (None, None), (None, None)], key=str)
    assert exact_dedup.drop_copies(spark.createDataFrame([], docs.schema)).count() == 0


@pytest.mark.parametrize("budget", [None, 900, 4000])
def test_trie_spills(budget):
    r = random.Random(budget)
    keys = [bytes(r.choices(b"ab", k=r.randint(0, 6))) * r.choice([1, 1, 40]) for _ in range(400)]
    trie, want = exact_dedup.PatriciaTrie(True, budget), {}
    for i, k in enumerate(keys):
        trie.insert(k, i)
        want[k] = (i, want.get(k, (0, 0))[1] + 1)
    assert {k: (o, n) for k, o, n in trie.items()} == want


def plain_shard(key, shards):
    """The descent in plain Python: at each level the child with the least draw."""

    def draw(level, child, weight):
        name = f"{'null' if key is None else key}/{level}/{child}"
        u = (int(hashlib.md5(name.encode()).hexdigest()[:13], 16) + 0.5) / 16**13
        return -np.log(u) / weight

    for level in ("region", "rack", "shard"):
        weights = {}
        for s in shards:
            weights[getattr(s, level)] = weights.get(getattr(s, level), 0) + s.weight
        taken = min(weights, key=lambda c: draw(level, c, weights[c])) if len(weights) > 1 else next(iter(weights))
        shards = [s for s in shards if getattr(s, level) == taken]
    return shards[0].shard


def test_sharding(spark, docs, rows, none):
    """Against the plain descent; rows without identifier too, and a table with a column of our names."""
    extra = spark.createDataFrame([(None, "no key", "en", None, 1, "x"), (None, "no key", "en", None, 1, "x")], SCHEMA)
    got = sharding.assign(docs.unionByName(extra).selectExpr("*", "1 AS shard", "2 AS size", "3 AS _draw0")).collect()
    assert len(got) == len(rows) + 2
    for s in range(8):
        own = sorted((r["slot"], r["doc_id"] if r["doc_id"] is not None else -1) for r in got if r["shard"] == s)
        assert [x for x, _ in own] == list(range(len(own))) and [d for _, d in own] == sorted(d for _, d in own)
    text = {x[0]: x[1] or "" for x in rows} | {None: "no key"}
    base, grown = sharding.topology(8), sharding.topology(9, planned=8)
    for r in got:
        b = text[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(b) + 1, zlib.crc32(b), "key")
        assert (r["shard"], r["grown_shard"]) == (plain_shard(r["doc_id"], base), plain_shard(r["doc_id"], grown))
        assert r["grown_shard"] in (r["shard"], 8)
    assert sharding.assign(none).count() == 0


@pytest.mark.parametrize("planned", [3, 8])
def test_one_more_shard_takes_rows_for_itself_only(spark, planned):
    df = spark.range(20_000)
    for n in (planned, planned + 1, planned + 4):
        for i in (n, n + 1):
            df = sharding.place(df, "id", sharding.topology(i, planned=planned), f"s{n}_{i}")
    got = df.collect()
    for n in (planned, planned + 1, planned + 4):
        a, b = [r[f"s{n}_{n}"] for r in got], [r[f"s{n}_{n + 1}"] for r in got]
        assert all(x == y or y == n for x, y in zip(a, b)) and abs(b.count(n) / len(got) - 1 / (n + 1)) < 0.02


def test_weights_move_keys_within_changed_subtrees_only(spark):
    df = spark.range(20_000)
    tree = sharding.topology(11)
    heavier = [sharding.Shard(s.region, s.rack, s.shard, 3.0 if s.shard == 5 else s.weight) for s in tree]
    where = {s.shard: s for s in tree}
    got = sharding.place(sharding.place(df, "id", tree, "a"), "id", heavier, "b").collect()
    for x, y in ((where[r["a"]], where[r["b"]]) for r in got if r["a"] != r["b"]):
        own = where[5]
        if x.region != y.region:
            assert y.region == own.region
        elif x.rack != y.rack:
            assert y.rack == own.rack
        else:
            assert y.shard == 5
    share = np.bincount([r["b"] for r in got], minlength=11) / len(got)
    assert abs(share[5] - 3 / 13) < 0.02 and abs(share - 1 / 13)[[0, 1, 2, 10]].max() < 0.02


def test_write_shards(spark, docs, rows, tmp_path):
    sharding.write_shards(docs, f"file://{tmp_path}/s", 3, file_bytes=2000)
    got = spark.read.parquet(f"file://{tmp_path}/s")
    assert got.count() == len(rows) and {(r["doc_id"], r["shard"]) for r in got.collect()} == {(x[0], plain_shard(x[0], sharding.topology(3))) for x in rows}
    with pytest.raises(ValueError):
        sharding.write_shards(docs.withColumn("Shard", docs["h"]), f"file://{tmp_path}/t")


def test_packing(spark, docs, rows, none):
    got = packing.pack(packing.pieces(docs, capacity=64), capacity=64).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    tok = tokens.Encoder(tokens.tokenizer_path()).tokenizer
    want = {}
    for x in rows:
        want.setdefault(x[0], []).append(np.array(tok.encode(x[1] or "", add_special_tokens=False).ids + [0], "<u4"))
    for d, ids in want.items():
        own = sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[d])
        n = len(ids[0])
        first = (n - 1) % 64 + 1
        cuts = [0, *range(first, n + 1, 64)]
        assert own == sorted((i, a, b - a, zlib.crc32(ids[0][a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:])) for _ in ids)
    for v in by_seq.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 64
    assert len(by_seq) <= 1.03 * sum(r["length"] for r in got) / 64 + 2
    named = packing.pack(packing.pieces(docs, capacity=64).selectExpr("*", "1 AS before_rows", "'x' AS _length", "2 AS row"), capacity=64)
    assert named.columns[5:8] == ["before_rows", "_length", "row"] and {tuple(r)[5:8] for r in named.collect()} == {(1, "x", 2)} and named.count() == len(got)
    assert packing.pack(packing.pieces(none)).count() == 0


def test_plan_places_each_piece_once():
    r = random.Random(4)
    for trial in range(20):
        counts = {r.randint(1, 100): r.randint(1, 50) for _ in range(r.randint(1, 60))}
        plan = packing.best_plan(counts, 100)
        seen, used = {}, {}
        for length, lo, n, seq, offset in plan.runs:
            for i in range(n):
                assert (length, lo + i) not in seen
                seen[length, lo + i] = 1
                used.setdefault(seq + i, []).append((offset, length))
        assert len(seen) == sum(counts.values()) and len(used) == plan.sequences
        for v in used.values():
            ends = [0]
            for o, n in sorted(v):
                assert o == ends[-1]
                ends.append(o + n)
            assert ends[-1] <= 100


@pytest.mark.parametrize("module, name", [(ngram_join, "op2_ngram_join"), (ngram_join, "op2_ngram_links"), (mixing, "op7_mixing"), (exact_dedup, "op8_exact_dedup"), (sharding, "op9_sharding")])
def test_queries_against_sql(spark, module, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    want = con.execute(module.ORACLES[name])
    columns = [c[0] for c in want.description]
    df = module.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(columns).collect())) == sorted(want.fetchall())


def test_missing_identifiers(spark, tmp_path):
    """Rows without identifier come first in token files and last in suffix order; they are stored, mixed, placed and packed like others."""
    r = random.Random(12)
    a, b = prose(r, 60), prose(r, 60)
    rows = [(None, a), (3, a), (None, b), (None, b), (5, ""), (6, None)]
    docs = spark.createDataFrame([(d, t, "s", "x") for d, t in rows], "doc_id long, text string, source string, key string").repartition(3)
    tok = fresh_tokenizer()
    n = {t: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows}
    files = token_files.TokenFiles.write(docs, f"file://{tmp_path}/t").digests().collect()
    assert [(x["doc_id"], x["n_tokens"]) for x in sorted(files, key=lambda x: x["start"])][-3:] == [(3, n[a]), (5, 1), (6, 1)]
    assert sorted(x["n_tokens"] for x in files if x["doc_id"] is None) == sorted([n[a], n[b], n[b]])
    media = audio.extract(audio.encode(docs)).collect()
    assert sorted(x["n_bytes"] for x in media if x["doc_id"] is None) == sorted([len(a.encode()), len(b.encode()), len(b.encode())]) and len(media) == 6
    cut = sorted(((x["doc_id"], x["n_bytes"], x["n_removed"]) for x in suffix_dedup.SuffixDedup(docs).documents().collect()), key=str)
    assert cut == sorted([(None, len(a.encode()), len(a.encode())), (3, len(a.encode()), 0), *[(None, len(b.encode()), 0)] * 2, (5, 0, 0), (6, 0, 0)], key=str)
    taken = mixing.Mix(docs, block=16).taken().collect()
    assert len(taken) == 6 and sum(x["taken"] for x in taken) in range(357, 361) and all(x["taken"] <= 2 * x["size"] for x in taken)
    packed = packing.pack(packing.pieces(docs)).collect()
    assert len(packed) == 6 and len({(x["sequence_id"], x["offset"]) for x in packed}) == 6
    groups = {(x["doc_id"], x["keep_id"], x["group_size"]) for x in exact_dedup.exact_groups(docs).collect()}
    assert groups == {(None, 3, 2), (3, 3, 2), (None, None, 2), (5, 6, 2), (6, 6, 2)}
