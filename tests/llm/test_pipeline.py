import hashlib
import re
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline as P
from loomtext.llm import toxicity

from .test_operators import brute_components, fresh_tokenizer, low

SF = "/root/testdata/sf0.001"


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_mix(rows):
    """Which texts the mix has how often: sources are filled up by weight, each from a shuffled stream that begins again."""
    sources = {}
    for d, s, t in rows:
        sources.setdefault(s, []).append((int(hashlib.md5(f"{d}/7".encode()).hexdigest()[:15], 16), d, t, len(WORD.findall(t or ""))))
    names = sorted(sources, key=lambda s: (s is None, s or ""))
    n = {s: sum(x[3] for x in sources[s]) for s in names}
    weight, left, target = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(n.values()), {}
    while True:
        rest = [s for s in names if s not in target]
        over = [s for s in rest if left * weight[s] / sum(weight[x] for x in rest) > 2 * n[s]]
        if not over:
            target |= {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
            break
        s = min(over, key=lambda s: (2 * n[s] / weight[s], names.index(s)))
        target[s], left = 2 * n[s], left - 2 * n[s]
    out = Counter()
    for s in names:
        take = min(int(target[s] + 1e-6), 2 * n[s])
        while take > 0:
            for _, d, t, size in sorted(sources[s], key=lambda x: x[:2]):
                words = min(size, take)
                if words:
                    out[d, t if words == size else t[: list(WORD.finditer(t))[words - 1].end()]] += 1
                take -= words
    return out


def check_packing(pieces, docs, capacity=2048):
    """The pieces are the documents' ids, each once; sequences have no gaps, and are about as few as the sum of lengths allows."""
    tok, want, total = fresh_tokenizer(), Counter(), 0
    for d, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[d, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in pieces) == want
    sequences = {}
    for r in pieces:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= -(-total // capacity) * 1.02 + 1


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "ngram_join", "mixing", "packing"]
    tables = []
    for _, stage in P.STAGES[:3]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == columns
        tables.append(docs.collect())
    chain = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), toxicity.labelled(spark, SF), toxicity.CATEGORIES)
    fine = {r["doc_id"] for r in toxicity.score(spark.read.parquet(f"{SF}/documents.parquet"), chain).where("NOT toxic").collect()}
    assert {r["doc_id"] for r in tables[0]} == fine
    last = {}
    for r in tables[0]:
        last[low(r["text"])] = max(r["doc_id"], last.get(low(r["text"]), -1))
    assert {r["doc_id"] for r in tables[1]} == set(last.values())
    assert {r["doc_id"] for r in tables[2]} == {d for d, _, c in brute_components([(r["doc_id"], r["text"]) for r in tables[1]]) if d == c}
    mixed = P.mixing_stage(spark, docs, SF).persist()
    assert mixed.columns == columns
    assert Counter((r["doc_id"], r["text"]) for r in mixed.collect()) == plain_mix([(r["doc_id"], r["source"], r["text"]) for r in tables[2]])
    packed = P.packing_stage(spark, mixed, SF)
    check_packing(packed.collect(), [(r["doc_id"], r["text"]) for r in mixed.collect()])
    total = packed.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in total) <= 2048
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in mixed.select("doc_id").distinct().collect()}


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null, shared and repeated identifiers, empty texts, exact repeats, near copies; then no rows at all."""
    import random

    from .test_operators import prose

    r = random.Random(1)
    a, b = prose(r, 120), prose(r, 120)
    rows = [(1, a, "en", "s1", 1), (1, a, "en", "s1", 1), (None, a + " more", "en", None, 1), (2, b, "de", "s1", 1), (5, b.upper().lower(), "de", "s2", 1), (5, prose(r, 60), None, "s2", 1)]
    rows += [(7, None, None, None, None), (8, "", "en", "s1", 0), (9, "short", "en", "s2", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("odd", rows), ("none", [])):
        spark.createDataFrame(data, schema).write.parquet(f"file://{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/{name}/labels.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/odd/documents.parquet")
    for _, stage in P.STAGES[:3]:
        docs = stage(spark, docs, f"file://{tmp_path}/odd")
    kept = sorted(((x["doc_id"], x["text"]) for x in docs.collect()), key=str)
    assert kept == sorted([(1, a), (5, b.upper().lower()), (5, rows[5][1]), (8, ""), (9, "short")], key=str)
    got = P.run(spark, f"file://{tmp_path}/odd").collect()
    assert {x["doc_id"] for x in got} <= {1, 5, 9} and all(x["length"] <= 2048 for x in got)
    empty = P.run(spark, f"file://{tmp_path}/none")
    assert empty.count() == 0 and empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
