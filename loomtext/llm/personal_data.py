"""Personal data by weak supervision.

Strict forms of four kinds (e-mail addresses, IP addresses, card numbers, telephone numbers) are always found. Wider forms of each kind are
candidates: addresses with "at" and "dot" in words or without a dotted domain, numbers with other separators or without a plus sign, chains
that miss a checksum or a range, IP addresses of version 6. Six labelers look at every candidate, strict ones included, and vote for it, against
it or not at all: the strict form; the structure (checksum, ranges, number of digits); a gazetteer (top-level domains, country codes, card
issuers, reserved networks); words around it; its grouping; and whether it is part of a longer word. How often each vote is cast over whole
tables is counted by vote pattern, a table of at most 4 * 729 rows; expectation-maximisation on these counts estimates how reliable
each labeler is for each kind, and how probable each pattern makes a candidate. With these probabilities as labels a logistic span classifier
is trained on a bounded sample of candidates (per_kind of each kind, those of least hash), over votes, shapes and words around; it decides which
candidates are added. Of added candidates that overlap, the most probable stays (then the first, then the kind listed first).

One scan reads the texts and leaves a row for each document with its spans and candidates; classifying reads those rows, and nothing is
shuffled but counts and the sample. All forms are matched in time linear in the text, but for lookups within bounded windows.

Nulls: a null text is empty and has no spans; a null identifier stays null, and repeated rows are answered each. Without candidates nothing is
added. Empty tables give empty results. Columns of other names take no part.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, least_hashed, materialize, slices, text_bytes

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


DIGITS = b"0123456789"
LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
LOCAL = _class(LETTERS + DIGITS + b"._%+-")
HEX = _class(DIGITS + b"ABCDEFabcdef")
ALNUM = _class(LETTERS + DIGITS)
DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
PHONE_FORM = re.compile(rb"\+[0-9][ ().0-9-]+[0-9]")
#: An address spelt in words, from behind its local part.
SPELT = re.compile(rb"(?: at | ?[\[({] ?(?:at|@) ?[\])}] ?)([A-Za-z0-9-]{1,63}(?:(?: dot | ?[\[({] ?(?:dot|\.) ?[\])}] ?|\.)[A-Za-z0-9-]{1,63})+)")
HOST = re.compile(rb"[A-Za-z0-9-]{1,63}")
SIX = re.compile(rb"(?:[0-9A-Fa-f]{1,4}:){2,7}(?::|(?::?[0-9A-Fa-f]{1,4}){1,7})")

#: The gazetteers and the words around, in lower case.
DOMAINS = frozenset("com org net edu gov int info biz io eu de fr es it uk us ca at ch be nl pl pt br cn jp kr in ru au".split())
COUNTRIES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 54 55 56 57 60 61 62 63 64 65 66 81 82 84 86 90 91 92 351 352 353 358 420 852 886 971 972".split())
ISSUERS = ("34", "37", "35", "36", "4", "51", "52", "53", "54", "55", "6011", "62", "65", "22", "23", "24", "25", "26", "27")
RESERVED = (0, 127, 255, *range(224, 255))
FOR = (
    frozenset("email e-mail mail contact address write correo courriel".split()),
    frozenset("ip host server address login client proxy".split()),
    frozenset("card credit visa mastercard amex payment debit carte karte tarjeta".split()),
    frozenset("phone tel telephone call mobile cell fax telefon teléfono téléphone".split()),
)
AGAINST = frozenset("version v release isbn issn order invoice token hash key sha md5 build page section chapter figure row id no total sum".split())


def luhn(digits: bytes) -> bool:
    at = np.frombuffer(digits, np.uint8)[::-1].astype(np.int64) - 48
    at[1::2] *= 2
    return int((at - 9 * (at > 9)).sum()) % 10 == 0


def _small(part: bytes) -> bool:
    part = part.lstrip(b"0")
    return len(part) < 3 or len(part) == 3 and int(part) < 256


def _chains(s: np.ndarray, e: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last runs of digits of each chain; joined[i]: run i + 1 goes on with run i."""
    if not len(s):
        return s, e
    cut = np.flatnonzero(~joined)
    return np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(s) - 1]])


@dataclass
class Found:
    """Spans of bytes in texts that lie end to end, a byte of line feed behind each: (start, kind, end)."""

    base: list[tuple[int, int, int]] = field(default_factory=list)
    wide: list[tuple[int, int, int]] = field(default_factory=list)


def find(data: np.ndarray) -> Found:
    """Strict spans and wider candidates. No form has a line feed, so none reaches from one text into the next."""
    raw, out = data.tobytes(), Found()
    digit = (data >= 48) & (data <= 57)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], digit, [False]]).astype(np.int8)))
    s, e = edge[::2], edge[1::2]
    gap = s[1:] - e[:-1]
    between = data[e[:-1]] if len(s) > 1 else np.zeros(0, np.uint8)
    dotted, spaced = (gap == 1) & (between == 46), (gap == 1) & ((between == 32) | (between == 45))
    digits = np.concatenate([[0], np.cumsum(e - s)])

    first, last = _chains(s, e, dotted)
    for a, z in zip(first[last - first >= 3].tolist(), last[last - first >= 3].tolist()):
        for i in range(a, z - 2, 4):
            parts = [raw[s[j] : e[j]] for j in range(i, i + 4)]
            (out.base if all(map(_small, parts)) else out.wide).append((int(s[i]), IP, int(e[i + 3])))
    first, last = _chains(s, e, spaced)
    n = digits[last + 1] - digits[first] if len(s) else first
    for a, z in zip(first[(n >= 12) & (n <= 19)].tolist(), last[(n >= 12) & (n <= 19)].tolist()):
        good = luhn(b"".join(raw[s[j] : e[j]] for j in range(a, z + 1)))
        (out.base if good else out.wide).append((int(s[a]), CARD, int(e[z])))
    for m in PHONE_FORM.finditer(raw):
        good = 9 <= int(digit[m.start() : m.end()].sum()) <= 15
        (out.base if good else out.wide).append((m.start(), PHONE, m.end()))
    end = 0
    for at in np.flatnonzero(data == 64).tolist():
        start = _back(data, at, end, at)
        if start == at:
            continue
        if m := DOMAIN.match(raw, at + 1):
            end = m.end()
            out.base.append((start, EMAIL, end))
        elif m := HOST.match(raw, at + 1):
            out.wide.append((start, EMAIL, m.end()))

    # wider forms
    for m in SPELT.finditer(raw):
        start = _back(data, m.start(), m.start() - 64, m.start())
        if start < m.start() and (b"dot" in m.group() or b"." in m.group(1) or m.group(0)[:4] != b" at "):
            out.wide.append((start, EMAIL, m.end()))
    loose = np.zeros(len(gap), bool)
    near = np.flatnonzero((gap == 1) | (gap == 2))
    if len(near):
        sep = _class(b" ().-/")
        loose[near] = sep[data[e[near]]] & sep[data[s[near + 1] - 1]]
    first, last = _chains(s, e, loose)
    n = digits[last + 1] - digits[first] if len(s) else first
    for a, z in zip(first[(n >= 7) & (n <= 19)].tolist(), last[(n >= 7) & (n <= 19)].tolist()):
        start, end, count = int(s[a]), int(e[z]), int(digits[z + 1] - digits[a])
        start -= start > 0 and raw[start - 1] == 40  # an opening bracket
        if count <= 15:
            out.wide.append((start, PHONE, end))
        if count >= 12:
            out.wide.append((int(s[a]), CARD, end))
    colon = np.flatnonzero(data == 58)
    close = colon[:-1][np.diff(colon) <= 5]
    end = 0
    for at in close.tolist():
        start = _back(data, at, max(end, at - 4), at, HEX)
        if start < at and at >= end and (m := SIX.match(raw, start, start + 48)):
            end = m.end()
            out.wide.append((start, IP, end))
    return out


def _back(data: np.ndarray, at: int, least: int, default: int, chars: np.ndarray = LOCAL) -> int:
    """Where the run of chars that ends before at begins, not before least."""
    start, least = default, max(least, 0)
    while start > least and chars[data[start - 1]]:
        start -= 1
    return start


LABELERS = 6
#: Features of a candidate: a vote of each labeler, then one of each of these groups (name, size).
GROUPS = (("length", 8), ("digits", 8), ("parts", 6), ("separator", 6), ("before", 5), ("after", 5), ("first", 4), ("word1", 64), ("word2", 64))
FIRST_OF = np.cumsum([3] * LABELERS + [n for _, n in GROUPS]) - np.array([3] * LABELERS + [n for _, n in GROUPS])
FEATURES = int(FIRST_OF[-1]) + GROUPS[-1][1]
WIDTH = LABELERS + len(GROUPS)
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _kind_of_char(raw: bytes, at: int) -> int:
    if at < 0 or at >= len(raw) or raw[at] in b" \n\t\r":
        return 0
    c = raw[at]
    return 1 if ALNUM[c] or c >= 128 else 2 if c in b".,;:!?" else 3 if c in b"()[]<>\"'" else 4


def describe(raw: bytes, kind: int, start: int, end: int, base: bool) -> list[int]:
    """The features of a candidate; the first ones are its votes: 3 * labeler + vote + 1."""
    body = raw[start:end]
    runs = re.findall(rb"[0-9]+", body)
    digits = b"".join(runs)
    line = raw.rfind(b"\n", max(0, start - 48), start) + 1
    head = raw[max(line, start - 48, 0) : start].lower()
    tail = raw[end : end + 24].split(b"\n")[0].lower()
    around = WORDS.findall(head)[-3:]
    words = {w.decode("utf-8", "ignore") for w in [*around, *WORDS.findall(tail)[:1]]}
    before, after = _kind_of_char(raw, start - 1), _kind_of_char(raw, end)
    vote = [1 if base else 0, 0, 0, 0, 0, 0]
    if words & FOR[kind]:
        vote[3] = 1
    elif words & AGAINST or any(words & FOR[k] for k in range(4) if k != kind):
        vote[3] = -1
    glued = before in (1, 4) or after in (1, 4) or before == 2 and kind != EMAIL and raw[start - 1 : start] in b".,:"
    vote[5] = -1 if glued else 1
    if kind == EMAIL:
        labels = re.split(rb" dot |[ \[\](){}]+(?:dot|\.)[ \[\](){}]+|\.", re.split(rb"@| at |[\[({] ?at ?[\])}]", body)[-1])
        vote[1] = 1 if len(labels) > 1 else -1
        vote[2] = 1 if labels[-1].decode("latin-1").strip().lower() in DOMAINS else -1
        vote[4] = -1 if body[:1] in b".-+%" or len(body) > 100 else 1
    elif kind == IP:
        six = b":" in body
        vote[1] = (1 if 3 <= body.count(b":") <= 7 else -1) if six else 1 if len(runs) == 4 and all(map(_small, runs)) else -1
        vote[2] = 0 if six else -1 if not _small(runs[0]) or int(runs[0]) in RESERVED else 1
        vote[4] = (1 if re.search(rb"[A-Fa-f]", body) and re.search(rb"[0-9]", body) else -1) if six else -1 if any(len(r) > 1 and r[:1] == b"0" for r in runs) else 1
    elif kind == CARD:
        vote[1] = 1 if luhn(digits) else -1
        vote[2] = 1 if digits.startswith(tuple(x.encode() for x in ISSUERS)) else -1
        sizes = [len(r) for r in runs]
        vote[4] = 1 if sizes in ([4, 4, 4, 4], [4, 6, 5], [16], [15]) else -1
    else:
        vote[1] = 1 if 9 <= len(digits) <= 15 else -1
        plain = digits[2:] if digits.startswith(b"00") else digits
        lead = body.startswith((b"+", b"00"))
        vote[2] = 0 if not lead else 1 if any(plain[:k].decode() in COUNTRIES for k in (1, 2, 3)) else -1
        vote[4] = -1 if len(runs) == 1 else 1 if b"(" in body or 3 <= len(runs) <= 5 else 0
    sep = re.sub(rb"[0-9A-Za-z]+", b"", body)
    shape = [
        min(len(body) // 4, 7), min(len(digits) // 3, 7), min(len(runs), 5), 0 if not sep else 1 + next((i for i, c in enumerate(b" -.(") if c in sep), 4),
        before, after, 0 if body[:1] == b"+" else 1 if body[:1] == b"(" else 2 if digit_first(body) else 3,
        *[zlib.crc32(w) % 64 for w in ([b"", b"", *around])[-1:-3:-1]],
    ]
    return [int(FIRST_OF[i] + v) for i, v in enumerate([*[v + 1 for v in vote], *shape])]


def digit_first(body: bytes) -> bool:
    return body[:1].isdigit()


@dataclass
class Document:
    """Spans of a text: (start, kind, end) in code points, the candidates' features."""

    base: list[tuple[int, int, int]]
    candidates: list[tuple[int, int, int]]
    strict: list[bool]
    features: list[list[int]]


def examine(column: pa.Array):
    """A Document for each text."""
    data, at = text_bytes(column)
    for lo, hi in slices(at):
        n = at[lo + 1 : hi + 1] - at[lo:hi]
        own = np.full(int(n.sum()) + hi - lo, 10, np.uint8)
        starts = np.cumsum(n + 1) - (n + 1)
        own[np.arange(int(n.sum())) + np.repeat(np.arange(hi - lo), n)] = data[at[lo] : at[hi]]
        # a text's own line feeds end words as they should; those behind texts keep spans apart
        found, raw = find(own), own.tobytes()
        base = sorted(found.base)
        ends, free = np.array(sorted((a, b) for a, _, b in base), np.int64).reshape(-1, 2), []
        known = np.maximum.accumulate(ends[:, 1]) if len(ends) else ends[:, 0]
        for a, k, b in dict.fromkeys(sorted(found.wide)):
            i = int(np.searchsorted(ends[:, 0], b)) - 1
            if i < 0 or known[i] <= a:  # a strict span stays as it is
                free.append((a, k, b))
        rest = np.flatnonzero((own & 0xC0) == 0x80)
        points = lambda x: x - np.searchsorted(rest, x)
        every = [(*x, True) for x in base] + [(*x, False) for x in free]
        spots = np.array([(a, b) for a, _, b, _ in every], np.int64).reshape(-1, 2)
        row = np.searchsorted(starts, spots[:, 0], side="right") - 1
        first = points(starts[row]) if len(row) else row
        p = np.column_stack([points(spots[:, 0]) - first, points(spots[:, 1]) - first])
        docs = [Document([], [], [], []) for _ in range(hi - lo)]
        for (a, k, b, strict), r, (x, y) in zip(every, row.tolist(), p.tolist()):
            d = docs[r]
            if strict:
                d.base.append((x, k, y))
            d.candidates.append((x, k, y))
            d.strict.append(strict)
            d.features.append(describe(raw, k, a, b, strict))
        yield from docs


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def codes(features: np.ndarray) -> np.ndarray:
    """The vote pattern of each row of features, a number below 3 ** 6."""
    votes = features[:, :LABELERS] - FIRST_OF[:LABELERS]
    return votes @ 3 ** np.arange(LABELERS)


ROW = "n_email long, n_ip long, n_card long, n_phone long, base string, kinds array<int>, starts array<long>, ends array<long>, strict array<boolean>, votes array<int>, features array<int>"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each document: strict spans and candidates, WIDTH features each."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                some = batch.slice(lo, 2048)
                found = list(examine(some.column(1)))
                kinds = [[k for _, k, _ in d.base] for d in found]
                votes = [codes(np.array(d.features, np.int64).reshape(-1, WIDTH)).tolist() for d in found]
                columns = [
                    some.column(0), *[pa.array([k.count(i) for k in kinds], pa.int64()) for i in range(4)], pa.array([joined(d.base) for d in found], pa.string()),
                    pa.array([[k for _, k, _ in d.candidates] for d in found], pa.list_(pa.int32())), pa.array([[a for a, _, _ in d.candidates] for d in found], pa.list_(pa.int64())),
                    pa.array([[b for _, _, b in d.candidates] for d in found], pa.list_(pa.int64())), pa.array([d.strict for d in found], pa.list_(pa.bool_())),
                    pa.array(votes, pa.list_(pa.int32())), pa.array([[x for f in d.features for x in f] for d in found], pa.list_(pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", *[f.split()[0] for f in ROW.split(", ")]])

    rows = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("t"))
    schema = T.StructType([rows.schema["id"], *T._parse_datatype_string(ROW).fields])
    return rows.mapInArrow(run, schema)


#: What the labelers are taken to do before anything was seen, as counts of votes against, none and for: of wrong and of right candidates.
PRIOR = np.array([[12.0, 6.0, 2.0], [2.0, 6.0, 12.0]])


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation for labelers that are independent given the truth. patterns: a row of votes (0, 1, 2 for against, none, for)
    for each pattern. Returns each pattern's probability, each labeler's shares of votes given the truth (2 x labelers x 3) and the share of right
    candidates."""
    n, m = patterns.shape
    hot = patterns[:, :, None] == np.arange(3)
    p = 1 / (1 + np.exp(-(patterns - 1.0).sum(axis=1)))
    tables, share = np.zeros((2, m, 3)), 0.5
    for _ in range(rounds):
        for y, w in ((0, (1 - p) * counts), (1, p * counts)):
            tables[y] = np.einsum("i,ijk->jk", w, hot) + PRIOR[y]
            tables[y] /= tables[y].sum(axis=1, keepdims=True)
        share = (float(p @ counts) + 5) / (float(counts.sum()) + 10)
        logs = [np.log(tables[y])[np.arange(m), patterns].sum(axis=1) for y in (0, 1)]
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1] + np.log(1 - share) - np.log(share), -500, 500)))
        if np.abs(new - p).max(initial=0) < 1e-9:
            break
        p = new
    return p, tables, share


def fit(features: np.ndarray, target: np.ndarray, l2: float = 1e-3, steps: int = 400) -> np.ndarray:
    """Logistic regression on probabilities as labels: WIDTH features that are on in each row, weights of all features (and the bias last), by
    accelerated gradient steps."""
    n = len(features)
    w, at, t = np.zeros(FEATURES + 1), np.zeros(FEATURES + 1), 1.0
    step = 4 / (WIDTH + 1 + 4 * l2)
    for _ in range(steps if n else 0):
        p = 1 / (1 + np.exp(-np.clip(at[features].sum(axis=1) + at[-1], -500, 500)))
        g = np.bincount(features.ravel(), np.repeat((p - target) / n, WIDTH), FEATURES + 1)
        g[-1] = (p - target).sum() / n
        g[:-1] += l2 * at[:-1]
        new, t2 = at - step * g, (1 + np.sqrt(1 + 4 * t * t)) / 2
        at, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w


@dataclass
class Model:
    """A row of weights for each kind, and what was learnt of the labelers."""

    weights: np.ndarray
    tables: list[np.ndarray]
    shares: list[float]

    def probabilities(self, kinds: np.ndarray, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.take_along_axis(self.weights[kinds], features, 1).sum(axis=1) + self.weights[kinds, -1], -500, 500)))

    def added(self, spans: list[tuple[int, int, int]], strict: list[bool], features: np.ndarray, threshold: float = 0.5) -> list[tuple[int, int, int]]:
        """The candidates to add, without overlaps."""
        wide = [i for i, x in enumerate(strict) if not x]
        if not wide:
            return []
        p = self.probabilities(np.array([spans[i][1] for i in wide]), features[wide])
        out: list[tuple[int, int, int]] = []
        for q, i in sorted((-q, i) for q, i in zip(p.tolist(), wide) if q >= threshold):
            a, k, b = spans[i]
            if all(b <= x or y <= a for x, _, y in out):
                out.append(spans[i])
        return out


def train(rows: DataFrame, per_kind: int = 10_000, seed: int = 17) -> Model:
    """rows: those of scan(). All candidates' votes are counted; per_kind candidates of each kind at most teach the classifier."""
    each = rows.select("id", F.posexplode("kinds").alias("i", "kind"), "starts", "votes", "features")
    vote = F.element_at("votes", F.col("i") + 1)
    counted = each.groupBy("kind", vote.alias("v")).agg(F.count("*").alias("n")).toArrow().to_pylist()
    tables, shares, p = [], [], {}
    for k in range(4):
        own = [r for r in counted if r["kind"] == k]
        patterns = np.array([[r["v"] // 3**j % 3 for j in range(LABELERS)] for r in own], np.int64).reshape(-1, LABELERS)
        q, table, share = reliabilities(patterns, np.array([r["n"] for r in own], float))
        tables.append(table)
        shares.append(share)
        p |= {(k, r["v"]): x for r, x in zip(own, q.tolist())}
    hashed = F.xxhash64("id", "kind", F.element_at("starts", F.col("i") + 1), F.element_at("features", F.col("i") * WIDTH + 1), "i", F.lit(seed))
    sample = least_hashed(each.select("kind", hashed.alias("h"), vote.alias("v"), F.slice("features", F.col("i") * WIDTH + 1, F.lit(WIDTH)).alias("f")), ["kind"], per_kind).to_pylist()
    weights = np.zeros((4, FEATURES + 1))
    for k in range(4):
        own = [r for r in sample if r["kind"] == k]
        weights[k] = fit(np.array([r["f"] for r in own], np.int64).reshape(-1, WIDTH), np.array([p[k, r["v"]] for r in own]))
        if not own:
            weights[k, -1] = -500
    return Model(weights, tables, shares)


def classify(rows: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """rows: those of scan(). One row per document: id, numbers of strict spans, base_sha256, spans."""

    def run(batches):
        for batch in batches:
            columns = {c: batch.column(c).to_pylist() for c in ("base", "kinds", "starts", "ends", "strict", "features")}
            spans = []
            for base, kinds, starts, ends, strict, features in zip(*columns.values()):
                if all(strict):
                    spans.append(base)
                    continue
                every = list(zip(starts, kinds, ends))
                own = model.added(every, strict, np.array(features, np.int64).reshape(-1, WIDTH), threshold)
                spans.append(joined([x for x, s in zip(every, strict) if s] + own))
            sha = [hashlib.sha256(b.encode()).hexdigest() for b in columns["base"]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=names)

    names = ["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    schema = T.StructType([*rows.schema.fields[:5], T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])
    return rows.mapInArrow(run, schema)


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", per_kind: int = 10_000, threshold: float = 0.5) -> DataFrame:
    """One row per document: key, n_email, n_ip, n_card and n_phone (strict spans), base_sha256 and spans."""
    rows = materialize(scan(docs, key, text), "spans")
    return classify(rows, train(rows, per_kind), threshold).withColumnRenamed("id", key)


def redacted(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents with all their columns, where each span, or each run of spans that overlap, is replaced by its first kind in brackets."""
    at = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            out = []
            for body, d in zip(batch.column(at).to_pylist(), examine(batch.column(at))):
                own = model.added(d.candidates, d.strict, np.array(d.features, np.int64).reshape(-1, WIDTH), threshold) if d.candidates else []
                parts, done = [], 0
                for a, k, b in sorted([*d.base, *own]):
                    if a >= done:
                        parts += [body[done:a], f"[{KINDS[k].upper()}]"]
                    done = max(done, b)
                out.append(None if body is None else "".join([*parts, body[done:]]))
            columns = list(batch.columns)
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(documents(spark, sf_dir))


QUERIES = {"op12_personal_data": op12_personal_data}
ORACLES: dict[str, str] = {}
