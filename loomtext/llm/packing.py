"""Best-fit packing by the linear grouping scheme.

Only the number of pieces of each length (one row for each length up to the sequence's, so a bounded table) comes to the driver. There the
large lengths are dealt in descending order to groups of equal cardinality and rounded up to their group's largest; a linear program over
the few sizes, solved by column generation, gives configurations and how often to use each; real lengths take the places of the rounded
ones; what is left over and all small lengths go best-fit into the room that remains. The plan speaks of runs: the n next pieces of a length
go, one each, to n sequences that follow each other, at the same offset. Every piece then finds its sequence from its rank among the pieces
of its length, without meeting any other piece.

Documents: null and empty texts have the end id alone. Documents of more ids than a sequence has are cut: whole sequences, and the first
piece has the rest. Rows with equal identifiers are packed as rows of their own. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import tokens
from .common import documents, materialize, running, shares


@dataclass
class Plan:
    """Runs: (length, first rank, number, first sequence, offset)."""

    capacity: int
    sequences: int = 0
    runs: list[tuple[int, int, int, int, int]] = field(default_factory=list)


@dataclass
class _Bins:
    first: int
    n: int
    used: int


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 2000) -> list[tuple[dict[int, int], int]]:
    """Patterns (place in sizes -> copies) and how many whole times each is used by the linear program's basic solution. rounds: new columns
    at most; the solution that is there then is taken, which is as valid, but may use more sequences."""
    m = len(sizes)
    s, d = np.array(sizes), np.array(demand, float)
    basis = [{j: int(capacity // s[j])} for j in range(m)]
    inverse = np.diag([1.0 / b[j] for j, b in enumerate(basis)])
    x = inverse @ d
    smallest = int(s.min())
    for _ in range(rounds):
        y = inverse.sum(axis=0)
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(smallest, capacity + 1):
            own = s <= c
            gain = np.where(own, best[np.maximum(c - s, 0)] + y, -1.0)
            j = int(gain.argmax())
            if gain[j] > best[c - 1] + 1e-12:
                best[c], pick[c] = gain[j], j
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        pattern, c = {}, capacity
        while c >= smallest:
            if pick[c] < 0:
                c -= 1
                continue
            j = int(pick[c])
            pattern[j] = pattern.get(j, 0) + 1
            c -= int(s[j])
        column = np.zeros(m)
        column[list(pattern)] = list(pattern.values())
        u = inverse @ column
        ratio = np.where(u > 1e-9, x / np.where(u > 1e-9, u, 1), np.inf)
        i = int(ratio.argmin())
        if not np.isfinite(ratio[i]):
            break
        x = x - ratio[i] * u
        x[i] = ratio[i]
        row = inverse[i] / u[i]
        inverse = inverse - np.outer(u, row)
        inverse[i] = row
        basis[i] = pattern
    out, left = [], list(demand)
    for pattern, n in zip(basis, x):
        n = min([int(n + 1e-6), *(left[j] // k for j, k in pattern.items())])
        if n > 0:
            out.append((pattern, n))
            for j, k in pattern.items():
                left[j] -= n * k
    return out


#: Where large lengths begin, as parts of a sequence, and how many groups they are dealt to.
GRAINS = ((0.5, 64), (0.4, 64), (0.25, 32))


def best_plan(counts: dict[int, int], capacity: int, grains: tuple[tuple[float, int], ...] = GRAINS) -> Plan:
    """The scheme's plan at the grain that needs the fewest sequences."""
    return min((make_plan(counts, capacity, groups, int(part * capacity)) for part, groups in grains), key=lambda p: p.sequences)


def make_plan(counts: dict[int, int], capacity: int, groups: int, small: int) -> Plan:
    """counts: pieces of each length from 1 to capacity. Lengths up to small go best-fit only."""
    plan = Plan(capacity)
    taken = dict.fromkeys(counts, 0)
    rooms: list[list[_Bins]] = [[] for _ in range(capacity + 1)]
    mask = 0

    def put(b: _Bins) -> None:
        nonlocal mask
        if b.n and b.used < capacity:
            rooms[capacity - b.used].append(b)
            mask |= 1 << (capacity - b.used)

    def place(length: int, b: _Bins, copies: int) -> _Bins:
        """copies pieces of a length into each of the bins."""
        for k in range(copies):
            plan.runs.append((length, taken[length], b.n, b.first, b.used + k * length))
            taken[length] += b.n
        return _Bins(b.first, b.n, b.used + copies * length)

    def split(b: _Bins, n: int) -> tuple[_Bins, _Bins]:
        return _Bins(b.first, n, b.used), _Bins(b.first + n, b.n - n, b.used)

    large = sorted((n for n in counts if small < n < capacity), reverse=True)
    if full := counts.get(capacity, 0):
        place(capacity, _Bins(0, full, 0), 1)
        plan.sequences = full
    sizes: list[int] = []
    members: list[list[list[int]]] = []  # of each size: [length, number left], descending
    if large:
        per_group = -(-sum(counts[n] for n in large) // groups)
        room = 0
        for n in large:
            todo = counts[n]
            while todo:
                if not room:
                    room = per_group
                    if not sizes or sizes[-1] != n:
                        sizes.append(n)
                        members.append([])
                now = min(room, todo)
                if members[-1] and members[-1][-1][0] == n:
                    members[-1][-1][1] += now
                else:
                    members[-1].append([n, now])
                room, todo = room - now, todo - now
        demand = [sum(k for _, k in g) for g in members]
        for pattern, n in configurations(sizes, demand, capacity):
            bins = [_Bins(plan.sequences, n, 0)]
            plan.sequences += n
            for j in sorted(j for j, k in pattern.items() for _ in range(k)):
                done = []
                for b in bins:
                    while b.n:
                        length, k = members[j][0]
                        own, b = split(b, min(b.n, k))
                        done.append(place(length, own, 1))
                        members[j][0][1] -= own.n
                        if not members[j][0][1]:
                            members[j].pop(0)
                bins = done
            for b in bins:
                put(b)
    for length in sorted((n for n in counts if n < capacity), reverse=True):
        todo = counts[length] - taken[length]
        while todo:
            fits = mask >> length
            if not fits:
                n = -(-todo // (capacity // length))
                put(_Bins(plan.sequences, n, 0))
                plan.sequences += n
                continue
            r = length + (fits & -fits).bit_length() - 1
            b = rooms[r].pop()
            if not rooms[r]:
                mask &= ~(1 << r)
            each = r // length
            some, rest = split(b, min(b.n, todo // each))
            if some.n:
                put(place(length, some, each))
                todo -= some.n * each
            if rest.n and 0 < todo < each:
                last, rest = split(rest, 1)
                put(place(length, last, todo))
                todo = 0
            put(rest)
    return plan


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(starts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For documents' starts among their ids: each piece's row, its number within the row, and the pieces' starts with the last one's end."""
    n = np.diff(starts)
    pieces = -(-n // capacity)
    row = np.repeat(np.arange(len(n)), pieces)
    number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = n - (pieces - 1) * capacity
    at = starts[:-1][row] + np.where(number > 0, first[row] + (number - 1) * capacity, 0)
    return row, number, np.concatenate([at, starts[-1:]])


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece, in no order; with_ids adds the ids themselves (little-endian unsigned 32-bit integers)."""

    def run(batches):
        enc = tokens.encoder(tokens.tokenizer_path(tokenizer))
        for batch in batches:
            for some in shares(batch, 1):
                ids, starts = enc.encode(some.column(1), end_id)
                row, number, at = cut(starts, capacity)
                keys = some.column(0).take(pa.array(row))
                columns = [keys, pa.array(number.astype(np.int32)), pa.array(at[:-1] - starts[:-1][row]), pa.array(np.diff(at)), pa.array(tokens.crc32s(ids, at))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    raw = ids.astype("<u4").tobytes()
                    columns.append(pa.array([raw[4 * a : 4 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, PIECES + ", ids binary" * with_ids)


def pack(cut_pieces: DataFrame, capacity: int = 2048, grains: tuple[tuple[float, int], ...] = GRAINS) -> DataFrame:
    """Adds sequence_id and offset to rows of pieces(); all their other columns stay."""
    cut_pieces = materialize(cut_pieces, "pieces")
    counts = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan = best_plan(counts, capacity, grains)
    runs = np.array(sorted(plan.runs), np.int64).reshape(-1, 5)
    span, at = 1 << 44, cut_pieces.columns.index("length")
    keys = runs[:, 0] * span + runs[:, 1]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rank = batch.column(batch.num_columns - 1).to_numpy()
            length = batch.column(at).to_numpy()
            r = np.searchsorted(keys, length * span + rank, side="right") - 1
            columns = [*batch.columns[:-1], pa.array(runs[r, 3] + rank - runs[r, 1]), pa.array(runs[r, 4])]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{i}" for i in range(len(columns))])

    # the pieces' own columns travel as one, so that none of their names clashes
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in cut_pieces.columns]
    rows = cut_pieces.select(F.struct(*cut_pieces.columns).alias("row"), F.col("length").cast("int").alias("length"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    ranked = running(rows, "length", [f"o{i}" for i in range(len(order))], "length", "ranks")
    ranked = ranked.select("row.*", F.col("before_rows").alias("before_rows"))
    fields = [*cut_pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    schema = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])
    plain = ranked.toDF(*[f"c{i}" for i in range(len(cut_pieces.columns))], "before_rows")
    return plain.mapInArrow(run, schema).toDF(*[f.name for f in fields])


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(documents(spark, sf_dir)))


QUERIES = {"op10_packing": op10_packing}
ORACLES: dict[str, str] = {}
