"""Vector arithmetic as column expressions over array columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(a), lambda x: x * x)))


def is_normalized(a: Column, tolerance: float = 1e-6) -> Column:
    return F.abs(norm(a) - 1) < tolerance


def cosine(a: Column, b: Column) -> Column:
    """0 where either has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def l2(a: Column, b: Column, squared: bool = False) -> Column:
    d = _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))
    return d if squared else F.sqrt(d)


def l1(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


def similarity_of_distance(d: Column, how: str = "inverse") -> Column:
    """inverse: 1 / (1 + d); complement: 1 - d, 0 at least; shifted: a cosine moved to 0 to 1."""
    return {"inverse": 1 / (1 + d), "complement": F.greatest(F.lit(0.0), 1 - d), "shifted": (d + 1) / 2}[how]


def bucket(x: Column, steps: list[tuple[float, str]], last: str) -> Column:
    """The name of the first step that x reaches."""
    out = F.lit(last)
    for least, name in reversed(steps):
        out = F.when(x >= least, name).otherwise(out)
    return out


COSINE_STEPS = [(0.8, "very similar"), (0.6, "similar"), (0.4, "somewhat similar")]
