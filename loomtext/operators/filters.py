"""Metadata conditions as nested dicts, compiled to one column: {"label": 3}, {"$or": [{"year": {"$gte": 2020}}, ...]}.

Several keys in one dict all have to hold. A comparison with a missing value never holds, $ne included.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_OPS = {
    "$eq": lambda c, v: c == F.lit(v), "$ne": lambda c, v: c != F.lit(v), "$gt": lambda c, v: c > F.lit(v), "$gte": lambda c, v: c >= F.lit(v),
    "$lt": lambda c, v: c < F.lit(v), "$lte": lambda c, v: c <= F.lit(v), "$in": lambda c, v: c.isin(list(v)), "$nin": lambda c, v: ~c.isin(list(v)),
}


def compile_where(where: dict | None) -> Column:
    parts = [_one(k, v) for k, v in (where or {}).items()]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _one(key: str, value) -> Column:
    if key in ("$and", "$or"):
        if not value:
            raise ValueError(f"{key} needs conditions")
        return reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), [compile_where(v) for v in value])
    if key.startswith("$"):
        raise ValueError(f"unknown operator {key}")
    if isinstance(value, dict):
        unknown = set(value) - set(_OPS)
        if unknown:
            raise ValueError(f"unknown operator {sorted(unknown)[0]}")
        return reduce(lambda a, b: a & b, [_OPS[op](F.col(key), v) for op, v in value.items()])
    return F.col(key) == F.lit(value)
