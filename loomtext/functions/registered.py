"""Names for SQL: scalar functions as SQL functions, which Spark inlines into plans, and chunkers as table functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: name: (arguments, result, body)
SCALARS = {
    "clean_spaces": ("t STRING", "STRING", "trim(regexp_replace(t, '\\\\s+', ' '))"),
    "token_estimate": ("t STRING, chars INT", "BIGINT", "CAST(floor(length(t) / chars) AS BIGINT)"),
    "text_preview": ("t STRING, n INT", "STRING", "CASE WHEN length(t) > n THEN concat(substr(t, 1, n), '...') ELSE t END"),
    "vector_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
}


def tools() -> list[str]:
    return sorted(SCALARS)


def register(spark: SparkSession) -> None:
    for name, (arguments, result, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")


def register_chunker(spark: SparkSession, name: str, chunker: Callable[[str], Iterator[tuple[int, int]]]) -> None:
    """SELECT ... FROM table, LATERAL name(text): a row (chunk, start, text) for each chunk; none for a null text. Rows travel a hundred at a time;
    as Arrow batches they would be thousands of whole texts at once, in a worker that then makes a batch of each text's chunks."""

    class Chunks:
        def eval(self, text: str):
            for i, (a, b) in enumerate(chunker(text) if text is not None else ()):
                yield i, a, text[a:b]

    spark.udtf.register(name, udtf(Chunks, returnType="chunk int, start int, text string", useArrow=False))
