"""Chunkers. Word and sentence chunks are expressions; those that look for boundaries are plain functions of a text, run by batches.

A chunker is a function of a text that gives (start, end) of each chunk; own ones are used like those here. Every chunker ends, for each
chunk starts after the one before it; none gives an empty chunk. A null text has no chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .pieces import rows_of_texts

Chunker = Callable[[str], Iterator[tuple[int, int]]]


def word_chunk_arrays(df: DataFrame, text: str, size: int, overlap: int) -> DataFrame:
    """Adds chunks: runs of size words, each beginning size - overlap words after the one before; none lies in the overlap of the last."""
    step = size - overlap
    df, w = df.withColumn("_w", X.words(F.col(text))), F.col("_w")  # split once, not for each chunk
    n = F.size(w)
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step)), lambda i: (n > 0) & ((i == 0) | (i + overlap < n)))
    return df.withColumn("chunks", F.transform(starts, lambda i: F.array_join(F.slice(w, i + 1, size), " "))).drop("_w")


def word_chunks(df: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    return word_chunk_arrays(df, text, size, overlap).select(key, F.posexplode_outer("chunks").alias("chunk", "content")).where("content IS NOT NULL")


def sentences(t: Column) -> Column:
    marked = F.regexp_replace(t, "([.!?])\\s+", "$1\u0001")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def sentence_chunks(df: DataFrame, key: str, text: str, n: int) -> DataFrame:
    """Runs of n sentences."""
    df, s = df.withColumn("_s", sentences(F.col(text))), F.col("_s")
    parts = F.when(F.size(s) > 0, F.transform(F.sequence(F.lit(0), F.size(s) - 1, F.lit(n)), lambda i: F.array_join(F.slice(s, i + 1, n), " ")))
    # the outer form: for the plain one the optimizer would work out all chunks a second time, to filter texts without any
    return df.select(key, F.posexplode_outer(parts).alias("chunk", "content")).where("content IS NOT NULL")


def enriched(df: DataFrame, key: str, chunks: str = "chunks") -> DataFrame:
    """A row for each chunk with its id, parent, place, number of chunks and size."""
    rows = df.select(F.col(key).alias("parent"), F.size(chunks).alias("total_chunks"), F.posexplode_outer(chunks).alias("chunk_index", "content")).where("content IS NOT NULL")
    return rows.select(F.concat(F.col("parent").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), "parent", "chunk_index", "total_chunks", F.length("content").alias("chunk_size"))


def chunked(df: DataFrame, chunker: Chunker, key: str, text: str) -> DataFrame:
    """key, chunk, start, end, content for each chunk; pieces of batches go to Python as Arrow data, and nothing is shuffled."""

    return rows_of_texts(df, key, text, "chunk int, start int, end int, content string", lambda t: ((i, a, b, t[a:b]) for i, (a, b) in enumerate(chunker(t) if t is not None else ())))


def _sliding(text: str, size: int, overlap: int, cut: Callable[[int, int], int]) -> Iterator[tuple[int, int]]:
    """Spans of size characters whose ends cut() may draw in; the last one ends with the text."""
    start, n = 0, len(text)
    while start < n:
        end = n if start + size >= n else max(start + 1, min(n, cut(start, start + size)))
        yield start, end
        if end >= n:
            return
        start = max(start + 1, end - overlap)


def _last(text: str, marks: tuple[str, ...], lo: int, hi: int) -> int:
    """The end of the last of several marks between two places, or -1."""
    return max((at + len(m) for m in marks if (at := text.rfind(m, lo, hi)) >= 0), default=-1)


def sentence_end(text: str, size: int = 500, overlap: int = 50) -> Iterator[tuple[int, int]]:
    """Chunks end after a sentence where one ends beyond the overlap."""

    def cut(a, b):
        at = _last(text, (".", "!", "?"), a + overlap, b)
        return at if at > 0 else b

    return _sliding(text, size, overlap, cut)


def fixed(text: str, size: int = 500, overlap: int = 50) -> Iterator[tuple[int, int]]:
    """Chunks end at white space where there is some beyond the overlap."""

    def cut(a, b):
        at = _last(text, (" ", "\n", "\t"), a + overlap + 1, b)
        return at if at > 0 else b

    return _sliding(text, size, overlap, cut)


def boundary(text: str, size: int = 500, overlap: int = 50) -> Iterator[tuple[int, int]]:
    """Chunks end at the strongest boundary of their second half: paragraph, sentence and line, sentence, line, space."""

    def cut(a, b):
        for mark in ("\n\n", ".\n", ". ", "\n", " "):
            at = text.rfind(mark, a + size // 2, b)
            if at >= 0:
                return at + len(mark)
        return b

    return _sliding(text, size, overlap, cut)


def separators(text: str, size: int = 1000, overlap: int = 200, marks: tuple[str, ...] = ("\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " "), reach: int = 50) -> Iterator[tuple[int, int]]:
    """Chunks end at the first separator, in the order given, that is found past the middle and up to a little beyond the size."""

    def cut(a, b):
        for mark in marks:
            at = text.rfind(mark, a, b + reach)
            if at >= a + size // 2:
                return at + len(mark)
        return b

    return _sliding(text, size, overlap, cut)


ITEM = re.compile(r"[ \t]*(?:[0-9]+[.)]|[-*•])[ \t]")


def list_aware(text: str, size: int = 400, overlap: int = 50) -> Iterator[tuple[int, int]]:
    """As boundary(), but a list is not split: a chunk that would end within one ends after it, and no overlap follows it."""
    lists, at, begin = [], 0, None
    for line in text.splitlines(keepends=True):
        inside = bool(ITEM.match(line))
        if inside and begin is None:
            begin = at
        if not inside and begin is not None and line.strip():
            lists.append((begin, at))
            begin = None
        at += len(line)
    if begin is not None:
        lists.append((begin, at))
    start, n = 0, len(text)
    while start < n:
        end = next(boundary(text[start : start + size + 1], size, 0))[1] + start if start + size < n else n
        whole = next(((a, b) for a, b in lists if a < end < b and b > start), None)
        if whole:
            end = whole[1]
        yield start, end
        if end >= n:
            return
        start = end if whole else max(start + 1, end - overlap)


def semantic(text: str, size: int = 500, least: int = 20) -> Iterator[tuple[int, int]]:
    """Paragraphs are put together up to the size; one that is longer is split into sentences; what is below the least size goes."""
    parts: list[tuple[int, int]] = []
    for m in re.finditer(r"\S(?:.*?\S)?(?=\s*\n\s*\n|\s*\Z)", text, re.S):
        if len(m[0]) <= size:
            parts.append(m.span())
        else:
            parts += [(m.start() + s.start(), m.start() + s.end()) for s in re.finditer(r"\S.*?(?:[.!?](?=\s)|\Z)", m[0], re.S)]
    held: tuple[int, int] | None = None
    used = 0
    for a, b in parts:
        if held and used + b - a > size:
            if held[1] - held[0] >= least:
                yield held
            held, used = None, 0
        held, used = (held[0] if held else a, b), used + b - a
    if held and held[1] - held[0] >= least:
        yield held


def recursive(text: str, size: int = 500, overlap: int = 50, marks: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> Iterator[tuple[int, int]]:
    """Text is split at the first separator that it has; parts that are still too long at the next; neighbours are put together again."""

    def pieces(a: int, b: int, level: int) -> Iterator[tuple[int, int]]:
        if b - a <= size:
            yield a, b
            return
        mark = marks[level]
        if not mark:
            for i in range(a, b, size):
                yield i, min(b, i + size)
            return
        at = a
        while at < b:
            end = text.find(mark, at, b)
            end = b if end < 0 else end + len(mark)
            yield from pieces(at, end, level + 1)
            at = end

    held: list[tuple[int, int]] = []
    for a, b in pieces(0, len(text), 0):
        if held and b - held[0][0] > size:
            yield held[0][0], held[-1][1]
            while held and (held[-1][1] - held[0][0] > overlap or b - held[0][0] > size):
                held.pop(0)
        held.append((a, b))
    if held and held[-1][1] > held[0][0]:
        yield held[0][0], held[-1][1]


def structure(t: Column) -> Column:
    """What a Markdown text has, and the chunk size and overlap that suit it."""
    parts = F.filter(F.split(t, "\n\n"), lambda p: F.btrim(p, F.lit(" \n\t\r")) != "")
    total = F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + F.length(p))
    mean = F.when(F.size(parts) > 0, total / F.size(parts)).otherwise(F.lit(0.0))
    tables = t.rlike("(?m)^[ \\t\\n\\r\\f]*\\|.*\\|")
    size = F.when(tables, 3000).when(mean < 300, 2000).when(mean < 600, 1500).otherwise(1200)
    return F.struct(
        t.rlike("(?m)^#{1,6} ").alias("has_headings"), tables.alias("has_tables"), t.rlike("(?m)^\\s*([-*]|[0-9]+\\.) ").alias("has_lists"), size.alias("chunk_size"),
        F.least(F.lit(500), F.floor(size / 5).cast("int")).alias("chunk_overlap"),
    )


def strategy(t: Column) -> Column:
    """table with more than five table rows, semantic with long lines, else fixed."""
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    total = F.aggregate(lines, F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    return F.when(F.regexp_count(t, F.lit("\\|[^\\n]*\\|")) > 5, "table").when((F.size(lines) > 0) & (total / F.size(lines) > 100), "semantic").otherwise("fixed")
