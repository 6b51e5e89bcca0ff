"""Extractive summaries: a text's sentences in the order of a random walk between those that share words.

The walk goes from a sentence to one of its words, from there to one of the sentences that have it, and now and then anywhere; its shares after a
fixed number of rounds rank the sentences. Each round takes time linear in the number of words: no pair of sentences is made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexical import terms

ROUNDS, DAMPING = 20, 0.85


def sentences(text: Column) -> Column:
    """Lines, cut after a full stop, a question or an exclamation mark that white space follows; without white space around, and none empty."""
    lines = F.split(F.regexp_replace(text, "([.!?])[ \\t\\n\\r]+", "$1\n"), "\n")
    return F.filter(F.transform(lines, lambda s: F.regexp_replace(s, "^[ \\t\\r]+|[ \\t\\r]+$", "")), lambda s: s != "")


def ranks(sentence: np.ndarray, word: np.ndarray, text_of: np.ndarray, rounds: int = ROUNDS, damping: float = DAMPING) -> np.ndarray:
    """sentence, word: pairs that occur, each once; words of two texts are two words. text_of: each sentence's text. Returns a share for each
    sentence; one without words has what the walk gives to all alike."""
    n = np.bincount(text_of)[text_of] if len(text_of) else np.zeros(0)
    words, have = np.bincount(sentence, minlength=len(n)), np.bincount(word)
    r = 1 / n
    for _ in range(rounds):
        mass = np.bincount(word, r[sentence] / words[sentence], len(have))
        r = (1 - damping) / n + damping * np.bincount(sentence, mass[word] / have[word], len(n))
    return r


def summarize(df: DataFrame, text: str, share: float = 0.2, name: str = "summary", at_once: int = 64) -> DataFrame:
    """Adds the summary: sentences in their order, best first as long as all fit into the share of the text's characters (one character at least); a
    best sentence that is longer is cut to it. Ties go to the earlier one. A null text has none, a text without sentences an empty one."""
    columns = df.columns
    listed = sentences(F.col(text))
    room = F.greatest(F.lit(1), F.floor(F.length(text) * F.lit(share) + 1e-9).cast("int"))
    rows = df.select("*", listed.alias("_s"), F.transform(listed, lambda s: F.array_distinct(terms(s))).alias("_w"), room.alias("_n"))

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, at_once):
                part = batch.slice(lo, at_once)
                texts, words, room = part.column(len(columns)), part.column(len(columns) + 1), part.column(len(columns) + 2).to_pylist()
                size = texts.value_lengths().fill_null(0).to_numpy().astype(np.int64)
                text_of = np.repeat(np.arange(part.num_rows), size)
                each = words.flatten()
                flat = each.flatten().dictionary_encode()
                sentence = np.repeat(np.arange(len(text_of)), each.value_lengths().to_numpy())
                code = text_of[sentence] * max(len(flat.dictionary), 1) + flat.indices.to_numpy()
                r = np.round(ranks(sentence, np.unique(code, return_inverse=True)[1].ravel(), text_of), 9)
                body, ends, out = texts.flatten().to_pylist(), np.concatenate([[0], np.cumsum(size)]), []
                for i in range(part.num_rows):
                    own = list(range(int(ends[i]), int(ends[i + 1])))
                    order, taken, used = sorted(own, key=lambda j: (-r[j], j)), [], 0
                    for j in order:
                        used += len(body[j])
                        if used > room[i]:
                            break
                        taken.append(j)
                    first = body[order[0]][: room[i]] if own and not taken else ""
                    out.append(None if not texts[i].is_valid else first or " ".join(body[j] for j in sorted(taken)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(columns)], pa.array(out, pa.string())], names=[*columns, name])

    return rows.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]))
