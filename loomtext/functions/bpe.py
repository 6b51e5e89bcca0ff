"""Token counts and cuts by a byte-level BPE vocabulary, on Arrow batches. Where no vocabulary is installed, the estimates of `text` stand in."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_50k.json"
_LOADED: dict = {}


def vocabulary(name: str = VOCABULARY):
    """The worker's own tokenizer. name: a path, or the name of an installed public one."""
    if name not in _LOADED:
        from tokenizers import Tokenizer

        if "/" not in name:
            import public_tokenizers

            name, known = public_tokenizers.path(name), name
            _LOADED[known] = Tokenizer.from_file(name)
            return _LOADED[known]
        _LOADED[name] = Tokenizer.from_file(name)
    return _LOADED[name]


def _batches(column, rows: int = 256, size: int = 4 << 20):
    """Texts of a column, a bounded number of characters at once."""
    held, n = [], 0
    for x in column:
        held.append(x.as_py() or "")
        n += len(held[-1])
        if n >= size or len(held) == rows:
            yield held
            held, n = [], 0
    if held:
        yield held


#: A byte-level vocabulary never joins over a place where white space follows anything else: texts are cut there. Those with
#: other white space than this are not cut.
PLACE, OTHER_SPACE = re.compile(r"(?<=[^ \t\n\r])[ \t\n\r]"), re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
#: Characters of a text's head for each token.
HEAD = 6
#: Characters of texts that are counted at once.
AT_ONCE = 1 << 20


def _cutter(v):
    """Whether a text may be cut: never under another kind of tokenizer, and not with an added token's content or odd white space."""
    plain = type(v.pre_tokenizer).__name__ == "ByteLevel" and v.normalizer is None
    added = [t.content for t in v.get_added_tokens_decoder().values() if t.content]
    return lambda t: plain and not any(a in t for a in added) and OTHER_SPACE.search(t) is None


#: Different chunks whose numbers of tokens a worker keeps; of those met longest ago as many again.
KEPT = 500_000
SPACE, LETTER, STOP = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
LETTER[[*range(65, 91), *range(97, 123)]] = True
STOP[[0x2C, 0x2E]] = True


class Counter:
    """Numbers of tokens of texts as sums over their chunks, each different one split and merged once. Chunks begin where white space follows
    anything else, and where a full stop or comma follows an ASCII letter; texts that may not be cut are encoded whole."""

    def __init__(self, v):
        self.v, self.model, self.split = v, v.model, v.pre_tokenizer
        asis = v.truncation is None and v.padding is None and not getattr(self.split, "add_prefix_space", True) and getattr(self.split, "use_regex", False)
        can = _cutter(v)
        self.can = lambda t: asis and can(t)
        self.new, self.old = {}, {}

    def _count(self, chunk: bytes) -> int:
        space = chunk[:1] == b" "
        if chunk[1:].isalpha() if space else chunk.isalpha():  # bytes: letters of ASCII only, which stand for themselves
            return len(self.model.tokenize("\u0120" + chunk[1:].decode() if space else chunk.decode()))
        return sum(len(self.model.tokenize(piece)) for piece, _ in self.split.pre_tokenize_str(chunk.decode()))

    def _known(self, chunk: bytes) -> int:
        n = self.new.get(chunk)
        if n is None:
            n = self.old.get(chunk)
            self.new[chunk] = n = self._count(chunk) if n is None else n
            if len(self.new) >= KEPT:
                self.new, self.old = {}, self.new
        return n

    def _cut(self, texts: list[str]) -> np.ndarray:
        column = pa.array(texts, pa.large_string())
        at = np.frombuffer(column.buffers()[1], np.int64)[: len(texts) + 1]
        if not at[-1]:
            return np.zeros(len(texts), np.int64)
        data = np.frombuffer(column.buffers()[2], np.uint8)[: at[-1]]
        space, start = SPACE[data], np.zeros(len(data), bool)
        start[1:] = (space[1:] & ~space[:-1]) | (STOP[data[1:]] & LETTER[data[:-1]])
        start[at[:-1][at[:-1] < len(data)]] = True
        begin = np.flatnonzero(start)
        ends = pa.py_buffer(np.append(begin, len(data)).astype(np.int64))
        chunks = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, ends, column.buffers()[2]]).dictionary_encode()
        n = np.fromiter(map(self._known, chunks.dictionary.to_pylist()), np.int64, len(chunks.dictionary))
        return np.diff(np.concatenate([[0], np.cumsum(n[chunks.indices.to_numpy()])])[np.searchsorted(begin, at)])

    def count(self, texts: list[str]) -> list[int]:
        out, cut = [0] * len(texts), []
        for i, t in enumerate(texts):
            if not self.can(t):
                out[i] = len(self.v.encode(t, add_special_tokens=False).ids)
                continue
            while len(t) > AT_ONCE and len(head := _head(t, AT_ONCE)) < len(t):  # a very long text in parts
                out[i] += int(self._cut([head])[0])
                t = t[len(head) :]
            cut.append((i, t))
        for (i, _), n in zip(cut, self._cut([t for _, t in cut]).tolist()):
            out[i] += n
        return out


_COUNTERS: dict = {}


def with_tokens(df: DataFrame, text: str, out: str = "tokens", name: str = VOCABULARY) -> DataFrame:
    """Adds the number of tokens of each text (null: 0)."""
    at = df.columns.index(text)

    def run(batches):
        v = vocabulary(name)
        if name not in _COUNTERS or _COUNTERS[name].v is not v:
            _COUNTERS[name] = Counter(v)
        for batch in batches:
            n = [x for some in _batches(batch.column(at), 4096, AT_ONCE) for x in _COUNTERS[name].count(some)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.LongType())]))


def _head(t: str, size: int) -> str:
    """The text up to its first place from size on where it may be cut."""
    place = PLACE.search(t, size)
    return t if place is None else t[: place.start()]


def truncated(df: DataFrame, text: str, tokens: int, out: str = "cut", name: str = VOCABULARY) -> DataFrame:
    """Adds each text up to its first tokens; a text that has no more stays as it is, and so does a null. A character whose bytes are cut
    apart is written as the replacement character, as the vocabulary's decoder does. Of a long text a head is encoded, and a longer one until it
    has more tokens than that."""
    at = df.columns.index(text)

    def run(batches):
        v = vocabulary(name)
        can = _cutter(v)

        def cut(t: str | None) -> str | None:
            size = HEAD * tokens + 1 if t and can(t) else len(t or "")
            while t:
                head = _head(t, size) if size < len(t) else t
                ids = v.encode(head, add_special_tokens=False).ids
                if len(ids) > tokens:
                    return v.decode(ids[:tokens], skip_special_tokens=False)
                if len(head) == len(t):
                    break
                size = max(4 * size, len(head))
            return t

        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([cut(x.as_py()) for x in batch.column(at)], pa.string())], names=[*batch.schema.names, out])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]))
