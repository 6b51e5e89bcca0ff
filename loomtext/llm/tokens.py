"""Token ids of whole texts by the tokenizers library, each different word once.

A byte-level BPE never joins bytes over the boundaries that its pattern draws, and one always lies where white space follows anything else,
and where a full stop or comma follows an ASCII letter. So a text's ids are the ids of its chunks between such places, and the library's
own splitter and merges run once for each different chunk that a worker meets; chunks are told apart by their bytes. Texts with white space
outside ASCII, or with the content of one of the tokenizer's added tokens (such as an end mark in plain text), are not split: the library
encodes them whole.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa

from .common import AT_ONCE, SPACE, dictionary, hash_spans, slices, text_bytes

#: White space of Unicode outside ASCII, and separators that some engines count as such.
OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
STOP = np.zeros(256, bool)
STOP[[0x2C, 0x2E]] = True
#: Letters that are letters in any version of Unicode; what the splitter takes as one piece, with a space before it.
LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_LEAD = np.zeros(256, bool)
_LEAD[[*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _spread(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of runs of these sizes, one run after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Runs:
    """Runs of numbers laid end to end, to which others are added."""

    def __init__(self, kind):
        self.flat, self.at, self.n = np.zeros(1 << 16, kind), np.zeros(1 << 16, np.int64), 0

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        used = int(self.at[self.n])
        while used + len(values) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(sizes) >= len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[used : used + len(values)] = values
        self.at[self.n + 1 : self.n + 1 + len(sizes)] = used + np.cumsum(sizes)
        self.n += len(sizes)

    def take(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the runs i, end to end, and the runs' sizes."""
        size = self.at[i + 1] - self.at[i]
        return self.flat[_spread(self.at[i], size)], size


class Encoder:
    """Keeps the bytes and ids of up to `words` different chunks, and forgets them all when there are more. They are found by a hash, and what
    is found is compared byte by byte."""

    def __init__(self, path: str, words: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.split = self.tokenizer.model, self.tokenizer.pre_tokenizer
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        plain = self.split.pre_tokenize_str(" \u00e9") if self.split else []
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.visible = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}  # how byte-level BPE writes bytes
        byte_level = self.split is not None and type(self.split).__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        if not byte_level or [x for x, _ in plain] != ["".join(self.visible[b] for b in " \u00e9".encode())]:
            raise ValueError("only byte-level BPE without normalizer can be encoded chunk by chunk")
        self.words, self.bits = words, int(words * 1.4).bit_length()
        self.clear()

    def clear(self) -> None:
        self.hashes, self.codes = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        self.chunks, self.ids = Runs(np.uint8), Runs(np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The code that a hash stands for, -1 for none."""
        mask = (1 << self.bits) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        out = self.codes[slot]
        todo = np.flatnonzero((out >= 0) & (self.hashes[slot] != h))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & mask
            out[todo] = self.codes[slot[todo]]
            todo = todo[(out[todo] >= 0) & (self.hashes[slot[todo]] != h[todo])]
        return out.astype(np.int64)

    def _insert(self, h: np.ndarray, code: np.ndarray) -> None:
        mask = (1 << self.bits) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        todo = np.arange(len(h))
        while len(todo):
            free = todo[self.codes[slot[todo]] < 0]
            self.codes[slot[free]] = code[free]  # of several that want a slot, the last one gets it
            won = free[self.codes[slot[free]] == code[free]]
            self.hashes[slot[won]] = h[won]
            lost = np.ones(len(h), bool)
            lost[won] = False
            todo = todo[lost[todo]]
            slot[todo] = (slot[todo] + 1) & mask

    def _whole(self, raw: bytes) -> bool:
        return any(t in raw for t in self.added) or OTHER_SPACE.search(raw.decode()) is not None

    def _chunk_ids(self, chunk: bytes) -> list[int]:
        tokenize = self.model.tokenize
        space = chunk[:1] == b" "
        if chunk[1:].isalpha() if space else chunk.isalpha():  # bytes: letters of ASCII only
            return [x.id for x in tokenize(self.visible[32] + chunk[1:].decode() if space else chunk.decode())]
        text = chunk.decode()
        if LATIN.fullmatch(text[1:] if space else text):
            return [x.id for x in tokenize(chunk.decode("latin-1").translate(self.visible))]
        if self._whole(chunk):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return [x.id for piece, _ in self.split.pre_tokenize_str(text) for x in tokenize(piece)]

    def _codes(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The codes of different chunks laid end to end; new ones are learnt."""
        h, size = hash_spans(data, at[:-1], at[1:]), np.diff(at)
        code = self._find(h)
        known = np.flatnonzero(code >= 0)
        if len(known):
            body, n = self.chunks.take(code[known])
            same = n == size[known]
            if not same.all():
                body = self.chunks.take(code[known[same]])[0]
            own = known[same]
            apart = np.flatnonzero(body != data[_spread(at[own], size[own])])
            same[np.flatnonzero(same)[np.unique(np.searchsorted(np.cumsum(size[own]), apart, side="right"))]] = False
            code[known[~same]] = -2  # another chunk of the same hash: it is encoded, but not to be found again
        new = np.flatnonzero(code < 0)
        if not len(new):
            return code
        if self.chunks.n + len(new) > self.words or self.ids.at[self.ids.n] > 16 * self.words or self.chunks.at[self.chunks.n] > 32 * self.words:
            self.clear()
            new, code = np.arange(len(h)), np.full(len(h), -1)
            if len(new) > self.words:
                self.bits = max(self.bits, int(2 * len(new)).bit_length())
                self.clear()
        raw = data.tobytes()
        ids = [self._chunk_ids(raw[a:b]) for a, b in zip(at[new].tolist(), at[new + 1].tolist())]
        numbers = np.arange(self.chunks.n, self.chunks.n + len(new))
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids.add(np.fromiter((x for i in ids for x in i), np.int32, int(n.sum())), n)
        self.chunks.add(data[_spread(at[new], size[new])], size[new])
        first = code[new] == -1
        self._insert(h[new[first]], numbers[first].astype(np.int32))
        code[new] = numbers
        return code

    def _encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, and where each text's ids start."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(at), np.int64)
        start = np.zeros(len(data), bool)
        space = SPACE[data]
        start[1:] = (space[1:] & ~space[:-1]) | (STOP[data[1:]] & LETTER[data[:-1]])
        start[at[:-1][at[:-1] < len(data)]] = True
        rows = np.zeros(0, np.int64)
        if _LEAD[data].any():  # rare enough that each such text is looked at whole
            rows = np.unique(np.searchsorted(at, np.flatnonzero(_LEAD[data]), side="right") - 1)
        if self.added and any(t in raw for raw in [data.tobytes()] for t in self.added):
            rows = np.arange(len(at) - 1)
        for r in rows.tolist():
            if at[r] < at[r + 1] and self._whole(data[at[r] : at[r + 1]].tobytes()):
                start[at[r] + 1 : at[r + 1]] = False
        s = np.flatnonzero(start)
        chunks, ends, place = dictionary(data, s)
        code = self._codes(chunks, ends)  # may forget all that was known
        ids, n = self.ids.take(code[place])
        return ids, np.concatenate([[0], np.cumsum(n)])[np.searchsorted(s, at)]

    def encode(self, column: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a column (null: empty), end_id after each, and where each text's ids start (one more entry)."""
        data, at = text_bytes(column)
        parts, starts, done = [], [np.zeros(1, np.int64)], 0
        for lo, hi in slices(at):
            part = data[at[lo] : at[hi]]
            cuts = [0, len(part)]
            if len(part) > 2 * AT_ONCE and not self._whole(part.tobytes()):  # one very long text
                cuts = [0]
                while cuts[-1] < len(part):
                    stop = min(len(part), cuts[-1] + AT_ONCE)
                    while stop < len(part) and not (SPACE[part[stop]] and not SPACE[part[stop - 1]]):
                        stop += 1
                    cuts.append(stop)
            if len(cuts) > 2:
                ids = np.concatenate([self._encode(part[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts, cuts[1:])])
                s = np.array([0, len(ids)])
            else:
                ids, s = self._encode(part, at[lo : hi + 1] - at[lo])
            if end_id is not None:
                ids = np.insert(ids, s[1:], end_id)
                s = s + np.arange(len(s))
            parts.append(ids)
            starts.append(s[1:] + done)
            done += len(ids)
        return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.concatenate(starts)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder, which stays for its later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def crc32s(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each run of ids as little-endian unsigned 32-bit integers."""
    raw = memoryview(np.ascontiguousarray(ids, "<u4").view(np.uint8))
    return np.fromiter((zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())), np.int64, len(starts) - 1)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The installed file of a public tokenizer; looked up on each machine, as its place can differ."""
    import public_tokenizers

    return public_tokenizers.path(name)
