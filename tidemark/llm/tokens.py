"""Operator 6: token counts, and the segment encoder that operator 4 shares.

A text is split at boundaries where the tokenizer's own pattern always splits (before a single
space between solid characters, around a single line feed, between an ASCII letter and following
punctuation), so the tokens of the whole text are those of its segments one after another; a text
beyond a slice is worked on in pieces that end at such boundaries. Segments repeat a great deal: each
distinct one is encoded once, in batches balanced by bytes, and kept in a cache of the Python worker
that is bounded in bytes. The cache knows a segment by a 64-bit hash of its bytes (a chance of about
n^2 / 2^65 of a clash among n segments: 3e-8 for a full cache).
"""

from __future__ import annotations

import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import flat_bytes, hold, prefix_hash, release, span_hash, trim

LIMIT = 512              # tokens of over_limit
SLICE = (1 << 20) - 2    # bytes of text worked on at once
ENCODE = 1 << 20         # bytes of one call to the tokenizer
CACHE = 1_000_000        # segments kept in a worker: 24 MB of slots and 12 bytes each
STORE = 1 << 22          # token ids kept beside them, 4 bytes each

#: ASCII punctuation that always begins a new piece after a letter. Apostrophes
#: (contractions) and the characters of special tokens (< | >) are left out.
_PUNCT = ',.;:!?)%$*#&"'
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_AFTER = np.zeros(256, bool)
_AFTER[[ord(c) for c in _PUNCT]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = True
_NEXT = _SOLID.copy()
_NEXT[0xC3:0xE0] = _NEXT[0xE4:0xF5] = True  # leads of characters that are never white space


def segments(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Start offsets of the segments; every text's start is one. Ends are the next starts."""
    n = len(data)
    cuts = np.zeros(n + 1, bool)
    if n > 2:
        before = _SOLID[data]                       # the character that ends here is solid
        before[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] < 0xE0)
        mid = np.zeros(n, bool)
        mid[1:-1] = before[:-2] & _NEXT[data[2:]]
        line = mid & (data == 10)
        cuts[:n] = (mid & (data == 32)) | line
        cuts[1:] |= line
        cuts[1:n] |= _LETTER[data[:-1]] & _AFTER[data[1:]]
    cuts[off[:-1][np.diff(off) > 0]] = True
    cuts[n] = False
    return np.flatnonzero(cuts)


class Segmented:
    """Encodes texts segment by segment; ``ids`` keeps token ids, otherwise only lengths."""

    _made: dict[tuple[str, bool], "Segmented"] = {}

    @classmethod
    def of(cls, path: str, ids: bool) -> "Segmented":
        """The worker's encoder, one at a time; it outlives a task where workers are reused."""
        release(but=cls._made.clear)
        if (path, ids) not in cls._made:
            cls._made.clear()
            cls._made[path, ids] = cls(path, ids)
        return cls._made[path, ids]

    def __init__(self, path: str, ids: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok, self.ids = Tokenizer.from_file(path), ids
        self.tok.no_truncation()
        self.tok.no_padding()
        # a tokenizer that lower-cases by itself sees fewer distinct segments if letters are lower before
        self.lower = "Lowercase" in str(self.tok.normalizer)
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(1 << 16, np.uint64)      # open addressing: hashes (0: free) and numbers
        self.numbers = np.zeros(1 << 16, np.int32)
        self.n = 0
        self.length = np.zeros(1 << 16, np.int32)
        self.at = np.zeros(1 << 16, np.int64)
        self.store = np.zeros(1 << 18, np.int32)
        self.used = 0

    def _find(self, h: np.ndarray) -> np.ndarray:
        """The numbers of hashes, -1 for unknown ones."""
        out = np.full(len(h), -1, np.int64)
        mask = np.uint64(len(self.keys) - 1)
        todo, slot = np.arange(len(h)), h & mask
        while len(todo):
            held = self.keys[slot]
            hit = held == h[todo]
            out[todo[hit]] = self.numbers[slot[hit]]
            on = ~hit & (held != 0)
            todo, slot = todo[on], (slot[on] + np.uint64(1)) & mask
        return out

    def _keep(self, h: np.ndarray, number: np.ndarray) -> None:
        """Take in distinct new hashes."""
        mask = np.uint64(len(self.keys) - 1)
        slot = h & mask
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]           # of several for one slot the last stays
            won = free & (self.keys[slot] == h)
            self.numbers[slot[won]] = number[won]
            h, number, slot = h[~won], number[~won], (slot[~won] + np.uint64(1)) & mask

    def _grow(self, more: int) -> None:
        size = len(self.keys)
        while 2 * (self.n + more) > size:
            size *= 2
        if size > len(self.keys):
            keys, numbers = self.keys, self.numbers
            full = np.flatnonzero(keys)
            self.keys, self.numbers = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._keep(keys[full], numbers[full])
        while self.n + more > len(self.length):
            self.length, self.at = np.concatenate([self.length] * 2), np.concatenate([self.at] * 2)

    def _learn(self, new: list[bytes], h: np.ndarray) -> None:
        """Encode segments and number them from ``self.n`` on."""
        self._grow(len(new))
        i = 0
        while i < len(new):
            j, size = i, 0
            while j < len(new) and (j == i or size + len(new[j]) <= ENCODE):
                size += len(new[j])
                j += 1
            got = self.tok.encode_batch_fast([x.decode("utf-8", "replace") for x in new[i:j]], add_special_tokens=False)
            lens = np.fromiter((len(e) for e in got), np.int32, j - i)
            at = slice(self.n + i, self.n + j)
            self.length[at] = lens
            if self.ids:
                total = int(lens.sum())
                while self.used + total > len(self.store):
                    self.store = np.concatenate([self.store, np.zeros_like(self.store)])
                self.store[self.used: self.used + total] = np.fromiter(itertools.chain.from_iterable(e.ids for e in got), np.int32, total)
                self.at[at] = self.used + np.cumsum(lens) - lens
                self.used += total
            i = j
        self._keep(h, np.arange(self.n, self.n + len(new)))
        self.n += len(new)

    def _look(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cache numbers of all segments, and the segments' starts."""
        if self.lower and b"<|" not in data.tobytes():
            data = _LOWER[data]
        starts = segments(data, off)
        if not len(starts):
            return np.zeros(0, np.int64), starts
        ends = np.append(starts[1:], len(data))
        h = np.maximum(span_hash(*prefix_hash(data), starts, ends), np.uint64(1))
        number = self._find(h)
        if len(miss := np.flatnonzero(number < 0)):
            if self.n + len(miss) > CACHE or self.used > STORE:
                self._clear()
                miss = np.arange(len(h))
            distinct, first, which = np.unique(h[miss], return_index=True, return_inverse=True)
            at = miss[first]
            raw, base = data.tobytes(), self.n
            self._learn([raw[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())], distinct)
            number[miss] = base + which
        return number, starts

    @staticmethod
    def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
        """A long text in pieces of about SLICE bytes that begin at segments' starts."""
        lo, size = 0, SLICE
        while lo < len(data):
            own = data[lo: lo + size]
            if lo + size < len(data):
                starts = segments(own, np.array([0, len(own)]))
                if not len(starts) or starts[-1] == 0:      # no boundary yet
                    size *= 2
                    continue
                own = own[: starts[-1]]
            yield own
            lo, size = lo + len(own), SLICE

    def counts(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        out = np.zeros(len(off) - 1, np.int64)
        for i, j in by_bytes(off, SLICE):
            if off[j] - off[i] > SLICE:
                out[i] = sum(int(self.length[self._look(p, np.array([0, len(p)]))[0]].sum(dtype=np.int64)) for p in self._pieces(data[off[i]: off[j]]))
                continue
            own = off[i: j + 1] - off[i]
            number, starts = self._look(data[off[i]: off[j]], own)
            total = np.concatenate([[0], np.cumsum(self.length[number].astype(np.int64))])
            first = np.searchsorted(starts, own)
            out[i:j] = total[first[1:]] - total[first[:-1]]
        return out

    def _ids(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lens = self.length[number].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(lens)])
        where = np.repeat(self.at[number] - total[:-1], lens) + np.arange(total[-1])
        return self.store[where], total

    def encode(self, data: np.ndarray, off: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(text, its token ids) of all texts, in order."""
        for i, j in by_bytes(off, SLICE):
            if off[j] - off[i] > SLICE:
                yield i, np.concatenate([self._ids(self._look(p, np.array([0, len(p)]))[0])[0] for p in self._pieces(data[off[i]: off[j]])])
                continue
            own = off[i: j + 1] - off[i]
            number, starts = self._look(data[off[i]: off[j]], own)
            ids, total = self._ids(number)
            at = total[np.searchsorted(starts, own)].tolist()
            for k in range(i, j):
                yield k, ids[at[k - i]: at[k - i + 1]]


hold(Segmented._made.clear)


def by_bytes(off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text is a range of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    Defined cases: null and empty texts have 0 bytes and 0 tokens; strings of special tokens
    inside texts count as the library treats them by default; a text without any safe boundary
    is encoded as one segment; texts of any length need memory for a slice; an empty table gives an empty one; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Segmented.of(path, False)
        for batch in batches:
            data, off = flat_bytes(batch.column(1))
            n = coder.counts(data, off)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(off)), pa.array(n), pa.array(n > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"])
            trim()

    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
