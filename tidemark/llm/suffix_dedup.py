"""Operator 1: suffix-array dedup of repeated passages by distributed prefix doubling.

A passage of ``length`` bytes that starts anywhere else too is removed, byte by byte.

Sorting all suffixes of a corpus would rank every byte position. Ranks are needed at anchors only:
each window start p has the anchor m(p), the position of the smallest hash of a short gram among the
first ``length // 2`` starts after p, which depends on the window's own bytes alone, so equal windows
have their anchors at equal offsets: two windows are equal if and only if their anchors' offsets are
and the bytes around the anchors are. One anchor serves a run of starts.

Prefix doubling then ranks anchors by the quarter length after them, reranks the survivors as pairs
(rank, rank at offset of a quarter) for half the length, and in every round positions whose rank is
unique leave. Half a length is all that the windows of one anchor have in common: further doublings
would rank bytes that only some of them hold. So at ``length`` a run of starts is decided as a whole
(all bytes that its windows touch are equal elsewhere), or else is cut on aligned borders down to
single starts, where a rank is that of the whole window; only the borders of repeats go that far. Of
equal runs one representative goes on, so copies cost one row.

A rank is the 64-bit hash of the bytes it stands for (equal bytes, equal rank; distinct ones differ
but for a chance of about n^2 / 2^64), which needs no global numbering and survives lost executors.

The same rounds over words instead of bytes say which documents share a passage of more than
``words - 1`` words with another document. Texts are worked on in overlapping slices, so a text of
any length needs bounded memory beyond its own bytes; only a single word longer than a slice is
hashed at once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, drop_table, flat_bytes, mix, prefix_hash, release, row_key, span_hash, trim, words_of
from tidemark.llm.tokens import by_bytes

LENGTH = 400
WORDS = 51           # of a passage that documents share
SLICE = 1 << 20      # bytes of text worked on at once; some 100 bytes of arrays for each
BESIDE = 24 << 20    # bytes of packed places that may be broadcast beside the texts


@dataclass(frozen=True)
class Unit:
    """What texts are made of here: bytes or words."""

    words: bool
    length: int              # of a window
    gram: int                # whose hash picks anchors
    steps: tuple[int, ...]   # starts of a run when it is split
    across: bool             # windows count as repeated only if two documents hold them

    @property
    def width(self) -> int:
        return self.length // 2

    @property
    def grain(self) -> int:
        return (self.length - self.width) // 2

    @property
    def slice(self) -> int:
        return SLICE // 4 if self.words else SLICE

    def symbols(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The units of all texts one after another, and each text's offsets in them."""
        data, off = flat_bytes(col)
        return word_hashes(data, off) if self.words else (data, off)


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _stops(data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """Ranges of about SLICE bytes of a long text that end before white space."""
    while lo < hi:
        end, look = min(lo + SLICE, hi), 4096
        while end < hi:
            at = np.flatnonzero(_SPACE[data[end: min(hi, end + look)]])
            if len(at):
                end += int(at[0])
                break
            end, look = min(hi, end + look), look * 2
        yield lo, end
        lo = end


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and each text's offsets in them."""
    hashes, counts = [np.zeros(0, np.uint64)], []
    for i, j in by_bytes(off, SLICE):
        many = 0
        for lo, hi in [(off[i], off[j])] if j - i > 1 or off[j] - off[i] <= 2 * SLICE else _stops(data, int(off[i]), int(off[j])):
            own = data[lo:hi]
            begins, stops, first = words_of(own, off[i: j + 1] - off[i] if hi == off[j] and lo == off[i] else np.array([0, hi - lo]))
            h, down = prefix_hash(own)
            hashes.append(span_hash(h, down, begins, stops))
            if j - i > 1:
                counts.extend(np.diff(first).tolist())
            many += len(begins)
        if j - i == 1:
            counts.append(many)
    return np.concatenate(hashes), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def slices(off: np.ndarray, limit: int, before: int, after: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(i, j, lo, hi, a, b): texts i to j with positions [lo, hi), of which [a, b) are to be read.
    Several texts are one slice; a text beyond ``limit`` is cut, and reads overlap by the margins."""
    for i, j in by_bytes(off, limit):
        lo, end = int(off[i]), int(off[j])
        if j - i > 1 or end - lo <= limit:
            yield i, j, lo, end, lo, end
            continue
        for at in range(lo, end, limit):
            yield i, j, at, min(end, at + limit), max(lo, at - before), min(end, at + limit + after)


# ------------------------------------------------------------------- anchors
def window_minima(v: np.ndarray, width: int) -> np.ndarray:
    """min(v[i : i + width]) for every i that has a full window, by blocks (two scans)."""
    n = len(v) - width + 1
    if n <= 0:
        return v[:0]
    blocks = -(-len(v) // width)
    pad = np.full(blocks * width, np.iinfo(v.dtype).max, v.dtype)
    pad[: len(v)] = v
    grid = pad.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1: width - 1 + n])


def runs(h: np.ndarray, down: np.ndarray, off: np.ndarray, unit: Unit) -> tuple[np.ndarray, ...]:
    """(text, anchor, lo, hi) of the runs of window starts with one anchor, as positions."""
    n, length = len(h) - 1, unit.length
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    at = np.arange(n - unit.gram + 1)
    gram = span_hash(h, down, at, at + unit.gram)
    v = (gram & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)   # leftmost of equal grams
    low = (window_minima(v, unit.width)[: n - length + 1] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    # only starts whose window ends in their own text
    text = np.repeat(np.arange(len(off) - 1), np.maximum(0, np.diff(off) - length + 1))
    start = np.repeat(off[:-1], np.maximum(0, np.diff(off) - length + 1))
    first = np.flatnonzero(np.append(True, text[1:] != text[:-1])) if len(text) else np.zeros(0, np.int64)
    p = np.arange(len(text)) - np.repeat(first, np.diff(np.append(first, len(text)))) + start
    m = low[p]
    new = np.flatnonzero(np.append(True, (m[1:] != m[:-1]) | (text[1:] != text[:-1]))) if len(p) else first
    last = np.append(new[1:], len(p)) - 1
    return text[new], m[new], p[new], p[last] if len(p) else p


def _anchored(rows: DataFrame, unit: Unit) -> DataFrame:
    """id, x (anchor), lo, hi (starts), r1 and r2 (ranks of the two halves of the common part),
    whole (rank of all that the run's windows touch, places included). ``rows``: id, text."""
    length, grain = unit.length, unit.grain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, off = unit.symbols(batch.column(1))
            for i, j, lo_, hi_, a, b in slices(off, unit.slice, 0, length - 1):
                if b - a < length:
                    continue
                ends = off[i: j + 1] - a if j - i > 1 else np.array([0, b - a])
                h, down = prefix_hash(data[a:b])
                t, x, lo, hi = runs(h, down, ends, unit)
                whole = mix(span_hash(h, down, lo, hi + length) + ((x - lo) * 1024 + (x - hi)).astype(np.uint64))
                base = off[i: j][t] - a
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(t + i)), *(pa.array((k - base).astype(np.int32)) for k in (x, lo, hi)),
                     *(pa.array(k.view(np.int64)) for k in (span_hash(h, down, x, x + grain), span_hash(h, down, x + grain, x + 2 * grain), whole))],
                    names=["id", "x", "lo", "hi", "r1", "r2", "whole"])
            trim()

    return rows.mapInArrow(run, "id long, x int, lo int, hi int, r1 long, r2 long, whole long")


def _split(rows: DataFrame, picked: DataFrame, unit: Unit, step: int) -> DataFrame:
    """The picked runs (id, x, lo, hi, wanted) split at multiples of ``step`` before the anchor:
    id, x, lo, hi, core (rank of what all aligned windows share), whole, wanted."""
    length = unit.length
    packed = picked.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("x", "lo", "hi", "wanted"))).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, off = unit.symbols(batch.column(1))
            lists = batch.column(2)
            text = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            all_x, all_lo, all_hi = (flat.field(k).to_numpy().astype(np.int64) + off[text] for k in range(3))
            all_wanted = flat.field(3).to_numpy(zero_copy_only=False)
            for i, j, first, last, a, b in slices(off, unit.slice, length, 2 * length):
                here = np.flatnonzero((text >= i) & (text < j) & (all_x >= first) & (all_x < last))
                if not len(here):
                    continue
                h, down = prefix_hash(data[a:b])
                t, wanted = text[here], all_wanted[here]
                x, lo, hi = all_x[here] - a, all_lo[here] - a, all_hi[here] - a
                # offsets x - p of the run, from x - hi to x - lo, cut at multiples of step
                one, many = (x - hi) // step, (x - lo) // step
                k = many - one + 1
                which = np.repeat(np.arange(len(x)), k)
                block = one[which] + np.arange(len(which)) - np.repeat(np.cumsum(k) - k, k)
                x, t, wanted = x[which], t[which], wanted[which]
                core_lo, core_hi = x - block * step, x - (block * step + step - 1) + length
                lo, hi = np.maximum(lo[which], x - block * step - step + 1), np.minimum(hi[which], core_lo)
                core = mix(span_hash(h, down, core_lo, core_hi) + block.astype(np.uint64))
                whole = mix(span_hash(h, down, lo, hi + length) + ((x - lo) * 1024 + (x - hi)).astype(np.uint64))
                base = off[t] - a
                for s in range(0, len(x), 500_000):
                    e = slice(s, s + 500_000)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(t[e])), *(pa.array((q - base)[e].astype(np.int32)) for q in (x, lo, hi)),
                         pa.array(core[e].view(np.int64)), pa.array(whole[e].view(np.int64)), pa.array(wanted[e])],
                        names=["id", "x", "lo", "hi", "core", "whole", "wanted"])
            trim()

    return beside(rows, cut(packed, "places"), "id", 13, "places", "inner").select("id", "_text", "places").mapInArrow(
        run, "id long, x int, lo int, hi int, core long, whole long, wanted boolean")


def beside(rows: DataFrame, packed: DataFrame, key: str, width: int, col: str, how: str) -> DataFrame:
    """Join packed places to the texts: broadcast if they measure BESIDE bytes or fewer, shuffled
    otherwise. ``packed`` is a written table."""
    size = packed.agg(F.sum(F.coalesce(F.size(col), F.lit(0)) * width + 16)).first()[0] or 0
    return rows.join(F.broadcast(packed) if size <= BESIDE else packed, key, how)


# -------------------------------------------------------------------- rounds
def _places(across: bool) -> Column:
    """How often a rank occurs: places, or only whether more than one document has it."""
    return F.when(F.min("id") == F.max("id"), 1).otherwise(2) if across else F.count(F.lit(1))


def _again(rows: DataFrame, keys: list[str], across: bool) -> DataFrame:
    """Rows whose rank is not unique. ``rows`` is a written table."""
    known = cut(rows.groupBy(*keys).agg(_places(across).alias("_n")).where("_n > 1").drop("_n"), "ranks")
    return rows.join(F.broadcast(known) if known.count() <= 1_000_000 else known, keys, "left_semi")


def _level(rows: DataFrame, keys: list[str], across: bool) -> tuple[DataFrame, DataFrame]:
    """One decision: (covered, undecided). Rows with an equal ``whole`` elsewhere are covered. Where
    runs of one core differ, one representative of each goes on, wanted if it was alone."""
    equal = cut(rows.groupBy(*keys, "whole").agg(
        _places(across).alias("n"), F.min(F.struct("id", "x", "lo", "hi")).alias("one"), F.max("wanted").alias("wanted")), "equal")
    pairs = equal.where("n > 1 and wanted").select(*keys, "whole")
    covered = cut(rows.where("wanted").join(F.broadcast(pairs) if pairs.count() <= 1_000_000 else pairs, [*keys, "whole"], "left_semi").select("id", "lo", "hi"), "covered")
    cores = equal.groupBy(*keys).agg(F.count(F.lit(1)).alias("kinds"), F.max(F.col("wanted") & (F.col("n") == 1)).alias("open")).where("kinds > 1 and open")
    cores = cut(cores.select(*keys), "cores")
    undecided = cut(equal.join(F.broadcast(cores) if cores.count() <= 1_000_000 else cores, keys, "left_semi").select(
        "one.id", "one.x", "one.lo", "one.hi", (F.col("wanted") & (F.col("n") == 1)).alias("wanted")), "open")
    drop_table(equal)
    return covered, undecided


def _repeated(rows: DataFrame, unit: Unit) -> DataFrame:
    """(id, lo, hi): runs of starts whose windows occur elsewhere. ``rows``: id, text. Rounds' tables
    are removed as soon as the next one is written."""
    anchors = cut(_anchored(rows, unit), "anchors")
    half = cut(_again(anchors, ["r1"], unit.across), "round1")                     # a quarter of a window
    drop_table(anchors)
    now, keys = cut(_again(half, ["r1", "r2"], unit.across), "round2"), ["r1", "r2"]   # twice that
    drop_table(half)
    covered, undecided = _level(now.withColumn("wanted", F.lit(True)), keys, unit.across)
    drop_table(now)
    for step in unit.steps:
        split = cut(_split(rows, undecided, unit, step), "split")
        now = cut(_again(split, ["core"], unit.across), "again")
        drop_table(split)
        more, undecided = _level(now, ["core"], unit.across)
        drop_table(now)
        covered = covered.union(more)
    return covered


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """key (of :func:`row_key`), spans: the byte ranges [start, end) of each document that repeated
    passages cover, merged and in order; only documents that have any."""
    if not 96 <= length <= 1000:
        raise ValueError("length must lie between 96 and 1000 bytes")
    rows = docs.select(row_key(id_col, text_col).alias("id"), F.col(text_col).alias("_text"))
    all_ = _repeated(rows, Unit(False, length, 24, (16, 1), False))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for places in batch.column(1).to_pylist():
                a = np.array([(p["lo"], p["hi"]) for p in places], np.int64)
                a = a[np.lexsort((a[:, 1], a[:, 0]))]
                end = np.maximum.accumulate(a[:, 1] + length)
                new = np.append(True, a[1:, 0] > end[:-1])
                last = np.append(np.flatnonzero(new)[1:], len(a)) - 1
                out.append([{"a": int(s), "b": int(e)} for s, e in zip(a[new, 0], end[last])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["id", "spans"])

    return all_.groupBy("id").agg(F.collect_list(F.struct("lo", "hi")).alias("places")).mapInArrow(merge, "id long, spans array<struct<a:int,b:int>>").withColumnRenamed("id", "key")


def sharing(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """key (of :func:`row_key`) of every document that shares a passage of ``words`` words or more with
    another one; only these."""
    if not 12 <= words <= 1000:
        raise ValueError("words must lie between 12 and 1000")
    rows = docs.select(row_key(id_col, text_col).alias("id"), F.col(text_col).alias("_text"))
    return _repeated(rows, Unit(True, words, 4, (1,), True)).select(F.col("id").alias("key")).distinct()


def _with_spans(docs: DataFrame, id_col: str, text_col: str, length: int, words: int | None = None) -> DataFrame:
    """id, _text, spans, shares of every row."""
    found = spans(docs, id_col, text_col, length)
    if words:
        found = found.join(sharing(docs, id_col, text_col, words).withColumn("shares", F.lit(True)), "key", "full")
    else:
        found = found.withColumn("shares", F.lit(None).cast("boolean"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("_text"), row_key(id_col, text_col).alias("key"))
    return beside(rows, cut(found, "spans"), "key", 12, "spans", "left").select("id", "_text", "spans", F.coalesce("shares", F.lit(False)).alias("shares"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, words: int = WORDS) -> DataFrame:
    """One row per document: id, n_bytes, n_removed, n_spans, kept_sha256, shares_passage (whether it
    shares a passage of ``words`` words or more with another document, however few bytes that are).

    Defined cases: a null text is empty; texts shorter than ``length`` lose nothing; equal documents
    lose all that their windows cover, each of them; rows that repeat an identifier and its text
    count as two places but as one document; rows that repeat an identifier with another text are
    documents of their own; rows with a null identifier are documents like others; an empty table
    gives an empty one; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat_bytes(batch.column(1))
            removed, count, sha = [], [], []
            for i, own in enumerate(batch.column(2).to_pylist()):
                text = data[off[i]: off[i + 1]]
                digest, at, gone = hashlib.sha256(), 0, 0
                for s in own or []:
                    digest.update(text[at: s["a"]].tobytes())
                    at = s["b"]
                    gone += s["b"] - s["a"]
                digest.update(text[at:].tobytes())
                removed.append(gone), count.append(len(own or [])), sha.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(off)), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), batch.column(3)],
                names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "shares_passage"])

    return _with_spans(docs, id_col, text_col, length, words).mapInArrow(
        run, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shares_passage boolean")


def kept_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id, kept (binary): the bytes that remain of each document. A cut may fall inside a character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat_bytes(batch.column(1))
            out = []
            for i, own in enumerate(batch.column(2).to_pylist()):
                text, at, parts = data[off[i]: off[i + 1]], 0, []
                for s in own or []:
                    parts.append(text[at: s["a"]].tobytes())
                    at = s["b"]
                out.append(b"".join([*parts, text[at:].tobytes()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=[id_col, "kept"])

    return _with_spans(docs, id_col, text_col, length).mapInArrow(run, f"`{id_col}` long, kept binary")
