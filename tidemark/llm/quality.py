"""Operator 5: a generalised additive model with pairwise interactions for text quality.

Shape statistics of a text are binned; cyclic boosting visits the features in turn and adds a
shallow tree's steps to each feature's lookup table, then to the tables of the pairs that still
explain most. A score is the logistic of a sum of table entries, found for a whole batch by
indexing with bin numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import flat_bytes, mix, prefix_hash, span_hash, release, trim, words_of
from tidemark.llm.tokens import by_bytes

SAMPLE = 20_000   # labelled rows that a fit uses at most: those of smallest hash
BINS = 32         # of a feature
ROUNDS = 160      # cycles over the features
PAIRS = 8         # interactions kept
RATE = 0.15

FEATURES = (
    "log_words", "word_length", "upper", "digit", "bang", "symbols", "bars", "stops", "accents",
    "distinct_words", "same_as_last", "distinct_lines", "line_words", "short_words", "long_words",
    "top_word", "mixed_ends", "distinct_pairs",
)


def _runs(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of the values sorted by (text, value), and where a new value begins. Texts are
    numbered within a slice; 40 bits of a value are left, ample within one text."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (value >> np.uint64(24)))
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return (key >> np.uint64(40)).astype(np.int64), new


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text, all from whole texts; an empty text has zeros."""
    n = len(off) - 1
    out = np.zeros((n, len(FEATURES)))
    begins, stops, first = words_of(data, off)
    count = np.diff(first).astype(float)
    some, per = np.maximum(count, 1), np.maximum(np.diff(off).astype(float), 1)
    doc_of_word = np.repeat(np.arange(n), np.diff(first))

    full = np.flatnonzero(np.diff(off) > 0)

    def share(mask: np.ndarray) -> np.ndarray:
        total = np.zeros(n)
        if len(full):
            total[full] = np.add.reduceat(mask, off[:-1][full], dtype=np.int64)
        return total / per

    def of_words(values: np.ndarray) -> np.ndarray:
        return np.bincount(doc_of_word, values, n) / some

    kind = np.zeros(256, np.uint8)
    for k, chars in enumerate(("!", "#$%&*@^~=+_\\{}[]<>", "|", ".,;:?"), 1):
        kind[[ord(c) for c in chars]] = k
    of = kind[data]
    length = (stops - begins).astype(float)
    out[:, 0] = np.log1p(count)
    out[:, 1] = of_words(length)
    out[:, 2] = share((data >= 65) & (data <= 90))
    out[:, 3] = share((data >= 48) & (data <= 57))
    for k in range(1, 5):
        out[:, 3 + k] = share(of == k)
    out[:, 8] = share(data >= 0xC3)
    if len(begins):
        h, down = prefix_hash(data)
        word = span_hash(h, down, begins, stops)
        # distinct words, and the share of the commonest, by sorting (text, word)
        d, new = _runs(doc_of_word, word)
        out[:, 9] = np.bincount(d[new], minlength=n) / some
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(d)))
        top = np.zeros(n)
        np.maximum.at(top, d[at], times)
        out[:, 15] = top / some
        last = np.zeros(len(word), bool)
        last[1:] = (word[1:] == word[:-1]) & (doc_of_word[1:] == doc_of_word[:-1])
        out[:, 10] = of_words(last)
        pair = mix(word[:-1] * np.uint64(3) + word[1:]) if len(word) > 1 else word[:0]
        inside = doc_of_word[1:] == doc_of_word[:-1]
        pd, new = _runs(doc_of_word[1:][inside], pair[inside])
        out[:, 17] = np.bincount(pd[new], minlength=n) / np.maximum(np.bincount(pd, minlength=n), 1)
        out[:, 13] = of_words(length <= 3)
        out[:, 14] = of_words(length >= 12)
        end = of[stops - 1]
        out[:, 16] = of_words((end == 1) | (end == 2))
        # lines
        opens = np.zeros(len(data) + 1, bool)
        opens[1:] = data == 10
        opens[off[:-1]] = True
        ls = np.flatnonzero(opens[:-1])
        le = np.minimum(np.append(ls[1:], len(data)), len(data))
        doc_of_line = np.searchsorted(off, ls, "right") - 1
        line = span_hash(h, down, ls, le)
        d, new = _runs(doc_of_line, line)
        lines = np.maximum(np.bincount(doc_of_line, minlength=n), 1)
        out[:, 11] = np.bincount(d[new], minlength=n) / lines
        out[:, 12] = np.log1p(count / lines)
    return out


# ---------------------------------------------------------------------- model
@dataclass
class Gam:
    """Edges of the bins, one lookup table a feature, and pair tables."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], 1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            total += t[b[:, k]]
        for i, j, t in self.pairs:
            total += t[b[:, i] * PAIR_BINS // BINS, b[:, j] * PAIR_BINS // BINS]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


PAIR_BINS = 8


def _steps(g: np.ndarray, h: np.ndarray, depth: int, ridge: float = 1.0) -> np.ndarray:
    """Leaf values of a shallow tree over ordered bins, from gradient and curvature sums."""
    value = np.zeros(len(g))

    def split(lo: int, hi: int, left: int) -> None:
        cg, ch = np.cumsum(g[lo:hi]), np.cumsum(h[lo:hi])
        whole = cg[-1] ** 2 / (ch[-1] + ridge)
        if left and hi - lo > 1:
            gain = cg[:-1] ** 2 / (ch[:-1] + ridge) + (cg[-1] - cg[:-1]) ** 2 / (ch[-1] - ch[:-1] + ridge)
            at = int(gain.argmax())
            if gain[at] > whole + 1e-9:
                split(lo, lo + at + 1, left - 1)
                split(lo + at + 1, hi, left - 1)
                return
        value[lo:hi] = cg[-1] / (ch[-1] + ridge)

    split(0, len(g), depth)
    return value


def _steps2(g: np.ndarray, h: np.ndarray, depth: int, ridge: float = 5.0) -> np.ndarray:
    """Leaf values of a shallow tree over two ordered bins, which may split on either at every node,
    from gradient and curvature sums by cell."""
    value = np.zeros(g.shape)

    def split(rows: slice, cols: slice, left: int) -> None:
        own_g, own_h = g[rows, cols], h[rows, cols]
        whole_g, whole_h = own_g.sum(), own_h.sum()
        best = (whole_g ** 2 / (whole_h + ridge) + 1e-9, -1, -1)
        for axis in (0, 1) if left else ():
            cg, ch = np.cumsum(own_g.sum(1 - axis))[:-1], np.cumsum(own_h.sum(1 - axis))[:-1]
            if len(cg):
                gain = cg ** 2 / (ch + ridge) + (whole_g - cg) ** 2 / (whole_h - ch + ridge)
                if gain.max() > best[0]:
                    best = (float(gain.max()), axis, int(gain.argmax()) + 1)
        _, axis, at = best
        if axis == 0:
            split(slice(rows.start, rows.start + at), cols, left - 1)
            split(slice(rows.start + at, rows.stop), cols, left - 1)
        elif axis == 1:
            split(rows, slice(cols.start, cols.start + at), left - 1)
            split(rows, slice(cols.start + at, cols.stop), left - 1)
        else:
            value[rows, cols] = whole_g / (whole_h + ridge)

    split(slice(0, g.shape[0]), slice(0, g.shape[1]), depth)
    return value


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting: first every feature's table, then the strongest pairs' on what is left.
    Without rows, or with one class only, the model is that class's smoothed rate."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    edges = []
    for k in range(len(FEATURES)):
        q = np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0)
        edges.append(q)
    model = Gam(edges, [np.zeros(BINS) for _ in FEATURES], [], float(np.log(rate / (1 - rate))))
    if len(x) == 0 or y.min() == y.max():
        return model
    b = model.bins(x)
    margin = np.full(len(x), model.base)

    def residual() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for k in range(len(FEATURES)):
            r, h = residual()
            step = RATE * _steps(np.bincount(b[:, k], r, BINS), np.bincount(b[:, k], h, BINS), 2)
            model.tables[k] += step
            margin += step[b[:, k]]
    c = b * PAIR_BINS // BINS
    r, h = residual()
    gains = []
    for i in range(len(FEATURES)):
        for j in range(i):
            cell = c[:, i] * PAIR_BINS + c[:, j]
            g, hh = np.bincount(cell, r, PAIR_BINS**2), np.bincount(cell, h, PAIR_BINS**2)
            gains.append((float((g**2 / (hh + 5)).sum()), i, j))
    chosen = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    tables = {p: np.zeros(PAIR_BINS**2) for p in chosen}
    for _ in range(ROUNDS // 4):
        for i, j in chosen:
            r, h = residual()
            cell = c[:, i] * PAIR_BINS + c[:, j]
            g, hh = np.bincount(cell, r, PAIR_BINS**2), np.bincount(cell, h, PAIR_BINS**2)
            step = RATE * _steps2(g.reshape(PAIR_BINS, -1), hh.reshape(PAIR_BINS, -1), 3).ravel()
            tables[i, j] += step
            margin += step[cell]
    model.pairs = [(i, j, t.reshape(PAIR_BINS, PAIR_BINS)) for (i, j), t in tables.items()]
    return model


# -------------------------------------------------------------------- queries
def held_out(id_col: str, parts: int, part: int, within: bool) -> Column:
    """crc32 of the identifier as text, modulo ``parts``, is (not) ``part``."""
    rest = F.crc32(F.col(id_col).cast("string").cast("binary")) % parts
    return (rest == part) if within else (rest != part)


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, training: Column, bound: int) -> DataFrame:
    """(text, label) of at most ``bound`` labelled training rows: those whose id hashes lowest.
    Conflicting labels of one id: the largest counts. An id gives one row, however often it is repeated."""
    picked = (labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & training)
              .groupBy(id_col).agg(F.max(label).cast("int").alias("_label"))
              .orderBy(F.xxhash64(F.col(id_col)), id_col).limit(bound))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked.withColumnRenamed(id_col, "_id")), "_id")
    # of rows that repeat an identifier one counts: that of the smallest hash
    return rows.groupBy("_id").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"), F.first("_label").alias("_label")).select("_text", "_label")


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", training: Column | None = None) -> Gam:
    """Fit on at most SAMPLE labelled rows, whose feature rows (not texts) come to the driver."""
    training = held_out(id_col, 3, 1, False) if training is None else training
    rows = labelled(docs, labels, label, id_col, text_col, training, SAMPLE)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, off = flat_bytes(batch.column(0))
            for i, j in by_bytes(off):
                f = features(data[off[i]: off[j]], off[i: j + 1] - off[i])
                yield pa.RecordBatch.from_pydict({"f": pa.array(list(f), pa.list_(pa.float64())), "y": batch.column(1).slice(i, j - i)})

    got = rows.mapInArrow(measure, "f array<double>, y int").toArrow()
    x = np.array(got.column("f").to_pylist(), float).reshape(-1, len(FEATURES))
    y = got.column("y").to_numpy().astype(float)
    order = np.lexsort((*x.T, y))  # the fit does not depend on the order of arrival
    return fit(x[order], y[order])


def score_texts(docs: DataFrame, model, id_col: str, text_col: str, measure, extra: tuple[Column, ...] = ()) -> DataFrame:
    """id, [extra], score of every row by ``model.score(measure(bytes, offsets))``."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, off = flat_bytes(batch.column(1))
            out = np.zeros(len(off) - 1)
            for i, j in by_bytes(off):
                out[i:j] = model.score(measure(data[off[i]: off[j]], off[i: j + 1] - off[i]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=[id_col, "score"])
            trim()

    return rows.mapInArrow(run, f"`{id_col}` {kind}, score double")


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Labels are learnt only from rows whose crc32(id as text) mod 3 is not 1. Defined cases: null
    texts are empty and get the model's score of an empty text; rows without labels are scored
    like all others; without any training label the score is 0.5 and predicted 1; repeated rows
    are scored alike; a text of any length is measured whole, with some 100 bytes of arrays for each of its
    bytes beyond a slice; an empty table gives an empty one; other columns are ignored.
    """
    model = fit_quality(docs, labels, id_col=id_col, text_col=text_col)
    got = score_texts(docs, model, id_col, text_col, features)
    return got.select(id_col, held_out(id_col, 3, 1, True).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the model accepts, unchanged, filtered in the scan's own pass."""
    model = fit_quality(docs, labels, id_col=id_col, text_col=text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, off = flat_bytes(batch.column(at))
            keep = np.zeros(len(off) - 1, bool)
            for i, j in by_bytes(off):
                keep[i:j] = model.score(features(data[off[i]: off[j]], off[i: j + 1] - off[i])) >= threshold
            yield batch.filter(pa.array(keep))
            trim()

    return docs.mapInArrow(run, docs.schema)
