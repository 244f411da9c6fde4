"""Operator 9: toxic passages as maximum-scoring segments.

Token log-odds between toxic and other training texts, shrunk by an informative Dirichlet prior
(the pooled counts), are the scores of a text's tokens; a linear-time scan finds all maximal
scoring segments (every significant passage), and extreme-value statistics turn the best scores
of a text of any length into a number that a two-parameter logistic maps to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import flat_bytes, prefix_hash, span_hash
from tidemark.llm.quality import held_out, labelled, score_texts
from tidemark.llm.tokens import by_bytes

SAMPLE = 20_000     # labelled rows that a fit uses at most: those of smallest hash
PRIOR = 20.0        # weight of the prior, in texts
MIN_Z = 3.0         # a token's log-odds count from this many standard errors
MIN_ODDS = 1.5      # and from this size, so that neutral text scores below 0 on average
MIN_TEXTS = 4       # texts that a token must occur in
STEMS = (4, 5, 6, 7, 8)  # bytes of the word beginnings that are tokens too
DRIFT = -0.15       # score of a neutral token

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PART = np.zeros(256, bool)          # bytes of words: ASCII letters and all of other characters
_PART[65:91] = _PART[97:123] = _PART[128:] = True


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and of their beginnings (0: too short), word starts and ends, and each
    text's first word. Accented Latin capitals are lowered with the ASCII ones."""
    low = _LOWER[data]
    if len(low) > 1:
        up = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        low[up] += 0x20
    part = _PART[data]
    begin, end = part.copy(), np.zeros(len(data) + 1, bool)
    begin[1:] &= ~part[:-1]
    end[1:] = part
    end[1:-1] &= ~part[1:]
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    edge = edge[part[edge] & part[edge - 1]]
    begin[edge] = end[edge] = True
    a, b = np.flatnonzero(begin), np.flatnonzero(end)
    h, down = prefix_hash(low)
    out = [span_hash(h, down, a, b)]
    for n in STEMS:
        stem = np.zeros(len(a), np.uint64)
        long = b - a > n
        stem[long] = span_hash(h, down, a[long], a[long] + n) ^ np.uint64(n)
        out.append(stem)
    return out, a, b, np.searchsorted(a, off)


def distinct(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The distinct token hashes of each text."""
    hashes, _, _, first = tokens(data, off)
    return [np.unique(np.concatenate([h[first[i]: first[i + 1]] for h in hashes])) for i in range(len(off) - 1)]


def log_odds(hashes: np.ndarray, toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> tuple[np.ndarray, np.ndarray]:
    """Significant tokens (sorted hashes) and their log-odds, from the numbers of toxic and other
    texts with the token; the Dirichlet prior is the pooled rate, weighing PRIOR texts."""
    pooled = (toxic + other) / max(1, n_toxic + n_other) * PRIOR
    t, o = toxic + pooled, other + pooled
    nt, no = n_toxic + PRIOR, n_other + PRIOR
    t, o = np.maximum(t, 1e-9), np.maximum(o, 1e-9)
    value = np.log(t / np.maximum(nt - t, 0.5)) - np.log(o / np.maximum(no - o, 0.5))
    z = value / np.sqrt(1 / t + 1 / o)
    use = (np.abs(z) >= MIN_Z) & (np.abs(value) >= MIN_ODDS) & (toxic + other >= MIN_TEXTS) & (hashes != 0)
    order = np.argsort(hashes[use])
    return hashes[use][order], value[use][order]


def maximal_segments(scores: np.ndarray, where: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, first, last position) of a sequence that is ``scores``
    at positions ``where`` and DRIFT elsewhere, in time linear in the positive positions: the
    stack keeps candidates with their left and right prefix sums, and a new one absorbs back to
    the last candidate with a smaller left sum."""
    stack: list[list[float]] = []       # left sum, right sum, first, last
    total, last = 0.0, -1
    for s, i in zip(scores.tolist(), where.tolist()):
        total += DRIFT * (i - last - 1)
        last = i
        if s <= 0:
            total += s
            continue
        new = [total, total + s, i, i]
        total += s
        while True:
            k = len(stack) - 1
            while k >= 0 and stack[k][0] >= new[0]:
                k -= 1
            if k < 0 or stack[k][1] >= new[1]:
                stack.append(new)
                break
            new = [stack[k][0], new[1], stack[k][2], i]
            del stack[k:]
    return [(r - l, int(a), int(b)) for l, r, a, b in stack]


@dataclass
class Toxicity:
    hashes: np.ndarray
    value: np.ndarray
    rate: float            # lambda of the extreme-value law
    weights: np.ndarray    # logistic over measure()'s columns
    centre: np.ndarray
    scale: np.ndarray

    def of_tokens(self, hashes: list[np.ndarray]) -> np.ndarray:
        """A word's score: its own log-odds, or the strongest of its beginnings, or DRIFT."""
        best = np.full(len(hashes[0]), np.nan)
        if len(self.hashes):
            for h in hashes:
                at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                v = np.where(self.hashes[at] == h, self.value[at], np.nan)
                best = np.fmax(best, v) if h is not hashes[0] else v
        return np.where(np.isnan(best), DRIFT, best + DRIFT)

    def segments(self, data: np.ndarray, off: np.ndarray) -> list[list[tuple[float, int, int]]]:
        """For each text its maximal segments: score, first and last byte."""
        hashes, a, b, first = tokens(data, off)
        value = self.of_tokens(hashes)
        marked = value != DRIFT
        out = []
        for i in range(len(off) - 1):
            lo, hi = first[i], first[i + 1]
            at = np.flatnonzero(marked[lo:hi])
            got = maximal_segments(value[lo:hi][at], at) if len(at) else []
            out.append([(s, int(a[lo + x] - off[i]), int(b[lo + y] - off[i])) for s, x, y in got])
        return out

    def measure(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Per text: best segment's excess over what chance gives at this length (a Gumbel
        variate), the same of the sum of the best five, and the number of segments beyond it."""
        hashes, _, _, first = tokens(data, off)
        value = self.of_tokens(hashes)
        marked = value > 0
        both = value != DRIFT
        out = np.zeros((len(off) - 1, 3))
        n_words = np.diff(first)
        hot = np.add.reduceat(marked, np.minimum(first[:-1], max(0, len(marked) - 1)), dtype=np.int64) if len(marked) else np.zeros(len(n_words), np.int64)
        for i in np.flatnonzero((n_words > 0) & (hot > 0)):
            lo, hi = first[i], first[i + 1]
            at = np.flatnonzero(both[lo:hi])
            scores = np.sort([s for s, _, _ in maximal_segments(value[lo:hi][at], at)])[::-1]
            if not len(scores):
                continue
            chance = np.log(n_words[i] + 1) / self.rate
            out[i] = scores[0] * self.rate, np.log1p(np.maximum(0, scores - chance).sum()), scores[0] - chance
        return out

    def score(self, m: np.ndarray) -> np.ndarray:
        x = np.concatenate([np.ones((len(m), 1)), (m - self.centre) / self.scale], 1)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _gumbel(value: np.ndarray, chance: np.ndarray) -> float:
    """The positive root of mean exp(lambda * score) = 1 over the words of a neutral text, in which
    a token of log-odds ``value`` is met with ``chance`` and all others score DRIFT: the rate at
    which the chance of a high segment score falls."""
    if not (value > 0).any():
        return 1.0
    rest = max(0.0, 1 - chance.sum())
    lo, hi = 1e-3, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        mean = rest * np.exp(mid * DRIFT) + (chance * np.exp(np.minimum(mid * (value + DRIFT), 600))).sum()
        lo, hi = (mid, hi) if mean < 1 else (lo, mid)
    return max(lo, 1e-2)


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", training: Column | None = None) -> Toxicity:
    """Fit on at most SAMPLE labelled rows. The executors send each text's distinct tokens and its
    marked words; texts of the bounded sample come to the driver as token hashes only."""
    training = held_out(id_col, 5, 0, False) if training is None else training
    rows = labelled(docs, labels, label, id_col, text_col, training, SAMPLE)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # counts of this partition's texts by token and class
        for batch in batches:
            data, off = flat_bytes(batch.column(0))
            y = batch.column(1).to_numpy()
            for i, j in by_bytes(off):
                sets = distinct(data[off[i]: off[j]], off[i: j + 1] - off[i])
                half = np.array([int(s[:64].sum() & np.uint64(1)) if len(s) else 0 for s in sets])
                sizes = [len(s) for s in sets]
                all_ = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                code = np.repeat(y[i:j] + 2 * half, sizes)
                yield pa.RecordBatch.from_pydict({"h": all_.view(np.int64), "c": pa.array(code, pa.int32()), "w": np.zeros(len(all_), np.int64)})
                words = np.diff(tokens(data[off[i]: off[j]], off[i: j + 1] - off[i])[3])
                yield pa.RecordBatch.from_pydict({"h": np.zeros(j - i, np.int64), "c": pa.array(y[i:j] + 2 * half, pa.int32()), "w": words})

    counts = (rows.mapInArrow(gather, "h long, c int, w long").groupBy("h")
              .agg(*[F.count_if(F.col("c") == k).alias(f"c{k}") for k in range(4)], F.sum(F.when(F.col("c") % 2 == 0, F.col("w"))).alias("w"))
              .where(f"c0 + c1 + c2 + c3 >= {MIN_TEXTS} or h = 0").toArrow())
    h = counts.column("h").to_numpy().view(np.uint64)
    c = np.stack([counts.column(f"c{k}").to_numpy() for k in range(4)], 1).astype(float)
    totals = c[h == 0].sum(0) if (h == 0).any() else np.zeros(4)
    n, nt = totals.sum(), totals[1] + totals[3]
    rate0 = (nt + 0.5) / (n + 1)
    blank = (np.zeros(3), np.ones(3))
    if n == 0 or nt in (0, n):
        return Toxicity(np.zeros(0, np.uint64), np.zeros(0), 1.0, np.array([np.log(rate0 / (1 - rate0)), 0, 0, 0]), *blank)
    words = float(counts.column("w").to_numpy()[h == 0].sum())   # of the other class
    h, c = h[h != 0], c[h != 0]
    # each half's tokens measure the other half; all texts give the final table
    tables = [log_odds(h, c[:, 2 * k + 1], c[:, 2 * k], int(totals[2 * k + 1]), int(totals[2 * k])) for k in (0, 1)]
    whole = log_odds(h, c[:, 1] + c[:, 3], c[:, 0] + c[:, 2], int(nt), int(n - nt))
    at = np.searchsorted(whole[0], h)
    hit = (at < len(whole[0])) & (whole[0][np.minimum(at, len(whole[0]) - 1)] == h) if len(whole[0]) else np.zeros(len(h), bool)
    neutral = np.zeros(len(whole[0]))
    neutral[at[hit]] = (c[hit, 0] + c[hit, 2] + 0.5) / max(words, 1.0)
    rate = _gumbel(whole[1], neutral)
    halves = [Toxicity(*t, rate, np.zeros(4), *blank) for t in tables]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat_bytes(batch.column(0))
            for i, j in by_bytes(off):
                own, ends = data[off[i]: off[j]], off[i: j + 1] - off[i]
                half = np.array([int(s[:64].sum() & np.uint64(1)) if len(s) else 0 for s in distinct(own, ends)])
                m = np.where((half == 0)[:, None], halves[1].measure(own, ends), halves[0].measure(own, ends))
                yield pa.RecordBatch.from_pydict({"m": pa.array(list(m), pa.list_(pa.float64())), "y": batch.column(1).slice(i, j - i)})

    got = rows.mapInArrow(measure, "m array<double>, y int").toArrow()
    m = np.array(got.column("m").to_pylist(), float).reshape(-1, 3)
    y = got.column("y").to_numpy().astype(float)
    order = np.lexsort((*m.T, y))
    m, y = m[order], y[order]
    centre, scale = m.mean(0), np.maximum(m.std(0), 1e-6)
    w = _logistic(np.concatenate([np.ones((len(m), 1)), (m - centre) / scale], 1), y)
    return Toxicity(*whole, rate, w, centre, scale)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted.

    Labels are learnt only from rows whose crc32(id as text) mod 5 is not 0. Defined cases: null
    texts are empty and get the score of a text without any segment; without training labels
    the score is 0.5; repeated rows are scored alike; a text of any length is scanned whole, with some 100
    bytes of arrays for each of its bytes beyond a slice; an empty table gives an empty one; other columns
    are ignored.
    """
    model = fit_toxicity(docs, labels, id_col, text_col)
    got = score_texts(docs, model, id_col, text_col, model.measure)
    return got.select(id_col, held_out(id_col, 5, 0, True).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxic_passages(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", significance: float = 0.01) -> DataFrame:
    """Every significant passage: id, start and end byte, score, p_value (chance of as good a
    segment in a neutral text of this length)."""
    model = fit_toxicity(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    kind = rows.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = flat_bytes(batch.column(1))
            pick, out = [], []
            for i, j in by_bytes(off):
                for k, got in enumerate(model.segments(data[off[i]: off[j]], off[i: j + 1] - off[i]), i):
                    n = max(1, int(off[k + 1] - off[k]) // 6)
                    for s, a, b in got:
                        p = float(-np.expm1(-n * np.exp(-model.rate * s)))
                        if p <= significance:
                            pick.append(k)
                            out.append((a, b, s, p))
            cols = list(zip(*out)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(pick, pa.int64())), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())],
                names=[id_col, "start", "end", "score", "p_value"])

    return rows.mapInArrow(run, f"`{id_col}` {kind}, start long, end long, score double, p_value double")
