"""Operator 2: mixing sources to target weights.

The words of a source, in a fixed pseudorandom order of its documents, are cut into blocks of a
fixed length. Every output shard gets multinomial source counts (drawn under the condition that a
source's counts add up to its target); a source's slots map through the source's own
pseudorandom permutation of block numbers, and slots and blocks are joined by number. A
source that is taken more than once runs through its permutation again; the last slot is cut
short, so that a source's words meet its target to the word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, cut, flat_bytes, release, trim, words_of

BLOCK = 256          # words of a block
WEIGHTS = (5, 2, 1)  # of the sources by code point, repeating
CAP = 3              # a source's words are taken this many times at most
BUCKETS = 4096       # hash ranges of a source's document order, for prefix sums
SOURCES = 100_000    # up to which a row for each source is broadcast
SHARD_SLOTS = 65536  # slots of an output shard, about


# --------------------------------------------------------------- permutations
def _rounds(left: np.ndarray, right: np.ndarray, half: int, keys: list[int], back: bool):
    mask = np.uint64((1 << half) - 1)

    def f(x: np.ndarray, key: int) -> np.ndarray:
        x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return (x >> np.uint64(32)) & mask

    for key in reversed(keys) if back else keys:
        left, right = (right ^ f(left, key), left) if back else (right, left ^ f(right, key))
    return left, right


def permute(index: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """A pseudorandom permutation of range(n), or its inverse: a Feistel network on the next
    even power of two, walked until inside range(n)."""
    half = max(1, math.ceil(max(1, (n - 1).bit_length()) / 2))
    keys = [int(k) for k in np.random.default_rng([seed, n]).integers(1, 1 << 62, 6)]
    out = index.astype(np.uint64)
    todo = np.ones(len(out), bool)
    mask = np.uint64((1 << half) - 1)
    while todo.any():
        x = out[todo]
        left, right = _rounds(x >> np.uint64(half), x & mask, half, keys, back)
        out[todo] = (left << np.uint64(half)) | right
        todo = out >= np.uint64(n)
    return out.astype(np.int64)


# -------------------------------------------------------------------- targets
def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, share: float = 1.0) -> list[float]:
    """Words wanted of each source: shares of all sizes by weight, stopped at ``cap`` times a
    source's size, the excess shared again by weight until nothing is above."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    out: list[float] = [0.0] * len(sizes)
    free, left = set(range(len(sizes))), share * sum(sizes)
    while free:
        total = sum(w[i] for i in free)
        over = [i for i in sorted(free) if left * w[i] / total > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = float(cap * sizes[i])
        free -= set(over)
        left -= sum(out[i] for i in over)
    return out


def _plan(rank: int, size: int, target: float, seed: int, block: int) -> dict:
    """Blocks, slots and the words of the last, partial run through the permutation."""
    n, want = -(-size // block), min(int(round(target)), CAP * size)
    if not size or not want:
        return {"rank": rank, "n": n, "size": size, "slots": 0, "last": 0}
    passes, rest = divmod(want, size)
    slots, last = passes * n, 0
    if rest:
        short = size - (n - 1) * block
        at = int(permute(np.array([n - 1]), n, seed + rank, back=True)[0])  # the short block's place
        if rest <= at * block:
            m = -(-rest // block)
            last = rest - (m - 1) * block
        elif rest <= at * block + short:
            m, last = at + 1, rest - at * block
        else:
            beyond = rest - at * block - short
            k = -(-beyond // block)
            m, last = at + 1 + k, beyond - (k - 1) * block
        slots += m
    return {"rank": rank, "n": n, "size": size, "slots": slots, "last": last}


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    block: int = BLOCK, seed: int = 7,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, slots, pieces).

    documents: id, tie, size, rank, source_size, target, start (its first word in its source's
    stream). slots: shard, rank, slot, pass, block, words (what the slot takes of the block).
    pieces: id, tie, rank, start, size, block, lo, hi (word positions in the source's stream)
    of every document that has words.

    Defined cases: null and empty texts have size 0 and are never taken; a null source is a
    source of its own, last in order; a source without words has target 0; rows that repeat an
    identifier are documents of their own; other columns are ignored. The driver holds one row
    for each source, nothing of the documents.
    """
    spark = docs.sparkSession
    raw = cut(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tie")), "sizes")
    found = sorted(((r.source, r.s) for r in raw.groupBy("source").agg(F.sum("size").alias("s")).collect()),
                   key=lambda x: (x[0] is None, (x[0] or "").encode()))
    want = targets([s for _, s in found])
    plans = [_plan(i, s, t, seed, block) for i, ((_, s), t) in enumerate(zip(found, want))]
    names = spark.createDataFrame(
        [(name, i, s, t) for i, ((name, s), t) in enumerate(zip(found, want))],
        "source string, rank int, source_size long, target double")
    ranked = raw.join(F.broadcast(names) if len(found) <= SOURCES else names, raw["source"].eqNullSafe(names["source"])).select(
        "id", "tie", "size", "rank", "source_size", "target",
        F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int").alias("bucket"))
    sums = ranked.groupBy("rank", "bucket").agg(F.sum("size").alias("s"))
    before = sums.select("rank", "bucket", (F.sum("s").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("s")).alias("before"))
    inside = Window.partitionBy("rank", "bucket").orderBy("id", "tie", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranked.select("*", (F.sum("size").over(inside) - F.col("size")).alias("inside")).join(before.hint("merge"), ["rank", "bucket"]).select(
        "id", "tie", "size", "rank", "source_size", "target", (F.col("before") + F.col("inside")).alias("start"))

    slots_all = sum(p["slots"] for p in plans)
    shards = max(1, -(-slots_all // SHARD_SLOTS))
    by_rank = {p["rank"]: p for p in plans}

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # how many slots of a source each shard gets: multinomial, given their sum
        for batch in batches:
            for rank in batch.column("rank").to_pylist():
                p = by_rank[rank]
                count = np.random.default_rng([seed, rank, 1]).multinomial(p["slots"], np.full(shards, 1 / shards))
                end = np.cumsum(count)
                yield pa.RecordBatch.from_pydict({"rank": np.full(shards, rank, np.int32), "shard": np.arange(shards), "lo": end - count, "hi": end})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            rank, slot = batch.column("rank").to_numpy(), batch.column("slot").to_numpy()
            block_no, round_, words = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
            for r in np.unique(rank):
                p, at = by_rank[int(r)], rank == r
                b = permute(slot[at] % p["n"], p["n"], seed + int(r))
                take = np.where(b == p["n"] - 1, p["size"] - (p["n"] - 1) * block, block)
                if p["last"]:
                    take = np.where(slot[at] == p["slots"] - 1, p["last"], take)
                block_no[at], round_[at], words[at] = b, slot[at] // p["n"], take
            yield pa.RecordBatch.from_pydict({"rank": rank, "shard": batch.column("shard"), "slot": slot, "pass": round_, "block": block_no, "words": words})

    used = spark.createDataFrame([(p["rank"],) for p in plans if p["slots"]], "rank int")
    slots = (used.mapInArrow(draw, "rank int, shard long, lo long, hi long").where("hi > lo")
             .repartition("rank", "shard")
             .select("rank", "shard", F.explode(F.expr("sequence(lo, hi - 1)")).alias("slot"))
             .mapInArrow(place, "rank int, shard long, slot long, pass long, block long, words long"))
    pieces = placed.where("size > 0").select("*", F.explode(F.expr(f"sequence(start div {block}, (start + size - 1) div {block})")).alias("block")).select(
        "id", "tie", "rank", "start", "size", "block",
        F.greatest("start", F.col("block") * block).alias("lo"),
        F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block).alias("hi"))
    return placed, slots, pieces


def taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: id, size, source_size, target, taken (words of it that the mix
    holds, repeats counted); cases as in :func:`mix`."""
    placed, slots, pieces = mix(docs, id_col, text_col, source_col)
    # blocks grow with the corpus: never broadcast, whatever their size looks like after compression
    by_block = slots.groupBy("rank", "block").agg(F.collect_list("words").alias("take"))  # CAP numbers at most
    got = pieces.join(by_block.hint("merge"), ["rank", "block"], "left").groupBy("id", "tie", "rank", "start", "size").agg(
        F.sum(F.expr(f"coalesce(aggregate(take, 0L, (s, w) -> s + greatest(0L, least(hi, block * {BLOCK} + w) - lo)), 0L)")).alias("taken"))
    with_words = placed.where("size > 0").join(got.select("rank", "start", "taken"), ["rank", "start"])
    return with_words.select("id", "size", "source_size", "target", "taken").union(
        placed.where("size = 0").select("id", "size", "source_size", "target", F.lit(0).cast("long"))).withColumnRenamed("id", id_col)


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix as rows like ``docs``: for every run through a source, a row for each maximal
    stretch of a document's words that it takes (a document that is taken whole keeps its text
    as it is; a stretch keeps the white space between its words). Other columns are repeated;
    ``n_chars``, where there is one, is counted anew."""
    columns = docs.columns
    _, slots, pieces = mix(docs, id_col, text_col, source_col)
    took = pieces.join(slots.hint("merge"), ["rank", "block"]).select(
        "id", "tie", "rank", "start", "size", "pass", "lo",
        F.least("hi", F.col("block") * BLOCK + F.col("words")).alias("hi")).where("hi > lo")
    w = Window.partitionBy("rank", "start", "pass").orderBy("lo")
    runs = (took.select("*", F.coalesce((F.lag("hi").over(w) != F.col("lo")).cast("int"), F.lit(1)).alias("new"))
            .select("*", F.sum("new").over(w).alias("run"))
            .groupBy("id", "tie", "rank", "start", "size", "pass", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    spans = runs.groupBy("id", "tie", "rank", "start", "size").agg(
        F.array_sort(F.collect_list(F.struct("pass", (F.col("lo") - F.col("start")).alias("a"), (F.col("hi") - F.col("start")).alias("b")))).alias("_spans"))
    # rows that repeat both identifier and text are told apart by number; a row travels as a struct, so no
    # column of it clashes with those here
    again = Window.partitionBy("id", "tie", "src").orderBy(F.lit(1))
    left = docs.select(
        F.struct(*[docs[c] for c in columns]).alias("row"), docs[id_col].alias("id"), F.xxhash64(F.coalesce(docs[text_col], F.lit(""))).alias("tie"),
        F.xxhash64(docs[source_col]).alias("src")).select("*", F.row_number().over(again).alias("rep"))
    names = docs.select(docs[source_col].alias("s")).distinct().collect()
    order = sorted((r.s for r in names), key=lambda s: (s is None, (s or "").encode()))
    ranks = docs.sparkSession.createDataFrame([(s, i) for i, s in enumerate(order)], "s string, rank int").select("rank", F.xxhash64("s").alias("src"))
    spans = spans.join(F.broadcast(ranks) if len(order) <= SOURCES else ranks, "rank").select(
        F.col("id").alias("_id"), F.col("tie").alias("_tie"), F.col("src").alias("_src"), "_spans",
        F.row_number().over(Window.partitionBy("id", "tie", "rank").orderBy("start")).alias("_rep"))
    both = left.join(spans, F.col("id").eqNullSafe(F.col("_id")) & (F.col("tie") == F.col("_tie")) & (F.col("src") == F.col("_src")) & (F.col("rep") == F.col("_rep")))
    both = both.select(*[F.col("row").getField(c).alias(f"c{k}") for k, c in enumerate(columns)], F.col("_spans").alias("spans"))
    schema = docs.schema
    at = columns.index(text_col)
    count_at = columns.index("n_chars") if "n_chars" in columns else None

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            spans_ = batch.column(len(columns)).to_pylist()
            data, off = flat_bytes(batch.column(at))
            begins, stops, first = words_of(data, off)
            pick, texts = [], []
            for i, own in enumerate(spans_):
                n = first[i + 1] - first[i]
                for s in own:
                    if s["a"] == 0 and s["b"] == n:
                        lo, hi = off[i], off[i + 1]
                    else:
                        lo, hi = begins[first[i] + s["a"]], stops[first[i] + s["b"] - 1]
                    pick.append(i)
                    texts.append(data[lo:hi].tobytes().decode())
            out = [batch.column(k).take(pa.array(pick, pa.int64())) for k in range(len(columns))]
            out[at] = pa.array(texts, batch.schema.field(at).type)
            if count_at is not None:
                out[count_at] = pa.array([len(t) for t in texts], pa.int64()).cast(batch.schema.field(count_at).type)
            yield pa.RecordBatch.from_arrays(out, schema=pa.schema([batch.schema.field(k).with_name(c) for k, c in enumerate(columns)]))
            trim()

    return both.mapInArrow(emit, schema)
