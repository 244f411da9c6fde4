"""Operator 7: near-duplicates by b-bit MinHash.

Every text's distinct word shingles are hashed; minima under PERMS random functions give band
keys (candidates) and, cut to their low bits and packed, a signature whose differing bits give a
collision-corrected estimate of similarity. Candidates that the estimate leaves possible are
confirmed on the full shingle sets.

Texts with the same shingle set are one class from the start. In a bucket, members are compared
with one central member first; only members that this leaves in another component than the bucket's
main one are compared with the rest of the bucket, in blocks: signatures first, and the full sets of
those that signatures leave possible. A pair is judged in the first bucket that it shares. So no
bucket is capped, copies are never expanded to pairs, texts of different buckets never meet, and no
link between components that any bucket holds is left untried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, cut, flat_bytes, mix, prefix_hash, row_key, span_hash, release, trim, with_ids, words_of
from tidemark.llm.tokens import by_bytes

PERMS = 125          # random functions
ROWS = 5             # of a band; 25 bands miss a pair at 0.85 with 4e-7, at 0.8 with 5e-5
BITS = 4             # kept of a minimum
SIGMAS = 5           # standard errors of the estimate that a candidate may lie below the threshold
HOT = 512            # members from which a bucket is salted
BLOCK = 128          # stragglers of a bucket compared in one task
OTHERS = 4096        # members they are compared with in one task
SET_BLOCK, SET_OTHERS = 64, 512   # the same where the full sets are there

_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(0, 1 << 63, PERMS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, PERMS, dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's n-word shingles, A-Z lowered; a text of fewer
    words has its whole sequence as one, a text without words none."""
    low = _LOWER[data]
    begins, stops, first = words_of(low, off)
    h, down = prefix_hash(low)
    word = span_hash(h, down, begins, stops)
    roll = np.zeros(max(0, len(word) - n + 1), np.uint64)
    for k in range(n):
        roll = mix(roll * np.uint64(31) + word[k: len(word) - n + 1 + k])
    out = []
    for i in range(len(off) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= n:
            s = np.sort(roll[a: b - n + 1])
            keep = np.ones(len(s), bool)
            keep[1:] = s[1:] != s[:-1]
            out.append(s[keep])
        elif b > a:
            v = np.zeros(1, np.uint64)
            for w in word[a:b]:
                v = mix(v * np.uint64(31) + w)
            out.append(mix(v ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(s: np.ndarray) -> np.ndarray:
    """The minima of a non-empty set under the random functions."""
    best = np.full(PERMS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 512):
        best = np.minimum(best, (s[i: i + 512, None] * _A + _B).min(0))
    return best


def bands(m: np.ndarray) -> np.ndarray:
    """Band keys: a hash of each ROWS minima, band number included."""
    g = m.reshape(-1, ROWS)
    h = np.arange(1, len(g) + 1, dtype=np.uint64)
    for k in range(ROWS):
        h = mix(h * np.uint64(31) + g[:, k])
    return h.view(np.int64)


def pack_bits(m: np.ndarray) -> bytes:
    """The low BITS bits of the minima (mixed first), BITS times PERMS bits packed."""
    low = (mix(m) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return np.packbits(np.unpackbits(low[:, None], axis=1, count=BITS, bitorder="little")).tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of packed signatures (rows of uint8) from equal groups of bits, corrected for
    the groups that are equal by chance."""
    x = a ^ b
    x |= x >> 2
    x |= x >> 1                      # the lowest bit of each group of four says whether any differs
    differ = np.bitwise_count(x & np.uint8(0x11)).sum(-1, dtype=np.int64)
    chance = 1 / (1 << BITS)
    return (1 - differ / PERMS - chance) / (1 - chance)


def _floor(threshold: float) -> float:
    """The lowest estimate of a pair at the threshold, SIGMAS standard errors below it."""
    chance = 1 / (1 << BITS)
    p = threshold + (1 - threshold) * chance
    return threshold - SIGMAS * (p * (1 - p) / PERMS) ** 0.5 / (1 - chance)


def _signed(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """id, row (its :func:`row_key`), n (set size), fp (the set's 128-bit fingerprint; null for an empty set), bands, sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, off = flat_bytes(batch.column(2))
            for i, j in by_bytes(off):
                sets = shingle_sets(data[off[i]: off[j]], off[i: j + 1] - off[i], n)
                fps, keys, sigs = [], [], []
                for s in sets:
                    if not len(s):
                        fps.append(None), keys.append(None), sigs.append(None)
                        continue
                    m = minima(s)
                    fps.append(np.array([mix(s).sum(), mix(s ^ _A[0]).sum(), np.uint64(len(s))], np.uint64).tobytes())
                    keys.append(bands(m))
                    sigs.append(pack_bits(m))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps, pa.binary()),
                     pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())], names=["id", "row", "n", "fp", "bands", "sig"])
            trim()

    return docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("_text")).mapInArrow(
        run, "id long, row long, n long, fp binary, bands array<long>, sig binary")


def _sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, set) of the rows with these keys, the set as sorted 64-bit integers in bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            data, off = flat_bytes(batch.column(1))
            for i, j in by_bytes(off):
                sets = shingle_sets(data[off[i]: off[j]], off[i: j + 1] - off[i], n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set"])
            trim()

    rows = docs.select(row_key(id_col, text_col).alias("id"), F.col(text_col).alias("_text"))
    return with_ids(rows, ids, "id").mapInArrow(run, "id long, set binary").dropDuplicates(["id"])


def _possible(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, sa, sb) whose signatures leave the threshold possible."""
    low = _floor(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for k in (2, 3))
            yield batch.select([0, 1]).filter(pa.array(estimate(a, b) >= low))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                ok.append(_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    left, right = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _blocks(members: DataFrame, group: str, block: int, others: int) -> DataFrame:
    """Members (group, a, comp, ...) of groups with more than one component, dealt to blocks
    (group, i, j): those outside the group's largest component (odd) in parts i, and all members in
    parts j, so that every pair across components meets in one block."""
    size = members.groupBy(group, "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = size.groupBy(group).agg(F.count(F.lit(1)).alias("comps"), F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top")).where("comps > 1")
    mixed = cut(mixed.select(group, F.col("top.comp").alias("main"), F.ceil((F.col("n") - F.col("top.n")) / block).cast("int").alias("parts"),
                             F.ceil(F.col("n") / others).cast("int").alias("rest")), "mixed")
    columns = members.columns
    own = members.join(mixed, group)
    h = F.xxhash64("a")
    odd = own.where("comp <> main").select(*columns, F.lit(True).alias("odd"), F.pmod(h, F.col("parts")).cast("int").alias("i"), F.explode(F.expr("sequence(0, rest - 1)")).alias("j"))
    all_ = own.select(*columns, F.lit(False).alias("odd"), F.explode(F.expr("sequence(0, parts - 1)")).alias("i"), F.pmod(h, F.col("rest")).cast("int").alias("j"))
    # groups are small in bytes but not in work: a count of partitions keeps them spread
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return odd.union(all_).repartition(parts, group, "i", "j")


def _across(pdf: pd.DataFrame, low: float) -> Iterator[tuple[int, np.ndarray, pd.DataFrame, pd.DataFrame]]:
    """(row of the odd side, rows of the other, both sides) whose signatures leave a link between
    components possible and whose first common band is this bucket's."""
    left, right = pdf[pdf.odd], pdf[~pdf.odd]
    if not len(left) or not len(right):
        return
    sig = [np.frombuffer(b"".join(x.sig), np.uint8).reshape(len(x), -1) for x in (left, right)]
    band = [np.stack(x.bands.to_list()) for x in (left, right)]
    comp = [x.comp.to_numpy() for x in (left, right)]
    key = pdf.key.iat[0]
    step = max(1, (1 << 22) // sig[1].size)
    for at in range(0, len(left), step):
        possible = (estimate(sig[0][at: at + step, None], sig[1]) >= low) & (comp[0][at: at + step, None] != comp[1])
        for k in np.flatnonzero(possible.any(1)):
            near = np.flatnonzero(possible[k])
            same = band[1][near] == band[0][at + k]
            near = near[band[0][at + k][same.argmax(1)] == key]
            if len(near):
                yield at + int(k), near, left, right


def _open(members: DataFrame, threshold: float) -> DataFrame:
    """(key, a): members of buckets that may link with members of other components there.

    ``members``: key, a (class), comp, sig, bands.
    """
    low = _floor(threshold)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [np.append(right.a.to_numpy()[near], left.a.iat[k]) for k, near, left, right in _across(pdf, low)]
        found = np.unique(np.concatenate(got)) if got else np.zeros(0, np.int64)
        return pd.DataFrame({"key": np.full(len(found), pdf.key.iat[0]), "a": found})

    return _blocks(members, "key", BLOCK, OTHERS).groupBy("key", "i", "j").applyInPandas(compare, "key long, a long").distinct()


def _links_across(members: DataFrame, threshold: float, percent: int) -> DataFrame:
    """Confirmed links (a, b) between components that a bucket holds, found by comparing every
    possible pair's full sets in blocks; of links between the same components a block gives one.

    ``members``: key, a, comp, sig, bands, set.
    """
    low = _floor(threshold)

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        got = []
        parent: dict[int, int] = {}

        def root(v: int) -> int:
            while parent.setdefault(v, v) != v:
                parent[v] = v = parent[parent[v]]
            return v

        for k, near, left, right in _across(pdf, low):
            a, c, x = int(left.a.iat[k]), int(left.comp.iat[k]), np.frombuffer(left.set.iat[k], np.uint64)
            for j in near.tolist():
                other = int(right.comp.iat[j])
                if root(c) != root(other) and _similar(x, np.frombuffer(right.set.iat[j], np.uint64), percent):
                    parent[root(c)] = root(other)
                    got.append((a, int(right.a.iat[j])))
        return pd.DataFrame(got, columns=["a", "b"], dtype="int64")

    return _blocks(members, "key", SET_BLOCK, SET_OTHERS).groupBy("key", "i", "j").applyInPandas(compare, "a long, b long")


def _similar(u: np.ndarray, v: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(u), len(v)) < percent * max(len(u), len(v)):
        return False
    both = np.concatenate([u, v])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(u) + len(v) - common)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept, row_key (of its identifier and text).

    Documents are linked at ``percent`` hundredths of Jaccard similarity of their sets of ``n``-word
    shingles; component_id is the smallest identifier reachable. Defined cases: texts without words
    (null, empty, blank) have no shingles and stay alone; rows that repeat an identifier and text
    share their result, rows that repeat an identifier with another text are documents of their own;
    rows with a null identifier are linked with nothing and kept; a text of any length is taken whole, with
    some 60 bytes of arrays for each of its bytes beyond a slice; an empty table gives an empty one; other
    columns are ignored.
    """
    threshold = percent / 100
    signed = cut(_signed(docs, id_col, text_col, n), "signed")
    some = signed.where("fp is not null and id is not null")  # null identifiers are linked with nothing
    classes = cut(some.groupBy("fp").agg(F.min("row").alias("a"), F.min("id").alias("least"), F.first("bands").alias("bands"), F.first("sig").alias("sig")), "classes")
    each = classes.select("a", "sig", F.explode("bands").alias("key"))
    # salted from the start: the count of a bucket is pre-aggregated
    count = cut(each.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")
    member = cut(with_keys(each, count), "members")                         # key, a, sig, n
    weight = member.groupBy("a").agg(F.sum("n").alias("w"))
    heads = (member.join(weight, "a").groupBy("key", "n").agg(F.max(F.struct("w", (-F.col("a")).alias("m"), "sig")).alias("h"))
             .select("key", "n", (-F.col("h.m")).alias("b"), F.col("h.sig").alias("sb")))
    salt = F.when(F.col("n") > HOT, F.pmod(F.xxhash64("a"), F.lit(64))).otherwise(0).cast("int")
    spread = F.explode(F.when(F.col("n") > HOT, F.sequence(F.lit(0), F.lit(63))).otherwise(F.array(F.lit(0))))
    tried = member.withColumn("salt", salt).join(heads.withColumn("salt", spread).drop("n"), ["key", "salt"]).where("a <> b").select(
        "a", "b", F.col("sig").alias("sa"), "sb").dropDuplicates(["a", "b"])
    pairs = cut(_possible(tried, threshold), "pairs")
    ids = cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ids")
    sets = cut(_sets(docs, ids, id_col, text_col, n), "sets")
    links = cut(_confirmed(pairs, sets, percent), "links")
    found = cut(components(links), "comps")

    # what the central members did not join; a bucket of two is decided by then
    own = classes.join(found.select(F.col("node").alias("a"), "root"), "a", "left").select("a", "sig", "bands", F.coalesce("root", "a").alias("comp"))
    now = member.where("n > 2").select("key", "a").join(own, "a")
    open_ = cut(_open(now, threshold), "open")
    if open_.limit(1).count():
        ids2 = cut(open_.select(F.col("a").alias("id")).distinct(), "ids")
        sets2 = cut(_sets(docs, ids2, id_col, text_col, n), "sets").withColumnRenamed("id", "a")
        more = _links_across(open_.join(own, "a").join(sets2, "a").select("key", "a", "comp", "sig", "bands", "set"), threshold, percent)
        links = cut(links.union(more), "links")
        found = cut(components(links), "comps")

    # classes are known by one row's key; components by their smallest identifier
    joined = classes.join(found.select(F.col("node").alias("a"), "root"), "a", "left").select("fp", "least", F.coalesce("root", "a").alias("comp"))
    roots = cut(joined.select("fp", "comp").join(joined.groupBy("comp").agg(F.min("least").alias("root")), "comp").select("fp", "root"), "roots")
    return signed.join(roots, "fp", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component_id"),
        F.coalesce(F.coalesce("root", "id") == F.col("id"), F.lit(True)).alias("kept"), F.col("row").alias("row_key"))


def with_keys(each: DataFrame, count: DataFrame) -> DataFrame:
    """Rows of the buckets in ``count``, with the bucket's size."""
    return each.join(F.broadcast(count) if count.count() <= 500_000 else count, "key")
