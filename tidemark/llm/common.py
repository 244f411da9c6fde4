"""Helpers the operators of this subpackage share: shared-folder tables, byte-level
text arrays for numpy, 64-bit hashing, and connected components.

Nothing here collects rows of a corpus to the driver.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's word: a run of characters that are none of space, \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"


# --------------------------------------------------------------------- tables
def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary one; a cluster without the
    setting is refused, as a machine-local folder there would be lost to other hosts.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "").partition("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="tidemark-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def cut(df: DataFrame, what: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost
    executor costs a reread instead of a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove a table that :func:`cut` wrote once nothing reads it any more."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def with_ids(df: DataFrame, ids: DataFrame, key: str, small: int = 1_000_000, how: str = "left_semi") -> DataFrame:
    """Join on ``key``; ``ids`` is broadcast only if it was counted at ``small`` rows or
    fewer (8-byte keys), and shuffled otherwise. ``ids`` should be a written table."""
    return df.join(F.broadcast(ids) if ids.count() <= small else ids, key, how)


def row_key(id_col: str, text_col: str) -> Column:
    """What tells rows apart: identifier and text. Identifiers may be null or used again."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def keep_rows(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, small: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` whose key (of :func:`row_key`) is in ``keys`` (a written table of one column). Of
    rows that repeat both identifier and text, one is kept, if they are asked for more than once."""
    (name,) = keys.columns
    repeated = keys.groupBy(name).count().where("count > 1").limit(1).count()
    chosen = keys.distinct()
    few = keys.count() <= small
    out = docs.join(F.broadcast(chosen) if few else chosen, row_key(id_col, text_col) == chosen[name], "left_semi")
    return out.dropDuplicates([id_col, text_col]) if repeated else out


# ----------------------------------------------------------------- byte arrays
def flat_bytes(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All texts of an Arrow string column as one uint8 array and int64 offsets; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    if isinstance(col, pa.ChunkedArray):  # no chunks at all
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    col = col.cast(pa.large_binary()).fill_null(b"")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64, n + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


_HELD: list[Callable[[], None]] = []


def hold(clear: Callable[[], None]) -> None:
    """Register what empties a worker's cache."""
    _HELD.append(clear)


def release(but: Callable[[], None] | None = None) -> None:
    """Empty the caches that an earlier operator left in this reused worker, ``but`` one."""
    for clear in _HELD:
        if clear != but:
            clear()
    trim()


def trim() -> None:
    """Give freed memory of this worker back to the system, where the C library can: workers are
    reused, and what one operator has freed would count beside what the next one needs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser on uint64, in place when it can be."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_ODD = 0x9E3779B97F4A7C15 | 1
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}
hold(_POW.clear)


def _powers(n: int, base: int = _ODD) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i < n, kept and grown."""
    have = _POW.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inv = pow(base, -1, 1 << 64)
        out = []
        for b in (base, inv):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POW[base] = (out[0], out[1])
    return have


def prefix_hash(data: np.ndarray, base: int = _ODD) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of scrambled bytes (or of 64-bit values) times powers of an odd base, modulo
    2**64 (one longer than ``data``), and the inverse powers; see :func:`span_hash`."""
    value = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(base))[data] if data.dtype == np.uint8 else data
    up, down = _powers(len(data) + 1, base)
    h = np.empty(len(data) + 1, np.uint64)
    h[0] = 0
    np.cumsum(value * up[: len(data)], out=h[1:])
    return h, down


def span_hash(h: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes [start, end) from :func:`prefix_hash`; position-independent."""
    return mix((h[end] - h[start]) * down[start])


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the contract's words, and for each text the index of its first
    word (one longer than the texts). Words never cross texts."""
    n = len(data)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begin, end = solid.copy(), np.zeros(n + 1, bool)
    begin[1:] &= ~solid[:-1]
    end[1:] = solid
    end[1:-1] &= ~solid[1:]
    # a text that begins with a word right after a text that ends with one
    edge = off[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    edge = edge[solid[edge] & solid[edge - 1]]
    begin[edge] = end[edge] = True
    begins, stops = np.flatnonzero(begin), np.flatnonzero(end)
    return begins, stops, np.searchsorted(begins, off)


# ------------------------------------------------------------------ components
def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an edge table (a, b: long) by alternating large-star and
    small-star contraction; returns (node, root) for every node that has an edge, root being
    the smallest node reachable.

    Each round is two grouped minima and joins on the node (hubs are split by adaptive skew
    joins; the minima are pre-aggregated), and ends in a written table. Nothing is collected
    but one count a round.
    """
    both = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    now = cut(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(rounds):
        # large star: every larger neighbour of a node links to the smallest of the node's neighbourhood
        sym = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sym.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = sym.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every smaller neighbour, and the node, link to the smallest
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        new = cut(small, "edges")
        # stable once every node has one parent that itself has none
        roots = new.select(F.col("b").alias("a")).distinct()
        left = new.join(roots, "a", "left_semi").limit(1).count()
        multi = new.groupBy("a").count().where("count > 1").limit(1).count()
        drop_table(now) if now.inputFiles() else None
        now = new
        if not left and not multi:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
