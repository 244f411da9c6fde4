"""Operator 10: near-duplicate embeddings by dual traversal of cover trees.

Unit vectors with cosine at least t are within sqrt(2 - 2t) of each other. The upper level deals
vectors to the nearest of a set of pivots that grows with the input, some CHUNK vectors each; a cell
that is still too large is dealt again to pivots of its own, and so on. A cell's tree has nested
levels whose radii halve. Pairs of cells, and within them pairs of nodes, are dropped when their
centres are farther apart than both covering radii and the threshold distance; pairs of nodes that
remain descend a level. What reaches single vectors is decided by the cosine in double precision.

Equal vectors are one class from the start and are only counted, never expanded into pairs. Where
unrelated vectors lie in high dimension no two cells are far apart, and the pairs of cells grow with
the square of the input, as those of every exact method do; then a row is sent once for each CHUNK
vectors of the input, as single-precision numbers where the input has them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import components, cut, drop_table, release

PIVOTS = 4096         # upper-level centres at most; larger inputs take further levels
CHUNK = 8192          # vectors of a cell, about; cells of twice as many are dealt again
LEAST = 1024          # the same where the whole input is a few cells
HELD = 200_000        # links of two chunks before they are folded
DEALT = 65_536        # vectors of a cell that one task deals again
DEPTH = 6             # levels of dealing; what is still too large then is closer than any of them tells apart
LEAF = 512            # vectors of a node from which its centres are compared directly
LEVELS = (1.0, 0.5, 0.25, 0.125, 0.0625)


def margin(dim: int) -> np.float32:
    """Above the rounding of a cosine of unit vectors in single precision: a sum of ``dim`` products
    is off by at most dim + 2 units of rounding (6e-8 each)."""
    return np.float32((dim + 16) * 1.2e-7)


class Tree:
    """Nested levels over unit vectors: every node is (row numbers, centre row, covering radius,
    children); a node's radius is the largest distance of its rows from its centre, its first row."""

    def __init__(self, x: np.ndarray, paths: np.ndarray | None = None):
        """``paths``: for rows in the tree's order, each row's child number by level (-1: no more)."""
        self.x, self.low, self.margin = x, x.astype(np.float32), margin(x.shape[1])
        self.paths = np.full((len(x), len(LEVELS)), -1, np.int32) if paths is None else paths
        self.order: list[np.ndarray] = []
        self.root = self._grow(np.arange(len(x)), 0) if paths is None else self._read(np.arange(len(x)), 0)

    def _radius(self, rows: np.ndarray) -> float:
        if len(rows) == 1:
            return 0.0
        far = np.sqrt(np.maximum(0, 2 - 2 * (self.x[rows] @ self.x[rows[0]])))
        return float(far.max())

    def _grow(self, rows: np.ndarray, level: int):
        """Greedy cover: the next uncovered row opens a node and takes all within the level's radius."""
        radius = self._radius(rows)
        if len(rows) == 1 or radius == 0.0 or level == len(LEVELS):
            self.order.append(rows)
            return rows, rows[0], radius, []
        cover, left, children = 1 - LEVELS[level] ** 2 / 2, rows, []
        while len(left):
            batch = left[:LEAF]
            near = self.low[batch] @ self.low[batch].T >= cover
            taken, centres = np.zeros(len(batch), bool), []
            for i in range(len(batch)):
                if not taken[i]:
                    centres.append(i)
                    taken |= near[i]
            sim = self.low[left] @ self.low[batch[centres]].T
            best = sim.argmax(1)
            inside = sim[np.arange(len(left)), best] >= cover
            inside[centres] = True
            best[centres] = np.arange(len(centres))
            at = np.flatnonzero(inside)
            at = at[np.argsort(best[at], kind="stable")]
            own = np.split(left[at], np.searchsorted(best[at], np.arange(1, len(centres))))
            for c, o in zip(batch[centres], own):
                children.append(o if o[0] == c else np.concatenate([[c], o[o != c]]))
            left = left[~inside]
        nodes = []
        for k, c in enumerate(children):
            self.paths[c, level] = k
            nodes.append(self._grow(c, level + 1))
        return rows, rows[0], radius, nodes

    def _read(self, rows: np.ndarray, level: int):
        """The same nodes again from rows in tree order and their paths."""
        if len(rows) == 1 or level == len(LEVELS) or self.paths[rows[0], level] < 0:
            return rows, rows[0], self._radius(rows), []
        k = self.paths[rows, level]
        ends = np.append(np.flatnonzero(k[1:] != k[:-1]) + 1, len(rows))
        nodes, lo = [], 0
        for hi in ends.tolist():
            nodes.append((rows[lo:hi], rows[lo], 0.0, []) if hi - lo == 1 else self._read(rows[lo:hi], level + 1))
            lo = hi
        return rows, rows[0], self._radius(rows), nodes


def dual(a: Tree, b: Tree, t: float, same: bool):
    """Row pairs (i of a, j of b) with cosine >= t, in arrays; each pair once if ``same``.

    Bounds are taken in single precision with a margin above its rounding, and as cosines, so that
    a node pair costs one product; only the decision about two vectors is in double precision.
    """
    reach = float(np.sqrt(2 - 2 * t))
    todo = [([a.root], [b.root])]
    while todo:
        left, right = todo.pop()
        ca, cb = np.array([n[1] for n in left]), np.array([n[1] for n in right])
        ra, rb = np.array([n[2] for n in left], np.float32), np.array([n[2] for n in right], np.float32)
        one_a, one_b = np.array([len(n[0]) == 1 for n in left]), np.array([len(n[0]) == 1 for n in right])
        # single vectors against single vectors need the cosine itself, the strictest bound; only
        # pairs with a node that holds more look at radii
        for mine, theirs in ((one_a, one_b), (~one_a, one_b), (one_a, ~one_b), (~one_a, ~one_b)):
            p, q = np.flatnonzero(mine), np.flatnonzero(theirs)
            if not len(p) or not len(q):
                continue
            columns = b.low[cb[q]].T
            alone = mine is one_a and theirs is one_b
            for s in range(0, len(p), 1024):
                rows = p[s: s + 1024]
                sim = a.low[ca[rows]] @ columns
                if alone:
                    bound = np.float32(t) - a.margin
                else:
                    far = np.minimum(np.float32(2), ra[rows, None] + rb[q] + np.float32(reach))
                    bound = 1 - far * far / 2 - a.margin
                i, j = np.nonzero(sim >= bound)
                i, j = rows[i], q[j]
                if alone:
                    if len(i):
                        yield _decide(a, b, ca[i], cb[j], t, same)
                    continue
                # a node against single vectors is one product; nodes against nodes descend
                if theirs is one_b:
                    for n, lo, hi in _runs(i):
                        yield from _direct(a, b, left[n][0], cb[j[lo:hi]], t, same)
                elif mine is one_a:
                    order = np.argsort(j, kind="stable")
                    for n, lo, hi in _runs(j[order]):
                        yield from _direct(a, b, ca[i[order[lo:hi]]], right[n][0], t, same)
                else:
                    yield from _descend(a, b, left, right, i, j, t, same, todo)


def _runs(v: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of the runs of a sorted array."""
    if not len(v):
        return []
    at = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    return list(zip(v[at].tolist(), at.tolist(), np.append(at[1:], len(v)).tolist()))


def _direct(a: Tree, b: Tree, x: np.ndarray, y: np.ndarray, t: float, same: bool):
    """Links between rows x of a and y of b, all compared."""
    for r in range(0, len(x), 1024):
        u, v = np.nonzero(a.low[x[r: r + 1024]] @ b.low[y].T >= t - a.margin)
        if len(u):
            yield _decide(a, b, x[r + u], y[v], t, same)


def _descend(a: Tree, b: Tree, left: list, right: list, i: np.ndarray, j: np.ndarray, t: float, same: bool, todo: list):
    """Node pairs (i of left, j of right) that may hold links: compared directly if small, else left
    to their children."""
    for n, lo, hi in _runs(i):
        node, few = left[n], [right[q] for q in j[lo:hi]]
        if len(node[0]) * sum(len(f[0]) for f in few) > LEAF * LEAF and (node[3] or any(f[3] for f in few)):
            todo.append((node[3] or [node], [k for f in few for k in (f[3] or [f])]))
        else:
            yield from _direct(a, b, node[0], np.concatenate([f[0] for f in few]), t, same)


def _decide(a: Tree, b: Tree, i: np.ndarray, j: np.ndarray, t: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    if same:
        keep = i < j
        i, j = i[keep], j[keep]
    out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for s in range(0, len(i), 100_000):
        p, q = i[s: s + 100_000], j[s: s + 100_000]
        ok = np.einsum("ij,ij->i", a.x[p], b.x[q]) >= t
        out[0].append(p[ok]), out[1].append(q[ok])
    return np.concatenate(out[0]), np.concatenate(out[1])


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component, after the links (i, j) are added to those of ``root``."""
    i, j = root[i], root[j]
    while True:
        low = np.minimum(root[i], root[j])
        old = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        np.minimum.at(root, old[i], low)
        np.minimum.at(root, old[j], low)
        root = root[root]
        if (root == old).all():
            return root


def _clean(col: pa.Array) -> tuple[list[bytes | None], np.dtype]:
    """Vectors as bytes, None for those that link with nothing: single-precision ones as they are,
    others scaled to unit length in double precision."""
    single = pa.types.is_float32(col.type.value_type)
    out: list[bytes | None] = []
    for v in col.to_pylist():
        x = np.array([np.nan if y is None else y for y in v], np.float32 if single else float) if v else np.array([np.nan])
        size = np.abs(x).max()
        if not np.isfinite(x).all() or size == 0:
            out.append(None)
        else:
            out.append(x.tobytes() if single else (x / size / np.sqrt(((x / size) ** 2).sum())).tobytes())
    return out, np.dtype(np.float32 if single else float)


def _units(rows, kind: np.dtype) -> np.ndarray:
    """Unit vectors in double precision, one a row; each row's bits depend on that row alone."""
    x = np.frombuffer(b"".join(rows), kind).reshape(len(rows), -1).astype(float)
    if kind == np.float32:
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of every row, and the distance to it."""
    best, far = np.zeros(len(x), np.int64), np.zeros(len(x))
    for i in range(0, len(x), 4096):
        sim = x[i: i + 4096] @ centres.T
        best[i: i + 4096] = sim.argmax(1)
        far[i: i + 4096] = np.sqrt(np.maximum(0, 2 - 2 * sim.max(1)))
    return best, far


def _dealt(classes: DataFrame, n: int, chunk: int, kind: np.dtype) -> DataFrame:
    """``classes`` with cell (the class that is its pivot) and far (the distance to it), no cell
    above twice ``chunk`` unless DEPTH levels cannot tell its vectors apart. Pivots are those of
    smallest hash, the same at every run."""
    spark = classes.sparkSession
    columns = "a long, copies long, dim int, unit binary"
    wanted = min(PIVOTS, -(-3 * n // (2 * chunk)))
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    picked = classes.orderBy(F.xxhash64("a"), "a").limit(wanted).select("a", "dim", "unit").collect()
    for d in {r.dim for r in picked}:
        own = [r for r in picked if r.dim == d]
        by_dim[d] = np.array([r.a for r in own]), _units([bytes(r.unit) for r in own], kind)
    shared = spark.sparkContext.broadcast(by_dim)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            # vectors of a length that no pivot has are a cell of their own
            dims = batch.column("dim").to_numpy()
            cell, far = np.iinfo(np.int64).min + dims.astype(np.int64), np.full(batch.num_rows, 2.0)
            units = batch.column("unit").to_pylist()
            for d in np.unique(dims):
                if d in shared.value:
                    at = np.flatnonzero(dims == d)
                    names, centres = shared.value[d]
                    best, far[at] = _nearest(_units([units[i] for i in at], kind), centres)
                    cell[at] = names[best]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("a", "copies", "dim", "unit")), pa.array(cell), pa.array(far)],
                                             names=["a", "copies", "dim", "unit", "cell", "far"])

    now = cut(classes.select("a", "copies", "dim", "unit").mapInArrow(deal, f"{columns}, cell long, far double"), "dealt")

    def again(key: tuple, rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        if len(rows) and len(pivots):
            best, far = _nearest(_units(list(rows.unit), kind), _units(list(pivots.centre), kind))
            rows = rows.assign(cell=pivots["pivot"].to_numpy()[best], far=far)
        return rows[["a", "copies", "dim", "unit", "cell", "far"]]

    for level in range(1, DEPTH):
        large = cut(now.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(f"n > {2 * chunk}"), "large")
        many = large.count()
        if not many:
            break
        held = now.join(F.broadcast(large) if many <= 100_000 else large, "cell")
        # a pivot for two thirds of a chunk, about: one class in so many, by hash
        drawn = held.where(F.pmod(F.xxhash64("a", F.lit(level)), F.lit(2 * chunk // 3)) == 0)
        parts = F.ceil(F.col("n") / DEALT).cast("int")
        left = held.withColumn("part", F.pmod(F.xxhash64("a"), parts).cast("int")).drop("n")
        right = drawn.select(F.col("a").alias("pivot"), F.col("unit").alias("centre"), F.col("cell").alias("of"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("at"))
        split = left.groupBy("cell", "part").cogroup(right.groupBy("of", "at")).applyInPandas(again, f"{columns}, cell long, far double")
        rest = now.join(F.broadcast(large) if many <= 100_000 else large, "cell", "left_anti").select(*now.columns)
        new = cut(rest.union(split.select(*now.columns)), "dealt")
        drop_table(now)
        now = new
    return now


def _near_cells(cells: DataFrame, reach: float, kind: np.dtype, block: int = 2048) -> DataFrame:
    """(p, q), p <= q: cells (cell, dim, unit, radius) that may hold links, compared in blocks."""
    n = cells.count()
    parts = -(-n // block)
    dealt = cells.withColumn("part", F.pmod(F.xxhash64("cell"), F.lit(parts)).cast("int"))
    places = F.expr(f"transform(sequence(0, {parts - 1}), k -> struct(least(part, k) as i, greatest(part, k) as j))")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf.i.iat[0]), int(pdf.j.iat[0])
        out = []
        for _, own in pdf.groupby("dim"):
            x, y = own[own.part == i], own[own.part == j]
            if not len(x) or not len(y):
                continue
            u, v = _units(list(x.unit), kind), _units(list(y.unit), kind)
            close = np.sqrt(np.maximum(0, 2 - 2 * (u @ v.T))) <= x.radius.to_numpy()[:, None] + y.radius.to_numpy() + reach
            close |= (x.radius.to_numpy()[:, None] >= 2) | (y.radius.to_numpy() >= 2)
            k, m = np.nonzero(close)
            pairs = np.stack([x.cell.to_numpy()[k], y.cell.to_numpy()[m]], 1)
            out.append(pairs[pairs[:, 0] <= pairs[:, 1]] if i == j else np.sort(pairs, 1))
        return pd.DataFrame(np.concatenate(out) if out else np.zeros((0, 2), np.int64), columns=["p", "q"])

    return dealt.select("*", F.explode(places).alias("at")).select("*", "at.i", "at.j").drop("at").groupBy("i", "j").applyInPandas(compare, "p long, q long")


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with
    nothing; vectors of different length never link; repeated vectors link with each other; rows
    with a null identifier are linked with nothing; an empty table gives an empty one; other
    columns are ignored.
    """
    spark = rows.sparkSession
    single = rows.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = np.dtype(np.float32 if single else float)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_clean(batch.column(1))[0], pa.binary())], names=["id", "unit"])

    vectors = cut(rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).mapInArrow(
        clean, "id long, unit binary"), "units")
    good = vectors.where("unit is not null and id is not null")
    classes = cut(good.groupBy("unit").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("copies"))
                  .select("a", "copies", "unit", F.length("unit").alias("dim")), "classes")
    n = classes.count()
    if not n:
        return vectors.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    chunk = min(CHUNK, max(LEAST, n // 8))
    dealt = _dealt(classes, n, chunk, kind)
    reach = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    # a cell is a chunk; one that no pivots could divide is in parts of the same centre and radius
    sizes = cut(dealt.groupBy("cell", "dim").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("radius"))
                .select("*", F.ceil(F.col("n") / (2 * chunk)).cast("int").alias("parts")), "cells")
    centres = sizes.join(classes.select(F.col("a").alias("cell"), "unit"), "cell", "left")
    # a cell without a pivot has the largest radius, and any centre does
    centres = centres.select("cell", "dim", "radius", F.coalesce("unit", F.expr("cast(repeat('?', dim) as binary)")).alias("unit"))
    cell_pairs = _near_cells(centres, reach, kind)
    counted = sizes.select("cell", "parts")
    chunk_pairs = (cell_pairs.join(counted.withColumnRenamed("cell", "p").withColumnRenamed("parts", "pn"), "p")
                   .join(counted.withColumnRenamed("cell", "q").withColumnRenamed("parts", "qn"), "q")
                   .select("p", "q", "qn", F.explode(F.expr("sequence(0, pn - 1)")).alias("i"))
                   .select("p", "q", "i", F.explode(F.expr("sequence(0, qn - 1)")).alias("j")).where("p < q or i <= j"))
    pairs = cut(chunk_pairs, "chunk-pairs")
    n_pairs = pairs.count()
    both = pairs.select("*", F.col("p").alias("cell"), F.col("i").alias("part"), F.lit(True).alias("left")).union(
        pairs.where("p < q or i < j").select("*", F.col("q").alias("cell"), F.col("j").alias("part"), F.lit(False).alias("left")))
    placed = dealt.join(counted, "cell").select("a", "copies", "dim", "unit", "cell", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        """A chunk's tree, once: its rows in tree order with their paths."""
        pdf = pdf.sort_values("a", ignore_index=True)
        tree = Tree(_units(list(pdf.unit), kind))
        order = np.concatenate(tree.order)
        return pdf.iloc[order].assign(pos=np.arange(len(pdf), dtype=np.int32), path=[tree.paths[i].tobytes() for i in order])[["a", "copies", "unit", "cell", "part", "pos", "path"]]

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    trees = cut(placed.repartition(parts, "cell", "part").groupBy("cell", "part").applyInPandas(grow, "a long, copies long, unit binary, cell long, part int, pos int, path binary"), "trees")
    none = pd.DataFrame({"a": [], "links": [], "root": []}).astype("int64")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """(a, links, root): within these two chunks, links of each class by copies, and the smallest class of its component."""
        side = pdf.left.to_numpy()
        one = bool(side.all())
        pdf = pdf.iloc[np.lexsort((pdf.pos, ~side))]
        ids, copies, m = pdf.a.to_numpy(), pdf.copies.to_numpy(), int(side.sum())
        if not one and (m == 0 or m == len(ids)):
            return none
        x = _units(list(pdf.unit), kind)
        paths = np.frombuffer(b"".join(pdf.path), np.int32).reshape(len(pdf), -1)
        left = Tree(x[:m], paths[:m])
        right = left if one else Tree(x[m:], paths[m:])
        # links are folded into counts and components as they come, never kept beyond HELD
        links = np.zeros(len(ids), np.int64)
        rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        root, held = np.arange(len(ids)), []
        for i, j in dual(left, right, threshold, one):
            j = j if one else j + m
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            held.append((rank[i], rank[j]))
            if sum(len(k) for k, _ in held) > HELD:
                root, held = _joined(root, *map(np.concatenate, zip(*held))), []
        if held:
            root = _joined(root, *map(np.concatenate, zip(*held)))
        hit = links > 0
        return pd.DataFrame({"a": ids[hit], "links": links[hit], "root": np.sort(ids)[root[rank]][hit]})

    met = cut(trees.join(F.broadcast(both) if n_pairs <= 100_000 else both, ["cell", "part"])
              .repartition(max(1, min(n_pairs, 4096)), "p", "q", "i", "j").groupBy("p", "q", "i", "j").applyInPandas(compare, "a long, links long, root long"), "met")
    links = met.groupBy("a").agg(F.sum("links").alias("links"))
    roots = components(met.select("a", F.col("root").alias("b")))
    own = cut(classes.select("a", "unit", "copies").join(links, "a", "left").join(roots.select(F.col("node").alias("a"), "root"), "a", "left").select(
        "unit", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("root", "a").alias("root")), "own")
    return vectors.join(own, (vectors["unit"] == own["unit"]) & vectors["id"].isNotNull(), "left").select(
        F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("id").isNotNull(), F.coalesce("root", "id")).alias("component_id"),
        F.coalesce(F.coalesce("root", "id") == F.col("id"), F.lit(True)).alias("kept"))
