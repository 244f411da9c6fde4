"""Operator 4: packing token sequences by vector bin packing.

Every example is a vector (tokens, one segment, loss-bearing tokens). A bin is filled by the
dot-product rule: of a bounded pool of waiting pieces, the one whose scaled vector has the largest
dot product with what the bin has left is placed, until none fits; what is still free is filled by
cutting a waiting piece. Work is local to an input partition and needs a bounded pool, so it scales
with partitions and a lost task repeats alone. The last, partly filled bin of a partition is cut
into powers of two, which are not padded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import flat_bytes, trim
from tidemark.llm.tokens import Segmented

TOKENS = 2048      # of a sequence
SEGMENTS = 256     # pieces of a sequence
LOSS = 2048        # loss-bearing tokens of a sequence
POOL = 256         # pieces that wait
END_ID = 1         # appended to every document


class Packer:
    """Fills bins from a stream of pieces; yields (sequence number, [(key, start, ids, loss from)]).

    A piece's tokens before ``free`` (counted from its example's start) bear no loss.
    """

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, pool: int = POOL):
        self.cap = np.array([tokens, segments, loss], np.float64)
        self.size = pool
        self.items: list[tuple] = []                      # (key, start, ids, free)
        self.need = np.zeros((pool + 1, 3))
        self.out: list[list[tuple]] = []

    @staticmethod
    def _loss(start: int, n: int, free: int) -> int:
        return max(0, start + n - max(start, free))

    def _vector(self, item: tuple) -> tuple[float, float, float]:
        return len(item[2]), 1, self._loss(item[1], len(item[2]), item[3])

    def _remove(self, i: int) -> tuple:
        item, last = self.items[i], len(self.items) - 1
        self.items[i], self.need[i] = self.items[last], self.need[last]
        self.items.pop()
        return item

    def _put(self, item: tuple) -> None:
        self.need[len(self.items)] = self._vector(item)
        self.items.append(item)

    def _part(self, item: tuple, left: np.ndarray) -> int:
        """How many leading tokens of a piece fit into what is left."""
        key, start, ids, free = item
        plain = min(max(0, free - start), len(ids))
        return int(min(len(ids), left[0], plain + left[2]))

    def fill(self) -> None:
        """Close one bin."""
        left, got = self.cap.copy(), []
        while self.items and left[0] > 0 and left[1] > 0:
            need = self.need[: len(self.items)]
            fits = (need <= left).all(1)
            if fits.any():
                score = np.where(fits, (need / self.cap) @ (left / self.cap), -1.0)
                i = int(score.argmax())
                item = self._remove(i)
            else:
                i = int(need[:, 0].argmax())
                n = self._part(self.items[i], left)
                if n <= 0:
                    break
                whole = self._remove(i)
                item = (whole[0], whole[1], whole[2][:n], whole[3])
                self._put((whole[0], whole[1] + n, whole[2][n:], whole[3]))
            got.append(item)
            left -= self._vector(item)
        if not got:  # an example that can never fit beside these limits
            raise ValueError("a limit of the packing is below one token")
        self.out.append(got)

    def add(self, key, ids: np.ndarray, free: int = 0) -> None:
        whole = int(min(self.cap[0], self.cap[2]))
        start = 0
        while len(ids) - start >= whole:      # full sequences need no partner
            self.out.append([(key, start, ids[start: start + whole], free)])
            start += whole
        if start < len(ids):
            self._put((key, start, ids[start:].copy(), free))
            if len(self.items) >= self.size:
                self.fill()

    def finish(self) -> None:
        while self.items:
            self.fill()
        if self.out and sum(len(p[2]) for p in self.out[-1]) < self.cap[0]:
            self._halves(self.out.pop())

    def _halves(self, pieces: list[tuple]) -> None:
        """Cut a partly filled sequence into sequences of powers of two."""
        while rest := sum(len(p[2]) for p in pieces):
            room, got = 1 << (rest.bit_length() - 1), []
            while room:
                key, start, ids, free = pieces.pop(0)
                n = min(room, len(ids))
                got.append((key, start, ids[:n], free))
                if n < len(ids):
                    pieces.insert(0, (key, start + n, ids[n:], free))
                room -= n
            self.out.append(got)

    def take(self) -> list[list[tuple]]:
        out, self.out = self.out, []
        return out


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
    free_col: str | None = None, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    ``free_col`` names a column with the number of leading tokens that bear no loss (a prompt);
    without it all tokens bear loss. Defined cases: a null or empty text is the end id alone; rows
    that repeat an identifier are documents of their own; documents longer than a sequence are cut;
    an empty table gives an empty one; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Segmented.of(path, True)
        box, number = Packer(tokens, segments, loss), TaskContext.get().partitionId() << 32
        kind = None

        def rows(made: list[list[tuple]], kind) -> pa.RecordBatch:
            nonlocal number
            cols: list[list] = [[] for _ in range(8)]
            for pieces in made:
                offset = 0
                for (doc, total), start, ids, free in pieces:
                    n = len(ids)
                    for c, v in zip(cols, (doc, start, n, zlib.crc32(ids.astype("<u4").tobytes()), total, number, offset, Packer._loss(start, n, free))):
                        c.append(v)
                    offset += n
                number += 1
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], kind)] + [pa.array(c, pa.int64()) for c in cols[1:]],
                names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"])

        for batch in batches:
            kind = batch.schema.field(0).type
            names, free = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            data, off = flat_bytes(batch.column(1))
            for k, ids in coder.encode(data, off):
                own = np.append(ids, np.int32(end_id))
                box.add((names[k], len(own)), own, free[k] or 0)
                if len(box.out) >= 64:
                    yield rows(box.take(), kind)
            trim()
        box.finish()
        if box.out:
            yield rows(box.take(), kind)

    rows_in = docs.select(F.col(id_col), F.col(text_col).alias("_text"),
                          (F.col(free_col) if free_col else F.lit(0)).cast("long").alias("_free"))
    kind = rows_in.schema[0].dataType.simpleString()
    return rows_in.mapInArrow(
        run, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long")
