"""Operator 11: conversation structure repair over a bidirectional tight-arc graph.

A conversation's rows are steps of a small automaton: nothing, or one system row and then pairs of user
and assistant rows. Nodes are (rows consumed, state), arcs are the edits. Minimum costs forward from
the start and backward from the accepting ends mark the tight arcs, those on some cheapest path; a
traversal of the frontier set then follows the tight arcs of the least letter, which gives the
least of all cheapest edit sequences.

Spark does everything around that: rows are ordered by a range sort over all conversations, so a long one
lies in many partitions; first occurrences are grouped minima; rows become one-letter codes, joined to blocks
of at most 65536 before they meet their conversation. One task holds one byte a row of a conversation, as
its edit sequence, one value of the result, does too; texts never meet but in the digest, which streams them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a. What a kept initial leads to, and
#: the state and edit letters an inserted or renamed row leads to (its role is forced by the state).
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FORCED = (USER, USER, ASSISTANT, USER)
INITIALS = "sua"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLOCK = 16
_STRETCH = 4096
_FAR = 1 << 60


def _code(at: int) -> tuple[str, int]:
    """The initial ('' for others) and the fault (0 none, 1 truncated, 2 must go) of a code letter."""
    return (INITIALS + " ")[at // 3].strip(), at % 3


_ARCS = []  # by code: (letter, from, to, cost) of the edits that consume the row
for _k in range(12):
    _initial, _fault = _code(_k)
    _arcs = [("D", q, q, DELETE) for q in range(4)]
    if _fault < 2:
        _arcs += [("K", q, STEP[q, _initial], TRUNCATED * _fault) for q in range(4) if (q, _initial) in STEP]
        _arcs += [("R", q, FORCED[q], REROLE + TRUNCATED * _fault) for q in range(4)]
    _ARCS.append(_arcs)


def _forward(now: list[int], code: int | None) -> list[int]:
    """Minimum costs after a row (None: before the first), insertions included."""
    out = [_FAR] * 4
    if code is None:
        out = list(now)
    else:
        for _, a, b, cost in _ARCS[code]:
            out[b] = min(out[b], now[a] + cost)
    out[USER] = min(out[USER], out[START] + INSERT, out[SYSTEM] + INSERT, out[ASSISTANT] + INSERT)
    out[ASSISTANT] = min(out[ASSISTANT], out[USER] + INSERT)
    return out


def _backward(after: list[int], code: int | None) -> list[int]:
    """Minimum costs from before a row to an end (None: behind the last row)."""
    out = [_FAR] * 4
    if code is None:
        out = list(after)
    else:
        for _, a, b, cost in _ARCS[code]:
            out[a] = min(out[a], after[b] + cost)
    out[USER], out[ASSISTANT] = min(out[USER], out[ASSISTANT] + INSERT), min(out[ASSISTANT], out[USER] + INSERT)
    out[START], out[SYSTEM] = min(out[START], out[USER] + INSERT), min(out[SYSTEM], out[USER] + INSERT)
    return out


def least_edits(codes: str) -> tuple[int, list[str]]:
    """Cost and edits of one conversation: a string for each row, that row's letter after those of the rows
    inserted before it (the last row's also has what follows). Letters: K, D, U and A for renamed rows,
    u and a for inserted ones. Backward costs are kept for every 4096th row and recomputed between."""
    row = [ord(c) - 97 for c in codes]
    n = len(row)
    if not n:
        return 0, []
    marks = {n: _backward([0, _FAR, _FAR, 0], None)}
    back = marks[n]
    for i in range(n - 1, -1, -1):
        back = _backward(back, row[i])
        if i % _STRETCH == 0:
            marks[i] = back
    total = back[START]
    forward = _forward([0, _FAR, _FAR, _FAR], None)
    frontier, edits = {START}, []
    for low in range(0, n, _STRETCH):
        high = min(low + _STRETCH, n)
        backs = [marks[high]]
        for i in range(high - 1, low - 1, -1):
            backs.append(_backward(backs[-1], row[i]))
        for i in range(low, high):
            after, here = backs[high - i - 1], backs[high - i]
            done, letter = "", "I"
            while letter == "I":
                tight = [(x, b) for x, a, b, cost in _ARCS[row[i]] if a in frontier and forward[a] + cost + after[b] == total]
                tight += [("I", FORCED[q]) for q in frontier if forward[q] + INSERT + here[FORCED[q]] == total]
                letter = min(tight)[0]
                frontier = {b for x, b in tight if x == letter}
                done += _written(letter, frontier)
            edits.append(done)
            forward = _forward(forward, row[i])
    end = marks[n]
    while not any(end[q] == 0 for q in frontier):
        frontier = {FORCED[q] for q in frontier if forward[q] + INSERT + end[FORCED[q]] == total}
        edits[-1] += _written("I", frontier)
    return total, edits


def _written(letter: str, states: set[int]) -> str:
    """An edit's letter with the role it gives, which is the state behind it."""
    if letter not in "IR":
        return letter
    role = "a" if ASSISTANT in states else "u"
    return role if letter == "I" else role.upper()


def illegal(codes: str) -> int:
    """Adjacent pairs of initials other than su, ua and au."""
    said = [_code(ord(c) - 97)[0] for c in codes]
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(said, said[1:]))


def _ordered(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """The rows in a written table, ``_at`` ascending by conversation, turn (nulls first), role and text (by its
    first 64 characters, then a hash); equal rows are dealt by a salt, so they fill no partition alone."""
    blank = F.lit(" ")
    rows = turns.select(
        F.col(conv_col).alias("_c"), F.col(turn_col).alias("_t"), F.coalesce(F.col(role_col), blank).alias("_r"), F.coalesce(F.col(text_col), blank).alias("_x"),
        F.pmod(F.monotonically_increasing_id(), F.lit(64)).alias("_s"))
    rows = rows.withColumns({"_p": F.substring("_x", 1, 64), "_h": F.xxhash64("_x")})
    order = ["_c", F.asc_nulls_first("_t"), "_r", "_p", "_h", "_s"]
    last = F.regexp_extract("_x", r"(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    return cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "_c", "_t", "_r", "_x", F.monotonically_increasing_id().alias("_at"),
        F.unhex(F.sha2(F.concat(F.octet_length("_r").cast("string"), F.lit(":"), "_r", "_x"), 256)).alias("_k"),
        (last == "").alias("_blank"), (~last.isin(".", "!", "?")).alias("_open")), "turns")


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conversations, rows): one row per conversation with conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit; and the repaired rows with conv_id, at, part (their order), role, text.

    Defined cases: a null role or text is one space; rows of one turn are ordered by role and text; rows that
    repeat all of it are duplicates; a null identifier is a conversation of its own; an empty table
    gives two empty ones; other columns are ignored, whatever their names.
    """
    kind = turns.schema[conv_col].dataType.simpleString()
    placed = _ordered(turns, conv_col, turn_col, role_col, text_col)
    firsts = placed.where("not _blank").groupBy("_c", "_k").agg(F.min("_at").alias("_at")).select("_at", F.lit(True).alias("_first"))
    initial = F.array_position(F.array(*[F.lit(c) for c in INITIALS]), F.substring("_r", 1, 1))
    marks = placed.select("_c", "_t", "_at", "_blank", "_open", F.when(initial == 0, len(INITIALS)).otherwise(initial - 1).alias("_i")).join(firsts, "_at", "left").select(
        "_c", "_t", "_at", "_i", F.when(F.col("_blank"), "blank").when(F.col("_first").isNull(), "duplicate").when(F.col("_open"), "truncated").alias("_fault"))
    marks = cut(marks.withColumn("_code", F.char(97 + 3 * F.col("_i") + F.when(F.col("_fault").isin("blank", "duplicate"), 2).when(F.col("_fault") == "truncated", 1).otherwise(0))), "marks")
    counts = marks.groupBy("_c").agg(
        F.coalesce(F.max("_t") - F.min("_t") + 1 - F.count_distinct("_t"), F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(F.coalesce(F.col("_fault") == x, F.lit(False))).alias(x) for x in ("blank", "duplicate", "truncated")])
    blocks = marks.groupBy("_c", F.shiftright("_at", BLOCK).alias("_b")).agg(
        F.min("_at").alias("_from"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_code"))), lambda x: x["_code"]), "").alias("_codes"))
    whole = blocks.groupBy("_c").agg(F.array_sort(F.collect_list(F.struct("_from", "_codes"))).alias("_blocks")).select(
        "_c", F.col("_blocks._from").alias("_from"), F.col("_blocks._codes").alias("_codes"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for codes in batch.column(2):
                codes = codes.as_py()
                cost, edits = least_edits("".join(codes))
                ends = [0]
                for c in codes:
                    ends.append(ends[-1] + len(c))
                out[0].append(cost)
                out[1].append(illegal("".join(codes)))
                out[2].append(["".join(edits[a:b]) for a, b in zip(ends, ends[1:])])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *[pa.array(x, pa.int64()) for x in out[:2]], pa.array(out[2], pa.list_(pa.string()))],
                names=["_c", "_from", "cost", "illegal", "_edits"])

    solved = cut(whole.mapInArrow(solve, f"_c {kind}, _from array<long>, cost long, illegal long, _edits array<string>"), "repairs")
    audits = solved.select(F.col("_c").alias("_c2"), "cost", "illegal", F.translate(F.array_join("_edits", ""), "UAua", "RRII").alias("audit"))
    found = counts.join(audits, F.col("_c").eqNullSafe(F.col("_c2"))).select(
        F.col("_c").alias(conv_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    # every row's edits, found by its place: a row's letter with the insertions around it
    edits = solved.select(F.explode(F.arrays_zip("_from", "_edits")).alias("_b")).select(
        F.col("_b._from").alias("_from"), F.posexplode(F.regexp_extract_all(F.col("_b._edits"), F.lit(r"[ua]*[KDUA](?:[ua]+\z)?"), F.lit(0))).alias("_n", "_edit"))
    edits = edits.select((F.col("_from") + F.col("_n")).alias("_at"), "_edit").where("_edit <> 'D'")

    def made(c):
        role = F.when(F.lower(c) == "u", "user").when(F.lower(c) == "a", "assistant").otherwise(F.col("_r"))
        return F.struct(role.alias("role"), F.when(c.isin("u", "a"), "").otherwise(F.col("_x")).alias("text"))

    rows = placed.select("_c", "_r", "_x", "_at").join(edits, "_at").select(
        F.col("_c").alias(conv_col), F.col("_at").alias("at"),
        F.posexplode(F.transform(F.filter(F.split("_edit", ""), lambda c: ~c.isin("D", "")), made)).alias("part", "_made"))
    return found, rows.select(conv_col, "at", "part", "_made.role", "_made.text")


def digests(rows: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """SHA-256 of every conversation's ``role:text`` lines, as conv_id, repaired_sha256. A digest is over one
    sequence of bytes: one task reads a conversation's lines in order and holds none of them."""
    kind = rows.schema[conv_col].dataType.simpleString()
    lines = rows.select(F.col(conv_col).alias("_c"), "at", "part", F.concat("role", F.lit(":"), "text").cast("binary").alias("_line"))
    piece = 1 << 20  # a line is sent in pieces, so that a batch of long ones stays small
    lines = lines.select("_c", "at", "part", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.floor(F.octet_length("_line") / piece).cast("int")), lambda k: F.substring("_line", k * piece + 1, F.lit(piece)))).alias("_piece", "_bytes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, digest = None, None
        for batch in batches:
            done: list[list] = [[], []]
            for c, first, data in zip(batch.column(0), batch.column(1), batch.column(2)):
                c = c.as_py()
                if digest is None or c != open_:
                    if digest is not None:
                        done[0].append(open_)
                        done[1].append(digest.hexdigest())
                    open_, digest = c, hashlib.sha256()
                elif first.as_py():
                    digest.update(b"\n")
                digest.update(data.as_py())
            if done[0]:
                yield pa.RecordBatch.from_arrays([pa.array(done[0], batch.schema.field(0).type), pa.array(done[1], pa.string())], names=[conv_col, "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([open_], batch.schema.field(0).type), pa.array([digest.hexdigest()])], names=[conv_col, "repaired_sha256"])

    return lines.repartition("_c").sortWithinPartitions("_c", "at", "part", "_piece").select("_c", (F.col("_piece") == 0).alias("_first"), "_bytes").mapInArrow(
        run, f"`{conv_col}` {kind}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """The conversations damaged row by row, by crc32 of ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its
    text, 2 removes its ends of sentences, 3 repeats it, 4 sets the role user. Nulls of role and text are one space."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("_do"))
    return rows.where("_do <> 0").select(
        "conv_id", "turn", F.when(F.col("_do") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_do") == 1, "").when(F.col("_do") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("_do") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy")).drop("_copy")


def repaired(turns: DataFrame) -> DataFrame:
    """Damage, repair and digest of every conversation of ``turns``, those without rows after damage included."""
    found, rows = repair(damaged(turns))
    empty = hashlib.sha256(b"").hexdigest()
    found = found.withColumnRenamed("conv_id", "_found")
    hashes = digests(rows).withColumnRenamed("conv_id", "_hashed")
    every = turns.select("conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("_found")) & F.col("gaps").isNotNull(), "left").join(
        hashes, F.col("conv_id").eqNullSafe(F.col("_hashed")) & F.col("repaired_sha256").isNotNull(), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
