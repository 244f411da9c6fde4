"""Operator 3: exact dedup by content sort, in DataFrame functions only.

Sampled splitters range-partition the normalised texts (by a bounded prefix, a content hash and
a salt, so splitters stay small and a group of copies with a third of all rows is spread over
``salts`` ranges); Spark's external sort places equal texts next to each other; the window over
the full text compares neighbours byte by byte and numbers each run. Runs of one text that lie
in different salts are then stitched by SHA-256 and length, on rows without texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, row_key


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    keep: str = "smallest",
    salts: int = 64,
    prefix: int = 64,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256, row_key (of its identifier and text).

    ``keep``: 'smallest' or 'largest' identifier of a group stays. Defined cases: a null text is
    the empty text; null identifiers lose to any other and are reported as null; of rows that
    repeat the kept identifier exactly one has kept = true; an empty table gives an empty one;
    other columns of ``docs`` are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    text = normalise(text) if normalise else text
    order = F.desc_nulls_last("_id") if keep == "largest" else F.asc_nulls_last("_id")
    best = F.max("_head") if keep == "largest" else F.min("_head")
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_t"), row_key(id_col, text_col).alias("_key")).select(
        "_id", "_t", "_key", F.substring("_t", 1, prefix).alias("_p"), F.xxhash64("_t").alias("_h"),
        F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int").alias("_salt"))
    run = Window.partitionBy("_p", "_h", "_salt", "_t")
    sorted_ = rows.repartitionByRange("_p", "_h", "_salt").select(
        "_id", "_salt", "_key", F.unhex(F.sha2("_t", 256)).alias("_sha"), F.octet_length("_t").alias("_n"),
        F.row_number().over(run.orderBy(order)).alias("_rn"),
        F.first("_id").over(run.orderBy(order)).alias("_head"),
        F.count(F.lit(1)).over(run).alias("_size"))
    runs = cut(sorted_, "exact")
    groups = runs.where("_rn = 1").groupBy("_sha", "_n").agg(
        best.alias("_keep"), F.sum("_size").alias("_total"),
        F.collect_set(F.struct("_salt", "_head")).alias("_in"))
    winner = groups.select(
        "_sha", "_n", "_keep", "_total", F.explode("_in").alias("_s"),
        F.array_min(F.transform(F.filter("_in", lambda s: s["_head"].eqNullSafe(F.col("_keep"))), lambda s: s["_salt"])).alias("_win"),
    ).select("_sha", "_n", "_keep", "_total", F.col("_s._salt").alias("_salt"), "_win")
    return runs.join(winner, ["_sha", "_n", "_salt"]).select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_total").cast("long").alias("group_size"),
        ((F.col("_rn") == 1) & (F.col("_salt") == F.col("_win"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
        F.col("_key").alias("row_key"))
