"""The corpus pipeline: stages over ``documents``, each written as Parquet and reread.

All stages: a null text is empty, other nulls are kept as they are (a null source is a source of its own),
rows that repeat an identifier with another text are documents of their own, an empty table gives an
empty one, and columns beside those of ``documents`` pass through all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact_dedup, minhash, mixing, packing, quality
from tidemark.llm.common import cut, keep_rows


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, unchanged; empty texts by the score of an empty text.
    Without any training label all are kept."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest identifier (null is the least); of rows that repeat
    it, one."""
    kept = exact_dedup.exact_dedup(docs, keep="largest").where("kept").select("row_key")
    return keep_rows(docs, cut(kept, "kept"), "doc_id", "text")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates (five words, 0.8), the document with the smallest identifier.
    Texts without words and rows without an identifier are in no group and stay."""
    kept = minhash.near_dedup(docs).where("kept").select("row_key")
    return keep_rows(docs, cut(kept, "kept"), "doc_id", "text")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents and stretches of documents, repeats included. Texts without words
    are never taken."""
    return mixing.mixed_texts(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token sequences with their places."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: A fitted model, MinHash and pseudorandom permutations have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
