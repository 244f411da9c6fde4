"""Append-only storage with latest-by-key views, and backups with a manifest."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tables of a full backup, parents before children; users' decisions included.
TABLES = ("sources", "source_health", "monitor_runs", "source_runs", "documents", "document_versions", "raw_snapshots", "opportunities",
          "positions", "opportunity_versions", "deadlines", "notifications", "classification_history", "extraction_results", "errors",
          "system_events", "tracking")


def shared(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a session of one machine that names none gets a
    temporary one, a cluster without it is refused."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if (spark.sparkContext.master or "").partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def place(spark: SparkSession, what: str) -> str:
    """A new name in the shared folder."""
    return f"{shared(spark)}/tidemark/{what}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """A table that several branches of one plan read, written once to the shared folder: lineage ends there."""
    path = place(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key of an append-only log."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order])
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def append_new(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored yet, one of each."""
    return new.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti")


def upsert(log: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return latest(log.unionByName(new, allowMissingColumns=True), keys, order)


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Children without their parent: the referential check that Spark has not."""
    return child.join(parent.select(key), key, "left_anti")


def dump(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Compressed JSON of every table, and a manifest of (table, rows, digest), written and returned."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        df.write.mode("errorifexists").json(f"{folder}/{name}", compression="gzip")
        rows.append((name, *_sum(df)))
    manifest = spark.createDataFrame(rows, "name string, row_count long, digest long")
    manifest.coalesce(1).write.json(f"{folder}/manifest")
    return manifest


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, row_count) of every table, as one plan."""
    each = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("name"), "row_count") for name, df in tables.items()]
    return reduce(DataFrame.union, each)


def _sum(df: DataFrame) -> tuple[int, int]:
    """Rows, and an order-free digest of their JSON (absent and null fields alike)."""
    columns = sorted(df.columns)
    r = df.select(F.to_json(F.struct(*columns)).alias("j")).agg(F.count(F.lit(1)), F.sum(F.crc32(F.col("j").cast("binary")))).first()
    return r[0], r[1] or 0


def restore(spark: SparkSession, folder: str, schemas: dict[str, str], existing: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables of a backup; refused while any target table has rows."""
    full = [n for n, df in existing.items() if df.limit(1).count()]
    if full:
        raise ValueError(f"tables are not empty: {', '.join(full)}")
    return {n: spark.read.schema(s).json(f"{folder}/{n}") for n, s in schemas.items()}


def verify(spark: SparkSession, folder: str, schemas: dict[str, str]) -> DataFrame:
    """(name, row_count, found, ok) of every table in the manifest."""
    manifest = spark.read.schema("name string, row_count long, digest long").json(f"{folder}/manifest")
    found = spark.createDataFrame([(n, *_sum(spark.read.schema(s).json(f"{folder}/{n}"))) for n, s in schemas.items()], "name string, found long, found_digest long")
    return manifest.join(found, "name", "left").select(
        "name", "row_count", "found", F.coalesce((F.col("row_count") == F.col("found")) & (F.col("digest") == F.col("found_digest")), F.lit(False)).alias("ok"))


def expired(backups: DataFrame, now, days: int = 30) -> DataFrame:
    """Backups (path, modified) older than ``days``."""
    return backups.where(F.col("modified") < F.lit(now) - F.expr(f"interval {days} days"))


