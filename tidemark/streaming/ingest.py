"""Incremental ingest and per-source health as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FAILURES = 3


def ingest(stream: DataFrame, target: str, checkpoint: str, keys: tuple[str, ...] = ("url", "content_hash")) -> StreamingQuery:
    """Appends versions not seen before: distinct within a batch, absent from the table. A replayed
    batch writes nothing twice."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates(list(keys))
        path = spark._jvm.org.apache.hadoop.fs.Path(target)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            new = new.join(spark.read.parquet(target).select(*keys), list(keys), "left_anti")
        new.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(target)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def health(stream: DataFrame, failures: int = FAILURES) -> DataFrame:
    """(source_id, attempts, streak, state) after each batch of attempts (source_id, at, success, found):
    failures in a row open the circuit, a success closes it; kept as state per source."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        attempts, streak, now = state.get if state.exists else (0, 0, "HEALTHY")
        rows = pd.concat(list(batches)).sort_values(["at"])
        for ok in rows.success:
            attempts, streak = attempts + 1, 0 if ok else streak + 1
            now = "HEALTHY" if ok else "OPEN" if streak >= failures else "DEGRADED"
        state.update((attempts, streak, now))
        yield pd.DataFrame({"source_id": [key[0]], "attempts": [attempts], "streak": [streak], "state": [now]})

    return stream.groupBy("source_id").applyInPandasWithState(
        step, "source_id string, attempts long, streak long, state string", "attempts long, streak long, state string", "update", GroupStateTimeout.NoTimeout)


def attempts_by_window(stream: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Attempts and failures of each source by tumbling window of event time; rows later than
    ``late`` are dropped by the watermark."""
    return stream.withWatermark("at", late).groupBy(F.window("at", width), "source_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(~F.col("success")).alias("failures"))


def follow(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).parquet(folder)
