"""Incremental ingest with Structured Streaming: counts by event time, first sightings, and a batch step for the stored tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_counts(events: DataFrame, time: str, kind: str, late: str = "1 hour") -> DataFrame:
    """Rows by day and kind; rows later than ``late`` behind the newest are dropped from the state, not from the sink."""
    return events.withWatermark(time, late).groupBy(F.window(time, "1 day"), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), kind, "n")


def first_seen(items: DataFrame, key: str, time: str, within: str = "21 days") -> DataFrame:
    """The first row of each key; the state of a key is dropped after ``within``, the retention of the sink."""
    return items.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def run_batches(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Feed all that is available to ``step(batch, number)``, a batch at a time, remembered in ``checkpoint``.

    A batch may come again after a failure with the same number; ``step`` must
    write by that number (overwrite of its own folder), which makes the result
    exactly-once.
    """
    return stream.writeStream.outputMode(mode).foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_latest(spark, path: str, keys: list[str]) -> DataFrame:
    """Of the batches that :func:`upsert_step` wrote, the last row of each key. Numbers of batches grow."""
    rows = spark.read.option("basePath", path).parquet(path)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "batch")]), "batch").alias("_r")).select(*keys, "_r.*")


def upsert_step(path: str) -> Callable[[DataFrame, int], None]:
    """A step for :func:`run_batches` that stores each batch's changed rows under its number."""
    return lambda batch, number: batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


BUCKETS = 64


def ingest_step(stored: str, key: str, after: Callable[[DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A step for :func:`run_batches`: rows whose key no earlier batch stored, one of each key, as ``stored/batch=N/bucket=B``.

    Buckets are by key, and only those of the batch's keys are read of what is
    stored. ``after`` gets the stored rows of the batch, for example to cluster
    the last hours again.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates([key]).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")).cache()
        path = spark._jvm.org.apache.hadoop.fs.Path(stored)
        new = rows
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            wanted = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most BUCKETS numbers
            old = spark.read.option("basePath", stored).parquet(stored).where((F.col("batch") < number) & F.col("bucket").isin(wanted)).select(key)
            new = rows.join(old, key, "left_anti")
        new.write.mode("overwrite").partitionBy("bucket").parquet(f"{stored}/batch={number}")
        rows.unpersist()
        if after is not None:
            after(spark.read.schema(batch.schema).parquet(f"{stored}/batch={number}"))

    return step
