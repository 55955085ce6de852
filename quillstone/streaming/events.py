"""Structured Streaming over append-only event logs: each event once, by type, in batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_events(spark: SparkSession, path: str, schema: str, fmt: str = "json", per_trigger: int = 100) -> DataFrame:
    """The files of a log as a stream; lines that do not parse are dropped."""
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", per_trigger).format(fmt).load(path)


def each_once(events: DataFrame, key: str = "event_id", time: str = "ts", types: tuple[str, ...] | None = None, type_col: str = "event_type", delay: str = "7 days") -> DataFrame:
    """Events of the given types without repeats of their id; ids are forgotten `delay` after their time, so state is bounded.

    Times without a zone are read as UTC instants, which watermarks need."""
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return e.where(F.col(type_col).isin(*types)) if types else e


def upsert_batches(events: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch of what is there now to `handle`, once per batch number across restarts."""
    return events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str = "ts", keys: tuple[str, ...] = ("event_type",), width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    e = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return e.groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def ready_batches(done: DataFrame, every: int) -> DataFrame:
    """cohort, n, complete: completed cases in order of completion (seq), cut into cohorts of `every`."""
    c = done.withColumn("cohort", F.floor((F.col("seq") - 1) / every).cast("long"))
    return c.groupBy("cohort").agg(F.count("*").alias("n")).withColumn("complete", F.col("n") == every)
