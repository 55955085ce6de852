"""Queues and batches: round robin over groups, one row a group, fixed-size parts, resumable work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_group(rows: DataFrame, group: str, order: list[Column | str], n: int = 1) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= n)


def round_robin(rows: DataFrame, group: str, order: list[Column | str]) -> DataFrame:
    """Adds `nth`, the row's place in its group: ordered by (nth, group) the groups take turns."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(group).orderBy(*order)))


def batch_ids(rows: DataFrame, order: list[Column | str], size: int, groups: int = 64) -> DataFrame:
    """Adds `position` (from 0, over all rows in order) and `batch`. Positions come from counts of ranges and a rank in each
    range, so no task ranks the whole table."""
    ranged = rows.repartitionByRange(groups, *order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id())
    from pyspark import StorageLevel

    ranged = ranged.persist(StorageLevel.MEMORY_AND_DISK)
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each range
    placed = ranged.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1).join(F.broadcast(before.select("_p", "_before")), "_p")
    placed = placed.withColumn("position", (F.col("_before") + F.col("_k")).cast("long"))
    return placed.withColumn("batch", F.floor(F.col("position") / size).cast("long")).drop("_p", "_k", "_before")


def best_by_status(rows: DataFrame, key: str, status: Column, ranks: dict[str, int], then: list[Column]) -> DataFrame:
    """Per key the row whose status ranks best."""
    rank = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in ranks.items() for x in kv)), status), F.lit(len(ranks) + 1))
    return first_per_group(rows.withColumn("status_rank", rank), key, ["status_rank", *then]).drop("nth")


def not_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key a checkpoint table does not have."""
    return rows.join(done.select(key).distinct(), key, "left_anti")
