"""Readers of checkpoints, append-only event logs and run logs; bad lines and files are passed over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EVENT = "schema_version int, seq long, event_id string, timestamp string, type string"


def json_lines(spark: SparkSession, path: str, schema: str, key: str | None = None) -> DataFrame:
    """Rows of JSON lines that parse, torn ones left out. With a key the last line of each key stands, by file then line."""
    rows = spark.read.text(path).select("value", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_line"))
    rows = rows.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("r"), F.col("value").alias("raw"), "_file", "_line").where("r is not null")
    if key:
        w = Window.partitionBy(F.col(f"r.{key}")).orderBy(F.col("_file").desc(), F.col("_line").desc())
        rows = rows.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    return rows.select("r.*", "raw")


def checkpoints(spark: SparkSession, directory: str, schema: str, key: str, skip: str = "manifest") -> DataFrame:
    """One row a JSON file, manifests and corrupt files left out; of a key the last file by name counts."""
    raw = spark.read.option("wholetext", True).text(f"{directory}/*.json").select("value", F.input_file_name().alias("_file")).where(~F.lower("_file").contains(skip))
    rows = raw.where(F.try_parse_json("value").isNotNull()).select(F.from_json("value", schema).alias("r"), "_file")
    w = Window.partitionBy(F.col(f"r.{key}")).orderBy(F.col("_file").desc())
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("r.*")


def last_sequence(events: DataFrame) -> int:
    """The number of the last whole event of a log; 0 for an empty one."""
    return events.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("s")).first()["s"]


def timings(spark: SparkSession, path: str, pattern: str = r"(\w+) took ([0-9.]+)s") -> DataFrame:
    """stage, n, median, max, total of the durations that a log's lines name."""
    lines = spark.read.text(path).select(F.regexp_extract("value", pattern, 1).alias("stage"), F.regexp_extract("value", pattern, 2).try_cast("double").alias("s")).where("stage <> ''")
    return lines.groupBy("stage").agg(F.count("*").alias("n"), F.percentile("s", F.lit(0.5)).alias("median"), F.max("s").alias("max"), F.sum("s").alias("total"))


def override(tables: list[DataFrame], key: str) -> DataFrame:
    """Rows of several sources, where later ones replace earlier ones of the same key."""
    out = None
    for i, t in enumerate(tables):
        t = t.withColumn("_prio", F.lit(i))
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.col("_prio").desc())
    return out.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_prio")
