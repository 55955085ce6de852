"""Shared plumbing of the training-data operators: the shared folder, binary files in it, and reusable plans.

Executors may be lost at any time, so every file an executor writes gets a name of its own attempt and counts only
once the task that wrote it has returned that name; leftovers of failed attempts are never read.
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Words as several contracts define them: runs of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made only where the session names none and all of it runs in one process (tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='quillstone-')}"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, free: bool = False, drop: list[DataFrame] | None = None) -> DataFrame:
    """The rows written as a table in the shared folder and read again: cuts lineage and survives lost executors.

    free: shuffle files that nothing needs any more are removed now instead of at the next garbage collection.
    drop: stored tables that only led to this one; their files go."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = path
    for old in drop or []:
        _delete(spark, _PATHS.pop(id(old)))
    if free:
        release(spark)
    return out


def release(spark: SparkSession) -> None:
    """Gives back what the driver no longer needs: Python's memory, the JVM's, and with that the shuffle files of dead plans."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


#: Where stored() has put what it returned, for `drop`.
_PATHS: dict[int, str] = {}


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def file_system(uri: str):
    """(pyarrow file system, path) of a URI or plain path, on whichever machine calls this."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


class BinaryFile:
    """A binary file below `directory`, created under a name no other attempt has; `name` is to be returned by the task."""

    def __init__(self, directory: str, suffix: str, stem: str | None = None):
        self.fs, path = file_system(directory)
        self.fs.create_dir(path, recursive=True)
        self.name = f"{stem or f'part-{uuid.uuid4().hex}'}{suffix}"
        self.out = self.fs.open_output_stream(f"{path}/{self.name}")
        self.at = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.out.close()


def read_range(directory: str, name: str, start: int = 0, length: int | None = None) -> bytes:
    fs, path = file_system(directory)
    with fs.open_input_file(f"{path}/{name}") as f:
        size = f.size()
        length = size - start if length is None else min(length, size - start)
        return f.read_at(length, start)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(df: DataFrame) -> DataFrame:
    """df, once the session hands Python workers batches of a few MB: long texts then need little memory at once."""
    conf = df.sparkSession.conf
    for key, most in (("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20), ("spark.sql.execution.arrow.maxRecordsPerBatch", 4000)):
        if int(conf.get(key).rstrip("b")) > most:
            conf.set(key, str(most))
    return df


def by_text(df: DataFrame, work: Callable[[], Callable[[list[str | None]], Iterable[tuple]]], schema: str) -> DataFrame:
    """The texts of df (its last column) through work, in batches; the other columns are carried along as they are.

    work() is called once a task and returns what takes the texts of a batch and yields (places, *columns): for each row
    made, the place of its text in the batch and its values. Carried columns never pass through pandas, where a null
    turns longs into doubles. schema: of the result, carried columns first."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        call = work()
        for batch in batches:
            for places, *columns in call(batch.column(batch.num_columns - 1).to_pylist()):
                at = pa.array(places, pa.int64())
                carried = [batch.column(i).take(at) for i in range(batch.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([c if c.type == f.type else c.cast(f.type) for c, f in zip([*carried, *(pa.array(c, f.type) for c, f in zip(columns, list(arrow)[len(carried) :], strict=True))], arrow, strict=True)], schema=arrow)

    return text_batches(df).mapInArrow(run, schema)


def only(df: DataFrame, *columns: str) -> DataFrame:
    """Just these columns: columns of the caller with clashing names never meet an operator's own."""
    return df.select(*(F.col(f"`{c}`") for c in columns))


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on the key and the seed only; any SQL engine with md5 gives the same."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))), 1, 12), 16, 10)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def both(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def batches(iterator, columns: int = 0):
    """Arrow batches without the empty ones."""
    return (b for b in iterator if b.num_rows)


def partitions_for(df: DataFrame, least: int = 12) -> int:
    """Shuffle partitions that the session is set to, at least `least`."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def set_threads() -> None:
    """Rust tokenizers otherwise start a thread for each core of the machine in each worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node -> smallest node of its component, by alternating large-star and small-star steps.

    edges: columns a, b of longs; loops and repeats are harmless. Each round is written to the shared folder, so the
    plan stays short and a lost executor repeats one round at most; so are the smallest neighbours, which makes both sides
    of their joins plain shuffles that Spark can split where a node has very many neighbours. Nodes without an edge do
    not appear. Edges that still change after `rounds` rounds are an error.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = stored(e, "components"), None
    for _ in range(rounds):
        # large star: each node's larger neighbours go to the smallest of its neighbourhood
        sym = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(sym.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "components-low")
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = stored(large.distinct(), "components")
        # small star: a node and its smaller neighbours go to the smallest of them
        low = stored(large.groupBy("u").agg(F.min("v").alias("m")), "components-low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        e = stored(small, "components")
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.unionAll(e.select(F.col("v").alias("u"), "v")).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        before = now
    raise RuntimeError(f"components of the graph are not final after {rounds} rounds")
