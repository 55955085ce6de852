"""Folders that driver and executors share, and small text files in them that appear whole or not at all."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where all of Spark is one process."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='quillstone-')}"
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """df, written as a table and read again, so that plans stay short and lost executors cost one step."""
    path = path or new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; none where there is no such folder."""
    p, fs = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def get_text(spark: SparkSession, path: str) -> str | None:
    p, fs = _at(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> bool:
    """Writes a file beside `path` and renames it, so that a reader sees all of it or nothing of it, and a writer that is
    killed leaves the old one. replace=False: False, and nothing changed, where the name is taken (by another writer)."""
    jvm = spark.sparkContext._jvm
    p, fs = _at(spark, path)
    fs.mkdirs(p.getParent())
    beside = jvm.org.apache.hadoop.fs.Path(f"{path.rsplit('/', 1)[0]}/.{path.rsplit('/', 1)[1]}.{uuid.uuid4().hex}")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.hsync()
    out.close()
    rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE if replace else rename.NONE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(beside), fs.makeQualified(p), how)
    except Exception as e:
        fs.delete(beside, False)
        if not replace and "FileAlreadyExists" in str(e):
            return False
        raise
    return True


class Manifest:
    """Which tables of a folder count: the newest of its numbered files. A number is taken once, so of two writers at once
    the later one gets an error and nothing that it wrote is read."""

    def __init__(self, spark: SparkSession, folder: str, empty: dict):
        self.spark, self.folder, self.state = spark, folder, {"number": 0} | empty
        self.refresh()

    def refresh(self) -> None:
        found = [n for n in names(self.spark, self.folder) if n.startswith("manifest-")]
        if found:
            self.state = json.loads(get_text(self.spark, f"{self.folder}/{found[-1]}"))

    def commit(self, **changes) -> None:
        new = self.state | changes | {"number": self.state["number"] + 1}
        if not put_text(self.spark, f"{self.folder}/manifest-{new['number']:08d}", json.dumps(new)):
            raise RuntimeError("another writer has changed this folder; refresh() and write again")
        self.state = new
