"""An ordered, append-only log written by streams: every event once, numbered without gaps.

    data/attempt=..    rows of one batch, with their task (part) and place in it (within)
    manifest-..        how many numbers are given, the last batch of each source, and the attempts that count

A batch is sorted by range over all tasks; its numbers are what the manifest had, what the tasks before had, and the place
within the task, so that no task numbers a whole batch. Rows are written first and the manifest is put in place afterwards,
whole or not at all: a run killed in between leaves rows that are never read, and its batch comes again under the same
batch number; a run killed behind it finds its batch number taken and writes nothing. Logs in JSON lines that other programs
wrote are taken over with the numbers they have; a torn last line does not parse and is passed over.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.folders import Manifest, new_folder
from ..sources.logs import json_lines

_WITHIN = (1 << 33) - 1


class EventLog:
    """The log in `folder`. order: columns by which the events of one batch are numbered; they should tell events apart."""

    def __init__(self, spark: SparkSession, folder: str | None = None, *, order: tuple[str, ...] = ("ts", "event_id")):
        self.spark, self.folder, self.order = spark, folder or new_folder(spark, "log"), order
        self.manifest = Manifest(spark, self.folder, {"last": 0, "sources": {}, "attempts": []})

    @property
    def last(self) -> int:
        """The number of the last event."""
        return self.manifest.state["last"]

    def _data(self, attempt: str) -> str:
        return f"{self.folder}/data/attempt={attempt}"

    def _take(self, attempt: str, source: str | None, batch: int) -> None:
        """Makes the rows of an attempt count: starts tells where the numbers of each task begin."""
        rows = self.spark.read.parquet(self._data(attempt))
        counts = rows.groupBy("part").agg(F.max("within").alias("n")).orderBy("part").collect()  # a row for each task
        starts, at = [], 0
        for r in counts:
            starts += [at] * (r["part"] + 1 - len(starts))
            at += r["n"] + 1
        state = self.manifest.state
        sources = state["sources"] | ({source: batch} if source is not None else {})
        self.manifest.commit(last=state["last"] + at, sources=sources, attempts=[*state["attempts"], {"attempt": attempt, "first": state["last"], "n": at, "starts": starts}])

    def append(self, events: DataFrame, batch: int, source: str = "stream") -> bool:
        """Appends a batch of a source, whose batch numbers grow; False, and nothing written, if it is there already."""
        self.manifest.refresh()
        if batch <= self.manifest.state["sources"].get(source, -1):
            return False
        attempt = uuid.uuid4().hex
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = events.repartitionByRange(n, *self.order).sortWithinPartitions(*self.order).select("*", F.monotonically_increasing_id().alias("_id"))
        rows.select(*events.columns, F.shiftright("_id", 33).cast("int").alias("part"), F.col("_id").bitwiseAND(_WITHIN).alias("within")).write.parquet(self._data(attempt))
        self._take(attempt, source, batch)
        return True

    def adopt(self, path: str, schema: str) -> int:
        """Takes over the events of JSON lines (schema with `seq`) into an empty log; lines that do not parse are not events.
        Numbering goes on behind the largest number found, which is returned."""
        if self.last:
            raise ValueError("only an empty log can take over another one")
        rows = json_lines(self.spark, path, schema, key="seq").drop("raw").where("seq > 0")
        attempt = uuid.uuid4().hex
        rows.select(*(c for c in rows.columns if c != "seq"), F.lit(0).alias("part"), (F.col("seq") - 1).alias("within")).write.parquet(self._data(attempt))
        self._take(attempt, None, 0)
        return self.last

    def sink(self, stream: DataFrame, checkpoint: str, source: str = "stream") -> StreamingQuery:
        """Appends what there is of a stream, batch by batch."""
        return stream.writeStream.foreachBatch(lambda rows, batch: self.append(rows, batch, source) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def read(self, after: int = 0, columns: str | None = None) -> DataFrame:
        """seq and the events behind number `after`. columns: the schema of events, where not taken from the files."""
        wanted = [a for a in self.manifest.state["attempts"] if a["first"] + a["n"] > after]
        if not wanted:
            return self.spark.createDataFrame([], f"seq long{', ' + columns if columns else ''}")
        reader = self.spark.read.option("basePath", f"{self.folder}/data")
        rows = (reader.schema(f"{columns}, part int, within long") if columns else reader.option("mergeSchema", True)).parquet(*(self._data(a["attempt"]) for a in wanted))
        # a row for each batch
        places = self.spark.createDataFrame([(a["attempt"], a["first"], a["starts"]) for a in wanted], "attempt string, first long, starts array<long>")
        seq = F.col("first") + F.get("starts", F.col("part")) + F.col("within") + 1
        return rows.join(F.broadcast(places), "attempt").select(seq.alias("seq"), *(c for c in rows.columns if c not in ("attempt", "part", "within"))).where(F.col("seq") > after)
