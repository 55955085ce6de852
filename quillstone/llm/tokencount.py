"""Token counts of the documents in flat token files that have no index.

A flat file is nothing but ids of a fixed width; each document ends with the end-of-document id. Blocks of a file are
scanned by themselves: one vectorised comparison finds all separators of a block, and what leaves the task is the
block's count of ids, the places of its separators and the lengths between them. A prefix scan over the blocks then carries
the ids since the last separator into the next block, across as many blocks as a document spans, first within a file,
then over the files of a stream. No task sees more than one block, or the summaries of one file or stream.

Rows: no ids after the last separator of a stream are a document of their own if there are any (`closed` is then
false); two separators in a row are an empty document; an empty file has no document; a file whose size is no multiple
of the id width is an error. A separator within a text (its special string) ends a document there as in any flat
file. For count_documents: such parts are added up, so a document's count is that of its whole text; null or empty texts give documents of their end id only, repeated rows and null ids give one
each, an empty table gives no file and no row, and other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BinaryFile, only, partitions_for, read_range, scratch, stored, text_batches
from .wordcode import shared_encoder, tokenizer_path

FILES = "stream int, seq int, file string, n_bytes long, ids array<long>"
#: What write_flat knows besides: of each document in `ids`, the ordinal of its first separator in the stream and how many it wrote.
WRITTEN = FILES + ", firsts array<long>, seps array<long>"
BLOCK = "stream int, seq int, block int, n long, places array<long>, gaps array<long>"


def write_flat(docs: DataFrame, directory: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 49407, width: int = 2, file_bytes: int = 16 << 20) -> DataFrame:
    """Each task writes one stream: the documents of its partition as they come, cut into files of file_bytes wherever that falls.

    Nothing is shuffled. Returns the stored list of files; documents may span files, none spans streams. `ids` are the
    ids of the documents that end in a file, for those who want to name the counts; the files themselves hold none.
    `firsts` and `seps` say which separators of the stream each of them wrote: its own end and those within its text."""
    path, dtype = tokenizer or tokenizer_path(), f"<u{width}"
    tail = np.asarray([end_id], dtype=dtype).tobytes()

    def write(batches):
        encoder, stream, done, held, ends = shared_encoder(path, dtype), TaskContext.get().partitionId(), [], b"", []
        ordinal = 0

        def put(n: int) -> None:
            nonlocal held, ends
            out = BinaryFile(directory, ".tok")
            out.write(held[:n])
            out.close()
            done.append((stream, len(done), out.name, out.at, *([x[c] for x in ends if x[0] <= n] for c in (1, 2, 3))))
            held, ends = held[n:], [(e - n, *x) for e, *x in ends if e > n]

        for batch in batches:
            parts, at = [held], len(held)
            for doc_id, codes in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                parts += [codes, tail]
                at += len(codes) + width
                seps = 1 + int(np.count_nonzero(np.frombuffer(codes, dtype) == end_id))
                ends.append((at, doc_id, ordinal, seps))
                ordinal += seps
            held = b"".join(parts)
            while len(held) >= file_bytes:
                put(file_bytes)
        if held:
            put(len(held))
        if done:
            types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), *[pa.list_(pa.int64())] * 3)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=["stream", "seq", "file", "n_bytes", "ids", "firsts", "seps"])

    rows = only(text_batches(docs), id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return stored(rows.mapInArrow(write, WRITTEN), "flat-files")


def scan_block(ids: np.ndarray, end_id: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(ids in the block, places of its separators, ids from each separator's predecessor in the block up to it; 0 for the first)."""
    at = np.flatnonzero(ids == end_id)
    return len(ids), at, np.diff(at, prepend=at[:1])


def scan(files: DataFrame, directory: str, *, end_id: int = 49407, width: int = 2, block_bytes: int = 1 << 20) -> DataFrame:
    """A row for each document: stream, ordinal (from 0, in its stream), start (ids before it in its stream), n_tokens with the separator, closed."""
    if block_bytes % width:
        raise ValueError("blocks must hold whole ids")
    blocks = files.where("n_bytes > 0").withColumn("block", F.explode(F.sequence(F.lit(0), (F.floor((F.col("n_bytes") - 1) / block_bytes)).cast("int"))))

    def read(batches):
        for batch in batches:
            out = []
            for stream, seq, file, size, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size % width:
                    raise ValueError(f"{file}: {size} bytes are no whole number of ids")
                n, places, gaps = scan_block(np.frombuffer(read_range(directory, file, block * block_bytes, block_bytes), f"<u{width}"), end_id)
                out.append((stream, seq, block, n, places, gaps))
                if len(out) >= 16:
                    yield _blocks(out)
                    out = []
            if out:
                yield _blocks(out)

    found = stored(blocks.select("stream", "seq", "file", "n_bytes", "block").repartition(partitions_for(files), "file", "block").mapInArrow(read, BLOCK), "flat-blocks")
    # Within a file: ids before the block, the last separator before it, and separators before it.
    file = Window.partitionBy("stream", "seq").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("long")
    b = found.withColumn("ends", F.size("places")).withColumn("before", F.coalesce(F.sum("n").over(file), none)).withColumn("ends_before", F.coalesce(F.sum("ends").over(file), none))
    last = F.when(F.col("ends") > 0, F.col("before") + F.element_at("places", -1))
    b = b.withColumn("last", last).withColumn("seen", F.max("last").over(file))
    # The same over the files of a stream.
    per = b.groupBy("stream", "seq").agg(F.sum("n").alias("file_n"), F.sum("ends").alias("file_ends"), F.max("last").alias("file_last"))
    stream = Window.partitionBy("stream").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("base", F.coalesce(F.sum("file_n").over(stream), none)).withColumn("base_ends", F.coalesce(F.sum("file_ends").over(stream), none))
    per = per.withColumn("base_last", F.col("base") + F.col("file_last")).withColumn("base_seen", F.max("base_last").over(stream))
    b = b.join(per.select("stream", "seq", "base", "base_ends", "base_seen"), ["stream", "seq"])
    # A block's first separator ends the document that began after the last separator before the block.
    prior = F.coalesce(F.col("base") + F.col("seen"), F.col("base_seen"), F.lit(-1))
    docs = b.select("stream", (F.col("base_ends") + F.col("ends_before")).alias("first"), (F.col("base") + F.col("before")).alias("at"), prior.alias("prior"), F.posexplode(F.arrays_zip("places", "gaps")).alias("k", "d"))
    n = F.when(F.col("k") == 0, F.col("at") + F.col("d.places") - F.col("prior")).otherwise(F.col("d.gaps"))
    docs = docs.select("stream", (F.col("first") + F.col("k")).alias("ordinal"), (F.col("at") + F.col("d.places") - n + 1).alias("start"), n.alias("n_tokens"), F.lit(True).alias("closed"))
    rest = per.groupBy("stream").agg(F.sum("file_n").alias("n"), F.sum("file_ends").alias("ordinal"), F.coalesce(F.max("base_last"), F.lit(-1)).alias("seen"))
    return docs.unionAll(rest.select("stream", "ordinal", F.col("seen") + 1, F.col("n") - F.col("seen") - 1, F.lit(False)).where(F.col("n") - F.col("seen") > 1))


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["stream", "seq", "block", "n", "places", "gaps"])


def count_documents(spark: SparkSession, docs: DataFrame, *, end_id: int = 49407, **options) -> DataFrame:
    """doc_id, n_tokens (with the separator): the counts of the flat files, with the ids of the documents in the order written."""
    directory = scratch(spark, "flat")
    files = write_flat(docs, directory, end_id=end_id, **options)
    counts = scan(files, directory, end_id=end_id)
    written = files.select("stream", F.explode(F.arrays_zip("ids", "firsts", "seps")).alias("d")).select("stream", F.col("d.ids").alias("doc_id"), F.col("d.firsts").alias("first"), F.col("d.seps").alias("seps"))
    named = written.select("stream", "doc_id", "first", F.explode(F.sequence("first", F.col("first") + F.col("seps") - 1)).alias("ordinal"))
    # A document is (stream, first): ids may be null or repeated.
    return counts.join(named, ["stream", "ordinal"]).groupBy("stream", "first", "doc_id").agg(F.sum("n_tokens").alias("n_tokens")).select("doc_id", "n_tokens")
