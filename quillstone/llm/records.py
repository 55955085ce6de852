"""Token ids as length-delimited binary records, with an index of offsets beside each file for shuffled reads.

File: 8-byte magic, uint16 id width in bytes, 6 zero bytes, then records one after the other, each
    uint64 payload length | masked crc32 of those 8 bytes | payload | masked crc32 of the payload
with payload = uint8 null flag, int64 document id, ids. Everything is little-endian; a masked checksum is the crc32
rotated right by 15 bits plus a constant, so that checksums stored within checked data do not match themselves.
Index (`.idx`): 8-byte magic, then a uint64 offset for each record and one for the end of the file.

Rows: a null text is an empty document (its end id only); a null document id sorts first and comes back null; repeated
rows give a record each, equal ids in order of their texts; an empty table gives no file and no row; columns other than
the two named are ignored, whatever their names. Long texts are one record each. Writing is safe against lost tasks:
a file counts only if the task that wrote it returned its name to the manifest, which is stored before anyone reads.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BinaryFile, only, partitions_for, read_range, scratch, stored, text_batches
from .wordcode import shared_encoder, tokenizer_path

MAGIC, INDEX_MAGIC = b"QSTREC1\0", b"QSTIDX1\0"
MASK = 0xA282EAD8
MANIFEST = "pid int, seq int, file string, n_records long, n_ids long, n_bytes long"
RECORD = "doc_id long, file string, offset long, start long, n_tokens long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """(payload, offset of the next record); raises ValueError where a checksum fails."""
    head = data[at : at + 8]
    if len(head) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked(head):
        raise ValueError(f"bad length checksum at {at}")
    n = struct.unpack("<Q", head)[0]
    payload = data[at + 12 : at + 12 + n]
    if len(payload) < n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
        raise ValueError(f"bad payload checksum at {at}")
    return payload, at + 16 + n


def write_records(docs: DataFrame, directory: str, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 2, width: int = 2, file_bytes: int = 64 << 20, partitions: int | None = None) -> DataFrame:
    """Writes the files in ascending order of ids; returns the stored manifest: one row a file, in the order of pid and seq.

    One shuffle deals the texts out by ranges of ids; a task holds one batch of texts and one record at a time.
    """
    path, dtype = tokenizer or tokenizer_path(), f"<u{width}"
    tail = np.asarray([end_id], dtype=dtype).tobytes()

    def write(batches):
        encoder, pid, seq, data, offsets, n_ids, done = shared_encoder(path, dtype), TaskContext.get().partitionId(), 0, None, [], 0, []
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                if data is None:
                    data, offsets, n_ids = BinaryFile(directory, ".rec"), [], 0
                    data.write(MAGIC + struct.pack("<H6x", width))
                offsets.append(data.at)
                data.write(frame(struct.pack("<Bq", doc_id is None, doc_id or 0) + ids + tail))
                n_ids += len(ids) // width + 1
                if data.at >= file_bytes:
                    done.append(finish(directory, data, offsets, pid, seq, n_ids))
                    data, seq = None, seq + 1
        if data is not None:
            done.append(finish(directory, data, offsets, pid, seq, n_ids))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["pid", "seq", "file", "n_records", "n_ids", "n_bytes"])

    n = partitions or partitions_for(docs)
    rows = only(text_batches(docs), id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return stored(rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, MANIFEST), "records-manifest")


def finish(directory: str, data: BinaryFile, offsets: list[int], pid: int, seq: int, n_ids: int) -> tuple:
    data.close()
    index = BinaryFile(directory, ".idx", data.name)
    index.write(INDEX_MAGIC + np.asarray([*offsets, data.at], dtype="<u8").tobytes())
    index.close()
    return pid, seq, data.name, len(offsets), n_ids, data.at


def read_records(manifest: DataFrame, directory: str, *, chunk_bytes: int = 8 << 20, with_ids: bool = False) -> DataFrame:
    """A row for each record, from the files: where it lies, the ids before it, its ids' count and crc32 (of uint32 ids).

    Files are read by their index in chunks of whole records. with_ids adds the ids as binary.
    """
    total = Window.orderBy("pid", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file of 64 MB
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(total), F.lit(0)).cast("long").alias("base"))
    schema = RECORD + (", ids binary" if with_ids else "")

    def read(batches):
        for batch in batches:
            for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = read_range(directory, file + ".idx")
                if raw[:8] != INDEX_MAGIC:
                    raise ValueError(f"{file}: not an index")
                offsets = np.frombuffer(raw, "<u8", offset=8).astype(np.int64)
                head = read_range(directory, file, 0, 16)
                if head[:8] != MAGIC:
                    raise ValueError(f"{file}: not a record file")
                width, at = struct.unpack_from("<H", head, 8)[0], 0
                while at < len(offsets) - 1:
                    to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + chunk_bytes, "right")) - 1)
                    data = read_range(directory, file, int(offsets[at]), int(offsets[to] - offsets[at]))
                    rows = []
                    for o in offsets[at:to].tolist():
                        payload, _ = unframe(data, o - int(offsets[at]))
                        null, doc_id = struct.unpack_from("<Bq", payload)
                        ids = payload[9:]
                        n = len(ids) // width
                        rows.append((None if null else doc_id, file, o, base, n, zlib.crc32(np.frombuffer(ids, f"<u{width}").astype("<u4").tobytes()), *([ids] if with_ids else [])))
                        base += n
                    at = to
                    types = [pa.int64(), pa.string(), *[pa.int64()] * 4, *([pa.binary()] if with_ids else [])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return files.repartition(partitions_for(manifest), "file").mapInArrow(read, schema)


def round_trip(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    directory = scratch(spark, "records")
    return read_records(write_records(docs, directory, **options), directory)
