"""WARC archives written from pages and read back by verified boundary chains.

Writing: equal payloads of at least `revisit_from` bytes are stored once, with the largest page id; the others become
revisit records that refer to it. Payload digests are computed by Spark before anything is written, and only pages
whose digest may be a repeated one are shuffled.

Reading: a file is read in blocks by independent tasks. Each task lists every offset in its block that looks like a
record (the version line after a blank line, and a header that parses), with the offset its length leads to. Within a
block these links are followed by pointer jumping over arrays; what leaves a block is (candidate, where its chain leaves
the block). Across the blocks of a file the same is done by doubling joins from the start of the file. Only what is
reachable from there is a record: version lines inside payloads, whatever header follows them, are not reached.

Rows: a null html is an empty payload; a null page id is written as an empty header and comes back null (never the one
referred to while another id is there); repeated rows are records of their own (the first of equal ids in no set order
is the response, so page ids should be unique); an empty table gives no file and no row; other columns are ignored.
A record longer than a block is read by the task in whose block it starts. Files of lost tasks are never listed.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BinaryFile, file_system, partitions_for, scratch, stored, text_batches

#: Fixed by the format (WARC 1.1, ISO 28500).
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

#: Read beyond a block's end for the header of its last record, and at a time where a header goes on after that.
HEADER_BYTES = 1 << 14
BLANK = b"\r\n\r\n"
MANIFEST = "file string, n_records long, n_bytes long"
#: Of the first writer: a row for each file, or a page that is handed on. Probes of the filter: 32-bit parts of a digest.
HANDED = pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("digest", pa.string()), ("n", pa.int64())])
PROBES = 3
FIELDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_CANDIDATE = re.compile(rb"WARC/1\.[01]\r\n")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def pack(page_id, url, payload: bytes | None, digest: str, refers_to, n: int | None = None) -> bytes:
    """One record with its closing blank lines. digest: lower-case hex SHA-1 of the payload, n: its bytes where it is not at hand."""
    block = HTTP if refers_to is not None else HTTP + payload
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 2024-01-01T00:00:00Z",
        f"WARC-Target-URI: {re.sub(r'\s', '%20', url or '')}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        f"X-Payload-Bytes: {len(payload) if n is None else n}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def header(data: bytes, at: int, read=None) -> bytes | None:
    """The header at `at` up to its blank line, however long; read(i, n) gives n bytes on from i where data ends too early."""
    if (end := data.find(BLANK, at)) >= 0:
        return data[at:end]
    head, line = bytearray(data[at:]), len(VERSION)
    while read:
        # Whole lines are fields; what has another line is no header, and is not read to the end of the file.
        if (last := head.rfind(b"\r\n")) > line:
            if any(b":" not in x for x in head[line:last].split(b"\r\n")):
                return None
            line = last + 2
        if not (more := read(at + len(head), HEADER_BYTES)):
            return None
        since = len(head) - 3
        head += more
        if (end := head.find(BLANK, since)) >= 0:
            return bytes(head[:end])
    return None


def parse(data: bytes, at: int, read=None) -> tuple[dict[str, str], int, int] | None:
    """(header fields in lower case, start of the block, its length), or None where no header parses."""
    if (head := header(data, at, read)) is None:
        return None
    try:
        fields = dict((k.strip().lower(), v.strip()) for k, v in (x.split(":", 1) for x in head[len(VERSION) :].decode().split("\r\n")))
        return fields, at + len(head) + 4, int(fields["content-length"])
    except (ValueError, KeyError, UnicodeDecodeError):
        return None


def sieve(digests: DataFrame, most_bits: int = 1 << 26) -> np.ndarray:
    """Bits of a Bloom filter of hex digests, at most `most_bits` of them (8 MB): what it does not hold is not among them."""
    bits = min(most_bits, max(1 << 10, 1 << (16 * digests.count()).bit_length()))
    place = F.explode(F.array(*(F.conv(F.substring("digest", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(PROBES))))
    words = digests.select(place.alias("at")).select((F.col("at") % bits).alias("at")).select(F.shiftright("at", 5).alias("word"), F.expr("shiftleft(1L, cast(at % 32 as int))").alias("bit"))
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()  # a row for each of at most most_bits / 32 words
    out = np.zeros(bits // 32, dtype=np.uint32)
    out[found["word"].to_numpy()] = found["bit"].to_numpy().astype(np.uint32)
    return out


def in_sieve(bits: np.ndarray, digest: str) -> bool:
    places = (int(digest[8 * i : 8 * i + 8], 16) % (32 * len(bits)) for i in range(PROBES))
    return all(bits[p >> 5] >> np.uint32(p & 31) & np.uint32(1) for p in places)


class Archives:
    """The archives of one task, each closed at `file_bytes`; `done` has a row of the manifest for each."""

    def __init__(self, directory: str, file_bytes: int):
        self.directory, self.most, self.out, self.n, self.done = directory, file_bytes, None, 0, []

    def add(self, record: bytes) -> None:
        self.out, self.n = self.out or BinaryFile(self.directory, ".warc"), self.n + 1
        self.out.write(record)
        if self.out.at >= self.most:
            self.close()

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.done.append((self.out.name, self.n, self.out.at))
            self.out, self.n = None, 0


def write_archives(pages: DataFrame, directory: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = 1000, file_bytes: int = 32 << 20) -> DataFrame:
    """Writes the archives; returns the stored manifest, a row for each file.

    Digests of equal payloads meet in one aggregate of (digest, largest id), which is combined before its shuffle. Those
    that occur more than once go to all tasks as a Bloom filter of bounded size. A page whose digest it does not hold is
    written where it is read; the others are handed on and joined with their digest's largest id. Of equal payloads in a
    batch only that of the largest id is handed on with its bytes, as the others can only be revisits.
    """
    rows = text_batches(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("n", F.length("payload").cast("long"))
    many = rows.where(F.col("n") >= revisit_from).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("c")).where("c > 1").select("digest", "first")
    many = stored(many, "warc-repeated")
    bits = many.sparkSession.sparkContext.broadcast(sieve(many))
    names = [f.name for f in HANDED]

    def alone(batches):
        held, files = bits.value, Archives(directory, file_bytes)
        for batch in batches:
            on = []
            for page_id, url, payload, digest, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n >= revisit_from and in_sieve(held, digest):
                    on.append([None, None, None, page_id, url, payload, digest, n])
                else:
                    files.add(pack(page_id, url, payload, digest, None))
            top: dict = {}
            for row in on:
                if row[3] is not None:
                    top[row[6]] = max(row[3], top.get(row[6], row[3]))
            for row in on:
                if row[6] in top and row[3] != top[row[6]]:
                    row[5] = None
            if on:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*on, strict=True), HANDED, strict=True)], names=names)
        files.close()
        if files.done:
            yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=False)) for d in files.done], schema=HANDED)

    def repeated(batches):
        files = Archives(directory, file_bytes)
        for batch in batches:
            for page_id, url, payload, digest, n, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files.add(pack(page_id, url, payload, digest, refers_to, n))
        files.close()
        if files.done:
            yield pa.RecordBatch.from_pylist([dict(zip(names[:3], d, strict=True)) for d in files.done], schema=pa.schema(list(HANDED)[:3]))

    first = stored(rows.mapInArrow(alone, MANIFEST + ", page_id long, url string, payload binary, digest string, n long"), "warc-first")
    on = first.where("file is null").select("page_id", "url", "payload", "digest", "n").join(many.withColumnRenamed("digest", "digest_of"), F.col("digest") == F.col("digest_of"), "left")
    on = on.select("page_id", "url", "payload", "digest", "n", F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))
    return first.where("file is not null").select("file", "n_records", "n_bytes").unionAll(stored(on.mapInArrow(repeated, MANIFEST), "warc-manifest"))


def jump(nexts: np.ndarray) -> np.ndarray:
    """For each node the last one on its chain, by pointer jumping; nexts[i] > i, or i itself at an end."""
    while not np.array_equal(after := nexts[nexts], nexts):
        nexts = after
    return nexts


def candidates(files: DataFrame, directory: str, block_bytes: int = 4 << 20) -> DataFrame:
    """A row for each block of each file, with arrays of its candidates: offset, where its record ends, where its chain
    leaves the block, how many records it has until there, where its block starts, and the record's fields. Only headers are
    read; what a payload says of itself waits until its record is reached. files: file, n_bytes."""
    blocks = files.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n_bytes") - 1, F.lit(block_bytes))))
    item = pa.struct([("offset", pa.int64()), ("next", pa.int64()), ("exit", pa.int64()), ("hops", pa.int64()), ("body", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    schema = pa.schema([("file", pa.string()), ("start", pa.int64()), ("found", pa.list_(item))])

    def scan(batches):
        for batch in batches:
            for file, size, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                fs, base = file_system(directory)
                found = []
                with fs.open_input_file(f"{base}/{file}") as f:
                    lead = min(len(BLANK), start)  # what a version line comes after
                    zero = start - lead
                    read = lambda i, n: f.read_at(min(n, size - zero - i), zero + i)
                    data = read(0, lead + block_bytes + HEADER_BYTES)
                    for m in _CANDIDATE.finditer(data, lead):
                        at = m.start()
                        if at >= lead + block_bytes:
                            break
                        # Headers of candidates end at the next blank line, so none is read for two of them.
                        if zero + at and data[max(0, at - len(BLANK)) : at] != BLANK:
                            continue
                        parsed = parse(data, at, read)
                        if parsed is None or parsed[2] < 0 or zero + parsed[1] + parsed[2] + 4 > size:
                            continue
                        fields, body, length = parsed
                        found.append(describe(zero + at, zero + body, zero + body + length + 4, fields))
                offsets = np.array([x["offset"] for x in found], dtype=np.int64)
                ends = np.array([x["next"] for x in found], dtype=np.int64)
                if len(found):
                    to = np.searchsorted(offsets, ends)
                    inside = (to < len(offsets)) & (offsets[np.minimum(to, len(offsets) - 1)] == ends)
                    nexts = np.where(inside, to, np.arange(len(offsets)))
                    last, hops = jump(nexts), [1] * len(found)
                    for i in range(len(found) - 1, -1, -1):
                        if inside[i]:
                            hops[i] += hops[nexts[i]]
                    for x, e, h in zip(found, ends[last].tolist(), hops, strict=True):
                        x["exit"], x["hops"] = e, h
                yield pa.RecordBatch.from_pylist([{"file": file, "start": start, "found": found}], schema=schema)

    n = partitions_for(files)
    return blocks.select("file", "n_bytes", "start").repartition(n, "file", "start").mapInArrow(scan, f"file string, start long, found array<struct<offset:bigint,next:bigint,exit:bigint,hops:bigint,body:bigint,{','.join(':'.join(x.split()) for x in FIELDS.split(', '))}>>")


def describe(offset: int, body: int, end: int, fields: dict[str, str]) -> dict:
    """What a record's header says; the digest and size of a payload that it holds itself are left open."""
    kind, digest, n = fields.get("warc-type", ""), None, None
    # Any integer that a long holds; leading zeros do not count.
    number = lambda k: n if re.fullmatch(r"-?0*\d{1,19}", x := fields.get(k, "")) and -(1 << 63) <= (n := int(x)) < 1 << 63 else None
    if kind == "revisit":
        try:
            digest = base64.b32decode(fields.get("warc-payload-digest", "").removeprefix("sha1:")).hex()
        except ValueError:
            digest = None
        n = number("x-payload-bytes")
    return {"offset": offset, "next": end, "body": body, "page_id": number("x-page-id"), "payload_bytes": n, "payload_digest": digest, "record_type": kind, "refers_to": number("x-refers-to-page")}


def payload_of(block: bytes) -> tuple[str, int]:
    """(hex SHA-1, size) of the payload in a record's block."""
    payload = block[at + 4 :] if (at := block.find(b"\r\n\r\n")) >= 0 else block
    return hashlib.sha1(payload).hexdigest(), len(payload)


def read_archives(manifest: DataFrame, directory: str, block_bytes: int = 4 << 20) -> DataFrame:
    """A row for each record reached from the start of its file: FIELDS, file and offset.

    Fails where a file's records are not as many as its manifest says."""
    files = manifest.select("file", "n_bytes")
    found = stored(candidates(files, directory, block_bytes), "warc-candidates")
    # Where a block's chain leads: an edge from each candidate that a chain can enter a block by to its exit.
    edges = found.select("file", F.explode("found").alias("c")).select("file", F.col("c.offset").alias("at"), F.col("c.exit").alias("to"))
    most = files.agg(F.max("n_bytes")).first()[0] or 0
    # `to` is an entry of a later block or the end of the file; doubling: after k rounds, entries within 2^k blocks are known.
    entries = files.select("file", F.lit(0).cast("long").alias("at"))
    steps = max(0, -(-most // block_bytes) - 1).bit_length()
    if steps:
        entered = edges.select("file", F.col("to").alias("at")).distinct()
        links = stored(edges.join(entered.unionAll(entries).distinct(), ["file", "at"]), "warc-links")
        entries = stored(entries, "warc-entries")
        for _ in range(steps):
            more = entries.join(links, ["file", "at"]).select("file", F.col("to").alias("at"))
            entries = stored(entries.unionAll(more).distinct(), "warc-entries")
            twice = links.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
            links = stored(links.join(twice, ["file", "to"], "left").select("file", "at", F.coalesce("then", "to").alias("to")), "warc-links")
    starts = entries.withColumn("start", F.floor(F.col("at") / F.lit(block_bytes)) * F.lit(block_bytes)).groupBy("file", "start").agg(F.min("at").alias("entry"))
    # A chain enters a block once; what it reaches there was counted from that entry.
    hops = F.aggregate(F.filter("found", lambda c: c["offset"] == F.col("entry")), F.lit(0).cast("long"), lambda n, c: n + c["hops"])
    reached = found.join(starts, ["file", "start"]).select("file", hops.alias("hops")).groupBy("file").agg(F.sum("hops").alias("reached"))
    lost = manifest.join(reached, "file", "left").withColumn("reached", F.coalesce("reached", F.lit(0))).where("reached <> n_records").select("file", "reached", "n_records").first()
    if lost:
        raise ValueError(f"{lost['file']}: {lost['reached']} of {lost['n_records']} records reached")

    out = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64())])

    def follow(batches):
        for batch in batches:
            for file, entry, items in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                by = {x["offset"]: x for x in items}
                rows, at = [], entry
                fs, base = file_system(directory)
                with fs.open_input_file(f"{base}/{file}") as f:
                    while at in by:
                        row = by[at] | {"file": file}
                        if row["record_type"] != "revisit":
                            row["payload_digest"], row["payload_bytes"] = payload_of(f.read_at(row["next"] - 4 - row["body"], row["body"]))
                        rows.append(row)
                        at = row["next"]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=out)

    return found.join(starts, ["file", "start"]).select("file", "entry", "found").mapInArrow(follow, FIELDS + ", file string, offset long")


def round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    directory = scratch(spark, "warc")
    return read_archives(write_archives(pages, directory, **options), directory)
