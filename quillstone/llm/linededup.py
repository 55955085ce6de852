"""Incremental line dedup that can be undone: sharded cuckoo filters backed by exact reference counts.

A line's key is the line without blanks at both ends and with A-Z lowered; keys of at least `least` code points count. An
index keeps, in a folder that all machines share:

    postings    doc_id, key of each document, as inserted; deleted documents have a tombstone
    refs        key, n_docs, owner: how many documents hold a key and which of them is the smallest; newest version counts
    filters     one cuckoo filter a shard of keys, with as many copies of a key's fingerprint as documents hold it, two at most

insert() counts a batch's keys, and the filters tell which of them the index may hold already: only these are looked up in
refs. delete() takes a document's references back; a key that loses its smallest document gets the next one from the
postings, and fingerprints that no document stands for any more leave the filters. dedupe() asks the filters first:
only lines that have two copies there meet the exact counts. A filter never misses a key that was inserted, and whatever it
claims is checked against refs, so results are exact up to collisions of 128-bit hashes.

Each change is one new version; its files count once the version's manifest is written, so lost executors and broken
runs leave nothing that is read. A filter that gets too full is built again, larger, from refs.

Edge cases: a null or empty text is one empty line, whose key is too short to count; a null doc_id is an id of its own,
behind all others; rows with the same id are one document, and each of them loses the lines that this document loses; an id that is in the
index already can only be inserted after delete(); empty tables change nothing; only doc_id and text are read, so other
columns cannot clash. A key held by very many documents is counted before it is shuffled, and dealt out by document when
filters are asked.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BinaryFile, by_text, file_system, only, partitions_for, read_range, scratch

BLANKS, LEAST = "\x20\x09\x0a\x0b\x0c\x0d", 10
_LOW = {c: c + 32 for c in range(65, 91)}
#: Slots of a bucket; keys that a shard is planned for; share of slots filled before a filter grows; parts a shard's lookups are dealt to.
SLOTS, SHARD_KEYS, FULL, DEAL = 4, 1 << 19, 0.85, 16


def key_of(line: str, least: int = LEAST) -> bytes | None:
    """128 bits of the key of a line; None where the key is too short."""
    line = line.strip(BLANKS)
    if len(line) < least:
        return None
    return hashlib.md5((line.lower() if line.isascii() else line.translate(_LOW)).encode("utf-8", "surrogatepass")).digest()


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four; a key may be held more than once, and any held copy may be removed."""

    def __init__(self, table: np.ndarray):
        self.table = table

    @classmethod
    def sized(cls, copies: int) -> CuckooFilter:
        """An empty filter that `copies` fingerprints leave half empty, so that it can grow."""
        return cls(np.zeros((1 << max(4, int(np.ceil(np.log2(max(1, copies) * 2 / SLOTS)))), SLOTS), dtype=np.uint16))

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        return cls(np.frombuffer(data, dtype="<u2").reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.astype("<u2").tobytes()

    @property
    def held(self) -> int:
        return int(np.count_nonzero(self.table))

    def _other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The second bucket of a fingerprint; the other of that is the first one again."""
        return at ^ ((mark.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, smaller bucket, larger bucket) of keys, given as 64-bit hashes."""
        mark = (keys & np.uint64(0xFFFF)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (keys >> np.uint64(24)).astype(np.int64) & (len(self.table) - 1)
        two = self._other(one, mark)
        return mark, np.minimum(one, two), np.maximum(one, two)

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Copies of each key, never fewer than were added."""
        mark, lo, hi = self._places(keys)
        first, second = ((self.table[at] == mark[:, None]).sum(axis=1) for at in (lo, hi))
        return first + np.where(lo == hi, 0, second)

    def add(self, keys: np.ndarray, seed: int = 0) -> bool:
        """Adds a copy of each key given; False if they do not fit, and the filter is spoilt then."""
        rng = np.random.default_rng(seed)
        mark, at, _ = self._places(keys)
        for turn in range(500):
            if not len(mark):
                return True
            order = np.argsort(at, kind="stable")
            mark, at = mark[order], at[order]
            head = np.searchsorted(at, at)
            nth = np.arange(len(at)) - head
            slots = np.argsort(self.table[at] != 0, axis=1, kind="stable")  # free ones first
            fits = nth < (self.table[at] == 0).sum(axis=1)
            self.table[at[fits], slots[np.flatnonzero(fits), nth[fits]]] = mark[fits]
            mark, at = mark[~fits], at[~fits]
            if turn and len(mark):  # one of each full bucket's newcomers takes the place of a fingerprint that moves on
                one = np.unique(at, return_index=True)[1]
                slot = rng.integers(0, SLOTS, len(one))
                moved = self.table[at[one], slot].copy()
                self.table[at[one], slot] = mark[one]
                mark[one] = moved
            at = self._other(at, mark)
        return not len(mark)

    def remove(self, keys: np.ndarray) -> None:
        """Takes a copy of each key given away; all of them must have been added."""
        mark, lo, hi = self._places(keys)
        order = np.lexsort((mark, lo))
        mark, lo, hi = mark[order], lo[order], hi[order]
        group = lo * (1 << 16) + mark
        nth = np.arange(len(group)) - np.searchsorted(group, group)
        here = np.concatenate([self.table[lo] == mark[:, None], (self.table[hi] == mark[:, None]) & (lo != hi)[:, None]], axis=1)
        pick = np.argmax(here & (np.cumsum(here, axis=1) == nth[:, None] + 1), axis=1)
        if not here[np.arange(len(pick)), pick].all() or (here.sum(axis=1) <= nth).any():
            raise ValueError("a key to remove is not in the filter")
        self.table[np.where(pick < SLOTS, lo, hi), pick % SLOTS] = 0


def _hashes(keys: pa.Array) -> np.ndarray:
    """64 bits of each 16-byte key, others than those that choose the shard."""
    return np.frombuffer(b"".join(keys.to_pylist()), dtype="<u8").reshape(-1, 2)[:, 1]


@dataclass(frozen=True)
class _Version:
    number: int = 0
    shards: int = 0
    postings: list[list] = field(default_factory=list)  # [version, path]
    tombstones: list[list] = field(default_factory=list)
    refs: list[str] = field(default_factory=list)
    filters: str = ""


class LineIndex:
    """The index in `folder`; a new folder is an empty index. shards: chosen from the first batch where not given."""

    def __init__(self, spark: SparkSession, folder: str | None = None, *, least: int = LEAST, shards: int = 0):
        self.spark, self.folder, self.least = spark, folder or scratch(spark, "lines"), least
        fs, path = file_system(self.folder)
        from pyarrow import fs as pafs

        found = [f.base_name for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.base_name.startswith("version-")]
        if found:
            self.now = _Version(**json.loads(read_range(self.folder, max(found))))
        else:
            self.now = _Version(shards=shards)

    # ---- tables

    def _write(self, df: DataFrame, what: str) -> str:
        path = f"{self.folder}/{what}-{self.now.number + 1:08d}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        return path

    def _commit(self, **changes) -> None:
        new = replace(self.now, number=self.now.number + 1, **changes)
        f = BinaryFile(self.folder, "", f"version-{new.number:08d}")
        f.write(json.dumps(asdict(new)).encode())
        f.close()
        self.now = new

    def _lines(self, docs: DataFrame) -> DataFrame:
        """doc_id, key: the distinct keys of each row."""
        least = self.least

        def work():
            def call(texts):
                rows, keys = [], []
                for i, text in enumerate(texts):
                    for k in {key_of(line, least) for line in (text or "").split("\n")} - {None}:
                        rows.append(i)
                        keys.append(k)
                yield rows, keys

            return call

        kind = only(docs, "doc_id").schema[0].dataType.simpleString()
        return by_text(only(docs, "doc_id", "text"), work, f"doc_id {kind}, key binary")

    def postings(self) -> DataFrame | None:
        """doc_id, key of all documents in the index."""
        if not self.now.postings:
            return None
        rows = reduce(DataFrame.unionByName, (self.spark.read.parquet(p).withColumn("at", F.lit(v)) for v, p in self.now.postings))
        if self.now.tombstones:
            gone = reduce(DataFrame.unionByName, (self.spark.read.parquet(p).select(F.col("doc_id").alias("gone"), F.lit(v).alias("until")) for v, p in self.now.tombstones))
            gone = gone.groupBy("gone").agg(F.max("until").alias("until"))
            rows = rows.join(gone, rows["doc_id"].eqNullSafe(gone["gone"]) & (F.col("at") < F.col("until")), "left_anti")
        return rows.select("doc_id", "key")

    def refs(self) -> DataFrame | None:
        """key, n_docs, owner of the keys that some document holds."""
        if not self.now.refs:
            return None
        if len(self.now.refs) == 1:
            return self.spark.read.parquet(self.now.refs[0]).where("n_docs > 0").select("key", "n_docs", "owner")
        newest = self.spark.read.parquet(*self.now.refs).groupBy("key").agg(F.max_by(F.struct("n_docs", "owner"), "version").alias("r"))
        return newest.select("key", "r.*").where("n_docs > 0")

    def _shard(self, key: str = "key") -> Column:
        return F.pmod(F.conv(F.hex(F.substring(key, 1, 4)), 16, 10).cast("long"), F.lit(self.now.shards)).cast("int")

    def _named(self, rows: DataFrame) -> DataFrame:
        """rows, which have a shard, with the file of that shard's filter (null where it has none yet)."""
        if not self.now.filters:
            return rows.withColumn("filter", F.lit(None).cast("string"))
        return rows.join(self.spark.read.parquet(self.now.filters).select("shard", "filter"), "shard", "left")

    def _counted(self, rows: DataFrame) -> DataFrame:
        """rows with copies: how many copies of its key the filters hold. rows: key first, binary. A shard's rows are dealt
        to DEAL tasks at most, so that a key of very many rows is not one task's."""
        rows = self._named(rows.withColumn("shard", self._shard()).withColumn("deal", F.pmod(F.xxhash64(*rows.columns), F.lit(DEAL)).cast("int")))
        rows = rows.repartition(partitions_for(rows, 24), "shard", "deal").sortWithinPartitions("shard")
        folder, columns = self.folder, [c for c in rows.columns if c not in ("shard", "deal")]

        def run(batches):
            name, held = None, None
            for batch in batches:
                files, counts = batch.column("filter").to_pylist(), np.zeros(batch.num_rows, dtype=np.int64)
                keys = _hashes(batch.column("key")) if batch.num_rows else np.empty(0, np.uint64)
                ends = [i for i in range(1, len(files)) if files[i] != files[i - 1]]
                for lo, hi in zip([0, *ends], [*ends, len(files)], strict=True):
                    if lo < hi and files[lo] is not None:
                        if files[lo] != name:
                            name, held = files[lo], CuckooFilter.load(read_range(folder, files[lo]))
                        counts[lo:hi] = held.count(keys[lo:hi])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(counts)], [*columns, "copies"])

        rows = rows.select(*columns)
        return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", copies long").drop("filter")

    def _filters(self, changes: DataFrame, refs: list[str]) -> str:
        """The manifest shard, filter, size after `changes` (key, add: copies more or fewer). Shards without changes keep their file."""
        new, folder = replace(self.now, refs=refs), self.folder
        by_shard = changes.withColumn("shard", self._shard()).groupBy("shard").agg(F.sum("add").alias("more"))
        old = self.spark.read.parquet(self.now.filters) if self.now.filters else self.spark.createDataFrame([], "shard int, filter string, slots long, held long")
        # a row for each shard; shards are planned for SHARD_KEYS keys
        plan = by_shard.join(old, "shard", "left").select("shard", "filter", ((F.coalesce("held", F.lit(0)) + F.col("more")) > F.coalesce("slots", F.lit(0)) * FULL).alias("rebuild"))
        plan_path = self._write(plan, "plan")
        plan = self.spark.read.parquet(plan_path)
        whole = self._view(new).select("key", F.least(F.col("n_docs"), F.lit(2)).cast("long").alias("add")).withColumn("shard", self._shard()).join(plan.where("rebuild").select("shard"), "shard", "left_semi")
        part = changes.withColumn("shard", self._shard()).join(plan.where("NOT rebuild").select("shard"), "shard", "left_semi").select("key", "add", "shard")
        rows = whole.withColumn("old", F.lit(None).cast("string")).unionByName(part.join(plan.select("shard", F.col("filter").alias("old")), "shard")).select("shard", "old", "key", "add")
        rows = rows.repartition(partitions_for(rows, 24), "shard").sortWithinPartitions("shard")
        schema = pa.schema([("shard", pa.int32()), ("filter", pa.string()), ("slots", pa.int64()), ("held", pa.int64())])

        def build(shard: int, old: str | None, keys: np.ndarray, add: np.ndarray) -> pa.RecordBatch:
            more = np.repeat(keys, np.maximum(add, 0))
            f = CuckooFilter.load(read_range(folder, old)) if old else CuckooFilter.sized(len(more))
            less = np.repeat(keys, np.maximum(-add, 0))
            if len(less):
                f.remove(less)
            if not f.add(more):
                # a filter at most FULL full refuses once in a very long while; twice the buckets need all keys, and only a new filter has them here
                if old:
                    raise RuntimeError(f"the filter of shard {shard} is spoilt; insert in smaller batches or with more shards")
                for times in (2, 4, 8, 16):
                    f = CuckooFilter.sized(times * len(more))
                    if f.add(more, seed=times):
                        break
                else:
                    raise RuntimeError(f"no filter takes the keys of shard {shard}")
            out = BinaryFile(folder, ".cuckoo")
            out.write(f.dump())
            out.close()
            return pa.RecordBatch.from_pydict({"shard": [shard], "filter": [out.name], "slots": [f.table.size], "held": [f.held]}, schema=schema)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, old, keys, add = None, None, [], []
            for batch in batches:
                shards, names, hashes, adds = np.asarray(batch.column("shard")), batch.column("old"), _hashes(batch.column("key")), np.asarray(batch.column("add"))
                ends = np.flatnonzero(np.diff(shards)) + 1
                for lo, hi in zip([0, *ends], [*ends, len(shards)], strict=True):
                    if lo < hi and shards[lo] != at:
                        if keys:
                            yield build(at, old, np.concatenate(keys), np.concatenate(add))
                        at, old, keys, add = int(shards[lo]), names[int(lo)].as_py(), [], []
                    keys.append(hashes[lo:hi])
                    add.append(adds[lo:hi])
            if keys:
                yield build(at, old, np.concatenate(keys), np.concatenate(add))

        built = rows.mapInArrow(run, "shard int, filter string, slots long, held long")
        path = self._write(built, "built")
        built = self.spark.read.parquet(path)
        kept = old.join(built.select("shard"), "shard", "left_anti").select(*built.columns)
        return self._write(built.unionByName(kept), "filters")

    def _view(self, at: _Version) -> DataFrame:
        now, self.now = self.now, at
        try:
            return self.refs()
        finally:
            self.now = now

    # ---- changes

    def insert(self, docs: DataFrame) -> None:
        """Adds the lines of documents (doc_id, text) whose ids are not in the index."""
        posted = self._write(self._lines(docs), "postings")
        rows = self.spark.read.parquet(posted)
        held = self.postings()
        if held is not None:
            again = rows.select("doc_id").distinct()
            if not again.join(held, again["doc_id"].eqNullSafe(held["doc_id"]), "left_semi").isEmpty():
                raise ValueError("some of these documents are in the index already")
        # rows of one id are one document; counts are combined before they are shuffled
        fresh = rows.groupBy("key", "doc_id").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"))
        fresh = self.spark.read.parquet(self._write(fresh, "batch"))
        if not self.now.shards:
            self.now = replace(self.now, shards=max(8, -(-fresh.count() // SHARD_KEYS)))
        if held is None:
            merged = fresh.select("key", F.lit(0).cast("long").alias("had"), F.col("n").alias("n_docs"), F.col("low").alias("owner"))
        else:
            asked = self.spark.read.parquet(self._write(self._counted(fresh), "asked"))
            # what no filter knows is new and is not looked up
            known = asked.where("copies > 0").join(self.refs().select("key", F.col("n_docs").alias("had"), F.col("owner").alias("old")), "key", "left")
            known = known.select("key", F.coalesce("had", F.lit(0)).cast("long").alias("had"), (F.coalesce("had", F.lit(0)) + F.col("n")).alias("n_docs"), F.least("low", "old").alias("owner"))
            merged = known.unionByName(asked.where("copies = 0").select("key", F.lit(0).cast("long").alias("had"), F.col("n").alias("n_docs"), F.col("low").alias("owner")))
        self._change(merged, postings=[*self.now.postings, [self.now.number + 1, posted]])

    def delete(self, ids: DataFrame) -> None:
        """Takes documents (doc_id) out; ids that the index does not hold are passed over."""
        held = self.postings()
        if held is None:
            return
        marked = self._write(ids.select("doc_id").distinct(), "tombstones")
        ids = self.spark.read.parquet(marked)
        gone = held.join(ids.select(F.col("doc_id").alias("gone")), F.col("doc_id").eqNullSafe(F.col("gone")), "left_semi").distinct()
        gone = gone.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"))
        gone = self.spark.read.parquet(self._write(gone, "batch"))
        marks = [*self.now.tombstones, [self.now.number + 1, marked]]
        left = gone.join(self.refs(), "key").select("key", F.col("n_docs").alias("had"), (F.col("n_docs") - F.col("n")).alias("n_docs"), "owner", "low")
        left = self.spark.read.parquet(self._write(left, "left"))
        lost = left.where((F.col("n_docs") > 0) & F.col("low").eqNullSafe(F.col("owner"))).select("key")
        now, self.now = self.now, replace(self.now, number=self.now.number + 1, tombstones=marks)
        heirs = self.postings().join(lost, "key", "left_semi").groupBy("key").agg(F.min("doc_id").alias("heir"), F.lit(True).alias("new"))
        self.now = now
        merged = left.join(heirs, "key", "left").select("key", "had", "n_docs", F.when(F.col("new"), F.col("heir")).otherwise(F.col("owner")).alias("owner"))
        self._change(merged, tombstones=marks)

    def _change(self, merged: DataFrame, **changes) -> None:
        """Writes key, had, n_docs, owner as the next version of these keys."""
        path = self._write(merged.withColumn("version", F.lit(self.now.number + 1)), "refs")
        refs = [*self.now.refs, path]
        rows = self.spark.read.parquet(path)
        add = (F.least(F.col("n_docs"), F.lit(2)) - F.least(F.col("had"), F.lit(2))).cast("long")
        filters = self._filters(rows.select("key", add.alias("add")).where("add <> 0"), refs)
        self._commit(refs=refs, filters=filters, **changes)

    # ---- use

    def repeated(self, docs: DataFrame | None = None) -> DataFrame:
        """doc_id, keys: what each document of docs loses, as a list of keys. docs need not be in the index; without docs,
        the documents of the index."""
        want = self.postings() if docs is None else self._lines(docs)
        if want is None:
            raise ValueError("the index holds no documents yet")
        want = want.select("key", "doc_id")
        if not self.now.filters:
            return want.groupBy("doc_id").agg(F.collect_set("key").alias("keys")).limit(0)
        many = self.refs().where("n_docs > 1").select("key", "owner")
        maybe = self._counted(want).where("copies > 1").select("key", "doc_id")
        lost = maybe.join(many, "key").where(~F.col("doc_id").eqNullSafe(F.col("owner")))
        return lost.groupBy("doc_id").agg(F.collect_set("key").alias("keys"))

    def dedupe(self, docs: DataFrame, indexed: bool = False) -> DataFrame:
        """doc_id, n_lines, n_dropped, kept: each row of docs without the lines that it loses to a smaller document.

        indexed: all of docs are in the index, with these texts; the keys of their lines are read there."""
        rows, lost, least = only(docs, "doc_id", "text"), self.repeated(None if indexed else docs), self.least
        rows = rows.join(lost.withColumnRenamed("doc_id", "loser"), F.col("doc_id").eqNullSafe(F.col("loser")), "left").select("doc_id", "keys", "text")
        kind = rows.schema[0].dataType.simpleString()
        schema = pa.schema([("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept", pa.string())])

        def run(batches):
            for batch in batches:
                out: list[list] = [[], [], []]
                for keys, text in zip(batch.column("keys").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    lines, keys = (text or "").split("\n"), set(keys or ())
                    kept = [x for x in lines if key_of(x, least) not in keys] if keys else lines
                    for values, v in zip(out, (len(lines), len(lines) - len(kept), "\n".join(kept)), strict=True):
                        values.append(v)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, f.type) for v, f in zip(out, schema, strict=True))], ["doc_id", *schema.names])

        return rows.mapInArrow(run, f"doc_id {kind}, n_lines long, n_dropped long, kept string")
