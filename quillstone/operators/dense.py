"""Dense retrieval: dot products of unit vectors, per space and over all, and the hashing encoder."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.text import tokenize
from . import products

DIM = 512


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def search(vectors: DataFrame, queries: DataFrame, *, id_col: str, vector_col: str, space_col: str | None = None, top_k: int = 10, per_space: int | None = None, block: int = 2048, least: float | None = 0.0, own: bool = True) -> DataFrame:
    """query_id, id, space, score, rank. Scores of `least` or less and vectors of another length are left out (own=False: and the row
    of the query's own id); ties go by id.

    queries: query_id, vector. They go to the vectors in blocks of at most `block`, so that no vector is shuffled; each
    block keeps its best hits only. Without spaces, products are made in NumPy (products.best), and vectors that hold null
    or non-finite components take no part."""
    if not space_col and not per_space:
        rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
        hits = products.best(rows, queries.select("query_id", "vector"), top_k=top_k, least=least, own=own, block=block)
        return hits.select("query_id", "id", F.lit("all").alias("space"), "score", "rank")
    v = vectors.select(F.col(id_col).alias("id"), (F.col(space_col).cast("string") if space_col else F.lit("all")).alias("space"), F.col(vector_col).cast("array<double>").alias("v"))
    q = queries.select("query_id", F.col("vector").cast("array<double>").alias("q"))
    n = q.count()
    order = [F.round("score", 9).desc(), F.col("id")]
    out = None
    for k in range(max(1, -(-n // block))):
        part = q if n <= block else q.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // block))) == k)
        hits = v.join(F.broadcast(part), F.size("v") == F.size("q")).select("query_id", "id", "space", dot(F.col("v"), F.col("q")).alias("score"))
        hits = hits if least is None else hits.where(F.col("score") > least)
        hits = hits if own else hits.where("id <> query_id")
        if per_space:
            hits = hits.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "space").orderBy(*order))).where(F.col("_r") <= per_space).drop("_r")
        hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= top_k)
        out = hits if out is None else out.unionAll(hits)
    return out


def _signed(docs: DataFrame, id_col: str, text: Column, dim: int) -> DataFrame:
    """id, bucket, w: signed counts of the tokens' md5 buckets, where they are not 0."""
    t = docs.select(F.col(id_col).alias("id"), F.explode(tokenize(text)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("c"))
    h = F.md5("term")
    sign = F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    t = t.select("id", (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim).cast("int").alias("bucket"), (sign * F.col("c")).alias("s"))
    return t.groupBy("id", "bucket").agg(F.sum("s").alias("w")).where("w <> 0")


def hash_buckets(docs: DataFrame, id_col: str, text: Column, dim: int = DIM) -> DataFrame:
    """id, bucket, weight: unit-length signed counts of the tokens' md5 buckets; sparse, so that no dense vector is built."""
    per = _signed(docs, id_col, text, dim).groupBy("id").agg(F.collect_list(F.struct("bucket", "w")).alias("b"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))  # at most dim buckets
    return per.select("id", "length", F.explode("b").alias("b")).select("id", "b.bucket", (F.col("b.w") / F.col("length")).alias("weight"))


def hash_vectors(docs: DataFrame, id_col: str, text: Column, dim: int = DIM) -> DataFrame:
    """id, keys, vals: hash_buckets as two arrays a document, counted where its text is read; documents without a bucket are left out.

    Where an id comes twice, its rows are one document, which a shuffle puts together."""
    if not products.one_row_each(docs.select(F.col(id_col).alias("id")), "id"):
        each = hash_buckets(docs, id_col, text, dim).groupBy("id").agg(F.collect_list(F.struct("bucket", "weight")).alias("e"))  # at most dim buckets
        return each.select("id", F.col("e.bucket").alias("keys"), F.col("e.weight").alias("vals"))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in tokens.pooled(batches):
            n, step = batch.num_rows, max(1, products.CELLS // dim)
            term, code, whose = tokens.coded(batch.column(1))
            raw, at = tokens.buffers(term)
            raw, at = raw.tobytes(), at.tolist()
            digest = np.frombuffer(b"".join([hashlib.md5(raw[i:j]).digest() for i, j in zip(at, at[1:], strict=False)]), np.uint8).reshape(-1, 16)
            bucket, sign = digest[:, :4].copy().view(">u4")[:, 0].astype(np.int64) % dim, np.where(digest[:, 4] % 2 == 0, 1.0, -1.0)
            for lo in range(0, n, step):
                hi = min(n, lo + step)
                c, r = (x[slice(*np.searchsorted(whose, (lo, hi)))] for x in (code, whose))
                w = np.bincount((r - lo) * dim + bucket[c], weights=sign[c], minlength=(hi - lo) * dim).reshape(hi - lo, dim)
                row, key = np.nonzero(w)
                val = w[row, key] / np.sqrt((w * w).sum(axis=1))[row]
                lists_at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=hi - lo))]).astype(np.int32))
                keys, vals = (pa.ListArray.from_arrays(lists_at, pa.array(x)) for x in (key.astype(np.int32), val))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), keys, vals], names=["id", "keys", "vals"])

    products.bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.lower(text).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, keys array<int>, vals array<double>").where(F.size("keys") > 0)


def vector_search(vectors: DataFrame, queries: DataFrame, *, top_k: int = 10) -> DataFrame:
    """query_id, id, score, rank: the best hash_vectors (id, keys, vals) for those of queries (whose id is the query's)."""
    return products.best(vectors, queries.withColumnRenamed("id", "query_id"), top_k=top_k, least=0.0).where(F.round("score", 9) > 0)


def hash_search(docs: DataFrame, queries: DataFrame, *, id_col: str, text: Column, query_id: str, query_text: Column, top_k: int = 10, dim: int = DIM) -> DataFrame:
    """query_id, id, score, rank. Documents become vectors where they are read and meet the queries there; only what may be
    among the best is shuffled."""
    return vector_search(hash_vectors(docs, id_col, text, dim), hash_vectors(queries, query_id, query_text, dim), top_k=top_k)
