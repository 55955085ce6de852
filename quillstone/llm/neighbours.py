"""Nearest neighbours by a block matrix join over int8 tiles.

Each vector x is held as int8 codes c and a scale s, with the exact length e of what the codes miss: x = s c + r,
|r| = e. A tile is a block of queries against a block of candidates: one product of code matrices (exact in float32 or
float64) gives the distance of the coded vectors, and the true distance differs from it by at most the two e. A
candidate survives its tile if its least possible distance is within the query's bound, the k-th smallest of greatest
possible distances. Every query gets a bound from one block of candidates before the others are looked at; the smallest
bound over all tiles then cuts once more. Surviving pairs are recomputed from the
original vectors in double precision and merged by heaps: first those of each task, then those of each query.
So the result is that of brute force; the codes only save work.

Equal vectors are one candidate that stands for its smallest ids, as many as can matter: a third of all rows may hold
one vector. Queries with equal vectors are one query. Tiles are dealt out by (query block, candidate block), and both
sides of a tile are of bounded size; no pair outside a tile's survivors is ever a row.

Rows: vectors that are null, empty, all zero or hold a null, NaN or infinity take no part, as query or as candidate;
vectors of different lengths are never compared; a null id is ignored; repeated ids are candidates of their own, but
none with the query's own id is its neighbour; a repeated query row is one query (the SQL lists its neighbours once for
each repeat within the same k ranks); different vectors under one id are not told apart; fewer than k candidates give fewer rows; ties go to the smaller id;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CODED = "rep long, dim int, code binary, scale double, miss double"
PAIR = "query long, rep long, low double, bound double"
#: Added to bounds in units of the largest component: far below what prunes, far above what squares lose when they vanish.
TINY = 1e-140


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(fine, F.lit(False)) & F.exists(v, lambda x: x != 0)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance in double precision; where squares overflow or vanish, of the differences in units of the largest."""
    gaps = F.zip_with(a, b, lambda x, y: x - y)
    length = lambda d: F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    plain, most = length(gaps), F.aggregate(gaps, F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x)))
    scaled = F.when((most == 0) | (most == float("inf")), most).otherwise(most * length(F.transform(gaps, lambda x: x / most)))
    return F.when((plain > 1e-140) & (plain < 1e150), plain).otherwise(scaled)


def coded(vectors: DataFrame, exponent: int = 0) -> DataFrame:
    """rep, vector -> its codes, scale and what they miss, all in units of 2^exponent.

    With the exponent of the largest component of all, squares neither overflow nor, where it matters, vanish."""

    def code(batches):
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["vector"].map(len)):
                x = np.ldexp(np.stack(part["vector"].to_numpy()).astype(np.float64), -exponent)
                top = np.abs(x).max(axis=1, keepdims=True)
                c = np.rint(x / np.where(top > 0, top, 1) * 127)
                miss = np.sqrt(((x - c * (top / 127)) ** 2).sum(axis=1))
                yield pd.DataFrame({"rep": part["rep"], "dim": dim, "code": [r.tobytes() for r in c.astype(np.int8)], "scale": top[:, 0] / 127, "miss": miss * (1 + 1e-12) + TINY})

    return vectors.select("rep", "vector").mapInPandas(code, CODED)


def product_tile(queries: pd.DataFrame, cands: pd.DataFrame, k: int) -> pd.DataFrame:
    """Survivors of one tile: for each query the candidates that may be among its k nearest. A query's own `bound`, if it has
    one, is a distance that k candidates are known to be within."""
    dim = int(queries["dim"].iloc[0])
    kind = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # sums of products are then exact
    a, b = (np.frombuffer(b"".join(p["code"]), dtype=np.int8).reshape(len(p), dim) for p in (queries, cands))
    sa, sb = queries["scale"].to_numpy(), cands["scale"].to_numpy()
    na, nb = ((x.astype(np.float64) ** 2).sum(axis=1) for x in (a, b))
    bt, rep = b.astype(kind).T, cands["rep"].to_numpy()
    given = queries["bound"].to_numpy() if "bound" in queries else np.full(len(a), np.inf)
    out = []
    for i in range(0, len(a), 256):
        s = slice(i, i + 256)
        dots = (a[s].astype(kind) @ bt).astype(np.float64)
        scale = (sa[s] ** 2 * na[s])[:, None] + (sb**2 * nb)[None]
        sq = scale - 2 * (sa[s, None] * sb[None]) * dots
        slack = 1e-12 * scale + TINY**2  # of float64 sums, and of what vanishes in them
        gap = queries["miss"].to_numpy()[s, None] + cands["miss"].to_numpy()[None]
        low = np.maximum(np.sqrt(np.maximum(sq - slack, 0)) - gap, 0)
        high = np.sqrt(np.maximum(sq + slack, 0)) + gap
        bound = np.partition(high, k - 1, axis=1)[:, k - 1] * (1 + 1e-9) if high.shape[1] >= k else np.full(len(high), np.inf)
        bound = np.fmin(bound, given[s])
        q, c = np.nonzero(~(low > bound[:, None]))
        out.append(pd.DataFrame({"query": queries["rep"].to_numpy()[s][q], "rep": rep[c], "low": low[q, c], "bound": bound[q]}))
    return pd.concat(out)


def heaps(rows, k: int):
    """(query, distance, rep) triples -> the k smallest of each query, by a heap for each."""
    best: dict[int, list] = {}
    for q, d, r in rows:
        heap = best.setdefault(q, [])
        if len(heap) < k:
            heapq.heappush(heap, (-d, -r))
        elif (-d, -r) > heap[0]:
            heapq.heapreplace(heap, (-d, -r))
    return [(q, -d, -r) for q, heap in best.items() for d, r in heap]


def nearest(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, every: int = 100, candidate_block: int = 8192, query_block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows, by Euclidean distance, of the rows whose id is a multiple of `every`."""
    v = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(F.col("id").isNotNull()).where(usable(F.col("vector")))
    # Equal vectors: the k + 1 smallest distinct ids stand for all of them (one may be the query's own), each with its number of
    # rows, up to k. Repeated rows are combined before the shuffle, and Spark keeps the limit before it too.
    same = Window.partitionBy("vector").orderBy("id")
    members = v.groupBy("vector", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times")).withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1)
    distinct = stored(members.groupBy("vector").agg(F.sort_array(F.collect_list(F.struct("id", "times"))).alias("ids")).select(F.col("ids")[0]["id"].alias("rep"), "vector", "ids"), "nn-vectors")
    asked = v.where(F.col("id") % every == 0).distinct().join(distinct.select("vector", "rep"), "vector")
    asked = stored(asked.select(F.col("id").alias("query_id"), F.col("rep").alias("query")), "nn-queries")
    queries = asked.select(F.col("query").alias("rep")).distinct()

    largest = distinct.agg(F.max(F.aggregate("vector", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x))))).first()[0]
    codes = stored(coded(distinct, math.frexp(largest or 1.0)[1]), "nn-codes")
    again = codes.sparkSession.createDataFrame([], codes.schema).unionByName(codes)  # a plan of its own for the other side
    n, nq = codes.count(), queries.count()
    cb, qb = max(1, -(-n // candidate_block)), max(1, -(-nq // query_block))
    block = lambda count: F.pmod(F.xxhash64("rep"), F.lit(count)).cast("int")
    key, fields = ["c", "q", "dim"], ["rep", "code", "scale", "miss"]
    asks = codes.join(queries, "rep").withColumn("q", block(qb))
    cands = again.withColumn("c", block(cb))

    def tiles(asks: DataFrame, cands: DataFrame, most: bool) -> DataFrame:
        """Pairs that survive their tile; most: only a row for each query, of its bound."""
        extra = ["bound"] if "bound" in asks.columns else []

        def tile(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(c):
                return pd.DataFrame({"query": [], "rep": [], "low": [], "bound": []})
            found = product_tile(q, c, k + 1)
            return found.drop_duplicates("query") if most else found

        return asks.select(*key, *fields, *extra).groupBy(*key).cogroup(cands.select(*key, *fields).groupBy(*key)).applyInPandas(tile, PAIR)

    # Each query's bound from one block of candidates, all of them in turn: with it the other tiles give few pairs.
    turn = F.pmod(F.col("q"), F.lit(cb)).cast("int")
    first = cands.withColumn("q", F.explode(F.filter(F.sequence(F.lit(0), F.lit(qb - 1)), lambda q: F.pmod(q, F.lit(cb)) == F.col("c"))))
    seeds = stored(tiles(asks.withColumn("c", turn), first, True).groupBy("query").agg(F.min("bound").alias("bound")), "nn-bounds")
    bounded = asks.join(seeds.withColumnRenamed("query", "rep"), "rep", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    bounded = bounded.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cb - 1))))
    every_block = cands.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(qb - 1))))
    pairs = stored(tiles(bounded, every_block, False), "nn-pairs")
    bounds = stored(pairs.groupBy("query").agg(F.min("bound").alias("least")), "nn-least")
    left = pairs.join(bounds, "query").where(~(F.col("low") > F.col("least"))).select("query", "rep")
    qv = distinct.select(F.col("rep").alias("query"), F.col("vector").alias("qv"))
    exact = left.join(distinct.select("rep", "vector"), "rep").join(qv, "query")
    exact = exact.select("query", distance(F.col("qv"), F.col("vector")).alias("score"), "rep")

    def merge(batches):
        part = []
        for pdf in batches:
            part = heaps([*part, *zip(pdf["query"].tolist(), pdf["score"].tolist(), pdf["rep"].tolist(), strict=True)], k + 1)
        if part:
            yield pd.DataFrame(part, columns=["query", "score", "rep"])

    schema = "query long, score double, rep long"
    top = stored(exact.mapInPandas(merge, schema).repartition("query").mapInPandas(merge, schema), "nn-top")
    # Back from vectors to rows.
    hits = asked.join(top, "query").join(distinct.select("rep", F.explode("ids").alias("m")), "rep").where("m.id <> query_id")
    hits = hits.select("query_id", "score", F.col("m.id").alias("vec_id"), F.explode(F.sequence(F.lit(1), F.col("m.times"))).alias("time"))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
