"""BM25 over a table of chunks, for one query or a whole table of queries in one plan.

Postings are (id, term, tf, len). Statistics come from whatever rows are passed in, so a filtered corpus gets its own
document frequencies and mean length. Only terms that some query has are joined to postings.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.text import tokenize
from ..sources.folders import stored
from . import products
from .sizes import broadcast_up_to

K1, B = 1.5, 0.75
#: A term that no text has, as tokens hold no space.
MARK = " "
#: How often a document has a term, and its length, as blocks hold them.
COUNTS = np.dtype([("tf", "<i4"), ("len", "<i4")])
#: So many bytes of texts have one row of blocks for each of their terms: about 300 MB in the task that counts them.
TOGETHER = 64 << 20
#: So few terms of queries make few postings, which one plan over one scan joins.
FEW = 50


def tokenized(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, tokens of the documents with a token. The array goes through a generator, so that it is computed once however
    often it is referred to."""
    return docs.select(F.col(id_col).alias("id"), F.explode(F.array(tokenize(text))).alias("tokens")).where(F.size("tokens") > 0)


def postings(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """id, term, tf, len; documents without a token are not indexed."""
    return tokenized(docs, id_col, text).select("id", F.size("tokens").alias("len"), F.explode("tokens").alias("term")).groupBy("id", "len", "term").agg(F.count("*").alias("tf"))


def block_schema(kind: str) -> str:
    """Columns of blocks() of ids of this type."""
    return f"term string, ids {'binary' if kind == 'bigint' else f'array<{kind}>'}, counts binary, n int"


def _bytes(places: np.ndarray, values: np.ndarray) -> pa.Array:
    """One binary value for the values from each place to the next."""
    return pa.Array.from_buffers(pa.binary(), len(places) - 1, [None, pa.py_buffer((places * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _block(places: np.ndarray, ids: pa.Array, tf: np.ndarray, long: np.ndarray) -> list[pa.Array]:
    """ids, counts, n of rows whose postings begin at these places; the last one ends the last row."""
    counts = np.empty(len(tf), COUNTS)
    counts["tf"], counts["len"] = tf, long
    packed = _bytes(places, ids.to_numpy(zero_copy_only=False)) if ids.type == pa.int64() else pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), ids)
    return [packed, _bytes(places, counts), pa.array(np.diff(places).astype(np.int32))]


def blocks(docs: DataFrame) -> DataFrame:
    """term, ids, counts, n: postings of documents (id, text), counted where texts are read; those of a term in TOGETHER bytes of
    texts are one row, n its documents. Their counts and lengths are one binary value (COUNTS), and so are ids that are
    longs, as a list costs Spark a step for each number. Besides, documents with a token post their lengths under the term MARK."""

    def rows(term, code, *columns):
        first = np.flatnonzero(np.diff(code, prepend=-1))
        made = pa.RecordBatch.from_arrays([term.take(pa.array(code[first])), *_block(np.concatenate([first, [len(code)]]), *columns)], names=["term", "ids", "counts", "n"])
        return (made.slice(k, 20_000) for k in range(0, made.num_rows, 20_000))

    def counted(held):
        ids, term = (pa.concat_arrays([h[k] for h in held]) for k in (0, 1))
        term, n = term.dictionary_encode(), len(ids)
        known, long, key, t, d = term.indices.to_numpy().astype(np.int64), [], [], 0, 0
        for some, terms, code, place in held:
            key.append(known[t + code] * n + (d + place))
            long.append(np.bincount(place, minlength=len(some)))
            t, d = t + len(terms), d + len(some)
        long, (each, times) = np.concatenate(long), np.unique(np.concatenate(key), return_counts=True)
        yield from rows(term.dictionary, each // n, ids.take(pa.array(each % n)), times, long[each % n])
        has = np.flatnonzero(long)
        yield from rows(pa.array([MARK]), np.zeros(len(has), np.int64), ids.take(pa.array(has)), np.ones(len(has)), long[has])

    def run(batches):
        held, size = [], 0
        for batch in tokens.pooled(batches):
            term, code, place = tokens.coded(batch.column(1))
            held.append((batch.column(0), term, code.astype(np.int32), place.astype(np.int32)))
            size += batch.nbytes
            if size >= TOGETHER:
                yield from counted(held)
                held, size = [], 0
        if held:
            yield from counted(held)

    products.bounded_batches(docs.sparkSession)
    return docs.select("id", F.lower("text").alias("text")).mapInArrow(run, block_schema(docs.schema["id"].dataType.simpleString()))


def packed(lists: DataFrame, *cols: str) -> DataFrame:
    """These columns, and ids, counts, n of blocks() from lists ids, tfs, lens."""
    kind = lists.schema["ids"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            ids, tf, long = (batch.column(name) for name in ("ids", "tfs", "lens"))
            places = np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy(zero_copy_only=False))]).astype(np.int64)
            numbers = (c.flatten().to_numpy(zero_copy_only=False) for c in (tf, long))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in cols), *_block(places, ids.flatten(), *numbers)], names=[*cols, "ids", "counts", "n"])

    products.bounded_batches(lists.sparkSession)
    given = ", ".join(f"{c} {lists.schema[c].dataType.simpleString()}" for c in cols)
    return lists.select(*cols, "ids", "tfs", "lens").mapInArrow(run, f"{given}, {block_schema(kind).split(', ', 1)[1]}")


def unblocked(blocks: DataFrame, *cols: str) -> DataFrame:
    """These columns, and id, tf, len of each posting of blocks()."""
    kind = blocks.schema["ids"].dataType
    long = kind.simpleString() == "binary"

    def run(batches):
        for batch in batches:
            ids, n = batch.column("ids"), batch.column("n").to_numpy(zero_copy_only=False)
            row, counts = pa.array(np.repeat(np.arange(batch.num_rows), n)), tokens.buffers(batch.column("counts"))[0].view(COUNTS)
            ids = pa.array(tokens.buffers(ids)[0].view(np.int64)) if long else ids.flatten()
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(row) for c in cols), ids, *(pa.array(np.ascontiguousarray(counts[c])) for c in ("tf", "len"))], names=[*cols, "id", "tf", "len"])

    products.bounded_batches(blocks.sparkSession)
    given = "".join(f"{c} {blocks.schema[c].dataType.simpleString()}, " for c in cols)
    return blocks.select(*cols, "ids", "counts", "n").mapInArrow(run, f"{given}id {'bigint' if long else kind.elementType.simpleString()}, tf int, len int")


def corpus_stats(docs: DataFrame, text: Column) -> DataFrame:
    """One row: n documents with tokens and their mean length."""
    sizes = docs.select(F.size(tokenize(text)).alias("len")).where("len > 0")
    return sizes.agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))


def doc_freq(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def term_documents(docs: DataFrame, id_col: str, text: Column) -> DataFrame:
    """term, df straight from the texts: each document counts a term once, and counts are combined before the one shuffle."""
    return doc_freq(tokenized(docs, id_col, text).select(F.explode(F.array_distinct("tokens")).alias("term")))


def query_terms(queries: DataFrame, id_col: str, text: Column) -> DataFrame:
    """query_id, term, qtf: a repeated query token counts as often as it is repeated."""
    return queries.select(F.col(id_col).alias("query_id"), F.explode(tokenize(text)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def search(docs: DataFrame, queries: DataFrame, *, id_col: str = "doc_id", text: Column | None = None, query_id: str = "query_id", query_text: Column | None = None, top_k: int = 10, most_terms: int = 200_000) -> DataFrame:
    """query_id, id, score, rank: the best documents of each query; equal scores go by id.

    Up to `most_terms` distinct queried terms go to the tasks, which count them in each text where it is read; statistics and
    scores come from these counts, and only what may be among the best is shuffled. With more terms, with FEW at most in all
    queries together, or where an id comes twice (its rows are one document), postings are joined."""
    text = F.col("text") if text is None else text
    q = query_terms(queries, query_id, F.col("text") if query_text is None else query_text)
    if q.limit(FEW + 1).count() <= FEW:
        return _joined(docs, q, id_col, text, top_k, most_terms)
    q = stored(q, "query-terms")
    terms = [r["term"] for r in q.select("term").distinct().limit(most_terms + 1).collect()]
    if len(terms) > most_terms or not products.one_row_each(docs.select(F.col(id_col).alias("id")), "id"):
        return _joined(docs, q, id_col, text, top_k, most_terms)
    post = stored(term_counts(docs.select(F.col(id_col).alias("id"), text.alias("text")), terms), "term-counts")
    n, length = post.agg(F.count("*"), F.sum("len")).first()
    known = q.sparkSession.createDataFrame(pa.table({"term": pa.array(terms, pa.string()), "key": pa.array(range(len(terms)), pa.int32())}))
    df = post.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("df"))
    return best_by_counts(post.where(F.size("keys") > 0), q.join(F.broadcast(known), "term"), df, n, length, top_k)


def best_by_counts(post: DataFrame, q: DataFrame, df: DataFrame, n: int, length: int | None, top_k: int) -> DataFrame:
    """search() from counts. post: id, len, keys, tfs of documents; q: query_id, key, qtf; df: key, df; n documents of that length in all."""
    weights = q.join(df, "key").select("query_id", "key", (F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("qtf")).alias("w"))
    asks = weights.groupBy("query_id").agg(F.collect_list(F.struct("key", "w")).alias("e")).select("query_id", F.col("e.key").alias("keys"), F.col("e.w").alias("vals"))  # terms of a query
    part = F.transform("tfs", lambda tf: tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit((length or 0) / max(n, 1)))))
    return products.best(post.select("id", "keys", part.alias("vals")), stored(asks, "query-weights"), top_k=top_k, least=0.0)


def term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """id, len, keys, tfs: of each document (id, text) with a token its number of tokens, the places in `terms` of those it has, and how often."""
    known, kind, size = pa.array(terms, pa.string()), docs.schema["id"].dataType.simpleString(), max(1, len(terms))

    def run(batches):
        for batch in tokens.pooled(batches):
            n = batch.num_rows
            term, code, row = tokens.coded(batch.column(1))
            long, key = np.bincount(row, minlength=n), pc.fill_null(pc.index_in(term, value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)[code]
            each, times = np.unique((row * size + key)[key >= 0], return_counts=True)
            has = np.flatnonzero(long)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(each // size, minlength=n)[has])]).astype(np.int32))
            keys, tfs = (pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (each % size, times))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(has)), pa.array(long[has].astype(np.int32)), keys, tfs], names=["id", "len", "keys", "tfs"])

    products.bounded_batches(docs.sparkSession)
    return docs.select("id", F.lower("text").alias("text")).mapInArrow(run, f"id {kind}, len int, keys array<int>, tfs array<int>")


def _joined(docs: DataFrame, q: DataFrame, id_col: str, text: Column, top_k: int, most_terms: int) -> DataFrame:
    """search() by a join of postings; q: query_id, term, qtf."""
    # One scan and one shuffle serve statistics, document frequencies and scores: every document also posts its length
    # under the term MARK, and all three read the same columns of the same postings (tf too), so that Spark reuses the exchange.
    terms = q.select("term").distinct().unionAll(q.sparkSession.range(1).select(F.lit(MARK).alias("term")))
    listed = tokenized(docs, id_col, text).select("id", F.size("tokens").alias("len"), F.explode(F.concat(F.array(F.lit(MARK)), "tokens")).alias("term")).where(F.col("term").isNotNull())
    post = listed.join(broadcast_up_to(terms, most_terms), "term", "left_semi").groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    mark = F.col("tf") * (F.col("term") == MARK).cast("int") > 0
    stats = post.agg(F.count(F.when(mark, 1)).alias("n"), F.avg(F.when(mark, F.col("len"))).alias("avg_len"))
    df = post.groupBy("term").agg(F.count(F.when(F.col("tf") > 0, 1)).alias("df"))
    n, avg = F.col("n"), F.col("avg_len")
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / avg))
    scored = post.join(df.join(q, "term"), "term").crossJoin(F.broadcast(stats))  # one row
    scored = scored.groupBy("query_id", "id").agg(F.sum(part * F.col("qtf")).alias("score")).where("score > 0")
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)
