"""A whole retrieval run for a table of questions: support pass, counter-evidence pass, fetch, layering and verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import stored
from . import evidence, lexical, products, structured
from .rules import counter_query
from .sizes import broadcast_up_to


def run(queries: DataFrame, chunks: DataFrame, *, chunk_id: str = "chunk_id", text: str = "text", hint: Column | None = None, cutoff: str | None = None, date_col: str | None = None, top_k: int = 10, most_hits: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """(evidence rows: query_id, chunk, score, counter; verdicts: query_id, counts, verdict).

    Both passes are one search over twice the questions. Chunks after the cutoff are gone before statistics are taken. A
    chunk that both passes find counts as support, with its better score. Up to `most_hits` hits go to the chunks, so that
    no text is shuffled."""
    known = structured.known_by(chunks, cutoff, date_col=date_col) if cutoff and date_col else chunks
    ask = hint if hint is not None else counter_query(F.col("text"))
    both = queries.select(F.struct("query_id", F.lit(False).alias("counter")).alias("key"), "text").unionByName(queries.select(F.struct("query_id", F.lit(True).alias("counter")).alias("key"), ask.alias("text")))
    hits = lexical.search(known, both, id_col=chunk_id, text=F.col(text), query_id="key", top_k=top_k)
    rows = hits.select("query_id.*", F.col("id").alias(chunk_id), "score").groupBy("query_id", chunk_id).agg(F.max("score").alias("score"), F.min(F.col("counter").cast("int")).cast("boolean").alias("counter"))
    rows = broadcast_up_to(stored(rows, "route-hits"), most_hits).join(known.select(chunk_id, F.col(text).alias("evidence_text")), chunk_id)
    return rows, evidence.verdicts(rows, F.col("evidence_text"), F.col("counter"), ("query_id",))


def fetch(wanted: DataFrame, rows: DataFrame, row_id: str, limit: int) -> DataFrame:
    """wanted: query_id, pos, id -> rows in the order asked for, at most `limit` a query."""
    found = wanted.withColumnRenamed("id", row_id).join(rows, row_id)
    n = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    return found.withColumn("n", n).where(F.col("n") <= limit).drop("n")


def by_pmid(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, pmid -> the first document of each pmid, by id."""
    return wanted.join(docs.groupBy("pmid").agg(F.min("doc_id").alias("doc_id")), "pmid", "left")


def expand_nearest(cases: DataFrame, references: DataFrame, score: Column, features: str, bonus: float = 0.02, k: int = 2) -> DataFrame:
    """Per case the k best few-shot references (another case's), by score plus `bonus` for each shared feature.

    cases: case_id, features, ...; references: ref_id, ref_features, ...; a stated set of cases against all references."""
    pairs = cases.join(references, F.col("case_id") != F.col("ref_id"))
    total = score + bonus * F.size(F.array_intersect(features, f"ref_{features}"))
    order = Window.partitionBy("case_id").orderBy(F.round(total, 9).desc(), "ref_id")
    return pairs.withColumn("score", total).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("case_id", "ref_id", "score", "rank")


def nearest_examples(cases: DataFrame, references: DataFrame, *, bonus: float = 0.02, k: int = 2, block: int = 2048) -> DataFrame:
    """case_id, ref_id, score, rank: as expand_nearest with the dot product of vectors as score, without a join of all pairs.

    cases: case_id, vector, features; references: ref_id, vector, features. Features are keys of products.best beside the
    vectors, each of them worth `bonus`; so features that most rows share make no pairs. A null or differently long vector,
    or one with null or non-finite components, takes no part; null features are none, ties go by ref_id."""
    if bonus < 0:
        raise ValueError("bonus must not be negative")

    def row(df: DataFrame, key: str, to: str, each: float) -> DataFrame:
        f = F.array_distinct(F.filter(F.coalesce("features", F.array().cast(df.schema["features"].dataType)), lambda x: x.isNotNull()))
        return df.select(F.col(key).alias(to), "vector", f.alias("keys")).withColumn("vals", F.transform("keys", lambda _: F.lit(each)))

    found = products.best(row(references, "ref_id", "id", 1.0), row(cases, "case_id", "query_id", bonus), top_k=k, own=False, block=block)
    return found.select(F.col("query_id").alias("case_id"), F.col("id").alias("ref_id"), "score", "rank")
