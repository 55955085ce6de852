"""Retrieval batches for a table of questions: rounds of searches, recovery of details, fusion, pool and evidence.

All questions go through each round together; what a question has found is kept as rows of a state table:

    query_id, channel, round, pos, rank, id, score

A round runs, for each channel, one search over the actions of all questions; a question's first semantic action also
locates documents and their best details. Then the best documents found so far are opened: each gives its best chunks to
the channel `document_detail`. Channels are fused by reciprocal ranks, where a channel's list is what it found in the order
in which it found it first; the pool reserves the first of some channels, then details, then goes by fused rank. The state
is written after every round, so a lost executor costs a round at most, and plans do not grow with rounds.

Edge cases: actions without text find nothing; an action beyond `per_round` of its round is left out, by pos; equal scores go
by id; a question that finds nothing has no rows; a channel that no search is given for is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import retrieval_terms
from ..sources.folders import stored
from . import fusion, twostage
from .sizes import broadcast_up_to

#: (query_id, text) -> query_id, id, score, rank
Search = Callable[[DataFrame], DataFrame]
SEED, DETAIL = "step3_then_step2_search", "document_detail"
SEMANTIC, RESERVED = ("dense_search", "hybrid_search"), ("bm25_search", "dense_search", SEED, DETAIL)
#: Words that speak for a clinical result.
CLINICAL = r"(?U)\b(?:pemetrexed|carboplatin|cisplatin|osimertinib|almonertinib|leptomeningeal|lmd|csf|response|progress|orr|dcr|recist|pr|sd|pd)\b"


#: So many rows that come from questions are broadcast to chunks.
MOST = 200_000


def few(rows: DataFrame, name: str) -> DataFrame:
    """Rows that grow with the questions and not with the chunks, stored and broadcast, so that no chunk is shuffled to meet them."""
    return broadcast_up_to(stored(rows, name), MOST)


def detail_rows(wanted: DataFrame, chunks: DataFrame, per_document: int = 3) -> DataFrame:
    """query_id, id, score: the best chunks of each wanted document.

    wanted: query_id, doc_id, terms. A chunk's score is the share of the terms that it contains, and up to 0.25 for its
    clinical words."""
    text = F.lower(F.trim(F.regexp_replace("text", r"\s+", " ")))
    rows = chunks.join(few(wanted, "details-wanted"), "doc_id").withColumn("low", text)
    score = twostage.coverage(F.col("low"), F.col("terms")) + F.least(F.lit(0.25), F.lit(0.025) * F.regexp_count("low", F.lit(CLINICAL)))
    best = Window.partitionBy("query_id", "doc_id").orderBy(F.round("score", 9).desc(), "id")
    rows = rows.select("query_id", "doc_id", F.col("chunk_id").alias("id"), score.alias("score"))
    return rows.withColumn("n", F.row_number().over(best)).where(F.col("n") <= per_document).select("query_id", "id", "score")


def locate_then_detail(asks: DataFrame, locators: DataFrame, chunks: DataFrame, *, documents: int = 30, per_document: int = 3, top_k: int = 32) -> DataFrame:
    """query_id, id, score, rank: details of the documents that each question's dense hits locate, as
    twostage.locate_then_detail gives for one question.

    asks: query_id, text; locators: query_id, id, score (chunks found); chunks: chunk_id, doc_id, text."""
    found = few(locators.select("query_id", "id", "score"), "locators").join(chunks.withColumnRenamed("chunk_id", "id"), "id")
    place = found.groupBy("query_id", "doc_id").agg(F.max("score").alias("dense"), F.array_join(F.array_sort(F.collect_list(F.lower("text"))), " ").alias("found"))
    place = place.join(asks.select("query_id", F.col("text").alias("ask"), retrieval_terms(F.lower("text")).alias("terms")), "query_id")
    place = place.withColumn("locator", 0.70 * F.col("dense") + 0.30 * twostage.coverage(F.col("found"), F.col("terms")))
    near = Window.partitionBy("query_id").orderBy(F.round("locator", 9).desc(), "doc_id")
    targets = F.array_distinct(F.concat(twostage.target_types(F.col("ask")), twostage.target_types(F.col("found"))))
    place = place.withColumn("n", F.row_number().over(near)).where(F.col("n") <= documents).select("query_id", "doc_id", "locator", "terms", targets.alias("targets"))
    score, bucket = twostage.detail_score(F.col("text"), F.col("terms"), F.col("targets"))
    rows = chunks.join(few(place, "located"), "doc_id").select("query_id", "doc_id", F.col("chunk_id").alias("id"), "locator", score.alias("score"), bucket.alias("bucket"))
    order = [F.round("score", 9).desc(), F.col("id")]
    nth = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rows = rows.withColumn("b", nth("query_id", "doc_id", "bucket")).where("b = 1").withColumn("d", nth("query_id", "doc_id")).where(F.col("d") <= per_document)
    rows = rows.withColumn("score", 0.55 * F.col("locator") + 0.45 * F.col("score")).withColumn("sibling", (nth("query_id", "doc_id") > 1).cast("int"))
    first = Window.partitionBy("query_id").orderBy("sibling", *order)
    return rows.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top_k).select("query_id", "id", "score", "rank")


def structured(entities: DataFrame, asks: DataFrame, top_k: int = 20) -> DataFrame:
    """query_id, id, score, rank: chunks by the share of a question's wanted values that they hold.

    entities: id, value; asks: query_id, value. Both are made distinct."""
    wanted = asks.select("query_id", "value").distinct()
    n = wanted.groupBy("query_id").agg(F.count("*").alias("of"))
    # cut to the wanted values before anything is shuffled
    held = entities.select("id", "value").join(broadcast_up_to(wanted.select("value").distinct(), MOST), "value", "left_semi").distinct()
    hits = held.join(broadcast_up_to(wanted, MOST), "value").groupBy("query_id", "id").agg(F.count("*").alias("held"))
    hits = hits.join(n, "query_id").select("query_id", "id", (F.col("held") / F.col("of")).alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top_k)


def _listed(state: DataFrame) -> DataFrame:
    """query_id, channel, id, rank: each channel's list, in the order in which it found its hits first."""
    first = state.groupBy("query_id", "channel", "id").agg(F.min(F.struct("round", "pos", "rank")).alias("at"))
    return first.select("query_id", "channel", "id", F.row_number().over(Window.partitionBy("query_id", "channel").orderBy("at", "id")).alias("rank"))


def run(goals: DataFrame, actions: DataFrame, chunks: DataFrame, searches: Mapping[str, Search], *, locate: Search | None = None, per_round: int = 2, documents: int = 10, per_document: int = 3, pool: int = 16, evidence: int = 12, score: Column | None = None, places: int = 6, most_rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """(state; evidence: query_id, rank, id, doc_id, rrf, n_channels, lane, text, score).

    goals: query_id, text; actions: query_id, round, pos, channel, text; chunks: chunk_id, doc_id, text; searches: by
    channel; locate: the search of a round's first semantic action. Scores are kept with `places` digits. score: of the
    pool's rows (with goal and text), to order the evidence by; without it the pool's order is kept."""
    # a round's number and a channel's name, no rows of questions
    rounds = [r["round"] for r in actions.select("round").distinct().orderBy("round").limit(most_rounds + 1).collect()]
    names = {r["channel"] for r in actions.select("channel").distinct().limit(100).collect()}
    if len(rounds) > most_rounds:
        raise ValueError(f"more than {most_rounds} rounds")
    if names - set(searches):
        raise ValueError(f"no search for {sorted(names - set(searches))}")
    nth = F.row_number().over(Window.partitionBy("query_id", "round").orderBy("pos"))
    actions = actions.withColumn("n", nth).where(F.col("n") <= per_round).where(F.trim(F.coalesce("text", F.lit(""))) != "").drop("n")
    state = None
    for r in rounds:
        mine, found = actions.where(F.col("round") == r), []
        if locate is not None:
            first = Window.partitionBy("query_id").orderBy("pos")
            seeds = mine.where(F.col("channel").isin(*SEMANTIC)).withColumn("n", F.row_number().over(first)).where("n = 1").select("query_id", "text")
            found.append(locate(seeds).select("query_id", F.lit(SEED).alias("channel"), F.lit(0).alias("pos"), "rank", "id", "score"))
        for name, search in searches.items():
            if name in names:
                keyed = mine.where(F.col("channel") == name).select(F.struct("query_id", "pos").alias("query_id"), "text")
                found.append(search(keyed).select("query_id.query_id", F.lit(name).alias("channel"), F.col("query_id.pos").alias("pos"), "rank", "id", "score"))
        rows = found[0]
        for more in found[1:]:
            rows = rows.unionByName(more)
        rows = stored(rows.select("query_id", "channel", F.lit(r).alias("round"), "pos", "rank", "id", F.round("score", places).alias("score")), "batch-round")
        state = rows if state is None else state.unionByName(rows)
        # the documents of the best hits so far, whatever channel found them
        best = few(state.groupBy("query_id", "id").agg(F.max("score").alias("score")), "batch-best").join(chunks.select(F.col("chunk_id").alias("id"), "doc_id"), "id")
        docs = best.groupBy("query_id", "doc_id").agg(F.min(F.struct((-F.col("score")).alias("less"), "id")).alias("top"))
        docs = docs.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("top"))).where(F.col("n") <= documents).select("query_id", "doc_id")
        said = mine.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda a: a["text"]), " ").alias("said"))  # per_round texts
        terms = goals.join(said, "query_id").select("query_id", retrieval_terms(F.lower(F.concat_ws(" ", "text", "said")), 64).alias("terms"))
        details = detail_rows(docs.join(terms, "query_id"), chunks, per_document)
        details = details.withColumn("score", F.round("score", places)).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")))
        state = stored(state.unionByName(details.select("query_id", F.lit(DETAIL).alias("channel"), F.lit(r).alias("round"), F.lit(0).alias("pos"), "rank", "id", "score")), "batch-state")
    if state is None:
        raise ValueError("no actions")
    lists = _listed(state)
    chosen = fusion.candidate_pool(lists, RESERVED, DETAIL, size=pool, keys=("query_id",))
    fused = lists.groupBy("query_id", "id").agg(F.sum(1 / (F.lit(60.0) + F.col("rank"))).alias("rrf"), F.count("*").alias("n_channels"))
    rows = few(chosen.join(fused, ["query_id", "id"]), "batch-pool").join(chunks.withColumnRenamed("chunk_id", "id"), "id").join(goals.select("query_id", F.col("text").alias("goal")), "query_id")
    rows = rows.withColumn("score", F.lit(None).cast("double") if score is None else score)
    last = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc_nulls_last(), "pool_pos")
    rows = rows.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= evidence)
    return state, rows.select("query_id", "rank", "id", "doc_id", "rrf", "n_channels", "lane", "text", "score")
