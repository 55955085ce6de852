"""Retrieval batches with scripted searches."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import batch

CHUNKS = [(f"d{d}#{k}", f"d{d}", f"document {d} part {k} " + ("response pr alpha" if k == 1 else "filler")) for d in range(4) for k in range(3)]


@pytest.fixture(scope="module")
def tables(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, doc_id string, text string")
    goals = spark.createDataFrame([(1, "alpha document"), (2, "alpha"), (3, "nothing asked")], "query_id long, text string")
    actions = spark.createDataFrame([(1, 1, 0, "dense_search", "alpha"), (1, 1, 1, "bm25_search", "beta"), (1, 1, 2, "bm25_search", "left out"), (2, 1, 0, "bm25_search", " "), (2, 2, 0, "other", "alpha")], "query_id long, round int, pos int, channel string, text string")
    return goals, actions, chunks


def scripted(ids):
    """A search that finds the same chunks for every question, the first with the best score."""
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("id"), F.lit(1.0 / (k + 1)).alias("score"), F.lit(k + 1).alias("rank")) for k, i in enumerate(ids))))
    return lambda asks: asks.select("query_id", "text", rows.alias("h")).where("text <> 'left out'").select("query_id", "h.*")


def test_rounds_build_on_each_other(tables):
    goals, actions, chunks = tables
    searches = {"dense_search": scripted(["d0#0", "d1#0"]), "bm25_search": scripted(["d1#0"]), "other": scripted(["d3#2"])}
    state, found = batch.run(goals, actions, chunks, searches, locate=scripted(["d2#0"]), per_document=1)
    seen = {(r.query_id, r.channel, r["round"], r.id) for r in state.collect()}
    # an action beyond the second, one without text and a question without actions find nothing
    assert {q for q, *_ in seen} == {1, 2} and {c for q, c, _, _ in seen if q == 2} == {"other", batch.DETAIL}
    # every found document is opened, and its best chunk has the terms and a clinical word
    assert {i for q, c, _, i in seen if c == batch.DETAIL and q == 1} == {"d0#1", "d1#1", "d2#1"}
    rows = [r for r in found.orderBy("query_id", "rank").collect() if r.query_id == 1]
    # the reserved: bm25, dense, located, details; d1#0 is found by two channels and comes once
    assert [r.id for r in rows] == ["d1#0", "d0#0", "d2#0", "d0#1", "d1#1", "d2#1"] and [r.n_channels for r in rows] == [2, 1, 1, 1, 1, 1]
    assert rows[0].rrf == pytest.approx(1 / 61 + 1 / 62)
    best = batch.run(goals, actions, chunks, searches, per_document=1, evidence=2, score=F.length("text"))[1].where("query_id = 1").orderBy("rank").collect()
    assert [r.rank for r in best] == [1, 2] and all("response" in r.text for r in best)


def test_channels_without_a_search_are_refused(tables):
    goals, actions, chunks = tables
    with pytest.raises(ValueError, match="no search for"):
        batch.run(goals, actions, chunks, {"dense_search": scripted(["d0#0"])})


def test_structured_hits_count_distinct_values(spark):
    entities = spark.createDataFrame([("c1", "a"), ("c1", "a"), ("c1", "b"), ("c2", "a"), ("c3", "z")], "id string, value string")
    asks = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "q")], "query_id long, value string")
    assert [tuple(r) for r in batch.structured(entities, asks).orderBy("rank").collect()] == [(1, "c1", 1.0, 1), (1, "c2", 0.5, 2)]
