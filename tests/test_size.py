"""Plans that must not shuffle what grows with the texts."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import anchors, router
from quillstone.operators.postings import PostingsIndex


@pytest.fixture
def no_size_hint(spark):
    """No table is small by Spark's own estimate."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().sparkPlan().toString()


CHUNKS = "id long, text string"


def test_routed_hits_go_to_the_chunks(spark, no_size_hint):
    chunks = spark.createDataFrame([(k, f"drug{k} toxicity response" if k % 2 else f"drug{k}") for k in range(40)], CHUNKS)
    asks = spark.createDataFrame([(k, f"drug{k} drug{k + 1}") for k in range(20)], "query_id long, text string")
    args = dict(chunk_id="id", hint=F.concat("text", F.lit(" toxicity")), top_k=3)
    rows, _ = router.run(asks, chunks, **args)
    assert "SortMergeJoin" not in plan(rows) and "BroadcastHashJoin" in plan(rows)
    other, _ = router.run(asks, chunks, **args, most_hits=1)
    assert "SortMergeJoin" in plan(other)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, other.collect()))


def test_excerpts_leave_texts_where_they_are(spark, sf, no_size_hint):
    from quillstone.plans import registry

    found = registry.QUERIES["query_excerpts"](spark, sf)
    assert "SortMergeJoin" not in plan(found) and "BroadcastHashJoin" in plan(found)


def test_index_searches_of_many_terms_shuffle_no_pairs(spark, sf, no_size_hint):
    docs, index = spark.read.parquet(f"{sf}/documents.parquet"), PostingsIndex(spark, buckets=5, deal=2)
    for k in range(2):
        index.add(docs.where(F.col("doc_id") % 2 == k))
    asks = spark.read.parquet(f"{sf}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    for within in (None, docs.where("lang = 'de'").select(F.col("doc_id").alias("id"))):
        found, joined = index.search(asks, within=within), index.search(asks, within=within, most_terms=1)
        assert "MapInArrow" in plan(found) and "Aggregate" not in plan(found) and "Join" not in plan(found)
        got, want = ({(r["query_id"], r["id"], r["rank"], round(r["score"], 7)) for r in df.collect()} for df in (found, joined))
        assert got == want and got


def test_documents_that_come_twice_in_a_batch_are_refused(spark):
    index = PostingsIndex(spark)
    with pytest.raises(ValueError, match="twice"):
        index.add(spark.createDataFrame([(1, "word"), (1, "other words")], "doc_id long, text string"))
    assert index.n_docs == 0 and index.doc_freq().count() == 0
    index.add(spark.createDataFrame([(1, "word word"), (2, "other words")], "doc_id long, text string"))
    assert {tuple(r) for r in index._read("sizes").collect()} == {(1, 2), (2, 2)} and index.doc_freq().count() == 3


def test_anchors_are_rows_before_they_are_looked_up(spark):
    bodies = [
        '{"gold_citations": ["c1", "", "0", 7, null, {"chunk_id": 0, "doc_id": "0", "pmid": 12.0, "group_id": "g"}], "gold_evidence": "none"}',
        '{"ground_truth": {"gold_evidence": [{"doc_id": 5, "members": [{"pmid": "p", "group_id": "h"}, "text", {"chunk_id": []}], "citations": [{"pmid": "q"}]}, {"citations": [{"pmid": "q"}, {"pmid": null}]}]}}',
        "[1]", "no json", None,
    ]
    found = anchors.gold_anchors(spark.createDataFrame(list(enumerate(bodies)), "case_id long, body string"))
    assert "lambda" not in plan(found)
    first = {(0, "chunk_id", "c1"), (0, "chunk_id", "0"), (0, "doc_id", "0"), (0, "pmid", "12"), (0, "group_id", "g")}
    assert {tuple(r) for r in found.collect()} == first | {(1, "doc_id", "5"), (1, "pmid", "p"), (1, "pmid", "q")}


ODD = [(1, None), (2, ""), (3, "The EGFR-L858R of 肺腺癌 4.5, 肺"), (4, "İK\u212a é-word+\nword WORD."), (5, "the of and"), (6, "x" * 70000 + " egfr-l858r"), (7, "word 肺腺 " * 40)]


def test_hashed_texts_are_tokenised_where_they_are_counted(spark):
    from quillstone.operators import dense

    docs = spark.createDataFrame(ODD, CHUNKS)
    asks = docs.where("id in (3, 7)")
    found = dense.hash_search(docs, asks, id_col="id", text=F.col("text"), query_id="id", query_text=F.col("text"))
    assert "regexp_extract_all" not in plan(dense.hash_vectors(docs, "id", F.col("text"))) and "regexp_extract_all" not in plan(found)
    a, b = (dense.hash_buckets(d, "id", F.col("text")).select(F.col("id").alias(n), "bucket", F.col("weight").alias(w)) for d, n, w in ((docs, "id", "x"), (asks, "query_id", "y")))
    want = {(r["query_id"], r["id"], round(r["score"], 7)) for r in a.join(b, "bucket").groupBy("query_id", "id").agg(F.sum(F.col("x") * F.col("y")).alias("score")).where("score > 1e-8").collect()}
    assert {(r["query_id"], r["id"], round(r["score"], 7)) for r in found.collect()} == want and want


def test_queried_terms_are_counted_where_texts_are_read(spark):
    from quillstone.operators import lexical

    docs = spark.createDataFrame(ODD, CHUNKS)
    assert "regexp_extract_all" not in plan(lexical.term_counts(docs, ["word", "肺腺"]))
    assert {(r["id"], r["len"], tuple(r["keys"]), tuple(r["tfs"])) for r in lexical.term_counts(docs, ["word", "肺腺"]).collect()} == {(3, 5, (1,), (1,)), (4, 5, (0,), (1,)), (6, 2, (), ()), (7, 80, (0, 1), (40, 40))}
    asks = spark.createDataFrame([(1, "word 肺腺癌 " + " ".join(f"w{k}" for k in range(60))), (2, "egfr-l858r é")], "query_id long, text string")
    got, want = ({(r["query_id"], r["id"], r["rank"], round(r["score"], 7)) for r in lexical.search(docs, asks, id_col="id", most_terms=m).collect()} for m in (1000, 1))
    assert got == want and got
