"""Queries of the rule operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import assembly, rules
from .registry import query


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


_DIMS = {"population_match": "l_linenumber % 4", "intervention_match": "l_partkey % 4", "regimen_match": "l_suppkey % 4", "timepoint_match": "l_orderkey % 4", "outcome_match": "(l_orderkey + l_linenumber) % 4", "directness": "3", "attribution": "(l_partkey + 1) % 4"}
_TYPE = "CASE l_returnflag WHEN 'N' THEN 'primary_result' WHEN 'A' THEN 'case_result' ELSE 'review_result' END"


@query(
    "match_scores",
    f"""WITH d AS (SELECT l_orderkey, l_linenumber, {_TYPE} AS t, {', '.join(f'{v} AS {k}' for k, v in _DIMS.items())} FROM lineitem)
        SELECT l_orderkey, l_linenumber, round(greatest(0.0::DOUBLE, least({' + '.join(f'{w}::DOUBLE * {k} / 3' for k, w in rules.DIMENSIONS.items())},
            CASE t WHEN 'primary_result' THEN 1.0 WHEN 'case_result' THEN 0.75 ELSE 0.85 END::DOUBLE, CASE WHEN outcome_match = 0 THEN 0.30 ELSE 1.0 END::DOUBLE, CASE WHEN intervention_match = 0 THEN 0.25 WHEN population_match = 0 THEN 0.30 ELSE 1.0 END::DOUBLE,
            CASE regimen_match WHEN 0 THEN 0.30 WHEN 1 THEN 0.55 ELSE 1.0 END::DOUBLE, CASE WHEN timepoint_match = 0 THEN 0.35 ELSE 1.0 END::DOUBLE, CASE WHEN attribution = 0 THEN 0.60 ELSE 1.0 END::DOUBLE)), 4) AS score FROM d""",
)
def match_scores(spark, sf):
    dims = {k: F.expr(v) for k, v in _DIMS.items()}
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", rules.match_score(F.expr(_TYPE), dims, rules.derived_mismatches(F.lit(None).cast("array<string>"), dims)).alias("score"))


@query("activation_gate", """SELECT o_orderpriority AS skill_id, CAST(count(*) FILTER (WHERE o_totalprice > 400000) AS BIGINT) AS eligible, coalesce(bool_and(o_orderstatus <> 'P') FILTER (WHERE o_totalprice > 400000), false) AS efficacy,
        coalesce(bool_and(o_custkey > 0) FILTER (WHERE o_totalprice > 400000), false) AS callability, CASE WHEN eligible > 0 AND efficacy AND callability THEN 'active' ELSE 'candidate' END AS status FROM orders GROUP BY o_orderpriority""")
def activation_gate(spark, sf):
    o = _t(spark, sf, "orders").select(F.col("o_orderpriority").alias("skill_id"), (F.col("o_totalprice") > 400000).alias("baseline_wrong"), (F.col("o_orderstatus") != "P").alias("intervention_correct"), (F.col("o_custkey") > 0).alias("mounted"))
    return rules.activation_gate(o)


_HITS_SQL = "(SELECT conv_id AS query_id, role AS label, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rank FROM conversations)"


def _hits(spark, sf) -> DataFrame:
    c = _t(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("role").alias("label"), "turn")
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("turn").desc())))


@query("document_ranks", f"WITH f AS (SELECT *, min(rank) OVER (PARTITION BY query_id, label) AS first_rank FROM {_HITS_SQL}) SELECT query_id, label, turn, CAST(rank AS INTEGER) AS rank, CAST(first_rank AS INTEGER) AS first_rank, CAST(dense_rank() OVER (PARTITION BY query_id ORDER BY first_rank) AS INTEGER) AS doc_rank FROM f")
def document_ranks(spark, sf):
    return rules.document_ranks(_hits(spark, sf), "label", "rank")


@query("rank_window_rescue", f"WITH a AS (SELECT *, max((label = 'assistant' AND rank < 2)::INT) OVER (PARTITION BY query_id) AS above FROM {_HITS_SQL}) SELECT query_id, turn, CAST(rank AS INTEGER) AS rank FROM a WHERE above = 0 AND label = 'assistant' AND rank BETWEEN 2 AND 6")
def rank_window_rescue(spark, sf):
    return rules.rescue(_hits(spark, sf), 2, 6, ok=F.col("label") == "assistant").select("query_id", "turn", "rank")


@query("recent_rounds", f"SELECT query_id, turn, label FROM {_HITS_SQL} WHERE rank <= 2")
def recent_rounds(spark, sf):
    c = _t(spark, sf, "conversations").select(F.col("conv_id").alias("query_id"), F.col("role").alias("label"), "turn")
    return assembly.last_rounds(c, ("query_id",), "turn", 2).select("query_id", "turn", "label")


@query(
    "label_agreement",
    f"""WITH c AS (SELECT query_id, label, count(*) AS n, min(rank) AS first FROM {_HITS_SQL} WHERE rank <= 3 GROUP BY ALL), b AS (SELECT query_id, first(label ORDER BY n DESC, first) AS l3, max(CASE WHEN first = 1 THEN label END) AS l1 FROM c GROUP BY query_id)
        SELECT query_id, l1 = 'user' AS top1, l3 = 'user' AS top3 FROM b""",
)
def label_agreement(spark, sf):
    return rules.label_agreement(_hits(spark, sf).withColumn("truth", F.lit("user")), "truth", "label").select("query_id", "top1", "top3")


@query(
    "retrieval_report",
    f"""WITH g AS (SELECT DISTINCT query_id, turn AS id, 'cap' || (query_id % 3) AS capability FROM {_HITS_SQL} WHERE label = 'assistant'), s AS (SELECT query_id, capability, count(*) AS gold FROM g GROUP BY ALL),
             h AS (SELECT query_id, turn AS id, rank FROM {_HITS_SQL} WHERE rank <= 4), p AS (SELECT h.query_id, count(*) AS got, count(g.id) AS hit, min(CASE WHEN g.id IS NOT NULL THEN rank END) AS first FROM h LEFT JOIN g USING (query_id, id) GROUP BY h.query_id),
             q AS (SELECT capability, gold, coalesce(got, 0) AS got, coalesce(hit, 0) AS hit, first FROM s LEFT JOIN p USING (query_id))
        SELECT capability, count(*) AS n, round(avg((hit > 0)::INT), 4) AS hit_rate, round(avg(hit / CAST(gold AS DOUBLE)), 4) AS mean_recall, round(avg(CASE WHEN got > 0 THEN hit / CAST(got AS DOUBLE) ELSE 0 END), 4) AS mean_precision, round(avg(coalesce(1.0 / first, 0)), 4) AS mrr FROM q GROUP BY capability""",
)
def retrieval_report(spark, sf):
    h = _hits(spark, sf).withColumn("id", F.col("turn"))
    gold = h.where("label = 'assistant'").select("query_id", "id", F.concat(F.lit("cap"), (F.col("query_id") % 3).cast("string")).alias("capability"))
    return rules.retrieval_report(h.where("rank <= 4"), gold, "capability")


@query("retrieval_funnel", """WITH c AS (SELECT lang AS stage, source AS key, CASE WHEN n_chars < 300 THEN 'short' WHEN n_chars > 5000 THEN 'long' END AS reason, count(*) AS c FROM documents GROUP BY ALL)
        SELECT key, stage, CAST(sum(c) AS BIGINT) AS n, coalesce(string_agg(reason || ':' || c, ',' ORDER BY reason) FILTER (WHERE reason IS NOT NULL), '') AS reasons FROM c GROUP BY key, stage""")
def retrieval_funnel(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("source").alias("key"), F.col("lang").alias("stage"), "n_chars")
    return rules.funnel(d, "key", "stage", F.when(F.col("n_chars") < 300, "short").when(F.col("n_chars") > 5000, "long"))


@query("fallback_predictions", """WITH c AS (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS supported, max(o_totalprice) AS top FROM orders GROUP BY o_custkey)
        SELECT o_custkey, CASE WHEN top > 400000 THEN '进展或有害' WHEN supported > 0 THEN '明显获益' ELSE '有限获益或稳定' END AS benefit FROM c""")
def fallback_predictions(spark, sf):
    c = _t(spark, sf, "orders").groupBy("o_custkey").agg(F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("s"), F.max("o_totalprice").alias("top"))
    return c.select("o_custkey", rules.fallback_benefit(F.when(F.col("top") > 400000, "critical").otherwise("low"), F.array(F.lit("ok")), F.col("s")).alias("benefit"))


@query("replan_actions", """WITH a AS (SELECT user_id, count(DISTINCT event_type) AS queries, list_distinct(list(CASE event_type WHEN 'click' THEN 'dense_search' WHEN 'view' THEN 'bm25_search' ELSE 'fetch' END)) AS tools, count(*) FILTER (WHERE value < 5) AS no_gain, count(*) FILTER (WHERE value > 99.5) AS matched FROM events GROUP BY user_id),
        b AS (SELECT *, queries >= 2 AND list_contains(tools, 'dense_search') AND list_contains(tools, 'bm25_search') AND no_gain >= 2 AND matched = 0 AS absent FROM a)
        SELECT user_id, absent, CASE WHEN matched > 2 THEN 'advance_to_next_step' WHEN (absent OR no_gain >= 3) AND matched = 0 THEN 'advance_to_next_step' WHEN absent OR no_gain >= 3 THEN 'narrow_search' ELSE 'continue_step' END AS action FROM b""")
def replan_actions(spark, sf):
    tool = F.when(F.col("event_type") == "click", "dense_search").when(F.col("event_type") == "view", "bm25_search").otherwise("fetch")
    a = _t(spark, sf, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("q"), F.collect_set(tool).alias("tools"), F.sum((F.col("value") < 5).cast("long")).alias("no_gain"), F.sum((F.col("value") > 99.5).cast("long")).alias("m"))
    a = a.withColumn("absent", rules.absence_supported(F.col("q"), F.col("tools"), F.col("no_gain"), F.col("m")))
    return a.select("user_id", "absent", rules.next_action(F.col("m") > 2, F.col("absent"), F.col("no_gain"), F.col("m"), F.lit(0), F.lit(2)).alias("action"))


@query("content_hashes", "SELECT item_id, substr(sha256(text), 1, 12) AS digest, CAST(floor(length(text) / 2) AS BIGINT) AS tokens FROM benchmark")
def content_hashes(spark, sf):
    return _t(spark, sf, "benchmark").select("item_id", rules.content_hash(F.col("text")).alias("digest"), rules.token_estimate(F.col("text")).alias("tokens"))


@query("citation_pointers", "SELECT doc_id, (contains(lower(text), '[doi]')::INT + contains(lower(text), '[pubmed]')::INT + contains(lower(text), '[google scholar]')::INT + contains(lower(text), 'pmid:')::INT + contains(lower(text), 'doi:')::INT) >= 2 AS is_pointer FROM documents")
def citation_pointers(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", rules.is_citation_pointer(F.col("text")).alias("is_pointer"))


@query("constraint_hints", """SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'progression,耐药' WHEN 1 THEN 'toxicity,相似' ELSE '' END AS clinical, CASE item_id % 3 WHEN 0 THEN 'drug:gefitinib' WHEN 1 THEN 'response:PD' ELSE 'ddi:drug interaction' END AS focus,
        CASE item_id % 3 WHEN 0 THEN 'broaden_to_resistance_mechanism' WHEN 1 THEN 'broaden_to_similar_case' ELSE 'broaden_to_mechanism' END AS wider FROM benchmark""")
def constraint_hints(spark, sf):
    asked = F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("Gefitinib 耐药 progression "), F.col("item_id"))).when(F.col("item_id") % 3 == 1, F.lit("toxicity, best pd 相似")).otherwise(F.lit("ddi mechanism"))
    c = _t(spark, sf, "benchmark").select("item_id", rules.constraint_layers(asked).alias("c"))
    return c.select("item_id", F.array_join("c.soft_hints.clinical_terms", ",").alias("clinical"), F.array_join("c.soft_hints.retrieval_focus", ",").alias("focus"), F.array_join("c.expansion_hints", ",").alias("wider"))
