"""Queries of gold anchors, reverse search and traces of past runs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anchors, assembly, traces
from ..sources.folders import stored
from .registry import query
from .retrieval import _CHUNKS_SQL, _t, chunks

_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_TERM, _OUTCOME = (p.replace("(?iU)", "(?i)") for p in (assembly.TERM, assembly.OUTCOME))
_PLAIN = "replace(replace(replace({0}, '年', '-'), '月', '-'), '日', '')"
_DISTINCT = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"


@query(
    "gold_candidates",
    rf"""WITH l AS (SELECT item_id, list_filter(list_transform(list_append(string_split(text, chr(10)), text), lambda x: {_STRIP.format("x")}), lambda x: x <> '') AS said FROM benchmark WHERE text IS NOT NULL),
             d AS (SELECT item_id, {_DISTINCT.format("said")} AS said FROM l),
             g AS (SELECT item_id, pos, said[pos + 1] AS gold FROM (SELECT item_id, said, unnest(range(len(said))) AS pos FROM d)),
             m AS (SELECT item_id, pos, gold, list_distinct(regexp_extract_all(gold, '{_TERM}')) AS terms, regexp_extract_all(gold, '{assembly.DATE}') AS dates, regexp_extract_all(gold, '{_OUTCOME}') AS outcomes FROM g),
             c AS (SELECT printf('%010d#%06d', doc_id, chunk_order) AS id, chunk, lower(chunk) AS low FROM {_CHUNKS_SQL}),
             o AS (SELECT item_id, pos, id, len(list_filter(terms, lambda t: contains(low, lower(t)))) / greatest(1, len(terms))::DOUBLE AS share, len(list_filter(dates, lambda t: contains({_PLAIN.format("chunk")}, {_PLAIN.format("t")}))) > 0 AS date_hit, len(list_filter(outcomes, lambda t: contains(low, lower(t)))) > 0 AS outcome_hit FROM m, c)
        SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY round(share, 4) DESC, pos, id) AS INTEGER) AS rank, CAST(pos AS INTEGER) AS pos, id, round(share, 4) AS lexical, date_hit, outcome_hit FROM o WHERE share >= 0.35 OR date_hit AND outcome_hit QUALIFY rank <= 60""",
)
def gold_candidates(spark, sf):
    """The first 60 chunks that cover the lines, or the whole, of each benchmark item, searched in the chunks of all documents."""
    truth = F.struct(F.split("text", "\n").alias("key_evidence_items"), F.col("text").alias("benefit_rebalance_reason"))
    cases = _t(spark, sf, "benchmark").select(F.col("item_id").alias("case_id"), F.to_json(F.struct(truth.alias("ground_truth"))).alias("body"))
    rows = chunks(_t(spark, sf, "documents")).select(F.format_string("%010d#%06d", "doc_id", "chunk_order").alias("id"), F.col("chunk").alias("text"))
    golds = anchors.gold_texts(cases).select(F.struct("case_id", "pos").alias("gold_id"), "text")
    found = anchors.first_covering(golds, stored(rows, "gold-chunks")).select("gold_id.*", "id", "lexical", "date_hit", "outcome_hit", F.lit(None).cast("double").alias("score"))
    return anchors.candidates(found).select(F.col("case_id").alias("item_id"), "rank", "pos", "id", "lexical", "date_hit", "outcome_hit")


@query(
    "anchor_presence",
    """WITH a AS (SELECT l_orderkey, 'doc_id' AS kind, l_partkey AS value FROM lineitem UNION ALL SELECT l_orderkey, 'pmid', l_suppkey FROM lineitem UNION ALL SELECT l_orderkey, 'chunk_id', l_suppkey * 10 + l_linenumber FROM lineitem),
             k AS (SELECT 'doc_id' AS kind, doc_id AS value FROM documents UNION SELECT 'pmid', doc_id * 3 FROM documents UNION SELECT 'chunk_id', doc_id FROM documents)
        SELECT DISTINCT l_orderkey, kind, CAST(value AS VARCHAR) AS value FROM a JOIN k USING (kind, value) WHERE NOT (kind = 'doc_id' AND value = 0)""",
)
def anchor_presence(spark, sf):
    """What the index knows of the gold that orders name: parts as documents (the number 0 is none), suppliers as members, lines as chunks."""
    line = _t(spark, sf, "lineitem")
    gold = F.struct(F.col("l_partkey").alias("doc_id"), F.array(F.struct(F.col("l_suppkey").cast("string").alias("pmid"))).alias("members"))
    cited = (F.col("l_suppkey") * 10 + F.col("l_linenumber")).cast("string")
    cases = line.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.collect_list(gold).alias("gold_evidence"), F.collect_list(cited).alias("gold_citations"))  # lines of an order
    cases = cases.select("case_id", F.to_json(F.struct(F.struct("gold_evidence").alias("ground_truth"), "gold_citations")).alias("body"))
    d = _t(spark, sf, "documents")
    known = anchors.present(anchors.gold_anchors(cases), d.select(F.col("doc_id").alias("chunk_id")), d.select("doc_id", (F.col("doc_id") * 3).alias("pmid")))
    return known.withColumnRenamed("case_id", "l_orderkey")


@query(
    "judged_groups",
    """WITH h AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) - 1 AS pos, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS id, CASE WHEN event_id % 5 <> 0 THEN CAST(json_extract(props, '$.k') AS BIGINT) % 4 END AS score, json_extract(props, '$.k') AS k FROM events),
             j AS (SELECT * FROM h WHERE event_type <> 'error' AND score IS NOT NULL AND k IS NOT NULL QUALIFY count(*) OVER (PARTITION BY user_id, event_type) >= 2 AND min(score) OVER (PARTITION BY user_id, event_type) < max(score) OVER (PARTITION BY user_id, event_type))
        SELECT CAST(user_id AS VARCHAR) AS source, event_type AS query, CAST(pos AS INTEGER) AS pos, id, CAST(score AS DOUBLE) AS historical_score, CAST(k AS BIGINT) AS k, md5(coalesce(text, event_type)) AS digest FROM j LEFT JOIN documents ON CAST(doc_id AS VARCHAR) = id""",
)
def judged_groups(spark, sf):
    """Traces of all users, a step for each type of event, whose hits are documents."""
    hit = F.struct(
        "event_id", F.floor("value").cast("string").alias("id"), F.when(F.col("event_id") % 5 != 0, F.from_json("props", "k long")["k"] % 4).alias("llm_relevance_score"),
        F.from_json("props", "k long").alias("llm_rerank_dimensions"), F.col("event_type").alias("text_preview"),
    )
    step = _t(spark, sf, "events").groupBy("user_id", "event_type").agg(F.array_sort(F.collect_list(hit)).alias("top_hits"))  # a trace of one user
    step = F.struct(F.when(F.col("event_type") == "error", "Search").otherwise("Rerank").alias("name"), F.col("event_type").alias("atomic_rerank_goal"), "top_hits"), step
    bodies = step[1].groupBy("user_id").agg(F.collect_list(step[0]).alias("steps")).select(F.col("user_id").cast("string").alias("source"), F.to_json(F.struct("steps")).alias("body"))
    rows = traces.judged_groups(stored(bodies, "traces"), _t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text"))
    return rows.select("source", "query", "pos", "id", "historical_score", F.variant_get(F.element_at("dimensions", "k"), "$", "long").alias("k"), F.md5("text").alias("digest"))


@query(
    "asked_steps",
    rf"""WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS step, turn, role, {_STRIP.format("text")} AS goal FROM conversations)
        SELECT printf('%012d', conv_id) AS source, CAST(step AS INTEGER) AS step, role AS query, md5(goal) AS goal FROM s WHERE turn % 3 <> 1 AND role <> '' AND goal <> '' QUALIFY row_number() OVER (PARTITION BY role, goal ORDER BY conv_id, step) = 1""",
)
def asked_steps(spark, sf):
    """Every conversation as a session whose turns are steps; two of three were searched with the tool that counts."""
    tools = F.when(F.col("turn") % 3 != 1, F.array(F.lit("bm25_search"), F.lit("hybrid_search"))).otherwise(F.array(F.lit("bm25_search")))
    turn = F.struct("turn", F.col("role").alias("query"), F.col("text").alias("rerank_goal"), tools.alias("selected_tools"))
    bodies = _t(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("loop_steps"))
    bodies = bodies.select(F.format_string("%012d", "conv_id").alias("source"), F.to_json(F.struct("loop_steps")).alias("body"))
    return traces.asked_steps(bodies).select("source", "step", "query", F.md5("goal").alias("goal"))


@query(
    "category_picks",
    r"""WITH RECURSIVE w AS (SELECT item_id, list_filter(regexp_extract_all(lower(text), '[a-z]{5,}'), lambda x: true) AS l FROM benchmark),
             n AS (SELECT item_id, list_filter(l, lambda x, i: list_position(l, x) = i)[1:2] AS needles FROM w),
             f AS (SELECT item_id, list(doc_id ORDER BY doc_id) AS docs FROM n, documents WHERE len(needles) > 0 AND len(list_filter(needles, lambda x: contains(lower(text), x))) = len(needles) GROUP BY item_id),
             o AS (SELECT *, row_number() OVER (ORDER BY item_id) AS turn FROM f),
             r AS (SELECT 0::BIGINT AS turn, NULL::BIGINT AS item_id, NULL::BIGINT AS doc_id, []::BIGINT[] AS used
                   UNION ALL SELECT o.turn, o.item_id, list_filter(docs, lambda d: NOT list_contains(used, d))[1], list_append(used, list_filter(docs, lambda d: NOT list_contains(used, d))[1]) FROM r JOIN o ON o.turn = r.turn + 1)
        SELECT item_id, doc_id FROM r WHERE doc_id IS NOT NULL""",
)
def category_picks(spark, sf):
    """For each benchmark item, by id, the first document with its first two long words that no item before it took."""
    needles = F.slice(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{5,}"), F.lit(0))), 1, 2)
    wanted = _t(spark, sf, "benchmark").select(F.col("item_id").alias("category"), needles.alias("needles"))
    found = traces.matches(_t(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text"), wanted)
    picked = traces.pick_without_reuse(found.select("category", F.col("category").alias("turn"), "row_id", F.col("row_id").alias("place")))
    return picked.select(F.col("category").alias("item_id"), F.col("row_id").alias("doc_id"))
