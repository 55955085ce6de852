"""Retrieval queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import assembly, dense, evidence, fusion, lexical, router, rules, structured, twostage
from .registry import query

STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokens_sql(source: str, key: str, col: str = "text") -> str:
    return rf"(SELECT {key}, list_filter(regexp_extract_all(lower(trim(regexp_replace({col}, '\s+', ' ', 'g'))), '[A-Za-z0-9\-\+\.]+'), lambda w: w NOT IN ({STOP})) AS tokens FROM {source})"


def bm25_sql(docs: str, queries: str, k: int) -> str:
    """docs and queries: sub-queries with (id, text) and (query_id, text)."""
    return f"""
        WITH d AS (SELECT id, tokens, len(tokens) AS len FROM {tokens_sql(docs, 'id')} WHERE len(tokens) > 0),
             s AS (SELECT count(*) AS n, avg(len) AS avg_len FROM d),
             q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(tokens) AS term FROM {tokens_sql(queries, 'query_id')}) GROUP BY ALL),
             p AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len, unnest(tokens) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
             f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
             r AS (SELECT query_id, id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * len / avg_len))) AS score
                   FROM p JOIN f USING (term) JOIN q USING (term), s GROUP BY query_id, id HAVING score > 0),
             t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM r)
        SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM t WHERE rank <= {k}"""


ASK = "the edthion ingand thble erhouse andition stre inly ention ofthe"
_ASK_SQL = f"(SELECT 0 AS query_id, '{ASK}' AS text)"


def _ask(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(0).alias("query_id"), F.lit(ASK).alias("text"))


def _bm25(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    return lexical.search(docs, queries, top_k=k).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("tokenize_stats", f"SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, CAST(len(list_distinct(tokens)) AS BIGINT) AS n_distinct FROM {tokens_sql('documents', 'doc_id')}")
def tokenize_stats(spark, sf):
    t = _t(spark, sf, "documents").select("doc_id", text.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query("doc_freq_topn", f"SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(tokens)) AS term FROM {tokens_sql('documents', 'doc_id')}) GROUP BY term ORDER BY df DESC, term LIMIT 50")
def doc_freq_topn(spark, sf):
    return lexical.term_documents(_t(spark, sf, "documents"), "doc_id", F.col("text")).orderBy(F.col("df").desc(), "term").limit(50)


_CHUNKS_SQL = r"""(SELECT doc_id, CAST(k AS INTEGER) AS chunk_order, substr(t, CAST(k * 780 + 1 AS BIGINT), 900) AS chunk
        FROM (SELECT doc_id, t, unnest(range(CASE WHEN length(t) <= 900 THEN 1 ELSE CAST(ceil((length(t) - 900) / 780.0) AS BIGINT) + 1 END)) AS k
              FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) WHERE length(t) > 0))"""


def chunks(docs: DataFrame, size: int = 900, overlap: int = 120) -> DataFrame:
    return docs.select("doc_id", F.posexplode(text.chunk_text(F.col("text"), size, overlap)).alias("chunk_order", "chunk"))


@query("chunk_documents", f"SELECT doc_id, chunk_order, CAST(length(chunk) AS INTEGER) AS n_chars, md5(chunk) AS digest FROM {_CHUNKS_SQL}")
def chunk_documents(spark, sf):
    return chunks(_t(spark, sf, "documents")).select("doc_id", "chunk_order", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


@query("bm25_topk", bm25_sql("(SELECT doc_id AS id, text FROM documents)", _ASK_SQL, 10))
def bm25_topk(spark, sf):
    return _bm25(_t(spark, sf, "documents"), _ask(spark), 10)


@query("bm25_subset_restats", bm25_sql("(SELECT doc_id AS id, text FROM documents WHERE lang = 'en' AND source <> 'src0')", _ASK_SQL, 10))
def bm25_subset_restats(spark, sf):
    return _bm25(_t(spark, sf, "documents").where("lang = 'en' and source <> 'src0'"), _ask(spark), 10)


@query("bm25_batch_queries", bm25_sql("(SELECT doc_id AS id, text FROM documents)", "(SELECT item_id AS query_id, text FROM benchmark)", 5))
def bm25_batch_queries(spark, sf):
    q = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return _bm25(_t(spark, sf, "documents"), q, 5)


_DOT = "list_sum(list_transform(list_zip(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), lambda p: p[1] * p[2]))"
_DENSE_SQL = f"(SELECT q.vec_id AS query_id, v.vec_id AS id, CAST(v.label AS VARCHAR) AS space, {_DOT} AS score FROM embeddings v, embeddings q WHERE q.vec_id = 0)"


def _vector_zero(v: DataFrame) -> DataFrame:
    return v.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query("dense_topk", f"SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM {_DENSE_SQL} WHERE score > 0 QUALIFY rank <= 10")
def dense_topk(spark, sf):
    v = _t(spark, sf, "embeddings")
    return dense.search(v, _vector_zero(v), id_col="vec_id", vector_col="embedding").select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(
    "dense_topk_per_space",
    f"""WITH h AS (SELECT *, row_number() OVER (PARTITION BY space ORDER BY round(score, 9) DESC, id) AS r FROM {_DENSE_SQL} WHERE score > 0)
        SELECT query_id, id, space, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM h WHERE r <= 3 QUALIFY rank <= 12""",
)
def dense_topk_per_space(spark, sf):
    v = _t(spark, sf, "embeddings")
    return dense.search(v, _vector_zero(v), id_col="vec_id", vector_col="embedding", space_col="label", per_space=3, top_k=12).select("query_id", "id", "space", F.round("score", 6).alias("score"), "rank")


def _hash_sql(tokens: str, key: str) -> str:
    return f"""(SELECT {key}, bucket, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM
        (SELECT {key}, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 512 AS bucket, sum(CASE WHEN CAST(('0x' || substr(md5(term), 9, 2)) AS BIGINT) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS w
         FROM (SELECT {key}, unnest(tokens) AS term FROM {tokens}) GROUP BY ALL HAVING w <> 0))"""


@query(
    "hash_embed_topk",
    f"""WITH d AS {_hash_sql(tokens_sql('documents', 'doc_id'), 'doc_id')}, q AS {_hash_sql(tokens_sql(_ASK_SQL, 'query_id'), 'query_id')},
             s AS (SELECT query_id, doc_id AS id, sum(d.weight * q.weight) AS score FROM d JOIN q USING (bucket) GROUP BY ALL HAVING round(score, 9) > 0)
        SELECT query_id, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""",
)
def hash_embed_topk(spark, sf):
    out = dense.hash_search(_t(spark, sf, "documents"), _ask(spark), id_col="doc_id", text=F.col("text"), query_id="query_id", query_text=F.col("text"))
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _channels(spark, sf, k: int = 20) -> DataFrame:
    v = _t(spark, sf, "embeddings")
    b = lexical.search(_t(spark, sf, "documents"), _ask(spark), top_k=2 * k).select(F.lit("bm25").alias("channel"), F.col("id"), "score", "rank")
    d = dense.search(v, _vector_zero(v), id_col="vec_id", vector_col="embedding", top_k=2 * k).select(F.lit("dense").alias("channel"), F.col("id"), "score", "rank")
    return b.unionByName(d)


_CHANNELS_SQL = f"""b AS ({bm25_sql('(SELECT doc_id AS id, text FROM documents)', _ASK_SQL, 40)}),
             v AS (SELECT id, score, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS rank FROM {_DENSE_SQL} WHERE score > 0 QUALIFY rank <= 40),
             h AS (SELECT 'bm25' AS channel, id, score, rank FROM b UNION ALL SELECT 'dense', id, score, rank FROM v)"""


@query(
    "minmax_hybrid",
    f"""WITH {_CHANNELS_SQL},
             n AS (SELECT channel, id, (CASE WHEN channel = 'dense' THEN 0.40 ELSE 0.25 END) * (CASE WHEN max(score) OVER w = min(score) OVER w THEN CASE WHEN score > 0 THEN 1.0 ELSE 0.0 END ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END) AS part
                   FROM h WINDOW w AS (PARTITION BY channel)),
             t AS (SELECT id, sum(part) AS score, count(*) AS n_channels FROM n GROUP BY id)
        SELECT id, round(score, 4) AS score, n_channels FROM t ORDER BY round(score, 4) DESC, id LIMIT 20""",
)
def minmax_hybrid(spark, sf):
    h = _channels(spark, sf).withColumn("score", F.when(F.col("channel") == "bm25", F.round("score", 6)).otherwise(F.col("score")))
    return fusion.hybrid(h, top_k=80).select("id", F.round("score", 4).alias("score"), "n_channels").orderBy(F.col("score").desc(), "id").limit(20)


@query(
    "rrf_fusion",
    f"""WITH {_CHANNELS_SQL}, t AS (SELECT id, sum(1.0 / (60.0 + rank)) AS score, count(*) AS n_channels FROM h GROUP BY id)
        SELECT id, round(score, 8) AS score, n_channels, CAST(row_number() OVER (ORDER BY round(score, 12) DESC, id) AS INTEGER) AS rank FROM t QUALIFY rank <= 20""",
)
def rrf_fusion(spark, sf):
    return fusion.reciprocal_ranks(_channels(spark, sf)).select("id", F.round("score", 8).alias("score"), "n_channels", "rank")


@query(
    "candidate_pool",
    f"""WITH {_CHANNELS_SQL},
             f AS (SELECT id, sum(1.0 / (60.0 + rank)) AS rrf, min(CASE WHEN rank <= 3 THEN (CASE channel WHEN 'bm25' THEN 100 ELSE 200 END) + rank END) AS kept, max(CASE WHEN channel = 'dense' THEN 1 ELSE 0 END) AS is_detail FROM h GROUP BY id),
             l AS (SELECT *, CASE WHEN kept IS NOT NULL THEN 0 WHEN is_detail = 1 THEN 1 ELSE 2 END AS lane FROM f),
             m AS (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY round(rrf, 12) DESC, id) AS n FROM l),
             o AS (SELECT id, kept, rrf, CASE WHEN lane = 1 AND n > 5 THEN 2 ELSE lane END AS lane FROM m)
        SELECT id, CAST(lane AS INTEGER) AS lane, CAST(row_number() OVER (ORDER BY lane, kept NULLS LAST, round(rrf, 12) DESC, id) AS INTEGER) AS pool_pos FROM o QUALIFY pool_pos <= 16""",
)
def candidate_pool(spark, sf):
    return fusion.candidate_pool(_channels(spark, sf), ("bm25", "dense"), "dense").select("id", "lane", "pool_pos")


@query(
    "dedupe_hits",
    f"""WITH {_CHANNELS_SQL} SELECT id, round(max(score), 4) AS score, arg_max(channel, score) AS source FROM h GROUP BY id""",
)
def dedupe_hits(spark, sf):
    h = _channels(spark, sf).select("id", "score", F.col("channel").alias("source"), F.lit("").alias("text"))
    return fusion.dedupe_hits(h).select("id", F.round("score", 4).alias("score"), "source")


_ENTITIES = {"segment": ("customer", "c_mktsegment"), "priority": ("orders", "o_orderpriority"), "status": ("orders", "o_orderstatus")}
_ENTITY_SQL = """(SELECT o_custkey AS case_id, 'priority' AS entity_type, lower(o_orderpriority) AS entity_value FROM orders
        UNION SELECT o_custkey, 'status', lower(o_orderstatus) FROM orders UNION SELECT c_custkey, 'segment', lower(c_mktsegment) FROM customer)"""


def entity_index(spark, sf) -> DataFrame:
    """case_id, entity_type, entity_value of customers and their orders, distinct."""
    a = structured.entity_pairs(_t(spark, sf, "orders"), "o_custkey", {"priority": F.col("o_orderpriority"), "status": F.col("o_orderstatus")})
    return a.unionByName(structured.entity_pairs(_t(spark, sf, "customer"), "c_custkey", {"segment": F.col("c_mktsegment")}))


@query(
    "structured_and_or",
    f"""WITH e AS {_ENTITY_SQL}, c AS (SELECT c_custkey AS case_id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'),
             m AS (SELECT case_id, max(CASE WHEN entity_type = 'segment' AND entity_value LIKE '%auto%' THEN 1 ELSE 0 END) + max(CASE WHEN entity_type = 'priority' AND entity_value LIKE '%urgent%' THEN 1 ELSE 0 END) + max(CASE WHEN entity_type = 'status' AND entity_value LIKE '%p%' THEN 1 ELSE 0 END) AS m FROM e GROUP BY case_id)
        SELECT case_id, CASE WHEN m = 3 THEN 1.0::DOUBLE ELSE round(0.25 + 0.5 * ((m + 1) / 4.0::DOUBLE), 6) END AS score, CASE WHEN m = 3 THEN 'and' ELSE 'or' END AS mode, CAST(m + 1 AS BIGINT) AS matched, CAST(4 AS BIGINT) AS requested, round((m + 1) / 4.0::DOUBLE, 6) AS coverage
        FROM m SEMI JOIN c USING (case_id) WHERE m > 0 ORDER BY score DESC, matched DESC, case_id DESC LIMIT 50""",
)
def structured_and_or(spark, sf):
    c = _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_t(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("r_name = 'EUROPE'")
    return structured.search(c.select(F.col("c_custkey").alias("case_id")), entity_index(spark, sf), [("segment", "auto"), ("priority", "urgent"), ("status", "p")], hard=1)


@query("structured_unconstrained", "SELECT c_custkey AS case_id, 0.0::DOUBLE AS score, 'unconstrained' AS mode, CAST(0 AS BIGINT) AS matched, CAST(0 AS BIGINT) AS requested, 0.0::DOUBLE AS coverage FROM customer ORDER BY c_custkey DESC LIMIT 50")
def structured_unconstrained(spark, sf):
    return structured.search(_t(spark, sf, "customer").select(F.col("c_custkey").alias("case_id")), entity_index(spark, sf), [])


@query("entity_index_explode", f"SELECT case_id, entity_type, entity_value FROM {_ENTITY_SQL}")
def entity_index_explode(spark, sf):
    return entity_index(spark, sf)


@query("entity_like_match", "SELECT p_brand, count(*) AS n_parts FROM part WHERE lower(p_type) LIKE '%econ%' GROUP BY p_brand")
def entity_like_match(spark, sf):
    return structured.containing(_t(spark, sf, "part"), F.col("p_type"), " ECON").groupBy("p_brand").agg(F.count("*").alias("n_parts"))


@query("temporal_cutoff_search", "SELECT o_custkey, count(*) AS n_orders, max(o_orderdate) AS latest FROM orders WHERE o_orderdate IS NOT NULL AND o_orderdate <= TIMESTAMP '1995-06-30' AND o_orderpriority = '1-URGENT' GROUP BY o_custkey")
def temporal_cutoff_search(spark, sf):
    known = structured.known_by(_t(spark, sf, "orders"), "1995-06-30", date_col="o_orderdate", source_col="o_orderpriority", source="1-URGENT")
    return known.groupBy("o_custkey").agg(F.count("*").alias("n_orders"), F.max("o_orderdate").alias("latest"))


@query("fetch_in_rank_order", "SELECT doc_id, w.pos, source, n_chars FROM documents JOIN (SELECT unnest([7, 3, 900, 12, 55]) AS doc_id, unnest([0, 1, 2, 3, 4]) AS pos) w USING (doc_id) ORDER BY pos LIMIT 4")
def fetch_in_rank_order(spark, sf):
    wanted = spark.range(1).select(F.posexplode(F.array(*(F.lit(i).cast("long") for i in (7, 3, 900, 12, 55)))).alias("pos", "id"))
    return structured.in_requested_order(_t(spark, sf, "documents"), wanted, "doc_id", 4).select("doc_id", "pos", "source", "n_chars")


TERMS = ("the", "ing", "ther", "tion", "ently", "first")
_TERMS_SQL = "[" + ", ".join(f"'{t}'" for t in TERMS) + "]"
_DETAIL_SQL = f"""(SELECT doc_id, chunk_order, len(list_filter({_TERMS_SQL}, lambda t: contains(lower(chunk), t))) / 6.0::DOUBLE + (CASE WHEN progress THEN 0.30::DOUBLE ELSE 0 END) AS score,
        CASE WHEN early THEN 'early_response' WHEN toxic THEN 'toxicity_or_counter' ELSE 'target_outcome' END AS bucket
        FROM (SELECT *, regexp_matches(lower(chunk), 'early|initial|first|(^|[^a-z0-9_àâäçéèêëîïôöùûüñáíóúß])(cr|pr|orr|dcr)([^a-z0-9_àâäçéèêëîïôöùûüñáíóúß]|$)') AS early, regexp_matches(lower(chunk), 'resistan|progress|relapse|(^|[^a-z0-9_àâäçéèêëîïôöùûüñáíóúß])pd([^a-z0-9_àâäçéèêëîïôöùûüñáíóúß]|$)') AS progress,
              regexp_matches(lower(chunk), 'toxicit|adverse|(^|[^a-z0-9_àâäçéèêëîïôöùûüñáíóúß])ae([^a-z0-9_àâäçéèêëîïôöùûüñáíóúß]|$)') AS toxic FROM {_CHUNKS_SQL}))"""


def _details(spark, sf) -> DataFrame:
    score, bucket = twostage.detail_score(F.col("chunk"), F.array(*map(F.lit, TERMS)), F.array(F.lit("progression")))
    return chunks(_t(spark, sf, "documents")).select("doc_id", "chunk_order", score.alias("score"), bucket.alias("bucket"))


@query("bucketed_details", f"""WITH b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, bucket ORDER BY round(score, 9) DESC, chunk_order) AS r FROM {_DETAIL_SQL})
        SELECT doc_id, chunk_order, bucket, round(score, 6) AS score FROM b WHERE r = 1""")
def bucketed_details(spark, sf):
    return twostage.bucketed(_details(spark, sf), "doc_id", "chunk_order").select("doc_id", "chunk_order", "bucket", F.round("score", 6).alias("score"))


@query(
    "doc_first_then_siblings",
    f"""WITH s AS (SELECT *, printf('%010d#%06d', doc_id, chunk_order) AS chunk_id FROM {_DETAIL_SQL}),
             t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, chunk_id) AS sibling FROM s)
        SELECT chunk_id, CAST(sibling AS INTEGER) AS sibling, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY (sibling > 1), round(score, 9) DESC, chunk_id) AS INTEGER) AS rank FROM t QUALIFY rank <= 40""",
)
def doc_first_then_siblings(spark, sf):
    rows = _details(spark, sf).withColumn("chunk_id", F.format_string("%010d#%06d", "doc_id", "chunk_order"))
    return twostage.documents_first(rows, "doc_id", "chunk_id", 40).select("chunk_id", "sibling", F.round("score", 6).alias("score"), "rank")


_LEVEL_SQL = "CASE lang WHEN 'en' THEN 'clinical_trial_evidence' WHEN 'fr' THEN 'review_evidence' WHEN 'de' THEN 'case_report_evidence' ELSE 'other_literature_evidence' END"


def _level():
    return F.when(F.col("lang") == "en", "clinical_trial_evidence").when(F.col("lang") == "fr", "review_evidence").when(F.col("lang") == "de", "case_report_evidence").otherwise("other_literature_evidence")


_B = "[^A-Za-z0-9_\u00c0-\u024f]"


def _word_sql(words: str) -> str:
    return f"regexp_matches(text, '(?i)(^|{_B})({words})({_B}|$)')"


_SUPPORT_SQL = _word_sql("pr|cr|response|respond|benefit|effective|improved|improvement|improv")
_AGAINST_SQL = _word_sql("pd|progression|resistance|resistant|fail|failed|failure|contraindicat|toxicit|adverse|fatal|death")
_RISK_SQL = _word_sql(r"ddi|interaction|contraindicat|toxicit|adverse|grade\s*[3-5]|fatal|death")


@query(
    "evidence_layering",
    f"""WITH e AS (SELECT doc_id, {_LEVEL_SQL} AS evidence_level, {_SUPPORT_SQL} AS s, {_AGAINST_SQL} AS c, {_RISK_SQL} AS r FROM documents),
             n AS (SELECT *, row_number() OVER (PARTITION BY evidence_level ORDER BY doc_id) AS k FROM e)
        SELECT evidence_level, count(*) AS count, CAST(max(CASE evidence_level WHEN 'clinical_trial_evidence' THEN 4 WHEN 'review_evidence' THEN 2 ELSE 1 END) AS INTEGER) AS priority,
               array_to_string(list_sort(list(doc_id) FILTER (WHERE k <= 3)), ',') AS samples, CAST(sum(s::INT) AS BIGINT) AS supporting, CAST(sum(c::INT) AS BIGINT) AS contradicting, CAST(sum(r::INT) AS BIGINT) AS safety_risk
        FROM n GROUP BY evidence_level""",
)
def evidence_layering(spark, sf):
    out = evidence.layers(_t(spark, sf, "documents"), _level(), F.col("text"), "doc_id")
    return out.select("evidence_level", "count", "priority", F.array_join(F.transform("sample_ids", lambda x: x.cast("string")), ",").alias("samples"), "supporting", "contradicting", "safety_risk")


@query(
    "contradiction_verdict",
    f"""WITH c AS (SELECT source, CAST(sum({_SUPPORT_SQL}::INT) AS BIGINT) AS support, CAST(sum({_AGAINST_SQL}::INT) AS BIGINT) AS contradiction, CAST(sum({_RISK_SQL}::INT) AS BIGINT) AS risk, CAST(sum((lang = 'de')::INT) AS BIGINT) AS counter_hits FROM documents GROUP BY source)
        SELECT *, CASE WHEN support = 0 AND contradiction = 0 AND risk = 0 THEN 'insufficient_evidence' WHEN contradiction + risk > greatest(1, support) THEN 'needs_caution_due_to_contradiction_or_risk'
                       WHEN support = 0 AND (counter_hits > 0 OR contradiction > 0) THEN 'not_supported' ELSE 'supported_with_monitoring' END AS verdict FROM c""",
)
def contradiction_verdict(spark, sf):
    return evidence.verdicts(_t(spark, sf, "documents"), F.col("text"), F.col("lang") == "de", ("source",))


@query(
    "safety_gate_rules",
    f"""WITH e AS (SELECT source, count(*) AS n, max((lower({_LEVEL_SQL}) LIKE '%ddi%')::INT) AS ddi, max(({_word_sql('grade[ ]*[34]|fatal|death|life[- ]?threatening|qt[ ]*prolong|hepatotox|pneumonitis|interstitial|cardiotox')})::INT) AS severe,
                    min(({_LEVEL_SQL} IN ('case_report_evidence', 'structured_extraction_evidence'))::INT) AS only_low, max(({_word_sql('guideline|nccn|esmo|asco')})::INT) AS guideline FROM documents GROUP BY source),
             q AS (SELECT DISTINCT source, 'dose 80 mg and interaction of ' || source AS ask FROM documents),
             j AS (SELECT q.source, coalesce(n, 0) AS n, coalesce(ddi, 0) AS ddi, coalesce(severe, 0) AS severe, coalesce(only_low, 0) AS only_low, coalesce(guideline, 0) AS guideline FROM q LEFT JOIN e USING (source))
        SELECT source, CAST(n AS BIGINT) AS evidence_rows,
               concat_ws(',', CASE WHEN n < 3 THEN 'insufficient_evidence' END, 'dose_recommendation_risk', CASE WHEN ddi = 0 THEN 'missing_ddi_evidence' END, CASE WHEN severe > 0 THEN 'severe_toxicity_signal' END, CASE WHEN only_low = 1 AND guideline = 0 THEN 'low_evidence_hierarchy' END) AS issues,
               CASE WHEN severe > 0 THEN 'critical' ELSE 'high' END AS risk_level, true AS requires_review FROM j""",
)
def safety_gate_rules(spark, sf):
    d = _t(spark, sf, "documents")
    ask = d.select("source").distinct().withColumn("ask", F.concat(F.lit("dose 80 mg and interaction of "), F.col("source")))
    return evidence.safety(ask, d, key="source", query=F.col("ask"), text=F.col("text"), level=_level())


@query(
    "doc_type_ladder",
    f"""WITH p AS (SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS text FROM pages)
        SELECT page_id, CASE WHEN {_word_sql('randomi[sz]ed|phase[ ]*[i1-4v]+|clinical[ ]+trial|controlled[ ]+trial')} THEN 'clinical_trial' WHEN {_word_sql('systematic[ ]+review|meta[- ]analysis|literature[ ]+review|review')} THEN 'review'
               WHEN {_word_sql('cohort|retrospective|prospective|observational|real[- ]world|case[- ]control|cross[- ]sectional')} THEN 'cohort_or_observational_study' WHEN {_word_sql('case[ ]+report|case[ ]+presentation|a[ ]+case[ ]+of')} THEN 'case_report' ELSE 'other_literature' END AS document_type FROM p""",
)
def doc_type_ladder(spark, sf):
    p = _t(spark, sf, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"))
    return p.select("page_id", text.document_type(F.col("title")).alias("document_type"))


@query(
    "html_meta_date",
    """SELECT page_id, regexp_extract(html, '(?i)<html[^>]*[ ]lang=["'']([^"'']+)["'']', 1) AS lang, length(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title_chars,
              CASE page_id % 3 WHEN 0 THEN strftime(last_day(day), '%Y-%m-%d') WHEN 1 THEN strftime(day, '%Y-12-31') END AS published FROM (SELECT *, DATE '1970-01-01' + CAST(hash_day AS INTEGER) AS day FROM (SELECT *, length(html) * 7 % 20000 AS hash_day FROM pages))""",
)
def html_meta_date(spark, sf):
    p = _t(spark, sf, "pages").withColumn("html", F.coalesce("html", F.lit("")))
    day = F.date_add(F.lit("1970-01-01").cast("date"), (F.length("html") * 7 % 20000).cast("int"))  # a date of the page's own
    meta = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit('<META name="citation_publication_date" content="'), F.date_format(day, "yyyy/MM"), F.lit('">')))
    meta = meta.when(F.col("page_id") % 3 == 1, F.concat(F.lit("<meta content='"), F.date_format(day, "yyyy"), F.lit("' x name='citation_publication_date'/>"))).otherwise('<meta name="citation_publication_date" content="soon">')
    return p.select("page_id", F.regexp_extract("html", r"(?i)<html[^>]*[ ]lang=[\"']([^\"']+)[\"']", 1).alias("lang"), F.length(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).cast("long").alias("title_chars"), text.meta_publication_date(F.concat("html", meta)).alias("published"))


@query(
    "lineage_unresolved",
    """WITH r AS (SELECT l_orderkey AS claim, l_partkey AS ref FROM lineitem WHERE l_returnflag = 'R'), e AS (SELECT DISTINCT p_partkey FROM part WHERE p_size > 10)
        SELECT claim, count(*) AS refs, count(*) FILTER (WHERE p_partkey IS NULL) AS unresolved FROM r LEFT JOIN e ON ref = p_partkey GROUP BY claim""",
)
def lineage_unresolved(spark, sf):
    claims = _t(spark, sf, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("refs"))
    rows = evidence.lineage(claims, _t(spark, sf, "part").where("p_size > 10"), claim="l_orderkey", refs="refs", evidence_id="p_partkey")
    return rows.groupBy(F.col("l_orderkey").alias("claim")).agg(F.count("*").alias("refs"), F.sum((~F.col("resolved")).cast("long")).alias("unresolved"))


@query(
    "citation_validation",
    r"""WITH c AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(text, '[0-9]{3,}')) AS cited FROM conversations)
        SELECT conv_id, turn, CAST(len(cited) AS BIGINT) AS n_cited, CAST(len(list_filter(cited, lambda x: length(x) <> 3)) AS BIGINT) AS n_rejected FROM c""",
)
def citation_validation(spark, sf):
    allowed = F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.lpad(i.cast("string"), 3, "0"))
    c = _t(spark, sf, "conversations").select("conv_id", "turn", assembly.citations(F.col("text"), r"[0-9]{3,}", allowed).alias("c"))
    return c.select("conv_id", "turn", F.size("c.cited").cast("long").alias("n_cited"), F.size("c.rejected").cast("long").alias("n_rejected"))


_ROUTE_ASK = "(SELECT item_id * 2 AS query_id, text FROM benchmark UNION ALL SELECT item_id * 2 + 1, text || ' ing toxicity failed' FROM benchmark)"


@query(
    "route_batch",
    f"""WITH r AS ({bm25_sql("(SELECT doc_id AS id, text FROM documents)", _ROUTE_ASK, 10)}),
             h AS (SELECT query_id // 2 AS query_id, id, min(query_id % 2) AS counter FROM r GROUP BY ALL),
             c AS (SELECT query_id, CAST(sum({_SUPPORT_SQL}::INT) AS BIGINT) AS support, CAST(sum({_AGAINST_SQL}::INT) AS BIGINT) AS contradiction, CAST(sum({_RISK_SQL}::INT) AS BIGINT) AS risk, CAST(sum(counter) AS BIGINT) AS counter_hits FROM h JOIN documents ON doc_id = id GROUP BY query_id)
        SELECT *, CASE WHEN support = 0 AND contradiction = 0 AND risk = 0 THEN 'insufficient_evidence' WHEN contradiction + risk > greatest(1, support) THEN 'needs_caution_due_to_contradiction_or_risk'
                       WHEN support = 0 AND (counter_hits > 0 OR contradiction > 0) THEN 'not_supported' ELSE 'supported_with_monitoring' END AS verdict FROM c""",
)
def route_batch(spark, sf):
    q = _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return router.run(q, _t(spark, sf, "documents"), chunk_id="doc_id", hint=F.concat("text", F.lit(" ing toxicity failed")))[1]


@query("constraint_extraction", """SELECT conv_id, turn, CASE WHEN contains(lower(text), 'luad') THEN 'LUAD' WHEN contains(lower(text), 'nsclc') THEN 'NSCLC' WHEN contains(lower(text), 'sclc') THEN 'SCLC' END AS cancer_type, contains(lower(text), 'ddi') OR contains(lower(text), 'interaction') AS ddi FROM conversations""")
def constraint_extraction(spark, sf):
    c = _t(spark, sf, "conversations").select("conv_id", "turn", rules.constraints(F.col("text")).alias("c"))
    return c.select("conv_id", "turn", "c.cancer_type", (F.size("c.ddi_terms") > 0).alias("ddi"))


@query(
    "few_shot_examples",
    """WITH f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, list_filter(range(1, 9), lambda i: embedding[i] > 0.05) AS f FROM embeddings),
             s AS (SELECT a.vec_id AS case_id, b.vec_id AS ref_id, list_dot_product(a.v, b.v) + 0.02::DOUBLE * len(list_intersect(a.f, b.f)) AS score FROM f a JOIN f b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 100 = 0)
        SELECT case_id, ref_id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY case_id ORDER BY round(score, 9) DESC, ref_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 3""",
)
def few_shot_examples(spark, sf):
    """The three best examples of each vector whose id is a multiple of 100, among all others; features are its large components."""
    features = F.filter(F.sequence(F.lit(1), F.lit(8)), lambda i: F.get("embedding", i - 1) > 0.05).alias("features")
    e = _t(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"), features)
    found = router.nearest_examples(e.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "case_id"), e.withColumnRenamed("vec_id", "ref_id"), k=3)
    return found.select("case_id", "ref_id", F.round("score", 6).alias("score"), "rank")
