"""Evaluation, telemetry, batching and event queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import batching, dense, evidence, metrics, telemetry
from .registry import query


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: The second rater of the labelled documents: a rule on their length and language.
_RATED_SQL = """(SELECT l.doc_id, l.quality, l.toxic, d.lang, d.source, d.n_chars, quality = 1 AS truth, (n_chars > 900 OR lang = 'fr') AS guess, n_chars > 400 AS guess2,
        CASE WHEN n_chars > 4000 THEN 4 WHEN n_chars > 1500 THEN 3 WHEN n_chars > 600 THEN 2 ELSE 1 END AS level, CASE WHEN quality = 1 AND toxic = 0 THEN 4 WHEN quality = 1 THEN 3 WHEN toxic = 0 THEN 2 ELSE 1 END AS true_level
        FROM labels l JOIN documents d USING (doc_id))"""


def rated(spark, sf) -> DataFrame:
    r = _t(spark, sf, "labels").join(_t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    r = r.withColumn("truth", F.col("quality") == 1).withColumn("guess", (F.col("n_chars") > 900) | (F.col("lang") == "fr")).withColumn("guess2", F.col("n_chars") > 400)
    r = r.withColumn("level", F.when(F.col("n_chars") > 4000, 4).when(F.col("n_chars") > 1500, 3).when(F.col("n_chars") > 600, 2).otherwise(1))
    return r.withColumn("true_level", F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 4).when(F.col("quality") == 1, 3).when(F.col("toxic") == 0, 2).otherwise(1))


def _binary_sql(rows: str, keys: str = "", digits: int = 4) -> str:
    k = f"{keys}, " if keys else ""
    g = f"GROUP BY {keys}" if keys else ""
    z = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE ({a}) / CAST({b} AS DOUBLE) END"
    acc, pre, rec, spe = z("tp + tn", "n"), z("tp", "(tp + fp)"), z("tp", "(tp + fn)"), z("tn", "(tn + fp)")
    f1, f0 = z("2 * tp", "(2 * tp + fp + fn)"), z("2 * tn", "(2 * tn + fp + fn)")
    cols = {"accuracy": acc, "precision": pre, "recall": rec, "f1": f1, "specificity": spe, "balanced_accuracy": f"(({rec}) + ({spe})) / 2", "macro_f1": f"(({f1}) + ({f0})) / 2"}
    return f"""SELECT {k}n, tp, fp, fn, tn, {', '.join(f'round({v}, {digits}) AS {c}' for c, v in cols.items())} FROM (SELECT {k}count(*) AS n, count(*) FILTER (WHERE truth AND guess) AS tp,
        count(*) FILTER (WHERE NOT truth AND guess) AS fp, count(*) FILTER (WHERE truth AND NOT guess) AS fn, count(*) FILTER (WHERE NOT truth AND NOT guess) AS tn FROM {rows} {g})"""


@query("binary_metrics", _binary_sql(_RATED_SQL))
def binary_metrics(spark, sf):
    return metrics.binary(rated(spark, sf), F.col("truth"), F.col("guess"))


@query("ablation_by_arm", _binary_sql(_RATED_SQL, "lang"))
def ablation_by_arm(spark, sf):
    return metrics.binary(rated(spark, sf), F.col("truth"), F.col("guess"), ("lang",))


@query("weighted_kappa", f"""SELECT count(*) AS n, round(1 - avg(power(true_level - level, 2)) / (avg(true_level * true_level) + avg(level * level) - 2 * avg(true_level) * avg(level)), 4) AS kappa FROM {_RATED_SQL}""")
def weighted_kappa(spark, sf):
    return metrics.weighted_kappa(rated(spark, sf), F.col("true_level"), F.col("level"))


@query("per_class_accuracy", f"SELECT true_level AS level, count(*) AS n, round(avg((true_level = level)::INT), 4) AS accuracy FROM {_RATED_SQL} GROUP BY true_level")
def per_class_accuracy(spark, sf):
    return metrics.per_class(rated(spark, sf), F.col("true_level"), F.col("level"))


_RECIST = "CASE {0} WHEN 4 THEN 'CR' WHEN 3 THEN 'PR' WHEN 2 THEN 'SD' ELSE 'NA' END"


@query(
    "recist_metrics",
    f"""WITH r AS (SELECT true_level AS t, level AS g FROM {_RATED_SQL} WHERE true_level > 1 AND level > 1), i AS (SELECT 5 - t AS t, 5 - g AS g, (t >= 3) = (g >= 3) AS same FROM r)
        SELECT count(*) AS count, round(avg(same::INT), 4) AS orr_accuracy, round(1 - avg(power(t - g, 2)) / (avg(t * t) + avg(g * g) - 2 * avg(t) * avg(g)), 4) AS kappa FROM i""",
)
def recist_metrics(spark, sf):
    name = lambda c: F.when(F.col(c) == 4, "CR").when(F.col(c) == 3, "PR").when(F.col(c) == 2, "SD").otherwise("NA")
    r = rated(spark, sf).select(name("true_level").alias("t"), name("level").alias("g"))
    return metrics.recist(r, F.col("t"), F.col("g"))


@query("direction_accuracy", f"SELECT count(*) AS count, round(avg(((CASE WHEN lang LIKE '%e%' THEN 'up' ELSE lang END) = (CASE WHEN source LIKE '%1%' THEN 'up' ELSE source END))::INT), 4) AS accuracy FROM {_RATED_SQL} WHERE lang NOT IN ('NA', '')")
def direction_accuracy(spark, sf):
    r = rated(spark, sf).select("lang", F.when(F.col("source").contains("1"), "e").otherwise("s").alias("g"))
    return metrics.direction(r, F.col("lang"), F.col("g"), {"e": "up"})


@query("toxicity_metrics", f"""WITH g AS (SELECT CASE WHEN toxic = 1 THEN 4 ELSE quality END AS t, level AS p, lang <> 'es' AS rec FROM {_RATED_SQL})
        SELECT round(count(*) FILTER (WHERE rec AND t >= 3 AND p >= 3) / CAST(nullif(count(*) FILTER (WHERE rec AND t >= 3), 0) AS DOUBLE), 4) AS severe_recall, round(count(*) FILTER (WHERE rec AND t >= 3 AND p >= 3) / CAST(nullif(count(*) FILTER (WHERE rec AND p >= 3), 0) AS DOUBLE), 4) AS severe_precision,
               round(count(*) FILTER (WHERE (t > 0 OR p > 0) AND abs(t - p) <= 1) / CAST(nullif(count(*) FILTER (WHERE t > 0 OR p > 0), 0) AS DOUBLE), 4) AS grade_tolerance_accuracy, count(*) FILTER (WHERE rec AND t >= 3) AS severe_count FROM g""")
def toxicity_metrics(spark, sf):
    r = rated(spark, sf).withColumn("t", F.when(F.col("toxic") == 1, 4).otherwise(F.col("quality")))
    return metrics.toxicity(r, F.col("t"), F.col("level"), F.col("lang") != "es")


@query(
    "ece_brier",
    f"""WITH p AS (SELECT truth::INT AS y, CASE lang WHEN 'en' THEN 0.9 WHEN 'fr' THEN 0.3 ELSE 0.6 END::DOUBLE AS p FROM {_RATED_SQL}),
             b AS (SELECT CASE WHEN p >= 0.75 THEN 1 WHEN p >= 0.45 THEN 2 ELSE 3 END AS b, count(*) AS n, avg(y) AS acc, avg(p) AS conf, sum(power(p - y, 2)) AS sq FROM p GROUP BY 1)
        SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(acc - conf)) / sum(n), 4) AS ece, round(sum(sq) / sum(n), 4) AS brier FROM b""",
)
def ece_brier(spark, sf):
    p = metrics.confidence_probability(F.when(F.col("lang") == "en", "高").when(F.col("lang") == "fr", "低").otherwise("中"))
    return metrics.calibration(rated(spark, sf), F.col("truth").cast("int"), p)


@query("paired_delta", f"""SELECT source, count(*) AS n, count(*) FILTER (WHERE guess <> truth AND guess2 = truth) AS fixed, count(*) FILTER (WHERE guess = truth AND guess2 <> truth) AS harmed, count(*) FILTER (WHERE guess = truth AND guess2 = truth) AS both_right,
        count(*) FILTER (WHERE guess <> truth AND guess2 <> truth) AS both_wrong, fixed - harmed AS net, fixed + harmed AS flips FROM {_RATED_SQL} GROUP BY source""")
def paired_delta(spark, sf):
    return metrics.paired_delta(rated(spark, sf), F.col("guess") == F.col("truth"), F.col("guess2") == F.col("truth"), ("source",))


_RANKED_SQL = """(SELECT q.vec_id AS query_id, CASE WHEN q.label = v.label THEN 1.0 WHEN abs(q.label - v.label) = 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS gain,
        row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_sum(list_transform(list_zip(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), lambda p: p[1] * p[2])), 9) DESC, v.vec_id) AS rank
        FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0 AND v.vec_id <> q.vec_id AND len(q.embedding) = len(v.embedding) QUALIFY rank <= 20)"""


@query(
    "ndcg_mrr_recall",
    f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, rank) AS ideal FROM {_RANKED_SQL}),
             s AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN (power(2, gain) - 1) / log2(rank + 1) END) AS dcg, sum(CASE WHEN ideal <= 10 THEN (power(2, gain) - 1) / log2(ideal + 1) END) AS idcg,
                          coalesce(max(CASE WHEN gain >= 0.5 THEN 1.0 / rank END), 0) AS rr, count(*) FILTER (WHERE gain >= 0.5 AND rank <= 3) AS top, count(*) FILTER (WHERE gain >= 0.5) AS rel, max(CASE WHEN rank = 1 THEN gain END) AS top1 FROM g GROUP BY query_id)
        SELECT query_id, round(dcg, 6) AS dcg, round(idcg, 6) AS idcg, round(CASE WHEN idcg = 0 THEN 0 ELSE dcg / idcg END, 6) AS ndcg, round(rr, 6) AS rr, round(CASE WHEN rel = 0 THEN 0 ELSE top / CAST(rel AS DOUBLE) END, 6) AS recall3, top1 FROM s""",
)
def ndcg_mrr_recall(spark, sf):
    v = _t(spark, sf, "embeddings")
    q = v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    hits = dense.search(v, q, id_col="vec_id", vector_col="embedding", top_k=20, least=None, own=False)
    labelled = v.select(F.col("vec_id").alias("id"), "label")
    top = hits.select("query_id", "id", "rank").join(labelled, "id").join(labelled.toDF("query_id", "ql"), "query_id")
    gain = F.when(F.col("label") == F.col("ql"), 1.0).when(F.abs(F.col("label") - F.col("ql")) == 1, 0.5).otherwise(0.0)
    return metrics.ranking(top, gain)


@query("top_overlap_jaccard", """WITH r AS (SELECT user_id, list_distinct(list(event_type)) AS a FROM events WHERE value > 50 GROUP BY user_id), s AS (SELECT user_id, list_distinct(list(event_type)) AS b FROM events WHERE value <= 50 GROUP BY user_id)
        SELECT user_id, round(len(list_intersect(a, b)) / CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 6) AS jaccard FROM r JOIN s USING (user_id)""")
def top_overlap_jaccard(spark, sf):
    e = _t(spark, sf, "events")
    a = e.where("value > 50").groupBy("user_id").agg(F.collect_set("event_type").alias("a"))
    b = e.where("value <= 50").groupBy("user_id").agg(F.collect_set("event_type").alias("b"))
    return a.join(b, "user_id").select("user_id", metrics.overlap(F.col("a"), F.col("b")).alias("jaccard"))


@query("compliance_rate", """WITH r AS (SELECT o_custkey, (o_orderdate > TIMESTAMP '1997-01-01') AS bad FROM orders) SELECT o_custkey, CAST(sum(bad::INT) AS BIGINT) AS violations, sum(bad::INT) = 0 AS compliant FROM r GROUP BY o_custkey""")
def compliance_rate(spark, sf):
    o = _t(spark, sf, "orders").withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return metrics.compliance(o, "o_custkey", F.col("d"), F.lit("1997-01-01"))


@query("telemetry_distribution", """SELECT event_type, count(value) AS count, round(sum(value), 4) AS sum, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.9), 4) AS p90, round(quantile_cont(value, 0.95), 4) AS p95, round(min(value), 4) AS min, round(max(value), 4) AS max FROM events GROUP BY event_type""")
def telemetry_distribution(spark, sf):
    return telemetry.distribution(_t(spark, sf, "events"), F.col("value"), ("event_type",))


@query("component_shares", """WITH c AS (SELECT user_id % 10 AS run, event_type AS component, count(*) AS calls, sum(value) AS duration, sum(length(props)) AS tokens, count(*) FILTER (WHERE value > 90) AS errors FROM events GROUP BY ALL)
        SELECT run, component, calls, round(duration, 6) AS duration, CAST(tokens AS BIGINT) AS tokens, errors, round(duration / sum(duration) OVER (PARTITION BY run), 6) AS duration_share, round(tokens / sum(tokens) OVER (PARTITION BY run), 6) AS token_share, round(errors / CAST(calls AS DOUBLE), 6) AS error_rate FROM c""")
def component_shares(spark, sf):
    e = _t(spark, sf, "events").withColumn("run", F.col("user_id") % 10)
    return telemetry.component_shares(e, F.col("event_type"), F.col("value"), F.length("props"), F.col("value") > 90, ("run",))


@query("status_counts", "SELECT o_orderstatus, count(*) AS n, max(o_orderdate) AS latest FROM orders GROUP BY o_orderstatus")
def status_counts(spark, sf):
    return telemetry.status_counts(_t(spark, sf, "orders"), "o_orderstatus", "o_orderdate")


@query("recurring_flags", "SELECT l_returnflag, count(*) AS occurrences, count(DISTINCT l_suppkey) AS cases FROM lineitem GROUP BY l_returnflag HAVING count(DISTINCT l_suppkey) >= 2")
def recurring_flags(spark, sf):
    return telemetry.recurring(_t(spark, sf, "lineitem"), "l_returnflag", "l_suppkey")


@query("tier_gaps", "WITH s AS (SELECT source, round(avg(n_chars), 4) AS score FROM documents GROUP BY source) SELECT source, score, round(score - lead(score) OVER (ORDER BY score DESC, source), 6) AS gap FROM s")
def tier_gaps(spark, sf):
    return telemetry.tier_gaps(_t(spark, sf, "documents").groupBy("source").agg(F.round(F.avg("n_chars"), 4).alias("score")), "source", "score")


@query("round_robin_batches", """WITH r AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nth FROM conversations), p AS (SELECT *, row_number() OVER (ORDER BY nth, conv_id, turn) - 1 AS position FROM r)
        SELECT conv_id, turn, CAST(nth AS INTEGER) AS nth, position, CAST(floor(position / 25) AS BIGINT) AS batch FROM p""")
def round_robin_batches(spark, sf):
    r = batching.round_robin(_t(spark, sf, "conversations").select("conv_id", "turn"), "conv_id", ["turn"])
    return batching.batch_ids(r, ["nth", "conv_id", "turn"], 25, groups=8).select("conv_id", "turn", "nth", "position", "batch")


@query("one_per_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def one_per_group(spark, sf):
    return batching.first_per_group(_t(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("best_status_row", "SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'P' THEN 2 ELSE 3 END, o_orderdate DESC, o_orderkey) = 1")
def best_status_row(spark, sf):
    return batching.best_by_status(_t(spark, sf, "orders"), "o_custkey", F.col("o_orderstatus"), {"F": 1, "P": 2, "O": 3}, [F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query("event_dedupe_latest", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def event_dedupe_latest(spark, sf):
    return telemetry.latest_by(_t(spark, sf, "events"), "user_id", [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id", "event_type", "value")


@query("checkpoint_anti_join", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def checkpoint_anti_join(spark, sf):
    done = _t(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return batching.not_done(_t(spark, sf, "customer"), done, "c_custkey").select("c_custkey", "c_mktsegment")


@query("factorial_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def factorial_cube(spark, sf):
    return _t(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query("failure_attribution", """SELECT CASE WHEN toxic IS NULL THEN 'unknown' WHEN n_chars < 200 THEN 'db_missing_gold' WHEN lang = 'de' THEN 'retrieval_miss' WHEN lang = 'fr' THEN 'rerank_drop' WHEN quality = 0 THEN 'evidence_review_drop' ELSE 'not_a_retrieval_failure' END AS failure, count(*) AS n
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def failure_attribution(spark, sf):
    r = _t(spark, sf, "documents").join(_t(spark, sf, "labels"), "doc_id", "left")
    stages = [("retrieval_miss", F.col("lang") != "de"), ("rerank_drop", F.col("lang") != "fr"), ("evidence_review_drop", F.col("quality") != 0)]
    return r.groupBy(telemetry.failure_stage(stages, F.col("toxic").isNotNull(), F.col("n_chars") >= 200).alias("failure")).agg(F.count("*").alias("n"))


@query("claim_ledger", """WITH c AS (SELECT l_orderkey AS claim, count(*) FILTER (WHERE l_returnflag = 'N') AS direct, count(*) FILTER (WHERE l_returnflag = 'A') AS part, count(*) FILTER (WHERE l_returnflag = 'R') AS against FROM lineitem GROUP BY l_orderkey)
        SELECT claim, CASE WHEN direct > 0 THEN 'direct' WHEN part > 0 THEN 'partial' ELSE 'unsupported' END AS support_level, round((direct + part) / CAST(greatest(1, direct + part + against) AS DOUBLE), 3) AS confidence FROM c""")
def claim_ledger(spark, sf):
    of = lambda f: F.collect_set(F.when(F.col("l_returnflag") == f, F.col("l_linenumber")))
    n = lambda f: F.sum((F.col("l_returnflag") == f).cast("long"))
    c = _t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("claim")).agg(of("N").alias("direct"), of("A").alias("part"), (n("N") + n("A")).alias("s"), n("R").alias("c"))
    return c.select("claim", evidence.support_level(F.col("direct"), F.col("part"), F.array().cast("array<int>")).alias("support_level"), evidence.claim_confidence(F.col("s"), F.col("c")).alias("confidence"))


@query("benefit_levels", """SELECT lang, CASE WHEN lang = 'en' THEN '明显获益' WHEN lang = 'fr' THEN '有限获益或稳定' WHEN lang = 'de' THEN '无明显获益' ELSE '进展或有害' END AS level, count(*) AS n FROM documents GROUP BY lang""")
def benefit_levels(spark, sf):
    raw = F.when(F.col("lang") == "en", "显著获益（6月）").when(F.col("lang") == "fr", "病情稳定").when(F.col("lang") == "de", "").otherwise("疾病进展")
    return _t(spark, sf, "documents").groupBy("lang", labels.benefit_level(raw).alias("level")).agg(F.count("*").alias("n"))


@query("request_packing", """WITH d AS (SELECT source, doc_id, n_chars, row_number() OVER w - 1 AS k, sum(least(n_chars, 900)) OVER w AS used FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))
        SELECT source, doc_id, CAST(greatest(floor(k / 8), floor((used - 1) / 4500)) AS INTEGER) AS batch FROM d WHERE greatest(floor(k / 8), floor((used - 1) / 4500)) < 2""")
def request_packing(spark, sf):
    d = _t(spark, sf, "documents").select("source", "doc_id", "n_chars")
    return evidence.pack(d, ("source",), ["doc_id"], F.least(F.col("n_chars"), F.lit(900))).select("source", "doc_id", "batch")


@query("score_stability", """SELECT l_returnflag, count(l_quantity) AS n, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity) / avg(l_quantity), 6) AS cv, CASE WHEN stddev_samp(l_quantity) / avg(l_quantity) < 0.05 THEN 'stable' WHEN stddev_samp(l_quantity) / avg(l_quantity) < 0.15 THEN 'moderate' ELSE 'unstable' END AS verdict FROM lineitem GROUP BY l_returnflag""")
def score_stability(spark, sf):
    return metrics.stability(_t(spark, sf, "lineitem"), ("l_returnflag",), F.col("l_quantity"))


@query("ceiling_floor", "SELECT event_type, round(avg((value >= 95)::INT), 6) AS ceiling, round(avg((value <= 5)::INT), 6) AS floor FROM events GROUP BY event_type")
def ceiling_floor(spark, sf):
    return metrics.ceiling_floor(_t(spark, sf, "events"), ("event_type",), F.col("value"), 95.0, 5.0)


@query("workflow_metrics", """WITH t AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), s AS (SELECT user_id, string_agg(event_type || ':' || c, ',' ORDER BY event_type) AS tools FROM t GROUP BY user_id)
        SELECT e.user_id, count(*) AS calls, count(DISTINCT CASE WHEN value > 50 THEN event_id END) AS accepted, max(value) AS budget, any_value(tools) AS tools FROM events e JOIN s USING (user_id) GROUP BY e.user_id""")
def workflow_metrics(spark, sf):
    return telemetry.workflow(_t(spark, sf, "events"), "user_id", F.col("event_type"), F.when(F.col("value") > 50, F.col("event_id")), F.col("value"))


@query("na_mask", """SELECT doc_id, array_to_string(list_filter([CASE WHEN lang = 'en' THEN 'M4_csf' END, CASE WHEN source = 'src1' THEN 'M3_cns' END], lambda x: x IS NOT NULL), ',') AS skipped FROM documents""")
def na_mask(spark, sf):
    flags = F.create_map(F.lit("csf_trajectory"), F.col("lang") == "en", F.lit("cns_lm_recist"), F.col("source") == "src1")
    return _t(spark, sf, "documents").select("doc_id", F.array_join(metrics.skipped_dimensions(flags), ",").alias("skipped"))
