"""Evidence layering, verdicts, safety rules and claim lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import labels


def layers(rows: DataFrame, level: Column, text: Column, id_col: str, keys: tuple[str, ...] = (), samples: int = 3) -> DataFrame:
    """keys, evidence_level, count, priority, sample ids (first by id), support, contradiction and risk counts.

    Samples are limited before they are collected, so a level of any size costs `samples` ids."""
    s = labels.signals(text)
    t = rows.select(*keys, F.coalesce(level, F.lit("case_report_evidence")).alias("evidence_level"), F.col(id_col).alias("_id"), *(c.alias(n) for n, c in s.items()))
    t = t.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "evidence_level").orderBy("_id")))
    total = lambda n: F.sum(F.col(n).cast("long")).alias(n.removeprefix("is_"))
    return t.groupBy(*keys, "evidence_level").agg(F.count("*").alias("count"), F.array_sort(F.collect_list(F.when(F.col("_n") <= samples, F.col("_id")))).alias("sample_ids"), *map(total, s)).withColumn("priority", labels.priority(F.col("evidence_level")))


def verdicts(rows: DataFrame, text: Column, counter: Column, keys: tuple[str, ...]) -> DataFrame:
    """keys, counts of signals, and the verdict; counter: the row came from the search for counter evidence."""
    s = labels.signals(text)
    c = rows.groupBy(*keys).agg(F.sum(s["is_supporting"].cast("long")).alias("support"), F.sum(s["is_contradicting"].cast("long")).alias("contradiction"), F.sum(s["is_safety_risk"].cast("long")).alias("risk"), F.sum(counter.cast("long")).alias("counter_hits"))
    return c.withColumn("verdict", labels.verdict(F.col("support"), F.col("contradiction"), F.col("risk"), F.col("counter_hits")))


def safety(queries: DataFrame, evidence: DataFrame, *, key: str, query: Column, text: Column, level: Column, ddi_terms: Column | None = None) -> DataFrame:
    """key, issue codes, risk_level, requires_review. queries: one row a key; evidence: its rows."""
    low = F.coalesce(level, F.lit("")).isin("case_report_evidence", "structured_extraction_evidence")
    e = evidence.groupBy(key).agg(F.count("*").alias("n"), F.sum((F.lower(level).contains("ddi")).cast("long")).alias("ddi"), F.sum(text.rlike(labels.SEVERE_TOXICITY).cast("long")).alias("severe"), F.min(low.cast("int")).alias("only_low"), F.max(text.rlike(labels.GUIDELINE).cast("int")).alias("guideline"))
    q = queries.join(e, key, "left")
    n = F.coalesce("n", F.lit(0))
    wants_ddi = query.rlike(labels.DDI) if ddi_terms is None else (F.size(ddi_terms) > 0) | query.rlike(labels.DDI)
    conditions = [
        (n < 3, "high", "insufficient_evidence"),
        (query.rlike(labels.DOSE), "high", "dose_recommendation_risk"),
        (wants_ddi & (F.coalesce("ddi", F.lit(0)) == 0), "high", "missing_ddi_evidence"),
        (F.coalesce("severe", F.lit(0)) > 0, "critical", "severe_toxicity_signal"),
        ((F.coalesce("only_low", F.lit(0)) == 1) & (F.coalesce("guideline", F.lit(0)) == 0) & ~query.rlike(labels.GUIDELINE), "medium", "low_evidence_hierarchy"),
    ]
    codes = F.filter(F.array(*(F.when(c, code) for c, _, code in conditions)), lambda x: x.isNotNull())
    risk = labels.max_severity(*((c, s) for c, s, _ in conditions))
    return q.select(key, n.alias("evidence_rows"), F.array_join(codes, ",").alias("issues"), risk.alias("risk_level"), risk.isin("high", "critical").alias("requires_review"))


def lineage(claims: DataFrame, evidence: DataFrame, *, claim: str, refs: str, evidence_id: str) -> DataFrame:
    """claim, ref, resolved: each reference of a claim (array `refs`) and whether the evidence has it."""
    r = claims.select(claim, F.explode(refs).alias("ref"))
    e = evidence.select(F.col(evidence_id).alias("ref"), F.lit(True).alias("resolved")).distinct()
    return r.join(e, "ref", "left").select(claim, "ref", F.coalesce("resolved", F.lit(False)).alias("resolved"))


def support_level(direct: Column, partial: Column, analog: Column) -> Column:
    return F.when(F.size(direct) > 0, "direct").when(F.size(partial) > 0, "partial").when(F.size(analog) > 0, "analog").otherwise("unsupported")


def claim_confidence(supporting: Column, contradicting: Column) -> Column:
    return F.round(supporting / F.greatest(F.lit(1), supporting + contradicting), 3)


def enters_context(status: Column, role: Column, level: Column, ids: Column) -> Column:
    """Whether a claim may be answered from: not rejected, relevant, with evidence of its support level."""
    bad = F.lower(F.trim(F.coalesce(status, F.lit("")))).isin("rejected_by_safety_gate", "irrelevant", "rejected", "discarded") | F.lower(F.trim(F.coalesce(role, F.lit("")))).isin("irrelevant", "insufficient")
    return ~bad & (F.size(ids) > 0) & F.lower(F.trim(F.coalesce(level, F.lit("")))).isin("direct", "partial", "analog")


def gated_context(direct: Column, analog: Column) -> Column:
    """At most four analogous items beside direct ones, at most two without any."""
    return F.when(F.size(direct) > 0, F.slice(analog, 1, 4)).otherwise(F.slice(analog, 1, 2))


def information_gain(new: Column, counter: Column, risk: Column, accepted: Column) -> Column:
    return F.round(F.least(F.lit(1.0), (new + counter + risk) / (accepted + 1)), 3)


def rerank_score(dimensions: dict[str, Column], weights: dict[str, float], caps: list[tuple[Column, float]]) -> Column:
    """Weighted dimensions (0 to 3 each) on 0 to 1, held below the least cap whose condition applies."""
    score = sum((w * dimensions[k] / 3 for k, w in weights.items()), F.lit(0.0))
    return F.least(score, F.lit(1.0), *(F.when(c, cap).otherwise(1.0) for c, cap in caps))


def pack(rows: DataFrame, keys: tuple[str, ...], order: list[Column | str], size: Column, budget: int = 4500, per_batch: int = 8, batches: int = 2) -> DataFrame:
    """Adds `batch`: rows in order, at most per_batch and `budget` characters (by running sums) in each, `batches` in all."""
    w = Window.partitionBy(*keys).orderBy(*order)
    n = F.row_number().over(w) - 1
    used = F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("batch", F.greatest(F.floor(n / per_batch), F.floor((used - 1) / budget)).cast("int")).where(F.col("batch") < batches)
