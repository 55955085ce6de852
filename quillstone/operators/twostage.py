"""Locate documents first, then their best details; documents before siblings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What makes a passage early, progressing, toxic or an outcome.
EARLY = r"(?U)早期|初始|首次|early|initial|first|\b(?:cr|pr|orr|dcr)\b|缓解|改善"
PROGRESSION = r"(?U)耐药|进展|复发|resistan|progress|relapse|\bpd\b"
TOXICITY = r"(?U)毒性|不良反应|toxicit|adverse|\bae\b"
OUTCOME = r"(?U)疗效|结局|随访|response|outcome|survival|\bpfs\b|\bos\b|症状"
TARGETS = {
    "early_response": r"(?U)早期|early|initial|首次|first assessment|症状改善|response|缓解|\b(?:cr|pr|orr|dcr)\b",
    "progression": PROGRESSION,
    "toxicity": r"(?U)毒性|不良反应|安全性|toxicit|adverse|\bae\b",
    "ddi": r"(?U)相互作用|合并用药|interaction|\bddi\b|cyp3a|抑制剂|诱导剂",
    "outcome": r"(?U)结局|生存|随访|outcome|survival|\bpfs\b|\bos\b|死亡|death",
}


def target_types(text: Column) -> Column:
    t = F.lower(text)
    found = F.filter(F.array(*(F.when(t.rlike(p), name) for name, p in TARGETS.items())), lambda x: x.isNotNull())
    return F.when(F.size(found) == 0, F.array(F.lit("target_outcome"))).otherwise(found)


def coverage(text: Column, terms: Column) -> Column:
    """Share of an array of terms that a text contains."""
    t = F.lower(text)
    return F.size(F.filter(terms, lambda x: t.contains(x))) / F.greatest(F.lit(1), F.size(terms))


def detail_score(text: Column, terms: Column, targets: Column) -> tuple[Column, Column]:
    """(score, bucket) of a passage against the query's terms and target types."""
    t = F.lower(text)
    early, progress, toxic, outcome = (t.rlike(p) for p in (EARLY, PROGRESSION, TOXICITY, OUTCOME))
    wants = lambda x: F.array_contains(targets, x)
    plus = lambda c, x: F.when(c, x).otherwise(0.0)
    score = coverage(text, terms) + plus(wants("early_response") & early, 0.35) + plus(wants("progression") & progress, 0.30) + plus(wants("toxicity") & toxic, 0.30) + plus(wants("outcome") & outcome, 0.20)
    score = score - plus(wants("early_response") & progress & ~early, 0.35)
    bucket = F.when(early, "early_response").when(toxic | (progress & ~wants("progression")), "toxicity_or_counter").otherwise("target_outcome")
    return score, bucket


def bucketed(rows: DataFrame, doc: str, chunk: str, per_document: int = 3) -> DataFrame:
    """Of rows with score and bucket the best of each bucket of a document, at most per_document of them."""
    order = [F.round("score", 9).desc(), F.col(chunk)]
    best = rows.withColumn("_b", F.row_number().over(Window.partitionBy(doc, "bucket").orderBy(*order))).where("_b = 1")
    return best.withColumn("_d", F.row_number().over(Window.partitionBy(doc).orderBy(*order))).where(F.col("_d") <= per_document).drop("_b", "_d")


def documents_first(rows: DataFrame, doc: str, chunk: str, top_k: int) -> DataFrame:
    """The best chunk of every document before any second one; adds `sibling` (1 for the first) and `rank`."""
    order = [F.round("score", 9).desc(), F.col(chunk)]
    s = rows.withColumn("sibling", F.row_number().over(Window.partitionBy(doc).orderBy(*order))).withColumn("_later", (F.col("sibling") > 1).cast("int"))
    best = s.orderBy("_later", *order).limit(top_k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy("_later", *order))).drop("_later")


def locate_then_detail(locators: DataFrame, chunks: DataFrame, query: str, terms: Column, *, doc: str = "doc_id", chunk: str = "chunk_id", documents: int = 30, per_document: int = 3, top_k: int = 12) -> DataFrame:
    """locators: doc, score, text of dense hits; chunks: doc, chunk, text. A document's score is 0.7 of its best hit and 0.3
    of its locators' coverage of the terms; a chunk's is 0.55 of that and 0.45 of its detail score."""
    place = locators.groupBy(doc).agg(F.max("score").alias("dense"), F.array_join(F.array_sort(F.collect_list(F.lower("text"))), " ").alias("found"))
    place = place.select(doc, (0.70 * F.col("dense") + 0.30 * coverage(F.col("found"), terms)).alias("locator"), "found").orderBy(F.round("locator", 9).desc(), doc).limit(documents)
    score, bucket = detail_score(F.col("text"), terms, F.array_distinct(F.concat(target_types(F.lit(query)), target_types(F.col("found")))))
    rows = chunks.join(place, doc).select(doc, chunk, "locator", score.alias("score"), bucket.alias("bucket"))
    rows = bucketed(rows, doc, chunk, per_document)
    return documents_first(rows.withColumn("score", 0.55 * F.col("locator") + 0.45 * F.col("score")), doc, chunk, top_k)
