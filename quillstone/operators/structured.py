"""Structured search: hard filters on profiles, then coverage of requested entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cancer_text(value: Column) -> Column:
    """Cancer type in comparable form: known Chinese names as latin ones, stages removed, words with single spaces."""
    t = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    for zh, en in (("非小细胞肺癌", " nsclc "), ("非小细胞癌", " nsclc "), ("肺腺癌", " lung adenocarcinoma "), ("肺鳞癌", " lung squamous "), ("小细胞肺癌", " sclc ")):
        t = F.replace(t, F.lit(zh), F.lit(en))
    t = F.regexp_replace(t, r"(?U)\b(?:stage|期|分期)\s*(?:i{1,3}|iv|[1-4])\b", " ")
    return F.array_join(F.regexp_extract_all(t, F.lit(r"[a-z0-9]+|[\x{4e00}-\x{9fff}]+"), F.lit(0)), " ")


def cancer_labels(text: Column) -> Column:
    """Labels of a normalised cancer text: organ, group, histology and the text itself."""
    arr = lambda *x: F.array(*map(F.lit, x))
    base = (
        F.when(text.contains("lung adenocarcinoma") | text.contains("luad"), arr("lung", "nsclc", "luad"))
        .when(text.contains("lung squamous") | text.contains("lusc"), arr("lung", "nsclc", "lusc"))
        .when(text.contains("nsclc") | text.contains("non small cell lung"), arr("lung", "nsclc"))
        .when(text.contains("sclc") | text.contains("small cell lung"), arr("lung", "sclc"))
        .when(text.contains("lung") | text.contains("肺癌"), arr("lung"))
        .otherwise(F.array().cast("array<string>"))
    )
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(base, F.array(text))))


def cancer_match(query: Column, stored: Column) -> Column:
    """How a stored cancer type fits the queried one; modes that are no match start with `no:`."""
    q, s = cancer_text(query), cancer_text(stored)
    ql, sl = cancer_labels(q), cancer_labels(s)
    histology = F.array(F.lit("luad"), F.lit("lusc"))
    qh, sh = F.array_intersect(ql, histology), F.array_intersect(sl, histology)
    return (
        F.when(q == "", "unconstrained").when(s == "", "no:missing").when(q == s, "normalized_exact")
        .when((F.length(q) >= 4) & (F.length(s) >= 4) & (s.contains(q) | q.contains(s)), "normalized_compatible")
        .when((F.size(qh) > 0) & (F.size(sh) > 0) & (F.sort_array(qh) != F.sort_array(sh)), "no:histology_conflict")
        .when(F.arrays_overlap(qh, sh), "canonical_exact")
        .when(F.array_contains(ql, "nsclc") & F.array_contains(sl, "nsclc"), "canonical_compatible")
        .when((F.size(F.array_except(ql, F.array(F.lit("lung"), q))) == 0) & F.array_contains(ql, "lung") & F.array_contains(sl, "lung"), "organ_compatible")
        .otherwise("no:different_cancer")
    )


def search(profiles: DataFrame, entities: DataFrame, requested: list[tuple[str, str]], *, case_col: str = "case_id", hard: int = 0, limit: int = 50) -> DataFrame:
    """case_id, score, mode, matched, requested, coverage.

    profiles: cases that pass the `hard` filters already; entities: case_id, entity_type, entity_value (lower case).
    Without requested entities every case scores 1 (`and`), or 0 (`unconstrained`) where nothing was asked at all."""
    cases = profiles.select(F.col(case_col).alias("case_id")).distinct()
    wanted = [(k, v.strip().lower()) for k, v in requested if v.strip()]
    if not wanted:
        n = F.lit(hard).cast("long")
        out = cases.select("case_id", F.lit(1.0 if hard else 0.0).alias("score"), F.lit("and" if hard else "unconstrained").alias("mode"), n.alias("matched"), n.alias("requested"), F.lit(1.0 if hard else 0.0).alias("coverage"))
        return out.orderBy(F.col("case_id").desc()).limit(limit)
    hit = [F.max(((F.col("entity_type") == k) & F.col("entity_value").contains(v)).cast("int")).alias(f"h{i}") for i, (k, v) in enumerate(dict.fromkeys(wanted))]
    types = sorted({k for k, _ in wanted})
    found = entities.where(F.col("entity_type").isin(*types)).groupBy("case_id").agg(*hit)
    m = sum((F.col(f"h{i}") for i in range(len(hit))), F.lit(0))
    total = hard + len(wanted)
    out = found.select("case_id", m.alias("m")).where("m > 0").join(cases, "case_id", "left_semi")
    coverage = (F.col("m") + hard) / F.lit(float(total))
    everything = F.col("m") == len(wanted)
    out = out.select("case_id", F.round(F.when(everything, 1.0).otherwise(0.25 + 0.5 * coverage), 6).alias("score"), F.when(everything, "and").otherwise("or").alias("mode"), (F.col("m") + hard).cast("long").alias("matched"), F.lit(total).cast("long").alias("requested"), F.round(coverage, 6).alias("coverage"))
    return out.orderBy(F.col("score").desc(), F.col("matched").desc(), F.col("case_id").desc()).limit(limit)


def entity_pairs(rows: DataFrame, case: str, entities: dict[str, Column]) -> DataFrame:
    """case_id, entity_type, entity_value (lower case), each pair once: what search() reads."""
    pairs = F.explode(F.array(*(F.struct(F.lit(k).alias("entity_type"), F.lower(v).alias("entity_value")) for k, v in entities.items())))
    return rows.select(F.col(case).alias("case_id"), pairs.alias("e")).select("case_id", "e.*").distinct()


def containing(rows: DataFrame, value: Column, needle: str) -> DataFrame:
    """Rows whose value contains the needle, regardless of case."""
    return rows.where(F.lower(value).contains(needle.strip().lower()))


def known_by(docs: DataFrame, cutoff: str | None, *, date_col: str = "date", source_col: str | None = None, source: str = "citation_publication_date", mode: str = "cutoff") -> DataFrame:
    """Rows proven to be published by the cutoff; undated ones and those dated otherwise than by their metadata are not."""
    if mode not in ("off", "cutoff"):
        raise ValueError(f"unknown temporal mode {mode!r}")
    if mode == "off":
        return docs
    if not cutoff:
        raise ValueError("a cutoff is needed in cutoff mode")
    keep = F.col(date_col).isNotNull() & (F.col(date_col).cast("string") != "") & (F.col(date_col) <= F.lit(cutoff))
    return docs.where(keep & (F.col(source_col) == source) if source_col else keep)


def in_requested_order(rows: DataFrame, wanted: DataFrame, id_col: str, limit: int) -> DataFrame:
    """Rows of the ids asked for, in the order asked; wanted: id, pos. Ids that are not there leave no gap."""
    return rows.join(wanted.withColumnRenamed("id", id_col), id_col).orderBy("pos").limit(limit)
