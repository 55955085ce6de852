"""Evaluation metrics in closed form: each is one pass of conditional sums, or a small confusion table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.nullif(b, F.lit(0)))


def ratio_or_null(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def _sum(c: Column) -> Column:
    return F.coalesce(F.sum(c.cast("long")), F.lit(0))


def binary(rows: DataFrame, truth: Column, guess: Column, keys: tuple[str, ...] = (), digits: int = 4) -> DataFrame:
    """n, tp, fp, fn, tn, accuracy, precision, recall, f1, specificity, balanced_accuracy, macro_f1 of boolean columns."""
    c = rows.groupBy(*keys).agg(F.count("*").alias("n"), _sum(truth & guess).alias("tp"), _sum(~truth & guess).alias("fp"), _sum(truth & ~guess).alias("fn"), _sum(~truth & ~guess).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    r = {"accuracy": ratio(tp + tn, F.col("n")), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "specificity": ratio(tn, tn + fp)}
    r["balanced_accuracy"] = (r["recall"] + r["specificity"]) / 2
    r["macro_f1"] = (r["f1"] + ratio(2 * tn, 2 * tn + fp + fn)) / 2
    return c.select(*keys, "n", "tp", "fp", "fn", "tn", *(F.round(v, digits).alias(k) for k, v in r.items()))


def weighted_kappa(rows: DataFrame, truth: Column, guess: Column, keys: tuple[str, ...] = (), digits: int = 4) -> DataFrame:
    """Quadratic weighted kappa of level numbers; 1 where all rows agree on a single level.

    Both sums over the confusion table have a closed form in moments, so one aggregate is enough:
    sum w O = E[(t - g)^2] and sum w E = E[t^2] + E[g^2] - 2 E[t] E[g], both over the square of the range of levels."""
    t, g = truth.cast("double"), guess.cast("double")
    m = rows.select(*keys, t.alias("t"), g.alias("g")).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.pow(F.col("t") - F.col("g"), 2)).alias("o"), F.avg(F.col("t") * F.col("t")).alias("tt"), F.avg(F.col("g") * F.col("g")).alias("gg"), F.avg("t").alias("mt"), F.avg("g").alias("mg"))
    expected = F.col("tt") + F.col("gg") - 2 * F.col("mt") * F.col("mg")
    return m.select(*keys, "n", F.round(F.when((F.col("o") == 0) & (F.abs(expected) < 1e-12), 1.0).otherwise(1 - F.col("o") / F.nullif(expected, F.lit(0.0))), digits).alias("kappa"))


def per_class(rows: DataFrame, truth: Column, guess: Column, digits: int = 4) -> DataFrame:
    """level, n, accuracy for each level of the truth."""
    return rows.groupBy(truth.alias("level")).agg(F.count("*").alias("n"), F.round(F.avg((truth == guess).cast("double")), digits).alias("accuracy"))


def recist(rows: DataFrame, truth: Column, guess: Column, digits: int = 4) -> DataFrame:
    """count, orr_accuracy, kappa of RECIST labels; rows with NA on either side do not count."""
    order = F.array(*map(F.lit, ("CR", "PR", "SD", "PD", "NA")))
    valid = rows.where((truth != "NA") & (guess != "NA")).select(truth.alias("t"), guess.alias("g"))
    place = lambda c: F.when(F.array_position(order, c) == 0, F.raise_error(F.concat(F.lit("unknown RECIST label: "), c)).cast("long")).otherwise(F.array_position(order, c))
    orr = lambda c: c.isin("CR", "PR")
    k = weighted_kappa(valid, place(F.col("t")), place(F.col("g")), digits=digits)
    o = valid.agg(F.count("*").alias("count"), F.round(F.avg((orr(F.col("t")) == orr(F.col("g"))).cast("double")), digits).alias("orr_accuracy"))
    return o.crossJoin(k.select("kappa"))  # one row each


def direction(rows: DataFrame, truth: Column, guess: Column, mapping: dict[str, str], digits: int = 4) -> DataFrame:
    """count, accuracy of labels mapped by the first key that they contain; truths that are not assessed do not count."""

    def mapped(c: Column) -> Column:
        out = None
        for k, v in mapping.items():
            out = F.when(c.contains(k), v) if out is None else out.when(c.contains(k), v)
        return c if out is None else out.otherwise(c)

    m = rows.select(mapped(truth).alias("t"), mapped(guess).alias("g")).where(~F.col("t").isin("NA", "未评估", ""))
    return m.agg(F.count("*").alias("count"), F.round(F.avg((F.col("t") == F.col("g")).cast("double")), digits).alias("accuracy"))


def toxicity(rows: DataFrame, truth: Column, guess: Column, recorded: Column | None = None, digits: int = 4) -> DataFrame:
    """Recall and precision of grades 3 and up (recorded cases only), and the share of grades at most one apart."""
    rec = F.coalesce(recorded, F.lit(True)) if recorded is not None else F.lit(True)
    t, g = F.coalesce(truth.cast("int"), F.lit(0)), F.coalesce(guess.cast("int"), F.lit(0))
    m = rows.agg(_sum(rec & (t >= 3) & (g >= 3)).alias("tp"), _sum(rec & (t >= 3) & (g < 3)).alias("fn"), _sum(rec & (t < 3) & (g >= 3)).alias("fp"), _sum(((t > 0) | (g > 0)) & (F.abs(t - g) <= 1)).alias("near"), _sum((t > 0) | (g > 0)).alias("graded"))
    return m.select(F.round(ratio_or_null(F.col("tp"), F.col("tp") + F.col("fn")), digits).alias("severe_recall"), F.round(ratio_or_null(F.col("tp"), F.col("tp") + F.col("fp")), digits).alias("severe_precision"), F.round(ratio_or_null(F.col("near"), F.col("graded")), digits).alias("grade_tolerance_accuracy"), (F.col("tp") + F.col("fn")).alias("severe_count"))


def calibration(rows: DataFrame, truth: Column, probability: Column, digits: int = 4) -> DataFrame:
    """n, ece, brier. The probability is that of the positive outcome; three fixed bins."""
    b = F.when(probability >= 0.75, "high").when(probability >= 0.45, "mid").otherwise("low")
    t = rows.select(truth.cast("double").alias("y"), probability.alias("p"), b.alias("b"))
    bins = t.groupBy("b").agg(F.count("*").alias("n"), F.avg("y").alias("acc"), F.avg("p").alias("conf"), F.sum(F.pow(F.col("p") - F.col("y"), 2)).alias("sq"))
    return bins.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n"), digits).alias("ece"), F.round(F.sum("sq") / F.sum("n"), digits).alias("brier"))


def confidence_probability(label: Column) -> Column:
    return F.when(label == "高", 0.9).when(label == "低", 0.3).otherwise(0.6)


def composite(f1: Column, kappa: Column, recist_kappas: list[Column], directions: list[Column], severe_recall: Column, ece: Column, compliance: Column, auxiliary: list[Column], digits: int = 4) -> Column:
    """Weighted total of the metrics. An ece of exactly 0 counts like a missing one."""
    z = lambda c: F.coalesce(c, F.lit(0.0))

    def mean(cs: list[Column]) -> Column:
        n = sum((c.isNotNull().cast("int") for c in cs), F.lit(0))
        return ratio(sum((z(c) for c in cs), F.lit(0.0)), n)

    primary = 0.30 * z(f1) + 0.20 * F.greatest(z(kappa), F.lit(0.0)) + 0.15 * mean(recist_kappas) + 0.10 * mean(directions) + 0.10 * z(severe_recall)
    primary = primary + 0.10 * F.greatest(1 - F.when(z(ece) == 0, 1.0).otherwise(ece), F.lit(0.0)) + 0.05 * z(compliance)
    aux = sum((w * z(a) / 5 for w, a in zip((0.30, 0.30, 0.25, 0.15), auxiliary, strict=True)), F.lit(0.0))
    return F.struct(F.round(primary, digits).alias("primary_score"), F.round(aux, digits).alias("auxiliary_score"), F.round(0.70 * primary + 0.30 * aux, digits).alias("composite_score"))


def paired_delta(rows: DataFrame, before: Column, after: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Correctness of two arms on the same cases: fixed, harmed, net, both_right, both_wrong, flips."""
    m = rows.groupBy(*keys).agg(F.count("*").alias("n"), _sum(~before & after).alias("fixed"), _sum(before & ~after).alias("harmed"), _sum(before & after).alias("both_right"), _sum(~before & ~after).alias("both_wrong"))
    return m.withColumn("net", F.col("fixed") - F.col("harmed")).withColumn("flips", F.col("fixed") + F.col("harmed"))


def ranking(hits: DataFrame, gains: Column, keys: tuple[str, ...] = ("query_id",), k: int = 10, digits: int = 6) -> DataFrame:
    """Per query dcg, idcg, ndcg (gain 2^s - 1), reciprocal rank of the first hit of gain 0.5 or more, recall at 3. hits: keys, rank."""
    w = Window.partitionBy(*keys).orderBy(gains.desc(), "rank")
    g = hits.withColumn("_g", gains.cast("double")).withColumn("_ideal", F.row_number().over(w))
    value = lambda place: (F.pow(F.lit(2.0), F.col("_g")) - 1) / F.log2(F.col(place) + F.lit(1.0))
    out = g.groupBy(*keys).agg(
        F.sum(F.when(F.col("rank") <= k, value("rank"))).alias("dcg"), F.sum(F.when(F.col("_ideal") <= k, value("_ideal"))).alias("idcg"),
        F.coalesce(F.max(F.when(F.col("_g") >= 0.5, 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"),
        ratio(F.sum(((F.col("_g") >= 0.5) & (F.col("rank") <= 3)).cast("long")), F.sum((F.col("_g") >= 0.5).cast("long"))).alias("recall3"), F.max(F.when(F.col("rank") == 1, F.col("_g"))).alias("top1"),
    )
    return out.select(*keys, F.round("dcg", digits).alias("dcg"), F.round("idcg", digits).alias("idcg"), F.round(ratio(F.col("dcg"), F.col("idcg")), digits).alias("ndcg"), F.round("rr", digits).alias("rr"), F.round("recall3", digits).alias("recall3"), F.col("top1").alias("top1"))


def overlap(a: Column, b: Column, digits: int = 6) -> Column:
    """Jaccard similarity of two arrays as sets; 0 where both are empty."""
    return F.round(ratio(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), digits)


def compliance(refs: DataFrame, key: str, date: Column, cutoff: Column) -> DataFrame:
    """key, compliant, violations: references after the cutoff, without a parseable date, or without any, violate."""
    parsed = F.try_to_date(F.coalesce(date, F.lit("9999-12-31")), "yyyy-MM-dd")
    bad = F.coalesce(parsed > F.try_to_date(cutoff, "yyyy-MM-dd"), F.lit(True))
    return refs.groupBy(key).agg(_sum(bad).alias("violations")).withColumn("compliant", F.col("violations") == 0)


def bootstrap(rows: DataFrame, columns: list[str], metric: Callable[[pd.DataFrame], float], n: int = 1000, alpha: float = 0.05, seed: int = 42, digits: int = 4) -> DataFrame:
    """mean, ci_lower, ci_upper, std, n of a metric over resamples with NumPy's generator; failing resamples are left out.

    For evaluation tables (rows of cases): the resamples of one seed form one sequence, so one task draws them all."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        np.random.seed(seed)
        values = []
        for _ in range(n):
            at = np.random.choice(len(pdf), size=len(pdf), replace=True)
            try:
                values.append(metric(pdf.iloc[at]))
            except (ValueError, ZeroDivisionError, KeyError):
                continue
        if not values:
            return pd.DataFrame([(None, None, None, None, 0)], columns=["mean", "ci_lower", "ci_upper", "std", "n"])
        v = np.array(values)
        return pd.DataFrame([(round(float(v.mean()), digits), round(float(np.percentile(v, 100 * alpha / 2)), digits), round(float(np.percentile(v, 100 * (1 - alpha / 2))), digits), round(float(v.std()), digits), len(v))], columns=["mean", "ci_lower", "ci_upper", "std", "n"])

    return rows.select(*columns, F.lit(0).alias("_all")).groupBy("_all").applyInPandas(lambda pdf: run(pdf.sort_values(columns, kind="stable").reset_index(drop=True)), "mean double, ci_lower double, ci_upper double, std double, n long")


def skipped_dimensions(flags: Column) -> Column:
    """Metrics that a case's na_flags (map of names to booleans) leave out."""
    names = {"csf_trajectory": "M4_csf", "cns_lm_recist": "M3_cns", "body_lesion_recist": "M3_body", "symptom_trajectory": "M4_symptom"}
    return F.filter(F.array(*(F.when(F.coalesce(F.element_at(flags, k), F.lit(False)), v) for k, v in names.items())), lambda x: x.isNotNull())


def stability(scores: DataFrame, keys: tuple[str, ...], score: Column, digits: int = 6) -> DataFrame:
    """keys, n, mean, cv (sample deviation over mean), verdict: stable below 0.05, moderate below 0.15."""
    g = scores.groupBy(*keys).agg(F.count(score).alias("n"), F.avg(score).alias("m"), F.stddev_samp(score).alias("sd"))
    cv = F.col("sd") / F.nullif(F.col("m"), F.lit(0.0))
    return g.select(*keys, "n", F.round("m", digits).alias("mean"), F.round(cv, digits).alias("cv"), F.when(cv < 0.05, "stable").when(cv < 0.15, "moderate").otherwise("unstable").alias("verdict"))


def ceiling_floor(scores: DataFrame, keys: tuple[str, ...], score: Column, high: float = 0.95, low: float = 0.05, digits: int = 6) -> DataFrame:
    """keys, shares of scores at the ceiling and at the floor."""
    share = lambda c: F.round(F.avg(c.cast("double")), digits)
    return scores.groupBy(*keys).agg(share(score >= high).alias("ceiling"), share(score <= low).alias("floor"))


def random_baseline(rows: DataFrame, truth: str, n: int = 200, seed: int = 42) -> DataFrame:
    """mean accuracy of truths against shuffles of themselves; for evaluation tables (one task, NumPy's generator)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng(seed)
        y = np.sort(pdf[truth].to_numpy())
        return pd.DataFrame({"accuracy": [round(float(np.mean([(y == rng.permutation(y)).mean() for _ in range(n)])), 4)]})

    return rows.select(truth, F.lit(0).alias("_all")).groupBy("_all").applyInPandas(run, "accuracy double")
