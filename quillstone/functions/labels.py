"""Labels of predictions and evidence as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ordered outcome levels and RECIST levels.
BENEFIT_LEVELS = ("明显获益", "有限获益或稳定", "无明显获益", "进展或有害")
RECIST_LEVELS = ("CR", "PR", "SD", "PD", "NA")

#: Priority of evidence levels, and patterns of signals.
EVIDENCE_PRIORITY = {
    "guideline_evidence": 5, "clinical_trial_evidence": 4, "cohort_or_observational_evidence": 3, "drug_label_or_ddi_rule_evidence": 3, "review_evidence": 2,
    "structured_extraction_evidence": 2, "case_report_evidence": 1, "other_literature_evidence": 1, "model_prior_knowledge": 0,
}
SUPPORTING = (r"(?iU)\b(pr|cr|response|respond|benefit|effective|improv(ed|ement)?)\b", "缓解|获益|有效|改善|病情稳定|控制")
CONTRADICTING = (r"(?iU)\b(pd|progression|resistance|resistant|fail(ed|ure)?|contraindicat|toxicit|adverse|fatal|death)\b", "进展|耐药|无效|失败|禁忌|毒性|不良反应|致死|死亡|风险")
RISK = (r"(?iU)\b(ddi|interaction|contraindicat|toxicit|adverse|grade\s*[3-5]|fatal|death)\b", "相互作用|禁忌|毒性|不良反应|严重|死亡|风险|警示")
DOSE = r"(?iU)\b(\d+(?:\.\d+)?\s*(?:mg|g|ml|mcg|μg|ug|qd|bid|tid|q\d+h))\b"
SEVERE_TOXICITY = r"(?iU)\b(grade\s*[34]|fatal|death|life[-\s]?threatening|qt\s*prolong|hepatotox|pneumonitis|interstitial|cardiotox)\b"
DDI = r"(?iU)\b(ddi|drug interaction|interaction|cyp3a4|cyp2d6|p-gp|bcrp|禁忌|相互作用)\b"
GUIDELINE = r"(?iU)\b(guideline|nccn|esmo|asco|说明书|药品标签)\b"


def benefit_level(label: Column) -> Column:
    """A free label as one of the four levels: exact, then by what it contains, in this order."""
    t = F.trim(label)
    has = lambda *xs: F.greatest(*(t.contains(x).cast("int") for x in xs)) > 0 if len(xs) > 1 else t.contains(xs[0])
    return (
        F.when(F.coalesce(label, F.lit("")) == "", BENEFIT_LEVELS[2]).when(t.isin(*BENEFIT_LEVELS), t)
        .when(has("明显获益", "显著获益") | (t == "获益"), BENEFIT_LEVELS[0]).when(has("有限", "稳定", "部分获益"), BENEFIT_LEVELS[1])
        .when(has("无", "不获益", "未获益"), BENEFIT_LEVELS[2]).when(has("进展", "有害", "恶化", "PD"), BENEFIT_LEVELS[3]).otherwise(BENEFIT_LEVELS[2])
    )


def is_benefit(label: Column) -> Column:
    return F.coalesce(label.isin(*BENEFIT_LEVELS[:2]), F.lit(False))


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    out = text.rlike(patterns[0])
    for p in patterns[1:]:
        out = out | text.rlike(p)
    return F.coalesce(out, F.lit(False))


def signals(text: Column) -> dict[str, Column]:
    return {"is_supporting": _any(text, SUPPORTING), "is_contradicting": _any(text, CONTRADICTING), "is_safety_risk": _any(text, RISK)}


def priority(level: Column) -> Column:
    out = F.lit(0)
    for name, p in EVIDENCE_PRIORITY.items():
        out = F.when(level == name, p).otherwise(out)
    return out


def verdict(support: Column, contradiction: Column, risk: Column, counter_hits: Column) -> Column:
    return (
        F.when((support == 0) & (contradiction == 0) & (risk == 0), "insufficient_evidence")
        .when(contradiction + risk > F.greatest(F.lit(1), support), "needs_caution_due_to_contradiction_or_risk")
        .when((support == 0) & ((counter_hits > 0) | (contradiction > 0)), "not_supported")
        .otherwise("supported_with_monitoring")
    )


def max_severity(*named: tuple[Column, str]) -> Column:
    """Largest severity of the conditions that hold: low, medium, high, critical."""
    order = {"low": 0, "medium": 1, "high": 2, "critical": 3}
    level = F.greatest(F.lit(0), *(F.when(c, order[s]).otherwise(0) for c, s in named))
    return F.element_at(F.array(*map(F.lit, order)), level + 1)


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value.try_cast("double"), F.lit(low))))


def as_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin("true", "yes", "1", "y"), F.lit(False))
