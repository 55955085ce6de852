"""Deterministic rules of planning, review, rerank scoring and answering, as column expressions over tables of claims,
attempts and hits; many cases are decided in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the match dimensions (0 to 3 each), caps by evidence type and by hard mismatch.
DIMENSIONS = {"population_match": 0.125, "intervention_match": 0.125, "regimen_match": 0.20, "timepoint_match": 0.15, "outcome_match": 0.20, "directness": 0.10, "attribution": 0.10}
TYPE_CAPS = {"primary_result": 1.00, "case_result": 0.75, "review_result": 0.85, "background": 0.35, "citation_pointer": 0.15, "irrelevant": 0.10}
MISMATCH_CAPS = {"wrong_drug": 0.25, "wrong_regimen": 0.55, "wrong_population": 0.40, "wrong_time_window": 0.35, "wrong_outcome": 0.30, "non_result_text": 0.15, "attribution_impossible": 0.30}
POINTERS = ("[doi]", "[pubmed]", "[google scholar]", "pmid:", "doi:")
GENES = (
    "AKT1", "ALK", "BRAF", "BRCA1", "BRCA2", "CDK4", "CDK6", "EGFR", "ERBB2", "ERBB3",
    "ERBB4", "FGFR1", "FGFR2", "FGFR3", "HRAS", "KIT", "KRAS", "MAP2K1", "MAP2K2", "MDM2",
    "MDM4", "MET", "MYC", "NRAS", "NTRK1", "NTRK2", "NTRK3", "PDGFRA", "PIK3CA", "PIK3CB",
    "PIK3CD", "PTEN", "RB1", "RET", "ROS1", "STK11", "TP53",
)
NOT_GENES = ("AI", "AN", "CNS", "CT", "CSF", "DDI", "ECOG", "LUAD", "MRI", "NA", "NSCLC", "PET", "PS", "PR", "CR", "SD", "PD", "SCLC", "TKI")
DRUGS = ("osimertinib", "gefitinib", "afatinib", "alectinib", "crizotinib", "temozolomide", "olaparib", "atezolizumab")
ALTERED = r"(EXON\d+|\d+DEL|\d+DELETION|\d+INS|\d+DUP|\d+AMP|AMPLIFICATION|FUSION|REARRANGEMENT|MUTATION|L858R|T790M|C797S|G719X|S768I)|\d"
#: Words of a question that a search should keep, and words that widen it.
CLINICAL_WORDS = ("progression", "progressed", "resistance", "resistant", "after", "following", "subsequent", "post", "switch", "line", "toxicity", "adverse", "response", "benefit")
CLINICAL_SIGNS = "进展|耐药|失败|后续|换药|毒性|不良反应|获益|缓解|相似|类似|同类|机制|原因"
WIDENING = {
    "broaden_to_similar_case": ("similar", "similar case", "相似", "类似", "同类", "同靶点", "同通路"),
    "broaden_to_resistance_mechanism": ("resistance", "resistant", "耐药", "进展", "progression", "progressed"),
    "broaden_to_mechanism": ("mechanism", "机制", "pathway", "原因"),
}
SAME_CLASS = ("同类", "类似", "同靶点", "同通路")
SAME_FAMILY = ("同类", "类似", "同通路")
COUNTER_HINT = "反证 毒性 不良反应 进展 耐药 禁忌 风险"


def present(values: Column) -> Column:
    return F.filter(values, lambda x: x.isNotNull())


def is_citation_pointer(text: Column) -> Column:
    t = F.lower(text)
    return sum((t.contains(m).cast("int") for m in POINTERS), F.lit(0)) >= 2


def derived_mismatches(given: Column, dims: dict[str, Column]) -> Column:
    """Hard mismatches that are named, and those that a dimension of 0 means."""
    zero = {"wrong_drug": "intervention_match", "wrong_regimen": "regimen_match", "wrong_time_window": "timepoint_match", "wrong_outcome": "outcome_match"}
    own = present(F.array(*(F.when(dims[d] == 0, m) for m, d in zero.items())))
    return F.array_union(F.coalesce(given, F.array().cast("array<string>")), own)


def match_score(evidence_type: Column, dims: dict[str, Column], mismatches: Column) -> Column:
    """Weighted dimensions held below the least cap that applies, rounded to 4 digits."""
    score = sum((w * F.coalesce(dims[k], F.lit(0)) / 3 for k, w in DIMENSIONS.items()), F.lit(0.0))
    pick = lambda table, key, other: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), F.lit(other))
    zero = lambda *names: reduce(lambda a, b: a | b, (F.coalesce(dims[n], F.lit(0)) == 0 for n in names))
    caps = [pick(TYPE_CAPS, evidence_type, 0.10), F.when(zero("outcome_match"), 0.35).otherwise(1.0), F.when(zero("population_match", "intervention_match"), 0.30).otherwise(1.0)]
    caps += [F.when(zero("regimen_match"), 0.30).when(dims["regimen_match"] == 1, 0.55).otherwise(1.0), F.when(zero("timepoint_match"), 0.35).otherwise(1.0), F.when(zero("attribution"), 0.60).otherwise(1.0)]
    caps += [F.when(F.array_contains(mismatches, m), cap).otherwise(1.0) for m, cap in MISMATCH_CAPS.items()]
    return F.round(F.greatest(F.lit(0.0), F.least(score, *caps)), 4)


def is_gene_alteration(text: Column) -> Column:
    c = F.upper(F.regexp_replace(text, r"(?U)\s+", ""))
    symbol = F.array(*map(F.lit, GENES))
    starts = F.exists(symbol, lambda g: c.startswith(g) & (F.length(c) > F.length(g)) & F.substr(c, F.length(g) + 1).rlike(ALTERED))
    code = c.rlike(r"^[A-Z0-9]{3,12}$") & c.rlike(r"\d")
    return (F.length(c) >= 3) & ~c.isin(*NOT_GENES) & (c.isin(*GENES) | starts | code)


def constraints(query: Column) -> Column:
    """Struct of cancer_type, responses, gene_alterations, drugs and ddi_terms that a question names."""
    q = F.lower(query)
    cancer = F.when(q.contains("luad"), "LUAD").when(q.contains("nsclc"), "NSCLC").when(q.contains("sclc"), "SCLC").when(q.contains("lung adenocarcinoma"), "lung adenocarcinoma")
    responses = present(F.array(*(F.when(q.rlike(rf"(?U)\b{t}\b"), t.upper()) for t in ("pr", "pd", "sd", "cr"))))
    found = F.regexp_extract_all(query, F.lit(r"(?U)\b[A-Z]{2,8}\s*(?:exon\s*\d+\s*(?:del|deletion|ins)?|(?:\d+|[A-Z])\d+[A-Z]?|[A-Z]?\d+[A-Z]?|del(?:etion)?|ins|dup|amp|amplification|fusion|rearrangement|mutation)?\b"), F.lit(0))
    genes = F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: (x != "") & is_gene_alteration(x))
    drugs = present(F.array(*(F.when(q.contains(d), d) for d in DRUGS)))
    ddi = F.when(q.contains("ddi") | q.contains("interaction") | query.contains("相互作用"), F.array(F.lit("drug interaction"))).otherwise(F.array().cast("array<string>"))
    return F.struct(cancer.alias("cancer_type"), responses.alias("responses"), genes.alias("gene_alterations"), drugs.alias("drugs"), ddi.alias("ddi_terms"))


def constraint_layers(query: Column) -> Column:
    """Struct of hard constraints, soft hints (clinical_terms, retrieval_focus) and expansion_hints; a null question has none."""
    text = F.coalesce(query, F.lit(""))
    q, hard = F.lower(text), constraints(text)
    said = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: q.contains(w))
    tagged = lambda field, tag: F.transform(F.coalesce(hard[field], F.array().cast("array<string>")), lambda x: F.concat(F.lit(f"{tag}:"), x))
    where = lambda c, values: F.when(c, values).otherwise(F.array().cast("array<string>"))
    clinical = F.concat(F.filter(F.array(*map(F.lit, CLINICAL_WORDS)), lambda w: q.contains(w)), F.regexp_extract_all(text, F.lit(f"({CLINICAL_SIGNS})"), F.lit(1)))
    focus = F.concat(tagged("drugs", "drug"), tagged("gene_alterations", "gene"), tagged("responses", "response"), tagged("ddi_terms", "ddi"))
    wider = [where(said(words), F.array(F.lit(name))) for name, words in WIDENING.items()]
    wider += [where(said(SAME_CLASS), tagged("drugs", "same_class_drug")), where(said(SAME_FAMILY), tagged("gene_alterations", "same_family_gene"))]
    soft = F.struct(F.array_distinct(clinical).alias("clinical_terms"), F.array_distinct(focus).alias("retrieval_focus"))
    return F.struct(hard.alias("hard_constraints"), soft.alias("soft_hints"), F.array_distinct(F.concat(*wider)).alias("expansion_hints"))


def grounded(proposed: Column, source: Column) -> Column:
    """Proposed values that the source text names literally, whatever the case."""
    s = F.lower(source)
    return F.filter(proposed, lambda x: (F.trim(x) != "") & s.contains(F.lower(F.trim(x))))


def counter_query(query: Column) -> Column:
    return F.concat(query, F.lit(" "), F.lit(COUNTER_HINT))


def is_counted_supporting(status: Column, role: Column) -> Column:
    return status.isin("supported", "contested") & ~role.isin("irrelevant", "insufficient")


def claim_status(support: Column, against: Column, level: Column, scoped: Column) -> Column:
    return F.when((support > 0) & (against > 0), "contested").when((level == "analog") & ~scoped, "unsupported").when(level.isin("direct", "partial"), "supported").when(level == "analog", "limited").otherwise("unsupported")


def fallback_benefit(risk_level: Column, issues: Column, supported: Column) -> Column:
    """Outcome level where no prediction parsed: by risk, then by whether any claim is supported."""
    risky = F.lower(risk_level).rlike("critical|high") | F.exists(issues, lambda x: F.lower(x).rlike("progress|risk"))
    return F.when(risky, "进展或有害").when(supported > 0, "明显获益").otherwise("有限获益或稳定")


def absence_supported(queries: Column, tools: Column, no_gain: Column, matched: Column) -> Column:
    """Whether attempts show that something is not there: two questions by complementary tools, nothing new twice, no match."""
    lit = lambda *x: F.array(*map(F.lit, x))
    both = F.arrays_overlap(tools, lit("dense_search", "hybrid_search")) & F.arrays_overlap(tools, lit("bm25_search", "structured_search"))
    return (queries >= 2) & both & (no_gain >= 2) & (matched == 0)


def next_action(met: Column, absent: Column, no_gain: Column, matched: Column, step: Column, steps: Column) -> Column:
    on = F.when(step + 1 < steps, "advance_to_next_step").otherwise("stop")
    return F.when(met, on).when((absent | (no_gain >= 3)) & (matched == 0), on).when(absent | (no_gain >= 3), "narrow_search").otherwise("continue_step")


def step_budget(requested: Column, used: Column, hard: int = 128) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(hard), F.greatest(requested, used + 1)))


def activation_gate(pairs: DataFrame, skill: str = "skill_id") -> DataFrame:
    """skill, eligible, efficacy, callability, status. pairs: baseline_wrong, intervention_correct, mounted (booleans)."""
    e = F.col("baseline_wrong")
    every = lambda c: F.coalesce(F.bool_and(F.when(e, c)), F.lit(False))
    g = pairs.groupBy(skill).agg(F.sum(e.cast("long")).alias("eligible"), every(F.col("intervention_correct")).alias("efficacy"), every(F.col("mounted")).alias("callability"))
    return g.withColumn("status", F.when((F.col("eligible") > 0) & F.col("efficacy") & F.col("callability"), "active").otherwise("candidate"))


def forwarded(direct: Column, analogs: Column) -> Column:
    """Direct findings, all of them; without any, two that are no mere analogs, else the first two. Items: struct with support_level."""
    better = F.filter(analogs, lambda a: a["support_level"] != "analog")
    return F.when(F.size(direct) > 0, direct).when(F.size(better) > 0, F.slice(better, 1, 2)).otherwise(F.slice(analogs, 1, 2))


def sanity(parse_failure_rate: Column, ece: Column) -> Column:
    return F.struct((1 - F.coalesce(parse_failure_rate, F.lit(0.0)) >= 0.8).alias("parse_rate_ok"), F.coalesce(ece < 0.3, F.lit(False)).alias("calibration_ok"))


def skill_score(skill_tokens: Column, query_tokens: Column) -> Column:
    """Share of the query's tokens that a skill's text has."""
    q = F.array_distinct(query_tokens)
    return F.size(F.array_intersect(q, skill_tokens)) / F.greatest(F.lit(1), F.size(q))


def content_hash(payload: Column) -> Column:
    return F.left(F.sha2(payload, 256), F.lit(12))


def append_unique(kept: Column, new: Column, most: int) -> Column:
    """The list with new items that it lacks, cut to its last `most`."""
    every = F.array_union(kept, new)
    return F.slice(every, F.greatest(F.lit(1), F.size(every) - most + 1), most)


def needs_consolidation(memories: Column, tokens: Column, budget: int = 2800) -> Column:
    return (memories >= 3) | (tokens >= 0.85 * budget)


def token_estimate(payload: Column) -> Column:
    return F.floor(F.length(payload) / 2).cast("long")


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    shifted = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(shifted, F.lit(0.0), lambda s, x: s + x)
    return F.transform(shifted, lambda v: v / total)


def ledger(attempts: DataFrame, key: str, actions: str, results: str) -> DataFrame:
    """One row a search action: key, attempt_no, action, result; attempts hold both as arrays of equal length."""
    return attempts.select(key, F.posexplode(F.arrays_zip(actions, results)).alias("_k", "_z")).select(key, (F.col("_k") + 1).alias("attempt_no"), F.col(f"_z.{actions}").alias("action"), F.col(f"_z.{results}").alias("result"))


def document_ranks(hits: DataFrame, doc: str, rank: str, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """Adds `first_rank` (of the document's best chunk) and `doc_rank` (documents by first appearance)."""
    first = hits.withColumn("first_rank", F.min(rank).over(Window.partitionBy(*keys, doc)))
    return first.withColumn("doc_rank", F.dense_rank().over(Window.partitionBy(*keys).orderBy("first_rank")))


def rescue(hits: DataFrame, low: int = 9, high: int = 16, keys: tuple[str, ...] = ("query_id",), ok: Column | None = None) -> DataFrame:
    """Of each query without an accepted hit above `low`, the accepted hits of ranks low to high."""
    accepted = F.col("accepted") if ok is None else ok
    above = F.max((accepted & (F.col("rank") < low)).cast("int")).over(Window.partitionBy(*keys))
    return hits.withColumn("_above", above).where((F.col("_above") == 0) & accepted & F.col("rank").between(low, high)).drop("_above")


def retrieval_report(hits: DataFrame, gold: DataFrame, group: str, question: str = "query_id", item: str = "id", digits: int = 4) -> DataFrame:
    """group, n, hit_rate, mean_recall, mean_precision, mrr. hits: question, item, rank; gold: question, item, group."""
    g = gold.select(question, item, group).distinct()
    sizes = g.groupBy(question, group).agg(F.count("*").alias("gold"))
    h = hits.select(question, item, "rank").join(g.select(question, item, F.lit(1).alias("is_gold")), [question, item], "left")
    per = h.groupBy(question).agg(F.count("*").alias("got"), F.countDistinct(F.when(F.col("is_gold") == 1, F.col(item))).alias("hit"), F.min(F.when(F.col("is_gold") == 1, F.col("rank"))).alias("first"))
    q = sizes.join(per, question, "left").select(group, "gold", F.coalesce("got", F.lit(0)).alias("got"), F.coalesce("hit", F.lit(0)).alias("hit"), "first")
    r = lambda c, n: F.round(F.avg(c), digits).alias(n)
    return q.groupBy(group).agg(F.count("*").alias("n"), r((F.col("hit") > 0).cast("double"), "hit_rate"), r(F.col("hit") / F.col("gold"), "mean_recall"), r(F.when(F.col("got") > 0, F.col("hit") / F.col("got")).otherwise(0.0), "mean_precision"), r(F.coalesce(1 / F.col("first"), F.lit(0.0)), "mrr"))


def label_agreement(hits: DataFrame, truth: str, label: str, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """keys, top1, top3: whether the first label, and the majority of the first three (the earlier wins ties), is the truth."""
    counts = hits.where("rank <= 3").groupBy(*keys, truth, label).agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    best = counts.groupBy(*keys, truth).agg(F.min(F.struct(-F.col("n"), F.col("first"), F.col(label).alias("label")))["label"].alias("top3_label"), F.min(F.when(F.col("first") == 1, F.col(label))).alias("top1_label"))
    return best.select(*keys, (F.col("top1_label") == F.col(truth)).alias("top1"), (F.col("top3_label") == F.col(truth)).alias("top3"))


def funnel(stages: DataFrame, key: str, stage: str, reason: Column) -> DataFrame:
    """key, stage, n, and the histogram of reasons as `reason:count` in order."""
    c = stages.groupBy(key, stage, reason.alias("reason")).agg(F.count("*").alias("c"))
    return c.groupBy(key, stage).agg(F.sum("c").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "c")))), lambda x: F.concat_ws(":", x["reason"], x["c"].cast("string"))), ",").alias("reasons"))
