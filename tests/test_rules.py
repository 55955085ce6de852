from pyspark.sql import functions as F

from quillstone.operators import rules

DIMS = list(rules.DIMENSIONS)


def scores(spark, rows):
    df = spark.createDataFrame([(t, *d, m) for t, d, m in rows], "t string, " + ", ".join(f"{d} int" for d in DIMS) + ", m array<string>")
    return [r[0] for r in df.select(rules.match_score(F.col("t"), {d: F.col(d) for d in DIMS}, F.col("m"))).collect()]


def test_match_scores(spark):
    got = scores(spark, [("primary_result", [3] * 7, []), ("case_result", [3] * 7, []), ("primary_result", [3, 3, 1, 3, 3, 3, 1], []), ("primary_result", [3] * 7, ["wrong_drug", "wrong_time_window"]), ("citation_pointer", [0] * 7, ["non_result_text"]), ("odd", [3] * 7, [])])
    assert got[0] == 1.0 and got[1] == 0.75 and got[2] <= 0.55 and got[3] == 0.25 and got[4] == 0.0 and got[5] == 0.10


def test_gene_alterations(spark):
    cases = {"EGFR": True, "egfr l858r": True, "KRAS G12C": True, "NSCLC": False, "TKI": False, "MET amplification": True, "T790M": True, "hello": False, "AN": False}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r[0]: r[1] for r in df.select("x", rules.is_gene_alteration(F.col("x"))).collect()} == cases


def test_constraints(spark):
    c = spark.createDataFrame([("NSCLC with EGFR exon 19 del on osimertinib, best PR; any DDI?",)], "q string").select(rules.constraints(F.col("q")).alias("c")).first()["c"]
    assert c["cancer_type"] == "NSCLC" and c["responses"] == ["PR"] and c["drugs"] == ["osimertinib"] and c["ddi_terms"] == ["drug interaction"] and any(g.startswith("EGFR") for g in c["gene_alterations"])
    assert spark.range(1).select(rules.grounded(F.array(F.lit("Osimertinib"), F.lit("x")), F.lit("on osimertinib"))).first()[0] == ["Osimertinib"]


def test_constraint_layers(spark):
    asked = ["Osimertinib 耐药后 Progression in EGFR T790M, similar 同类 DDI, 耐药 PR?", None, "", "第二 同靶点 gefitinib pathway"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i int, q string")
    got = {r["i"]: r["c"] for r in df.select("i", rules.constraint_layers(F.col("q")).alias("c")).collect()}
    a, gene = got[0], got[0]["hard_constraints"]["gene_alterations"]
    assert a["soft_hints"]["clinical_terms"] == ["progression", "耐药", "同类"] and any("T790M" in g for g in gene)
    assert a["soft_hints"]["retrieval_focus"] == ["drug:osimertinib", *(f"gene:{g}" for g in gene), "response:PR", "ddi:drug interaction"]
    assert a["expansion_hints"] == ["broaden_to_similar_case", "broaden_to_resistance_mechanism", "same_class_drug:osimertinib", *(f"same_family_gene:{g}" for g in gene)]
    assert all(got[i]["expansion_hints"] == [] and got[i]["soft_hints"]["clinical_terms"] == [] and got[i]["soft_hints"]["retrieval_focus"] == [] for i in (1, 2))
    assert got[3]["expansion_hints"] == ["broaden_to_similar_case", "broaden_to_mechanism", "same_class_drug:gefitinib"]


def test_activation_gate(spark):
    rows = [("a", True, True, True), ("a", False, False, False), ("b", False, True, True), ("c", True, True, False), ("d", True, False, True)]
    got = {r["skill_id"]: (r["status"], r["efficacy"], r["callability"]) for r in rules.activation_gate(spark.createDataFrame(rows, "skill_id string, baseline_wrong boolean, intervention_correct boolean, mounted boolean")).collect()}
    assert got == {"a": ("active", True, True), "b": ("candidate", False, False), "c": ("candidate", True, False), "d": ("candidate", False, True)}


def test_lists(spark):
    row = spark.range(1).select(rules.append_unique(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")), 2).alias("u"), rules.softmax(F.array(F.lit(0.0), F.lit(0.0))).alias("s"), rules.needs_consolidation(F.lit(1), F.lit(2400)).alias("n")).first()
    assert row["u"] == ["b", "c"] and row["s"] == [0.5, 0.5] and row["n"]
    led = rules.ledger(spark.createDataFrame([(1, ["x", "y"], [2, 3])], "k int, a array<string>, r array<int>"), "k", "a", "r").collect()
    assert [(r["attempt_no"], r["action"], r["result"]) for r in led] == [(1, "x", 2), (2, "y", 3)]


def test_forwarding(spark):
    s = "array<struct<id:string,support_level:string>>"
    df = spark.createDataFrame([([("d", "direct")], [("a", "analog")] * 3), ([], [("p", "partial"), ("a", "analog"), ("q", "partial"), ("r", "partial")]), ([], [("a", "analog")] * 3)], f"d {s}, a {s}")
    assert [[x["id"] for x in r[0]] for r in df.select(rules.forwarded(F.col("d"), F.col("a"))).collect()] == [["d"], ["p", "q"], ["a", "a"]]
