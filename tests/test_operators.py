import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import batching, dense, evidence, fusion, knowledge, lexical, metrics, scoring, structured, telemetry, twostage


def test_min_max_hybrid(spark):
    rows = [("structured", "a", 100.0), ("structured", "b", 50.0), ("dense", "a", 0.1), ("dense", "b", 0.9), ("bm25", "a", 1000.0), ("bm25", "b", 10.0)]
    got = {r["id"]: round(r["score"], 6) for r in fusion.hybrid(spark.createDataFrame(rows, "channel string, id string, score double")).collect()}
    assert got == {"a": 0.60, "b": 0.40}
    flat = spark.createDataFrame([("c", "x", 2.0), ("c", "y", 2.0), ("z", "x", 0.0)], "channel string, id string, score double")
    got = {(r["channel"], r["id"]): r["m"] for r in flat.withColumn("m", fusion.min_max(F.col("score"), ["channel"])).collect()}
    assert got == {("c", "x"): 1.0, ("c", "y"): 1.0, ("z", "x"): 0.0}


def test_structured_and_or(spark):
    cases = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "case_id string")
    ents = spark.createDataFrame([("c1", "drugs", "osimertinib"), ("c1", "responses", "pr"), ("c2", "drugs", "osimertinib")], "case_id string, entity_type string, entity_value string")
    got = structured.search(cases, ents, [("drugs", "Osimertinib"), ("responses", "PR")], hard=1).collect()
    assert [(r["case_id"], r["mode"], r["coverage"]) for r in got] == [("c1", "and", 1.0), ("c2", "or", 0.666667)]
    assert [r["score"] for r in structured.search(cases, ents, []).collect()] == [0.0, 0.0, 0.0]


def test_cancer_types(spark):
    pairs = [("nsclc", "非小细胞肺癌（肺腺癌）IV期"), ("肺腺癌", "lung squamous"), ("", "x"), ("nsclc", ""), ("lung", "sclc"), ("luad", "lung adenocarcinoma"), ("breast", "gastric")]
    df = spark.createDataFrame(pairs, "q string, s string")
    got = [r[0] for r in df.select(structured.cancer_match(F.col("q"), F.col("s"))).collect()]
    assert got == ["normalized_compatible", "no:histology_conflict", "unconstrained", "no:missing", "organ_compatible", "canonical_exact", "no:different_cancer"]


def test_cutoff_needs_proof(spark):
    d = spark.createDataFrame([("a", "2021-06-01", "citation_publication_date"), ("b", "2024-06-01", "citation_publication_date"), ("c", None, None), ("d", "2020-01-01", "step1_date_fallback")], "id string, date string, src string")
    assert [r["id"] for r in structured.known_by(d, "2022-12-31", source_col="src").collect()] == ["a"]
    assert structured.known_by(d, None, mode="off").count() == 4
    try:
        structured.known_by(d, None)
    except ValueError:
        return
    raise AssertionError("a cutoff mode without a date must be an error")


def test_requested_order(spark):
    rows = spark.createDataFrame([("ch1",), ("ch2",), ("ch3",)], "chunk_id string")
    wanted = spark.createDataFrame([("ch3", 0), ("ch1", 1), ("ch2", 2)], "id string, pos int")
    assert [r["chunk_id"] for r in structured.in_requested_order(rows, wanted, "chunk_id", 2).collect()] == ["ch3", "ch1"]


def plain_bm25(docs, query):
    toks = {i: t.lower().split() for i, t in docs if t.split()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for i, ws in toks.items():
        s = 0.0
        for q in query.lower().split():
            df = sum(q in x for x in toks.values())
            tf = ws.count(q)
            if tf:
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ws) / avg))
        if s > 0:
            out[i] = round(s, 9)
    return out


def test_bm25_against_a_plain_loop(spark):
    docs = [(1, "egfr lung response egfr"), (2, "lung toxicity"), (3, "rule egfr ddi"), (4, ""), (5, "kras")]
    q = "egfr lung egfr"
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(0, q)], "query_id int, text string")).collect()
    assert {r["id"]: round(r["score"], 9) for r in got} == plain_bm25(docs, q)


def test_bm25_reads_its_texts_once(spark, tmp_path):
    """Statistics, frequencies and scores share one scan and one tokenisation."""
    spark.createDataFrame([(i, f"alpha beta w{i % 7} w{i % 5}") for i in range(50)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    q = spark.createDataFrame([(0, "alpha w3")], "query_id long, text string")
    out = lexical.search(spark.read.parquet(str(tmp_path / "d")), q, top_k=3)
    assert len(out.collect()) == 3
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("FileScan parquet") == 1 and plan.count("ReusedExchange") == 2


def test_dense_drops_other_lengths_and_non_positive(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [-1.0, 0.0]), (4, [1.0])], "id long, v array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query_id int, vector array<double>")
    assert [(r["id"], r["rank"]) for r in dense.search(v, q, id_col="id", vector_col="v").orderBy("rank").collect()] == [(1, 1), (2, 2)]


def test_bucketed_details(spark):
    texts = {"r1": "drug resistance developed", "r2": "disease progression later", "e": "early partial response and initial improvement", "t": "toxicity grade 2 adverse event"}
    rows = spark.createDataFrame([("d", k, v) for k, v in texts.items()], "doc_id string, chunk_id string, text string")
    score, bucket = twostage.detail_score(F.col("text"), F.array(F.lit("early"), F.lit("response")), F.array(F.lit("early_response")))
    got = twostage.bucketed(rows.withColumn("score", score).withColumn("bucket", bucket), "doc_id", "chunk_id").orderBy(F.col("score").desc()).collect()
    assert got[0]["chunk_id"] == "e" and len({r["bucket"] for r in got}) == len(got) and not {"r1", "r2"} <= {r["chunk_id"] for r in got}


def test_safety_rules(spark):
    q = spark.createDataFrame([(1, "EGFR TKI 80 mg qd 与 DDI ?"), (2, "what does the guideline say")], "k int, q string")
    e = spark.createDataFrame([(1, "grade 4 hepatitis", "case_report_evidence"), (1, "response", "case_report_evidence"), (2, "guideline", "guideline_evidence"), (2, "label", "drug_label_or_ddi_rule_evidence"), (2, "trial", "clinical_trial_evidence")], "k int, text string, level string")
    got = {r["k"]: r for r in evidence.safety(q, e, key="k", query=F.col("q"), text=F.col("text"), level=F.col("level")).collect()}
    assert got[1]["risk_level"] == "critical" and got[1]["requires_review"]
    assert {"dose_recommendation_risk", "missing_ddi_evidence", "severe_toxicity_signal", "insufficient_evidence"} <= set(got[1]["issues"].split(","))
    assert got[2]["risk_level"] == "low" and got[2]["issues"] == ""


def test_confusion_published_in_the_baseline(spark):
    rows = [(True, True)] * 29 + [(False, False)] * 3 + [(False, True)] * 6 + [(True, False)] * 5
    m = metrics.binary(spark.createDataFrame(rows, "t boolean, g boolean"), F.col("t"), F.col("g")).first()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"]) == (0.7442, 0.8286, 0.8529, 0.8406)


def test_kappa_against_the_definition(spark):
    rng = np.random.default_rng(1)
    t, g = rng.integers(0, 4, 60), rng.integers(0, 4, 60)
    o = np.zeros((4, 4))
    for a, b in zip(t, g, strict=True):
        o[a, b] += 1
    w = np.array([[(i - j) ** 2 for j in range(4)] for i in range(4)])
    e = np.outer(o.sum(1), o.sum(0)) / 60
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(t, g, strict=True)], "t int, g int")
    assert abs(metrics.weighted_kappa(df, F.col("t"), F.col("g")).first()["kappa"] - (1 - (w * o).sum() / (w * e).sum())) < 1e-4
    same = spark.createDataFrame([(2, 2)] * 3, "t int, g int")
    assert metrics.weighted_kappa(same, F.col("t"), F.col("g")).first()["kappa"] == 1.0


def test_perfect_ece_counts_as_missing(spark):
    z = [F.lit(None).cast("double")]
    row = spark.range(1).select(metrics.composite(F.lit(1.0), F.lit(1.0), z, z, F.lit(1.0), F.lit(0.0), F.lit(1.0), [F.lit(5.0)] * 4).alias("c")).first()["c"]
    assert row["primary_score"] == 0.65 and row["auxiliary_score"] == 1.0


def test_bootstrap_is_numpys(spark):
    y = [0.0, 1.0, 1.0, 0.0, 1.0]
    got = metrics.bootstrap(spark.createDataFrame([(v,) for v in y], "y double"), ["y"], lambda p: float(p["y"].mean()), n=50).first()
    np.random.seed(42)
    v = np.array([np.sort(y)[np.random.choice(5, size=5, replace=True)].mean() for _ in range(50)])
    assert (got["mean"], got["n"]) == (round(float(v.mean()), 4), 50) and got["ci_lower"] == round(float(np.percentile(v, 2.5)), 4)


def test_failure_ladder(spark):
    df = spark.createDataFrame([(False, True, True, True), (True, False, True, True), (True, True, False, True), (True, True, True, False)], "gold boolean, db boolean, dense boolean, review boolean")
    got = [r[0] for r in df.select(telemetry.failure_stage([("rerank_drop", F.col("dense")), ("evidence_review_drop", F.col("review"))], F.col("gold"), F.col("db"))).collect()]
    assert got == ["unknown", "db_missing_gold", "rerank_drop", "evidence_review_drop"]


def test_batches_and_positions(spark):
    df = spark.createDataFrame([(g, k) for g in "abc" for k in range(5)], "g string, k int")
    got = batching.batch_ids(batching.round_robin(df, "g", ["k"]), ["nth", "g"], 4, groups=3).orderBy("position").collect()
    assert [(r["g"], r["nth"]) for r in got] == [(g, n) for n in range(1, 6) for g in "abc"] and [r["batch"] for r in got] == [i // 4 for i in range(15)]


def test_candidate_pool_reserves_channels(spark):
    hits = spark.createDataFrame([("bm25", f"b{i}", i) for i in range(1, 20)] + [("dense", f"d{i}", i) for i in range(1, 20)] + [("detail", f"x{i}", i) for i in range(1, 9)], "channel string, id string, rank int")
    ids = [r["id"] for r in fusion.candidate_pool(hits, ("bm25", "dense", "detail"), "detail").orderBy("pool_pos").collect()]
    assert len(ids) == 16 and ids[:9] == ["b1", "b2", "b3", "d1", "d2", "d3", "x1", "x2", "x3"] and ids[9:14] == ["x4", "x5", "x6", "x7", "x8"]


def test_knowledge_chain(spark):
    names = spark.createDataFrame([("Osimertinib", "osi", "Tagrisso", ["AZD9291"])], "drug_name string, generic_name string, brand_name string, alias array<string>")
    pk = spark.createDataFrame([("osimertinib", "substrate", "CYP3A4", "inhibition", "ketoconazole", "x")], "drug_name string, role string, enzyme_transporter string, pk_interaction_type string, related_pk_drug string, adme_desc string")
    rules = spark.createDataFrame([("cyp3a4", "inhibitor", "substrate", "likely", "n")], "enzyme_transporter string, role1 string, role2 string, ddi_likelihood string, notes string")
    mut = spark.createDataFrame([("EGFR T790M", ["osimertinib"])], "mutation string, drugs array<string>")
    terms = knowledge.expansion(names, pk, rules, spark.createDataFrame([(1, "tagrisso")], "query_id int, term string")).first()["terms"]
    assert terms[0] == "tagrisso" and {"osimertinib", "azd9291", "cyp3a4", "likely"} <= set(terms)
    assert knowledge.by_mutation(mut, spark.createDataFrame([(1, "t790m"), (2, "kras")], "query_id int, term string")).count() == 1
    assert knowledge.rule_chunks(names, rules, pk, mut).count() == 4


def test_scorers_plug_in(spark):
    pairs = spark.createDataFrame([("a", "aa"), ("b", "xb b")], "query string, text string")
    got = scoring.score_pairs(pairs, lambda: lambda q, t: [float(x.count(y)) for y, x in zip(q, t, strict=True)]).orderBy("query").collect()
    assert [r["model_score"] for r in got] == [2.0, 2.0]
    hits = spark.createDataFrame([(1, "body", 0.4, False), (1, "ref", 0.9, True)], "query_id int, id string, s double, p boolean")
    assert [(r["id"], r["rerank_score"]) for r in scoring.rerank(hits, F.col("p"), F.col("s"), 5).orderBy("rank").collect()] == [("body", 0.4), ("ref", 0.15)]


def test_rerank_caps(spark):
    d = {k: F.lit(3.0) for k in ("a", "b")}
    w = {"a": 0.6, "b": 0.4}
    row = spark.range(1).select(evidence.rerank_score(d, w, []).alias("x"), evidence.rerank_score(d, w, [(F.lit(True), 0.75), (F.lit(False), 0.25)]).alias("y")).first()
    assert abs(row["x"] - 1.0) < 1e-12 and row["y"] == 0.75


def test_lineage(spark):
    claims = spark.createDataFrame([("claim_01", ["c1", "c9"])], "claim string, refs array<string>")
    got = evidence.lineage(claims, spark.createDataFrame([("c1",)], "id string"), claim="claim", refs="refs", evidence_id="id").orderBy("ref").collect()
    assert [(r["ref"], r["resolved"]) for r in got] == [("c1", True), ("c9", False)]
    assert json.dumps([r["claim"] for r in got]) == '["claim_01", "claim_01"]'


def test_route_counts_support_before_counter(spark):
    from quillstone.operators import router

    chunks = spark.createDataFrame([("c1", "egfr response improved", "2020-01-01"), ("c2", "egfr fatal toxicity death", "2020-01-01"), ("c3", "egfr response", "2030-01-01")], "chunk_id string, text string, date string")
    q = spark.createDataFrame([(1, "egfr response"), (2, "nothing here")], "query_id int, text string")
    rows, verdict = router.run(q, chunks, hint=F.concat("text", F.lit(" toxicity")), cutoff="2025-01-01", date_col="date")
    assert {(r["query_id"], r["chunk_id"], r["counter"]) for r in rows.collect()} >= {(1, "c1", False), (2, "c2", True)}
    assert all(r["chunk_id"] != "c3" for r in rows.collect())
    assert {r["query_id"]: r["verdict"] for r in verdict.collect()}[2] == "needs_caution_due_to_contradiction_or_risk"


def test_fetch_keeps_the_order_asked_for(spark):
    from quillstone.operators import router

    wanted = spark.createDataFrame([(1, 0, "b"), (1, 1, "zz"), (1, 2, "a"), (1, 3, "c")], "query_id int, pos int, id string")
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "chunk_id string")
    assert [r["chunk_id"] for r in router.fetch(wanted, rows, "chunk_id", 2).orderBy("pos").collect()] == ["b", "a"]
    docs = spark.createDataFrame([("d2", "7"), ("d1", "7")], "doc_id string, pmid string")
    assert router.by_pmid(spark.createDataFrame([(1, "7"), (2, "8")], "query_id int, pmid string"), docs).orderBy("query_id").collect()[0]["doc_id"] == "d1"


def test_few_shot_references(spark):
    from quillstone.operators import router

    cases = spark.createDataFrame([("a", ["x", "y"], 0.5)], "case_id string, features array<string>, s double")
    refs = spark.createDataFrame([("a", ["x", "y"], 0.9), ("b", ["x", "y"], 0.5), ("c", [], 0.52)], "ref_id string, ref_features array<string>, r double")
    assert [r["ref_id"] for r in router.expand_nearest(cases, refs, F.col("r"), "features").orderBy("rank").collect()] == ["b", "c"]


@pytest.mark.parametrize("block", [2048, 7])
def test_examples_equal_all_pairs(spark, block):
    import random

    from quillstone.operators import router

    r = random.Random(6)
    row = lambda i: (i, [round(r.gauss(0, 0.3), 3) for _ in range(4)] if i != 5 else None, ["all", *(f"f{r.randrange(6)}" for _ in range(r.randrange(0, 5)))] if i % 7 else None)
    rows = [row(i) for i in range(90)] + [(200, [1.0], ["all"]), (201, [2.0], [])]
    e = spark.createDataFrame(rows, "ref_id long, vector array<double>, features array<string>")
    got = router.nearest_examples(e.withColumnRenamed("ref_id", "case_id").where("case_id % 3 = 0 OR case_id = 200"), e, bonus=0.2, k=4, block=block)
    want = []
    for c, v, f in rows:
        if v and (c % 3 == 0 or c == 200):
            scored = sorted((-round(sum(a * b for a, b in zip(v, w, strict=True)) + 0.2 * len(set(f or ()) & set(g or ())), 9), i) for i, w, g in rows if w and len(w) == len(v) and i != c)
            want += [(c, i, n + 1) for n, (_, i) in enumerate(scored[:4])]
    assert sorted((x["case_id"], x["ref_id"], x["rank"]) for x in got.collect()) == sorted(want)
    assert router.nearest_examples(e.withColumnRenamed("ref_id", "case_id").limit(0), e).count() == 0


def test_random_baseline_of_one_label_is_perfect(spark):
    rows = spark.createDataFrame([("x",)] * 5, "y string")
    assert metrics.random_baseline(rows, "y", n=5).first()["accuracy"] == 1.0
