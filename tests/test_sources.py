import json

from quillstone.sources import cases, logs
from quillstone.streaming import events


def write(path, obj):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(obj, ensure_ascii=False))


def corpus(root):
    write(root / "step1_extracted/p1_tr.json", {"title": "A retrospective cohort", "date": "2020-02", "text": "First text.\n\nReferences\n1. x", "source_file": "raw/p1.html"})
    write(root / "step2_cleaned/p1_tr_cleaned.json", {"text": "", "is_case_report": False, "rejection_reason": "cohort", "metadata": {"title": "A retrospective cohort"}})
    write(root / "step2_cleaned/p2_tr_cleaned.json", {"text": "Case text " * 200, "is_case_report": True, "provenance": {"source_pmid": "77"}, "metadata": {"title": "T"}})
    event = {"time": None, "event_type": "diagnosis + molecular", "molecular": {"alterations": ["EGFR L858R mutation"]}, "treatment": {"regimen": ["osimertinib"], "dosage": {"osimertinib": "80 mg qd"}}, "response": {"best": "PR", "duration_months": 12.0}, "safety": {"adverse_events": ["Grade 1 rash"], "dose_adjustments": []}}
    write(root / "step3_structured/p3_tr_cleaned.json.json", {"provenance": {"document_type": "case_report"}, "baseline_clinical_profile": {"cancer_type": "NSCLC", "metastatic_sites_at_baseline": None}, "timeline_events": [event], "outcome_summary": {"survival_months": 20.0}})


def test_layers_unify(spark, tmp_path):
    corpus(tmp_path)
    c = cases.unified(spark, str(tmp_path)).cache()
    assert c.count() == 3 and cases.unified(spark, str(tmp_path), legacy_stems=True).count() == 2
    d = {r["doc_id"]: r for r in cases.documents(c).collect()}
    assert d["p1"]["date"] == "2020-02-29" and d["p1"]["metadata"]["publication_date_source"] == "step1_date_fallback" and d["p1"]["document_type"] == "cohort_or_observational_study"
    assert d["p2"]["pmid"] == "77" and d["p2"]["document_type"] == "case_report" and d["p3"]["source_layer"] == "step3_structured"
    html = spark.createDataFrame([("raw/p1.html", '<meta name="citation_publication_date" content="2021 Aug">')], "source_file string, html string")
    d = {r["doc_id"]: r for r in cases.documents(c, html).collect()}
    assert d["p1"]["date"] == "2021-08-31" and d["p1"]["metadata"]["publication_date_source"] == "citation_publication_date"
    e = cases.events(c)
    row = e.first()
    assert row["event_id"] == "p3#case-1#event-001" and row["time"] == "unknown" and row["event_types"] == ["diagnosis", "molecular"]
    assert all(x in row["summary_text"] for x in ("80 mg qd", "response_duration_months=12", "toxicities=Grade 1 rash", "response=PR"))
    assert json.loads(row["raw_json"])["safety"]["adverse_events"] == ["Grade 1 rash"]
    k = cases.chunks(c, cases.documents(c), e).orderBy("chunk_id").collect()
    kinds = [(r["doc_id"], r["chunk_type"]) for r in k]
    assert kinds == [("p1", "case_text_chunk")] + [("p2", "case_text_chunk")] * 3 + [("p3", "event_chunk"), ("p3", "structured_field_chunk")]
    assert k[0]["text"] == "First text." and k[0]["layer"] == "step1_extracted" and "survival_months" in k[-1]["text"]
    p = {r["doc_id"]: r for r in cases.profiles(c).collect()}
    assert p["p3"]["metastatic_sites_at_baseline"] == [] and p["p3"]["baseline_molecular_alterations"] == ["EGFR L858R mutation"]
    assert {(r["entity_type"], r["entity_value"]) for r in cases.entity_index(e).collect()} >= {("drugs", "osimertinib"), ("responses", "pr"), ("genes", "egfr")}


def test_refresh_and_upsert(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, m string, keep string")
    new = spark.createDataFrame([(1, "A"), (3, "C")], "id int, m string")
    assert sorted((r["id"], r["m"], r["keep"]) for r in cases.refresh_metadata(old, new, "id").collect()) == [(1, "A", "x"), (2, "b", "y")]
    assert sorted((r["id"], r["m"]) for r in cases.upsert(old.select("id", "m"), new, "id").collect()) == [(1, "A"), (2, "b"), (3, "C")]


def test_torn_lines_and_last_rows(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"seq": 1, "event_id": "a", "type": "t"}\n{"seq": 2, "event_id": "a", "type": "u"}\n{"seq": 3, "ev')
    rows = logs.json_lines(spark, str(tmp_path / "log.jsonl"), logs.EVENT)
    assert logs.last_sequence(rows) == 2
    assert [r["type"] for r in logs.json_lines(spark, str(tmp_path / "log.jsonl"), logs.EVENT, key="event_id").collect()] == ["u"]
    write(tmp_path / "c/1.json", {"id": "x", "v": 1})
    write(tmp_path / "c/2.json", {"id": "x", "v": 2})
    (tmp_path / "c/3.json").write_text("{torn")
    write(tmp_path / "c/manifest.json", {"id": "m", "v": 0})
    assert [(r["id"], r["v"]) for r in logs.checkpoints(spark, str(tmp_path / "c"), "id string, v int", "id").collect()] == [("x", 2)]


def test_stream_counts_each_event_once(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    n = e.count()
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    e.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    got = []
    q = events.upsert_batches(events.each_once(stream, delay="60 days"), lambda df, k: got.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sum(got) == n
    q = events.upsert_batches(events.each_once(stream, delay="60 days"), lambda df, k: got.append(df.count()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sum(got) == n


def test_cohorts(spark):
    done = spark.createDataFrame([(i,) for i in range(1, 8)], "seq int")
    assert [(r["cohort"], r["n"], r["complete"]) for r in events.ready_batches(done, 3).orderBy("cohort").collect()] == [(0, 3, True), (1, 3, True), (2, 1, False)]
