"""Gold anchors, reverse search, trace mining and picks without reuse, against plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import anchors, assembly, traces


def test_anchors_and_texts_of_cases(spark):
    body = {
        "gold_citations": ["c1", {"chunk_id": "c2", "doc_id": 7, "pmid": "", "members": [], "citations": [{"pmid": 31, "group_id": "no"}, "x"]}, 5, None],
        "gold_evidence": {"chunk_id": "not a list"},
        "ground_truth": {"gold_evidence_groups": [{"group_id": "g", "members": [{"chunk_id": "c1"}, {"doc_id": "d"}]}], "key_evidence_items": [" a 1 ", "", "b", 3], "gold_evidence_texts": ["b"], "benefit_rebalance_reason": " why ", "label": "PD"},
    }
    df = spark.createDataFrame([(1, json.dumps(body)), (2, "no json"), (3, None), (4, "[1]"), (5, '{"ground_truth": 3, "gold_citations": [{"doc_id": 0, "pmid": false, "group_id": "0"}]}')], "case_id long, body string")
    got = sorted((r["kind"], r["value"]) for r in anchors.gold_anchors(df).collect())
    assert got == [("chunk_id", "c1"), ("chunk_id", "c2"), ("doc_id", "7"), ("doc_id", "d"), ("group_id", "0"), ("group_id", "g"), ("pmid", "31")]
    assert [tuple(r) for r in anchors.gold_texts(df).orderBy("pos").collect()] == [(1, 0, "a 1"), (1, 1, "b"), (1, 2, "3"), (1, 3, "why")]
    chunks, docs = spark.createDataFrame([("c1",), ("zz",)], "chunk_id string"), spark.createDataFrame([("d", "31"), ("e", None)], "doc_id string, pmid string")
    assert sorted((r["kind"], r["value"]) for r in anchors.present(anchors.gold_anchors(df), chunks, docs).collect()) == [("chunk_id", "c1"), ("doc_id", "d"), ("pmid", "31")]


def test_covering_equals_a_loop_over_all_pairs(spark):
    r = random.Random(8)
    word = lambda: r.choice(["in", "the", "of"]) if r.random() < 0.4 else f"w{r.randrange(60)}x"
    golds = [(i, " ".join(word() for _ in range(r.randrange(1, 14))).title() if i % 3 else " ".join(word() for _ in range(9))) for i in range(40)]
    golds += [(50, "seen 2024年5月 with progression alpha beta gamma delta epsilon"), (51, "2024-05"), (52, ""), (53, None), (54, "脑转移 进展 2023/11"), (55, "??")]
    chunks = [(f"k{i}", " ".join(word() for _ in range(r.randrange(0, 40)))) for i in range(200)]
    chunks += [("d1", "by 2024-5 PROGRESSION was"), ("d2", "2024-05 stable"), ("d3", "脑转移 缓解"), ("d4", "2023/11 进展"), ("n", None), ("k1", "repeated id in the of")]
    g, c = spark.createDataFrame(golds, "gold_id long, text string"), spark.createDataFrame(chunks[:-1], "id string, text string")
    every = g.crossJoin(c.withColumnRenamed("text", "chunk")).select("gold_id", "id", assembly.gold_overlap(F.col("text"), F.col("chunk")).alias("o")).where("o.passes").select("gold_id", "id", "o.lexical", "o.date_hit", "o.outcome_hit")
    found = anchors.covering(g, c)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, every.collect())) and found.count() > 100
    assert {(r["gold_id"], r["id"]) for r in found.where("lexical < 0.35").collect()} == {(50, "d1")}
    assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
    assert anchors.covering(g.limit(0), c).count() == 0 == anchors.covering(g, c.limit(0)).count()
    hits = found.select((F.col("gold_id") % 2).alias("case_id"), F.col("gold_id").alias("pos"), "id", "lexical", F.lit(None).cast("double").alias("score"))
    first = anchors.candidates(hits, most=60)
    for case in (0, 1):
        want = sorted((-r["lexical"], r["pos"], r["id"]) for r in hits.where(F.col("case_id") == case).collect())[:60]
        assert [(-r["lexical"], r["pos"], r["id"]) for r in first.where(F.col("case_id") == case).orderBy("rank").collect()] == want


def test_steps_and_judged_groups(spark):
    step = lambda q, g, tools=("hybrid_search",): {"query": q, "rerank_goal": g, "selected_tools": list(tools)}
    sessions = [("b", {"loop_steps": [step("q", "g"), step(" q ", "other")]}), ("a", {"loop_steps": ["x", step("z", "g", ["bm25"]), step("q", "g "), step("", "g"), {"query": "q"}]}), ("c", {"loop_steps": None})]
    s = spark.createDataFrame([(k, json.dumps(v)) for k, v in sessions] + [("d", "{"), ("e", None)], "source string, body string")
    assert sorted(map(tuple, traces.asked_steps(s).collect())) == [("a", 2, "q", "g"), ("b", 1, "q", "other")]
    hit = lambda i, score, dims=1, **more: {"id": i, "llm_relevance_score": score, "llm_rerank_dimensions": {"d": dims} if dims else {}, **more}
    rerank = lambda *hits, goal="why", name="Rerank": {"name": name, "atomic_rerank_goal": goal, "top_hits": list(hits)}
    t = [("t1", {"steps": [rerank(hit("c1", 1, text_preview="p", llm_evidence_type="case"), hit("zz", 0.5, text_preview="own"), hit("c1", None), hit("c2", 3, 0)), rerank(hit("c1", 1), hit("c2", 1.0)), rerank(hit("c1", 2)), rerank(hit("c1", 1), hit("c2", 2), goal=""), rerank(hit("c1", 1), hit("c2", 2), name="Search"), 7]})]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in t] + [("t2", "[]"), ("t3", None)], "source string, body string")
    c = spark.createDataFrame([("c1", "text 1"), ("c2", "text 2")], "chunk_id string, text string")
    got = traces.judged_groups(df, c).orderBy("source", "step", "pos").drop("dimensions").collect()
    assert [tuple(r) for r in got] == [("t1", 0, "why", 0, "c1", "text 1", 1.0, 0.0, "case"), ("t1", 0, "why", 1, "zz", "own", 0.5, 0.0, "")]


@pytest.mark.parametrize("seed", [1, 2])
def test_picks_equal_the_loop(spark, seed):
    r = random.Random(seed)
    rows = [(f"r{i}", i, " ".join(f"t{r.randrange(25)}q" for _ in range(4)).upper()) for i in range(4000 if seed == 1 else 60)]
    cats = [(f"c{i}", i * 3, [f"t{r.randrange(25)}q" for _ in range(1 + i % 2)]) for i in range(50)] + [("none", 500, ["absent"]), ("empty", 501, [])]
    d, k = spark.createDataFrame(rows, "row_id string, place long, text string"), spark.createDataFrame(cats, "category string, turn long, needles array<string>")
    found = traces.matches(d, k).join(k.select("category", "turn"), "category").join(d.select("row_id", "place"), "row_id")
    used, want = set(), {}
    for c, _, needles in cats:
        match = next((i for i, _, t in rows if needles and i not in used and all(n in t.lower() for n in needles)), None)
        if match:
            used.add(match)
            want[c] = match
    assert dict(map(tuple, traces.pick_without_reuse(found).collect())) == want and len(want) >= 20
    assert traces.pick_without_reuse(found.limit(0)).count() == 0
