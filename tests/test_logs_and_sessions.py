"""Ordered logs under failures, and session memory across versions, layouts and batches."""

import json

import pytest
from pyspark.sql import functions as F

from quillstone.streaming import eventlog, sessions
from quillstone.streaming.eventlog import EventLog
from quillstone.streaming.sessions import ConversationState, SessionStore


def numbered(log):
    return [tuple(r) for r in log.read().select("seq", "event_id").orderBy("seq").collect()]


@pytest.fixture
def stream(spark, tmp_path):
    """Thirty events in six files, one file a batch."""
    for i in range(6):
        spark.range(i * 5, i * 5 + 5).select((99 - F.col("id")).alias("event_id"), F.col("id").alias("ts"), F.lit("x" * i).alias("type")).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    return spark.readStream.schema("event_id long, ts long, type string").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")


@pytest.mark.parametrize("behind", [False, True])
def test_a_stream_killed_around_its_commit_numbers_every_event_once(spark, stream, tmp_path, monkeypatch, behind):
    log, commit, calls = EventLog(spark, f"file://{tmp_path}/log"), eventlog.Manifest.commit, []

    def killed(self, **changes):
        calls.append(1)
        if len(calls) == 3:  # rows of the third batch are written; the manifest is not, or the stream does not hear of it
            if behind:
                commit(self, **changes)
            raise RuntimeError("killed")
        commit(self, **changes)

    monkeypatch.setattr(eventlog.Manifest, "commit", killed)
    with pytest.raises(Exception, match="killed"):
        log.sink(stream, f"{tmp_path}/checkpoint").awaitTermination()
    assert len(numbered(EventLog(spark, log.folder))) == (15 if behind else 10)
    again = EventLog(spark, log.folder)
    again.sink(stream, f"{tmp_path}/checkpoint").awaitTermination()
    again.manifest.refresh()
    rows = numbered(again)
    assert [s for s, _ in rows] == list(range(1, 31)) and sorted(e for _, e in rows) == list(range(70, 100))
    # numbers follow time within each batch
    for k in range(0, 30, 5):
        assert [e for _, e in rows[k : k + 5]] == sorted((e for _, e in rows[k : k + 5]), reverse=True)
    assert [r["seq"] for r in again.read(after=27).orderBy("seq").collect()] == [28, 29, 30]


def test_a_torn_log_is_taken_over(spark, tmp_path):
    lines = [json.dumps({"seq": i, "event_id": f"e{i}", "type": "t"}) for i in (1, 2, 3)]
    (tmp_path / "old.jsonl").write_text("\n".join([lines[0], '{"seq": 9, "event_id"', lines[1], lines[2], '{"seq": 4, "ev']))
    log = EventLog(spark, f"file://{tmp_path}/log", order=("event_id",))
    assert log.adopt(f"{tmp_path}/old.jsonl", "seq long, event_id string, type string") == 3
    assert log.append(spark.createDataFrame([("b", "u"), ("a", "u")], "event_id string, type string"), 0)
    assert not log.append(spark.createDataFrame([("c", "u")], "event_id string, type string"), 0)
    assert numbered(log) == [(1, "e1"), (2, "e2"), (3, "e3"), (4, "a"), (5, "b")]
    with pytest.raises(ValueError, match="empty log"):
        log.adopt(f"{tmp_path}/old.jsonl", "seq long, event_id string, type string")


def test_two_writers_and_empty_batches(spark, tmp_path):
    row = lambda e: spark.createDataFrame([(1, e)], "ts long, event_id string")
    a = EventLog(spark, f"file://{tmp_path}/log")
    b = EventLog(spark, a.folder)
    assert a.read().count() == 0 and a.append(row("x").limit(0), 0, "a") and a.last == 0
    assert b.append(row("y"), 0, "b") and a.append(row("x"), 1, "a")
    assert numbered(a) == [(1, "y"), (2, "x")]


def saved(spark, store, **states):
    store.save(spark.createDataFrame([(k, v if isinstance(v, str) else json.dumps(v)) for k, v in states.items()], "session_id string, payload string"))


def test_sessions_keep_their_newest_snapshot(spark):
    store = SessionStore(spark)
    assert store.load().count() == 0
    saved(spark, store, s1={"original_query": "q", "round_memories": [{"round": 1}, "noise"], "loop_steps": [{"step": 1}], "final_answer": "测试回答", "answer_memory": {"claims": [{"claim_id": "c1"}]}, "memory_timeline": {"current_agent_round": 4}, "active_plan_step_index": 2}, s2={"original_query": "other"})
    saved(spark, store, s2={"original_query": "newer"}, bad="[1]")
    got = {r["session_id"]: r for r in SessionStore(spark, store.folder).load().select("*", F.to_json("answer_memory").alias("am"), F.to_json("round_memories").alias("rm"), F.to_json("step_memories").alias("sm"), F.to_json("memory_timeline").alias("mt")).drop("answer_memory", "round_memories").collect()}
    assert sorted(got) == ["s1", "s2"] and (got["s2"].original_query, got["s2"].version) == ("newer", 2)
    one = got["s1"]
    assert one.final_answer == "测试回答" and one.active_plan_step_index == 2 and json.loads(one.rm) == json.loads(one.sm) == [{"round": 1}]
    assert json.loads(one.am)["claims"][0]["claim_id"] == "c1" and json.loads(one.mt)["current_agent_round"] == 4
    store.manifest.refresh()
    store.compact()
    assert {(r.session_id, r.previous_query) for r in store.planner_context(spark.createDataFrame([("s2",)], "session_id string")).collect()} == {("s2", "newer")}


def test_old_layouts_are_migrated_when_read(spark):
    store = SessionStore(spark)
    old = {"long_memory": ["旧摘要", "  "], "retrieved_evidence": [{"chunk_id": "e1", "text": "first"}, {"chunk_id": "e1", "text": "evidence"}, {"text": "nameless"}, 7], "identified_entities": {"gene": "EGFR", "drug": ["a", "b"]}}
    saved(spark, store, old=old, kept={"answer_memory": {"claims": []}, "retrieved_evidence": [{"chunk_id": "e1"}], "step_memories": [{"s": 1}], "round_memories": [{"r": 1}]})
    rows = {r["session_id"]: r for r in store.planner_context().select("session_id", "identified_entities", F.to_json("answer_memory").alias("am"), F.to_json("step_memories").alias("sm")).collect()}
    assert json.loads(rows["old"].am) == {"claims": [], "evidence_by_id": {"e1": {"chunk_id": "e1", "text": "evidence"}}, "informative_rounds": [], "legacy_context": ["旧摘要"]}
    assert rows["old"].identified_entities == {"gene": ["EGFR"], "drug": ["a", "b"]}
    assert json.loads(rows["kept"].am) == {"claims": []} and json.loads(rows["kept"].sm) == [{"s": 1}]


def test_names_of_sessions(spark):
    df = spark.createDataFrame([(" a/b:c-é_1 ",)], "s string")
    assert df.select(sessions.session_id(F.col("s"))).first()[0] == "a_b_c-é_1"
    with pytest.raises(Exception, match="no name"):
        spark.createDataFrame([("  ",)], "s string").select(sessions.session_id(F.col("s"))).collect()


def test_conversations_in_batches_come_to_what_they_come_to_at_once(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").withColumnRenamed("conv_id", "session_id")
    at_once, grown = ConversationState(spark), ConversationState(spark)
    assert grown.read().count() == 0
    at_once.append(turns, 0)
    for k, part in enumerate((turns.where("turn >= 4"), turns.where("turn < 2"), turns.where("turn between 2 and 3"))):
        assert grown.append(part, k)
        assert not grown.append(part, k)  # a replay
    state = lambda s: sorted(map(str, s.read().collect()))
    assert state(grown) == state(at_once)
    grown.compact()
    assert state(ConversationState(spark, grown.folder)) == state(at_once)
