"""Session memory across turns: snapshots of any layout by session, and states of conversations that grow batch by batch.

Both keep versions: a save writes only what came, one table a version, and a manifest that appears whole or not at all; of
a session the newest version counts. Old layouts are migrated when they are read and are never written back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.folders import Manifest, new_folder

#: The fields of a snapshot by kind.
OBJECTS = (
    "confirmed_constraints", "replanner_short_memory", "replanner_long_memory", "memory_timeline", "answer_memory", "answer_context_summary", "skill_runtime",
    "final_safety_review", "citations", "workflow_trace", "budget_state", "step_budget_status", "retrieval_plan",
)
LISTS = ("round_memories", "step_memories", "pending_replanner_step_memories", "replanner_memory_events", "loop_steps", "budget_events", "replan_decisions")
TEXTS = ("final_answer", "original_query", "updated_at")
PLANNER = (
    "original_query", "confirmed_constraints", "identified_entities", "round_memories", "step_memories", "replanner_short_memory", "replanner_long_memory", "pending_replanner_step_memories", "memory_timeline",
    "answer_memory", "final_safety_review", "retrieval_plan", "replan_decisions", "active_plan_step_index", "budget_state", "step_budget_status",
)

_MAP, _LIST = "map<string,variant>", "array<variant>"


def session_id(raw: Column) -> Column:
    """A session's name as a file name: all but letters, digits, `_` and `-` become `_`; an empty one is an error."""
    clean = F.regexp_replace(F.trim(raw), r"(?U)[^\w\-]", "_")
    return F.when(F.length(clean) > 0, clean).otherwise(F.raise_error(F.lit("a session has no name")))


def _variant(value: Column) -> Column:
    return F.parse_json(F.to_json(value))


def _is(value: Column, kind: str) -> Column:
    return F.schema_of_variant(value).startswith(kind)


def snapshot(payload: Column) -> dict[str, Column]:
    """The fields of a snapshot in JSON, of any layout; a text that is no object gives nulls.

    Old layouts: retrieved evidence becomes the evidence of an answer memory that is missing, long memory its legacy
    context, rounds stand in for missing steps, and a single entity is a list of one."""
    v = F.try_parse_json(payload)
    v = F.when(_is(v, "OBJECT"), v)
    get = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    there = lambda c: F.when(v.isNotNull(), c)
    empty_map, empty_list = F.create_map().cast(_MAP), F.array().cast(_LIST)
    objects = lambda name: F.filter(F.coalesce(get(name, _LIST), empty_list), lambda x: x.isNotNull() & _is(x, "OBJECT"))

    out = {name: there(F.coalesce(get(name, _MAP), empty_map)) for name in OBJECTS}
    # of evidence with one id the last counts
    pieces = F.filter(objects("retrieved_evidence"), lambda x: F.length(F.try_variant_get(x, "$.chunk_id", "string")) > 0)
    ids = F.transform(pieces, lambda x: F.try_variant_get(x, "$.chunk_id", "string"))
    last = F.filter(F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1))), lambda i: (i <= F.size(pieces)) & (F.array_position(F.slice(ids, i + 1, F.size(ids)), F.get(ids, i - 1)) == 0))
    evidence = F.map_from_entries(F.transform(last, lambda i: F.struct(F.get(ids, i - 1).alias("k"), F.get(pieces, i - 1).alias("v"))))
    made = F.create_map(F.lit("claims"), _variant(F.array().cast("array<string>")), F.lit("evidence_by_id"), _variant(evidence), F.lit("informative_rounds"), _variant(F.array().cast("array<string>")))
    had_evidence = F.size(F.coalesce(get("retrieved_evidence", _LIST), empty_list)) > 0
    memory = F.when((F.size(out["answer_memory"]) == 0) & had_evidence, made).otherwise(out["answer_memory"])
    old = F.filter(F.transform(F.coalesce(get("long_memory", _LIST), empty_list), lambda x: F.try_variant_get(x, "$", "string")), lambda x: F.length(F.trim(x)) > 0)
    legacy = F.map_concat(F.map_filter(memory, lambda k, _: k != "legacy_context"), F.create_map(F.lit("legacy_context"), _variant(old)))
    out["answer_memory"] = there(F.when(F.size(old) > 0, legacy).otherwise(memory))

    out |= {name: there(objects(name)) for name in LISTS}
    out["step_memories"] = there(F.when(F.size(F.coalesce(get("step_memories", _LIST), empty_list)) > 0, objects("step_memories")).otherwise(objects("round_memories")))
    text = lambda x: F.try_variant_get(x, "$", "string")
    entities = F.transform_values(F.coalesce(get("identified_entities", _MAP), empty_map), lambda _, x: F.when(_is(x, "ARRAY"), F.transform(F.try_variant_get(x, "$", _LIST), text)).otherwise(F.array(text(x))))
    out["identified_entities"] = there(entities)
    out |= {name: there(F.coalesce(get(name, "string"), F.lit(""))) for name in TEXTS}
    out["active_plan_step_index"] = there(F.coalesce(get("active_plan_step_index", "int"), F.lit(0)))
    return out


class SessionStore:
    """Snapshots by session in `folder`; a save overwrites a session's snapshot as a whole."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or new_folder(spark, "sessions")
        self.manifest = Manifest(spark, self.folder, {"versions": []})

    def save(self, states: DataFrame) -> None:
        """states: session_id, payload (JSON), one row a session; of several the greatest text counts."""
        path = f"{self.folder}/states-{uuid.uuid4().hex}"
        rows = states.select(session_id(F.col("session_id")).alias("session_id"), "payload").groupBy("session_id").agg(F.max("payload").alias("payload"))
        rows.withColumn("version", F.lit(self.manifest.state["number"] + 1)).write.parquet(path)
        self.manifest.commit(versions=[*self.manifest.state["versions"], path])

    def _newest(self, wanted: DataFrame | None) -> DataFrame:
        rows = self.spark.read.schema("session_id string, payload string, version int").parquet(*self.manifest.state["versions"]) if self.manifest.state["versions"] else self.spark.createDataFrame([], "session_id string, payload string, version int")
        if wanted is not None:
            rows = rows.join(wanted.select(session_id(F.col("session_id")).alias("session_id")), "session_id", "left_semi")
        return rows.groupBy("session_id").agg(F.max_by("payload", "version").alias("payload"), F.max("version").alias("version"))

    def load(self, wanted: DataFrame | None = None) -> DataFrame:
        """session_id, version and the fields of the newest snapshot of each (wanted) session whose text is an object."""
        rows = self._newest(wanted)
        return rows.select("session_id", "version", *(c.alias(name) for name, c in snapshot(F.col("payload")).items())).where("original_query IS NOT NULL")

    def planner_context(self, wanted: DataFrame | None = None) -> DataFrame:
        """session_id and what a planner goes on with."""
        return self.load(wanted).select("session_id", *PLANNER).withColumnRenamed("original_query", "previous_query")

    def compact(self) -> None:
        """One table of newest versions in place of many."""
        path = f"{self.folder}/states-{uuid.uuid4().hex}"
        self._newest(None).select("session_id", "payload", "version").write.parquet(path)
        self.manifest.commit(versions=[path])


class ConversationState:
    """What each conversation has come to: turns so far, the first question, the last answer, the last `keep` turns.

    A batch of turns is folded by itself and added as a version; folds of versions add up in any order, so turns in many
    batches come to what they come to in one. A batch number of a source counts once. Batches bring each turn once."""

    KEYS = ("session_id", "n_turns", "question", "answer", "recent")

    def __init__(self, spark: SparkSession, folder: str | None = None, *, keep: int = 3):
        self.spark, self.folder, self.keep = spark, folder or new_folder(spark, "conversations"), keep
        self.manifest = Manifest(spark, self.folder, {"versions": [], "sources": {}})

    def _fold(self, rows: DataFrame) -> DataFrame:
        nth = F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("turn").desc(), "role", "text"))
        said, one = F.struct("turn", "role", "text"), rows.withColumn("n", nth)
        of = lambda role: F.when(F.col("role") == role, F.struct("turn", "text"))
        return one.groupBy("session_id").agg(F.count("*").alias("n_turns"), F.min(of("user")).alias("question"), F.max(of("assistant")).alias("answer"), F.collect_list(F.when(F.col("n") <= self.keep, said)).alias("recent"))

    def append(self, turns: DataFrame, batch: int, source: str = "stream") -> bool:
        """turns: session_id, turn, role, text. False, and nothing written, if the batch is there already."""
        self.manifest.refresh()
        if batch <= self.manifest.state["sources"].get(source, -1):
            return False
        path = f"{self.folder}/turns-{uuid.uuid4().hex}"
        self._fold(turns.select(F.col("session_id").cast("string").alias("session_id"), "turn", "role", "text")).write.parquet(path)
        self.manifest.commit(versions=[*self.manifest.state["versions"], path], sources=self.manifest.state["sources"] | {source: batch})
        return True

    def read(self) -> DataFrame:
        """session_id, n_turns, question, answer (turn, text), recent (turn, role, text; newest last)."""
        turn = "struct<turn:long,text:string>"
        schema = f"session_id string, n_turns long, question {turn}, answer {turn}, recent array<struct<turn:long,role:string,text:string>>"
        paths = self.manifest.state["versions"]
        rows = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        # `keep` turns a version
        newest = F.reverse(F.array_sort(F.flatten(F.collect_list("recent"))))
        out = rows.groupBy("session_id").agg(F.sum("n_turns").alias("n_turns"), F.min("question").alias("question"), F.max("answer").alias("answer"), newest.alias("recent"))
        return out.withColumn("recent", F.reverse(F.slice("recent", 1, self.keep)))

    def compact(self) -> None:
        path = f"{self.folder}/turns-{uuid.uuid4().hex}"
        self.read().select(*self.KEYS).write.parquet(path)
        self.manifest.commit(versions=[path])
