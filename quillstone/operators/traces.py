"""What traces of past runs hold: asked steps, judged candidates, and picks of examples by category.

Traces are JSON texts, read as variants, so that only the fields asked for are taken from them. Texts that are no JSON object
and entries of another form than expected are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import stored
from .substrings import containing

#: The step whose hits are judged, and the tool whose steps are asked again.
JUDGED, ASKED_WITH = "Rerank", "hybrid_search"


def _text(v: Column | str, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _entries(traces: DataFrame, path: str) -> DataFrame:
    """source, step, s: the entries of a list in each trace."""
    return traces.select("source", F.posexplode(F.try_variant_get(F.try_parse_json("body"), path, "array<variant>")).alias("step", "s"))


def asked_steps(sessions: DataFrame) -> DataFrame:
    """source, step, query, goal: steps that searched with a goal, each pair of query and goal where it came first (by source, step).

    sessions: source, body."""
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    tools = F.try_variant_get("s", "$.selected_tools", "array<string>")
    rows = _entries(sessions, "$.loop_steps").where(F.array_contains(tools, ASKED_WITH))
    rows = rows.select("source", "step", trim(_text("s", "$.query")).alias("query"), trim(_text("s", "$.rerank_goal")).alias("goal")).where("query <> '' AND goal <> ''")
    return rows.groupBy("query", "goal").agg(F.min(F.struct("source", "step")).alias("at")).select("at.source", "at.step", "query", "goal")


def judged_groups(traces: DataFrame, chunks: DataFrame) -> DataFrame:
    """source, step, query, pos, id, text, historical_score, hybrid_score, evidence_type, dimensions: judged candidates of the
    steps that have two or more of them with different scores.

    traces: source, body; chunks: chunk_id, text. A candidate that the chunks lack keeps the trace's preview of its text."""
    steps = _entries(traces, "$.steps").withColumn("query", _text("s", "$.atomic_rerank_goal")).where((_text("s", "$.name") == JUDGED) & (F.col("query") != ""))
    hits = steps.select("source", "step", "query", F.posexplode(F.try_variant_get("s", "$.top_hits", "array<variant>")).alias("pos", "h"))
    dimensions = F.try_variant_get("h", "$.llm_rerank_dimensions", "map<string, variant>")
    hits = hits.select(
        "source", "step", "query", "pos", _text("h", "$.id").alias("id"), _text("h", "$.text_preview").alias("preview"), F.try_variant_get("h", "$.llm_relevance_score", "double").alias("historical_score"),
        F.coalesce(F.try_variant_get("h", "$.hybrid_score", "double"), F.lit(0.0)).alias("hybrid_score"), F.coalesce(_text("h", "$.llm_evidence_type"), F.lit("")).alias("evidence_type"), dimensions.alias("dimensions"),
    ).where(F.col("historical_score").isNotNull() & (F.size("dimensions") > 0))
    group = hits.groupBy("source", "step").agg(F.count("*").alias("n"), F.min("historical_score").alias("low"), F.max("historical_score").alias("high"))
    hits = hits.join(group.where("n >= 2 AND low < high").select("source", "step"), ["source", "step"], "left_semi")
    known = hits.join(chunks.select(F.col("chunk_id").cast("string").alias("id"), "text"), "id", "left")
    return known.withColumn("text", F.coalesce("text", "preview", F.lit(""))).select("source", "step", "query", "pos", "id", "text", "historical_score", "hybrid_score", "evidence_type", "dimensions")


def matches(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """category, row_id: rows whose text contains all needles of a category, without regard to case.

    rows: row_id, text; categories: category, needles (array). A category without needles matches nothing."""
    wanted = categories.select("category", F.explode(F.array_distinct(F.transform("needles", F.lower))).alias("needle"))
    of = wanted.groupBy("category").agg(F.count("*").alias("of"))
    found = containing(rows.select(F.col("row_id").alias("text_id"), F.lower("text").alias("text")), wanted.select(F.col("needle").alias("needle_id"), "needle").distinct())
    held = found.join(wanted.withColumnRenamed("needle", "needle_id"), "needle_id").groupBy("category", F.col("text_id").alias("row_id")).agg(F.count("*").alias("n"))
    return held.join(of, "category").where("n = of").select("category", "row_id")


def pick_without_reuse(found: DataFrame) -> DataFrame:
    """category, row_id: what a loop over the categories gives in which each takes its first row that none before it took.

    found: category, turn (the place of the category, distinct), row_id, place (of the row, distinct). The category of the k-th
    turn needs its first k rows only. All that are without a row propose to their next one at once; a row keeps the earliest
    turn that asks for it, and the others go on to their next. As every row prefers the same order, this ends in the
    loop's result, whatever the order of proposals. Categories that would go through the same rows start apart, each as far
    down as equal ones stand before it. A round is one job over the categories still asking; state is a table."""
    order = found.select("category", "turn").distinct()
    # distinct turns are counted in ranges, so that no task sorts all of them
    ranges = stored(order.repartitionByRange("turn").withColumn("part", F.spark_partition_id()), "pick-order")
    before = ranges.groupBy("part").agg(F.count("*").alias("n"))
    before = before.alias("a").join(F.broadcast(before.alias("b")), F.col("b.part") < F.col("a.part"), "left").groupBy("a.part").agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("before"))
    ranked = ranges.join(F.broadcast(before), "part").select("category", (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("turn"))).alias("k"))
    nth = F.row_number().over(Window.partitionBy("category").orderBy("place"))
    lists = found.withColumn("at", nth).join(ranked, "category").where(F.col("at") <= F.col("k")).select("category", "turn", "row_id", "at")
    lists = stored(lists, "pick-lists")
    # equal lists have equal hashes of their rows; a false match would only start a category too far down, so length and two hashes are compared
    same = found.groupBy("category", "turn").agg(F.count("*").alias("n"), F.sum(F.xxhash64("row_id").cast("decimal(38,0)")).alias("h1"), F.sum(F.hash("row_id").cast("long")).alias("h2"))
    state = same.select("category", F.row_number().over(Window.partitionBy("n", "h1", "h2").orderBy("turn")).alias("at"))
    state = stored(state, "pick-state")
    while True:
        asks = state.join(lists, ["category", "at"])
        kept = asks.groupBy("row_id").agg(F.min("turn").alias("first"))
        asks = stored(asks.join(kept, "row_id").withColumn("won", F.col("turn") == F.col("first")), "pick-round")
        if asks.where("NOT won").isEmpty():
            return asks.select("category", "row_id")
        # a category past its last row asks no more
        state = asks.select("category", (F.col("at") + F.when(F.col("won"), 0).otherwise(1)).alias("at"))
