"""Roll-ups of run telemetry, audits and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(rows: DataFrame, value: Column, keys: tuple[str, ...] = (), digits: int = 4) -> DataFrame:
    """count, sum, mean, median, p90, p95, min, max; percentiles by linear interpolation."""
    r = lambda c, name: F.round(c, digits).alias(name)
    return rows.groupBy(*keys).agg(F.count(value).alias("count"), r(F.sum(value), "sum"), r(F.avg(value), "mean"), r(F.percentile(value, F.lit(0.5)), "median"), r(F.percentile(value, F.lit(0.9)), "p90"), r(F.percentile(value, F.lit(0.95)), "p95"), r(F.min(value), "min"), r(F.max(value), "max"))


def component_shares(calls: DataFrame, component: Column, duration: Column, tokens: Column, failed: Column, keys: tuple[str, ...] = (), digits: int = 6) -> DataFrame:
    """keys, component, calls, duration, tokens, errors, their shares of the keys' totals, and the error rate."""
    c = calls.groupBy(*keys, component.alias("component")).agg(F.count("*").alias("calls"), F.sum(duration).alias("duration"), F.sum(tokens).alias("tokens"), F.sum(failed.cast("long")).alias("errors"))
    w = Window.partitionBy(*(keys or (F.lit(0),)))
    share = lambda x: F.round(F.col(x) / F.nullif(F.sum(x).over(w), F.lit(0)), digits)
    return c.select(*keys, "component", "calls", F.round("duration", digits).alias("duration"), "tokens", "errors", share("duration").alias("duration_share"), share("tokens").alias("token_share"), F.round(F.col("errors") / F.col("calls"), digits).alias("error_rate"))


def latest_by(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key by the order given; later lines of a log override earlier ones."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def recurring(rows: DataFrame, flag: str, case: str, least: int = 2) -> DataFrame:
    """Flags that occur in at least `least` different cases."""
    return rows.groupBy(flag).agg(F.count("*").alias("occurrences"), F.countDistinct(case).alias("cases")).where(F.col("cases") >= least)


def status_counts(rows: DataFrame, status: str, time: str) -> DataFrame:
    return rows.groupBy(status).agg(F.count("*").alias("n"), F.max(time).alias("latest"))


def run_status(failed_stages: Column, answered: Column) -> Column:
    return F.when(~answered, "failed").when(F.size(failed_stages) > 0, "degraded").otherwise("complete")


def tier_gaps(scores: DataFrame, name: str, score: str) -> DataFrame:
    """Scores from the best down, each with the gap to the next one."""
    return scores.withColumn("gap", F.round(F.col(score) - F.lead(score).over(Window.orderBy(F.col(score).desc(), name)), 6))


def failure_stage(stages: list[tuple[str, Column]], in_gold: Column, in_db: Column) -> Column:
    """The first stage that lost the gold evidence; stages: name of the loss and whether the gold was still there after it."""
    out = F.when(~in_gold, "unknown").when(~in_db, "db_missing_gold")
    for name, there in stages:
        out = out.when(~there, name)
    return out.otherwise("not_a_retrieval_failure")


def workflow(calls: DataFrame, case: str, tool: Column, accepted: Column, budget: Column) -> DataFrame:
    """Per case: calls, tools as `name:count` in order, distinct accepted ids, budget used and its largest value."""
    t = calls.select(case, tool.alias("tool"), accepted.alias("id"), budget.alias("budget"))
    tools = t.groupBy(case, "tool").agg(F.count("*").alias("c")).groupBy(case).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tool", "c"))), lambda x: F.concat_ws(":", x["tool"], x["c"].cast("string"))), ",").alias("tools"))
    total = t.groupBy(case).agg(F.count("*").alias("calls"), F.countDistinct("id").alias("accepted"), F.max("budget").alias("budget"))
    return total.join(tools, case)
