"""Mergeable resampling against NumPy's, and containment joins against trials of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import metrics, resample, substrings


def test_intervals_are_close_to_resamples_of_a_fixed_size(spark):
    r = random.Random(3)
    df = spark.createDataFrame([("abc"[i % 3], int(r.random() < 0.3 + 0.2 * (i % 3)), None) for i in range(3000)], "g string, right int, x int")
    rate = F.col("right") / F.nullif(F.col("n"), F.lit(0.0))
    got = {x.g: x for x in resample.bootstrap(df, {"right": F.col("right"), "n": F.lit(1)}, rate, keys=("g",), n=1000).collect()}
    for g in "abc":
        want = metrics.bootstrap(df.where(F.col("g") == g), ["right"], lambda p: float(p["right"].mean()), n=1000).first()
        assert all(abs(got[g][k] - want[k]) < 0.006 for k in ("mean", "ci_lower", "ci_upper", "std")) and got[g].n == 1000
    # the same in whatever partitions
    assert resample.bootstrap(df.repartition(7), {"right": F.col("right"), "n": F.lit(1)}, rate, keys=("g",), n=1000).orderBy("g").collect() == [got[g] for g in "abc"]
    none = resample.bootstrap(df.limit(0), {"right": F.col("right"), "n": F.lit(1)}, rate).first()
    assert (none["n"], none["mean"]) == (0, None) and resample.bootstrap(df, {"x": F.col("x"), "y": F.col("x")}, F.col("x") / F.nullif(F.col("y"), F.lit(0.0)), n=10).first()["n"] == 0


def test_intervals_cover_as_often_as_they_say(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(t, float(x)) for t in range(200) for x in rng.normal(1.0, 2.0, 60)], "t long, x double")
    out = resample.bootstrap(df, {"x": F.col("x"), "n": F.lit(1)}, F.col("x") / F.nullif(F.col("n"), F.lit(0.0)), keys=("t",), n=300)
    assert out.where("ci_lower <= 1.0 AND ci_upper >= 1.0").count() in range(176, 200)


def test_shuffled_baseline_meets_its_expectation(spark):
    rows = spark.createDataFrame([(x,) for x in "a" * 500 + "b" * 300 + "c" * 200] + [(None,)], "t string")
    got = resample.shuffled_baseline(rows, F.col("t")).first()
    assert got["n"] == 200 and got["accuracy"] == pytest.approx(0.38, abs=0.005)
    assert got["accuracy"] == pytest.approx(metrics.random_baseline(rows.where("t IS NOT NULL"), "t").first()["accuracy"], abs=0.006)


def test_containment_equals_all_pairs(spark):
    r = random.Random(8)
    made = lambda lo, hi: "".join(r.choice("abcé ") for _ in range(r.randint(lo, hi)))
    texts = [(i, made(0, 60)) for i in range(120)] + [(900, None), (901, ""), (902, "abc"), (903, "abc")]
    needles = [(i, made(0, 6)) for i in range(150)] + [(900, None), (901, "zzz"), (902, "abc"), (903, "abc")]
    got = substrings.containing(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(needles, "needle_id long, needle string"))
    rows = [tuple(x) for x in got.collect()]
    assert sorted(rows) == sorted((n, t) for n, needle in needles if needle for t, text in texts if text is not None and needle in text)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert substrings.containing(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame([(1, "")], "needle_id long, needle string")).count() == 0


def test_containment_of_a_hundred_thousand_by_a_hundred_thousand(spark):
    texts = spark.range(100_000).select(F.col("id").alias("text_id"), F.concat(F.md5(F.col("id").cast("string")), F.lit(" tail")).alias("text"))
    needles = spark.range(100_000).select(F.col("id").alias("needle_id"), F.substring(F.md5(F.col("id").cast("string")), 5, 20).alias("needle"))
    got = substrings.containing(texts, needles)
    assert got.where("needle_id = text_id").count() == 100_000 == got.count()
