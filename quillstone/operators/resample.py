"""Resampling whose parts add up: bootstrap intervals and shuffled baselines of tables of any size.

A row counts in a resample as often as a Poisson draw says. Draws of equal rows add up to a draw of their number, so rows
are first counted by what the metric reads of them, and each such cell draws once a resample. The draws of a cell come from
its own values and the seed: they are the same in whatever task they are made, and made again if an executor is lost. Sums of
a resample merge by addition; only they, `n` rows, meet for the percentiles.

Against resamples of a fixed size, Poisson ones vary in size as well: for means and rates over m rows, interval ends differ
by an amount of order 1 / m, beside the noise of n draws, of order 1 / sqrt(n) of the interval's width.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _generator(seed: int, values: tuple) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.md5(repr((seed, values)).encode()).digest(), "big"))


def bootstrap(rows: DataFrame, parts: dict[str, Column], metric: Column, *, keys: tuple[str, ...] = (), n: int = 1000, alpha: float = 0.05, seed: int = 42, digits: int = 4) -> DataFrame:
    """keys, mean, ci_lower, ci_upper, std, n: an interval of a metric of sums.

    parts: what each row adds to each sum (nulls add nothing); metric: of columns named like the parts, which hold the sums of
    one resample. Resamples whose metric is null or no number are left out; without any, all but n (0) are null. The work
    grows with the distinct combinations of parts, of which metrics of labels have few."""
    names = list(parts)
    cells = rows.select(*keys, *(F.coalesce(c.cast("double"), F.lit(0.0)).alias(p) for p, c in parts.items())).groupBy(*keys, *names).agg(F.count("*").alias("_rows"))
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    k = len(keys)

    def draw(batches):
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for i in range(batch.num_rows):
                times = _generator(seed, tuple(c[i] for c in columns)).poisson(columns[-1][i], size=n).astype(np.float64)
                fixed = [pa.array([columns[j][i]] * n, batch.schema.field(j).type) for j in range(k)]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.arange(n), pa.int32()), *(pa.array(times * columns[k + j][i]) for j in range(len(names)))], [*keys, "_draw", *names])

    schema = ", ".join([*(f"`{x}` {kinds[x]}" for x in keys), "_draw int", *(f"`{p}` double" for p in names)])
    sums = cells.mapInArrow(draw, schema).groupBy(*keys, "_draw").agg(*(F.sum(p).alias(p) for p in names)).select(*keys, metric.alias("_m"))
    sums = sums.withColumn("_m", F.when(~F.isnan("_m"), F.col("_m")))
    at = lambda q: F.round(F.percentile("_m", F.lit(q)), digits)
    return sums.groupBy(*keys).agg(F.round(F.avg("_m"), digits).alias("mean"), at(alpha / 2).alias("ci_lower"), at(1 - alpha / 2).alias("ci_upper"), F.round(F.stddev_pop("_m"), digits).alias("std"), F.count("_m").alias("n"))


def shuffled_baseline(rows: DataFrame, truth: Column, *, n: int = 200, seed: int = 42, digits: int = 4) -> DataFrame:
    """accuracy, n: mean share of truths that meet an equal one when they are shuffled, over n shuffles; nulls are left out.

    Only how many rows each truth has matters, so shuffles are drawn from these counts, one for each label. Each label's part
    needs the labels before it in order: a table of as many rows as there are labels."""
    counts = rows.select(truth.cast("string").alias("t")).where("t IS NOT NULL").groupBy("t").agg(F.count("*").alias("c"))

    def run(key, pdf):
        import pandas as pd

        c = pdf.sort_values("t")["c"].to_numpy()
        rng, hits, total = np.random.default_rng([seed, int(key[0])]), 0, int(c.sum())
        left = c.copy()
        for i, size in enumerate(c):
            got = rng.multivariate_hypergeometric(left, int(size), method="marginals")
            hits, left = hits + int(got[i]), left - got
        return pd.DataFrame({"share": [hits / total]})

    # a shuffle is a task's work, not all of them
    each = counts.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return each.groupBy("draw").applyInPandas(run, "share double").agg(F.round(F.avg("share"), digits).alias("accuracy"), F.count("*").alias("n"))
