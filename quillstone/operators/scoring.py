"""Model scoring as a plug-in: any function of (queries, texts) -> scores runs over Arrow batches; rules are the default."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Scorer = Callable[[list[str], list[str]], list[float]]


def score_pairs(pairs: DataFrame, make: Callable[[], Scorer], batch: int = 8, query: str = "query", text: str = "text") -> DataFrame:
    """Adds `model_score`. make() loads the model once for each partition's stream of batches."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorer = make()
        for q, t in batches:
            out: list[float] = []
            for i in range(0, len(q), batch):
                out += scorer(q.iloc[i : i + batch].tolist(), t.iloc[i : i + batch].tolist())
            yield pd.Series(out, dtype="float64")

    return pairs.withColumn("model_score", scored(F.col(query), F.col(text)))


def encode(rows: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], text: str = "text", batch: int = 128) -> DataFrame:
    """Adds `embedding` (float array) from an encoder that is loaded once for each partition's stream."""

    @F.pandas_udf("array<float>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for t in batches:
            out: list[list[float]] = []
            for i in range(0, len(t), batch):
                out += [list(map(float, v)) for v in model(t.iloc[i : i + batch].fillna("").tolist())]
            yield pd.Series(out)

    return rows.withColumn("embedding", encoded(F.col(text)))


def rerank(hits: DataFrame, pointer: Column, score: Column, top_k: int, keys: tuple[str, ...] = ("query_id",), pointer_cap: float = 0.15) -> DataFrame:
    """Best hits; lists of citations go last with a capped score, knowledge hits are never reranked (filter them before)."""
    s = hits.withColumn("rerank_score", F.when(pointer, F.least(score, F.lit(pointer_cap))).otherwise(score)).withColumn("_p", pointer.cast("int"))
    w = Window.partitionBy(*keys).orderBy("_p", F.round("rerank_score", 9).desc(), "id")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).drop("_p")
