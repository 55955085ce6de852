"""Sources mixed to target weights by Pareto order sampling.

Every source has a target in words. Its documents first get the certain whole copies that all of them get, the whole
part of target / source size. What is left, the gap, is sampled: each document has an inclusion probability p and a
random number u from its id, and documents are ranked by (u / (1 - u)) / (p / (1 - p)), Pareto order sampling (Rosen
1997). Probabilities are unequal: p = t min(1, long / size), times the document's own weight over its source's largest
if there are weights. So documents of up to `long` words have equal chances, and a longer one's fall as its size grows:
the words it is expected to bring stay those of a document of `long` words, and no few of them make up the mix. `long` is
the least doubling of the source's mean size with which the expected words reach the gap at a t of 1 or less; t makes
them equal to it. A document larger than the gap cannot be taken and has probability 0.
The sample is fixed in size, which is counted in words: from the top of the ranking, as many as fit in the gap. Two more
passes close what is left, less than one document, with the next ones that are small enough.

No rank over a whole source is ever made in one task: documents fall in buckets of the ranking, word sums of buckets
are added up, and only the bucket at which the words run out is ranked one by one. All that leaves the executors is one
row a source with its cuts, against which each document is then held, wherever it lies.

Rows: null or empty texts have size 0 and take nothing; a null source is a source of its own, the last; repeated rows
share their number and are taken or left together, so a cut may be passed by repeats of one row; equal ranks go by
document id, then size; an empty table gives an empty result; other columns are kept by copies() and ignored by mix().
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, uniform

#: Documents in a bucket of the ranking, about.
BUCKET = 1000
#: Doublings of the mean size that `long` is looked for among.
DOUBLINGS = 21
STATE = ("source", "source_size", "target", "whole", "gap_words")
CHANCES = ("long", "odds", "most_weight")


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, *, share: float, weights: tuple[float, ...], cap: float) -> DataFrame:
    """source, source_size -> + target. Shares by weight, none above cap times its size, the excess reshared by weight.

    The sources that end at their cap are the first ones by cap / weight for which what is left, shared by the weights
    left, is still above their cap.
    """
    cycle = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    s = sizes.withColumn("w", cycle).withColumn("most", cap * F.col("source_size"))
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    s = s.withColumn("left", share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("level", F.col("left") / F.sum("w").over(after))
    s = s.withColumn("full", F.col("level") * F.col("w") >= F.col("most"))
    first = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)  # that of the first source below its cap
    return s.select("source", "source_size", F.when(F.col("full"), F.col("most")).otherwise(first * F.col("w")).alias("target"))


def _inclusion(size: str = "size", weight: str = "weight", of: str = "") -> Column:
    """The probability that the gap's sample takes a document; null where nothing is sampled."""
    p = F.col(f"{of}odds") * F.least(F.lit(1.0), F.col(f"{of}long") / F.col(size)) * (F.col(weight) / F.col(f"{of}most_weight"))
    return F.when((F.col(f"{of}gap_words") > 0) & (F.col(size) > 0) & (F.col(size) <= F.col(f"{of}gap_words")), F.least(p, F.lit(1 - 1e-9)))


def _rank(p: Column, u: str = "u") -> Column:
    """Place in the ranking, from 0 to 1: odds x as x / (1 + x)."""
    odds = F.col(u) / (1 - F.col(u)) * ((1 - p) / p)
    return F.when(p > 0, odds / (1 + odds))


def _chances(base: DataFrame, state: DataFrame) -> DataFrame:
    """state with long, odds (t) and most_weight of each source."""
    means = base.groupBy(F.col("source").alias("source_of")).agg(F.count(F.when(F.col("size") > 0, 1)).alias("n"), F.max("weight").alias("most_weight"))
    state = state.join(means, F.col("source").eqNullSafe(F.col("source_of"))).drop("source_of")
    long = lambda j: F.ceil(F.col("source_size") / F.nullif(F.col("n"), F.lit(0)) * F.lit(float(1 << j))).cast("long")
    rows = _with_state(base, state).where((F.col("size") > 0) & (F.col("size") <= F.col("gap_words")))
    mass = rows.groupBy(F.col("source").alias("source_of")).agg(*(F.sum(F.least(F.col("size"), long(j)) * (F.col("weight") / F.col("most_weight"))).alias(f"mass{j}") for j in range(DOUBLINGS)))
    state = state.join(mass, F.col("source").eqNullSafe(F.col("source_of")), "left").drop("source_of")
    levels = F.array(*(F.struct(long(j).alias("long"), F.col(f"mass{j}").alias("mass")) for j in range(DOUBLINGS)))
    level = F.coalesce(F.get(F.filter(levels, lambda x: x["mass"] >= F.col("gap_words")), 0), F.element_at(levels, -1))
    state = state.withColumn("level", level)
    return state.select(*STATE, F.col("level.long").alias("long"), F.least(F.lit(1.0), F.col("gap_words") / F.col("level.mass")).alias("odds"), "most_weight")


def plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, share: float = 1.5, weights: tuple[float, ...] = (3.0, 1.0, 2.0), cap: int = 2, seed: int = 17, passes: int = 3) -> tuple[DataFrame, DataFrame]:
    """(a row for each document with its size, one row for each source with target, whole copies and cuts)."""
    base = stored(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), uniform(F.col(id_col), seed).alias("u"), (F.col(weight_col) if weight_col else F.lit(1.0)).cast("double").alias("weight")),
        "mix-sizes",
    )
    state = targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), share=share, weights=weights, cap=cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = state.withColumn("whole", F.floor(rate).cast("int")).withColumn("gap_words", F.col("target") - F.floor(rate) * F.col("source_size"))
    state = _chances(base, state).withColumn("gap", F.col("gap_words"))
    state = stored(state.withColumn("cuts", F.expr("cast(array() as array<struct<most:double,cut:struct<rank:double,doc_id:bigint,size:bigint>>>)")), "mix-state")
    buckets = 1 << max(6, math.ceil(math.log2(max(1, base.count()) / BUCKET)))
    for _ in range(passes):
        state = stored(_fill(base, state, buckets), "mix-state")
    return base, state


def _with_state(rows: DataFrame, state: DataFrame) -> DataFrame:
    s = state.withColumnRenamed("source", "source_of")
    return rows.join(s, F.col("source").eqNullSafe(F.col("source_of"))).drop("source_of")


def _taken() -> Column:
    key = F.struct(F.col("rank"), F.col("doc_id").cast("long").alias("doc_id"), F.col("size"))
    return F.col("rank").isNotNull() & F.exists("cuts", lambda c: (F.col("size") <= c["most"]) & (key <= c["cut"]))


def _cut(rank: Column) -> Column:
    return F.struct(rank.alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("size"))


def _fill(base: DataFrame, state: DataFrame, buckets: int) -> DataFrame:
    """One more cut for each source: from the top of the ranking, as many of the documents that are left and no larger than the gap as fit in it."""
    rows = _with_state(base, state).withColumn("rank", _rank(_inclusion())).where((F.col("size") > 0) & (F.col("size") <= F.col("gap")) & F.col("rank").isNotNull())
    rows = rows.where(~_taken()).select("source", "doc_id", "size", "rank", "gap", F.floor(F.col("rank") * buckets).alias("bucket"))
    sums = rows.groupBy("source", "bucket", "gap").agg(F.sum("size").alias("total"))
    run = Window.partitionBy("source").orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("total").over(run)).withColumn("before", F.col("upto") - F.col("total"))
    last = sums.groupBy("source").agg(F.min(F.when(F.col("upto") > F.col("gap"), F.struct("bucket", "before"))).alias("at"), F.max("upto").alias("all"))
    # the bucket where the words run out, document by document
    edge = last.where("at is not null").select(F.col("source").alias("source_of"), F.col("at.bucket").alias("bucket_of"), "at.before")
    edge = rows.join(edge, F.col("source").eqNullSafe(F.col("source_of")) & (F.col("bucket") == F.col("bucket_of")))
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size")
    edge = edge.withColumn("upto", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).where("upto <= gap")
    edge = edge.groupBy(F.col("source").alias("source_e")).agg(F.max(F.struct("rank", "doc_id", "size")).alias("edge"), F.max("upto").alias("edge_used"))
    ends = last.join(edge, F.col("source").eqNullSafe(F.col("source_e")), "left").select(
        F.col("source").alias("source_of"),
        F.when(F.col("at").isNull(), _cut(F.lit(2.0))).otherwise(F.coalesce(F.col("edge"), _cut(F.col("at.bucket") / F.lit(float(buckets))))).alias("cut"),
        F.when(F.col("at").isNull(), F.col("all")).otherwise(F.coalesce(F.col("edge_used"), F.col("at.before"))).alias("used"),
    )
    s = state.join(ends, F.col("source").eqNullSafe(F.col("source_of")), "left")
    cut = F.array(F.struct(F.col("gap").alias("most"), F.col("cut").alias("cut")))
    return s.select(*STATE, *CHANCES, (F.col("gap") - F.coalesce("used", F.lit(0))).alias("gap"), F.when(F.col("used").isNotNull(), F.concat("cuts", cut)).otherwise(F.col("cuts")).alias("cuts"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target (of its source), inclusion (the probability that
    the sample beyond the whole copies takes it), copies, taken (words)."""
    base, state = plan(docs, **options)
    rows = _with_state(base, state).withColumn("p", _inclusion()).withColumn("rank", _rank(F.col("p")))
    copies = F.col("whole") + F.when(_taken(), 1).otherwise(0)
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("p", F.lit(0.0)).alias("inclusion"), copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_col: str | None = None, seed: int = 17, **options) -> DataFrame:
    """The documents, each as often as the mix takes it, with the columns that they had."""
    _, state = plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, weight_col=weight_col, seed=seed, **options)
    state = state.select(F.struct("source", "whole", "gap_words", *CHANCES, "cuts").alias("__mix"))
    weight = (F.col(weight_col) if weight_col else F.lit(1.0)).cast("double")
    drawn = docs.join(state, F.col(source_col).eqNullSafe(F.col("__mix.source")))
    own = F.struct(uniform(F.col(id_col), seed).alias("u"), words(F.col(text_col)).alias("size"), weight.alias("weight"))
    drawn = drawn.withColumn("__own", F.explode(F.array(own)))  # counted once, however often it is referred to
    rank = _rank(_inclusion("__own.size", "__own.weight", "__mix."), "__own.u")
    key = F.struct(rank.alias("rank"), F.col(id_col).cast("long").alias("doc_id"), F.col("__own.size").alias("size"))
    extra = F.exists("__mix.cuts", lambda c: (F.col("__own.size") <= c["most"]) & (key <= c["cut"]))
    drawn = drawn.withColumn("__n", F.col("__mix.whole") + F.when(extra & rank.isNotNull(), 1).otherwise(0)).where("__n > 0")
    return drawn.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*(F.col(f"`{c}`") for c in docs.columns))
