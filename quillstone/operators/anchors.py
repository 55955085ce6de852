"""Gold anchors of cases, and the search from gold texts back to the chunks that cover them.

A chunk covers a gold text if it contains 0.35 of the text's distinct terms, or one of its dates and one of its outcomes
(assembly.gold_overlap). A chunk that holds `need` of n terms holds one of any n - need + 1 of them; so only that many of
each text's terms, the longest, are looked up in all chunks by the dictionary of substrings.containing, and what they meet
is compared in full. Nothing is tried on every pair and no covering chunk is lost.

Edge cases: cases that are no JSON object have neither anchors nor texts; blank texts and values (empty, 0, false, null)
count for nothing; a gold text without terms is covered by its date and outcome only; null chunks cover nothing; repeated
gold texts of a case count once.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import stored
from . import products
from .assembly import LEAST_SHARE, gold_marks, marks_overlap, plain_dates
from .sizes import broadcast_up_to
from .substrings import containing, found_needles

#: Where a case names its anchors and its gold texts, and how many candidates a case keeps.
ANCHORED, TEXTS, REASON = ("gold_citations", "gold_evidence", "gold_evidence_groups"), ("key_evidence_items", "evidence_items", "gold_evidence_texts"), "benefit_rebalance_reason"
MOST = 60
#: Values that count for nothing, as text; a text that reads like them, but for the empty one, counts.
NOTHING = ("", "0", "0.0", "false", "[]", "{}")
#: So many distinct terms of gold texts go to every task, and so many of their hits are broadcast to chunks.
MOST_TERMS = 200_000


def _list(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _value(v: Column, name: str) -> Column:
    """A field as text; null where it is missing or counts for nothing (the text "0" is no number and counts)."""
    got, inner = F.try_variant_get(v, f"$.{name}", "string"), F.try_variant_get(v, f"$.{name}", "variant")
    return F.when((F.schema_of_variant(inner) == "STRING") & (got != "") | ~got.isin(*NOTHING), got)


def gold_anchors(cases: DataFrame) -> DataFrame:
    """case_id, kind (chunk_id, doc_id, pmid, group_id), value: what a case names as its gold, each once.

    cases: case_id, body (JSON text). A plain text in a list is a chunk; members of a group count like itself."""
    # Objects become maps, as a path that leads nowhere costs Spark an exception each time. What names an anchor, then each
    # name, is a row of its own: nothing is looked up in lambda functions, and only what is there becomes text.
    of = lambda m, n: F.try_element_at(m, F.lit(n))
    fields = lambda v: F.try_variant_get(v, "$", "map<string,variant>")
    m = cases.select("case_id", fields(F.try_parse_json("body")).alias("m")).select("case_id", "m", fields(of(F.col("m"), "ground_truth")).alias("truth"))
    rows = m.select("case_id", F.explode(F.concat(*(_list(of(F.col(at), n), "$") for at in ("m", "truth") for n in ANCHORED))).alias("row"))
    rows = rows.withColumn("m", fields(F.col("row"))).select("case_id", "row", "m", _list(of(F.col("m"), "members"), "$").alias("members"))
    inner = F.when(F.size("members") > 0, F.col("members")).otherwise(_list(of(F.col("m"), "citations"), "$"))
    v, outer = F.col("v"), F.col("pos") == 0
    rows = rows.select("case_id", F.posexplode(F.concat(F.array("row"), inner)).alias("pos", "v")).withColumn("m", fields(v))
    rows = rows.withColumn("is_text", outer & F.col("m").isNull() & (F.schema_of_variant("v") == "STRING"))
    names = [of(F.col("m"), n) for n in ("chunk_id", "doc_id", "pmid")]
    plain, group = F.when(F.col("is_text"), v), F.when(outer, of(F.col("m"), "group_id"))
    named = F.array(*(F.struct(F.lit(n).alias("kind"), x.alias("v"), F.col("is_text").alias("plain")) for n, x in zip(("chunk_id", "chunk_id", "doc_id", "pmid", "group_id"), (plain, *names, group), strict=True)))
    found = rows.select("case_id", F.explode(named).alias("a")).select("case_id", "a.*").where(v.isNotNull())
    found = found.select("case_id", "kind", F.try_variant_get(v, "$", "string").alias("value"), F.when(~F.col("plain"), v).alias("v"))
    counts = ~F.col("value").isin(*NOTHING) | (F.col("value") != "") & (F.coalesce(F.schema_of_variant("v"), F.lit("STRING")) == "STRING")
    return found.where(counts).select("case_id", "kind", "value").distinct()


def present(anchors: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """The anchors that the index knows. chunks: chunk_id; documents: doc_id, pmid."""
    known = [chunks.select(F.lit("chunk_id").alias("kind"), F.col("chunk_id").cast("string").alias("value"))]
    known += [documents.select(F.lit(n).alias("kind"), F.col(n).cast("string").alias("value")) for n in ("doc_id", "pmid")]
    return anchors.join(known[0].unionByName(known[1]).unionByName(known[2]), ["kind", "value"], "left_semi").select("case_id", "kind", "value")


def gold_texts(cases: DataFrame) -> DataFrame:
    """case_id, pos, text: the descriptions of a case's gold evidence, each once, in their order; never its outcome label."""
    v, strip = F.try_parse_json("body"), lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    items = F.transform(F.concat(*(_list(v, f"$.ground_truth.{n}") for n in TEXTS)), lambda x: F.try_variant_get(x, "$", "string"))
    said = F.transform(F.concat(items, F.array(_value(v, f"ground_truth.{REASON}"))), strip)
    return cases.select("case_id", F.posexplode(F.array_distinct(F.filter(said, lambda x: F.coalesce(x, F.lit("")) != ""))).alias("pos", "text"))


def covering(golds: DataFrame, chunks: DataFrame) -> DataFrame:
    """gold_id, id, lexical, date_hit, outcome_hit: all chunks that cover a gold text. golds: gold_id, text; chunks: id, text."""
    marks = stored(golds.where(F.col("text").isNotNull()).select("gold_id", gold_marks(F.col("text")).alias("m")), "gold-marks")
    n = F.size("m.terms")
    longest = F.array_sort(F.transform("m.terms", lambda t: F.struct((-F.length(t)).alias("n"), F.lower(t).alias("t"))))
    first = F.slice(longest, F.lit(1), F.greatest(F.lit(0), n - F.ceil(LEAST_SHARE * n - 1e-9).cast("int") + 1))
    terms = marks.where(n > 0).select("gold_id", F.explode(F.array_distinct(F.transform(first, lambda x: x["t"]))).alias("needle"))
    dates = marks.where(F.size("m.outcomes") > 0).select("gold_id", F.explode(F.array_distinct(F.transform("m.dates", plain_dates))).alias("needle"))
    met = None
    for wanted, text in ((terms, F.lower("text")), (dates, plain_dates(F.col("text")))):
        wanted = stored(wanted, "gold-needles")
        pairs = containing(chunks.select(F.col("id").alias("text_id"), text.alias("text")), wanted.select(F.col("needle").alias("needle_id"), "needle").distinct())
        pairs = pairs.join(wanted.withColumnRenamed("needle", "needle_id"), "needle_id").select("gold_id", F.col("text_id").alias("id"))
        met = pairs if met is None else met.unionByName(pairs)
    rows = met.distinct().join(marks, "gold_id").join(chunks.select("id", "text"), "id")
    # a generator, so that the comparison is made once and not for each column that reads it
    rows = rows.select("gold_id", "id", F.inline(F.array(marks_overlap(F.col("m"), F.col("text")))))
    return rows.where("passes").select("gold_id", "id", "lexical", "date_hit", "outcome_hit")


def first_covering(golds: DataFrame, chunks: DataFrame, most: int = MOST) -> DataFrame:
    """covering(), but of each gold text only the first `most` chunks by share of terms, then by id: no pair of a text and a
    chunk is listed before it is known to be among them, and chunks are never shuffled.

    Each chunk's terms are found where it is read, and their shares are products with the terms of the gold texts. Chunks that
    pass by date and outcome alone are listed for the texts that have both. Gold texts of very many terms, whose shares could
    be equal once rounded, or more terms than a task should know are left to covering()."""
    marks = stored(golds.where(F.col("text").isNotNull()).select("gold_id", gold_marks(F.col("text")).alias("m")), "gold-marks")
    terms = stored(marks.select("gold_id", F.size("m.terms").alias("of"), F.explode("m.terms").alias("t")).groupBy("gold_id", "of", F.lower("t").alias("term")).agg(F.count("*").alias("w")), "gold-terms")
    needles = [r["term"] for r in terms.select("term").distinct().limit(MOST_TERMS + 1).collect()]
    if len(needles) > MOST_TERMS or not terms.where("of > 4000").isEmpty():
        return covering(golds, chunks)
    spark = chunks.sparkSession
    known = spark.createDataFrame(pa.table({"term": pa.array(needles, pa.string()), "key": pa.array(range(len(needles)), pa.int32())}))
    asks = terms.join(F.broadcast(known), "term").groupBy("gold_id").agg(F.collect_list(F.struct("key", (F.col("w") / F.col("of")).alias("w"))).alias("e"))  # terms of a text
    held = stored(found_needles(chunks.select(F.col("id").alias("text_id"), F.lower("text").alias("text")), needles).where(F.size("keys") > 0), "gold-held")
    rows = held.select(F.col("text_id").alias("id"), "keys", F.transform("keys", lambda _: F.lit(1.0)).alias("vals"))
    asks = stored(asks.select(F.col("gold_id").alias("query_id"), F.col("e.key").alias("keys"), F.col("e.w").alias("vals")), "gold-asks")
    best = products.best(rows, asks, top_k=most, least=LEAST_SHARE - 1e-9).select(F.col("query_id").alias("gold_id"), "id")
    both = marks.where((F.size("m.outcomes") > 0) & (F.size("m.dates") > 0))
    if not both.isEmpty():
        dates = stored(both.select("gold_id", F.explode(F.array_distinct(F.transform("m.dates", plain_dates))).alias("needle")), "gold-dates")
        pairs = containing(chunks.select(F.col("id").alias("text_id"), plain_dates(F.col("text")).alias("text")), dates.select(F.col("needle").alias("needle_id"), "needle").distinct())
        best = best.unionByName(pairs.join(dates, F.col("needle_id") == F.col("needle")).select("gold_id", F.col("text_id").alias("id")))
    found = broadcast_up_to(stored(best.distinct(), "gold-found"), MOST_TERMS)
    rows = chunks.select("id", "text").join(found, "id").join(F.broadcast(marks) if marks.limit(10_001).count() <= 10_000 else marks, "gold_id")
    rows = rows.select("gold_id", "id", F.inline(F.array(marks_overlap(F.col("m"), F.col("text")))))
    return rows.where("passes").select("gold_id", "id", "lexical", "date_hit", "outcome_hit")


def candidates(hits: DataFrame, keys: tuple[str, ...] = ("case_id",), then: tuple[str, ...] = ("pos", "id"), most: int = MOST) -> DataFrame:
    """keys, rank and the other columns of the first hits of each case that cover their gold text: by share of terms, then by score.

    hits: keys, `then`, lexical, score of covering hits of any channels (joined to `covering`)."""
    best = Window.partitionBy(*keys).orderBy(F.col("lexical").desc(), F.round("score", 9).desc_nulls_last(), *then)
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
