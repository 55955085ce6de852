"""Joins on `contains`: needles in texts, by a dictionary of n-grams instead of a trial of every pair.

A text that contains a needle has all its n-grams. Each needle is filed under its rarest one (of three characters; of all
that it has, if these are fewer), counted over the texts; texts meet needles by n-grams that some needle is filed under,
an equi join, and a pair counts once the text is found to contain the needle. Where the needles are few enough to go to every
task, texts are looked up where they are read, and no text or n-gram is shuffled.

Empty and null needles are in no text, null texts contain nothing; equal needles and texts are rows of their own.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import stored
from .products import bounded_batches
from .sizes import broadcast_up_to

WIDTH = 3


def _grams(text: Column, width: Column | int) -> Column:
    """The distinct pieces of `width` (at most WIDTH) characters of a text. Characters are parted once, as a substring would
    be counted from the start of the text each time."""
    w = F.lit(width) if isinstance(width, int) else width
    if isinstance(width, int):
        piece = lambda chars: lambda c, i: F.concat(c, *(F.coalesce(F.get(chars, i + k), F.lit("")) for k in range(1, width)))
    else:
        piece = lambda chars: lambda c, i: F.array_join(F.slice(chars, i + 1, w), "")
    pieces = F.transform(F.array(F.split(text, "")), lambda chars: F.transform(chars, piece(chars)))
    return F.array_distinct(F.filter(F.element_at(pieces, 1), lambda g: F.length(g) == w))


def finder(needles: list[str], most_words: int = 300_000):
    """text -> places of the needles that it contains. Each needle is filed under the n-gram that fewest needles have.

    A needle without white space lies within one word of a text, so what a word contains is kept for texts that come later,
    for up to `most_words` words at once."""
    grams = [{t[i : i + WIDTH] for i in range(max(1, len(t) - WIDTH + 1))} for t in needles]
    often = Counter(g for gs in grams for g in gs)

    def look_up(those: list[int]):
        filed = defaultdict(list)
        for k in those:
            filed[min(grams[k], key=lambda g: (often[g], g))].append(k)
        widths, names = sorted({len(g) for g in filed}), set(filed)
        return lambda text: [k for g in names.intersection([text[i : i + w] for w in widths for i in range(len(text) - w + 1)]) for k in filed[g] if needles[k] in text]

    spaced = [k for k, t in enumerate(needles) if any(c.isspace() for c in t)]
    in_word, in_text, seen = look_up(sorted(set(range(len(needles))) - set(spaced))), look_up(spaced), {}

    def find(text: str) -> list[int]:
        found = set(in_text(text)) if spaced else set()
        for word in set(text.split()):
            held = seen.get(word)
            if held is None:
                if len(seen) >= most_words:
                    seen.clear()
                held = seen[word] = in_word(word)
            found.update(held)
        return sorted(found)

    return find


def found_needles(texts: DataFrame, needles: list[str]) -> DataFrame:
    """text_id, keys: of each text that is not null (text_id, text) the places in `needles` of those that it contains."""

    def run(batches):
        find = finder(needles)
        for batch in batches:
            places = [find(t) if t is not None else [] for t in batch.column(1).to_pylist()]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array([k for p in places for k in p], pa.int32()))], names=["text_id", "keys"])

    bounded_batches(texts.sparkSession)
    kind = texts.schema["text_id"].dataType.simpleString()
    return texts.where("text IS NOT NULL").select("text_id", "text").mapInArrow(run, f"text_id {kind}, keys array<int>")


def containing(texts: DataFrame, needles: DataFrame, *, most_grams: int = 200_000) -> DataFrame:
    """needle_id, text_id of all pairs where the text contains the needle. texts: text_id, text; needles: needle_id, needle.

    Up to `most_grams` needles go to the tasks; more are joined."""
    wanted = stored(needles.where(F.length("needle") > 0).select("needle_id", "needle"), "needles")
    distinct = [r["needle"] for r in wanted.select("needle").distinct().limit(most_grams + 1).collect()]
    if len(distinct) > most_grams:
        return _joined(texts, wanted, most_grams)
    known = wanted.sparkSession.createDataFrame(pa.table({"needle": pa.array(distinct, pa.string()), "key": pa.array(range(len(distinct)), pa.int32())}))
    pairs = found_needles(texts, distinct).select("text_id", F.explode("keys").alias("key"))
    return pairs.join(F.broadcast(known.join(wanted, "needle").select("key", "needle_id")), "key").select("needle_id", "text_id")


def _joined(texts: DataFrame, needles: DataFrame, most_grams: int) -> DataFrame:
    """containing() for any number of needles."""
    wanted = needles.where(F.length("needle") > 0).select("needle_id", "needle", F.least(F.length("needle"), F.lit(WIDTH)).alias("width"))
    held = stored(wanted.select("needle_id", "needle", F.explode(_grams(F.col("needle"), F.col("width"))).alias("gram")), "needle-grams")
    # widths that some needle has, three numbers at most
    widths = sorted(r["w"] for r in held.select(F.length("gram").alias("w")).distinct().collect())
    if not widths:
        return texts.crossJoin(needles.limit(0)).select("needle_id", "text_id").limit(0)
    rows = texts.where("text IS NOT NULL").select("text_id", F.explode(F.concat(*(_grams(F.col("text"), w) for w in widths))).alias("gram"))
    known = broadcast_up_to(held.select("gram").distinct(), most_grams)
    rows = stored(rows.join(known, "gram", "left_semi"), "text-grams")
    often = rows.groupBy("gram").agg(F.count("*").alias("n"))
    # n-grams that no text has file their needles where nothing is found
    filed = held.join(often, "gram", "left").groupBy("needle_id", "needle").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    filed = stored(filed, "needle-filed")
    met = rows.join(broadcast_up_to(filed.select("gram").distinct(), most_grams), "gram", "left_semi").join(filed, "gram").select("needle_id", "needle", "text_id")
    return met.join(texts, "text_id").where(F.contains("text", "needle")).select("needle_id", "text_id")
