"""Query-aware excerpts: windows around a query's terms and around clinical results, chosen under a budget of characters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import normalize_text

#: What counts as a term of a query and as a clinical result; centres of terms, and gap between windows.
TERM = r"[a-z][a-z0-9_.+-]*|\d+(?:\.\d+)?|[一-鿿]{2,}"
SIGNAL = (
    r"(?iU)\b(?:orr|pfs|os|dcr|cr|pr|sd|pd|rano|recist|ctcae|csf|response|survival|toxicity|adverse|cytology|symptom|improv\w*|progress\w*)\b"
    r"|\d+(?:\.\d+)?\s*(?:%|mg|months?|weeks?|days?|年|月|周|天)"
)
CENTRES, GAP, LEAST_ROOM, LEAST_WINDOW = 40, " ... ", 40, 20

_INTS, _RANGES = "array<int>", "array<struct<s:int,e:int>>"


def query_terms(query: Column) -> Column:
    """Distinct terms of two characters or more, in the order in which a query has them."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(query), F.lit(TERM), F.lit(0)), lambda t: F.length(t) >= 2))


def _starts(low: Column, term: Column) -> Column:
    """The first CENTRES places (from 0) where a term starts, without overlaps: what lies between them adds up to them."""
    pieces = F.split(low, F.concat(F.lit(r"\Q"), term, F.lit(r"\E")), CENTRES + 1)
    step = lambda s, p: F.struct((s["at"] + F.length(p) + F.length(term)).alias("at"), F.concat(s["found"], F.array(s["at"] + F.length(p))).alias("found"))
    state = F.aggregate(F.slice(pieces, 1, F.size(pieces) - 1), F.struct(F.lit(0).alias("at"), F.array().cast(_INTS).alias("found")), step)
    return state["found"]


def _term_centres(low: Column, terms: Column) -> Column:
    """Places of the first CENTRES occurrences, those of earlier terms first, then sorted."""
    found = F.aggregate(terms, F.array().cast(_INTS), lambda s, t: F.when(F.size(s) >= CENTRES, s).otherwise(F.concat(s, F.slice(_starts(low, t), 1, CENTRES - F.size(s)))))
    return F.array_sort(found)


def _chooser(size: int) -> Callable[[Column, Column, Column], Column]:
    """(state, start, end) -> state: takes a window that no chosen one holds, cut to the room that is left, until there is none."""

    def choose(state: Column, start: Column, end: Column) -> Column:
        held = F.exists(state["chosen"], lambda r: (start >= r["s"]) & (end <= r["e"]))
        room = F.lit(size) - state["used"] - F.when(F.size(state["chosen"]) > 0, 5).otherwise(0)
        to = F.least(end, start + room)
        over = state["over"] | (~held & (room <= LEAST_ROOM))
        take = ~over & ~held & (to - start > LEAST_WINDOW)
        chosen = F.when(take, F.concat(state["chosen"], F.array(F.struct(start.cast("int").alias("s"), to.cast("int").alias("e"))))).otherwise(state["chosen"])
        return F.struct(chosen.alias("chosen"), F.when(take, state["used"] + (to - start)).otherwise(state["used"]).cast("int").alias("used"), over.alias("over"))

    return choose


def query_excerpt(text: Column, query: Column, most: int = 1200) -> Column:
    """At most `most` characters of a text: all of it where it is short enough; else its head and the windows around the
    query's terms, then around clinical results, in the order of the text.

    Windows of terms go before those of results, then by place; a window inside a chosen one is passed over. Places are
    found by what lies between matches and are never listed for results, so that a text of very many results costs one
    pass over them. A null text or query gives null and a plain head."""
    lead, radius = min(180, most // 4), max(90, min(220, most // 5))
    choose = _chooser(most)

    def excerpt(norm: Column) -> Column:
        n = F.length(norm)
        window = lambda state, c: choose(state, F.greatest(F.lit(0), c - radius), F.least(n, c + radius))
        state = F.struct(F.array().cast(_RANGES).alias("chosen"), F.lit(0).alias("used"), F.lit(False).alias("over"))
        state = choose(state, F.lit(0), F.lit(lead))
        state = F.aggregate(_term_centres(F.lower(norm), F.coalesce(query_terms(query), F.array().cast("array<string>"))), state, window)
        # what lies before each result, and the result itself, move the place along
        pieces, results = F.split(norm, SIGNAL, -1), F.regexp_extract_all(norm, F.lit(SIGNAL), F.lit(0))
        moves = F.zip_with(F.transform(pieces, lambda p: F.length(p)), F.transform(results, lambda r: F.length(r)), lambda p, r: F.struct(p.alias("before"), r.alias("long")))

        def step(s: Column, m: Column) -> Column:
            at = s["at"] + m["before"]
            return F.struct(F.when(s["state"]["over"] | m["long"].isNull(), s["state"]).otherwise(window(s["state"], at)).alias("state"), (at + F.coalesce(m["long"], F.lit(0))).alias("at"))

        chosen = F.aggregate(moves, F.struct(state.alias("state"), F.lit(0).alias("at")), step)["state"]["chosen"]
        cut = F.array_join(F.transform(F.array_sort(chosen), lambda r: F.trim(F.substring(norm, r["s"] + 1, r["e"] - r["s"]))), GAP)
        cut = F.when(F.length(cut) > most, F.concat(F.rtrim(F.substring(cut, 1, most - 3)), F.lit("..."))).otherwise(cut)
        head_only = (F.size(chosen) == 1) & (F.element_at(chosen, 1)["s"] == 0)
        return F.when(n <= most, norm).when(head_only, F.concat(F.substring(norm, 1, most - 3), F.lit("..."))).otherwise(cut)

    # one element each, so that the normalised text is made once however often it is referred to
    return F.element_at(F.transform(F.array(normalize_text(text)), excerpt), 1)
