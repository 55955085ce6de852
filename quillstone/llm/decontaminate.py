"""Benchmark decontamination: every passage of every document asks a BM25 index of the test items.

A document is cut into overlapping passages twice as long as the longest item, so each item that a document holds lies
whole in one. A passage's distinct words are the query; an item is retrieved if its BM25 score reaches `retrieve` times
the score that the item's own words would give it. All such items are found, with block-max pruning:
- weights are held as shares of the item's threshold, so an item is retrieved at a sum of 1;
- per item, the words of least weight that together stay below `SPARE` are not essential: a passage needs the rest of
  the sum from the others, so only the others' postings are read at first;
- postings are grouped in blocks of items with the largest weight of each word in the block; a block is passed over
  where the sum of these, with all that words which are not essential could add, stays below 1;
- so is an item of the blocks left, by its own weights; what is still left is scored in full.
What is retrieved is verified: the passage must hold the share `verify` of the word n-grams of the item's question (first
line) and of its answer (the other lines), of each by itself; a part without words is not asked for.

The index is built from all items in shards, with document frequencies over all items, and each shard is broadcast by
itself; so the result does not depend on the number of shards. A shard is flat arrays and one dictionary of its words, at
most `BYTES_WORD` a word of its items and `BYTES_TERM` a distinct word; shards are as many as keep that below `index_bytes`.
n-grams are 64-bit hashes of word numbers.

Rows: a null or empty text has no passage, a null or wordless item is never retrieved; items or parts shorter than n
words count as one n-gram; repeated documents each get their rows, repeated items theirs; empty tables give an empty
result; other columns are ignored. Very long texts are cut into passages like any other, none is left out.
"""

from __future__ import annotations

import math
import re
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_text, stored, text_batches

K1, B = 1.2, 0.75
_WORD = re.compile(r"\w+")
SCHEMA = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, overlap double"
SPARE, VERIFY = 0.25, 0.6
#: Words of documents that are looked up together.
CHUNK = 200_000
#: Bytes of an index for each word of its items and for each distinct one (its text, a number, a slot of the dictionary).
BYTES_WORD, BYTES_TERM = 44, 180


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams(tokens: list[str], n: int) -> list[tuple[str, ...]]:
    return [tuple(tokens[i : i + n]) for i in range(max(1, len(tokens) - n + 1))] if tokens else []


def split_item(text: str) -> tuple[list[str], list[str]]:
    question, _, answer = text.strip().partition("\n")
    return words(question), words(answer)


def _hashes(ids: np.ndarray, m: int) -> np.ndarray:
    """64-bit hashes of all runs of m word numbers."""
    ids, h = ids.astype(np.uint64), np.full(max(0, len(ids) - m + 1), m, dtype=np.uint64)
    for k in range(m):
        h = (h ^ (ids[k : k + len(h)] + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


class Index:
    """Postings of one shard. items: (item_id, text); df, n, mean: statistics of all items."""

    def __init__(self, items, df: dict[str, int], n: int, mean: float, retrieve: float, gram: int, block: int = 16, longest: int | None = None):
        self.gram, self.block = gram, block
        self.vocabulary: dict[str, int] = {}
        number = lambda text: np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in text], dtype=np.int32)
        kept = [(i, number(q), number(a)) for i, t in items for q, a in [split_item(t)] if q or a]
        kept.sort(key=lambda x: (len(x[1]) + len(x[2]), str(x[0])))  # like lengths together: tighter blocks
        self.ids = [x[0] for x in kept]
        # n-grams of question and answer of each item, sorted; those of part p stand at gram_at[p] to gram_at[p + 1].
        parts = [np.unique(_hashes(p, min(gram, len(p)))) if len(p) else np.empty(0, np.uint64) for _, q, a in kept for p in (q, a)]
        self.grams, self.gram_at = _flat(parts, np.uint64)
        # Passages follow the longest item of the whole benchmark, of which these may be a shard.
        self.longest = longest or max((len(q) + len(a) for _, q, a in kept), default=1)
        idf = np.array([math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) for t in self.vocabulary])
        terms, weights, limits, spare, essential, shares = [], [], [], [], [], []
        for _, q, a in kept:
            tids, tf = np.unique(np.concatenate([q, a]), return_counts=True)
            w = idf[tids] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * (len(q) + len(a)) / mean))
            limit = retrieve * w.sum()
            share = w / limit
            order = np.argsort(share, kind="stable")
            rest = np.cumsum(share[order]) < SPARE
            essential.append(tids[order[~rest]]), shares.append(share[order[~rest]]), spare.append(share[order[rest]].sum())
            terms.append(tids), weights.append(w), limits.append(limit)
        self.all_terms, self.term_at = _flat(terms, np.int32)
        self.all_weights, _ = _flat(weights, np.float64)
        self.limits, self.spare = np.array(limits), np.array(spare)
        self.needs = np.array([1 - max(spare[b : b + block]) for b in range(0, len(kept), block)]) if kept else np.ones(1)
        # Postings by word: items and shares of their thresholds, rounded up, as they bound scores from above.
        owner, at = _flat(essential, np.int32)
        item = np.repeat(np.arange(len(kept), dtype=np.int32), np.diff(at))
        order = np.argsort(owner, kind="stable")
        owner, self.items = owner[order], item[order]
        self.shares = np.nextafter(_flat(shares, np.float32)[0][order], np.float32(np.inf))
        counts = np.bincount(owner, minlength=len(self.vocabulary) + 1)  # the last: unknown words
        self.at = np.concatenate([[0], np.cumsum(counts)])
        # The largest share of each word in each block.
        cells, inverse = np.unique(owner.astype(np.int64) * len(self.needs) + self.items // block, return_inverse=True)
        self.most = np.zeros(len(cells), dtype=np.float32)
        np.maximum.at(self.most, inverse, self.shares)
        self.blocks = (cells % len(self.needs)).astype(np.int32)
        self.block_at = np.searchsorted(cells, np.arange(len(counts) + 1) * len(self.needs))
        self.essential = counts > 0

    @property
    def terms(self) -> list[np.ndarray]:
        return np.split(self.all_terms, self.term_at[1:-1])

    @property
    def weights(self) -> list[np.ndarray]:
        return np.split(self.all_weights, self.term_at[1:-1])

    def held(self, item: int, grams: np.ndarray) -> tuple[list[int], list[int]]:
        """(how many n-grams of the question and of the answer are among some sorted ones; how many each has)."""
        parts = [self.grams[self.gram_at[p] : self.gram_at[p + 1]] for p in (2 * item, 2 * item + 1)]
        return [int(_among(p, grams).sum()) for p in parts], [len(p) for p in parts]

    def search(self, docs: list[list[str]], verify: float) -> list[tuple[int, int, float, float | None, float | None, float]]:
        """(number of the document, item, score, overlaps) of the best passage for each item that a document is found to hold."""
        step, unknown = self.longest, len(self.vocabulary)
        get = self.vocabulary.get
        lengths = np.array([len(d) for d in docs])
        tids = np.fromiter((get(w, unknown) for d in docs for w in d), dtype=np.int64, count=int(lengths.sum()))
        per = np.maximum(1, -(-lengths // step))
        first = np.concatenate([[0], np.cumsum(per)])
        hit = np.flatnonzero(self.essential[tids])
        if not len(hit):
            return []
        starts = np.concatenate([[0], np.cumsum(lengths)])
        doc = np.searchsorted(starts, hit, "right") - 1
        at = (hit - starts[doc]) // step
        passage = np.concatenate([first[doc] + at, (first[doc] + at - 1)[at > 0]])  # passage j has the words of steps j and j + 1
        term = np.concatenate([tids[hit], tids[hit][at > 0]])
        key = np.unique(passage * (unknown + 1) + term)
        passage, term = key // (unknown + 1), key % (unknown + 1)
        # Blocks that could hold an item, then items that could reach their threshold.
        where, n = _expand(self.block_at, term)
        cell, inverse = np.unique(np.repeat(passage, n) * len(self.needs) + self.blocks[where], return_inverse=True)
        cell = cell[np.bincount(inverse, weights=self.most[where]) >= self.needs[cell % len(self.needs)] * (1 - 1e-9)]
        if not len(cell):
            return []
        near = np.isin(passage, np.unique(cell // len(self.needs)))
        passage, term = passage[near], term[near]
        where, n = _expand(self.at, term)
        owner, item = np.repeat(passage, n), self.items[where]
        near = np.isin(owner * len(self.needs) + item // self.block, cell)
        pair, inverse = np.unique(owner[near] * len(self.ids) + item[near], return_inverse=True)
        pair = pair[np.bincount(inverse, weights=self.shares[where][near]) + self.spare[pair % len(self.ids)] >= 1 - 1e-9]
        best: dict[tuple[int, int], tuple] = {}
        for p, group in _runs(pair // max(1, len(self.ids)), pair % max(1, len(self.ids))):
            d = int(np.searchsorted(first, p, "right")) - 1
            a = (p - int(first[d])) * step
            said = tids[starts[d] + a : min(starts[d] + a + 2 * step, starts[d + 1])]
            here, held = np.unique(said), None
            for k in group:
                own = slice(self.term_at[k], self.term_at[k + 1])
                score = float(self.all_weights[own][_among(self.all_terms[own], here)].sum())
                if score < self.limits[k]:
                    continue
                if held is None:  # unknown words have a number that no item has, so their n-grams are in none
                    held = np.unique(np.concatenate([_hashes(said, m) for m in range(1, self.gram + 1)]))
                found, of = self.held(k, held)
                q, an = (x / y if y else None for x, y in zip(found, of, strict=True))
                if any(x is not None and x < verify for x in (q, an)):
                    continue
                both = sum(found) / sum(of)
                if (d, k) not in best or (both, score) > (best[d, k][3], best[d, k][0]):
                    best[d, k] = (score, q, an, both)
        return [(d, self.ids[k], *x) for (d, k), x in best.items()]


def _flat(arrays: list[np.ndarray], dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all values in a row, where each array starts and ends in it)."""
    flat = np.concatenate(arrays).astype(dtype) if arrays else np.empty(0, dtype)
    return flat, np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int64)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among sorted ones."""
    at = np.searchsorted(known, values)
    return (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == values) if len(known) else np.zeros(len(values), dtype=bool)


def _expand(at: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of all postings of the terms, how many each has)."""
    n = at[term + 1] - at[term]
    return np.repeat(at[term] - (np.cumsum(n) - n), n) + np.arange(n.sum()), n


def _runs(keys: np.ndarray, values: np.ndarray):
    """(key, its values) for sorted keys."""
    cuts = np.flatnonzero(np.diff(keys)) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
        if j > i:
            yield int(keys[i]), values[i:j].tolist()


def leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", verify: float = VERIFY, **options) -> DataFrame:
    """A row for each document and item that it holds: the best passage's BM25 score and overlaps of question, answer and both."""
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = [_search(text, index, verify) for index in _indexes(items, **options)]
    return reduce(DataFrame.unionAll, found)


def _indexes(items: DataFrame, *, item_col: str = "item_id", item_text_col: str = "text", retrieve: float = 0.4, gram: int = 5, shard_bytes: int = 16 << 20, index_bytes: int = 64 << 20):
    """An index for each shard of the items (about shard_bytes of texts and index_bytes of index at most), with the statistics of all of them."""
    bench = stored(items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text is not null"), "bench-items")

    def terms():
        def call(texts):
            of = [words(t) for t in texts]
            own = [(i, w) for i, ws in enumerate(of) for w in set(ws)]
            yield [i for i, _ in own], [w for _, w in own], [1] * len(own), [0] * len(own)
            yield range(len(of)), [""] * len(of), [int(bool(ws)) for ws in of], [len(ws) for ws in of]

        return call

    counts = lambda df: by_text(df.select("text"), terms, "term string, n long, length long")
    counted = stored(counts(bench).groupBy("term").agg(F.sum("n").alias("n"), F.sum("length").alias("length"), F.max("length").alias("longest")), "bench-terms")
    whole = counted.where("term = ''").first()
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes), _shards(whole["length"] if whole else 0, counted.count() - 1, index_bytes))
    for k in range(shards):
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k)
        rows = [(r["item_id"], r["text"]) for r in part.collect()]  # about shard_bytes
        df = {r["term"]: r["n"] for r in counted.join(counts(part).select("term").distinct(), "term", "left_semi").collect()}
        yield Index(rows, df, whole["n"] if whole else 0, (whole["length"] / max(1, whole["n"])) if whole else 1.0, retrieve, gram, longest=whole["longest"] if whole else None)


def _shards(length: int, distinct: int, most: int) -> int:
    """How many shards keep an index below `most` bytes, for items of so many words, and so many distinct ones."""
    apart = -(-length * (BYTES_WORD + BYTES_TERM) // most)  # as if each word were new
    room = most - distinct * BYTES_TERM
    return min(apart, -(-length * BYTES_WORD // room)) if room > 0 else apart


def clean(docs: DataFrame, items: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no item, with the columns that they had. Each is judged by its own text where it lies, so null or repeated ids and clashing columns do not matter, and nothing is shuffled."""
    verify = options.pop("verify", VERIFY)
    for index in _indexes(items, **options):
        docs = text_batches(docs).where(~_holds(docs, index, verify)(F.col(f"`{text_col}`")))
    return docs


def _of(shared) -> Index:
    index = Index.__new__(Index)
    index.__dict__ = shared.value
    return index


def _found(index: Index, texts: list[str | None], verify: float) -> list[tuple]:
    """What index.search finds in all texts, looked up CHUNK words at a time, with the place of the text first."""
    part, base, size, out = [], 0, 0, []
    for t in texts:
        w = words(t)
        part.append(w)
        size += len(w)
        if size >= CHUNK:
            out += [(base + d, *x) for d, *x in index.search(part, verify)]
            part, base, size = [], base + len(part), 0
    return out + [(base + d, *x) for d, *x in index.search(part, verify)]


def _search(text: DataFrame, index: Index, verify: float) -> DataFrame:
    shared = text.sparkSession.sparkContext.broadcast(index.__dict__)

    def work():
        one = _of(shared)
        return lambda texts: [tuple(zip(*out, strict=True))] if (out := _found(one, texts, verify)) else []

    return by_text(text, work, SCHEMA)


def _holds(docs: DataFrame, index: Index, verify: float):
    shared = docs.sparkSession.sparkContext.broadcast(index.__dict__)

    @F.pandas_udf("boolean")
    def holds(text: pd.Series) -> pd.Series:
        out = np.zeros(len(text), dtype=bool)
        out[[x[0] for x in _found(_of(shared), text.tolist(), verify)]] = True
        return pd.Series(out)

    return holds
