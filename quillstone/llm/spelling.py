"""Spelling variants: words of the corpus that are one edit apart, each grouped under its most frequent neighbour.

The vocabulary is self-joined on tries. A pair one edit apart, the longer word with L code points, agrees before the edit
and behind it, so it shares either the first L // 2 code points or the last L - L // 2. Each word therefore stands in
buckets (L, shared head, shared tail) for L of its own length and one more, and every bucket is a trie of what lies
between head and tail, self-joined on its own: level by level, a node keeps its active nodes, those whose prefixes are
within one edit of its own, and hands them down to children with equal letters. Buckets of over `most` words are split
again in the same way, a half at a time, until at most three code points lie between; nothing is ever left out. A pair
that both halves would find is dropped from the second by comparing the first half.

Words per bucket are bounded by `most`, or by the alphabet of 64 letters to the third power; neighbours of a word by the
alphabet times its length. Buckets return counts and best neighbours of their words, never lists of pairs.

Edge cases: a null or empty text has no words; a null doc_id counts as an empty one in the hash; a text is taken whole,
however long; repeated rows count again; equal neighbours go to the smallest in code-point order; an empty table has no
rows; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, partitions_for, stored

#: The letters of words; shorter words than LEAST are not told apart by one edit.
LETTERS, LEAST, OFTEN, GARBLED = r"[A-Za-zÀ-ÿ]", 5, 3, 97
#: Words of one trie, and rows that a task takes at a time.
MOST, ROWS = 20_000, 20_000
_BITS = 21  # a code point fits

KEY = ("size", "head", "tail", "avoid")


def _garbled(doc_id: Column, run: Column) -> Column:
    """The run, a letter less where the hash of document and run says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    return F.when(h % GARBLED == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, often: int = OFTEN, garble: bool = True) -> DataFrame:
    """word, n: words of at least LEAST letters, and their occurrences where these are at least `often`."""
    # a maximal run of fewer letters cannot become a word
    runs = only(docs, "doc_id", "text").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{LETTERS}{{{LEAST},}}"), F.lit(0))).alias("run"))
    low = F.when(F.lower("run") == F.col("run"), F.col("run")).otherwise(F.translate("run", string.ascii_uppercase, string.ascii_lowercase))
    runs = runs.select("doc_id", low.alias("run"))
    word = _garbled(F.col("doc_id"), F.col("run")) if garble else F.col("run")
    return runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n")).where((F.length("word") >= LEAST) & (F.col("n") >= often))


def _halves(size: Column, head: Column, tail: Column, avoid: Column) -> Column:
    """The two buckets that a bucket's word goes to, each with half of what lay between head and tail shared as well."""
    a, b, word = F.length(head), F.length(tail), F.col("word")
    half = F.floor((size - a - b) / 2).cast("int")
    rest = size - a - half  # what the tail of the second bucket is
    first = F.struct(size.alias("size"), F.substring(word, F.lit(1), a + half).alias("head"), tail.alias("tail"), avoid.alias("avoid"))
    second = F.struct(size.alias("size"), head.alias("head"), F.substring(word, F.length(word) - rest + 1, rest).alias("tail"), F.when(avoid > 0, F.least(avoid, a + half)).otherwise(a + half).alias("avoid"))
    return F.array(first, second)


def _buckets(vocab: DataFrame, most: int) -> DataFrame:
    """size, head, tail, avoid, word, n: the words of each trie. avoid: pairs equal in so many first letters are found elsewhere."""
    size = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("size")
    flat = vocab.select("word", "n", size)
    entries = flat.select("word", "n", F.explode(_halves(F.col("size"), F.lit(""), F.lit(""), F.lit(0))).alias("k")).select("k.*", "word", "n")
    entries, done = stored(entries, "spelling"), []
    while True:
        between = F.col("size") - F.length("head") - F.length("tail")
        large = stored(entries.groupBy(*KEY).count().where((F.col("count") > most) & (between > 3)).drop("count"), "spelling-large")
        if large.isEmpty():
            break
        done.append(entries.join(large, list(KEY), "left_anti"))
        again = entries.join(large, list(KEY), "left_semi")
        entries = stored(again.select("word", "n", F.explode(_halves(*(F.col(c) for c in KEY))).alias("k")).select("k.*", "word", "n"), "spelling")
    for part in done:
        entries = entries.unionByName(part)
    return entries


def _children(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of `nodes`, place of the child) for every child of every node; keys: parents and letters of a level, sorted."""
    lo = np.searchsorted(keys, nodes << _BITS)
    n = np.searchsorted(keys, (nodes + 1) << _BITS) - lo
    which = np.repeat(np.arange(len(nodes)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)


def _find(keys: np.ndarray, parents: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Place of the child of each parent by that letter, -1 where it has none."""
    if not len(keys):
        return np.full(len(parents), -1)
    wanted = (parents << _BITS) | letters
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def near_pairs(roots: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of words of the same root that are exactly one inserted, deleted or replaced code point apart,
    each pair once; the longer word comes first. Words of a root are distinct.

    The tries of all roots grow by one level at a time. Active nodes of a node's children are made from its own: a sibling
    (a letter replaced), the parent (a letter too many), and for those already one edit away the child by the same letter.
    What a letter too few would add is the mirror of one too many."""
    text = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    lens = np.fromiter((len(w) for w in words), np.int64, len(words))
    starts = np.cumsum(lens) - lens
    mask = (1 << _BITS) - 1

    def ends(level: int, at: np.ndarray, nodes: int) -> np.ndarray:
        """The word that ends at each node of a level, or -1."""
        out = np.full(nodes, -1)
        here = np.flatnonzero(lens[alive] == level)
        out[at[here]] = alive[here]
        return out

    def grow(level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words that go on, their nodes on the next level, that level's parents and letters)."""
        on = lens[alive] > level
        keys, place = np.unique((at[on] << _BITS) | text[starts[alive[on]] + level], return_inverse=True)
        return alive[on], place, keys

    found: list[tuple[np.ndarray, np.ndarray]] = []

    def meet(a: np.ndarray, b: np.ndarray) -> None:
        both = (a >= 0) & (b >= 0)
        if both.any():
            found.append((a[both], b[both]))

    alive, at = np.arange(len(words)), np.asarray(roots, dtype=np.int64)
    end = ends(0, at, int(at.max(initial=-1)) + 1)
    none = np.empty(0, np.int64)
    same, longer = (none, none), (none, none, none)  # active pairs: of one level; of a node and one a level above, with the letter too many
    level, up_keys = 0, none
    while len(alive):
        alive, at, keys = grow(level, at)
        under = ends(level + 1, at, len(keys))
        parents, letters = keys >> _BITS, keys & mask
        # a letter too many: pairs (x on this level, y above) made on the level before go down by letters other than the extra one
        x, y, extra = longer
        which, child = _children(keys, x)
        keep = letters[child] != extra[which]
        which, child = which[keep], child[keep]
        other = _find(up_keys, y[which], letters[child])
        down = (child[other >= 0], other[other >= 0])
        meet(under[down[0]], end[down[1]])
        # a letter replaced: pairs go down by equal letters, and siblings start new ones
        x, y = same
        which, child = _children(keys, x)
        other = _find(keys, y[which], letters[child])
        pairs = (child[other >= 0], other[other >= 0])
        after = np.searchsorted(parents, parents, side="right") - np.arange(len(parents)) - 1
        first = np.repeat(np.arange(len(parents)), after)
        second = np.arange(len(first)) - np.repeat(np.cumsum(after) - after, after) + first + 1
        same = (np.concatenate([pairs[0], first]), np.concatenate([pairs[1], second]))
        meet(under[same[0]], under[same[1]])
        meet(under, end[parents])
        # no letter is ruled out behind the first step
        longer = (np.concatenate([down[0], np.arange(len(keys))]), np.concatenate([down[1], parents]), np.concatenate([np.full(len(down[0]), -1), letters]))
        end, up_keys, level = under, keys, level + 1
    if not found:
        return none, none
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _best(rows: list[tuple]) -> dict[str, list]:
    """word, near, form_n, form of the words in `rows` (size, head, tail, avoid, word, n) that have a near word in their bucket."""
    rows = [r for r, alone in zip(rows, _alone(rows), strict=True) if not alone]
    if not rows:
        return {}
    words, n = [r[4] for r in rows], np.fromiter((r[5] for r in rows), np.int64, len(rows))
    fresh = [i == 0 or rows[i][:4] != rows[i - 1][:4] for i in range(len(rows))]
    a, b = near_pairs(np.cumsum(fresh) - 1, [r[4][len(r[1]) : len(r[4]) - len(r[2])] for r in rows])
    # a pair belongs to the buckets of its longer word's length, and if it shares the first half, to the bucket of that half
    heads = np.unique(np.array([r[4][: r[3]] for r in rows], dtype=object), return_inverse=True)[1]
    avoid = np.fromiter((r[3] for r in rows), np.int64, len(rows))
    full = np.fromiter((len(r[4]) == r[0] for r in rows), bool, len(rows))
    keep = full[a] & ((avoid[a] == 0) | (heads[a] != heads[b]))
    src, dst = np.concatenate([a[keep], b[keep]]), np.concatenate([b[keep], a[keep]])
    if not len(src):
        return {}
    rank = np.unique(np.array(words, dtype=object), return_inverse=True)[1]
    order = np.lexsort((rank[dst], -n[dst], src))
    src, dst = src[order], dst[order]
    at, count = np.unique(src, return_index=True, return_counts=True)[1:]
    return {"word": [words[i] for i in src[at]], "near": count.tolist(), "form_n": n[dst[at]].tolist(), "form": [words[i] for i in dst[at]]}


def _alone(rows: list[tuple]) -> Iterator[bool]:
    for i, r in enumerate(rows):
        yield (i == 0 or rows[i - 1][:4] != r[:4]) and (i + 1 == len(rows) or rows[i + 1][:4] != r[:4])


def _join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole buckets, many at a time; rows come sorted by bucket."""
    schema = pa.schema([("word", pa.string()), ("near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])
    held: list[tuple] = []
    for batch in batches:
        held.extend(zip(*(c.to_pylist() for c in batch.columns), strict=True))
        if len(held) >= ROWS:
            cut = len(held)
            while cut and held[cut - 1][:4] == held[-1][:4]:
                cut -= 1
            if cut and (out := _best(held[:cut])):
                yield pa.RecordBatch.from_pydict(out, schema=schema)
            held = held[cut:]
    if held and (out := _best(held)):
        yield pa.RecordBatch.from_pydict(out, schema=schema)


def near_words(vocab: DataFrame, most: int = MOST) -> DataFrame:
    """word, n_near, best struct(less, form): how many words of the vocabulary (word, n) are near each word, and the most
    frequent of them (less: its n, negative). Words without a near word do not appear."""
    entries = _buckets(vocab, most).repartition(partitions_for(vocab, 24), *KEY).sortWithinPartitions(*KEY)
    part = entries.select(*KEY, "word", "n").mapInArrow(_join, "word string, near long, form_n long, form string")
    return part.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """word, root from word, form: the end of each chain of forms, by pointer jumping. Chains are free of cycles, since n
    at least doubles with each step, and no longer than 63 steps, so six rounds do."""
    now = stored(links.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = now.join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        step = stored(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, *, often: int = OFTEN, most: int = MOST, garble: bool = True, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the corpus. form: its most frequent near word, where that is at
    least `times` (2 or more) times as frequent."""
    vocab = stored(vocabulary(docs, often, garble), "vocabulary")
    near = vocab.join(near_words(vocab, most), "word", "left")
    chosen = -F.col("best.less") >= times * F.col("n")
    rows = stored(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("best.form")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n")), "spelling-forms")
    out = rows.join(roots(rows.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
