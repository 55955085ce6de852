"""Exact repeats of `length` bytes, by a run-length index of the corpus around anchors.

Anchors. In every window of `length` bytes the k-gram of smallest hash is an anchor (winnowing), so equal windows have the
same anchor at the same place, and a window that starts anywhere else too meets its twin under that anchor. Anchors that
occur once are dropped. What is indexed for the others are their contexts: the bytes around them that a window over the
anchor can reach. Equal contexts are one, with their number of occurrences.

Index. Under each anchor the contexts are sorted by what follows the anchor: column 0 of a positional Burrows-Wheeler
transform. Each step left permutes the rows stably by their byte in the next column, the transform's column. It is only
ever held as runs: rows that follow each other and had the same bytes in all columns so far. A run is its first and its
last row (the sampled ends) and how far its first row matches the last one of the run before. A step splits runs where
neighbours differ in the column, permutes the runs, and gives each the least match between it and the run it now
follows; runs of one row that neither follow nor precede another under their anchor are dropped. So streaming through the columns gives the matching
statistics: a run's ends match to the length held with the run, and neighbours within a run by how far they agree on
either side of the anchor, which needs no column. Windows are marked where these lengths reach `length`. Beside the
contexts themselves, memory follows the runs.

A group of one anchor too large for a task is split by its windows: a context falls apart in pieces, one for each range
of windows, under keys of the anchor, the range and the bytes that all windows of the range share; equal pieces are one.
Equal windows stay under one key. What is still too large is split into narrower ranges, down to single windows, whose
pieces are equal or apart. All pieces go through the same index, so the result does not depend on sizes.

Passages. Besides, documents that hold a passage of another one are told: the hashes of runs of GRAM words are winnowed
so that of any PASSAGE words a run is selected; a selected run that another document has too is a passage. So none of
PASSAGE words or more is missed, and none of under GRAM words counts; repeats within a document do not.

Marked windows leave as intervals; those of a document are merged and cut from its bytes.

Rows: a null text is empty; texts shorter than `length` have no window; matches never cross documents; repeated rows
repeat each other, and document ids should be unique (rows with equal ids and texts are reported each with the same
result, equal ids with other texts apart, by the digest of the text); an empty table gives an empty result; other columns are
ignored. Very long texts are cut into pieces of no relation to the result: all anchors of a text are found.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_text, partitions_for, stored
from .jaccard import by_group

K = 64
#: Contexts of one key that a task takes (about 1 KB each), contexts that go through the columns together, and the parts a
#: range of windows is split into.
LARGE, ROWS, PARTS = 20_000, 20_000, 8
#: Words of the runs that are compared, and of the passages that always have one selected.
GRAM, PASSAGE = 40, 50
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def kgram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each run of K bytes, by doubling."""
    with np.errstate(over="ignore"):
        h, width = data.astype(np.uint64) + np.uint64(1), 1
        parts, at = None, 0
        powers = {1: _P}
        k = K
        while k:
            if k & 1:
                n = len(data) - K + 1
                piece = h[at : at + n]
                parts = piece.copy() if parts is None else parts * powers[width] + piece
                at += width
            k >>= 1
            if k:
                h = h[: len(h) - width] * powers[width] + h[width:]
                powers[2 * width] = powers[width] * powers[width]
                width *= 2
        return _mix(parts)


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the k-grams that are the smallest of some window of `length` bytes."""
    w = length - K + 1  # k-grams in a window
    if len(data) < length:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    h = kgram_hashes(data)
    # Blocks of w: the least of a window is the least of a suffix of one block and a prefix of the next.
    n = -(-len(h) // w) * w
    order = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    order[: len(h)] = h
    blocks = order.reshape(-1, w)
    prefix = np.minimum.accumulate(blocks, axis=1).ravel()
    suffix = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(h) - w + 1
    least = np.minimum(suffix[:count], prefix[w - 1 : w - 1 + count])
    where = np.flatnonzero(h == _spread_max(least, len(h), w))
    return where, h[where]


def _spread_max(least: np.ndarray, n: int, w: int) -> np.ndarray:
    """For each place the largest least of the windows that hold it: the place is one's least only if it equals this."""
    pad = np.zeros(n + w - 1, dtype=np.uint64)
    pad[w - 1 : w - 1 + len(least)] = least
    m = -(-len(pad) // w) * w
    full = np.zeros(m, dtype=np.uint64)
    full[: len(pad)] = pad
    b = full.reshape(-1, w)
    prefix = np.maximum.accumulate(b, axis=1).ravel()
    suffix = np.maximum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.maximum(suffix[:n], prefix[w - 1 : w - 1 + n])


def common_ends(rows: list[bytes], at: np.ndarray, before: bool, width: int) -> np.ndarray:
    """For each k of `at` how many bytes rows k - 1 and k agree in, from their starts (or, with before, from their ends)."""
    out = np.zeros(len(at), dtype=np.int64)
    for i in range(0, len(at), 4096):
        part = at[i : i + 4096]
        table = np.zeros((2, len(part), width), dtype=np.uint8)
        sizes = np.zeros((2, len(part)), dtype=np.int64)
        for side, shift in ((0, -1), (1, 0)):
            for x, k in enumerate(part.tolist()):
                raw = np.frombuffer(rows[k + shift], dtype=np.uint8)
                table[side, x, : len(raw)] = raw[::-1] if before else raw
                sizes[side, x] = len(raw)
        differ = table[0] != table[1]
        out[i : i + 4096] = np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), width), sizes.min(axis=0))
    return out


def mark(group: np.ndarray, left: list[bytes], right: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) for rows of contexts, in groups: the windows that begin so many bytes before the anchor and that
    another row of the group has, -1 where there is none. left: the bytes before the anchor; right: from it on.

    All marked windows of a row hold its anchor, so what they cover lies between the two."""
    n, reach = len(group), max(map(len, left), default=0)
    order = sorted(range(n), key=lambda i: (group[i], right[i]))
    group, left, right = group[order], [left[i] for i in order], [right[i] for i in order]
    same = np.flatnonzero(group[1:] == group[:-1]) + 1
    follows = np.full(n, -1, dtype=np.int64)  # bytes that a row and the one before it agree in, from the anchor on
    follows[same] = common_ends(right, same, False, length)
    precedes = np.full(n, -1, dtype=np.int64)  # and before the anchor
    precedes[same] = common_ends(left, same, True, max(1, reach))
    least, most = np.full(n, n and length, dtype=np.int64), np.full(n, -1, dtype=np.int64)

    def hit(rows, lo, hi):
        np.minimum.at(least, rows, lo)
        np.maximum.at(most, rows, hi)

    # Neighbours within a run, for as many columns as they are one.
    lo = np.maximum(0, length - follows[same])
    ok = lo <= precedes[same]
    for rows in (same[ok], same[ok] - 1):
        hit(rows, lo[ok], precedes[same][ok])
    # Runs, column by column. A key is what rows must share to meet again: the group and all bytes of the columns so far.
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if n else np.zeros(0, dtype=np.int64)
    last = np.append(first[1:], n) - 1 if n else first
    key, match = np.arange(len(first)), np.full(len(first), -1, dtype=np.int64)
    padded = np.append(follows, [length, length])

    def inner(first, last):
        """The least match between rows of a run."""
        least = np.minimum.reduceat(padded, np.stack([first + 1, last + 1], axis=1).ravel())[::2] if len(first) else first
        return np.where(last > first, least, length)

    within = inner(first, last)
    breaks = same[np.argsort(precedes[same], kind="stable")]
    cut_at = np.searchsorted(precedes[breaks], np.arange(reach + 2))
    lengths = np.array([len(x) for x in left], dtype=np.int64)
    text, text_ends = np.frombuffer(b"\0" * (reach + 1) + b"".join(left), dtype=np.uint8).astype(np.int16), np.cumsum(lengths) + reach + 1
    for j in range(1, reach + 1):
        if not len(first):
            break
        new = breaks[cut_at[j - 1] : cut_at[j]]  # rows that differ from the one before in column j
        if len(new):
            by_row = np.argsort(first, kind="stable")
            inside = by_row[np.maximum(np.searchsorted(first[by_row], new, "right") - 1, 0)]
            there = (first[inside] < new) & (last[inside] >= new)
            new, inside = new[there], inside[there]
        if len(new):
            o = np.lexsort((new, inside))
            new, inside = new[o], inside[o]
            ends = last[inside].copy()
            ends[:-1] = np.where(inside[1:] == inside[:-1], new[1:] - 1, ends[:-1])
            head = np.unique(inside, return_index=True)
            last[head[0]] = new[head[1]] - 1
            within[head[0]], parts = inner(first[head[0]], last[head[0]]), inner(new, ends)
            first, last, key, match, within = (np.insert(x, inside + 1, y) for x, y in ((first, new), (last, ends), (key, key[inside]), (match, follows[new]), (within, parts)))
        # The column: a byte for each run (none where the texts begin), and the runs permuted stably by it.
        byte = np.where(lengths[first] >= j, text[text_ends[first] - j], 256)
        column = key * 257 + byte
        step = np.argsort(column, kind="stable")
        sorted_key = column[step]
        joined = np.append(False, sorted_key[1:] == sorted_key[:-1])
        now = np.full(len(step), -1, dtype=np.int64)
        heads = np.flatnonzero(joined)
        if len(heads):
            # from the run after the one now followed up to this one, and what lies within the runs passed over
            bounds = np.stack([2 * step[heads - 1] + 2, 2 * step[heads] + 1], axis=1).ravel()
            now[heads] = np.minimum.reduceat(np.stack([match, within], axis=1).ravel(), bounds)[::2]
        # Runs that follow or precede another one go on, and those of several rows, which may part.
        alive = byte[step] != 256
        joined &= alive
        keep = alive & (joined | np.append(joined[1:], False) | (last > first)[step])
        first, last, within, match = first[step][keep], last[step][keep], within[step][keep], np.where(joined, now, -1)[keep]
        key = np.cumsum(np.append(1, np.diff(sorted_key[keep]) != 0))[: int(keep.sum())]
        reaches = np.flatnonzero(match >= length - j)
        hit(first[reaches], j, j)
        hit(last[reaches - 1], j, j)
    back = np.empty(n, dtype=np.int64)
    back[order] = np.arange(n)
    return np.where(most < 0, -1, least)[back], most[back]


OCCURRENCE = "doc_id long, row long, anchor long, ctx long, pos int"


def occurrences(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, row, raw -> each anchor with the hash of its context. Contexts are only ever told apart under one anchor, so
    the two hashes are 128 bits together."""
    reach = length - K

    def work():
        def call(texts):
            for i, raw in enumerate(texts):
                if len(raw) < length:
                    continue
                at, h = anchors(np.frombuffer(raw, dtype=np.uint8), length)
                left, right = np.minimum(at, reach), np.minimum(len(raw) - at, length)
                ctx = np.fromiter((xxhash.xxh3_64_intdigest(raw[p - x : p + y], x) for p, x, y in zip(at.tolist(), left.tolist(), right.tolist(), strict=True)), dtype=np.uint64, count=len(at))
                yield np.full(len(at), i), h.astype(np.int64), ctx.astype(np.int64), at.astype(np.int32)

        return lambda texts: _together(call(texts), 4)

    return by_text(docs.select("doc_id", "row", "raw"), work, OCCURRENCE)


def _together(parts, columns: int):
    """The rows of many small parts at once."""
    parts = list(parts)
    return [tuple(np.concatenate([p[k] for p in parts]) for k in range(columns))] if parts else []


def contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """The bytes of wanted contexts (anchor, ctx, doc_id, row, pos): anchor, ctx, lhs, rhs."""
    per = wanted.groupBy(F.col("doc_id").alias("of"), F.col("row").alias("of_row")).agg(F.collect_list(F.struct("anchor", "ctx", "pos")).alias("at"))  # bounded by the document

    def run(batches):
        for pdf in batches:
            rows = [(x["anchor"], x["ctx"], raw[max(0, x["pos"] - length + K) : x["pos"]], raw[x["pos"] : x["pos"] + length]) for raw, at in zip(pdf["raw"], pdf["at"], strict=True) for x in at]
            yield pd.DataFrame(rows, columns=["anchor", "ctx", "lhs", "rhs"])

    found = docs.join(per, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("of_row"))).select("raw", "at").mapInPandas(run, "anchor long, ctx long, lhs binary, rhs binary")
    return found.dropDuplicates(["anchor", "ctx"])  # repeated rows give theirs each


#: A piece: its key and name, its ranges of windows, where they begin before its anchor, and its bytes around the anchor.
PIECE = "key binary, piece binary, a int, b int, lhs binary, rhs binary"
MARKED = "key binary, piece binary, least int, most int"


def _index(length: int):
    def run(batches):
        for pdf, starts in by_group(batches, ["key"]):
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(pdf))))
            cut = np.flatnonzero(np.diff(starts // ROWS)) + 1
            for lo, hi in zip([0, *starts[cut].tolist()], [*starts[cut].tolist(), len(pdf)], strict=True):
                part = pdf.iloc[lo:hi]
                least, most = mark(group[lo:hi], part["lhs"].tolist(), part["rhs"].tolist(), length)
                # Windows outside of a piece's range are another piece's.
                least, most = np.maximum(least, part["a"].to_numpy()), np.minimum(most, part["b"].to_numpy())
                found = np.flatnonzero((most >= 0) & (least <= most))
                yield pd.DataFrame({"key": part["key"].to_numpy()[found], "piece": part["piece"].to_numpy()[found], "least": least[found], "most": most[found]})

    return run


NAMES = "of binary, of_piece binary, key binary, piece binary, a int, b int"


def _narrower(length: int):
    """Pieces of a range of windows -> the names of what its parts cut from them; no bytes."""

    def run(batches):
        for pdf in batches:
            rows = []
            for key, piece, a, b, lhs, rhs in zip(*(pdf[c] for c in ("key", "piece", "a", "b", "lhs", "rhs")), strict=True):
                cuts = np.unique(np.linspace(a, b + 1, PARTS + 1).astype(int)).tolist()
                raw, at = lhs + rhs, len(lhs)
                for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                    y -= 1
                    if at >= x and len(rhs) >= length - y:
                        shared = xxhash.xxh3_128_digest(key + bytes([x & 255, x >> 8, y & 255, y >> 8]) + raw[at - x : at + length - y])
                        before = min(y, at)
                        rows.append((key, piece, shared, xxhash.xxh3_128_digest(raw[at - before : at + length - x], before), x, y))
            yield pd.DataFrame(rows, columns=["of", "of_piece", "key", "piece", "a", "b"])

    return run


def marked(pieces: DataFrame, length: int, large: int) -> DataFrame:
    """PIECE rows, a row for each piece of a key -> MARKED.

    Keys of more than `large` pieces are split by ranges of windows: first in names only; bytes are then cut, one piece of
    each name, for those keys alone that still have several pieces."""
    part, levels = partitions_for(pieces), []
    while True:
        sizes = pieces.groupBy("key").agg(F.count("*").alias("size"))
        big = stored(sizes.where(F.col("size") > large).select("key"), "dup-large")
        more = not big.isEmpty()
        some = pieces.join(big, "key", "left_anti") if more else pieces
        levels.append(some.repartition(part, "key").sortWithinPartitions("key", "piece").mapInPandas(_index(length), MARKED))
        if not more:
            break
        parents = stored(pieces.join(big, "key", "left_semi"), "dup-parents")
        names = stored(parents.mapInPandas(_narrower(length), NAMES), "dup-names")
        per = stored(names.groupBy("key", "piece").agg(F.count("*").alias("c"), F.min("a").alias("a"), F.min("b").alias("b"), F.min(F.struct("of", "of_piece")).alias("src")), "dup-names")
        levels.append(names.select("of", "of_piece", "key", "piece"))
        levels.append(per.where("c > 1").select("key", "piece", F.col("a").alias("least"), F.col("b").alias("most")))  # equal pieces: every window of theirs
        mixed = stored(per.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "dup-mixed")
        wanted = per.join(mixed, "key", "left_semi").select("src.of", "src.of_piece", "key", "piece", "a", "b")
        cut = wanted.join(parents.select(F.col("key").alias("of"), F.col("piece").alias("of_piece"), "lhs", "rhs"), ["of", "of_piece"])
        lhs = F.expr("substring(lhs, greatest(length(lhs) - b, 0) + 1, b)")
        pieces = stored(cut.select("key", "piece", "a", "b", lhs.alias("lhs"), F.expr(f"substring(rhs, 1, {length} - a)").alias("rhs")), "dup-pieces")
    out = levels.pop()
    while levels:
        repeated, names, above = levels.pop(), levels.pop(), levels.pop()
        inner = out.unionAll(repeated).groupBy("key", "piece").agg(F.min("least").alias("least"), F.max("most").alias("most"))
        inner = stored(inner, "dup-inner")
        up = names.join(inner, ["key", "piece"]).groupBy("of", "of_piece").agg(F.min("least").alias("least"), F.max("most").alias("most"))
        out = above.unionAll(up.select(F.col("of").alias("key"), F.col("of_piece").alias("piece"), "least", "most"))
    return out


def repeats(docs: DataFrame, length: int, large: int = LARGE) -> DataFrame:
    """doc_id, row, raw -> doc_id, row, lo, hi: intervals of bytes covered by windows that also start elsewhere (they may overlap)."""
    every = stored(occurrences(docs, length), "dup-anchors")
    again = stored(every.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "dup-again")
    occ = stored(every.join(again, "anchor", "left_semi"), "dup-repeated", free=True, drop=[every, again])
    place = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "pos")).alias("place")
    per = stored(occ.groupBy("anchor", "ctx").agg(F.count("*").alias("c"), place), "dup-contexts", free=True)
    mixed = stored(per.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "dup-mixed")
    # Contexts that occur twice: every window in them does. All that a window over the anchor can reach is clipped to the text later.
    whole = per.where("c > 1").select("anchor", "ctx", F.lit(0).alias("least"), F.lit(length - K).alias("most"))
    # Contexts whose anchor has others too: their bytes are needed, from one place each.
    wanted = per.join(mixed, "anchor", "left_semi").select("anchor", "ctx", "place.doc_id", "place.row", "place.pos")
    name = lambda c: F.unhex(F.lpad(F.hex(c), 16, "0"))
    pieces = contexts(docs, wanted, length).select(name("anchor").alias("key"), name("ctx").alias("piece"), F.lit(0).alias("a"), F.lit(length - K).alias("b"), "lhs", "rhs")
    found = marked(stored(pieces, "dup-bytes", free=True), length, large)
    long = lambda c: F.conv(F.hex(c), 16, -10).cast("long")
    found = found.select(long("key").alias("anchor"), long("piece").alias("ctx"), "least", "most")
    spans = stored(found.unionAll(whole).groupBy("anchor", "ctx").agg((-F.max("most")).alias("from"), (F.lit(length) - F.min("least")).alias("to")), "dup-spans", free=True)
    return occ.join(spans, ["anchor", "ctx"]).select("doc_id", "row", (F.col("pos") + F.col("from")).alias("lo"), (F.col("pos") + F.col("to")).alias("hi"))


def _numbers(words: list[str]) -> np.ndarray:
    """A number below 2^31 for each word, the first bits of its md5: any engine with md5 gives the same."""
    return np.fromiter((int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") >> 1 for w in words), dtype=np.int64, count=len(words))


def factors() -> list[int]:
    """Of the words of a run in its hash: below 2^20, from a rule."""
    return [int.from_bytes(hashlib.md5(str(k).encode()).digest()[:4], "big") >> 12 for k in range(GRAM)]


#: Of the order of runs: two primes and two factors below 2^31.
PRIMES, MIX = (2147483647, 2147483629), (1812433253, 1664525261)


def selected_runs(numbers: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the distinct hashes of runs of GRAM words in each text of which each PASSAGE words have one: the
    least of them. numbers: the words of all texts, one after the other; sizes: how many each has.

    The weighted sum of a run differs little from the next one's, so sums are put in an order without regard to their
    size: 31 bits of order, then 31 of the sum."""
    count = np.maximum(0, sizes - PASSAGE + 1)  # windows of each text
    if not count.any():
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    h = np.zeros(len(numbers) - GRAM + 1, dtype=np.int64)
    for k, f in enumerate(factors()):
        h += numbers[k : k + len(h)] * f
    high, low = np.divmod(h, PRIMES[0])
    order = (low * MIX[0] % PRIMES[1] + high * MIX[1] % PRIMES[1]) % PRIMES[1]
    h = (order << 31) + low
    least = h[: len(h) - (PASSAGE - GRAM)].copy()
    for k in range(1, PASSAGE - GRAM + 1):
        np.minimum(least, h[k : k + len(least)], out=least)
    text = np.repeat(np.arange(len(sizes)), count)
    starts = np.cumsum(sizes) - sizes
    least = least[np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(len(text))]
    new = np.append(True, (least[1:] != least[:-1]) | (text[1:] != text[:-1]))
    text, least = text[new], least[new]
    by = np.lexsort((least, text))
    text, least = text[by], least[by]
    new = np.append(True, (least[1:] != least[:-1]) | (text[1:] != text[:-1]))
    return text[new], least[new]


def passages(docs: DataFrame) -> DataFrame:
    """doc_id, row, raw -> distinct doc_id, row of the documents that hold a passage of another one (or of a repeated row)."""

    def work():
        import pyarrow as pa
        import pyarrow.compute as pc

        def call(texts):
            split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).cast(pa.string()))
            words = split.flatten().dictionary_encode()
            full = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)
            numbers, of = _numbers(words.dictionary.to_pylist()), words.indices.to_numpy(zero_copy_only=False)
            there = np.append(0, np.cumsum(full[of])) if len(of) else np.zeros(1, dtype=np.int64)
            at = split.offsets.to_numpy() - split.offsets[0].as_py()
            yield selected_runs(numbers[of[full[of]]] if len(of) else np.zeros(0, dtype=np.int64), np.diff(there[at]))

        return call

    every = stored(by_text(docs.select("doc_id", "row", "raw"), work, "doc_id long, row long, run long"), "passage-runs")
    again = stored(every.groupBy("run").agg(F.count("*").alias("n")).where("n > 1").select("run"), "passage-again")
    return stored(every.join(again, "run", "left_semi").select("doc_id", "row").distinct(), "passage-documents", free=True, drop=[every, again])


def cut(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 400, large: int = LARGE) -> DataFrame:
    """A row for each document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, shares_passage (1 if another document holds
    a passage of it, else 0), and the removed spans (byte offsets)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    shared = passages(rows).select(F.col("doc_id").alias("shared_id"), F.col("row").alias("shared_row"))
    found = repeats(rows, length, large)
    # Intervals of a document, merged: overlapping ones by a running maximum of their ends.
    order = Window.partitionBy("doc_id", "row").orderBy("lo", "hi")
    found = found.groupBy("doc_id", "row", "lo").agg(F.max("hi").alias("hi")).withColumn("reach", F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    found = found.withColumn("part", F.sum(F.when(F.col("reach") >= F.col("lo"), 0).otherwise(1)).over(order))
    merged = found.groupBy("doc_id", "row", "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).groupBy(F.col("doc_id").alias("of"), F.col("row").alias("of_row")).agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("wide"))
    marks = merged.join(shared, F.col("of").eqNullSafe(F.col("shared_id")) & (F.col("of_row") == F.col("shared_row")), "full")
    marks = stored(marks.select(F.coalesce("of", "shared_id").alias("of"), F.coalesce("of_row", "shared_row").alias("of_row"), "wide", F.col("shared_row").isNotNull().cast("int").alias("shares")), "dup-merged", free=True)
    out = rows.join(marks, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("of_row")), "left")
    size = F.length("raw")
    out = out.withColumn("spans", F.transform("wide", lambda s: F.struct(F.greatest(s["lo"], F.lit(0)).alias("lo"), F.least(s["hi"], size).alias("hi"))))
    gone = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["hi"] - x["lo"]), F.lit(0).cast("long"))
    # What is left: the bytes from each removed run's end to the next one's start.
    n = F.size("spans")
    from_ = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("spans", i - 1)["hi"])
    gaps = F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(from_(i).alias("lo"), F.when(i == n, size).otherwise(F.get("spans", i)["lo"]).alias("hi")))
    # joined at once, so that a text of very many spans is copied once
    kept = F.unhex(F.array_join(F.transform(gaps, lambda g: F.hex(F.substring("raw", g["lo"] + 1, g["hi"] - g["lo"]))), ""))
    return out.select("doc_id", size.cast("long").alias("n_bytes"), gone.alias("n_removed"), F.coalesce(n, F.lit(0)).cast("long").alias("n_spans"), F.sha2(F.when(F.col("spans").isNull(), F.col("raw")).otherwise(kept), 256).alias("kept_sha256"), F.coalesce("shares", F.lit(0)).alias("shares_passage"), "spans")
