"""Jaccard join of documents on word n-grams by chosen paths.

A document is the set of its runs of `words` words (lower case, split at white space). Equal sets are one class, so
copies cost one set. Each class keeps a sample, the smallest hashes of its set, and a signature.

Paths. A class goes to the buckets of the first `roots` tokens of its sample. Any pair of similarity s shares the first
of the union's tokens with probability s, the next one again, and so on, and splits of a bucket part it with at most
PARTED: it misses all buckets with (1 - s (1 - PARTED))^roots, and `roots` is the number of such runs that reaches the
target recall. A bucket of one is dropped, a small one is compared
pair by pair. A large one is split again: classes near to a few pivots are linked to them and leave; for the rest,
tokens are sampled anew, without those that over half of the bucket has, and lead to child buckets; a class many of whose
tokens are in over half of the bucket goes to a bucket of what is left. What is
still large at the last level is compared in blocks, so nothing is capped.

Comparing signatures only groups classes that may be similar, in candidate components. Then sets are rebuilt from the
whole texts, once a class, and compared exactly: a component within one tile, a larger one (in classes or in shingles)
in tiles of two blocks, each of which gets the sets of those classes only whose signature is near one of the tile.
Links are counted in the tiles and never written as pairs; a tile gives each class its count and one edge to the
smallest class it is connected to. Classes go by 64 bits of a 128-bit hash, whose other half shows two sets of one name.

Rows: a null text or one without words has no set, no link, and is its own group; a text of fewer than `words` words is
one run of all its words; repeated rows are copies; null ids stay null and are never a group's name while it has another
id; of rows with equal ids and other texts each is a document; an empty table gives an empty result; other columns are ignored. Very long texts are sets like others.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_text, connected_components, partitions_for, stored

SAMPLE, BINS = 64, 128
LEAF, PIVOTS, SPLIT, LEVELS, BLOCK = 1000, 4, 5, 6, 512
#: Signatures differ from the true similarity by about 0.035, for similarities as below; five times that is left open.
FLOOR, LINK, LEAVE = 0.6, 0.3, 0.7
#: The threshold and recall that these and SPLIT were set for.
LEAST, MOST = 0.8, 1 - 1e-7
#: The share of similar pairs that the splits of one root's path may part (measured: below a twentieth a level).
PARTED = 0.1
SKETCH = "doc_id long, row long, cls long, alt long, n int, sample array<long>, sig binary"
SETS = "cls long, comp long, blocks int, i int, weight long, n int, sig binary, tokens binary"
#: Shingles of a tile's block, about: with BLOCK it bounds a task's memory.
TOKENS = 1_500_000
_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """For each text its sorted distinct hashes of runs of words."""
    number: dict[str, int] = {}
    parts = [[number.setdefault(w, len(number)) for w in t.lower().split()] if t else [] for t in texts]
    lengths = np.array([len(p) for p in parts], dtype=np.int64)
    flat = np.fromiter((i for p in parts for i in p), dtype=np.int64, count=int(lengths.sum()))
    h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode(errors="surrogatepass")) for w in number), dtype=np.uint64, count=len(number))[flat] if len(flat) else np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        runs = h[: max(0, len(h) - words + 1)].copy()
        for j in range(1, words):
            runs = runs * _P + h[j : j + len(runs)]
        runs = _mix(runs)
        out, at = [], 0
        for n in lengths.tolist():
            if n >= words:
                out.append(np.unique(runs[at : at + n - words + 1]))
            elif n:
                one = np.uint64(n)
                for x in h[at : at + n]:
                    one = one * _P + x
                out.append(_mix(np.array([one], dtype=np.uint64)))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
            at += n
    return out


def class_of(tokens: np.ndarray, seed: int = 0) -> tuple[int | None, int | None]:
    """The two halves of a set's 128-bit hash, as longs: the class's name, and what tells sets of one name apart."""
    if not len(tokens):
        return None, None
    h = xxhash.xxh3_128_intdigest(tokens.tobytes(), seed)
    return tuple(x - (1 << 64) if x >> 63 else x for x in (h & (1 << 64) - 1, h >> 64))


def signature(tokens: np.ndarray) -> bytes:
    """The smallest token of each of BINS ranges of hashes, as a byte from 1 to 255; 0 where there is none."""
    edges = (np.arange(BINS, dtype=np.uint64) << np.uint64(64 - BINS.bit_length() + 1)).astype(np.uint64)
    at = np.searchsorted(tokens, edges)
    there = at < np.append(at[1:], len(tokens))
    least = tokens[np.minimum(at, len(tokens) - 1)]
    with np.errstate(over="ignore"):
        return np.where(there, _mix(least) % np.uint64(255) + np.uint64(1), 0).astype(np.uint8).tobytes()


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity of rows of signatures."""
    return ((a == b) & (a > 0)).sum(axis=1) / np.maximum(1, ((a > 0) | (b > 0)).sum(axis=1))


def in_chunks(texts: list[str | None], size: int = 1_500_000):
    """(place of the first, texts) of about `size` characters together, one text at least."""
    part, base, chars = [], 0, 0
    for t in texts:
        part.append(t)
        chars += len(t) if t else 0
        if chars >= size:
            yield base, part
            part, base, chars = [], base + len(part), 0
    if part:
        yield base, part


def sketches(docs: DataFrame, words: int, seed: int = 0) -> DataFrame:
    """doc_id, row, text -> SKETCH."""

    def work():
        def call(texts):
            for base, part in in_chunks(texts):
                sets = shingle_sets(part, words)
                cls, alt = zip(*(class_of(s, seed) for s in sets), strict=True)
                yield range(base, base + len(part)), cls, alt, [len(s) for s in sets], [s[:SAMPLE].astype(np.int64) for s in sets], [signature(s) if len(s) else b"" for s in sets]

        return call

    return by_text(docs.select("doc_id", "row", "text"), work, SKETCH)


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and edges a-b the smallest node of each one's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low), np.minimum.at(label, b, low)
        label = label[label]
        open_ = label[a] != label[b]
        if not open_.any():
            break
        # also lower the nodes that stand for others
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low), np.minimum.at(label, label[b], low)
        label = label[label]
    return label


def by_group(batches, keys: list[str]):
    """Frames of whole groups from batches sorted by their keys, many small groups at a time, with where each starts."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        values = pdf[keys].to_numpy()
        starts = np.flatnonzero(np.append(True, (values[1:] != values[:-1]).any(axis=1))[: len(pdf)])
        rest = pdf.iloc[starts[-1] :] if len(starts) else None
        if len(starts) > 1:
            yield pdf.iloc[: starts[-1]].reset_index(drop=True), starts[:-1]
    if rest is not None and len(rest):
        yield rest.reset_index(drop=True), np.array([0])


def _leaves(batches):
    """path, cls, sig sorted by path -> edges between classes of a path whose signatures are near."""
    for pdf, starts in by_group(batches, ["path"]):
        sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint8).reshape(len(pdf), BINS)
        cls = pdf["cls"].to_numpy()
        sizes = np.diff(np.append(starts, len(pdf)))
        for lo, hi in _spans(sizes * (sizes - 1) // 2, 100_000):
            a, b = pairs_within(starts[lo:hi], sizes[lo:hi])
            near = np.concatenate([estimate(sig[a[i : i + 20_000]], sig[b[i : i + 20_000]]) for i in range(0, len(a), 20_000)] or [np.zeros(0)]) >= FLOOR
            base = starts[lo]
            n = int(starts[hi - 1] + sizes[hi - 1] - base)
            label = labels_of(n, a[near] - base, b[near] - base)
            own = np.flatnonzero(label != np.arange(n))
            yield pd.DataFrame({"a": cls[own + base], "b": cls[label[own] + base]})


def _spans(weights: np.ndarray, most: int):
    """Ranges of neighbours whose weights are about `most` together."""
    cuts = np.flatnonzero(np.diff(np.cumsum(weights) // most)) + 1
    return zip([0, *cuts.tolist()], [*cuts.tolist(), len(weights)], strict=True)


def pairs_within(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows of each group."""
    row = np.repeat(starts, sizes) + (np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes))
    left = np.repeat(starts + sizes, sizes) - row - 1  # partners after each row
    a = np.repeat(row, left)
    b = a + 1 + (np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left))
    return a, b


def _pivot_step(batches):
    """path, cls, sig and the pivots of the path -> for each class its first near pivot (none: null) and whether it
    stays; besides, once a batch, each pair of pivots that some class is near to both of."""
    for pdf in batches:
        n = len(pdf)
        sig = np.frombuffer(b"".join(pdf["sig"]), dtype=np.uint8).reshape(n, BINS)
        path, own = pdf["path"].to_numpy(), pdf["cls"].to_numpy()
        paths, row = np.unique(path, return_inverse=True)
        lists = [pdf["pivots"].iloc[i] for i in np.unique(row, return_index=True)[1]]
        first = np.full(n, -1, dtype=np.int64)
        leaves = np.zeros(n, dtype=bool)
        joined = set()
        for k in range(PIVOTS):
            there = np.array([len(ps) > k for ps in lists])[row]
            cls = np.array([ps[min(k, len(ps) - 1)]["cls"] for ps in lists], dtype=np.int64)
            ref = np.frombuffer(b"".join(ps[min(k, len(ps) - 1)]["sig"] for ps in lists), dtype=np.uint8).reshape(len(lists), BINS)
            est = np.concatenate([estimate(sig[i : i + 20_000], ref[row[i : i + 20_000]]) for i in range(0, n, 20_000)])
            leaves |= there & (est >= LEAVE)
            near = there & (est >= LINK)
            both = near & (first >= 0)
            joined |= set(zip(path[both].tolist(), cls[row[both]].tolist(), np.array([[p["cls"] for p in ps] + [0] * (PIVOTS - len(ps)) for ps in lists], dtype=np.int64)[row[both], first[both]].tolist(), strict=True))
            first[near & (first < 0)] = k
        table = np.array([[p["cls"] for p in ps] + [0] * (PIVOTS - len(ps)) for ps in lists], dtype=np.int64)
        to = pd.array(np.where(first >= 0, table[row, np.maximum(first, 0)], 0), dtype="Int64")
        to[first < 0] = pd.NA
        yield pd.DataFrame({"path": path, "cls": own, "pivot": to, "stays": ~leaves})
        if joined:
            yield pd.DataFrame([(p, a, b, False) for p, a, b in joined], columns=["path", "cls", "pivot", "stays"])


def _hash(*columns):
    return F.xxhash64(*columns)


def candidate_edges(one: DataFrame, *, roots: int, level_roots: int = 3) -> DataFrame:
    """one: cls, sample, sig -> edges a-b between classes that may be similar; connected components of them hold all similar pairs."""
    members = one.select("cls", F.explode(F.slice("sample", 1, roots)).alias("path"))
    members = members.select(_hash("path").alias("path"), "cls")
    edges, leaves = [], []
    for level in range(LEVELS + 1):
        members = stored(members, "jaccard-paths")
        sizes = stored(members.groupBy("path").agg(F.count("*").alias("size")).where("size > 1"), "jaccard-sizes")
        leaves.append(members.join(sizes.where(F.col("size") <= LEAF).select("path"), "path"))
        big = sizes.where(F.col("size") > LEAF)
        if big.isEmpty():
            break
        large = members.join(big, "path")
        if level == LEVELS:
            edges.append(_blocks(large, one))
            break
        large = stored(large.join(one, "cls"), "jaccard-large")
        first = Window.partitionBy("path").orderBy(_hash("path", "cls"), "cls")
        pivots = large.select("path", "cls", "sig").withColumn("k", F.row_number().over(first)).where(F.col("k") <= PIVOTS).groupBy("path").agg(F.collect_list(F.struct("cls", "sig")).alias("pivots"))
        seen = stored(large.select("path", "cls", "sig").join(pivots, "path").mapInPandas(_pivot_step, "path long, cls long, pivot long, stays boolean"), "jaccard-pivots")
        edges.append(seen.where("cls <> pivot").select(F.col("cls").alias("a"), F.col("pivot").alias("b")))
        left = large.join(seen.where("stays").select("path", "cls"), ["path", "cls"])
        # Some tokens of each sample, the same ones for all classes that have them.
        some = F.slice(F.sort_array(F.transform("sample", lambda t: F.struct(_hash("path", t).alias("h"), t.alias("token")))), 1, SPLIT)
        left = stored(left.select("path", "cls", F.transform(some, lambda t: t["h"]).alias("tokens")), "jaccard-tokens", free=True, drop=[large])
        # Tokens that over half of a bucket has do not split it; they are fewer than 2 * SPLIT.
        now = left.groupBy("path").agg(F.count("*").alias("now"))
        df = left.select("path", F.explode("tokens").alias("h")).groupBy("path", "h").agg(F.count("*").alias("df")).where("df > 1").join(now, "path")
        common = df.where("df * 2 > now").groupBy("path").agg(F.collect_list("h").alias("common"))
        left = left.join(common, "path", "left").withColumn("own", F.coalesce(F.array_except("tokens", "common"), "tokens"))
        many = F.when((F.size("tokens") - F.size("own")) * 5 >= SPLIT * 3, F.array(F.lit(-1).cast("long"))).otherwise(F.array().cast("array<bigint>"))
        children = left.select("path", "cls", F.concat(F.slice("own", 1, level_roots), many).alias("to")).repartition(partitions_for(one), "path", "cls").select("path", "cls", F.explode("to").alias("child"))
        members = children.select(_hash("path", "child").alias("path"), "cls")
    rows = leaves[0]
    for x in leaves[1:]:
        rows = rows.unionAll(x)
    n = partitions_for(one)
    near = rows.join(one.select("cls", "sig"), "cls").repartition(n, "path").sortWithinPartitions("path", "cls").mapInPandas(_leaves, "a long, b long")
    for e in edges:
        near = near.unionAll(e)
    return near


def _blocks(large: DataFrame, one: DataFrame) -> DataFrame:
    """Edges within buckets that no token splits, compared block against block."""
    b = large.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("i", F.pmod(_hash("cls"), F.col("blocks")).cast("int"))
    b = b.join(one.select("cls", "sig"), "cls").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    b = b.select("path", F.least("i", "j").alias("ti"), F.greatest("i", "j").alias("tj"), "i", "cls", "sig")

    def compare(batches):
        for pdf, starts in by_group(batches, ["path", "ti", "tj"]):
            for part in np.split(np.arange(len(pdf)), starts[1:]):
                g = pdf.iloc[part]
                sig, cls = np.frombuffer(b"".join(g["sig"]), dtype=np.uint8).reshape(len(g), BINS), g["cls"].to_numpy()
                a, b = np.triu_indices(len(g), 1)
                near = np.concatenate([estimate(sig[a[i : i + 20_000]], sig[b[i : i + 20_000]]) for i in range(0, len(a), 20_000)] or [np.zeros(0)]) >= FLOOR
                label = labels_of(len(g), a[near], b[near])
                own = np.flatnonzero(label != np.arange(len(g)))
                yield pd.DataFrame({"a": cls[own], "b": cls[label[own]]})

    return b.repartition(partitions_for(large), "path", "ti", "tj").sortWithinPartitions("path", "ti", "tj").mapInPandas(compare, "a long, b long")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, through postings of the tokens that more than one set has."""
    g = len(sets)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(g), [len(s) for s in sets])
    keep = count[token] > 1
    token, owner = token[keep], owner[keep]
    order = np.argsort(token, kind="stable")
    posting, sorted_token = owner[order], token[order]
    lo, hi = np.searchsorted(sorted_token, token), np.searchsorted(sorted_token, token, "right")
    out = np.zeros((g, g), dtype=np.int64)
    ends = np.searchsorted(owner, np.arange(g + 1))
    for i in range(g):
        a, n = lo[ends[i] : ends[i + 1]], (hi - lo)[ends[i] : ends[i + 1]]
        if len(a):
            at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
            out[i] = np.bincount(posting[at], minlength=g)
    return out


def _near_tiles(batches):
    """comp, ti, tj, i, cls, n, sig of a tile -> its classes with a near signature (of a fitting size) on the other side."""
    for pdf, starts in by_group(batches, ["comp", "ti", "tj"]):
        for part in np.split(np.arange(len(pdf)), starts[1:]):
            g = pdf.iloc[part]
            sig, n, own = np.frombuffer(b"".join(g["sig"]), dtype=np.uint8).reshape(len(g), BINS), g["n"].to_numpy(), g["i"].to_numpy()
            left = np.flatnonzero(own == g["ti"].iloc[0])
            right = left if g["ti"].iloc[0] == g["tj"].iloc[0] else np.flatnonzero(own == g["tj"].iloc[0])
            keep = np.zeros(len(g), dtype=bool)
            for k in left.tolist():
                fits = right[(right != k) & (n[right] >= LEAST * n[k] - 1e-9) & (n[k] >= LEAST * n[right] - 1e-9)]
                near = fits[estimate(sig[k][None], sig[fits]) >= FLOOR]
                keep[near] = True
                keep[k] |= len(near) > 0
            yield g[keep][["comp", "ti", "tj", "cls"]]


def _verify(threshold: float):
    def run(batches):
        for pdf, starts in by_group(batches, ["comp", "ti", "tj"]):
            out = []
            for part in np.split(np.arange(len(pdf)), starts[1:]):
                g = pdf.iloc[part]
                _, first = np.unique(g["cls"].to_numpy(), return_index=True)  # repeated rows give a class twice
                g = g.iloc[np.sort(first)]
                if len(g) < 2:
                    continue
                sets, cls, weight, block = [np.frombuffer(t, dtype=np.uint64) for t in g["tokens"]], g["cls"].to_numpy(), g["weight"].to_numpy(), g["i"].to_numpy()
                n = np.array([len(s) for s in sets])
                shared = common_counts(sets)
                linked = (shared * (1 + threshold) >= threshold * (n[:, None] + n[None]) - 1e-9) & (shared > 0)
                np.fill_diagonal(linked, False)
                if g["ti"].iloc[0] != g["tj"].iloc[0]:
                    linked &= block[:, None] != block[None]
                links = linked @ weight
                label = labels_of(len(cls), *np.nonzero(np.triu(linked)))
                has = np.flatnonzero(links)
                out.append(pd.DataFrame({"cls": cls[has], "other": cls[label[has]], "links": links[has]}))
            if out:
                yield pd.concat(out)

    return run


def _sets(rows: DataFrame, words: int, seed: int) -> DataFrame:
    """cls, comp, blocks, i, weight, text of a class's first row -> SETS; another row may have the id, its set is another's."""

    def work():
        def call(texts):
            for base, part in in_chunks(texts):
                sets = shingle_sets(part, words)
                yield range(base, base + len(part)), [len(s) for s in sets], [signature(s) if len(s) else b"" for s in sets], [s.tobytes() for s in sets], [class_of(s, seed)[0] for s in sets]

        return call

    return by_text(rows.select("cls", "comp", "blocks", "i", "weight", "text"), work, SETS + ", found long").where("found = cls").drop("found")


def _classes(text: DataFrame, words: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(a row for each document with its class, classes with sample and signature, classes with first row and weight, the
    seed of their names). Names are halves of 128-bit hashes; should two sets share one, all are named anew."""
    for seed in range(4):
        sketch = stored(sketches(text, words, seed), "jaccard-sketch")
        there = sketch.where("cls is not null")
        # A class goes by its smallest id, and among equal ones by the hash of the text; no id is larger than any.
        rep = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("rep")
        classes = stored(there.groupBy("cls").agg(rep, F.count("*").alias("weight"), F.max("n").alias("n"), (F.min("alt") != F.max("alt")).alias("several")), "jaccard-weights")
        if classes.where("several").isEmpty():
            one = stored(there.groupBy("cls").agg(F.first("sample").alias("sample"), F.first("sig").alias("sig")), "jaccard-classes")
            return stored(sketch.select("doc_id", "row", "cls", "n"), "jaccard-ids", free=True, drop=[sketch]), one, classes.drop("several"), seed
    raise RuntimeError("sets that share a 64-bit name under each of four hashes")


def _grouped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8, recall: float = MOST) -> DataFrame:
    """A row for each document: doc_id, row (the hash of its text), cls, n, name (of its group: none, doc_id, row), n_links, copies."""
    if threshold < LEAST or recall > MOST:
        raise ValueError(f"floors and splits are set for thresholds of {LEAST} or more and recalls of {MOST} or less")
    # A root's path misses a pair that does not share its token (1 - threshold) or that splits part (PARTED).
    roots = max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold * (1 - PARTED)))) if threshold < 1 else 1
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    sketch, one, classes, seed = _classes(text, words)
    comp = connected_components(candidate_edges(one, roots=roots)).select(F.col("node").alias("cls"), F.col("component").alias("comp"))
    comp = stored(comp, "jaccard-candidates", free=True, drop=[one])
    rows = comp.join(classes, "cls")
    size = rows.groupBy("comp").agg(F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(TOKENS))).cast("int").alias("blocks"))
    rows = rows.join(size, "comp").withColumn("i", F.pmod(_hash("cls"), F.col("blocks")).cast("int")).select("cls", "comp", "blocks", "i", "weight", "rep.doc_id", "rep.row")
    rows = rows.join(text.toDF("rep_id", "rep_row", "text"), F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("row") == F.col("rep_row")))
    sets = stored(_sets(rows, words, seed), "jaccard-sets", free=True)
    part = partitions_for(docs)
    # Of components in several blocks, each tile gets the sets of those classes only whose signature is near one of the tile.
    cut = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("i", j).alias("ti"), F.greatest("i", j).alias("tj")))
    large = sets.where("blocks > 1").select("comp", "cls", "i", "n", "sig", F.explode(cut).alias("t")).select("comp", "t.ti", "t.tj", "i", "cls", "n", "sig")
    near = stored(large.repartition(part, "comp", "ti", "tj").sortWithinPartitions("comp", "ti", "tj").mapInPandas(_near_tiles, "comp long, ti int, tj int, cls long"), "jaccard-near")
    whole = sets.select("comp", "i", "cls", "weight", "tokens")
    tiles = near.join(whole.drop("comp"), "cls").select("comp", "ti", "tj", "i", "cls", "weight", "tokens")
    tiles = tiles.unionAll(sets.where("blocks = 1").select("comp", F.lit(0).alias("ti"), F.lit(0).alias("tj"), "i", "cls", "weight", "tokens"))
    linked = tiles.repartition(part, "comp", "ti", "tj").sortWithinPartitions("comp", "ti", "tj").mapInPandas(_verify(threshold), "cls long, other long, links long")
    linked = stored(linked, "jaccard-linked", free=True, drop=[sets])
    groups_ = connected_components(linked.select(F.col("cls").alias("a"), F.col("other").alias("b")))
    count = linked.groupBy("cls").agg(F.sum("links").alias("links"))
    named = classes.join(groups_, F.col("cls") == F.col("node"), "left").withColumn("component", F.coalesce("component", "cls"))
    name = named.groupBy("component").agg(F.min("rep").alias("name"))
    named = named.join(name, "component").join(count, "cls", "left").select("cls", "name", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.col("weight").alias("copies"))
    return sketch.join(named, "cls", "left")


def groups(docs: DataFrame, **options) -> DataFrame:
    """A row for each document: doc_id, class_id (smallest id of its group of linked documents), n_links (documents of
    similarity `threshold` or more, copies included), copies (documents with the same set), n_shingles.

    Options: id_col, text_col, words, threshold, recall. Thresholds below LEAST and recalls above MOST are an error: the
    floors and splits would lose true pairs."""
    return _grouped(docs, **options).select("doc_id", F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("name.doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"), F.col("n").alias("n_shingles"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without all but one of each group: that with the smallest id stays, among rows of that id the text of
    the smallest hash (repeats of its row with it). Rows without an id go where their group has another."""
    g = _grouped(docs, id_col=id_col, text_col=text_col, **options).where(F.col("name").isNotNull())
    drop = g.where(~(F.col("doc_id").eqNullSafe(F.col("name.doc_id")) & (F.col("row") == F.col("name.row")))).select(F.col("doc_id").alias("__dropped"), F.col("row").alias("__row")).distinct()
    return docs.join(drop, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__dropped")) & (F.xxhash64(F.col(f"`{text_col}`")) == F.col("__row")), "left_anti")
