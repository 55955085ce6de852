"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of the embeddings of its hash and of the hashes of its first 3, 5 and 7 letters, so that
unseen inflections of a known word are not unknown. Filters of widths 1, 2 and 3 run over the whole text, each is
pooled to its maximum, and a logistic layer scores the pooled values. For scoring, a batch's distinct words are
multiplied with all filters once; positions then only add up rows of that product.

Fitting reads labelled rows whose crc32 of the id is not a multiple of `folds`: at most `sample` of each class, the
first by a hash of the id, collected to the driver (bounded in rows and in characters, parameters). A fifth of them is kept out of the training
to calibrate: a logistic map of the scores, weighted to the class shares of all labels, makes 0.5 the even odds, and a
threshold is set for each language with enough rows (for clean(); languages, labels, sources and ids are never inputs
of a score). Scoring covers every whole text.

Rows: a null or empty text has no words and gets the score of none; a null id is never held out nor learned from; of
repeated labels of an id the largest counts, null labels count for nothing; repeated rows are scored each; without both
classes every score is the share of toxic labels (0 if there are none); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_text, release, stored, text_batches, uniform

WORDS, PREFIXES, DIM, WIDTHS, FILTERS = 1 << 17, 1 << 15, 16, (1, 2, 3), 8
PREFIX = (3, 5, 7)
_TRIM = re.compile(r"^[\W\d_]+|[\W\d_]+$")
#: Words scored at once, which bounds a task's memory: a text of more words is still one text, scored whole.
CHUNK = 80_000


def features(word: str) -> tuple[int, ...]:
    """Rows of the embedding: of the word and of its first letters. Row 0 is empty."""
    w = _TRIM.sub("", word)
    if not w:
        return (0,) * (1 + len(PREFIX))
    own = 1 + zlib.crc32(w.encode(errors="surrogatepass")) % (WORDS - 1)
    return (own, *(WORDS + i * PREFIXES + zlib.crc32(w[:n].encode(errors="surrogatepass")) % PREFIXES if len(w) >= n else 0 for i, n in enumerate(PREFIX)))


def indexed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each distinct word, with an empty one first; word numbers of all texts, each followed by empty ones; where texts start)."""
    number: dict[str, int] = {"": 0}
    at, starts, parts = 0, [], []
    gap = [0] * max(1, WIDTHS[-1] - 1)
    for t in texts:
        words = t.lower().split() if t else []
        ids = [number.setdefault(w, len(number)) for w in words]
        starts.append(at)
        parts.append(ids + gap)
        at += len(ids) + len(gap)
    flat = np.fromiter((i for p in parts for i in p), dtype=np.int32, count=at)
    return np.array([features(w) for w in number], dtype=np.int32), flat, np.array(starts, dtype=np.int64)


class Net:
    """Embedding, filters and logistic layer, with the calibration and thresholds found for them."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.e = (rng.standard_normal((WORDS + len(PREFIX) * PREFIXES, DIM)) * 0.05).astype(np.float32)
        self.e[0] = 0
        self.w = [(rng.standard_normal((k, DIM, FILTERS)) / np.sqrt(k * DIM)).astype(np.float32) for k in WIDTHS]
        self.b = np.zeros(len(WIDTHS) * FILTERS, dtype=np.float32)
        self.v = (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.3).astype(np.float32)
        self.c, self.slope, self.shift = np.float32(0), 1.0, 0.0
        self.thresholds: dict[str, float] = {}
        self.prior: float | None = None

    @classmethod
    def of(cls, state: dict) -> Net:
        net = cls.__new__(cls)
        net.__dict__ = state
        return net

    def pooled(self, feats, flat, starts, argmax=False):
        x = self.e[feats].sum(axis=1)
        lengths = np.diff(np.append(starts, len(flat)))
        out, places = [], []
        for w in self.w:
            table = np.concatenate([x @ w[j] for j in range(len(w))], axis=1)
            y = table[flat, :FILTERS]
            for j in range(1, len(w)):
                y[: len(flat) - j] += table[flat[j:], j * FILTERS : (j + 1) * FILTERS]
            y[self.gaps(flat, starts)] = 0  # what begins after a text's last word reaches into the next text
            top = np.maximum.reduceat(y, starts, axis=0)
            out.append(top)
            if argmax:
                doc = np.repeat(np.arange(len(starts)), lengths)
                at = np.where(y == top[doc], np.arange(len(flat))[:, None], len(flat))
                places.append(np.minimum.reduceat(at, starts, axis=0))
        return x, np.concatenate(out, axis=1), places

    @staticmethod
    def gaps(flat, starts) -> np.ndarray:
        """Places of the empty words that follow each text."""
        return (np.append(starts[1:], len(flat))[:, None] - np.arange(1, max(1, WIDTHS[-1] - 1) + 1)[None]).ravel()

    def logits(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        _, top, _ = self.pooled(*indexed(texts))
        return np.maximum(top + self.b, 0).astype(np.float64) @ self.v + self.c

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(texts) + self.shift, -40, 40)))

    def train(self, texts: list[str | None], y: np.ndarray, epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 5) -> None:
        """Adam for the filters and the last layer, adaptive steps for the embedding rows that a maximum came from."""
        rng = np.random.default_rng(seed)
        dense = [*self.w, self.b, self.v]
        m, s = [np.zeros_like(p) for p in dense], [np.zeros_like(p) for p in dense]
        es, t = np.full(len(self.e), 1e-3, dtype=np.float32), 0
        weight = np.where(y == 1, 1.0, y.mean() / max(1e-9, 1 - y.mean()))
        weight = (weight / weight.mean()).astype(np.float32)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for i in range(0, len(order), batch):
                pick = order[i : i + batch]
                feats, flat, starts = indexed([texts[k] for k in pick])
                x, top, places = self.pooled(feats, flat, starts, argmax=True)
                h = np.maximum(top + self.b, 0)
                keep = (rng.random(h.shape) > 0.2).astype(np.float32) / 0.8
                hk = h * keep
                p = 1 / (1 + np.exp(-np.clip(hk @ self.v + self.c, -30, 30)))
                d = ((p - y[pick]) * weight[pick] / len(pick)).astype(np.float32)
                dh = d[:, None] * self.v[None] * keep * (h > 0)
                grads = [np.zeros_like(w) for w in self.w]
                dx = np.zeros_like(x)
                gap = np.zeros(len(flat), dtype=bool)
                gap[self.gaps(flat, starts)] = True
                for k, w in enumerate(self.w):
                    g = dh[:, k * FILTERS : (k + 1) * FILTERS]
                    for j in range(len(w)):
                        words = np.where(gap[places[k]], 0, flat[np.minimum(places[k] + j, len(flat) - 1)])  # documents x filters
                        grads[k][j] = np.einsum("nf,nfd->df", g, x[words])
                        np.add.at(dx, words.ravel(), (g[:, :, None] * w[j].T[None]).reshape(-1, DIM))
                t += 1
                for q, (par, g) in enumerate(zip(dense, [*grads, dh.sum(axis=0), hk.T @ d], strict=True)):
                    m[q] = 0.9 * m[q] + 0.1 * g
                    s[q] = 0.999 * s[q] + 0.001 * g * g
                    par -= rate * (m[q] / (1 - 0.9**t)) / (np.sqrt(s[q] / (1 - 0.999**t)) + 1e-8)
                self.c -= np.float32(rate * d.sum() * 5)
                used = np.flatnonzero(np.abs(dx).sum(axis=1))
                rows, g = feats[used].ravel(), np.repeat(dx[used], feats.shape[1], axis=0)
                rows, inverse = np.unique(rows, return_inverse=True)
                total = np.zeros((len(rows), DIM), dtype=np.float32)
                np.add.at(total, inverse, g)
                es[rows] += (total**2).mean(axis=1)
                self.e[rows] -= 0.1 * total / np.sqrt(es[rows])[:, None]
                self.e[0] = 0


def in_chunks(net: Net, texts: list[str | None]) -> np.ndarray:
    """Scores of texts, so many at a time that their words are about CHUNK, one text at least."""
    out, part, size = [np.zeros(0)], [], 0
    for t in texts:
        part.append(t)
        size += len(t) // 5 + 1 if t else 1
        if size >= CHUNK:
            out.append(net.scores(part))
            part, size = [], 0
    return np.concatenate([*out, net.scores(part)])


def calibrate(net: Net, texts, y: np.ndarray, langs: list[str | None], share: float, least: int = 20) -> None:
    """A logistic map of the logits, each class weighted to its share, and the threshold of each language by its best F1."""
    z = net.logits(texts)
    centre, scale = z.mean(), z.std() + 1e-9
    u = (z - centre) / scale
    w = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    a, b = 1.0, 0.0
    for _ in range(100):  # Newton steps with a little ridge
        p = 1 / (1 + np.exp(-np.clip(a * u + b, -30, 30)))
        ga, gb = (w * (p - y) * u).sum() + 1e-3 * a, (w * (p - y)).sum()
        q = w * p * (1 - p)
        haa, hab, hbb = (q * u * u).sum() + 1e-3, (q * u).sum(), q.sum() + 1e-6
        det = haa * hbb - hab * hab
        a, b = a - (hbb * ga - hab * gb) / det, b - (haa * gb - hab * ga) / det
    net.slope, net.shift = float(max(a, 1e-3) / scale), float(b - max(a, 1e-3) * centre / scale)
    p = 1 / (1 + np.exp(-np.clip(net.slope * z + net.shift, -40, 40)))
    lang = np.array([x or "" for x in langs])
    for name in ["", *sorted(set(lang) - {""})]:
        here = lang == name if name else np.ones(len(p), dtype=bool)
        if min((y[here] == 1).sum(), (y[here] == 0).sum()) < least:
            continue
        cuts = np.unique(np.round(p[here], 4))
        weights = np.where(y[here] == 1, share / (y[here] == 1).sum(), (1 - share) / (y[here] == 0).sum())
        f1 = [2 * weights[(p[here] >= c) & (y[here] == 1)].sum() / max(1e-12, weights[p[here] >= c].sum() + share) for c in cuts]
        best = np.flatnonzero(np.array(f1) >= max(f1) - 1e-9)
        net.thresholds[name] = float(np.clip(cuts[best[len(best) // 2]], 0.02, 0.98))


def held_out(doc_id, folds: int = 5):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", folds: int = 5, sample: int = 3000, longest: int = 200_000, most_chars: int = 48_000_000, seed: int = 11) -> Net:
    """Learns from at most `sample` labelled documents of each class, outside the fold that is held out.

    The sample is bounded in characters too: texts of over `longest` are not learned from, and of the others the first
    (by a hash of the id) that have `most_chars` together. An id with several rows is learned from once, by the smallest
    of its texts."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~held_out(F.col("doc_id"), folds)).groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("u", uniform(F.col("doc_id"), seed))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    net = Net()
    if not (counts.get(0) and counts.get(1)):
        net.prior = 1.0 if counts.get(1) else 0.0
        return net
    picked = [known.where(F.col("y") == c).orderBy("u", "doc_id").limit(sample) for c in (0, 1)]
    picked = picked[0].unionAll(picked[1])  # a bounded number of rows, so that this side can be broadcast
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.coalesce(F.length(F.col(text_col)), F.lit(0)) <= longest)
    rows = text.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y", "u").agg(F.min(F.struct("text", "lang")).alias("d")).select("doc_id", "y", "u", "d.*")
    rows = stored(rows.withColumn("chars", F.coalesce(F.length("text"), F.lit(0))), "toxic-sample")  # at most 2 * sample rows
    sizes = rows.select("u", "doc_id", "chars").orderBy("u", "doc_id").toPandas()
    last = sizes["u"][sizes["chars"].cumsum() <= most_chars].max()
    rows = rows.where(F.col("u") <= F.lit(float(last))).orderBy("u", "doc_id").toPandas()
    y, texts, langs = rows["y"].to_numpy(), rows["text"].tolist(), rows["lang"].tolist()
    if len(set(y.tolist())) < 2:
        net.prior = float(y.mean()) if len(y) else 0.0
        return net
    aside = np.arange(len(y)) % 5 == 4
    if min((y[aside] == 1).sum(), (y[aside] == 0).sum()) < 2:  # too few rows to keep some aside
        aside = np.ones(len(y), dtype=bool)
        learn = aside
    else:
        learn = ~aside
    net.train([t for t, k in zip(texts, learn, strict=True) if k], y[learn])
    calibrate(net, [t for t, k in zip(texts, aside, strict=True) if k], y[aside], [x for x, k in zip(langs, aside, strict=True) if k], counts[1] / (counts[0] + counts[1]))
    del rows, texts
    release(docs.sparkSession)
    return net


def score(docs: DataFrame, net: Net, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted: a row for each document, from its whole text."""
    model = docs.sparkSession.sparkContext.broadcast(net.__dict__)

    def work():
        return lambda texts: [(range(len(texts)), in_chunks(Net.of(model.value), texts))]

    out = by_text(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def is_toxic(docs: DataFrame, net: Net, *, text_col: str = "text", lang_col: str = "lang") -> Column:
    """Whether a document's score is at or above the threshold of its language; a condition, so no column of docs can clash."""
    model = docs.sparkSession.sparkContext.broadcast(net.__dict__)

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(in_chunks(Net.of(model.value), text.tolist()))

    limit = F.lit(net.thresholds.get("", 0.5))
    for name, cut in sorted(net.thresholds.items()):
        limit = F.when(F.col(f"`{lang_col}`") == name, cut).otherwise(limit) if name else limit
    return scored(F.col(f"`{text_col}`")) >= limit


def clean(docs: DataFrame, net: Net, **columns) -> DataFrame:
    """The documents below their language's threshold, with the columns that they had."""
    return text_batches(docs).where(~is_toxic(docs, net, **columns))
