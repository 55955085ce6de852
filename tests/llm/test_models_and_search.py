import math
import random
import sys
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import decontaminate, jaccard, licences, mixing, neighbours, toxicity

DOC = "doc_id long, text string, lang string, source string, score double"  # score clashes with the operators' own


# ---- nearest neighbours


def brute_nearest(rows, k):
    ok = [(i, np.array(v, dtype=np.float64)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    out = []
    for q, x in ok:
        if q % 100:
            continue
        near = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in ok if i != q and len(y) == len(x))[:k]
        out += [(q, r + 1, i, round(s, 9)) for r, (s, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(8192, 2048), (16, 2)])
def test_nearest_equals_brute_force(spark, blocks):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(8).round(3).tolist()) for i in range(420)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]  # one common vector
    rows += [(2000, None), (2001, []), (2002, [0.0] * 8), (2100, [1.0, None] + [0.0] * 6), (2200, [float("nan")] * 8), (2300, [float("inf")] + [1.0] * 7), (2400, [1.0, 2.0]), (2401, [1.0, 2.5]), (None, rows[5][1]), (1, rows[1][1]), (100, rows[7][1])]
    df = spark.createDataFrame([(*r, "z") for r in rows], "vec_id long, embedding array<double>, rank string")
    got = neighbours.nearest(df, k=7, candidate_block=blocks[0], query_block=blocks[1]).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got if r["query_id"] != 100) == [x for x in brute_nearest(rows, 7) if x[0] != 100]
    assert {r["query_id"] for r in got} >= {0, 100, 200, 2400}
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_repeated_rows_keep_all_neighbours(spark):
    """A query row twelve times, others that share its vector, and candidate rows twelve times."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.standard_normal(8).round(3).tolist()) for i in range(120)]
    rows += [rows[0]] * 11 + [(501 + i, rows[0][1]) for i in range(3)] + [(7, rows[0][1])] * 12
    rows += [rows[20]] * 11
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for k in (5, 20):
        got = neighbours.nearest(df, k=k, candidate_block=16, query_block=2).collect()
        want = []
        for q in (0, 100):
            asks = {tuple(v) for i, v in rows if i == q}
            all_ = sorted((float(np.sqrt(((np.array(x) - np.array(y)) ** 2).sum())), i) for x in asks for i, y in rows if i != q)[:k]
            want += [(q, r + 1, i, round(s, 9)) for r, (s, i) in enumerate(all_)]
        assert sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in got) == want


@pytest.mark.parametrize("scales", [(1e160,), (1e-170,), (1e300, 1.0), (1e160, 1e-160, 1.0), (5e-324,), (1e-308, 1e307)])
def test_magnitudes_lose_no_neighbours(spark, scales):
    """Finite vectors whose squares overflow or vanish, alone and beside others."""
    rng = np.random.default_rng(8)
    rows = [(100 * i if i < 5 else 100 * i + 1, (rng.integers(1, 9, 4) * scales[i % len(scales)]).tolist()) for i in range(24)]
    got = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3, candidate_block=4, query_block=2).collect()
    dist = lambda x, y: math.dist(x, y)  # noqa: E731  scales by the largest difference itself
    want = []
    for q, x in rows[:5]:
        want += [(q, r + 1, s) for r, s in enumerate(sorted(dist(x, y) for i, y in rows if i != q)[:3])]
    found = sorted((r["query_id"], r["rank"], r["score"]) for r in got)
    assert [f[:2] for f in found] == [w[:2] for w in want]
    assert all(f[2] == w[2] or abs(f[2] / w[2] - 1) < 1e-9 for f, w in zip(found, want, strict=True))


def test_tile_bounds_hold():
    import pandas as pd

    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 64)) * rng.lognormal(0, 2, (40, 1))
    top = np.abs(x).max(axis=1, keepdims=True)
    c = np.rint(x / top * 127)
    t = pd.DataFrame({"rep": range(40), "dim": 64, "code": [r.tobytes() for r in c.astype(np.int8)], "scale": top[:, 0] / 127, "miss": np.sqrt(((x - c * top / 127) ** 2).sum(axis=1))})
    for r in neighbours.product_tile(t, t, 40).itertuples():
        true = np.sqrt(((x[r.query] - x[r.rep]) ** 2).sum())
        assert r.low <= true + 1e-9 and true <= r.bound + 1e-9


# ---- mixing


def water_fill(sizes, share, weights, cap):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, total = {}, share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        rest, sw = total - sum(fixed.values()), sum(w[s] for s in free)
        target = {s: rest * w[s] / sw for s in free}
        over = [s for s in free if target[s] >= cap * sizes[s]]
        if not over:
            return fixed | target
        fixed |= {s: cap * sizes[s] for s in over}


def test_mix_reaches_its_targets(spark):
    rng = random.Random(3)
    rows = []
    for s, n in (("a", 3000), ("b", 150), ("é", 300), (None, 90), ("", 40)):
        rows += [(len(rows) + i, " ".join(["w"] * int(rng.lognormvariate(3, 1))), "en", s, 0.0) for i in range(n)]
    rows += [(-1, None, "en", "a", 0.0), (-2, " \t", None, "a", 0.0), (7, rows[7][1], "en", rows[7][3], 0.0)]
    docs = spark.createDataFrame(rows, DOC)
    got = mixing.mix(docs).collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want, taken = water_fill(sizes, 1.5, (3, 1, 2), 2), defaultdict(int)
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 2 and abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]]
        taken[r["source"]] += r["taken"]
        assert r["copies"] >= int(want[r["source"]] / sizes[r["source"]])  # certain whole copies
    assert len(got) == len(rows)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(12, 0.01 * want[s]), s
    again = {(r["doc_id"], r["size"]): r["copies"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["size"]): r["copies"] for r in got}
    copies = mixing.copies(docs)
    assert copies.columns == docs.columns and copies.count() == sum(r["copies"] for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_pareto_sampling_follows_weights(spark):
    rows = [(i, "w", "en", s, 3.0 if i % 2 else 1.0) for i in range(4000) for s in "a"] + [(9000 + i, "w w w", "en", "b", 1.0) for i in range(500)]
    got = mixing.mix(spark.createDataFrame(rows, DOC), share=0.4, weights=(1.0, 1.0), weight_col="score").where("source = 'a'").collect()
    by = [np.mean([r["copies"] for r in got if r["doc_id"] % 2 == k]) for k in (0, 1)]
    assert 2.2 < by[1] / by[0] < 4


def test_inclusion_follows_the_odds(spark):
    """The same sizes in many sources, each with its own random numbers: how often each place is taken, against its probability."""
    rng = random.Random(12)
    sizes = [int(rng.lognormvariate(3, 1)) + 1 for _ in range(120)] + [200, 300]
    sources = 400
    rows = [(i * sources + s, "w " * n, "en", f"s{s:03}", 0.0) for s in range(sources) for i, n in enumerate(sizes)]
    got = mixing.mix(spark.createDataFrame(rows, DOC), share=0.45, weights=(1.0,)).collect()
    p, taken, words = np.zeros(len(sizes)), np.zeros(len(sizes)), defaultdict(int)
    for r in got:
        p[r["doc_id"] // sources] = r["inclusion"]
        taken[r["doc_id"] // sources] += r["copies"] / sources
        words[r["source"]] += r["taken"]
    target = 0.45 * sum(sizes)
    assert all(abs(w - target) <= 0.03 * target for w in words.values())
    assert abs((p * sizes).sum() - target) < 1e-6 * target  # the expected words are the target
    small = [k for k, n in enumerate(sizes) if n <= np.mean(sizes)]
    assert len({round(p[k], 9) for k in small}) == 1 and 0 < p[-1] < p[-2] < 0.5 * p[small[0]]
    # The passes that close the gap favour the smallest ones a little (measured: 0.13 at most, 0.03 on average).
    assert np.abs(taken - p).max() < 0.2 and np.abs(taken - p).mean() < 0.05 and np.corrcoef(taken, p)[0, 1] > 0.95


# ---- decontamination


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["the", "of", "and"]) if rng.random() < 0.4 else f"w{rng.randrange(3000)}"
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, f"{text(rng.randrange(8, 30))}?\n{text(rng.randrange(1, 12))}" if i % 2 else text(rng.randrange(6, 40)), 0.0) for i in range(60)]
    items += [(60, None, 0.0), (61, "", 0.0), (62, "single", 0.0), (63, items[3][1], 0.0)]
    docs = [text(rng.randrange(0, 300)) for _ in range(120)]
    for k in range(30):
        w = items[k][1].split()
        docs.append(text(rng.randrange(0, 200)) + " " + items[k][1].upper() + "!! " + text(rng.randrange(0, 200)))
        docs.append(text(90) + " " + " ".join(w[: len(w) // 3]) + " " + text(50))
    docs.append(text(30_000) + " " + items[5][1] + " " + text(10))
    rows = [(i, d, "en", "s", 0.0) for i, d in enumerate(docs)] + [(999, None, None, None, None), (998, "", "", "", 0.0), (120, docs[120], "en", "s", 0.0)]
    d, b = spark.createDataFrame(rows, DOC), spark.createDataFrame(items, "item_id long, text string, score double")
    got = decontaminate.leaks(d, b).collect()
    want = set()
    for i, t, *_ in rows:
        w = decontaminate.words(t)
        held = {g for n in range(1, 6) for g in zip(*(w[k:] for k in range(n)), strict=False)}
        for k, it, _ in items:
            parts = [set(decontaminate.grams(p, 5)) for p in decontaminate.split_item(it or "")]
            if any(parts) and all(len(p & held) >= 0.6 * len(p) for p in parts):
                want.add((i, k))
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(want) >= 31
    leaking = {i for i, _ in want}
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns and sorted(map(str, kept.collect())) == sorted(str(r) for r in d.collect() if r["doc_id"] not in leaking)
    sharded = decontaminate.leaks(d, b, shard_bytes=700).collect()
    assert sorted((r["doc_id"], r["item_id"], round(r["score"], 6)) for r in sharded) == sorted((r["doc_id"], r["item_id"], round(r["score"], 6)) for r in got)
    assert decontaminate.leaks(d.limit(0), b).count() == 0 and decontaminate.leaks(d, b.limit(0)).count() == 0


def test_question_and_answer_must_both_be_there(spark):
    q, a = " ".join(f"q{i}" for i in range(30)), " ".join(f"a{i}" for i in range(6))
    b = spark.createDataFrame([(1, f"{q}?\n{a}"), (2, " ".join(f"z{i}" for i in range(400)))], "item_id long, text string")
    docs = [(None, f"x {q} y {a} z"), (2, f"x {q} y"), (3, f"{a} and {a}"), (4, f"{a} {q}"), (5, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted((str(r["doc_id"]), r["item_id"]) for r in decontaminate.leaks(d, b).collect()) == [("4", 1), ("None", 1)]
    assert sorted(r["doc_id"] for r in decontaminate.clean(d, b, shard_bytes=300).collect()) == [2, 3, 5]


def test_pruning_keeps_all_above_the_threshold():
    rng = random.Random(9)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(12))) for i in range(40)]
    from collections import Counter

    ws = [decontaminate.words(t) for _, t in items]
    df = Counter(x for w in ws for x in set(w))
    index = decontaminate.Index(items, df, len(ws), sum(map(len, ws)) / len(ws), 0.4, 5, block=4)
    docs = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(0, 40))] for _ in range(80)]
    found = {(d, i) for d, i, *_ in index.search(docs, verify=0.0)}
    step, want = index.longest, set()
    for d, w in enumerate(docs):
        for a in range(0, max(1, len(w)), step):
            here = {index.vocabulary.get(x) for x in w[a : a + 2 * step]}
            for k, (terms, weights) in enumerate(zip(index.terms, index.weights, strict=True)):
                if sum(x for t, x in zip(terms.tolist(), weights.tolist(), strict=True) if t in here) >= index.limits[k]:
                    want.add((d, index.ids[k]))
    assert found == want and want


def test_an_index_is_as_small_as_its_estimate(spark):
    """Half of the words are rare, so that the vocabulary counts too; null ids keep their items."""
    import pickle
    from collections import Counter

    rng = random.Random(4)
    items = [(i or None, " ".join(f"r{rng.randrange(60_000)}" if rng.random() < 0.5 else f"c{rng.randrange(200)}" for _ in range(rng.randrange(5, 150)))) for i in range(3000)]
    ws = [decontaminate.words(t) for _, t in items]
    df = Counter(x for w in ws for x in set(w))
    n = sum(map(len, ws))
    index = decontaminate.Index(items, df, len(ws), n / len(ws), 0.4, 5)
    most = decontaminate.BYTES_WORD * n + decontaminate.BYTES_TERM * len(df)
    arrays = sum(x.nbytes for x in index.__dict__.values() if isinstance(x, np.ndarray))
    assert arrays + sum(sys.getsizeof(w) + 32 for w in index.vocabulary) + sys.getsizeof(index.vocabulary) < most and len(pickle.dumps(index.__dict__)) < most
    assert {i for _, i, *_ in index.search([ws[0], ws[7]], verify=1.0)} == {None, 7}
    shards = decontaminate._shards(n, len(df), most // 3)
    assert 3 <= shards <= 40 and decontaminate._shards(0, -1, 10) == 0 and decontaminate._shards(n, len(df), most) == 1
    b = spark.createDataFrame(items[:40], "item_id long, text string")
    d = spark.createDataFrame([(k, items[k][1]) for k in range(0, 40, 4)], "doc_id long, text string")
    found = lambda **o: sorted((r["doc_id"], str(r["item_id"])) for r in decontaminate.leaks(d, b, **o).collect())
    assert found(index_bytes=200_000) == found() == sorted((k, str(k or None)) for k in range(0, 40, 4))


def test_passages_do_not_depend_on_shards(spark):
    """A short item whose halves lie further apart than twice its own length, within a passage of the longest item."""
    half = [" ".join(f"h{k}w{i}" for i in range(10)) for k in range(2)]
    items = [(1, " ".join(half))] + [(2 + j, " ".join(f"l{j}w{i}" for i in range(200 - j))) for j in range(6)]
    filler = " ".join(f"f{i}" for i in range(50))
    d = spark.createDataFrame([(1, f"{half[0]} {filler} {half[1]}")], "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    one = decontaminate.leaks(d, b).collect()
    assert [r["item_id"] for r in one] == [1]
    for size in (1000, 300):
        assert decontaminate.leaks(d, b, shard_bytes=size).collect() == one


# ---- licences


UNSEEN = (
    "This software is provided 'as-is', without any express or implied warranty.",
    "Licensed under CC BY-ND 4.0.",
    "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "This work is licensed under the GNU General Public License, version 1.",
    "Licensed under the Apache License, Version 1.1.",
    "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
    "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Released under the Artistic License 2.0.",
    "This database is made available under the Open Database License.",
    "The contents of this file are subject to the terms of the Common Development and Distribution License.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications.",
    "This product is licensed under the European Union Public Licence.",
)


@pytest.mark.parametrize("line, family, confirmed", [
    ("Licensed under CC BY-SA 4.0.", "cc-by-sa-4.0", True), ("Licensed under CC BY 4.0.", "cc-by-4.0", True), ("Licensed under CC BY-ND 4.0.", "cc-by-4.0", False), ("Licensed under CC BY-ND 4.0.", "cc-by-sa-4.0", False),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl-3.0", True), ("This work is licensed under the GNU General Public License, version 1.", "gpl-3.0", False),
    ("This work is licensed under the GNU Affero General Public License, version 3.", "gpl-3.0", False), ("Licensed under the Apache License, Version 1.1.", "apache-2.0", False),
])
def test_versions_and_conditions_decide(line, family, confirmed):
    assert licences.compare(licences.words(line), family, 0.5)[1] is confirmed


def test_licence_paragraphs(spark):
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(["the", "river", "mit", "of", "was", "und", "license", "grew", "to", "and", "2.0", "field", "public"]) for _ in range(n))
    docs = [(i, "\n".join(prose(rng.randrange(3, 60)) for _ in range(5)), "en", "s", 0.0) for i in range(150)]
    planted = {}
    for k, (family, ts) in enumerate(licences.TEMPLATES.items()):
        for j, t in enumerate(ts):
            docs.append((1000 + 10 * k + j, f"{prose(20)}\n{t}\n\n{prose(9)}", "en", "s", 0.0))
            planted[1000 + 10 * k + j] = family
    docs += [(5000, None, None, None, None), (5001, "", "", "", 0.0), (5002, "\n \n", "", "", 0.0), (1000, docs[150][1], "en", "s", 0.0), (None, "Released under the MIT License.", "en", "s", 0.0)]
    df = spark.createDataFrame(docs, DOC)
    model = licences.fit(df)
    got = licences.scan(df, model).collect()
    hit = {(r["doc_id"], r["family"]) for r in got if r["confirmed"]}
    assert {(d, f) for d, f in planted.items()} <= hit and (None, "mit") in hit
    prose_hits = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 1000]  # of 750 lines of prose with some licence words
    assert all(r["family"] == "unknown" for r in prose_hits) and len(prose_hits) <= 7  # 99 % of other text
    assert sum(r["doc_id"] == 1000 for r in got) == 2 and all(r["paragraph"] == 1 for r in got if r["doc_id"] in planted)
    for line in (docs[0][1], docs[150][1], *licences.OTHERS):  # the bound never passes over what would be reported
        for w in map(licences.words, line.split("\n")):
            if w and model.probabilities(w)[-1] < 0.5:
                assert sum(model.top.get(x, 0.0) for x in w) >= model.floor()
    # Licences of no family, none of them among the sentences of training or calibration: reported, as unknown.
    unseen = spark.createDataFrame([(i, t, "en", "s", 0.0) for i, t in enumerate(UNSEEN)], DOC)
    reported = {r["doc_id"]: (r["family"], r["confirmed"]) for r in licences.scan(unseen, model).collect()}
    assert set(reported.values()) == {("unknown", False)} and len(reported) >= 0.8 * len(UNSEEN)
    assert licences.scan(df.limit(0), model).count() == 0 and licences.fit(df.limit(0)).top


def test_wrapped_licences_are_confirmed(spark):
    import textwrap

    prose = "The river rose in spring and the field was wet.\nNo one went there."
    docs, want = [], set()
    for k, (family, ts) in enumerate(licences.TEMPLATES.items()):
        for j, t in enumerate(ts):
            if len(licences.words(t)) > 24:
                docs.append((10 * k + j, f"{prose}\n\n{textwrap.fill(t, 72, initial_indent=' * ', subsequent_indent=' * ')}\n\n{prose}", "en", "s", 0.0))
                docs.append((5000 + 10 * k + j, f"{prose}\n{textwrap.fill(t, 72)}\n{prose}", "en", "s", 0.0))
                want |= {(10 * k + j, family), (5000 + 10 * k + j, family)}
    docs += [(9000 + i, f"{prose}\n\n{prose}", "en", "s", 0.0) for i in range(40)]
    df = spark.createDataFrame(docs, DOC)
    got = {(r["doc_id"], r["family"]) for r in licences.scan(df, licences.fit(df)).collect() if r["confirmed"]}
    assert len(want) > 15 and want <= got and all(d < 9000 for d, _ in got)


# ---- toxicity


def test_toxicity_held_out(spark):
    rng = random.Random(4)
    bad = ["idiot", "scum", "moronic", "trashling"]
    rows, labels = [], []
    for i in range(1200):
        w = [f"w{rng.randrange(800)}" for _ in range(rng.randrange(5, 120))]
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w), rng.choice(["en", "de"]), "s", 0.0))
        labels.append((i, int(toxic)))
    truth = dict(labels)
    rows += [(5000, None, None, None, None), (5001, "", "", "", 0.0), (0, rows[0][1], "en", "s", 0.0), (None, "idiot", "en", "s", 0.0)]
    df, lab = spark.createDataFrame(rows, DOC), spark.createDataFrame([*labels, (0, None), (1, truth[1]), (None, 1)], "doc_id long, toxic int")
    net = toxicity.fit(df, lab)
    got = toxicity.score(df, net).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    import zlib

    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in out]) > 0.95
    turned = spark.createDataFrame([(-r[0] if r[0] else r[0], r[1], "xx", "t", 1.0) for r in rows], DOC)  # scores depend on the text only
    assert sorted(round(r["score"], 12) for r in toxicity.score(turned, net).collect()) == sorted(round(r["score"], 12) for r in got)
    given = df.withColumn("toxic_flag", F.lit("mine"))
    kept = toxicity.clean(given, net)
    assert kept.columns == given.columns and 0 < kept.count() < len(rows)
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in df.where(~toxicity.is_toxic(df, net)).collect()}
    small = toxicity.fit(df, lab, longest=300, most_chars=20_000)  # bounds of what is collected
    assert small.prior is None and toxicity.score(df, small).count() == len(rows)
    again = {r["doc_id"]: r["score"] for r in toxicity.score(df, toxicity.fit(df.repartition(5), lab.repartition(3))).collect()}
    assert all(abs(again[r["doc_id"]] - r["score"]) < 1e-4 for r in got)  # float32 products of other batches


def test_toxicity_without_two_classes(spark):
    df = spark.createDataFrame([(1, "a b", "en", "s", 0.0)], DOC)
    for lab, want in (([], 0.0), ([(2, 0)], 0.0), ([(2, 1), (3, 1)], 1.0)):
        net = toxicity.fit(df, spark.createDataFrame(lab, "doc_id long, toxic int"))
        assert toxicity.score(df, net).first()["score"] == want
    assert toxicity.score(df.limit(0), net).count() == 0


def test_ids_beside_nulls_stay_exact(spark):
    """Ids that no double holds, in a batch with a null id."""
    big = (1 << 53) + 1
    item = " ".join(f"z{i}" for i in range(40))
    text = f"Released under the MIT License.\n{item}\nidiot"
    df = spark.createDataFrame([(None, text, "en", "s", 0.0), (big, text, "en", "s", 0.0), (-big, "other words", "en", "s", 0.0)], DOC).coalesce(1)
    b = spark.createDataFrame([(big, item)], "item_id long, text string")
    ids = lambda out, c="doc_id": {r[c] for r in out.collect()}
    found = licences.scan(df, licences.fit(df))
    assert ids(found.where("confirmed")) == {None, big} and ids(found) <= {None, big, -big}
    assert ids(toxicity.score(df, toxicity.fit(df, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")))) == {None, big, -big}
    assert ids(decontaminate.leaks(df, b)) == {None, big} and ids(decontaminate.leaks(df, b), "item_id") == {big}
    assert ids(jaccard.groups(df)) == {None, big, -big} and ids(jaccard.groups(df), "class_id") == {big, -big}
