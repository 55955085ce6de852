import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillstone.llm import jaccard, suffixdup
from quillstone.llm.common import connected_components

SCHEMA = "doc_id long, text string, cls string, lo int"  # the last two clash with names that the operators use


def words(rng, n):
    return [f"w{rng.randrange(400)}" for _ in range(n)]


def corpus():
    rng = random.Random(7)
    docs = [words(rng, rng.randrange(20, 120)) for _ in range(40)]
    passage = words(rng, 70)
    docs += [words(rng, 30) + passage + words(rng, 30) for _ in range(12)]
    base = words(rng, 90)
    for i in range(30):  # near copies
        d = list(base)
        d[rng.randrange(90)] = f"x{i}"
        docs.append(d)
    docs += [list(docs[0]) for _ in range(5)] + [["a", "b"], ["a", "b"], ["a", "c"], ["Loop"] * 300]
    rows = [(i, " ".join(d), "z", 1) for i, d in enumerate(docs)]
    return rows + [(900, None, None, None), (901, "", "", 0), (902, " \n ", "", 0), (None, "only here once " * 3, "q", 2), (3, rows[3][1], "again", 5)]


@pytest.mark.parametrize("options", [{"threshold": 0.5}, {"threshold": 0.79}, {"recall": 1 - 1e-9}])
def test_thresholds_that_floors_are_not_set_for_are_refused(spark, options):
    with pytest.raises(ValueError, match="floors"):
        jaccard.groups(spark.createDataFrame([(1, "a b c")], "doc_id long, text string"), **options)


def brute_groups(rows, t=0.8):
    sets = []
    for _, text, *_ in rows:
        w = (text or "").lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    links, parent = Counter(), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and len(a & b) / len(a | b) >= t:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(rows[i][0])
    name = {k: min((x for x in v if x is not None), default=None) for k, v in members.items()}
    return sorted(((rows[i][0], rows[i][0] if not sets[i] else name[root(i)], links[i]) for i in range(len(rows))), key=str)


@pytest.mark.parametrize("limits", [{}, {"LEAF": 5, "BLOCK": 4, "PIVOTS": 2}, {"LEAF": 2, "BLOCK": 3, "LEVELS": 1}, {"TOKENS": 200}])
def test_groups_equal_brute_force(spark, monkeypatch, limits):
    for k, v in limits.items():
        monkeypatch.setattr(jaccard, k, v)
    rows = corpus()
    got = jaccard.groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in got), key=str) == brute_groups(rows)


def test_one_of_each_group_stays(spark):
    rows = corpus()
    kept = jaccard.keep_one(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "cls", "lo"]
    names = {c for d, c, n in brute_groups(rows)}
    ids = {r["doc_id"] for r in kept.collect()}
    assert {i for i in names if i is not None} <= ids and {900, 901, 902} <= ids and None in ids
    assert len(ids) == len({(c if n else d) for d, c, n in brute_groups(rows)})


def test_rows_without_or_with_equal_ids(spark):
    """Copies without an id go where another has one; two texts of one id are two documents."""
    a, b, c = (" ".join(f"{p}{i}" for i in range(60)) for p in "abc")
    near = a.replace("a30", "x")
    rows = [(None, a, "1"), (5, a, "2"), (3, near, "3"), (3, b, "4"), (4, b + " end", "5"), (3, near, "6"), (None, c, "7"), (None, c, "8"), (None, None, "9"), (None, "", "10")]
    d = spark.createDataFrame(rows, "doc_id long, text string, row string")
    kept = [(r["doc_id"], r["text"]) for r in jaccard.keep_one(d).collect()]
    assert sorted(kept, key=str) == sorted([(3, near), (3, near), (3, b), (None, c), (None, c), (None, None), (None, "")], key=str)
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"], r["copies"]) for r in jaccard.groups(d).collect()), key=str)
    want = [(None, 3, 3, 2), (5, 3, 3, 2), (3, 3, 3, 2), (3, 3, 3, 2), (3, 3, 1, 1), (4, 3, 1, 1), (None, None, 1, 2), (None, None, 1, 2), (None, None, 0, 1), (None, None, 0, 1)]
    assert got == sorted(want, key=str)


def test_recall_at_the_default_limits(spark):
    """Buckets far above LEAF: pairs of a similarity just above the threshold among documents that share boilerplate."""
    rng = random.Random(13)
    shared = [f"s{rng.randrange(10**6)}" for _ in range(90)]  # in every document; alone it makes no pair similar
    rows, pairs = [], []
    for i in range(1500):
        own = [f"o{rng.randrange(10**7)}" for _ in range(110)]
        d = shared + own
        other = list(d)
        other[rng.randrange(100, 190)] = f"x{i}"  # up to five shingles of 196 on either side
        other += [f"y{rng.randrange(10**7)}" for _ in range(28)]
        pairs.append((2 * i, 2 * i + 1))
        rows += [(2 * i, " ".join(d)), (2 * i + 1, " ".join(other))]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    like = [len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in pairs]
    assert 0.8 <= min(like) and max(like) < 0.86 and len(sets[0] & sets[2]) / len(sets[0] | sets[2]) < 0.4
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: (i - i % 2, 1) for i, _ in rows}


def test_names_that_collide_are_given_anew(spark, monkeypatch):
    real = jaccard.class_of
    monkeypatch.setattr(jaccard, "class_of", lambda tokens, seed=0: (real(tokens)[0] and (7 if seed == 0 else real(tokens, seed)[0]), real(tokens, seed)[1]))
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h i j k l"), (4, None)]
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0)]


def test_components_that_are_not_final_are_an_error(spark):
    with pytest.raises(RuntimeError, match="not final"):
        connected_components(spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long"), rounds=1)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert jaccard.groups(empty).count() == 0 and suffixdup.cut(empty).count() == 0


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 4), (7, 7), (9, 8), (8, 3), (1, 2)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 1, 9: 1, 4: 4, 5: 4}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    for share in (0.3, 0.8, 1.0):
        a = np.unique(rng.integers(0, 1 << 63, 2000).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * share)], rng.integers(0, 1 << 63, int(2000 * (1 - share))).astype(np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        sig = [np.frombuffer(jaccard.signature(x), dtype=np.uint8)[None] for x in (a, b)]
        assert abs(jaccard.estimate(*sig)[0] - true) < 0.16


def brute_cut(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[p : p + length] for r in raw for p in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), dtype=bool)
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(r, dtype=np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("large", [suffixdup.LARGE, 2])
def test_repeats_equal_brute_force(spark, large):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    shared, base = text(430), text(900)
    docs = [text(rng.randrange(0, 700)) for _ in range(15)]
    docs += [text(200) + shared + text(rng.randrange(0, 300)) for _ in range(6)] + [text(50) + shared[10:410] for _ in range(2)] + [shared[:399]]
    docs += [base, base, base[:500] + "#" + base[501:], base[100:], "ab" * 600, "line\n" * 120, text(450) + shared[:405] + "|" + shared[:405]]
    docs += [text(rng.randrange(0, 9)) + base[a : a + 420 + rng.randrange(0, 80)] + text(rng.randrange(0, 9)) for a in range(0, 300, 7)]
    rows = [(i, d, "c", 3) for i, d in enumerate(docs)] + [(100, None, "c", 1), (101, "", "c", 1), (0, docs[0], "c", 2), (102, "x" * 400, None, None), (None, base[:600], "c", 1), (None, text(500), "c", 1), ((1 << 53) + 1, docs[3], "c", 1)]
    got = suffixdup.cut(spark.createDataFrame(rows, SCHEMA), large=large).collect()
    want = sorted(((r[0], *b) for r, b in zip(rows, brute_cut([r[1] for r in rows], 400), strict=True)), key=str)
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=str) == want


def test_runs_mark_the_windows_of_brute_force():
    """Groups of small alphabets: many runs that part and meet again, texts that begin or end near the anchor."""
    rng = random.Random(3)
    for trial in range(400):
        length = rng.choice([66, 75, 90])
        reach, letters = length - suffixdup.K, "ab" if trial % 2 else "abcd"
        rows: dict = {}
        for _ in range(rng.randrange(1, 50)):
            lhs = "".join(rng.choice(letters) for _ in range(rng.choice([reach, reach, rng.randrange(reach + 1)])))
            rhs = "A" * suffixdup.K + "".join(rng.choice(letters) for _ in range(rng.randrange(reach + 1)))
            if rows and rng.random() < 0.7:
                _, x, y = rng.choice(list(rows))
                k, m = rng.randrange(len(x) + 1), rng.randrange(suffixdup.K, len(y) + 1)
                lhs, rhs = (lhs + x[k:])[-reach:], (y[:m] + rhs[m:])[:length]
            rows[rng.randrange(3), lhs, rhs] = None
        rows = sorted(rows)
        wins = [{j: (x[len(x) - j :] + y)[:length] for j in range(len(x) + 1) if len(y) >= length - j} for _, x, y in rows]
        count = Counter((r[0], j, w) for r, ws in zip(rows, wins, strict=True) for j, w in ws.items())
        least, most = suffixdup.mark(np.array([r[0] for r in rows]), [r[1].encode() for r in rows], [r[2].encode() for r in rows], length)
        for k, (r, ws) in enumerate(zip(rows, wins, strict=True)):
            js = [j for j, w in ws.items() if count[r[0], j, w] > 1]
            assert (least[k], most[k]) == ((min(js), max(js)) if js else (-1, -1))


def test_shared_passages(spark):
    rng = random.Random(11)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = words(60)
    docs = [words(30) + shared + words(20), words(5) + shared[:50], words(100) + shared[9:59], words(50) + shared[:39] + words(50), words(4) + shared[20:59] + words(9), words(300)]
    docs += [["again", "and"] * 80, words(10) + [*(loop := words(55)), *loop], words(49), words(3)]
    rows = [(i, ("  " if i % 2 else "\n").join(d)) for i, d in enumerate(docs)] + [(20, None), (21, ""), (None, " ".join(docs[5][100:150]))]
    got = {r["doc_id"]: r["shares_passage"] for r in suffixdup.cut(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i for i, x in got.items() if x} == {0, 1, 2, 5, None} and set(got) == {r[0] for r in rows}


def test_every_window_has_an_anchor():
    rng = np.random.default_rng(1)
    for data in (rng.integers(97, 105, 3000), np.zeros(1500), np.tile(np.arange(7), 300)):
        data = data.astype(np.uint8)
        at, _ = suffixdup.anchors(data, 400)
        starts = np.arange(len(data) - 400 + 1)
        inside = np.searchsorted(at, starts + 400 - suffixdup.K, "right") - np.searchsorted(at, starts)
        assert (inside > 0).all()


def test_very_many_spans_in_one_text_take_linear_time(spark):
    import time

    r = random.Random(6)
    part = "".join(r.choice("abcdefgh") for _ in range(450))
    # 3,000 removed spans with bytes between them that are not repeated
    text = "".join(part + f"{i:07d}{r.random():.17f}" for i in range(3000))
    began = time.time()
    row = suffixdup.cut(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_spans == 3000 and time.time() - began < 60
    kept, at = hashlib.sha256(), 0
    for s in row.spans:
        kept.update(text[at : s["lo"]].encode())
        at = s["hi"]
    kept.update(text[at:].encode())
    assert row.kept_sha256 == kept.hexdigest()
