"""Spelling variants, incremental line dedup and conversation repair against brute force."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import spelling, turns
from quillstone.llm.linededup import BLANKS, CuckooFilter, LineIndex, key_of

WORD_RUN = re.compile("[A-Za-zÀ-ÿ]+")


# ---- spelling variants


def one_edit(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain_variants(rows: list[tuple], often: int = 3) -> set[tuple]:
    words: Counter = Counter()
    for doc_id, text in rows:
        for run in WORD_RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            words[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = Counter({w: n for w, n in words.items() if len(w) >= 5 and n >= often})
    form, near = {}, {}
    for w in words:
        beside = [v for v in words if abs(len(v) - len(w)) <= 1 and one_edit(v, w)]
        near[w] = len(beside)
        best = min(beside, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, near[w], words[form[w]] if form[w] is not None else None) for w, n in words.items()}


def rows_of(df) -> set[tuple]:
    return {tuple(r) for r in df.collect()}


def garbled_rows(seed: int, letters: str, longest: int) -> list[tuple]:
    r = random.Random(seed)
    stems = ["".join(r.choice(letters) for _ in range(r.randint(4, longest))) for _ in range(60)]
    rows = []
    for i in range(150):
        out = []
        for _ in range(40):
            w = stems[min(int(r.expovariate(0.1)), 59)]
            if r.random() < 0.3:
                at = r.randrange(len(w))
                w = w[:at] + r.choice(["", r.choice(letters), r.choice(letters) + w[at]]) + w[at + 1 :]
            out.append(w.upper() if r.random() < 0.2 else w)
        rows.append((i, r.choice([" ", "-", "1"]).join(out)))
    return rows


@pytest.mark.parametrize(("seed", "letters", "longest", "most"), [(1, "abÀé", 6, 5), (2, "ab", 12, 3), (3, "abcdefghÿ×", 9, 20_000), (4, "aA", 14, 2)])
def test_variants_equal_all_pairs(spark, seed, letters, longest, most):
    rows = garbled_rows(seed, letters, longest) + [(None, "tooth tooth tooth tootk tooth"), (900, None), (901, ""), (901, "tooth"), (901, "tooth")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string")
    got = spelling.variants(docs, most=most)
    assert got.count() == got.select("word").distinct().count()
    assert rows_of(got) == plain_variants(rows)


def test_variants_of_real_text_and_of_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert rows_of(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), most=50)) == plain_variants(rows)
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_pairs_are_found_once():
    r = random.Random(5)
    for _ in range(100):
        roots, words = [], []
        for b in range(r.randint(1, 3)):
            fresh = sorted({"".join(r.choice("abü") for _ in range(r.randint(0, 7))) for _ in range(r.randint(1, 25))})
            roots, words = roots + [b] * len(fresh), words + fresh
        a, b = spelling.near_pairs(np.array(roots), words)
        got = sorted(tuple(sorted(p)) for p in zip(a.tolist(), b.tolist(), strict=True))
        assert got == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if roots[i] == roots[j] and one_edit(words[i], words[j])]


def test_long_words_and_chains(spark):
    long = "ab" * 3000
    rows = [(i, f"{long}x {long}y {long}y {long}y") for i in range(3)]
    # each word of the chain is twice as frequent as the one before
    chain = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb", "bbbbc", "bbbcc", "bbccc"]
    rows += [(50, " ".join(" ".join([w] * (3 * 2**i)) for i, w in enumerate(chain)))]
    got = spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), garble=False)
    by = {r.word: r for r in got.collect()}
    assert by[long + "x"].form == long + "y" and by[long + "y"].form is None
    assert all(by[w].root == chain[-1] for w in chain) and by[chain[0]].form == chain[1]


# ---- lines


def plain_lines(rows: list[tuple]) -> list[tuple]:
    holders: dict[bytes, set] = {}
    for doc_id, text in rows:
        for k in {key_of(x) for x in (text or "").split("\n")} - {None}:
            holders.setdefault(k, set()).add(doc_id)
    first = lambda ids: min(ids, key=lambda i: (i is None, i or 0))
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key_of(x), ())) < 2 or first(holders[key_of(x)]) == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows(seed: int, ids: range) -> list[tuple]:
    r = random.Random(seed)
    pool = [f"Line {i} of the pool{'é' * (i % 3)}" for i in range(40)] + ["short", "", "  ", "NINE CHAR", " exactly 10 "]
    change = [lambda x: x, str.upper, lambda x: f"\t{x} \r", lambda x: x + "\x0b"]
    rows = []
    for i in ids:
        lines = [r.choice(change)(r.choice(pool)) if r.random() < 0.6 else f"a line of {i} alone, {r.random()}" for _ in range(r.randint(0, 12))]
        rows.append((i, "\n".join(lines)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key long")


def test_lines_at_once(spark):
    rows = line_rows(1, range(60)) + [(None, "Line 1 of the poolé\nonly of the null row"), (None, "Line 1 of the poolé"), (100, None), (101, ""), (102, "the row twice\n."), (102, "the row twice\n.")]
    index = LineIndex(spark)
    index.insert(frame(spark, rows))
    for indexed in (False, True):
        assert sorted((tuple(r) for r in index.dedupe(frame(spark, rows), indexed).collect()), key=str) == plain_lines(rows)


def test_lines_are_reversible(spark):
    a, b, c = line_rows(2, range(40, 80)), line_rows(3, range(0, 40)), line_rows(4, range(80, 100))
    index = LineIndex(spark, shards=3)
    index.insert(frame(spark, a))
    before = sorted((tuple(r) for r in index.dedupe(frame(spark, a)).collect()), key=str)
    index.insert(frame(spark, b))  # smaller ids take lines over
    index.insert(frame(spark, c))
    everything = a + b + c
    assert sorted((tuple(r) for r in index.dedupe(frame(spark, everything)).collect()), key=str) == plain_lines(everything)
    with pytest.raises(ValueError, match="already"):
        index.insert(frame(spark, b[:1]))
    half = [r for r in b if r[0] % 2]
    index.delete(spark.createDataFrame([(r[0],) for r in half] + [(5000,)], "doc_id long"))
    left = a + [r for r in b if r[0] % 2 == 0] + c
    for indexed in (False, True):
        assert sorted((tuple(r) for r in index.dedupe(frame(spark, left), indexed).collect()), key=str) == plain_lines(left)
    # another session opens the same folder; what was deleted may come back
    again = LineIndex(spark, index.folder)
    again.insert(frame(spark, half))
    assert sorted((tuple(r) for r in again.dedupe(frame(spark, everything)).collect()), key=str) == plain_lines(everything)
    again.delete(spark.createDataFrame([(r[0],) for r in b + c], "doc_id long"))
    assert sorted((tuple(r) for r in again.dedupe(frame(spark, a)).collect()), key=str) == before == plain_lines(a)
    # and so have the filters: as many copies as documents stand for, two at most
    copies = again.refs().agg(F.sum(F.least("n_docs", F.lit(2)))).first()[0]
    assert spark.read.parquet(again.now.filters).agg(F.sum("held")).first()[0] == copies


def test_lines_of_nothing(spark):
    index, none = LineIndex(spark), frame(spark, [])
    assert index.dedupe(frame(spark, [(1, "a line that stays")])).collect()[0][1:3] == (1, 0)
    index.insert(none)
    index.delete(none)
    assert index.dedupe(none).count() == 0
    index.insert(frame(spark, [(1, "a line that stays"), (2, "A LINE THAT STAYS")]))
    assert [r.kept for r in index.dedupe(frame(spark, [(1, "a line that stays"), (2, "A LINE THAT STAYS")])).orderBy("doc_id").collect()] == ["a line that stays", ""]


def test_keys():
    assert key_of(f"{BLANKS}Ten Letters{BLANKS}") == key_of("ten letters") and key_of("ÄTEN LETTERS") == key_of("Äten letters") != key_of("äten letters")
    assert key_of(" ten letters") != key_of("ten letters") and key_of("nine char") is None and key_of("ten chars ") is None


def test_cuckoo_filter_counts_and_forgets():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 1 << 63, 18_500, dtype=np.uint64)
    f = CuckooFilter.sized(len(keys) * 3 // 2)
    f.table = f.table[: len(f.table) // 2]  # as full as it may get
    assert f.add(np.concatenate([keys, keys[:9_250]]))
    assert f.held == 27_750 and (f.count(keys[:9_250]) >= 2).all() and (f.count(keys[9_250:]) >= 1).all()
    assert (CuckooFilter.load(f.dump()).table == f.table).all()
    others = rng.integers(0, 1 << 63, 50_000, dtype=np.uint64)
    assert (f.count(others) > 0).mean() < 0.001
    f.remove(np.concatenate([keys[:9_250], keys[:5_000]]))
    assert (f.count(keys[5_000:]) >= 1).all() and f.held == 13_500
    with pytest.raises(ValueError, match="not in the filter"):
        f.remove(others[:100])
    f.remove(keys[5_000:])
    assert f.held == 0
    assert not CuckooFilter.sized(10).add(np.repeat(keys[:1], 9))  # one key fills both of its buckets


# ---- conversations

LEGAL = {"su", "ua", "au"}


def plain_repair(rows: list[tuple]) -> tuple:
    """The columns of the result for one conversation's damaged rows (turn, role, text), by a search over whole label strings."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    kinds, seen = [], set()
    for _, role, text in rows:
        body = text.rstrip(turns.BLANK)
        kinds.append("b" if not body.strip(turns.BLANK) else "d" if (role, text) in seen else "-" if body[-1] in ".!?" else "t")
        seen.add((role, text))
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, labels, i, state, out = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in (0, 3):
            break
        step = turns.STEPS
        for role in ("user", "assistant"):
            if (state, role[0]) in step:
                heapq.heappush(heap, (cost + 5, labels + "I", i, step[state, role[0]], (*out, f"{role}:")))
                if i < len(rows) and kinds[i] not in "bd":
                    heapq.heappush(heap, (cost + 1 + 5 * (kinds[i] == "t"), labels + "R", i + 1, step[state, role[0]], (*out, f"{role}:{rows[i][2]}")))
        if i < len(rows):
            heapq.heappush(heap, (cost + 2, labels + "D", i + 1, state, out))
            if kinds[i] not in "bd" and (state, rows[i][1][:1]) in step:
                heapq.heappush(heap, (cost + 5 * (kinds[i] == "t"), labels + "K", i + 1, step[state, rows[i][1][:1]], (*out, f"{rows[i][1]}:{rows[i][2]}")))
    known = {r[0] for r in rows if r[0] is not None}
    gaps = max(known) - min(known) + 1 - len(known) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(rows, rows[1:]))
    return gaps, *(kinds.count(k) for k in "bdt"), illegal, cost, labels, hashlib.sha256("\n".join(out).encode()).hexdigest()


def talk(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        turn = 0
        for _ in range(r.randint(0, 9)):
            turn += r.choice([0, 1, 1, 1, 3])
            role = r.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None])
            rows.append((conv, r.choice([turn] * 9 + [None]), role, r.choice(["Yes.", "No!", "Why? ", "cut off", "", " \n", None, "é. ", f"Turn {turn}."])))
    return rows


def test_repair_equals_a_search(spark):
    rows = talk(1, 120)
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, cost long")
    groups: dict = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    want = {(k, *plain_repair(v)) for k, v in groups.items()}
    for block, parts in ((4096, 4), (1, 3), (3, 5)):
        pieces = turns.repair(df, block=block, parts=parts)
        assert rows_of(turns.digest(pieces)) == want
    told = turns.repaired_turns(pieces).where("conv_id IS NOT NULL").orderBy("conv_id", "part", "seq", "place").collect()
    by: dict = {}
    for t in told:
        by.setdefault(t.conv_id, []).append(f"{t.role}:{t.text}")
    assert all(hashlib.sha256("\n".join(by.get(k, [])).encode()).hexdigest() == sha for k, *_, sha in want if k is not None)


def test_damage_and_repair_of_the_table(spark, sf):
    convs = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    convs = convs.unionByName(spark.createDataFrame([(10**6, None, None, None), (None, 3, "user", "Hi."), (None, None, "tool", "x"), (10**6 + 1, 1, "user", "Hi.")], convs.schema))
    groups: dict = {}
    for conv, turn, role, text in convs.collect():
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = groups.setdefault(conv, [])
        if h:
            text = "" if h == 1 else "".join(c for c in text if c not in ".!?") if h == 2 else text
            mine.extend([(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1))
    assert rows_of(turns.digest(turns.repair(turns.damage(convs)))) == {(k, *plain_repair(v)) for k, v in groups.items()}


def test_one_very_long_conversation(spark):
    r = random.Random(9)
    rows = [(1, i, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "cut", "", f"Number {i}."])) for i in range(3000)] + [(0, 0, "user", "Hi."), (2, 0, "user", "Hi.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = turns.repair(df, block=100, parts=6)
    assert pieces.where("conv_id = 1").count() >= 30
    assert rows_of(turns.digest(pieces).where("conv_id = 1")) == {(1, *plain_repair([r[1:] for r in rows if r[0] == 1]))}


def test_no_conversations(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turns.digest(turns.repair(turns.damage(none))).count() == 0
    gone = spark.createDataFrame([(1, 1, "user", "Hi.", True)], "conv_id long, turn long, role string, text string, gone boolean")
    assert rows_of(turns.digest(turns.repair(gone))) == {(1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
