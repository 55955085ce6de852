"""Best products against loops over all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import anchors, dense, lexical, products, substrings


def best_by_loop(rows, queries, score, k, least=None, own=True):
    out = []
    for q, x in queries:
        scored = sorted((-round(s, 9), i) for i, y in rows if (own or i != q) and (s := score(x, y)) is not None and (least is None or s > least))
        out += [(q, i, n + 1) for n, (_, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,cells", [(1024, 2_000_000), (3, 40)])
def test_vectors_keys_and_both(spark, monkeypatch, block, cells):
    monkeypatch.setattr(products, "CELLS", cells)
    r = random.Random(4)
    vector = lambda: [r.choice((-0.5, 0.0, 0.25, 1.0)) for _ in range(r.choice((3, 3, 3, 2)))]  # noqa: E731  many ties
    made = [(i, vector(), sorted(r.sample("abcdefg", r.randrange(4)))) for i in range(300)] + [(300, None, ["a"]), (301, [float("nan")] * 3, []), (302, [1.0, None, 0.0], ["a"])]
    rows = spark.createDataFrame([(i, v, k, [2.0] * len(k)) for i, v, k in made], "id long, vector array<double>, keys array<string>, vals array<double>").repartition(3)
    asks = rows.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    usable = lambda v: bool(v) and all(x is not None and x == x for x in v)
    dot = lambda v, w: sum(a * b for a, b in zip(v, w, strict=True)) if usable(v) and usable(w) and len(v) == len(w) else None
    shared = lambda k, m: 4.0 * len(set(k) & set(m))
    got = lambda cols, **kw: sorted((x.query_id, x.id, x["rank"]) for x in products.best(rows.select("id", *cols), asks.select("query_id", *cols), block=block, **kw).collect())
    queries, every = [(i, (v, k)) for i, v, k in made if i % 20 == 0], [(i, (v, k)) for i, v, k in made]
    assert got(("vector",), top_k=5) == best_by_loop(every, queries, lambda x, y: dot(x[0], y[0]), 5)
    assert got(("keys", "vals"), top_k=4, least=0.0) == best_by_loop(every, queries, lambda x, y: shared(x[1], y[1]), 4, least=0.0)
    both = lambda x, y: None if (d := dot(x[0], y[0])) is None else d + shared(x[1], y[1])
    assert got(("vector", "keys", "vals"), top_k=3, own=False) == best_by_loop(every, queries, both, 3, own=False)
    assert products.best(rows, asks.limit(0), top_k=3).count() == 0 == products.best(rows.limit(0), asks, top_k=3).count()


def test_vectors_are_not_joined_with_all_queries(spark):
    """each pair was a joined row."""
    v = spark.createDataFrame([(i, [i % 7 + 0.5, 1.0]) for i in range(50)], "id long, v array<double>")
    out = dense.search(v, v.where("id < 5").select(F.col("id").alias("query_id"), F.col("v").alias("vector")), id_col="id", vector_col="v", top_k=3, least=None, own=False)
    assert out.count() == 15 and "NestedLoop" not in out._jdf.queryExecution().toString()


def test_hashed_vectors_equal_buckets_and_are_not_shuffled(spark):
    """every bucket of a text was a row, and every product of two buckets."""
    d = spark.createDataFrame([(i, f"alpha w{i % 3} w{i % 3} beta{i}") for i in range(30)] + [(40, ""), (41, None)], "id long, text string")
    buckets = {(r.id, r.bucket): round(r.weight, 12) for r in dense.hash_buckets(d, "id", F.col("text")).collect()}
    vectors = dense.hash_vectors(d, "id", F.col("text"))
    assert {(r.id, k): round(v, 12) for r in vectors.collect() for k, v in zip(r["keys"], r.vals, strict=True)} == buckets
    twice = dense.hash_vectors(d.union(d.where("id = 1")), "id", F.col("text")).where("id = 1").collect()
    assert len(twice) == 1 and "Exchange" not in vectors._jdf.queryExecution().executedPlan().toString()


def test_few_terms_and_many_terms_score_alike(spark, monkeypatch):
    """postings of many queries were shuffled three times."""
    d = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 17}" for k in range(1 + i % 9))) for i in range(120)] + [(500, ""), (501, None)], "doc_id long, text string")
    q = spark.createDataFrame([(k, f"w{k} w{k + 1} w{k} w3 none") for k in range(15)], "query_id long, text string")
    many = sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in lexical.search(d, q, top_k=4).collect())
    monkeypatch.setattr(lexical, "FEW", 10**6)
    few = sorted((r.query_id, r["rank"], r.id, round(r.score, 9)) for r in lexical.search(d, q, top_k=4).collect())
    assert many == few and len(many) == 60


def test_first_covering_is_the_head_of_covering(spark):
    """all pairs of a gold text and a chunk that share a term were listed."""
    golds = [(i, " ".join(f"w{(i * k) % 11}x" for k in range(2 + i % 5))) for i in range(12)] + [(50, "seen 2024-05 with progression a1 b2 c3 d4"), (51, None)]
    chunks = [(f"k{i:03d}", " ".join(f"W{(i * k) % 13}x" for k in range(i % 12))) for i in range(150)] + [("d", "2024-05 Progression"), ("n", None)]
    g, c = spark.createDataFrame(golds, "gold_id long, text string"), spark.createDataFrame(chunks, "id string, text string")
    row = lambda r: (r.gold_id, -r.lexical, r.id, r.date_hit, r.outcome_hit)
    every, got = sorted(map(row, anchors.covering(g, c).collect())), sorted(map(row, anchors.first_covering(g, c, 5).collect()))
    assert got == [r for i, r in enumerate(every) if sum(x[0] == r[0] for x in every[:i]) < 5] and len(got) > 40


def test_needles_in_words_and_across_words():
    """F6, F8: texts were shuffled by their n-grams."""
    needles, texts = ["ab", "b c", "abc", "é", "zz", " "], ["xabc d", "ab cd", "é", "", "ab c zz"]
    find = substrings.finder(needles, 2)
    assert [find(t) for t in texts] == [[k for k, n in enumerate(needles) if n in t] for t in texts]
