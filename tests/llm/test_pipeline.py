"""The pipeline's stages against plain statements of what each has to do, on the small tables."""

import re
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from quillstone.llm import jaccard, mixing, toxicity  # noqa: E402
from quillstone.llm.common import stored, table  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = table(spark, sf, "documents"), [("start", table(spark, sf, "documents"))]
    for name, f in corpus_pipeline.STAGES:
        docs = stored(f(spark, docs, sf), f"t-{name}")
        out.append((name, docs))
    return out


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def test_stages_and_columns(stages):
    assert [n for n, _ in stages] == ["start", "toxicity", "near_duplicates", "decontamination", "mixing", "token_records"]
    assert all(df.columns == COLUMNS for _, df in stages[:-1])


def test_toxic_documents_go(spark, sf, stages):
    before, after = stages[0][1], stages[1][1]
    net = toxicity.fit(before, table(spark, sf, "labels"))
    assert ids(before) - ids(after) == ids(before.where(toxicity.is_toxic(before, net))) and ids(after)


def test_one_of_each_group_stays(stages):
    before, after = stages[1][1], stages[2][1]
    groups = jaccard.groups(before).collect()
    assert ids(after) == {r["class_id"] for r in groups}
    assert all(r["n_links"] == 0 for r in jaccard.groups(after).collect())


def test_leaking_documents_go(spark, sf, stages):
    before, after = stages[2][1], stages[3][1]
    items = [r["text"] for r in table(spark, sf, "benchmark").collect()]
    verbatim = {r["doc_id"] for r in before.collect() if any(x in (r["text"] or "") for x in items)}
    gone = ids(before) - ids(after)
    assert verbatim <= gone and len(gone - verbatim) <= len(verbatim)


def test_mix_repeats_whole_documents(stages):
    before, after = stages[3][1], stages[4][1]
    size = lambda t: len(re.findall(mixing.WORD, t or ""))
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
    got: dict = {}
    for r in after.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in plan.items() if v}
    assert max(got.values()) <= 2 and all(size("a  b\n") == 2 for _ in range(1))


def test_records_hold_every_copy(stages):
    docs, records = stages[4][1], stages[5][1]
    a, b = sorted(r["doc_id"] for r in docs.collect()), [r["doc_id"] for r in records.orderBy("start").collect()]
    assert a == b
    n = records.orderBy("start").collect()
    assert all(x["start"] + x["n_tokens"] == y["start"] for x, y in zip(n[:-1], n[1:], strict=True))


CLASH = "doc_id long, text string, lang string, source string, n_chars int, toxic_flag string, cls string, size double, rank int, item_id long"


def written(spark, path, docs, labels, items):
    spark.createDataFrame(docs, CLASH).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def through(spark, path):
    docs = table(spark, path, "documents")
    out = [docs]
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        docs = f(spark, docs, path)
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == out[0].columns
        out.append(docs := stored(docs, f"e-{name}"))
    return out


def test_every_stage_with_odd_rows(spark, tmp_path):
    """Null ids, texts, languages and sources, empty and very long texts, repeated rows, clashing columns."""
    import random

    rng = random.Random(6)
    prose = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    item, twin, big = prose(30), prose(80), (1 << 53) + 1
    rows = [(i, f"{prose(30)} idiot scum {prose(20)}" if i % 4 == 0 else prose(60), ("en", "de", None)[i % 3], ("a", "b", None)[i % 3]) for i in range(400)]
    labels = [(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (5, None)]
    rows += [(1000, None, None, None), (1001, "", "en", "a"), (None, None, None, None), (1002, prose(30_000), "en", "a"), (1003, twin, "en", "a"), (None, twin, "en", "b"), (big, twin + " end", None, None), (1004, prose(40), "en", "b"), (1004, rows[1][1] + " more", "en", "b")]
    rows += [(1005, f"{prose(20)} {item} {prose(20)}", "en", "a"), (None, f"{item} {prose(70)}", "en", "a"), (None, f"{prose(50)} idiot scum idiot", "en", "a"), (1006, same := prose(50), "en", "a"), (1006, same, "en", "a")]
    docs = [(*r, 1, "yes", "c", 0.5, 3, 9) for r in rows]
    start, clean, single, kept, mixed_, ids = through(spark, written(spark, tmp_path, docs, labels, [(1, item), (None, None), (3, "")]))
    texts = lambda df: [r["text"] for r in df.collect()]
    assert not [t for t in texts(clean) if t and "idiot" in t] and clean.count() >= len(rows) - 101 - 8
    assert sum((t or "").startswith(twin) for t in texts(single)) == 1 and (1003, twin) in {(r["doc_id"], r["text"]) for r in single.collect()}
    assert not [t for t in texts(kept) if t and item in t] and kept.count() == single.count() - sum(item in (t or "") for t in texts(single))
    assert sorted(str(r["doc_id"]) for r in ids.collect()) == sorted(str(r["doc_id"]) for r in mixed_.collect()) and mixed_.count()


def test_every_stage_without_rows(spark, tmp_path):
    for k, (docs, labels, items) in enumerate((([], [], []), ([(1, "a b c d e f", "en", "a", 1, None, None, None, None, None)], [], []), ([(None,) * 10], [(None, None)], [(None, None)]))):
        out = through(spark, written(spark, tmp_path / str(k), docs, labels, items))
        assert all(df.count() <= max(1, 2 * len(docs)) for df in out) and out[3].count() == len(docs)
