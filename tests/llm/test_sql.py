"""The registered queries against their SQL in DuckDB, and the entry point's guard."""

import duckdb
import pytest

import __spark_entry__ as entry
from quillstone.llm import queries as q

TABLES = "documents embeddings pages benchmark labels conversations".split()


def rows(df):
    df = df[sorted(df.columns)]
    plain = df.map(lambda v: round(v, 5) if isinstance(v, float) else v).astype(str).replace({"nan": "None", "<NA>": "None", "NaT": "None"})
    return sorted(map(tuple, plain.values.tolist()))


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_query_equals_sql(spark, sf, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    ours, theirs = q.QUERIES[name](spark, sf).toPandas(), db.execute(q.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and rows(ours) == rows(theirs)


def test_one_query_for_each_operator():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_only_a_missing_subpackage_is_passed_over(monkeypatch):
    import builtins

    real = builtins.__import__

    def broken(name, *a, **k):
        if name == "corpus_pipeline":
            raise ModuleNotFoundError("No module named 'other'", name="other")
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", broken)
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
