"""Every registered query of the engine against its SQL in DuckDB."""

import duckdb
import pytest

from quillstone.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    plain = df.map(lambda v: round(v, 5) if isinstance(v, float) else v).astype(str).replace({"nan": "None", "<NA>": "None", "NaT": "None"})
    return sorted(map(tuple, plain.values.tolist()))


def test_every_query_has_sql():
    """But for those that draw weights from hashes, which test_resample_and_substrings.py compares with NumPy's."""
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"resampled_return_rate", "shuffled_priorities"}
    assert set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sf, db, name):
    ours, theirs = registry.QUERIES[name](spark, sf).toPandas(), db.execute(registry.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
