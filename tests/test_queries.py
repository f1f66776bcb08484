"""Every query of the registry against its SQL in DuckDB, on the smallest tables."""

import collections
import math
from decimal import Decimal

import pytest

from marlwork.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float | Decimal):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = collections.Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in registry.oracle_sql():
        assert got
        return
    found = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = collections.Counter(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in found.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
