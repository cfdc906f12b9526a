"""Every registered query of the library against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from tallyfold.plans import registry

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 5) + 0.0
    return str(v)[:19] if hasattr(v, "isoformat") else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(([_plain(r[i]) for i in order] for r in data), key=str)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = duck.execute(registry.oracles()[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0
