"""Every registered query of the engine against its SQL."""

import math

import duckdb
import pytest

from recordframe.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None), key=lambda r: tuple(map(str, r)))


def same(a, b):
    if isinstance(a, float) and b is not None:
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    got, want = rows(df.toPandas()), rows(duck.sql(registry.ORACLES[name]).df())
    assert len(got) == len(want)
    assert all(same(x, y) for g, w in zip(got, want) for x, y in zip(g, w))
