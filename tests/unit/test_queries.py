"""Every registered query against its SQL, and row counts of those without."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
CORE = entry.registry.QUERIES


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.registry.ORACLES))
def test_equals_sql(spark, sf, duck, name):
    df = CORE[name](spark, sf)
    cur = duck.execute(entry.registry.ORACLES[name])
    kinds = {d[0]: str(d[1]) for d in cur.description}
    assert {c: KINDS[t] for c, t in df.dtypes} == kinds
    order = sorted(kinds)
    place = [list(kinds).index(c) for c in order]
    want = sorted((tuple(r[i] for i in place) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(CORE) - set(entry.registry.ORACLES)))
def test_runs(spark, sf, name):
    assert CORE[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["concept", "token", "rank", "p"]
    assert df.count() > 0


def test_contract():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(callable(f) for f in entry.queries().values())
