"""Queries over events with a value of 0 against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["p38_math", "a28_masked_cross_entropy"])
def test_value_zero(spark, tmp_path, name):
    duck = duckdb.connect()
    duck.execute("create table events as select * replace (case when event_id % 7 = 0 then 0 else value end as value) from '/root/testdata/sf0.001/events.parquet'")
    duck.execute(f"copy events to '{tmp_path}/events.parquet' (format parquet)")
    cur = duck.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    got = sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).select(*cols).collect()))
    want = sorted(cur.fetchall())
    assert got == want
