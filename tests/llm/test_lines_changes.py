"""Line dedup and change points against plain versions and SQL."""

import datetime
import hashlib
import math
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import changepoints, lines, queries
from threadloom.llm.common import lower_ascii


@pytest.mark.parametrize("name,table", [("op12_line_dedup", "documents"), ("op13_change_points", "sale_lines")])
def test_sql(spark, sf, name, table):
    df = queries.queries()[name](spark, sf)
    c = duckdb.connect()
    c.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    rel = c.execute(queries.oracle_sql()[name])
    assert [d[0] for d in rel.description] == df.columns
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(rel.fetchall(), key=repr)


# line dedup

BLANK = "\t\n\x0b\x0c\r "


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def plain(rows, least, min_chars=1):
    seen = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            seen[key(line)].add(i)
    drop = {k for k, ids in seen.items() if len(ids) >= least and len(k) >= min_chars}
    out = []
    for i, t in rows:
        parts = (t or "").split("\n")
        kept = [x for x in parts if key(x) not in drop]
        out.append((i, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    pool = ["Common LINE", " common line\r", "Été", "été", "", "  ", "\x0b", "rare", "x" * 5000, "a.b", " pad "]
    rows = [(rng.choice([i, i, None, i % 7]), "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, "long\n" * 5000), (3, rows[3][1]), (3, rows[3][1])]


@pytest.mark.parametrize("limit,least,batches,fanout,min_chars", [(lines.TABLE_LIMIT, 10, 4, 2, 1), (0, 2, 5, 3, 1), (0, 3, 1, 2, 4), (lines.TABLE_LIMIT, 20, 2, 2, 0)])
def test_lines(spark, limit, least, batches, fanout, min_chars):
    rows = corpus(least)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3).withColumns({"kept": F.lit(1), "h1": F.lit("x"), "n": F.lit(2), "_text": F.lit(0), "odd.name": F.lit(1)})
    frequent = lines.frequent_lines(docs, least, batches, fanout, min_chars)
    out = lines.drop_lines(docs, frequent, min_chars=min_chars, table_limit=limit)
    assert sorted(map(tuple, out.collect()), key=repr) == plain(rows, least, min_chars)


def test_lines_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert lines.line_dedup(docs).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id bigint, text string")
    assert lines.line_dedup(one).collect()[0] == (1, 1, 0, "")


def test_runs(spark):
    """Levels fill and empty like a counter; settled hashes aren't written again; nothing stays."""
    runs = lines.LineRuns(spark, least=3, fanout=2, buckets=2)
    shape, total = [], defaultdict(int)
    for b in range(6):
        rows = [(h, -h, (h + b) % 3 + 1) for h in range(b, b + 8)]
        runs.add(spark.createDataFrame(rows, "h1 bigint, h2 bigint, n bigint"))
        for h, _, n in rows:
            total[h] += n
        shape.append([len(x) for x in runs.levels])
    assert shape == [[1], [0, 1], [1, 1], [0, 0, 1], [1, 0, 1], [0, 1, 1]]
    assert {r.h1 for r in runs.frequent().collect()} == {h for h, n in total.items() if n >= 3}
    known = spark.createDataFrame([(5, -5, 3), (777, -777, 1)], "h1 bigint, h2 bigint, n bigint")
    runs.add(known)
    new = [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
    assert new and {r.h1 for r in spark.table(runs.levels[0][-1]).collect()} == {777}
    plan = spark.table(runs.levels[0][-1]).join(spark.table(runs.levels[1][-1]).hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("line_run_")]
    assert runs.frequent().count() == 0


def test_line_plan(spark, sf):
    """No Python, and texts aren't shuffled while the table is small."""
    p = queries.op12_line_dedup(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|Arrow|Pandas|CartesianProduct", p)
    assert not re.search(r"Exchange[^\n]*_text", p)


# change points


def cheapest(x, least, penalty):
    """All segmentations, by the contract's order."""
    n, best = len(x), None

    def cost(s, e):
        m, t, q = e - s, sum(x[s:e]), sum(v * v for v in x[s:e])
        return m * math.floor(1000 * math.log(1 + (m * q - t * t) // (m * m)))

    def back(e, cuts):
        nonlocal best
        for s in [0, *range(least, e - least + 1)]:
            starts = [s, *cuts]
            if s:
                back(s, starts)
            elif e >= least or n < least:
                k = (sum(cost(a, b) for a, b in zip(starts, [*starts[1:], n])) + penalty * (len(starts) - 1), len(starts), starts[::-1])
                best = k if best is None or k < best else best

    back(n, [])
    return best[2][::-1], best[0]


def test_segments():
    rng = np.random.default_rng(3)
    for t in range(300):
        n = int(rng.integers(1, 25))
        x = [rng.integers(0, 50, n), rng.integers(0, 2, n), np.repeat(rng.integers(-90, 90, n // 5 + 1), 5)[:n], np.zeros(n, int), rng.integers(0, 3, n) * 10**11][t % 5].astype(np.int64)
        least, penalty = (5, 5, 3)[t % 3], (10_000, 300, 0, 2500)[t % 4]
        assert changepoints.best_segments(x, least, penalty) == cheapest(x.tolist(), least, penalty)


def test_long_series():
    """Beyond the cost matrix, columns give the same."""
    x = np.random.default_rng(5).integers(0, 40, 300) + np.repeat([0, 400, 90], 100)
    want = changepoints.best_segments(x)
    old, changepoints._MATRIX = changepoints._MATRIX, 10
    try:
        assert changepoints.best_segments(x) == want
    finally:
        changepoints._MATRIX = old
    assert len(want[0]) >= 3


def test_bounds():
    """No prefix costs less than its bound."""
    rng = np.random.default_rng(7)
    for t in range(60):
        x = [rng.integers(0, 50, 20), rng.integers(0, 3, 20), np.repeat(rng.integers(0, 90, 4), 5)][t % 3].astype(np.int64)
        low = changepoints._bounds(*changepoints._sums(x), 5, 10_000)
        for e in range(5, 21):
            assert low[e] <= cheapest(x[:e].tolist(), 5, 10_000)[1]


def test_change_points_edges(spark):
    day = datetime.datetime(2024, 1, 1)
    at = lambda d, h=3: day + datetime.timedelta(days=d, hours=h)
    rows = [(1, 5, at(0)), (1, 5, at(0)), (1, 7, at(3)), (1, None, at(90)), (1, 9, None), (2, 4, at(2)), (None, 1, at(1)), (None, 2, at(8)), (3, None, at(1)), (4, 100, datetime.datetime(1971, 1, 1)), (4, 100, at(5))]
    df = spark.createDataFrame(rows, "vendor_id bigint, quantity int, shipped_at timestamp_ntz").withColumns({"series": F.lit(1), "day": F.lit("x"), "value": F.lit("y"), "odd.name": F.lit(0)})
    out = changepoints.change_points(df)
    got = defaultdict(list)
    for r in out.orderBy("vendor_id", "segment_no").collect():
        got[r.vendor_id].append(r)
    first = (day.date() - datetime.date(1970, 1, 1)).days
    assert set(got) == {1, 2, None, 4}
    assert [(r.first_day, r.n_days, r.total, r.n_segments) for r in got[1]] == [(first, 4, 17, 1)]
    assert [(r.first_day, r.n_days, r.total, r.spread, r.cost) for r in got[2]] == [(first + 2, 1, 4, 1, 0)]
    assert sum(r.n_days for r in got[None]) == 8 and sum(r.total for r in got[None]) == 3
    assert sum(r.n_days for r in got[4]) == first + 5 - 365 + 1 and got[4][0].best_cost == sum(r.cost for r in got[4]) + 10_000 * (len(got[4]) - 1)
    assert changepoints.change_points(df.where("false")).count() == 0
