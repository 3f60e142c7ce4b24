"""Plans: native operators stay in the JVM, scans read only what is used."""

import re

import pytest

from threadloom.llm import queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["op2_chat", "op4_fingerprint", "op5_mixing", "op6_urls", "op9_exact_dedup", "op10_sharding"])
def test_native(spark, sf, name):
    p = plan(queries.queries()[name](spark, sf))
    assert not re.search(r"Python|Arrow|Pandas|CartesianProduct", p)


@pytest.mark.parametrize("name", ["op3_bpe", "op7_toxicity", "op8_secrets"])
def test_one_pass(spark, sf, name):
    """What is done to every document needs no exchange."""
    p = plan(queries.queries()[name](spark, sf))
    assert "Exchange" not in p
    assert "MapInArrow" in p


@pytest.mark.parametrize("name", ["op3_bpe", "op8_secrets", "op9_exact_dedup", "op10_sharding"])
def test_pruned(spark, sf, name):
    p = plan(queries.queries()[name](spark, sf))
    read = set(re.findall(r"ReadSchema: struct<([^>]*)>", p))
    assert read <= {"doc_id:bigint,text:string", "doc_id:bigint"}
