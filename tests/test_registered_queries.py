"""Every registered query against its SQL twin on the smallest data folder, and plan assertions."""

import pytest
from check import compare, duck

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
NAMES = sorted(entry.queries())


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    msg, _, _ = compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert msg.startswith(("ok", "rows=")), msg


@pytest.mark.parametrize("name", ["mark_table_blocks", "dedupe_ocr_words", "build_chunks", "page_proximity_bonus", "claims_conflict", "reading_order"])
def test_no_nested_loops(spark, name):
    plan = entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_layout_pass_shuffles_once(spark):
    plan = entry.queries()["mark_captions"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
