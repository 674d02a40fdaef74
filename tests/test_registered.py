"""Every registered query against its SQL twin, and what its plan looks like."""

import contextlib
import io
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_point  # noqa: E402
from sieverank import plans  # noqa: E402
from check import TABLES, differing_types, rows_of  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {name: run for name, run in entry_point.queries().items() if name in plans.queries()}
ORACLES = plans.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the generated tables")


def explained(df, mode="simple"):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain(mode=mode)
    return text.getvalue()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(QUERIES) and len(QUERIES) > 40


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = explained(df)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "BatchEvalPython" not in plan and "PythonRDD" not in plan
    result = duck.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert not differing_types(df, duck.cursor(), ORACLES[name])
    assert rows_of(df.columns, df.collect()) == rows_of(columns, result.fetchall())


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize(
    "name, wanted",
    [
        ("conditions_filter", ["PushedFilters: [", "Or(EqualTo(lang,en),EqualTo(lang,fr))", "GreaterThanOrEqual(n_chars,1000)"]),
        ("hybrid_single", ["TakeOrderedAndProject"]),
        ("blank_query", ["TakeOrderedAndProject"]),
        ("prefiltered_topk", ["LeftSemi", "WindowGroupLimit", "MapInArrow"]),
        ("hybrid_batch", ["WindowGroupLimit", "MapInArrow"]),
        ("dense_topk", ["WindowGroupLimit"]),
    ],
)
def test_plans_hold_what_they_should(spark, name, wanted):
    plan = explained(QUERIES[name](spark, SF_DIR), "formatted")
    for text in wanted:
        assert text in plan, plan


@pytest.mark.parametrize(
    "name", ["route_conditions", "conditions_as_data", "quality_rejects", "hybrid_single", "semantic_text", "narrative", "rules_long"]
)
def test_no_python_in_row_work(spark, name):
    plan = explained(QUERIES[name](spark, SF_DIR))
    assert "Python" not in plan and "Arrow" not in plan and "MapInPandas" not in plan


def test_routing_and_narratives_do_not_shuffle(spark):
    for name in ("narrative", "flatten_record", "payload_roundtrip", "window_overlap", "catalog_listing"):
        assert "Exchange" not in explained(QUERIES[name](spark, SF_DIR))
