"""The registered queries against their SQL, on the smallest tables."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.path.join(ROOT, "tools"))

import __spark_entry__ as contract  # noqa: E402
from check import connect, difference  # noqa: E402

SF = contract.ENTRY_DIR
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")

CHECKED = [
    "bars_daily",
    "normalize_bars",
    "dedupe_bars",
    "validate_bars",
    "ticker_overview",
    "features_all",
    "latest_features",
    "scale_features",
    "compare_signals",
    "returns_histogram",
    "walk_forward_status",
    "class_metrics",
    "quality_gate",
    "history_display",
    "comparison_display",
    "ingest_status",
]


def test_flagship(spark):
    df = contract.entry(spark)
    assert df.count() == 5 and "sharpe_ratio" in df.columns


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    got = contract.queries()[name](spark, SF).toPandas()
    expected = con.execute(contract.oracle_sql()[name]).df()
    assert len(got) > 0
    assert difference(got, expected) == ""


def scans(df, table):
    """How often the optimized plan reads a given table."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return sum(table in str(leaf.toString()) for leaf in _leaves(plan))


def _leaves(plan):
    found = plan.collectLeaves()
    return [found.apply(i) for i in range(found.size())]


@pytest.mark.parametrize("name", ["bars_daily", "ingest_status"])
def test_ticks_are_read_once(spark, name):
    assert scans(contract.queries()[name](spark, SF), "l_quantity") == 1


@pytest.mark.parametrize("name", ["features_all", "latest_features", "scale_features", "ticker_overview"])
def test_features_read_written_bars_not_ticks(spark, name):
    assert scans(contract.queries()[name](spark, SF), "l_quantity") == 0


def test_bars_are_hashed(spark):
    for name in ("bars_daily", "bars_hourly", "bars_index"):
        df = contract.queries()[name](spark, SF)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan


@pytest.mark.parametrize("name", ["scale_features", "returns_histogram", "signals_join"])
def test_statistics_share_the_exchange_of_the_rows(spark, name):
    """Behind the exchange stand the readings of the bars: of numbering, of rows, and of prices that signals are bound to."""
    df = contract.queries()[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan
    assert plan.count("FileScan") == (3 if name == "signals_join" else 2)
