"""Shapes of the physical plans: what is pushed down, what is shuffled, what is broadcast."""

import re
from datetime import datetime

import pytest

from conftest import SMALL
from helpers import same
from supplyplan import EVERY, Tables, VarianceFilter
from supplyplan.operators import comparison, panels, variance
from supplyplan.sources.derived import AS_OF, PLAN_TABLES, DerivedTables
from supplyplan.sources.schemas import SCHEMAS, conform
from supplyplan.sources.storage import (
    append_rows, read_tables, save_plan_table, stamp_snapshot, write_version,
)

WHOLE = VarianceFilter(planners=[None], vendors=EVERY)
KEY_SHUFFLE = r"Exchange hashpartitioning\((?:product|component_part)#\d+, week_id#\d+, demand_date#\d+, \d+\)"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("plan"))
    derived = DerivedTables(spark, SMALL)
    for name in PLAN_TABLES:
        write_version(conform(getattr(derived, name), name), root, name)
    return root


@pytest.fixture
def shuffled_joins(spark):
    """Plans as for large tables: nothing is broadcast on an estimate."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def scans_of(df, table):
    """Details of the scans of one stored table."""
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return [block for block in text.split("\n\n") if "Scan parquet" in block and f"/{table}]" in block]


def test_week_and_columns_reach_the_scans(spark, stored):
    t = read_tables(spark, stored, *PLAN_TABLES)
    df = variance.variance_by_view(t, "PLNR", "WEEK", WHOLE, AS_OF)
    for name in ("forecast", "commits", "adjustments"):
        (scan,) = scans_of(df, name)
        # stored by snapshot week: other weeks' folders are not opened
        assert re.search(r"PartitionFilters: \[[^\]]*week_id#\d+ = 4\)", scan)
    schema = lambda name: scans_of(df, name)[0].split("ReadSchema:")[1]
    assert not re.search("remarks|open_po_gsa|build_type", schema("forecast"))
    assert not re.search("commit_comments|created_by", schema("commits"))


def test_demand_week_reaches_the_scans(spark, stored):
    t = read_tables(spark, stored, *PLAN_TABLES)
    for report in comparison.week_comparison(t, WHOLE, AS_OF):
        for name in ("forecast", "commits", "adjustments"):
            (scan,) = scans_of(report, name)
            assert "GreaterThanOrEqual(demand_date,1998-01-22)" in scan and "LessThan(demand_date,1998-01-29)" in scan


def test_one_shuffle_per_plan_table(spark, stored, shuffled_joins):
    t = read_tables(spark, stored, *PLAN_TABLES)
    plan = plan_of(variance.variance_by_view(t, "PLNR", "WEEK", WHOLE, AS_OF))
    assert len(re.findall(KEY_SHUFFLE, plan)) == 3
    assert plan.count("SortMergeJoin") - plan.count("SortMergeJoin [part_name") == 2
    rows = plan_of(variance.variance_rows(t, "PLNR", WHOLE))
    assert "BroadcastHashJoin [product" in rows


def test_bucketed_tables_need_no_key_shuffle(spark, stored, shuffled_joins, tmp_path):
    t = read_tables(spark, stored, *PLAN_TABLES)
    frames = dict(vars(t))
    for name in ("forecast", "commits", "adjustments"):
        save_plan_table(frames[name], name, f"bucketed_{name}", 4, str(tmp_path / name))
        frames[name] = spark.table(f"bucketed_{name}")
    report = lambda tables: variance.variance_by_view(tables, "PLNR", "WEEK", WHOLE, AS_OF)
    bucketed = report(Tables(**frames))
    assert len(re.findall(KEY_SHUFFLE, plan_of(bucketed))) == 0
    assert same(bucketed, report(t))
    for name in ("forecast", "commits", "adjustments"):
        spark.sql(f"DROP TABLE bucketed_{name}")


def test_declared_decimals_give_the_same_numbers(spark, stored):
    t = read_tables(spark, stored, *PLAN_TABLES)
    assert t.forecast.schema == SCHEMAS["forecast"]
    derived = DerivedTables(spark, SMALL).tables()
    assert same(variance.variance_rows(t, "CM", WHOLE), variance.variance_rows(derived, "CM", WHOLE))
    assert same(panels.exceptions_by_counterparty(t, "CM", 5), panels.exceptions_by_counterparty(derived, "CM", 5))


def test_rows_and_sums_agree(spark, stored):
    t = read_tables(spark, stored, *PLAN_TABLES)
    week4 = variance.variance_rows(t, "REQ", WHOLE).where("week = 4").groupBy("product").agg({"variance": "sum"})
    views = [variance.variance_by_view(t, "REQ", v, WHOLE, AS_OF).groupBy("product").agg({"variance": "sum"})
             for v in ("WEEK", "MONTH", "YEAR")]
    assert all(same(week4, v) for v in views)


def test_results_are_ordered(spark, stored):
    t = read_tables(spark, stored, *PLAN_TABLES)
    for df, columns in ((variance.variance_rows(t, "PLNR", WHOLE), ("product", "monday")),
                        (variance.variance_by_view(t, "PLNR", "MONTH", WHOLE, AS_OF), ("product", "monday")),
                        (comparison.week_comparison(t, WHOLE, AS_OF)[0], ("product", "forecast_date"))):
        keys = [tuple((v is None, v) for v in r) for r in df.select(*columns).collect()]
        # a missing date is equal to a missing date
        keys = [tuple((a, b if not a else 0) for a, b in k) for k in keys]
        assert keys and all(x <= y for x, y in zip(keys, keys[1:]))


def test_storage_round_trip(spark, stored, tmp_path):
    t = read_tables(spark, stored, "suppliers", "forecast")
    assert t.commits is None
    root = str(tmp_path)
    write_version(t.suppliers, root, "suppliers")
    append_rows(t.suppliers.limit(1), root, "suppliers")
    assert read_tables(spark, root, "suppliers").suppliers.count() == t.suppliers.count() + 1
    with pytest.raises(Exception, match="(?i)exist"):
        write_version(t.suppliers, root, "suppliers")
    assert [r[0] for r in stamp_snapshot(t.forecast, 4).select("week_id").distinct().collect()] == [4]


def test_dashboard_keeps_one_set_of_sums(spark, stored):
    t = Tables(**{**vars(read_tables(spark, stored, *PLAN_TABLES)), "tasks": DerivedTables(spark, SMALL).tasks})
    board = panels.dashboard(t, "CM", 5, vendors=[0])
    assert all("InMemoryTableScan" in plan_of(df) for df in (board.exceptions, board.forecast_commit_receive))
    alone = panels.forecast_commit_receive(t, "CM", 5)
    assert same(board.forecast_commit_receive, alone)
    board.release()


def test_clock_may_be_a_date(spark, stored):
    t = read_tables(spark, stored, *PLAN_TABLES)
    at = lambda clock: variance.variance_by_view(t, "PLNR", "WEEK", WHOLE, clock)
    assert same(at(AS_OF.date()), at(datetime(1998, 1, 28, 23, 59)))
