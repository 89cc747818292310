"""The derived tables in Spark and in SQL are the same rows."""

import pytest

from conftest import SMALL
from helpers import duck_bag, frame_bag
from oracle.derived import CTES, with_tables
from supplyplan.sources.derived import DerivedTables
from supplyplan.sources.schemas import SCHEMAS

# batches whose columns are named for the library on one side and for SQL on the other
_RENAMED = {
    "fx_revision_batch": {"non_gsa_adjustment": "non_gsa", "gsa_adjustment": "gsa", "adjustment": "fc",
                          "adjustment_type": "kind", "adjustment_comment": "note"},
    "fx_adhoc": {"non_gsa_adjustment": "non_gsa_adj", "gsa_adjustment": "gsa_adj", "adjustment": "forecast_adj",
                 "adjustment_type": "kind", "adjustment_comment": "note"},
}


@pytest.mark.parametrize("name", [n for n in CTES if n != "fx_lines"])
def test_derived_table(name, spark, duck):
    df = getattr(DerivedTables(spark, SMALL), name.removeprefix("fx_"))
    df = df.withColumnsRenamed(_RENAMED.get(name, {}))
    expected, columns = duck_bag(duck, with_tables(f"SELECT * FROM {name}"))
    assert set(columns) <= set(df.columns)
    assert frame_bag(df.select(*columns)) == expected


def test_whole_source_tables_are_used(spark):
    d = DerivedTables(spark, SMALL)
    count = lambda t: spark.read.parquet(f"{SMALL}/{t}.parquet").count()
    assert d.forecast.count() == count("lineitem")
    assert d.commits.count() == d.adjustments.count() == 3 * count("lineitem")
    assert d.tasks.count() == d.task_actions.count() == count("events")
    assert d.requests.count() == d.new_requests.count() == d.revision_batch.count() == count("orders")
    assert d.adhoc.count() == 2 * count("part")


@pytest.mark.parametrize("name", ["forecast", "commits", "adjustments", "item_master", "requests", "tasks"])
def test_columns_are_declared(name, spark):
    declared = {f.name for f in SCHEMAS[name].fields}
    assert set(getattr(DerivedTables(spark, SMALL), name).columns) <= declared
