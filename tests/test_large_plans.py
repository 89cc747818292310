"""Plans above the size at which they are laid out by ranges of products, and short forecasts in them."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from conftest import SMALL
from helpers import duck_bag, frame_bag
from test_rules import AS_OF, ONE, adjust, commit, fc, plan
from supplyplan.operators import variance
from supplyplan.plans.placement import piece_of
from supplyplan.plans.scope import resolve
from supplyplan.plans.spine import _heavy_products, load_plan

QUERIES = entry_points.queries()
STATEMENTS = entry_points.oracle_sql()


@pytest.fixture
def large(spark, tuned):
    """Limits as if the tables were large, but no key heavy."""
    tuned(windowRows=2000, broadcastBytes=2000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", ["q_variance_rows", "q_variance_rows_family", "q_variance_rows_unset", "q_variance_month",
                                  "q_variance_week", "q_exceptions_plnr", "q_exceptions_cm", "q_fcr_cm", "q_fvc_cm", "q_fvc_plnr"])
def test_large_plans_equal_statements(name, spark, duck, large):
    expected, _ = duck_bag(duck, STATEMENTS[name])
    assert frame_bag(QUERIES[name](spark, SMALL)) == expected


@pytest.mark.parametrize("name", ["q_variance_rows", "q_variance_month"])
def test_one_shuffle_per_side_and_none_for_the_order(name, spark, large):
    df = QUERIES[name](spark, SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange shufflepartitionidpassthrough", text)) == 4  # forecast, two logs, items
    assert "Exchange rangepartitioning" not in text
    rows = [((r["product"]), r["monday"] is None, r["monday"]) for r in df.select("product", "monday").collect()]
    order = [(p, n, None if n else d) for p, n, d in rows]
    assert all((a[0], a[1]) < (b[0], b[1]) or a == b or (a[:2] == b[:2] and a[2] <= b[2]) for a, b in zip(order, order[1:]))
    assert len({r[0] for r in df.select(F.spark_partition_id()).distinct().collect()}) > 1


def _items(*parts):
    return [dict(part_name=p, part_site="S", product_family="F", dept="D", bu="B", build_type="T") for p in parts]


def test_logs_are_cut_to_the_keys_of_a_short_forecast(spark, tuned):
    tuned(windowRows=20)
    t = plan(spark, [fc()], [commit(product=f"P{k}", at=AS_OF) for k in range(30)], [adjust(product=f"P{k}", at=AS_OF) for k in range(30)],
             items=_items(*[f"P{k}" for k in range(30)]))
    p = load_plan(t, resolve(t, ONE), rows=True)
    assert p.commits.count() == p.adjustments.count() == 1
    assert variance.variance_rows(t, "PLNR", ONE).count() == 1


def test_heavy_products_are_found_in_large_plans(spark, tuned):
    """Rows that are drawn name the keys to count; the count itself is exact."""
    n = 60
    t = plan(spark, [fc(part="A")] + [fc() for _ in range(n)], [commit(at=AS_OF) for _ in range(n)], [adjust(at=AS_OF) for _ in range(n)],
             items=_items("A", "P1"))
    tuned(windowRows=150, broadcastBytes=100, hotRows=100_000)
    p = load_plan(t, resolve(t, ONE), rows=True)
    assert p.bounds is not None and p.share < 1
    assert [r["product"] for r in _heavy_products(p).collect()] == ["P1"]
    assert variance.variance_rows(t, "PLNR", ONE).count() == n ** 3 + 1


def test_ranges_of_products(spark):
    bounds = ["b", "d", "é", "z"]
    got = spark.createDataFrame([(x,) for x in ("", "a", "b", "c", "d", "dd", "z", "é", "zz", "ü")], "p string").select(
        "p", piece_of(F.col("p"), sorted(bounds, key=str.encode)).alias("n")).collect()
    assert {r.p: r.n for r in got} == {p: sum(b.encode() <= p.encode() for b in bounds) for p in (r.p for r in got)}
