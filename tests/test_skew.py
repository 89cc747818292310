"""Results do not depend on sizes: tight limits force every fallback and deal out most keys."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from conftest import SMALL
from helpers import duck_bag, frame_bag, same
from test_rules import AS_OF, MON, ONE, adjust, commit, fc, plan
from supplyplan.operators import variance
from supplyplan.plans.ledger import numbered
from supplyplan.plans.revisions import KEYS, latest
from supplyplan.plans.scope import resolve
from supplyplan.plans.sizing import Tuning, measure
from supplyplan.plans.skew import hot_keys, key_hash, lookup_join, salts_for, skew_join
from supplyplan.plans.spine import _heavy_products, _in_cells, load_plan, plan_rows

QUERIES = entry_points.queries()
STATEMENTS = entry_points.oracle_sql()

SHUFFLED = [
    "q_variance_rows", "q_variance_rows_scoped", "q_variance_week", "q_exceptions_plnr", "q_fvc_cm", "q_user_roles",
    "q_requests_approval", "q_tasks_update", "q_preferences_replace", "q_adhoc_adjustments", "q_append_commits",
]


@pytest.mark.parametrize("name", SHUFFLED)
def test_tight_limits(name, spark, duck, tuned):
    tuned(broadcastBytes=-1, hotRows=3, windowRows=100)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        expected, _ = duck_bag(duck, STATEMENTS[name])
        assert frame_bag(QUERIES[name](spark, SMALL)) == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def _keyed(spark, rows, value):
    return spark.createDataFrame(rows, f"k int, d int, {value} int").withColumn("id", F.monotonically_increasing_id())


def _heavy_rows(rng, n, width):
    # a third of all rows on one key, some keys without a partner, some NULL keys
    return [((7 if i % 3 == 0 else rng.choice([None, *range(width)])), rng.randrange(2), i) for i in range(n)]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("hot_side", ["left", "right", "both"])
def test_skew_join(how, hot_side, spark):
    rng = random.Random(3)
    left = _keyed(spark, _heavy_rows(rng, 120, 9), "x")
    right = _keyed(spark, _heavy_rows(rng, 90, 14), "y").withColumnRenamed("id", "rid")
    tuning = Tuning(hot_rows=4)
    counts = lambda df: {r["h"]: r["n"] for r in df.groupBy(key_hash(["k", "d"]).alias("h")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    left_salts = salts_for(counts(left), tuning) if hot_side != "right" else {}
    right_salts = salts_for(counts(right), tuning) if hot_side != "left" else {}
    assert left_salts or right_salts
    dealt = skew_join(left, right, ["k", "d"], how, left_salts, right_salts,
                      left_spread=F.col("id"), right_spread=F.col("rid"))
    assert same(dealt, left.join(right, ["k", "d"], how))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_shuffled(how, spark, tuned):
    tuned(broadcastBytes=-1, hotRows=4)
    left = _keyed(spark, _heavy_rows(random.Random(5), 150, 9), "x")
    right = spark.createDataFrame([(k, d) for k in (1, 2, 7, 20) for d in (0, 1)], "k int, d int")
    assert same(lookup_join(left, right, ["k", "d"], how), left.join(right, ["k", "d"], how))


def test_heavy_key_is_spread(spark):
    left = spark.range(30000).select(F.lit(1).alias("k"), "id")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    tuning = Tuning(hot_rows=1000)
    hot = hot_keys(left, ["k"], tuning)
    assert list(hot.values()) == [30000]
    joined = skew_join(left, right.hint("merge"), ["k"], "inner", salts_for(hot, tuning), left_spread=F.col("id"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        per_task = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(r["count"] for r in per_task) == 30000
    assert max(r["count"] for r in per_task) < 15000


def test_hot_keys_of_nothing(spark):
    assert hot_keys(spark.createDataFrame([], "k int"), ["k"], Tuning(hot_rows=1)) == {}


def _revisions(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        key = ("A", 4, 1) if i % 3 == 0 else (rng.choice("ABCD"), rng.choice([4, 5]), rng.randrange(4))
        rows.append((*key, rng.choice([None, "2020-01-01", "2020-01-02", "2020-01-03"]), i))
    return spark.createDataFrame(rows, "product string, week_id int, day int, stamp string, q int").select(
        "product", "week_id", F.date_add(F.lit("2020-01-06").cast("date"), F.col("day")).alias("demand_date"),
        F.col("stamp").cast("timestamp_ntz").alias("creation_date"), "q")


@pytest.mark.parametrize("seed", range(3))
def test_latest_equals_correlated_maximum(seed, spark):
    revs = _revisions(spark, seed)
    best = {}
    for r in revs.collect():
        best.setdefault(tuple(r[k] for k in KEYS), []).append(r)
    expected = set()
    for group in best.values():
        stamps = [r["creation_date"] for r in group if r["creation_date"] is not None]
        newest = max(stamps) if stamps else None
        expected |= {r["q"] for r in group if r["creation_date"] == newest}
    assert {r["q"] for r in latest(revs).collect()} == expected
    hot = hot_keys(revs, KEYS, Tuning(hot_rows=20))
    assert hot
    assert sorted(r["q"] for r in latest(revs, hot).collect()) == sorted(expected)


@pytest.mark.parametrize("limit", [5, 64, 10**6])
def test_numbering(limit, spark, tuned):
    tuned(windowRows=limit)
    ords = random.Random(1).sample(range(10**12), 300)
    got = numbered(spark.createDataFrame([(o,) for o in ords], "ord long"), "ord", 41, "id").collect()
    assert {r["ord"]: r["id"] for r in got} == {o: 41 + i for i, o in enumerate(sorted(ords))}


def test_measure(spark):
    df = spark.createDataFrame([("abc", 1), (None, 2)], "s string, n int")
    size = measure(a=df, b=df.limit(0))
    assert size["a"].rows == 2 and size["a"].bytes == 2 * (32 + 8) + 3
    assert size["b"].rows == size["b"].bytes == 0


def test_a_product_of_groups_is_dealt_out(spark, tuned):
    """Few equal rows on each side, too many together: no task makes more than its share, and all rows are there."""
    tuned(hotRows=2000)
    n = 30
    t = plan(spark, [fc() for _ in range(n)] + [fc(part="P2"), fc(part="P3")], [commit(at=AS_OF) for _ in range(n)] + [commit(product="P2", at=AS_OF)],
             [adjust(at=AS_OF) for _ in range(n)] + [adjust(product="P3", at=AS_OF)],
             items=[dict(part_name=p, part_site="S", product_family="F", dept="D", bu="B", build_type="T") for p in ("P1", "P2", "P3")])
    rows = plan_rows(load_plan(t, resolve(t, ONE), rows=True))
    made = {r["product"]: r["n"] for r in rows.groupBy("product").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert made == {"P1": n ** 3, "P2": 1, "P3": 1}
    assert rows.where("product = 'P2' AND non_gsa_commit = 1 AND non_gsa_adjustment IS NULL").count() == 1
    as_large = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    [spark.conf.set(k, v) for k, v in as_large.items()]
    try:
        shares = [r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    finally:
        [spark.conf.unset(k) for k in as_large]
    assert len(shares) == 4 and max(shares) < 0.7 * n ** 3  # four shuffle partitions in tests
    cells = _in_cells(load_plan(t, resolve(t, ONE), rows=True).forecast, _heavy_products(load_plan(t, resolve(t, ONE), rows=True)), 0)
    assert cells.where("product = 'P1'").select("_i", "_j", "_k").distinct().count() > 7  # of 14 pieces


@pytest.mark.parametrize("sides", [(12, 0, 30), (12, 30, 0), (400, 1, 1), (1, 20, 20), (3, 11, 13)])
def test_dealt_products_equal_plain_ones(sides, spark, tuned):
    f, c, a = sides
    days = [MON, MON + timedelta(7)]
    t = plan(spark, [fc(day=d, req_plan_non_gsa=k) for k in range(f) for d in days], [commit(day=MON, at=AS_OF, qty=k) for k in range(c)],
             [adjust(day=MON, at=AS_OF, qty=k) for k in range(a)])
    plain = variance.variance_rows(t, "PLNR", ONE)
    expected = frame_bag(plain)
    tuned(hotRows=7)
    assert frame_bag(variance.variance_rows(t, "PLNR", ONE)) == expected
    assert sum(expected.values()) == f * max(c, 1) * max(a, 1) + f
