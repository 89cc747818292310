"""What current totals leave on disk, merges in several rounds, and large plans that read totals."""

import dataclasses
import json
import os
import random
import re
from datetime import timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from test_current_totals import full_rule, random_commits
from test_rules import AS_OF, MON, ONE, adjust, commit, fc, plan, table

import __spark_entry__ as entry_points
from conftest import SMALL
from helpers import duck_bag, frame_bag, same
from supplyplan.operators import panels, variance
from supplyplan.sources.current_totals import CurrentTotals


def files_under(folder):
    return {os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")}


def listed(folder):
    """The data files of the newest version of each ledger under a folder."""
    found = set()
    for d, _, names in os.walk(folder):
        if os.path.basename(d) == "versions":
            newest = max(n for n in names if not n.startswith("."))
            with open(os.path.join(d, newest), encoding="utf-8") as f:
                found |= {re.sub("^file:/+", "/", json.loads(line)["path"]) for line in f}
    return found


def shuffle_files(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {p: os.path.getsize(p) for p in blocks.splitlines() if os.path.basename(p).startswith("shuffle_") and os.path.exists(p)}


def many_commits(n, k=0):
    return [commit(day=MON + timedelta(7 * (x % 50)), at=AS_OF + timedelta(k), qty=x % 9, product=f"P{x // 50}", commit_reason=f"R{x % 3}")
            for x in range(n)]


def test_the_query_leaves_the_newest_files_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(entry_points, "work_folder", lambda _, name: str(tmp_path / name))
    assert entry_points.queries()["q_variance_week_kept"](spark, SMALL).count()
    assert files_under(tmp_path) == listed(tmp_path) != set()


def test_an_append_leaves_no_batch_and_no_shuffle_behind(spark, tmp_path):
    kept = CurrentTotals(spark, str(tmp_path), "commits")
    batches = [table(spark, "commits", *many_commits(5000, k)) for k in range(2)]
    before = shuffle_files(spark)
    for batch in batches:
        kept.append(batch)
    left = sum(size for p, size in shuffle_files(spark).items() if p not in before)
    assert left < 60_000  # numbers of rows; the rows themselves take more
    assert not any("/staged/" in f for f in files_under(tmp_path))
    assert kept.read().agg(F.sum("rows")).first()[0] == 5000


def test_rounds_equal_the_full_rule(spark, tmp_path, tuned):
    tuned(windowRows=10)
    r, held = random.Random(5), []
    kept = CurrentTotals(spark, str(tmp_path), "commits", slots=2, round_rows=50)
    for k in range(3):
        batch = many_commits(600, k % 2)[k * 50:400 + k * 50] + random_commits(r, 20)
        held += batch
        folders = set(os.listdir(tmp_path / "commits_current" / "data")) if k else set()
        kept.append(table(spark, "commits", *batch))
        assert len(set(os.listdir(tmp_path / "commits_current" / "data")) - folders) > 3
        assert same(kept.read().drop("creation_date"), full_rule(table(spark, "commits", *held))), k
    assert {x.week_id for x in kept.read(5).select("week_id").distinct().collect()} == {5}


def test_heavy_keys_are_summed_up_first(spark, tmp_path, tuned):
    tuned(hotRows=5)
    rows = [commit(at=AS_OF, qty=q) for q in range(40)] + many_commits(100)
    kept = CurrentTotals(spark, str(tmp_path), "commits", slots=4)
    for k in (0, 1):
        kept.append(table(spark, "commits", *rows[k::2]))
    assert same(kept.read().drop("creation_date"), full_rule(table(spark, "commits", *rows)))


def test_quantities_are_rounded_after_their_sum(spark, tmp_path):
    rows = table(spark, "commits", *[commit(at=AS_OF)] * 3).withColumn("non_gsa_commit_qty", F.lit(Decimal("0.000040")))
    kept = CurrentTotals(spark, str(tmp_path), "commits")
    kept.append(rows)
    assert kept.read().first()["non_gsa_commit"] == Decimal("0.0001")


def test_forgotten_versions(spark, tmp_path):
    kept = CurrentTotals(spark, str(tmp_path), "commits", slots=8)
    kept.append(table(spark, "commits", *many_commits(100)))
    assert kept.append(table(spark, "commits", commit(at=AS_OF + timedelta(9), product="P0", qty=77))) == 2
    first = {f.path for f in kept.ledger.files(1)}
    with pytest.raises(ValueError):
        kept.ledger.forget(2)
    kept.ledger.forget(0)
    assert len(first) > 1 and kept.ledger.read(1).count() == 100
    kept.ledger.forget(1)
    kept.ledger.forget(1)
    assert kept.ledger.read(2).count() == 100 and files_under(tmp_path) == listed(tmp_path)
    assert len(first & {f.path for f in kept.ledger.files(2)}) == len(first) - 1


# large plans

@pytest.fixture
def large(spark, tuned):
    tuned(windowRows=2000, broadcastBytes=2000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_large_plan_of_totals_is_shuffled_once(spark, duck, large):
    df = entry_points.queries()["q_variance_week_kept"](spark, SMALL)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Exchange shufflepartitionidpassthrough", text)) == 4  # forecast, two totals, items
    assert "Exchange rangepartitioning" not in text
    assert frame_bag(df) == duck_bag(duck, entry_points.oracle_sql()["q_variance_week_kept"])[0]


def test_reports_of_large_totals(spark, tmp_path, tuned):
    days, products = [MON + timedelta(7 * k) for k in range(2)], [f"P{k}" for k in range(30)]
    commits = [commit(d, at=a, qty=q, product=p, commit_reason="R") for d in days for p in products for a, q in ((None, 1), (AS_OF, 2), (AS_OF, 3))]
    adjustments = [adjust(d, at=AS_OF, qty=5, product=p, adjustment_type=x) for d in days for p in products for x in ("A", "")]
    items = [dict(part_name=p, part_site="S", product_family="F", dept="D", bu="B", build_type="T") for p in products]
    t = plan(spark, [fc(p, day=d) for d in days for p in products for _ in range(2)], commits, adjustments, items=items)
    kept = {}
    for name in ("commits", "adjustments"):
        store = CurrentTotals(spark, str(tmp_path), name)
        store.append(getattr(t, name))
        kept[f"{name[:-1]}_totals"] = store.read()
    from_totals = dataclasses.replace(t, **kept)
    reports = [lambda x, role=role: variance.variance_by_view(x, role, "WEEK", ONE, AS_OF) for role in ("PLNR", "CM", "REQ")]
    reports += [lambda x: panels.exceptions_by_counterparty(x, "CM", 1), lambda x: panels.forecast_commit_receive(x, "CM", 1)]
    expected = [frame_bag(report(t)) for report in reports]
    tuned(windowRows=50, broadcastBytes=100)
    for report, rows in zip(reports, expected):
        assert rows and frame_bag(report(from_totals)) == rows
