"""Maintained totals of current revisions against the full rule over the log."""

import dataclasses
import random
from datetime import datetime, timedelta

import pytest
from helpers import same
from pyspark.sql import functions as F
from test_rules import AS_OF, MON, ONE, adjust, commit, fc, plan, table

from supplyplan.functions.quantities import COMMITS
from supplyplan.operators import panels, variance
from supplyplan.plans.revisions import KEYS, latest, revisions, totals
from supplyplan.plans.spine import COMMIT_LABELS
from supplyplan.sources.current_totals import CurrentTotals


def random_commits(r, n):
    return [commit(day=r.choice([MON, MON + timedelta(7), None]), at=r.choice([None, AS_OF, AS_OF + timedelta(r.randrange(3))]), qty=r.randrange(9),
                   product=r.choice(["P1", "P2", None]), week=r.choice([4, 5, None]), commit_reason=r.choice(["A", "", None])) for _ in range(n)]


def full_rule(log):
    labels = list(COMMIT_LABELS)
    return totals(latest(revisions(log, COMMITS, labels)), list(COMMITS), "rows", labels)


def test_twenty_batches_equal_the_full_rule(spark, tmp_path):
    r, held = random.Random(1), []
    kept = CurrentTotals(spark, str(tmp_path), "commits", slots=2)
    for k in range(20):
        batch = random_commits(r, r.randrange(1, 6))
        held += batch
        kept.append(table(spark, "commits", *batch))
        if k in (0, 9, 19):
            assert same(kept.read().drop("creation_date"), full_rule(table(spark, "commits", *held))), k
    assert kept.read().count() > 4


def test_a_batch_rewrites_only_its_slots(spark, tmp_path):
    kept = CurrentTotals(spark, str(tmp_path), "commits", slots=8)
    kept.append(table(spark, "commits", *[commit(day=MON + timedelta(k), at=AS_OF, week=w) for k in range(40) for w in (4, 5)]))
    before = set(kept.ledger.files())
    assert len(before) > 8
    kept.append(table(spark, "commits", commit(day=MON, at=AS_OF + timedelta(1), week=4, qty=77)))
    assert len(before - set(kept.ledger.files())) == 1 and len(set(kept.ledger.files()) - before) == 1
    assert kept.read(4).where("non_gsa_commit = 77").count() == 1 and kept.read(5).where("week_id = 5").count() == 40


def test_a_week_opens_its_files_only(spark, tmp_path):
    kept = CurrentTotals(spark, str(tmp_path), "commits", slots=4)
    kept.append(table(spark, "commits", *[commit(day=MON + timedelta(k), at=AS_OF, week=w) for k in range(20) for w in range(1, 9)]))
    assert {r.week_id for r in kept.read(4).select("week_id").distinct().collect()} == {4}
    assert len(kept.read(4).inputFiles()) <= 4 < len(kept.read().inputFiles())


@pytest.mark.parametrize("empty", [False, True])
def test_reports_from_totals(spark, tmp_path, empty):
    days = [MON + timedelta(7 * k) for k in range(2)]
    commits = [] if empty else [commit(d, at=a, qty=q, commit_reason="R") for d in days for a, q in ((None, 1), (AS_OF, 2), (AS_OF, 3))]
    adjustments = [] if empty else [adjust(d, at=AS_OF, qty=5, adjustment_type=x) for d in days for x in ("A", "")]
    t = plan(spark, [fc(day=d) for d in days for _ in range(2)], commits, adjustments)
    kept = {}
    for name in ("commits", "adjustments"):
        store = CurrentTotals(spark, str(tmp_path), name)
        store.append(getattr(t, name))
        kept[f"{name[:-1]}_totals"] = store.read()
    unread = {n: getattr(t, n).where(F.raise_error("the log was read").cast("boolean")) for n in ("commits", "adjustments")}
    from_totals = dataclasses.replace(t, **kept, **unread)
    for role in ("PLNR", "CM"):
        a, b = (variance.variance_by_view(x, role, "WEEK", ONE, AS_OF) for x in (t, from_totals))
        assert same(a, b)
    a, b = (panels.exceptions_by_counterparty(x, "CM", 1) for x in (t, from_totals))
    assert same(a, b) and a.count()
