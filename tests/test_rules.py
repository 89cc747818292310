"""Hand-made frames for the rules that whole-table checks show least clearly."""

import dataclasses
import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from supplyplan import EVERY, Tables, VarianceFilter
from supplyplan.functions.calendar import (
    iso_monday, plan_week, plan_week_of, stamp_text, view_bucket, week_dates,
)
from supplyplan.functions.text import clean_department, contains_pattern, join_text, supplier_key
from supplyplan.operators import (
    comparison, lookups, panels, plan_edits, preferences, requests, tasks, variance,
)
from supplyplan.plans.ledger import numbered
from supplyplan.sources.reasons import SEED_REASONS, seed_reasons
from supplyplan.sources.schemas import SCHEMAS

AS_OF = datetime(2020, 1, 24, 9, 5, 7)
MON = date(2020, 1, 20)


def table(spark, name, *rows):
    """A table with the declared schema; a row names only the columns it fills."""
    schema = SCHEMAS[name]
    fill = lambda r: tuple(Decimal(r[f.name]) if "decimal" in f.dataType.simpleString() and r.get(f.name) is not None
                           else r.get(f.name) for f in schema.fields)
    return spark.createDataFrame([fill(r) for r in rows], schema)


def fc(part="P1", day=MON, week=4, supplier="Acme Inc.", **q):
    return dict(component_part=part, demand_date=day, week_id=week, supplier=supplier,
                **{"req_plan_non_gsa": 10, "req_plan_gsa": 5, "req_plan_forecast": 1, **q})


def commit(day=MON, at=None, qty=1, product="P1", week=4, **more):
    return dict(product=product, demand_date=day, week_id=week, creation_date=at, non_gsa_commit_qty=qty, **more)


def adjust(day=MON, at=None, qty=1, product="P1", week=4, **more):
    return dict(product=product, demand_date=day, week_id=week, creation_date=at, req_plan_non_gsa_adj=qty, **more)


def plan(spark, forecast, commits=(), adjustments=(), items=None, planners=None, **other):
    items = items or [dict(part_name="P1", part_site="S1", product_family="F", dept="D", bu="B", build_type="T")]
    planners = planners or [dict(planner_code="XCM", description="X", organization_id=128, employee_id=1)]
    system = [dict(segment1=p, organization_id=128, planner_code="XCM") for p in {i["part_name"] for i in items}]
    frames = dict(forecast=forecast, commits=commits, adjustments=adjustments, item_master=items, planners=planners,
                  system_items=system,
                  suppliers=[dict(vendor_id=1, vendor_name="ACME Inc"), dict(vendor_id=2, vendor_name="Other")])
    frames.update(other)
    return Tables(**{n: table(spark, n, *rows) for n, rows in frames.items()})


ONE = VarianceFilter(planners=["XCM"], vendors=[1])


# calendar

@pytest.mark.parametrize("day,week", [(date(2020, 1, 1), 1), (date(2020, 1, 7), 1), (date(2020, 1, 8), 2),
                                      (date(2020, 12, 31), 53), (date(2021, 1, 1), 1), (date(2019, 12, 31), 53)])
def test_plan_week(spark, day, week):
    assert plan_week_of(day) == week
    assert spark.range(1).select(plan_week(F.lit(day))).first()[0] == week


def test_plan_week_over_400_years(spark):
    days = spark.range(400 * 366).select(F.date_add(F.lit(date(1800, 1, 1)), F.col("id").cast("int")).alias("d"))
    bad = days.where((plan_week("d") < 1) | (plan_week("d") > 53)
                     | (plan_week("d") != F.ceil(F.dayofyear("d") / 7).cast("int")))
    assert bad.count() == 0


@settings(deadline=None, max_examples=200)
@given(st.integers(1900, 2100), st.integers(1, 53))
def test_week_dates_are_that_week(year, week):
    first, end = week_dates(year, week)
    days = [first + timedelta(days=i) for i in range((end - first).days)]
    assert days and all(d.year == year and plan_week_of(d) == week for d in days)
    assert plan_week_of(first - timedelta(days=1)) != week and plan_week_of(end) != week


@settings(deadline=None, max_examples=200)
@given(st.integers(1990, 2030), st.integers(1, 53))
def test_shifted_dates_are_those_days(year, week):
    first, end = comparison._shifted_year_dates(year, week)
    span = [date(year, 1, 1) + timedelta(days=i) for i in range(-20, 400)]
    wanted = [d for d in span if plan_week_of(d) == week and (d - timedelta(days=7)).year == year]
    assert wanted == [d for d in span if first <= d < end]


def test_view_buckets(spark):
    row = lambda v: tuple(spark.range(1).select(*view_bucket(v, F.lit(date(2020, 2, 27)))).first())
    assert row("WEEK") == row("anything") == (9, date(2020, 2, 27))
    assert row("MONTH") == (2, date(2020, 2, 1)) and row("YEAR") == (2020, date(2020, 1, 1))
    assert spark.range(1).select(iso_monday(F.lit(date(2020, 1, 26)))).first()[0] == MON


def test_stamp_text():
    assert stamp_text(AS_OF) == "24-JAN-2020 09:05:07"


# text

def test_text_rules(spark):
    df = spark.createDataFrame([("A.b.",), ("...",), (None,), ("a\r\nb",), ("\r\n",)], "t string")
    assert [r[0] for r in df.select(supplier_key(F.col("t"))).collect()] == ["AB", None, None, "A\r\nB", "\r\n"]
    assert [r[0] for r in df.select(clean_department(F.col("t"))).collect()] == ["A.b.", "...", None, "ab", None]
    assert df.select(join_text("<", F.col("t"), ">")).collect()[2][0] == "<>"


@pytest.mark.parametrize("pattern,hit", [("b", ["abc", "a%b"]), ("a_c", ["abc"]), ("a%b", ["abc", "a%b"]), ("\\", ["x\\y"]),
                                         ("", ["abc", "a%b", "x\\y"])])
def test_like_pattern(spark, pattern, hit):
    df = spark.createDataFrame([("abc",), ("a%b",), ("x\\y",), (None,)], "t string")
    assert sorted(r[0] for r in df.where(contains_pattern(F.col("t"), pattern)).collect()) == sorted(hit)


# joined plan

def test_ties_multiply_and_newest_wins(spark):
    old, new = datetime(2020, 1, 1), datetime(2020, 1, 2)
    t = plan(spark, [fc()], [commit(at=old, qty=100), commit(at=new, qty=2), commit(at=new, qty=3), commit(qty=50)],
             [adjust(qty=7), adjust(qty=8)])
    rows = variance.variance_rows(t, "CM", ONE).collect()
    assert sorted((r.non_gsa_commit, r.non_gsa_adjustment) for r in rows) == [(2, 7), (2, 8), (3, 7), (3, 8)]
    sums = variance.variance_by_view(t, "REQ", "WEEK", ONE, AS_OF).collect()
    assert len(sums) == 1 and sums[0].variance == sum(r.variance for r in rows) == 4 * 16 + 30 - 10
    assert sums[0].adjustment_type is None


def test_commit_ignores_supplier_and_sites_multiply(spark):
    sites = [dict(part_name="P1", part_site=s, product_family="F", dept="D", bu="B", build_type="T") for s in "12"]
    t = plan(spark, [fc(), fc(supplier="other")], [commit(at=AS_OF, qty=4)], items=sites)
    assert [(r.org, r.non_gsa_forecast, r.non_gsa_commit) for r in
            variance.variance_by_view(t, "CM", "WEEK", ONE, AS_OF).orderBy("org").collect()] == [("1", 10, 4), ("2", 10, 4)]
    every = variance.variance_by_view(t, "CM", "WEEK", VarianceFilter(["XCM"], EVERY), AS_OF).orderBy("org").collect()
    assert [(r.non_gsa_forecast, r.non_gsa_commit) for r in every] == [(20, 8), (20, 8)]


def test_views_agree(spark):
    days = [MON, date(2020, 2, 3), date(2020, 12, 31), None]
    t = plan(spark, [fc(day=d) for d in days], [commit(day=MON, qty=3)], [adjust(day=d, qty=2) for d in days])
    totals = {v: variance.variance_by_view(t, "REQ", v, ONE, AS_OF).agg(F.sum("variance")).first()[0]
              for v in ("WEEK", "MONTH", "YEAR")}
    whole = variance.variance_rows(t, "REQ", ONE).agg(F.sum("variance")).first()[0]
    assert set(totals.values()) == {whole} == {4 * 16 + 3 * 2 - 3}
    monday = [r.monday for r in variance.variance_by_view(t, "REQ", "WEEK", ONE, AS_OF).collect()]
    assert monday == [*days[:3], None]


def test_empty_planner_and_vendor_lists(spark):
    t = plan(spark, [fc()])
    count = lambda f: variance.variance_rows(t, "PLNR", f).count()
    assert count(ONE) == count(VarianceFilter([None], [1])) == count(VarianceFilter(["no", None], EVERY)) == 1
    assert count(VarianceFilter([], [1])) == count(VarianceFilter(["XCM"], [])) == 0
    assert count(VarianceFilter.single("XCM", 1)) == 1
    assert count(VarianceFilter.single(None, 1)) == count(VarianceFilter.single("XCM", None)) == 0


def test_missing_family_or_department_never_passes(spark):
    item = dict(part_site="S", bu="B", build_type="T")
    t = plan(spark, [fc(p) for p in ("P1", "P2", "P3", "P4")], items=[
        dict(part_name="P1", product_family="F", dept="D\r\n", **item), dict(part_name="P2", dept="D", **item),
        dict(part_name="P3", product_family="F", **item), dict(part_name="P4", product_family="G", dept="\r\n", **item)])
    products = lambda **f: sorted(r.product for r in variance.variance_rows(
        t, "PLNR", VarianceFilter([None], EVERY, **f)).collect())
    assert products() == products(family="F") == products(department="D") == products(product="P") == ["P1"]
    assert products(family="G") == products(department="E") == products(product="p") == []


def test_snapshot_week(spark):
    t = plan(spark, [fc(), fc(week=5)])
    assert variance.variance_by_view(t, "PLNR", "WEEK", ONE, AS_OF).first().non_gsa_forecast == 10
    assert variance.variance_rows(t, "PLNR", ONE).count() == 2


def test_append_then_read(spark):
    t = plan(spark, [fc()], [commit(at=datetime(2020, 1, 1), qty=1, commit_id=9)])
    batch = spark.createDataFrame([(1, "P1", MON, 6, 0, 0, "R", "c")], """ord long, product string, monday date,
        non_gsa_commit int, gsa_commit int, commit int, adjustment_type string, adjustment_comment string""")
    after = plan_edits.append_commits(t.commits, batch, "XCM", "1", AS_OF)
    new = after.where("commit_id = 10").first()
    assert (new.created_by, new.planner_id, new.week_id, new.creation_date) == ("1", "XCM", 4, AS_OF)
    t2 = Tables(**{**vars(t), "commits": after})
    assert [(r.non_gsa_commit, r.adjustment_type) for r in variance.variance_rows(t2, "CM", ONE).collect()] == [(6, "R")]


def test_append_to_empty_and_empty_batch(spark):
    empty = table(spark, "adjustments")
    batch = spark.createDataFrame([(2, "P1", MON, 1, 1, 1, "T", "x"), (1, "P2", MON, 1, 1, 1, "T", "y")],
                                  """ord long, product string, monday date, non_gsa_adjustment int, gsa_adjustment int,
                                     adjustment int, adjustment_type string, adjustment_comment string""")
    after = plan_edits.append_adjustments(empty, batch, "XCM", "1", AS_OF)
    assert {r.adjustment_id: r["product"] for r in after.collect()} == {1: "P2", 2: "P1"}
    assert after.schema == empty.schema
    assert plan_edits.append_adjustments(empty, batch.limit(0), "XCM", "1", AS_OF).count() == 0


# week comparison

def test_week_comparison(spark):
    t = plan(spark, [fc(day=MON), fc(day=date(2020, 1, 27)), fc(day=date(2019, 1, 23)), fc(day=MON, week=3),
                     fc(day=date(2020, 1, 28))])
    last, current = comparison.week_comparison(t, ONE, AS_OF)
    # week 4 of 2020 is 22-28 January
    assert [(r.week_id, r.forecast_date, r.non_gsa_req) for r in current.collect()] == [(4, date(2020, 1, 27), 20)]
    assert [(r.week_id, r.forecast_date, r.non_gsa_req) for r in last.collect()] == [(3, date(2020, 1, 20), 20)]
    last, current = comparison.week_comparison(t, ONE, AS_OF, weeks=((2020, 2), (2020, 4)))
    assert [r.forecast_date for r in last.collect()] == [date(2020, 1, 13)]
    assert [r.forecast_date for r in current.collect()] == [date(2020, 1, 27)]
    assert comparison.week_comparison(t, ONE, AS_OF, year=2019)[1].first().forecast_date == date(2019, 1, 21)


# panels

def test_panels_of_other_roles_are_empty(spark):
    t = plan(spark, [fc()], tasks=[dict(task_request_id=1, created_by="1", task_status="Open")])
    board = panels.dashboard(t, "REQ", 1, vendors=[2])
    assert {n: df.count() for n, df in board.panels().items()} == {
        "exceptions": 0, "forecast_vs_commit": 0, "forecast_commit_receive": 0, "open_tasks": 0, "open_pos": 1}
    board.release()


def test_exceptions_count_planner_organizations_and_same_named_vendors(spark):
    codes = [dict(planner_code="XCM", description="X", organization_id=o, employee_id=1) for o in (128, 204)]
    vendors = [dict(vendor_id=v, vendor_name="acme inc") for v in (1, 3)]
    t = plan(spark, [fc(), fc(day=date(2020, 2, 3))], planners=codes, suppliers=vendors)
    assert [tuple(r) for r in panels.exceptions_by_counterparty(t, "CM", 1).collect()] == [("XCM", "X", 4, 64)]
    assert sorted(tuple(r) for r in panels.exceptions_by_counterparty(t, "PLNR", 1).collect()) == [
        ("1", "acme inc", 2, 32), ("3", "acme inc", 2, 32)]


def test_receive_shows_earliest_dates_and_null_last(spark):
    days = [date(2020, 3, d) for d in (30, 23, 16, 9)] + [None]
    t = plan(spark, [fc(day=d) for d in days])
    out = panels.forecast_commit_receive(t, "PLNR", 1)
    assert [r.forecast_date for r in out.collect()] == [*sorted(days[:4]), None]
    assert [r.forecast_date for r in panels.forecast_commit_receive(t, "PLNR", 1, k=2).collect()] == sorted(days[:4])[:2]
    first = out.first()
    assert (first.view, first.total_forecast, first.total_commit, first.total_received) == ("WEEK", 16, 0, 0)


def test_open_tasks(spark):
    rows = [dict(task_request_id=i, created_by="7", task_to="Other", task_status=s)
            for i, s in ((4, "closed"), (3, "Close"), (2, None), (1, "Open"))]
    t = Tables(tasks=table(spark, "tasks", *rows),
               suppliers=table(spark, "suppliers", dict(vendor_id=2, vendor_name="Other"),
                               dict(vendor_id=3, vendor_name="OTHER")))
    ids = lambda role, login: [r.task_request_id for r in panels.open_tasks(t, role, login).collect()]
    assert ids("PLNR", 7) == ids("CM", 2) == [1, 4]
    assert ids("PLNR", 8) == ids("CM", 3) == []


# lookups

def test_user_roles(spark):
    users = table(spark, "users", dict(user_name="p", employee_id=5, supplier_id=1), dict(user_name="one", supplier_id=1),
                  dict(user_name="two", supplier_id=2), dict(user_name="none", supplier_id=3), dict(user_name="x"),
                  dict(user_name="null", supplier_id=4), dict(user_name="mixed", supplier_id=6))
    contacts = table(spark, "supplier_contacts", *[dict(vendor_contact_id=c, vendor_site_id=s) for c, s in
                     ((1, 10), (1, 11), (2, 10), (2, 12), (4, 13), (6, 10), (6, 13))])
    sites = table(spark, "supplier_sites", *[dict(vendor_site_id=s, vendor_id=v) for s, v in
                  ((10, 100), (11, 100), (12, 200), (13, None))])
    got = {r.user_name: (r.user_type, r.user_id, r.error) for r in
           lookups.resolve_user_roles(users, contacts, sites).collect()}
    assert got == {"p": ("PLNR", 5, None), "one": ("CM", 100, None), "two": ("CM", 2, None), "none": ("CM", 3, None),
                   "x": (None, None, "Invalid Username"), "null": ("CM", None, None), "mixed": ("CM", 6, None)}


def test_search_criteria(spark):
    t = plan(spark, [], adj_reasons=[dict(ar_value="T1", ar_type="A"), dict(ar_value="R1", ar_type="R")], items=[
        dict(part_name="33210" + "x" * 60, product_family="F", dept="D\n"), dict(part_name="33210" + "x" * 60, dept="D"),
        dict(part_name="3350-1", dept="\r\n"), dict(part_name="3490-1")])
    got = lambda role: sorted((r.role, r.role_id or "", r.role_value or "") for r in
                              lookups.search_criteria(t, role, [2]).collect())
    common = [("DEPARTMENT", "", ""), ("DEPARTMENT", "D", ""), ("PLANNER", "XCM", "X"), ("PRODUCT_FAMILY", "F", ""),
              ("PRODUCT_LINE", "PL", ""), ("VENDOR", "2", "Other")]
    assert got("PLNR") == sorted([*common, ("ADJ_TYPE", "T1", "T1"), ("PRODUCT", "33210" + "x" * 45, "")])
    assert got("CM") == sorted([*common, ("RESN_TYPE", "R1", "R1"), ("PRODUCT", "3350-1", ""), ("PRODUCT", "3490-1", "")])
    with pytest.raises(ValueError, match="Invalid Usertype"):
        lookups.search_criteria(t, "REQ")


def test_seed_reasons(spark):
    df = seed_reasons(spark, [("own", "Own", "R")])
    assert df.count() == len(SEED_REASONS) + 1 and df.where("ar_type = 'A'").count() == 5


def test_preferences(spark):
    current = table(spark, "preferences", *[dict(user_id=u, user_name=f"u{u}", preference_name=n, preference_value="old")
                                            for u in (1, 2) for n in ("VIEW", "THEME")])
    batch = table(spark, "preferences", dict(user_id=1, user_name="u1", preference_name="VIEW", preference_value="new"))
    once = preferences.replace_preferences(current, batch)
    assert sorted((r.user_id, r.preference_value) for r in once.collect()) == [(1, "new"), (2, "old"), (2, "old")]
    assert sorted(map(tuple, preferences.replace_preferences(once, batch).collect())) == sorted(map(tuple, once.collect()))
    assert preferences.replace_preferences(current, batch.limit(0)).count() == 4
    assert lookups.user_preferences(current, [2]).count() == 2 and lookups.user_preferences(current, []).count() == 0


# ledgers

_REQUEST = dict(product_family="F", product_line="PL", product="P", request_quantity=3, request_type="T")


def _new(spark, *rows):
    names = [*requests.NEW_REQUIRED]
    return spark.createDataFrame([(i, *[r.get(n) for n in names]) for i, r in enumerate(rows)],
                                 "ord long, product_family string, product_line string, product string, "
                                 "request_quantity long, request_type string, request_comments string, approver string")


def test_request_ledger(spark):
    current = table(spark, "requests",
                    dict(request_id=1, planner_id="7", created_by="7", approval_status="NEW", **_REQUEST),
                    dict(request_id=2, planner_id="7", created_by="8", **_REQUEST),
                    dict(request_id=3, planner_id="9", created_by="9", approval_status="In Process", **_REQUEST),
                    dict(request_id=4, planner_id="9", created_by="9", approval_status="NEW", **_REQUEST))
    new = _new(spark, dict(request_comments="c", approver="A", **_REQUEST), dict(request_comments="c", **_REQUEST),
               dict(request_comments="c", approver="A", **{**_REQUEST, "product": "Q"}))
    inserted = requests.apply_requests(current, "7", AS_OF, new=new)
    added = inserted.where("request_id > 4").orderBy("request_id").collect()
    assert [(r.request_id, r["product"], r.approver_id, r.week_id, r.approval_status, r.supplier_id) for r in added] == [
        (5, "P", "A", 4, None, None), (6, "Q", "A", 4, None, None)]
    assert added[0].approved_date == added[0].creation_date == AS_OF
    remove = spark.createDataFrame([("F", "PL", "P", 3, "T", AS_OF, "other"), ("F", "PL", "Q", 3, "T", None, "A")],
                                   "product_family string, product_line string, product string, request_quantity int, "
                                   "request_type string, request_date timestamp_ntz, approver string")
    kept = requests.apply_requests(current, "7", AS_OF, new=new, remove=remove)
    assert sorted(r.request_id for r in kept.collect()) == [2, 3, 4, 6]
    answers = spark.createDataFrame([(2, "W2", True), (3, "W3", True), (4, "W4", False), (99, "W99", True)],
                                    "request_id long, workflow_id string, ok boolean")
    done = requests.apply_requests(current, "7", AS_OF, new=new, remove=remove, results=answers)
    assert {r.request_id: (r.approval_status, r.approval_workflow_id) for r in done.collect()} == {
        2: ("In Process", "W2"), 3: ("In Process", None), 4: ("ERROR", "W4"), 6: (None, None)}
    assert done.schema == current.schema


def test_task_actions(spark):
    current = table(spark, "tasks", dict(task_request_id=1, task_status="Open", task_message="m", created_by="c"),
                    dict(task_request_id=2, task_status="Open", task_message=None))
    columns = """ord long, action string, request_id string, login_type string, login_value string, planner string,
        p_from string, supplier string, p_to string, product string, forecast_date date, variance int, status string,
        subject string, message string"""
    act = lambda ord_, action, rid=None, role="PLNR", status="S", message="x": (
        ord_, action, rid, role, f"L{ord_}", "PL", "me", "SUP", "you", "P", MON, 4, status, "sub", message)
    batch = spark.createDataFrame([
        act(9, "UPDATE", "1", "CM", "Close", "late"), act(3, "UPDATE", "1", "PLNR", "Open", "early"),
        act(5, "UPDATE", "1", "REQ", "Odd"), act(4, "CREATE", message=None), act(2, "UPDATE", "3"), act(8, "UPDATE", "3"),
        act(6, "UPDATE", "77"), act(7, "UPDATE", "2", "REQ", None), act(1, "OTHER", "2"), act(10, "UPDATE", None)], columns)
    out = {r.task_request_id: r for r in tasks.apply_task_actions(current, batch, AS_OF).collect()}
    at = "24-JAN-2020 09:05:07"
    assert sorted(out) == [1, 2, 3]
    assert out[1].task_message == (f"m<BR/><U>{at} [me]</U><BR/>early<BR/><BR/><U>{at} [you]</U><BR/>late<BR/>")
    assert (out[1].task_status, out[1].updated_by, out[1].created_by) == ("Close", "L9", "c")
    assert (out[2].task_status, out[2].task_message, out[2].updated_by) == (None, None, "L7")
    # the update before the creation does not reach the new task
    assert out[3].task_message == f"<U>{at} [me]</U><BR/><BR/><BR/><U>{at} [me]</U><BR/>x<BR/>"
    assert (out[3].task_approval_id, out[3].variances, out[3].forecast_date, out[3].updated_by) == (3, "4", "2020-01-20", "L8")


def _adhoc(spark, *rows):
    return spark.createDataFrame(
        [(o, p, d, v, "XCM", "F", 1, 2, 3, "T", f"note{o}") for o, p, d, v in rows],
        """ord long, product string, forecast_date date, vendor_id long, planner string, product_family string,
           non_gsa_adjustment int, gsa_adjustment int, adjustment int, adjustment_type string, adjustment_comment string""")


def test_adhoc(spark):
    t = plan(spark, [fc(day=date(2019, 1, 24))], adjustments=[adjust(adjustment_id=20)])
    batch = _adhoc(spark, (1, "P9", MON, 1), (2, "P1", date(2020, 1, 23), 1), (3, "P1", MON, 99), (4, "P1", MON, 1),
                   (5, "P1", date(2021, 1, 15), 1), (6, "P1", MON, 99), (7, "P1", None, 2), (8, "P1", None, 2))
    forecast, adjustments, status = plan_edits.apply_adhoc(t, batch, AS_OF)
    assert {r.ord: (r.status, r.request_week) for r in status.collect()} == {
        1: ("INVALID_PRODUCT", 3), 2: ("PRESENT", 4), 3: ("VENDOR_ERROR", 3), 4: ("ACCEPTED", 3), 5: ("PRESENT", 3),
        6: ("PRESENT", 3), 7: ("ACCEPTED", None), 8: ("ACCEPTED", None)}
    added = forecast.where("remarks is not null").orderBy("remarks").collect()
    assert [(r.week_id, r.demand_date, r.supplier, r.req_plan_non_gsa, r.remarks) for r in added] == [
        (4, MON, "ACME Inc", 0, "note4"), (4, None, "Other", 0, "note7"), (4, None, "Other", 0, "note8")]
    new = adjustments.where("adjustment_id > 20").orderBy("adjustment_id").collect()
    assert [(r.adjustment_id, r.demand_date, r.req_plan_non_gsa_adj, r.supplier_id, r.created_by) for r in new] == [
        (21, MON, 1, "1", "XCM"), (22, None, 1, "2", "XCM"), (23, None, 1, "2", "XCM")]
    assert forecast.schema == t.forecast.schema and adjustments.schema == t.adjustments.schema


def test_adhoc_reads_the_forecast_once(spark, tmp_path):
    """None of the forecast while the results are built, one pass for status and adjustments together."""
    t = plan(spark, [fc(day=date(2019, 1, 24)), fc(part="P2")], adjustments=[adjust(adjustment_id=20)],
             items=[dict(part_name=p, part_site="S", product_family="F", dept="D", bu="B", build_type="T") for p in ("P1", "P2")])
    spied = t.forecast.coalesce(1).mapInArrow(_spy(str(tmp_path)), t.forecast.schema)
    batch = _adhoc(spark, *[(k, f"P{k % 2 + 1}", MON + timedelta(7 * k), 1) for k in range(20)])
    forecast, adjustments, status = plan_edits.apply_adhoc(dataclasses.replace(t, forecast=spied), batch, AS_OF)
    assert not list(tmp_path.iterdir())
    accepted = status.where("status = 'ACCEPTED'").count()
    new = adjustments.where("adjustment_id > 20").collect()
    assert sorted(r.adjustment_id for r in new) == list(range(21, 21 + accepted))
    assert len(list(tmp_path.iterdir())) == 1
    assert forecast.count() == 2 + accepted
    status.unpersist()


def _spy(folder):
    def passed(batches):
        import os
        import uuid

        open(os.path.join(folder, uuid.uuid4().hex), "w").close()
        yield from batches
    return passed


def test_adhoc_weeks_of_many_years_and_products(spark):
    """The mask of planned weeks against a plain set of (product, week)."""
    r = random.Random(1)
    days = [date(2015, 1, 1) + timedelta(r.randrange(3000)) for _ in range(60)]
    planned = [("P%d" % r.randrange(4), d) for d in days]
    t = plan(spark, [fc(part=p, day=d) for p, d in planned], items=[
        dict(part_name=f"P{k}", part_site="S", product_family="F", dept="D", bu="B", build_type="T") for k in range(4)])
    asked = [(k, f"P{r.randrange(5)}", date(2023, 1, 1) + timedelta(r.randrange(366)), 1) for k in range(150)]
    seen, expected = {(p, plan_week_of(d)) for p, d in planned}, {}
    for k, p, d, _ in asked:
        slot = p, plan_week_of(d)
        expected[k] = "INVALID_PRODUCT" if p == "P4" else "PRESENT" if slot in seen else "ACCEPTED"
        seen |= {slot} if expected[k] == "ACCEPTED" else set()
    got = plan_edits.adhoc_status(t, _adhoc(spark, *asked)).collect()
    assert {x.ord: x.status for x in got} == expected and set(expected.values()) == {"INVALID_PRODUCT", "PRESENT", "ACCEPTED"}


def test_numbering_within_a_larger_frame(spark, tuned):
    tuned(windowRows=7)
    rows = spark.createDataFrame([(k if k % 9 else None, k) for k in range(100)], "ord long, v long")
    few = rows.where("v % 3 = 0")
    a, b = (sorted((x.id, x.ord) for x in numbered(few, "ord", 5, "id", within=w).collect()) for w in (None, rows))
    assert a == b and [k for k, _ in a] == list(range(5, 39))


def test_numbering_keeps_rows_without_an_order(spark, tuned):
    """Every size of batch numbers rows without or with equal order values, first those without."""
    batch = spark.createDataFrame([(None, "a"), (3, "b"), (None, "c"), (3, "d"), (1, "e"), (2, "f"), (9, "g")], "ord long, v string")
    for limit in (100, 4, 2, 1):
        tuned(windowRows=limit)
        rows = {r.v: r.id for r in numbered(batch, "ord", 10, "id").collect()}
        assert sorted(rows.values()) == list(range(10, 17))
        assert {rows["a"], rows["c"]} == {10, 11} and rows["e"] == 12 and rows["f"] == 13 and rows["g"] == 16


def test_key_types_do_not_decide(spark, tuned):
    current = table(spark, "preferences", dict(user_id=1, user_name="a", preference_name="V", preference_value="x"),
                    dict(user_id=2, user_name="b", preference_name="V", preference_value="x"))
    batch = spark.createDataFrame([(1, "a", "V", "y")], "user_id int, user_name string, preference_name string, preference_value string")
    expected = [(1, "y"), (2, "x")]
    got = lambda: sorted((r.user_id, r.preference_value) for r in preferences.replace_preferences(current, batch).collect())
    assert got() == expected
    tuned(broadcastBytes=-1, hotRows=1)
    assert got() == expected


def test_empty_text_is_null(spark):
    f = VarianceFilter(planners=["", "X"], vendors=[1], product="", family="", department="")
    assert (f.planners, f.product, f.family, f.department) == ([None, "X"], None, None, None)
    current = table(spark, "requests", dict(request_id=1, planner_id="7", created_by="7", approval_status="", **_REQUEST))
    new = _new(spark, dict(request_comments="", approver="A", **_REQUEST), dict(request_comments="c", approver="A", **{**_REQUEST, "product_line": ""}),
               dict(request_comments="c", approver="A", **_REQUEST))
    assert requests.new_requests(current, new, "7", AS_OF).count() == 1
    answers = spark.createDataFrame([(1, "W1", True), (1, "W0", False)], "request_id long, workflow_id string, ok boolean")
    done = requests.settle_approvals(current, answers).collect()
    assert [(r.approval_status, r.approval_workflow_id) for r in done] == [("In Process", "W1")]


def test_bad_task_id_fails_alone(spark):
    current = table(spark, "tasks", dict(task_request_id=1, task_status="Open", task_message="m", created_by="c"))
    columns = """ord long, action string, request_id string, login_type string, login_value string, planner string,
        p_from string, supplier string, p_to string, product string, forecast_date date, variance int, status string,
        subject string, message string"""
    row = lambda o, action, rid: (o, action, rid, "PLNR", "L", "PL", "me", "S", "you", "P", MON, 1, "Close", "s", "x")
    batch = spark.createDataFrame([row(1, "UPDATE", "one"), row(2, "UPDATE", "1"), row(3, "UPDATE", "5"), row(4, "OTHER", None),
                                   row(5, "CREATE", None)], columns)
    assert {r.ord: r.status for r in tasks.task_action_status(current, batch, AS_OF).collect()} == {
        1: "BAD_ID", 2: "UPDATED", 3: "UNKNOWN_TASK", 4: "IGNORED", 5: "CREATED"}
    assert {r.task_request_id: r.task_status for r in tasks.apply_task_actions(current, batch, AS_OF).collect()} == {
        1: "Close", 2: "Close"}


def test_seed_reasons_are_dated(spark):
    rows = seed_reasons(spark, [("x", "y", "R")], AS_OF).collect()
    assert {r.creation_date for r in rows} == {AS_OF} and len(rows) == len(SEED_REASONS) + 1
    assert [(r.ar_id, r.ar_value, r.ar_type) for r in rows][:13] == list(SEED_REASONS)


def test_empty_labels_and_attributes_are_one_group_with_null(spark):
    days = [MON + timedelta(k) for k in range(3)]
    t = plan(spark, [fc(day=d) for d in days],
             adjustments=[adjust(d, at=AS_OF, adjustment_type=x, adjustment_comments=x) for d, x in zip(days, ("", None, ""))],
             items=[dict(part_name="P1", part_site=s, product_family="F", dept="D", bu=s, build_type=s) for s in ("", None)])
    got = variance.variance_by_view(t, "PLNR", "YEAR", ONE, AS_OF).collect()
    assert [(r.adjustment_type, r.adjustment_comment, r.org, r.bu, r.build_type, r.non_gsa_adjustment) for r in got] == [
        (None, None, None, None, None, 6)]
    assert {r.org for r in variance.variance_rows(t, "PLNR", ONE).collect()} == {None}


def test_empty_preferences_are_stored_as_null(spark):
    batch = table(spark, "preferences", dict(user_id=1, user_name="", preference_name="VIEW", preference_value=""))
    got = preferences.replace_preferences(table(spark, "preferences"), batch).collect()
    assert [(r.user_name, r.preference_value) for r in got] == [(None, None)]
