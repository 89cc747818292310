"""Dashboard panels of one login: a planner (employee id) or a manufacturer (vendor id)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyplan.functions.quantities import total_commit, total_forecast
from supplyplan.functions.text import null_if_empty
from supplyplan.plans.scope import Scope, owned_items, planned_items, vendor_keys
from supplyplan.plans.skew import lookup_join
from supplyplan.plans.spine import Plan, load_plan, plan_rows, plan_totals, sum_measures
from supplyplan.tables import Tables

PLANNER, MANUFACTURER = "PLNR", "CM"

# Vendors of the pilot, used where a report takes no vendor list.
PILOT_VENDORS = (109420, 28306, 25917, 18025, 77523, 1388845)


def login_scope(t: Tables, role: str, login: int) -> Scope:
    """A planner sees the items of the own planner codes, a manufacturer the own forecast rows."""
    if role == PLANNER:
        return Scope(owned_items(t, login))
    if role == MANUFACTURER:
        return Scope(planned_items(t), vendor_keys(t, [login]))
    # other roles see nothing
    return Scope(planned_items(t).limit(0), vendor_keys(t, []))


def _sums(plan: Plan, role: str) -> DataFrame:
    """Plan sums as the panels need them: by supplier for planners, by planner code for others."""
    if role == PLANNER:
        return plan_totals(plan, by_supplier=True, collapse=True)
    return plan_totals(plan, attributes=["planner_code"], collapse=True)


def _total_forecast() -> Column:
    return F.col("forecast") + F.col("adjustment")


def exceptions_by_counterparty(t: Tables, role: str, login: int, plan: Plan | None = None,
                               sums: DataFrame | None = None) -> DataFrame:
    """Plan rows and variance by vendor (planner login) or by planner code (manufacturer login)."""
    plan = plan or load_plan(t, login_scope(t, role, login))
    sums = sums or _sums(plan, role)
    if role == PLANNER:
        sums = sum_measures(sums, ["supplier_key"])
        names = (t.suppliers.where(F.col("vendor_name").isNotNull())
                 .groupBy(F.upper("vendor_name").alias("supplier_key"),
                          F.col("vendor_id").cast("string").alias("code"), F.col("vendor_name").alias("name"))
                 .agg(F.count(F.lit(1)).alias("copies")))
        named = sums.join(names, "supplier_key")
    else:
        sums = sum_measures(sums, ["planner_code"])
        # planner codes repeat per organization, and each repetition counts
        names = (t.planners.groupBy("planner_code", F.col("description").alias("name"))
                 .agg(F.count(F.lit(1)).alias("copies")))
        named = sums.join(names, "planner_code").withColumn("code", F.col("planner_code"))
    return named.select("code", "name", (F.col("plan_rows") * F.col("copies")).alias("no_of_exceptions"),
                        ((_total_forecast() - F.col("commit")) * F.col("copies")).alias("exception_quantity"))


def forecast_vs_commit(t: Tables, role: str, login: int, plan: Plan | None = None) -> DataFrame:
    """(total forecast, total commit) of every row of the joined plan."""
    plan = plan or load_plan(t, login_scope(t, role, login), rows=True)
    return plan_rows(plan).select(total_forecast().alias("total_forecast"), total_commit().alias("total_commit"))


def forecast_commit_receive(t: Tables, role: str, login: int, k: int = 5, plan: Plan | None = None,
                            sums: DataFrame | None = None) -> DataFrame:
    """Totals of the `k` earliest demand dates; nothing is ever recorded as received."""
    plan = plan or load_plan(t, login_scope(t, role, login))
    sums = sum_measures(sums or plan_totals(plan, collapse=True), ["demand_date"])
    return sums.select(
        F.lit("WEEK").alias("view"), F.col("demand_date").alias("forecast_date"),
        _total_forecast().alias("total_forecast"), F.col("commit").alias("total_commit"),
        F.lit(0).cast("long").alias("total_received"),
    ).orderBy(F.col("forecast_date").asc_nulls_last()).limit(k)


def open_tasks(t: Tables, role: str, login: int) -> DataFrame:
    """Tasks not closed: a planner's own ones, or those sent to the manufacturer by name."""
    tasks = t.tasks.where(F.upper(null_if_empty(F.col("task_status"))) != "CLOSE")
    if role == PLANNER:
        tasks = tasks.where(F.col("created_by") == str(login))
    elif role == MANUFACTURER:
        names = (t.suppliers.where((F.col("vendor_id") == login) & F.col("vendor_name").isNotNull())
                 .select(F.col("vendor_name").alias("task_to")))
        tasks = lookup_join(tasks, names, ["task_to"], "inner")
    else:
        tasks = tasks.where(F.lit(False))
    return tasks.select(
        "task_request_id", "task_approval_id", "product", "forecast_date", "variances", "task_status",
        "task_from", "task_to", "task_subject", "task_message",
    ).orderBy(F.col("task_request_id").asc_nulls_last())


def open_pos(t: Tables, vendors: Sequence[int] = PILOT_VENDORS) -> DataFrame:
    """Placeholder list of open purchase orders: constants for each listed vendor."""
    return t.suppliers.where(F.col("vendor_id").isin(list(vendors))).select(
        F.col("vendor_id").cast("string").alias("code"), F.col("vendor_name").alias("name"),
        F.lit(1).alias("no_of_open_pos"), F.lit(10).alias("open_pos_quantity"))


@dataclass(frozen=True)
class Dashboard:
    """The panels; `release` drops the plan sums kept for them."""

    exceptions: DataFrame
    forecast_vs_commit: DataFrame
    forecast_commit_receive: DataFrame
    open_tasks: DataFrame
    open_pos: DataFrame
    kept: DataFrame = field(repr=False)

    def panels(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in _SUMMED}

    def release(self) -> None:
        self.kept.unpersist()


def dashboard(t: Tables, role: str, login: int, vendors: Sequence[int] = PILOT_VENDORS, keep: bool = True) -> Dashboard:
    """All panels of one login, over one scope and one set of plan sums.

    The sums, by counterparty and demand date as the panels need them, are kept until released; with `keep` false
    they are not kept, which serves a caller that reads all panels at once.
    """
    plan = load_plan(t, login_scope(t, role, login), rows=True)
    sums = sum_measures(_sums(plan, role), ["supplier_key" if role == PLANNER else "planner_code", "demand_date"])
    sums = sums.persist() if keep else sums
    return Dashboard(
        exceptions_by_counterparty(t, role, login, plan, sums),
        forecast_vs_commit(t, role, login, plan),
        forecast_commit_receive(t, role, login, plan=plan, sums=sums),
        open_tasks(t, role, login),
        open_pos(t, vendors),
        sums)


# panel -> columns whose sums the summary shows
_SUMMED = {
    "exceptions": ("no_of_exceptions", "exception_quantity"),
    "forecast_vs_commit": ("total_forecast", "total_commit"),
    "forecast_commit_receive": ("total_forecast", "total_commit"),
    "open_tasks": (None, None),
    "open_pos": ("no_of_open_pos", "open_pos_quantity"),
}


def dashboard_summary(board: Dashboard) -> DataFrame:
    """Row count and two totals per panel."""
    def line(name: str, df: DataFrame) -> DataFrame:
        first, second = (F.sum(c) if c else F.lit(None) for c in _SUMMED[name])
        return df.agg(F.lit(name).alias("panel"), F.count(F.lit(1)).alias("row_count"),
                      first.cast("decimal(38,4)").alias("total_1"), second.cast("decimal(38,4)").alias("total_2"))

    lines = [line(n, df) for n, df in board.panels().items()]
    out = lines[0]
    for one in lines[1:]:
        out = out.unionByName(one)
    return out
