"""Week-over-week comparison."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyplan.functions.calendar import iso_monday, plan_week, plan_week_of, week_dates
from supplyplan.plans.scope import VarianceFilter, resolve
from supplyplan.plans.spine import load_plan, plan_totals, sum_measures
from supplyplan.tables import Tables

# report column -> measure
_COLUMNS = {
    "non_gsa_req": "non_gsa_forecast", "non_gsa_adj": "non_gsa_adjustment", "non_gsa_commit": "non_gsa_commit",
    "gsa_req": "gsa_forecast", "gsa_adj": "gsa_adjustment", "gsa_commit": "gsa_commit",
    "forecast_req": "forecast", "forecast_adj": "adjustment", "forecast_commit": "commit",
}


def _week_report(totals: DataFrame, day: Column) -> DataFrame:
    sums = totals.withColumns({"week": plan_week(day), "forecast_date": iso_monday(day)})
    return sum_measures(sums, ["product", "week", "forecast_date"]).select(
        "product", F.col("week").alias("week_id"), "forecast_date",
        *[F.col(m).alias(c) for c, m in _COLUMNS.items()],
    ).orderBy(F.col("product").asc_nulls_last(), F.col("forecast_date").asc_nulls_last())


def _shifted_year_dates(year: int, week: int) -> tuple[date, date]:
    """Days of plan week `week` whose day seven days earlier lies in `year`.

    Only the days of week 1 change the year when shifted, and all of them do.
    """
    return week_dates(year + 1 if week == 1 else year, week)


def week_comparison(t: Tables, f: VarianceFilter, as_of: date | datetime, year: int | None = None,
                    weeks: tuple[tuple[int, int], tuple[int, int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(last week, current week) of the current snapshot.

    Both read the demand week of the clock; "last" shows it under the date seven days
    earlier and asks for that date's year to be `year` (default: the year of the clock).
    With `weeks` = ((year, week), (year, week)) the first pair names the shifted week of
    the "last" report, the second the week and shifted year of the "current" one.
    """
    day, snapshot = F.col("demand_date"), plan_week_of(as_of)
    year = as_of.year if year is None else year
    if weeks is None:
        last, current = _shifted_year_dates(year, snapshot), week_dates(year, snapshot)
    else:
        (y1, w1), (y2, w2) = weeks
        last = tuple(d + timedelta(days=7) for d in week_dates(y1, w1))
        current = _shifted_year_dates(y2, w2)
    # the ranges differ in week 1 only; else one plan, measured once, serves both reports
    totals = {dates: plan_totals(load_plan(t, resolve(t, f, week=snapshot, dates=dates))) for dates in {last, current}}
    return _week_report(totals[last], F.date_sub(day, 7)), _week_report(totals[current], day)
