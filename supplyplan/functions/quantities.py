"""Quantity columns of the plan and the measures computed from them.

Three buckets (non-GSA, GSA, forecast) exist on the forecast, on planner adjustments
and on supplier commits. Missing quantities count as zero everywhere.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# measure -> column of the forecast table
FORECAST = {
    "non_gsa_forecast": "req_plan_non_gsa",
    "gsa_forecast": "req_plan_gsa",
    "forecast": "req_plan_forecast",
    "buffer": "req_plan_buffer",
    "buffer_opt_adj": "req_plan_buffer_opt_adj",
    "original_forecast": "original_irp_total_original",
    "final_forecast": "final_irp_total_final",
}

# measure -> column of the commit table
COMMITS = {
    "non_gsa_commit": "non_gsa_commit_qty",
    "gsa_commit": "gsa_commit_qty",
    "commit": "commit_quantity",
}

# measure -> column of the adjustment table
ADJUSTMENTS = {
    "non_gsa_adjustment": "req_plan_non_gsa_adj",
    "gsa_adjustment": "req_plan_gsa_adj",
    "adjustment": "adjustment_quantity",
}

# order in which reports show the measures; variance follows them
MEASURES = (
    "non_gsa_forecast", "non_gsa_commit", "non_gsa_adjustment",
    "gsa_forecast", "gsa_commit", "gsa_adjustment",
    "forecast", "commit", "adjustment",
    "buffer", "buffer_opt_adj", "original_forecast", "final_forecast",
)


def nz(column: str | Column) -> Column:
    """NULL as zero."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(0))


def _total(*names: str) -> Column:
    return reduce(add, (nz(n) for n in names))


def total_forecast() -> Column:
    """Forecast of the three buckets plus planner adjustments; buffers do not count."""
    return _total("non_gsa_forecast", "gsa_forecast", "forecast",
                  "non_gsa_adjustment", "gsa_adjustment", "adjustment")


def total_commit() -> Column:
    return _total("non_gsa_commit", "gsa_commit", "commit")


def variance() -> Column:
    return total_forecast() - total_commit()
