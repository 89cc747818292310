"""The inputs of the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Tables:
    """One DataFrame per logical table; an operator needs only the ones it reads.

    Pass tables as they are scanned. Columns follow `supplyplan.sources.schemas`.
    """

    forecast: DataFrame | None = None
    commits: DataFrame | None = None
    adjustments: DataFrame | None = None
    item_master: DataFrame | None = None
    system_items: DataFrame | None = None
    planners: DataFrame | None = None
    suppliers: DataFrame | None = None
    tasks: DataFrame | None = None
    requests: DataFrame | None = None
    preferences: DataFrame | None = None
    adj_reasons: DataFrame | None = None
    users: DataFrame | None = None
    supplier_contacts: DataFrame | None = None
    supplier_sites: DataFrame | None = None
    # sums of current revisions (`CurrentTotals`), which reports of sums then read instead of the logs
    commit_totals: DataFrame | None = None
    adjustment_totals: DataFrame | None = None
