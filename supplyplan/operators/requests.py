"""Unplanned-request ledger."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyplan.functions.calendar import plan_week_of, timestamp_literal
from supplyplan.functions.text import normalized, null_if_empty
from supplyplan.plans.ledger import aligned, append, next_id, numbered
from supplyplan.plans.skew import lookup_join
from supplyplan.sources.ledgers import StoredLedger

# Columns that must all be filled for a row of a batch to count.
NEW_REQUIRED = ("product_family", "product_line", "product", "request_quantity", "request_type",
                "request_comments", "approver")
REMOVE_REQUIRED = ("product_family", "product_line", "product", "request_quantity", "request_type",
                   "request_date", "approver")
_MATCH = ("product_family", "product_line", "product", "request_quantity", "request_type")


def _all_filled(columns: tuple[str, ...]) -> Column:
    test = F.lit(True)
    for c in columns:
        test = test & F.col(c).isNotNull()
    return test


def pending() -> Column:
    status = null_if_empty(F.col("approval_status"))
    return status.isNull() | (status == "NEW")


def new_requests(requests: DataFrame, new: DataFrame, login: str, as_of: date | datetime,
                 ids: Callable[[int], int] | None = None) -> DataFrame:
    """The rows that the completely filled requests of a batch (ordered by `ord`) add to the ledger, pending approval.

    Of the ledger only the greatest id is read, and nothing if `ids` reserves them (`IdBlocks`). Store them with `append_rows`."""
    now = timestamp_literal(as_of)
    valid = normalized(new).where(_all_filled(NEW_REQUIRED))
    rows = numbered(valid, "ord", ids or next_id(requests, "request_id"), "request_id").withColumnRenamed(
        "approver", "approver_id").withColumns({
            "planner_id": F.lit(login), "created_by": F.lit(login), "creation_date": now,
            "updated_by": F.lit(login), "updation_date": now, "approved_date": now,
            "week_id": F.lit(plan_week_of(as_of))})
    return aligned(rows, requests)


def insert_requests(requests: DataFrame, new: DataFrame, login: str, as_of: date | datetime) -> DataFrame:
    """The ledger with the new requests of a batch."""
    return append(requests, new_requests(requests, new, login, as_of))


def _removed(requests: DataFrame, remove: DataFrame, login: str, how: str) -> DataFrame:
    gone = normalized(remove).where(_all_filled(REMOVE_REQUIRED)).select(
        F.lit(login).alias("planner_id"), F.lit(login).alias("created_by"), *_MATCH).distinct()
    typed = gone.select(*[F.col(c).cast(requests.schema[c].dataType).alias(c) for c in gone.columns])
    return lookup_join(requests, typed, typed.columns, how).select(*requests.columns)


def remove_requests(requests: DataFrame, remove: DataFrame, login: str) -> DataFrame:
    """Delete the login's own requests that equal a completely filled row of the batch."""
    return _removed(requests, remove, login, "left_anti")


def settle_approvals(requests: DataFrame, results: DataFrame) -> DataFrame:
    """Move pending requests of any user on, as the approval workflow answered.

    Results: request_id, workflow_id, ok. Of several answers to a request the one with the greatest workflow id counts.
    A pending request without a result stays pending.
    """
    answers = results.groupBy("request_id").agg(F.max(F.struct("workflow_id", "ok")).alias("a")).select(
        "request_id", "a.workflow_id", "a.ok", F.lit(True).alias("answered"))
    moved = pending() & F.col("answered").isNotNull()
    both = lookup_join(requests, answers, ["request_id"], "left")
    return both.withColumns({
        "approval_workflow_id": F.when(moved, F.col("workflow_id")).otherwise(F.col("approval_workflow_id")),
        "approval_status": F.when(moved & F.col("ok"), "In Process").when(moved, "ERROR")
        .otherwise(F.col("approval_status")),
    }).select(*requests.columns)


def apply_requests(requests: DataFrame, login: str, as_of: date | datetime, new: DataFrame | None = None,
                   remove: DataFrame | None = None, results: DataFrame | None = None) -> DataFrame:
    """Insert, then delete (which may hit rows just added), then settle approvals."""
    if new is not None:
        requests = insert_requests(requests, new, login, as_of)
    if remove is not None:
        requests = remove_requests(requests, remove, login)
    if results is not None:
        requests = settle_approvals(requests, results)
    return requests


def store_requests(ledger: StoredLedger, login: str, as_of: date | datetime, new: DataFrame | None = None,
                   remove: DataFrame | None = None, results: DataFrame | None = None,
                   ids: Callable[[int], int] | None = None) -> int:
    """`apply_requests` on a stored ledger, as one version: only files with a request that is removed or answered are rewritten."""
    current = ledger.read()
    keys = current.select("request_id").limit(0)
    if remove is not None:
        keys = keys.unionByName(_removed(current, remove, login, "left_semi").select("request_id"))
    if results is not None:
        keys = keys.unionByName(results.select(F.col("request_id").cast("bigint")))

    def changed(rows: DataFrame) -> DataFrame:
        rows = rows if remove is None else remove_requests(rows, remove, login)
        return rows if results is None else settle_approvals(rows, results)

    added = None if new is None else changed(new_requests(current, new, login, as_of, ids))
    return ledger.change(keys, changed, added)
