"""Appending revisions: planner adjustments, supplier commits, ad-hoc forecasts.

Each function takes the current table and a batch and returns the new table; writing it
is up to the caller. Batches carry their order in the column `ord`.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from supplyplan.functions.calendar import plan_week, plan_week_of, timestamp_literal
from supplyplan.functions.text import normalized
from supplyplan.plans.ledger import aligned, append, next_id, numbered
from supplyplan.plans.sizing import Size, Tuning, measure
from supplyplan.plans.skew import lookup_join
from supplyplan.tables import Tables


# a date's plan week, or none
_WEEKS = 54


def _stamped(rows: DataFrame, user, as_of: date | datetime) -> DataFrame:
    now = timestamp_literal(as_of)
    return rows.withColumns({"created_by": user, "creation_date": now, "updated_by": user, "updation_date": now,
                             "week_id": F.lit(plan_week_of(as_of))})


def new_adjustments(adjustments: DataFrame, batch: DataFrame, planner: str, vendor: str,
                    as_of: date | datetime, ids: Callable[[int], int] | None = None) -> DataFrame:
    """The revisions that a batch of planner adjustments adds to the log.

    Of the log only the greatest id is read, and nothing if `ids` reserves them (`IdBlocks`).

    Store them with `append_rows`. Batch: ord, product, monday, non_gsa_adjustment, gsa_adjustment, adjustment,
    adjustment_type, adjustment_comment.
    """
    rows = numbered(normalized(batch), "ord", ids or next_id(adjustments, "adjustment_id"), "adjustment_id").select(
        "adjustment_id", F.lit(planner).alias("planner_id"), F.lit(vendor).alias("supplier_id"), "product",
        F.col("non_gsa_adjustment").alias("req_plan_non_gsa_adj"), F.col("gsa_adjustment").alias("req_plan_gsa_adj"),
        F.col("adjustment").alias("adjustment_quantity"), "adjustment_type",
        F.col("adjustment_comment").alias("adjustment_comments"), F.col("monday").alias("demand_date"))
    return aligned(_stamped(rows, F.lit(planner), as_of), adjustments)


def append_adjustments(adjustments: DataFrame, batch: DataFrame, planner: str, vendor: str,
                       as_of: date | datetime) -> DataFrame:
    """The log with the new adjustments of a batch."""
    return adjustments.unionByName(new_adjustments(adjustments, batch, planner, vendor, as_of))


def new_commits(commits: DataFrame, batch: DataFrame, planner: str, vendor: str, as_of: date | datetime,
                ids: Callable[[int], int] | None = None) -> DataFrame:
    """The revisions that a batch of supplier commits adds to the log.

    Of the log only the greatest id is read, and nothing if `ids` reserves them (`IdBlocks`).

    Store them with `append_rows`. Batch: ord, product, monday, non_gsa_commit, gsa_commit, commit, adjustment_type (the
    reason), adjustment_comment.
    """
    rows = numbered(normalized(batch), "ord", ids or next_id(commits, "commit_id"), "commit_id").select(
        "commit_id", F.lit(planner).alias("planner_id"), F.lit(vendor).alias("supplier_id"), "product",
        F.col("non_gsa_commit").alias("non_gsa_commit_qty"), F.col("gsa_commit").alias("gsa_commit_qty"),
        F.col("commit").alias("commit_quantity"), F.col("adjustment_type").alias("commit_reason"),
        F.col("adjustment_comment").alias("commit_comments"), F.col("monday").alias("demand_date"))
    return aligned(_stamped(rows, F.lit(vendor), as_of), commits)


def append_commits(commits: DataFrame, batch: DataFrame, planner: str, vendor: str,
                   as_of: date | datetime) -> DataFrame:
    """The log with the new commits of a batch."""
    return commits.unionByName(new_commits(commits, batch, planner, vendor, as_of))


def adhoc_status(t: Tables, batch: DataFrame) -> DataFrame:
    """The batch with `status`, `vendor_name` and `request_week` (plan week of the asked date).

    As if requests came one after another in `ord` order: INVALID_PRODUCT for unknown
    parts; PRESENT when the product already has a demand date in that week of any year,
    in the forecast or through an earlier accepted request; VENDOR_ERROR when the vendor
    id does not name exactly one vendor; otherwise ACCEPTED. A request without a date
    meets no other.
    """
    order = F.col("ord")
    asked = normalized(batch).withColumn("request_week", plan_week(F.col("forecast_date")))
    products = asked.select("product").where("product IS NOT NULL").distinct()
    known = measure(products=products)["products"]
    few = known.fits(Tuning.of(batch.sparkSession))
    # the plan has one row for each product, and the batch at most one for each of its plan weeks, so nothing is scanned to be measured
    per_product = Size(known.rows, known.bytes + 16 * known.rows) if few else None
    per_week = Size(_WEEKS * known.rows, _WEEKS * (known.bytes + 32 * known.rows)) if few else None

    def of_batch(df: DataFrame) -> DataFrame:
        # a small batch cuts the plan tables down before they are aggregated
        return df.join(F.broadcast(products), "product", "left_semi") if few else df

    parts = (of_batch(t.item_master.select(F.col("part_name").alias("product")).where("product IS NOT NULL"))
             .groupBy("product").agg(F.lit(True).alias("known")))
    planned = (of_batch(t.forecast.where(F.col("demand_date").isNotNull())
                        .select(F.col("component_part").alias("product"), plan_week(F.col("demand_date")).alias("week")))
               # one bit for each planned week of any year
               .groupBy("product").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("week"))).alias("weeks")))
    vendors = (t.suppliers.where(F.col("vendor_id").isNotNull()).groupBy("vendor_id")
               .agg(F.count(F.lit(1)).alias("vendors"), F.first("vendor_name").alias("vendor_name")))
    checked = lookup_join(asked, parts, ["product"], "left", per_product, left_spread=order)
    checked = lookup_join(checked, planned, ["product"], "left", per_product, left_spread=order)
    checked = checked.withColumn("planned", F.coalesce(F.call_function("getbit", F.col("weeks"), F.col("request_week")) == 1, F.lit(False)))
    checked = lookup_join(checked, vendors, ["vendor_id"], "left", left_spread=order)
    sole_vendor = F.coalesce(F.col("vendors") == 1, F.lit(False))
    open_slot = F.col("known").isNotNull() & ~F.col("planned")
    firsts = (checked.where(open_slot & sole_vendor & F.col("request_week").isNotNull())
              .groupBy("product", "request_week").agg(F.min("ord").alias("first_ord")))
    judged = lookup_join(checked, firsts, ["product", "request_week"], "left", per_week, left_spread=order)
    status = (F.when(F.col("known").isNull(), "INVALID_PRODUCT")
              .when(F.col("planned") | (order > F.col("first_ord")), "PRESENT")
              .when(~sole_vendor, "VENDOR_ERROR")
              .otherwise("ACCEPTED"))
    return judged.withColumn("status", status).drop("known", "weeks", "planned", "vendors", "first_ord")


def apply_adhoc(t: Tables, batch: DataFrame, as_of: date | datetime,
                ids: Callable[[int], int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(forecast, adjustments, status) after a batch of ad-hoc forecast requests.

    The judged batch is kept by the first result that runs and serves the others; `status` is that batch, so
    `status.unpersist()` frees it. Building the results runs nothing on the forecast.

    Batch: ord, product, forecast_date, vendor_id, planner, product_family,
    non_gsa_adjustment, gsa_adjustment, adjustment, adjustment_type, adjustment_comment.
    An accepted request adds an empty forecast row and its quantities as an adjustment.
    """
    judged = adhoc_status(t, batch).persist(StorageLevel.MEMORY_AND_DISK)
    accepted = judged.where("status = 'ACCEPTED'")
    zero = F.lit(0)
    blank = accepted.select(
        F.lit(plan_week_of(as_of)).alias("week_id"), F.col("product").alias("component_part"),
        F.col("forecast_date").alias("demand_date"),
        zero.alias("req_plan_non_gsa"), zero.alias("req_plan_gsa"), zero.alias("req_plan_forecast"),
        zero.alias("req_plan_buffer"), zero.alias("req_plan_buffer_opt_adj"),
        "product_family", F.col("vendor_name").alias("supplier"), F.col("adjustment_comment").alias("remarks"))
    rows = numbered(accepted, "ord", ids or next_id(t.adjustments, "adjustment_id"), "adjustment_id", within=batch).select(
        "adjustment_id", F.col("planner").alias("planner_id"), F.col("vendor_id").cast("string").alias("supplier_id"),
        "product", F.col("non_gsa_adjustment").alias("req_plan_non_gsa_adj"),
        F.col("gsa_adjustment").alias("req_plan_gsa_adj"), F.col("adjustment").alias("adjustment_quantity"),
        "adjustment_type", F.col("adjustment_comment").alias("adjustment_comments"),
        F.col("forecast_date").alias("demand_date"), "planner")
    adjustments = append(t.adjustments, _stamped(rows, F.col("planner"), as_of))
    return append(t.forecast, blank), adjustments, judged
