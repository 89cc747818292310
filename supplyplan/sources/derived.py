"""Plan tables derived from the order-and-parts test tables.

Every derived table takes in every row of the table it comes from. Awkward cases are
planted by value: parts on two sites, two organizations, tied and missing revision
dates, revisions a week off their forecast, missing families, departments, demand dates
and quantities, line breaks in departments, dotted supplier names, unknown ids.
FIXTURES.md part B gives the same tables in SQL.
"""

from __future__ import annotations

import os
from datetime import datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from supplyplan.functions.calendar import plan_week
from supplyplan.tables import Tables

AS_OF = datetime(1998, 1, 24)

PLAN_TABLES = ("forecast", "commits", "adjustments", "item_master", "system_items", "planners", "suppliers")


def _text(c: Column) -> Column:
    return c.cast("string")


def _null(type_: str = "string") -> Column:
    return F.lit(None).cast(type_)


def _part_name(key: Column) -> Column:
    prefix = F.when(key % 3 == 0, "33210-").when(key % 3 == 1, "3350-").otherwise("3490-")
    return F.concat(prefix, _text(key))


def _monday(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "week")


def _each(*values: int) -> Column:
    return F.explode(F.array(*[F.lit(v) for v in values]))


def _big(c: Column) -> Column:
    return c.cast("bigint")


class DerivedTables:
    """The derived tables over one test-data folder, built on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder
        self._sources: dict[str, DataFrame] = {}

    def _source(self, name: str) -> DataFrame:
        if name not in self._sources:
            self._sources[name] = self._spark.read.parquet(os.path.join(self._folder, f"{name}.parquet"))
        return self._sources[name]

    def tables(self, *names: str) -> Tables:
        """The named tables; those of the joined plan if none is named."""
        return Tables(**{n: getattr(self, n) for n in names or PLAN_TABLES})

    @cached_property
    def suppliers(self) -> DataFrame:
        return self._source("supplier").select(F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("vendor_name"))

    @cached_property
    def item_master(self) -> DataFrame:
        key, size = F.col("p_partkey"), F.col("p_size")
        dept = F.concat(F.lit("DEPT"), _text(size % 5))
        sites = F.when(key % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
        return self._source("part").withColumn("site", F.explode(sites)).select(
            key.alias("item_id"), _part_name(key).alias("part_name"),
            F.concat(F.lit("SITE"), _text(F.col("site"))).alias("part_site"),
            F.when(key % 17 != 0, F.col("p_brand")).alias("product_family"), F.col("p_type").alias("build_type"),
            F.concat(F.lit("BU"), _text(size % 3)).alias("bu"),
            F.when(key % 19 == 0, _null()).when(key % 23 == 0, "\r\n")
            .when(key % 5 == 0, F.concat(dept, F.lit("\r\n"))).otherwise(dept).alias("dept"))

    @cached_property
    def system_items(self) -> DataFrame:
        item = F.col("item_id")
        ending = F.when(item % 4 == 1, "B2B").when(item % 4 == 3, "XX").otherwise("CM")
        return (self.item_master.select("item_id", F.col("part_name").alias("segment1")).distinct()
                .withColumn("organization_id", _each(128, 204))
                .select("segment1", "organization_id",
                        F.concat(F.lit("PL"), _text(item % 10), ending).alias("planner_code")))

    @cached_property
    def planners(self) -> DataFrame:
        code = F.col("planner_code")
        return self.system_items.select("planner_code", "organization_id").distinct().select(
            code, F.concat(F.lit("Planner "), code).alias("description"), "organization_id",
            _big(F.substring(code, 3, 1).cast("int") + 1000).alias("employee_id"))

    @cached_property
    def _lines(self) -> DataFrame:
        order = F.col("l_orderkey")
        return self._source("lineitem").select(
            "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus",
            _big(F.col("l_quantity")).alias("qty"), _part_name(F.col("l_partkey")).alias("product"),
            (F.col("l_linenumber") % 3 + 3).cast("int").alias("week_id"),
            F.when(order % 97 != 0, _monday(F.col("l_shipdate"))).alias("demand_date"))

    @cached_property
    def forecast(self) -> DataFrame:
        order, qty = F.col("l_orderkey"), F.col("qty")
        name = F.col("vendor_name")
        return self._lines.join(self.suppliers, F.col("l_suppkey") == F.col("vendor_id")).select(
            "week_id", F.col("product").alias("component_part"), "demand_date", qty.alias("req_plan_non_gsa"),
            F.when(F.col("l_linenumber") != 7, _big(F.col("l_linenumber"))).alias("req_plan_gsa"),
            _big(order % 13).alias("req_plan_forecast"), _big(order % 3).alias("req_plan_buffer"),
            _big(order % 2).alias("req_plan_buffer_opt_adj"), (qty + 5).alias("original_irp_total_original"),
            (qty + 7).alias("final_irp_total_final"),
            F.concat(F.lit("FAM"), _text(F.col("l_partkey") % 5)).alias("product_family"),
            F.when(order % 2 == 0, name).otherwise(F.concat(name, F.lit("."))).alias("supplier"),
            _null().alias("remarks"))

    def _log(self, slip: Column) -> DataFrame:
        """Three revisions of each line, a week later where `slip`; the first and third tie."""
        stamp = F.date_sub("demand_date", F.col("n") % 3).cast("timestamp_ntz")
        return self._lines.withColumn("n", _each(1, 2, 4)).withColumns({
            "stamp": F.when(F.col("l_orderkey") % 11 != 0, stamp),
            "demand_date": F.date_add("demand_date", F.when(slip, 7).otherwise(0)),
            "id": F.col("l_orderkey") * 100 + F.col("l_linenumber") * 10 + F.col("n"),
            "by": _text(F.col("l_suppkey"))})

    @cached_property
    def commits(self) -> DataFrame:
        order = F.col("l_orderkey")
        return self._log(F.col("l_returnflag") == "N").select(
            F.col("id").alias("commit_id"), _null().alias("planner_id"), F.col("by").alias("supplier_id"), "product",
            (F.col("qty") - F.col("n")).alias("non_gsa_commit_qty"), _big(F.col("n")).alias("gsa_commit_qty"),
            _big(order % 7).alias("commit_quantity"), F.concat(F.lit("R"), _text(order % 5)).alias("commit_reason"),
            F.concat(F.lit("c"), _text(order % 2)).alias("commit_comments"), F.col("by").alias("created_by"),
            F.col("stamp").alias("creation_date"), F.col("by").alias("updated_by"),
            F.col("stamp").alias("updation_date"), "week_id", "demand_date")

    @cached_property
    def adjustments(self) -> DataFrame:
        order = F.col("l_orderkey")
        return self._log(F.col("l_linestatus") == "F").select(
            F.col("id").alias("adjustment_id"), _null().alias("planner_id"), F.col("by").alias("supplier_id"),
            "product", (F.col("qty") - F.col("n")).alias("req_plan_non_gsa_adj"),
            _big(F.col("n")).alias("req_plan_gsa_adj"), _big(order % 7).alias("adjustment_quantity"),
            F.concat(F.lit("T"), _text(order % 5)).alias("adjustment_type"),
            F.concat(F.lit("a"), _text(order % 2)).alias("adjustment_comments"), F.col("by").alias("created_by"),
            F.col("stamp").alias("creation_date"), F.col("by").alias("updated_by"),
            F.col("stamp").alias("updation_date"), "week_id", "demand_date")

    @cached_property
    def revision_batch(self) -> DataFrame:
        """One edited row per order; the same columns serve adjustments and commits."""
        order = F.col("o_orderkey")
        non_gsa, gsa, fc = _big(order % 50), _big(order % 4), _big(order % 13)
        return self._source("orders").select(
            order.alias("ord"), _part_name(F.col("o_custkey")).alias("product"),
            _monday(F.col("o_orderdate")).alias("monday"),
            non_gsa.alias("non_gsa_adjustment"), gsa.alias("gsa_adjustment"), fc.alias("adjustment"),
            non_gsa.alias("non_gsa_commit"), gsa.alias("gsa_commit"), fc.alias("commit"),
            F.concat(F.lit("T"), _text(order % 5)).alias("adjustment_type"),
            F.concat(F.lit("note"), _text(order)).alias("adjustment_comment"))

    @cached_property
    def tasks(self) -> DataFrame:
        event, user = F.col("event_id"), F.col("user_id")
        return self._source("events").select(
            event.alias("task_request_id"), event.alias("task_approval_id"),
            F.concat(F.lit("PL"), _text(user % 10)).alias("planner"),
            F.concat(F.lit("Planner"), _text(user)).alias("task_from"), _text(user % 10).alias("supplier"),
            F.concat(F.lit("Supplier#"), F.lpad(_text(user % 10), 9, "0")).alias("task_to"),
            F.concat(F.lit("P"), _text(event % 30)).alias("product"),
            _text(F.col("ts").cast("date")).alias("forecast_date"), _text(event % 100).alias("variances"),
            F.when(F.col("event_type") == "error", "Close").when(F.col("event_type") != "signup", F.col("event_type"))
            .alias("task_status"),
            F.lit("subject").alias("task_subject"), F.concat(F.lit("m"), _text(event)).alias("task_message"),
            _text(user).alias("created_by"), F.col("ts").alias("creation_date"),
            _text(user).alias("updated_by"), F.col("ts").alias("updation_date"))

    @cached_property
    def task_actions(self) -> DataFrame:
        """An action per event: creations, updates (several per task, some of unknown or new tasks), others."""
        event, user, kind = F.col("event_id"), F.col("user_id"), F.col("event_type")
        return self._source("events").select(
            event.alias("ord"),
            F.when(event % 3 == 0, "CREATE").when(event % 3 == 1, "UPDATE").otherwise("OTHER").alias("action"),
            F.when(kind == "error", event + 100000000).when(kind == "signup", event * 2)
            .otherwise(event - event % 10).alias("request_id"),
            F.when(user % 3 == 0, "PLNR").when(user % 3 == 1, "CM").otherwise("REQ").alias("login_type"),
            _text(user).alias("login_value"), F.concat(F.lit("PL"), _text(user % 10)).alias("planner"),
            F.concat(F.lit("F"), _text(user)).alias("p_from"), _text(user % 10).alias("supplier"),
            F.when(user % 7 != 0, F.concat(F.lit("T"), _text(user))).alias("p_to"),
            F.concat(F.lit("P"), _text(event % 30)).alias("product"), F.col("ts").cast("date").alias("forecast_date"),
            (event % 100).alias("variance"), F.when(event % 2 == 0, "Close").otherwise("Open").alias("status"),
            F.lit("asked").alias("subject"),
            F.when(event % 29 != 0, F.concat(F.lit("msg"), _text(event))).alias("message"))

    @cached_property
    def requests(self) -> DataFrame:
        order, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp_ntz")
        user = _text(F.col("o_custkey") % 20)
        return self._source("orders").select(
            order.alias("request_id"), user.alias("planner_id"), _null().alias("supplier_id"),
            F.concat(F.lit("Brand#"), _text(order % 25 + 1)).alias("product_family"), F.lit("PL").alias("product_line"),
            F.concat(F.lit("P"), _text(order % 40)).alias("product"), (order % 9).alias("request_quantity"),
            F.col("o_orderpriority").alias("request_type"), F.lit("comment").alias("request_comments"),
            user.alias("created_by"), day.alias("creation_date"), user.alias("updated_by"), day.alias("updation_date"),
            F.when(F.col("o_orderstatus") == "P", "NEW").when(F.col("o_orderstatus") != "O", "In Process")
            .alias("approval_status"),
            _null().alias("approval_workflow_id"), F.concat(F.lit("A"), _text(order % 4)).alias("approver_id"),
            _null("timestamp_ntz").alias("approved_date"), plan_week(day).alias("week_id"))

    @cached_property
    def new_requests(self) -> DataFrame:
        order = F.col("o_orderkey")
        return self._source("orders").select(
            order.alias("ord"), F.when(order % 7 != 1, "Brand#1").alias("product_family"),
            F.when(order % 7 != 2, "PL").alias("product_line"), F.when(order % 11 != 3, "P5").alias("product"),
            F.when(order % 13 != 4, order % 9).alias("request_quantity"), F.col("o_orderpriority").alias("request_type"),
            F.when(order % 17 != 5, "why").alias("request_comments"),
            F.when(order % 19 != 6, F.concat(F.lit("A"), _text(order % 4))).alias("approver"))

    @cached_property
    def remove_requests(self) -> DataFrame:
        return self.requests.select(
            "product_family", "product_line", "product", "request_quantity",
            F.when(F.col("request_id") % 9 != 0, F.col("request_type")).alias("request_type"),
            F.col("creation_date").alias("request_date"), F.col("approver_id").alias("approver"))

    @cached_property
    def approval_results(self) -> DataFrame:
        """Answers for every second request id, beyond the present ids too."""
        order = F.col("o_orderkey")
        return self._source("orders").select(
            (order * 2).alias("request_id"), F.concat(F.lit("WF"), _text(order)).alias("workflow_id"),
            (F.col("o_orderpriority") != "1-URGENT").alias("ok"))

    @cached_property
    def users(self) -> DataFrame:
        cust = F.col("c_custkey")
        return self._source("customer").select(
            F.col("c_name").alias("user_name"), F.when((cust % 4).isin(0, 3), cust % 10 + 1000).alias("employee_id"),
            F.when((cust % 4).isin(1, 3), cust).alias("supplier_id"), F.col("c_mktsegment").alias("description"))

    @cached_property
    def supplier_contacts(self) -> DataFrame:
        cust = F.col("c_custkey")
        steps = F.when(cust % 13 == 0, F.array(F.lit(0), F.lit(1), F.lit(3))).otherwise(
            F.when(cust % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
        return self._source("customer").withColumn("k", F.explode(steps)).select(
            cust.alias("vendor_contact_id"), F.when(cust % 9 != 0, (cust + F.col("k")) % 10).alias("vendor_site_id"))

    @cached_property
    def supplier_sites(self) -> DataFrame:
        supp = F.col("s_suppkey")
        return self._source("supplier").select(
            supp.alias("vendor_site_id"), F.when(supp % 7 != 6, supp - supp % 2).alias("vendor_id"))

    @cached_property
    def preferences(self) -> DataFrame:
        names = F.explode(F.array(F.lit("VIEW"), F.lit("THEME")))
        return self._source("customer").withColumn("preference_name", names).select(
            F.col("c_custkey").alias("user_id"), F.col("c_name").alias("user_name"), "preference_name",
            F.col("c_mktsegment").alias("preference_value"))

    @cached_property
    def preference_batch(self) -> DataFrame:
        """A new preference for every second user id, beyond the present ids too."""
        return self._source("customer").select(
            (F.col("c_custkey") * 2).alias("user_id"), F.col("c_name").alias("user_name"),
            F.lit("VIEW").alias("preference_name"), F.lit("MONTH").alias("preference_value"))

    @cached_property
    def adj_reasons(self) -> DataFrame:
        kinds = self._source("region").select(
            F.concat(F.lit("T"), _text(F.col("r_regionkey") + 1)).alias("ar_value"), F.lit("A").alias("ar_type"))
        reasons = self._source("nation").select(
            F.concat(F.lit("Reason "), _text(F.col("n_nationkey"))).alias("ar_value"), F.lit("R").alias("ar_type"))
        return kinds.unionByName(reasons)

    @cached_property
    def adhoc(self) -> DataFrame:
        """Two ad-hoc requests per part, for the same date; some parts, vendors and dates are unknown."""
        key, n = F.col("p_partkey"), F.col("n")
        return self._source("part").withColumn("n", _each(1, 2)).select(
            (key * 10 + n).alias("ord"),
            F.when(key % 6 == 1, F.concat(F.lit("BAD-"), _text(key))).otherwise(_part_name(key)).alias("product"),
            F.when(key % 31 != 0, F.date_add(F.lit("1998-01-05").cast("date"), (key % 180).cast("int")))
            .alias("forecast_date"),
            F.when((key % 9 == 2) & (n == 1), F.lit(999999)).otherwise(key % 10).cast("bigint").alias("vendor_id"),
            F.concat(F.lit("PL"), _text(key % 10), F.lit("CM")).alias("planner"), F.col("p_brand").alias("product_family"),
            _big(n).alias("non_gsa_adjustment"), _big(F.lit(2)).alias("gsa_adjustment"),
            _big(key % 5).alias("adjustment"), F.concat(F.lit("T"), _text(key % 5)).alias("adjustment_type"),
            F.concat(F.lit("adhoc"), _text(key)).alias("adjustment_comment"))
