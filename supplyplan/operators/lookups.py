"""User roles, search lists, submitted requests and preferences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyplan.functions.text import clean_department, normalized, null_if_empty
from supplyplan.operators.panels import PILOT_VENDORS
from supplyplan.plans.scope import ORGANIZATION, collaborating
from supplyplan.plans.skew import lookup_join
from supplyplan.tables import Tables

# Fixed values of the search lists: part prefixes, label and type of the reason list per role.
SEARCH_LISTS = {
    "PLNR": {"prefixes": ("33210",), "reasons": "ADJ_TYPE", "reason_type": "A"},
    "CM": {"prefixes": ("3350", "3490"), "reasons": "RESN_TYPE", "reason_type": "R"},
}
PRODUCT_LINE = "PL"
LIST_WIDTH = 50


def resolve_user_roles(users: DataFrame, contacts: DataFrame, sites: DataFrame) -> DataFrame:
    """Role and id of every user.

    An employee is a planner. Otherwise a supplier contact is a manufacturer, identified
    by the one vendor its sites lead to, or by the contact id when they lead to none or
    to several (a site without a vendor counts as one more vendor). Others are invalid.
    """
    site_vendors = sites.where(F.col("vendor_site_id").isNotNull()).select("vendor_site_id", "vendor_id").distinct()
    reached = lookup_join(contacts.where(F.col("vendor_contact_id").isNotNull() & F.col("vendor_site_id").isNotNull()),
                          site_vendors, ["vendor_site_id"], "inner")
    vendor = F.col("vendor_id")
    per_contact = reached.groupBy(F.col("vendor_contact_id").alias("supplier_id")).agg(
        F.min(vendor).alias("low"), F.max(vendor).alias("high"),
        F.max(vendor.isNull()).alias("some_null"))
    one_vendor = F.when(F.col("some_null"), F.col("low").isNull()).otherwise(F.col("low") == F.col("high"))
    contact = per_contact.select("supplier_id", F.col("low").alias("only_vendor"), one_vendor.alias("one_vendor"))
    employee, supplier = F.col("employee_id"), F.col("supplier_id")
    return lookup_join(users, contact, ["supplier_id"], "left").select(
        "user_name",
        F.when(employee.isNotNull(), employee)
        .when(supplier.isNotNull() & F.col("one_vendor"), F.col("only_vendor"))
        .otherwise(supplier).alias("user_id"),
        F.when(employee.isNotNull(), "PLNR").when(supplier.isNotNull(), "CM").alias("user_type"),
        "description",
        F.when(employee.isNull() & supplier.isNull(), "Invalid Username").alias("error"))


def search_criteria(t: Tables, role: str, vendors: Sequence[int] = PILOT_VENDORS,
                    organization: int = ORGANIZATION) -> DataFrame:
    """Distinct entries of the seven search lists of a role."""
    if role not in SEARCH_LISTS:
        raise ValueError("Invalid Usertype")
    spec = SEARCH_LISTS[role]

    def entries(df: DataFrame, name: str, key: Column, value: Column) -> DataFrame:
        return df.select(F.lit(name).alias("role"), key.alias("role_id"), value.alias("role_value"))

    nothing = F.lit(None).cast("string")
    part, family, dept = F.col("part_name"), F.col("product_family"), F.col("dept")
    wanted_part = F.lit(False)
    for prefix in spec["prefixes"]:
        wanted_part = wanted_part | part.startswith(prefix)

    # one scan of the item master feeds three lists
    def entry(name: str, keep: Column, value: Column) -> Column:
        return F.when(keep, F.struct(F.lit(name).alias("role"), value.alias("role_id")))

    from_items = (
        normalized(t.item_master.select("part_name", "product_family", "dept")).select(F.explode(F.array_compact(F.array(
            entry("PRODUCT", wanted_part, F.substring(part, 1, LIST_WIDTH)),
            entry("PRODUCT_FAMILY", family.isNotNull(), F.substring(family, 1, LIST_WIDTH)),
            entry("DEPARTMENT", dept.isNotNull(), clean_department(dept))))).alias("e"))
        .select("e.role", "e.role_id", nothing.alias("role_value")))
    lists = [
        entries(normalized(t.suppliers).where(F.col("vendor_id").isin(list(vendors))), "VENDOR",
                F.col("vendor_id").cast("string"), F.col("vendor_name")),
        entries(normalized(t.planners).where(collaborating(organization)), "PLANNER",
                F.col("planner_code"), F.col("description")),
        from_items,
        entries(t.suppliers.sparkSession.range(1), "PRODUCT_LINE", F.lit(PRODUCT_LINE), nothing),
        entries(t.adj_reasons.where(F.col("ar_type") == spec["reason_type"]), spec["reasons"],
                null_if_empty(F.col("ar_value")), null_if_empty(F.col("ar_value"))),
    ]
    out = lists[0]
    for one in lists[1:]:
        out = out.unionByName(one)
    return out.distinct()


def submitted_requests(requests: DataFrame) -> DataFrame:
    """Every request, whoever made it."""
    return requests.select(
        "product_family", "product_line", "product", F.col("creation_date").alias("request_date"),
        "request_quantity", "request_type", "request_comments", F.col("approver_id").alias("approver"))


def user_preferences(preferences: DataFrame, users: Sequence[int] | DataFrame) -> DataFrame:
    """Preferences of the given user ids (a list, or a frame with a user_id column)."""
    columns = ("user_id", "user_name", "preference_name", "preference_value")
    if isinstance(users, DataFrame):
        ids = users.select("user_id").distinct()
        return lookup_join(preferences, ids, ["user_id"], "left_semi").select(*columns)
    wanted = F.col("user_id").isin(list(users)) if users else F.lit(False)
    return preferences.where(wanted).select(*columns)
