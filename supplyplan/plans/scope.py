"""What a request may see: items, planners, suppliers and weeks."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyplan.functions.text import clean_department, contains_pattern, null_if_empty
from supplyplan.tables import Tables


class _Every:
    """Every vendor of the vendor table."""

    def __repr__(self) -> str:
        return "EVERY"


EVERY = _Every()

# The planning organization and the planner-code endings of this process.
ORGANIZATION = 128
PLANNER_SUFFIXES = ("CM", "B2B")


@dataclass(frozen=True)
class VarianceFilter:
    """Filters of the variance and comparison reports.

    An empty text stands for None everywhere.

    planners: planner codes; a None element stands for any planner, an empty list for none.
    vendors: vendor ids, or EVERY; an empty list gives no rows.
    product: substring pattern of the part name (% and _ are wildcards).
    family, department: equality. Items without a family or department never pass,
    whether the filter is set or not.
    """

    planners: Sequence[str | None] = ()
    vendors: Sequence[int] | _Every = ()
    product: str | None = None
    family: str | None = None
    department: str | None = None
    organization: int = ORGANIZATION

    def __post_init__(self) -> None:
        object.__setattr__(self, "planners", [p or None for p in self.planners])
        for name in ("product", "family", "department"):
            object.__setattr__(self, name, getattr(self, name) or None)

    @classmethod
    def single(cls, planner: str | None, vendor: int | None, **other) -> VarianceFilter:
        """One planner and one vendor; a missing value matches nothing."""
        return cls(planners=[planner] if planner else [],
                   vendors=[] if vendor is None else [vendor], **other)


@dataclass(frozen=True)
class Scope:
    """A resolved scope.

    items: part_name, part_site, bu, build_type, planner_code - one row per item and
    system item, duplicates included because they multiply quantities.
    suppliers: distinct supplier_key values, or None for no supplier test.
    week, dates: snapshot week and demand-date range (first day, first day after).
    """

    items: DataFrame
    suppliers: DataFrame | None = None
    week: int | None = None
    dates: tuple[date, date] | None = None


def collaborating(organization: int = ORGANIZATION) -> Column:
    """Planner codes that take part: one organization, fixed endings."""
    code = F.col("planner_code")
    ends = code.endswith(PLANNER_SUFFIXES[0]) | code.endswith(PLANNER_SUFFIXES[1])
    return (F.col("organization_id") == organization) & ends


def planner_test(planners: Sequence[str | None]) -> Column:
    code = F.col("planner_code")
    if not planners:
        return F.lit(False)
    if any(p is None for p in planners):
        return code.isNotNull()
    return code.isin(list(planners))


def item_test(f: VarianceFilter) -> Column:
    part, family, dept = F.col("part_name"), null_if_empty(F.col("product_family")), clean_department(F.col("dept"))
    by_part = null_if_empty(part).isNotNull() if f.product is None else contains_pattern(part, f.product)
    by_family = family.isNotNull() if f.family is None else family == f.family
    by_dept = dept.isNotNull() if f.department is None else dept == f.department
    return by_part & by_family & by_dept


def scoped_items(item_master: DataFrame, system_items: DataFrame) -> DataFrame:
    """Items of the master that are system items of the given set, with their planner."""
    items = item_master.select("part_name", *[null_if_empty(F.col(c)).alias(c) for c in ("part_site", "bu", "build_type")])
    planned = system_items.select(F.col("segment1").alias("part_name"), "planner_code")
    return items.join(planned, "part_name")


def filtered_items(t: Tables, f: VarianceFilter) -> DataFrame:
    planned = t.system_items.where(collaborating(f.organization) & planner_test(f.planners))
    return scoped_items(t.item_master.where(item_test(f)), planned)


def owned_items(t: Tables, employee: int, organization: int = ORGANIZATION) -> DataFrame:
    """Items planned under any planner code of one employee."""
    codes = t.planners.where(F.col("employee_id") == employee).select("planner_code")
    planned = t.system_items.where(collaborating(organization)).join(codes, "planner_code", "left_semi")
    return scoped_items(t.item_master, planned)


def planned_items(t: Tables, organization: int = ORGANIZATION) -> DataFrame:
    return scoped_items(t.item_master, t.system_items.where(collaborating(organization)))


def vendor_keys(t: Tables, vendors: Sequence[int] | _Every) -> DataFrame:
    """Names of the given vendors as they are matched with forecast suppliers."""
    known = F.col("vendor_id").isNotNull() if vendors is EVERY else (
        F.col("vendor_id").isin(list(vendors)) if vendors else F.lit(False))
    return (t.suppliers.where(known & F.col("vendor_name").isNotNull())
            .select(F.upper("vendor_name").alias("supplier_key")).distinct())


def resolve(t: Tables, f: VarianceFilter, week: int | None = None,
            dates: tuple[date, date] | None = None) -> Scope:
    return Scope(filtered_items(t, f), vendor_keys(t, f.vendors), week, dates)
