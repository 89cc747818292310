"""The joined plan: forecast, items, latest commits and latest adjustments.

A forecast row meets every current commit and every current adjustment of its key, and
every item row of its product, so the joined plan is a product of groups.

* `plan_rows` is that product itself, for reports that show its rows.
* `plan_totals` never builds it. Sums over a product of groups follow from the sums and
  counts of each group, so every side is aggregated by key first (with map-side combine)
  and one row per key and side is joined. A key with very many rows costs no more than
  its aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyplan.functions.quantities import ADJUSTMENTS, COMMITS, FORECAST, nz
from supplyplan.functions.text import supplier_key
from supplyplan.plans.placement import PIECE, drawn_keys, pieces, placed, range_bounds, range_share
from supplyplan.plans.revisions import KEYS, in_period, latest, revisions, summed, totals
from supplyplan.plans.scope import Scope
from supplyplan.plans.sizing import Size, Tuning, measure
from supplyplan.plans.skew import (
    ROW_ID, hot_keys, lookup_join, with_key_types, with_row_id,
)
from supplyplan.sources.files import stored_once
from supplyplan.tables import Tables

COMMIT_LABELS = ("commit_reason", "commit_comments")
ADJUSTMENT_LABELS = ("adjustment_type", "adjustment_comments")


@dataclass(frozen=True)
class Plan:
    """Inputs of the joined plan, cut down to a scope."""

    forecast: DataFrame
    commits: DataFrame
    adjustments: DataFrame
    items: DataFrame
    sizes: Mapping[str, Size]
    tuning: Tuning
    hot: Mapping[str, dict[int, int]] = field(default_factory=dict)
    kept: frozenset[str] = frozenset()  # logs that are given as their current totals
    bounds: Sequence[str] | None = None  # products at which a large plan is cut into ranges, one for each task
    drawn: DataFrame | None = None  # keys of a share of all rows, where the plan is laid out
    share: float = 1.0

    @property
    def layout(self) -> list[str]:
        """The column by which the sides are laid out, if they are."""
        return [] if self.bounds is None else [PIECE]

    @property
    def small_items(self) -> bool:
        return self.sizes["items"].fits(self.tuning)


def load_plan(t: Tables, scope: Scope, rows: bool = False) -> Plan:
    """Read the plan tables for a scope.

    One small job measures the scope and counts the three plan tables. Small item and
    supplier lists are broadcast into all scans before anything is shuffled. Heavy keys
    are looked for only in a table that has more rows than one task may hold.
    """
    tuning = Tuning.of(t.forecast.sparkSession)
    fc = t.forecast.where(F.col("component_part").isNotNull() & in_period(scope.week, scope.dates))
    period = in_period(scope.week, scope.dates)
    totals_of = {} if rows else {n: df for n, df in (("commits", t.commit_totals), ("adjustments", t.adjustment_totals)) if df is not None}

    def log(name: str, quantities: Mapping[str, str], labels: Sequence[str]) -> DataFrame:
        if name in totals_of:
            return totals_of[name].where(period).select(*KEYS, "creation_date", *labels, "rows", *quantities)
        df = getattr(t, name)
        return revisions(with_row_id(df) if rows else df, quantities, labels, scope.week, scope.dates, [ROW_ID] * rows)

    commits, adjustments = log("commits", COMMITS, COMMIT_LABELS), log("adjustments", ADJUSTMENTS, ADJUSTMENT_LABELS)
    # rows of the plan tables are counted without reading a key column
    to_measure = {"items": scope.items, **{
        n: totals_of.get(n, getattr(t, n)).where(period).select() for n in ("forecast", "commits", "adjustments")}}
    if scope.suppliers is not None:
        to_measure["suppliers"] = scope.suppliers
    sizes = measure(**to_measure)
    large = {n for n in ("forecast", "commits", "adjustments") if sizes[n].rows > tuning.hot_rows}

    if rows:
        fc = with_row_id(fc)
    fc = fc.select(
        F.col("component_part").alias("product"), "week_id", "demand_date",
        supplier_key(F.col("supplier")).alias("supplier_key"),
        *[nz(c).alias(m) for m, c in FORECAST.items()],
        *[c for c in fc.columns if c == ROW_ID])
    if sizes["items"].fits(tuning):
        parts = F.broadcast(scope.items.select(F.col("part_name").alias("product")))
        fc, commits, adjustments = (df.join(parts, "product", "left_semi") for df in (fc, commits, adjustments))
    if scope.suppliers is not None:
        spread = F.col(ROW_ID) if ROW_ID in fc.columns else None
        fc = lookup_join(fc, scope.suppliers, ["supplier_key"], "left_semi", sizes["suppliers"], spread)

    by_name = {"forecast": fc, "commits": commits, "adjustments": adjustments}
    wanted = large - {"forecast"} - totals_of.keys()
    many = sum(sizes[n].rows for n in by_name)
    if many > tuning.window_rows and (rows or not sizes["items"].fits(tuning)):
        if rows:
            fc = by_name["forecast"] = stored_once(fc, "forecast")
        logs = {n: with_key_types(by_name[n], fc, KEYS) for n in ("commits", "adjustments")}
        keys = fc.select(*KEYS)
        if rows and measure(keys=keys)["keys"].fits(tuning):
            # a short forecast names the keys that matter of the logs
            logs = {n: stored_once(df.join(F.broadcast(keys.distinct()), list(KEYS), "left_semi"), n) for n, df in logs.items()}
            return Plan(fc, logs["commits"], logs["adjustments"], scope.items, sizes, tuning)
        n = pieces(tuning, many, int(fc.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        enough = range_share(tuning, many, n)
        share = max(enough, _heavy_share(tuning)) if rows else enough
        drawn = drawn_keys({"forecast": fc, **logs}, KEYS, share)
        drawn = stored_once(drawn, "drawn") if rows else drawn
        bounds = range_bounds(drawn.sample(enough / share, seed=2) if enough < share else drawn, enough, n, tuning)
        if bounds is not None:
            return Plan(fc, *logs.values(), scope.items, sizes, tuning, kept=frozenset(totals_of), bounds=bounds, drawn=drawn, share=share)
    hot = {n: hot_keys(by_name[n], KEYS, tuning) for n in wanted}
    return Plan(fc, commits, adjustments, scope.items, sizes, tuning, hot, frozenset(totals_of))


def _collapsed(df: DataFrame, buckets: Sequence[str], name: str, keep: Sequence[str]) -> DataFrame:
    return df.select(*keep, reduce(add, (F.col(b) for b in buckets)).alias(name))


def plan_totals(plan: Plan, by_supplier: bool = False, labels: Sequence[str] = (), attributes: Sequence[str] = (),
                collapse: bool = False) -> DataFrame:
    """Sums of the joined plan per key and, where asked for, supplier, label and item attributes.

    Columns: the key, supplier_key, the labels (either those of commits or those of
    adjustments), the item attributes, `plan_rows` (rows of the joined plan) and the sum
    of every measure over those rows. With `collapse` the three buckets of each side are
    added up before anything else and only `forecast`, `commit` and `adjustment` remain.
    """
    extra = ["supplier_key"] if by_supplier else []
    forecast, commits, adjustments = plan.forecast, plan.commits, plan.adjustments
    in_f, in_c, in_a = list(FORECAST), list(COMMITS), list(ADJUSTMENTS)
    if collapse:
        forecast = _collapsed(forecast, in_f[:3], "forecast", [*KEYS, *extra])
        commits, adjustments = (
            _collapsed(df, in_x, m, [*KEYS, "creation_date", *names, *["rows"] * (n in plan.kept)])
            for df, in_x, m, names, n in ((commits, in_c, "commit", COMMIT_LABELS, "commits"),
                                          (adjustments, in_a, "adjustment", ADJUSTMENT_LABELS, "adjustments")))
        in_f, in_c, in_a = ["forecast"], ["commit"], ["adjustment"]
    if plan.bounds is not None:
        forecast, commits, adjustments = (placed(df, plan.bounds) for df in (
            forecast, commits, adjustments))
    at = plan.layout
    f = forecast.groupBy(*at, *KEYS, *extra).agg(
        F.count(F.lit(1)).alias("f_rows"), *[F.sum(m).alias(m) for m in in_f])

    def current(name: str, df: DataFrame, measures: list[str], count: str, all_labels: Sequence[str]) -> DataFrame:
        by = [*at, *[x for x in labels if x in all_labels]]
        return summed(df, measures, count, by) if name in plan.kept else totals(
            latest(df, plan.hot.get(name), at), measures, count, by)

    c = current("commits", commits, in_c, "c_rows", COMMIT_LABELS)
    a = current("adjustments", adjustments, in_a, "a_rows", ADJUSTMENT_LABELS)
    # equal item rows of a product are counted, not repeated
    items = plan.items.select(F.col("part_name").alias("product"), *attributes)
    items = items if plan.bounds is None or plan.small_items else placed(items, plan.bounds)
    laid = [x for x in at if x in items.columns]
    items = items.groupBy(*laid, "product", *attributes).agg(F.count(F.lit(1)).alias("i_rows"))
    joined = (f.join(c, [*at, *KEYS], "left").join(a, [*at, *KEYS], "left")
              .join(F.broadcast(items) if plan.small_items else items, [*laid, "product"]))
    # a side without a match still contributes one (empty) row to the product of groups
    n_f, n_i = F.col("f_rows"), F.col("i_rows")
    n_c, n_a = F.coalesce("c_rows", F.lit(1)), F.coalesce("a_rows", F.lit(1))
    times = {"f_times": n_c * n_a * n_i, "c_times": n_f * n_a * n_i, "a_times": n_f * n_c * n_i}
    counted = joined.withColumns(times | {"plan_rows": n_f * n_c * n_a * n_i})

    def repeated(m: str, count: str) -> Column:
        # most groups have one row, and a product of wide decimals is dear
        return F.when(F.col(count) == 1, nz(m)).otherwise(nz(m) * F.col(count)).alias(m)

    return counted.select(
        *at, *KEYS, *extra, *labels, *attributes, "plan_rows", *[repeated(m, "f_times") for m in in_f],
        *[repeated(m, "c_times") for m in in_c], *[repeated(m, "a_times") for m in in_a])


def sum_measures(df: DataFrame, by: Sequence[str]) -> DataFrame:
    measures = [c for c in df.columns if c in {"plan_rows", *FORECAST, *COMMITS, *ADJUSTMENTS}]
    return df.groupBy(*by).agg(*[F.sum(m).alias(m) for m in measures])


def plan_rows(plan: Plan, attributes: Sequence[str] = ()) -> DataFrame:
    """Every row of the joined plan with the given item attributes.

    The rows of a key are a product of three groups. Where that exceeds what one task may hold, the key is dealt out
    on a grid: its forecast rows, commits and adjustments into pieces each, and every triple of pieces is one cell.
    """
    keys, cell = list(KEYS), ["_i", "_j", "_k"]
    heavy = _heavy_products(plan)
    if heavy is None and plan.bounds is not None:
        return _rows_in_place(plan, attributes)
    logs = {n: latest(getattr(plan, n), plan.hot.get(n)) for n in ("commits", "adjustments")}
    if heavy is None:
        # a log is worth measuring where it is short or cut down to few items
        sides = {n: getattr(plan, n) for n in logs if plan.small_items or plan.sizes[n].rows <= plan.tuning.hot_rows}
        small = {n for n, size in measure(**sides).items() if size.fits(plan.tuning)} if sides else set()
        rows = plan.forecast
        for name, current in logs.items():
            current = with_key_types(current.drop(ROW_ID), rows, keys)
            rows = rows.join(F.broadcast(current) if name in small else current, keys, "left")
    else:
        rows = _in_cells(plan.forecast, heavy, 0, keep=(ROW_ID, "_commits", "_adjustments"))
        for side, (name, current) in enumerate(logs.items(), 1):
            met = f"_met_{name}"
            dealt = _in_cells(with_key_types(current, plan.forecast, keys), heavy, side).withColumn(met, F.lit(True))
            # where a key has rows on a side, a cell without any adds nothing
            rows = rows.join(dealt, [*keys, *cell], "left").where(F.col(met).isNotNull() | ~F.col(f"_{name}")).drop(met)
        rows = rows.drop(*cell, "_commits", "_adjustments")
    items = plan.items.select(F.col("part_name").alias("product"), *attributes)
    if plan.small_items:
        rows = rows.join(F.broadcast(items), "product")
    else:
        rows = lookup_join(rows, items, ["product"], "inner", plan.sizes["items"], F.col(ROW_ID))
    return rows.drop(ROW_ID)


def _rows_in_place(plan: Plan, attributes: Sequence[str]) -> DataFrame:
    """`plan_rows` of sides that are laid out by ranges of products; the rows keep `PIECE`."""
    rows = placed(plan.forecast.drop(ROW_ID), plan.bounds)
    for log in (plan.commits, plan.adjustments):
        rows = rows.join(latest(placed(log.drop(ROW_ID), plan.bounds), also=[PIECE]), [PIECE, *KEYS], "left")
    items = plan.items.select(F.col("part_name").alias("product"), *attributes)
    if plan.small_items:
        return rows.join(F.broadcast(items), "product")
    return rows.join(placed(items, plan.bounds), [PIECE, "product"])


#: keys that are dealt out at most
_HEAVY = 1000
#: a key is looked into where the rows drawn of it make it out to have this share of a task's rows
_DOUBT = 0.1


def _heavy_share(tuning: Tuning) -> float:
    return min(1.0, 16 / max(1.0, tuning.hot_rows ** (1 / 3)))


def _doubtful(plan: Plan) -> Plan | None:
    """The plan cut down to keys whose product of groups may be too large for a task.

    A product above n rows has a side of more than the cube root of n. Rows are drawn so that such a side shows some 16
    of them; a side with none drawn counts as one row. Only those keys are then counted in full; None if there are none.
    """
    if plan.bounds is None or plan.share == 1:
        return plan
    n, names = plan.tuning.hot_rows, ("forecast", "commits", "adjustments")
    made = F.lit(1.0)
    for name in names:
        made = made * F.greatest(F.lit(1.0), F.sum((F.col("side") == name).cast("int")) / plan.share)
    keys = plan.drawn.groupBy(*KEYS).agg(made.alias("made")).where(F.col("made") > _DOUBT * n).orderBy(F.desc("made")).limit(8 * _HEAVY)
    found = keys.select(*KEYS).collect()  # the largest only
    kept = F.broadcast(plan.forecast.sparkSession.createDataFrame(found, plan.forecast.select(*KEYS).schema))
    return replace(plan, **{name: with_key_types(getattr(plan, name), plan.forecast, KEYS).join(kept, list(KEYS), "left_semi")
                            for name in names}) if found else None


def _heavy_products(plan: Plan) -> DataFrame | None:
    """The keys whose product of groups is too large for a task, with the pieces of each side; None if there are none.

    Rows are counted per key and side with map-side combine. The answer is bounded: it names the largest products only,
    and each other key makes less than a thousandth of all rows.
    """
    plan = _doubtful(plan)
    if plan is None:
        return None

    def current_rows(log: DataFrame, name: str) -> DataFrame:
        dated = log.groupBy(*KEYS, "creation_date").agg(F.count(F.lit(1)).alias("n"))
        return dated.groupBy(*KEYS).agg(F.max(F.struct("creation_date", "n"))["n"].alias(name))

    counts = (plan.forecast.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("f"))
              .join(with_key_types(current_rows(plan.commits, "c"), plan.forecast, KEYS), list(KEYS), "left")
              .join(with_key_types(current_rows(plan.adjustments, "a"), plan.forecast, KEYS), list(KEYS), "left"))
    made = F.col("f").cast("double") * F.coalesce("c", F.lit(1)) * F.coalesce("a", F.lit(1))
    top = counts.withColumn("_made", made).where(F.col("_made") > plan.tuning.hot_rows).orderBy(
        F.desc("_made")).limit(_HEAVY).collect()
    if not top:
        return None
    rows = []
    for r in top:
        left, pieces = -(-r["_made"] // plan.tuning.hot_rows), []
        for n in (r["f"], r["c"] or 1, r["a"] or 1):
            pieces.append(int(min(n, left)))
            left = -(-left // pieces[-1])
        rows.append((*[r[k] for k in KEYS], pieces, r["c"] is not None, r["a"] is not None))
    schema = ", ".join(f"{k} {plan.forecast.schema[k].dataType.simpleString()}" for k in KEYS)
    return plan.forecast.sparkSession.createDataFrame(rows, f"{schema}, _pieces array<int>, _commits boolean, _adjustments boolean")


def _in_cells(df: DataFrame, heavy: DataFrame, side: int, keep: Sequence[str] = ()) -> DataFrame:
    """Rows with their cells `_i`, `_j`, `_k`: one piece of the row's own side, all pieces of the other sides."""
    marked = df.join(F.broadcast(heavy), list(KEYS), "left")  # at most a thousand rows
    pieces = F.coalesce("_pieces", F.array(F.lit(1), F.lit(1), F.lit(1)))
    dealt = marked.withColumn("_pieces", pieces).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_commits", "_adjustments")})
    for axis, name in enumerate(("_i", "_j", "_k")):
        n = F.col("_pieces")[axis]
        own = F.pmod(F.xxhash64(ROW_ID), n).cast("int")
        dealt = dealt.withColumn(name, own if axis == side else F.explode(F.sequence(F.lit(0), n - 1)))
    extra = {"_pieces", "_commits", "_adjustments", ROW_ID} - set(keep)
    return dealt.drop(*extra)
