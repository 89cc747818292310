"""Latest revisions of an append-only log.

A revision is current when its creation date is the greatest of its key (product,
snapshot week, demand date). Ties are all current; revisions without a date are
current only where no revision of the key has one.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from supplyplan.functions.quantities import nz
from supplyplan.functions.text import null_if_empty
from supplyplan.plans.skew import is_hot

KEYS = ("product", "week_id", "demand_date")


def in_period(week: int | None, dates: tuple[date, date] | None) -> Column:
    """Snapshot-week and demand-date tests in a form that reaches the scan."""
    test = F.lit(True)
    if week is not None:
        test = test & (F.col("week_id") == week)
    if dates is not None:
        test = test & (F.col("demand_date") >= F.lit(dates[0])) & (F.col("demand_date") < F.lit(dates[1]))
    return test


def revisions(log: DataFrame, quantities: Mapping[str, str], labels: Sequence[str] = (),
              week: int | None = None, dates: tuple[date, date] | None = None, also: Sequence[str] = ()) -> DataFrame:
    """The columns of a log that the plan reads, and `also` others; a revision without a full key joins nothing."""
    complete = F.col("product").isNotNull() & F.col("week_id").isNotNull() & F.col("demand_date").isNotNull()
    return log.where(complete & in_period(week, dates)).select(
        *KEYS, "creation_date", *[null_if_empty(F.col(c)).alias(c) for c in labels], *[nz(c).alias(m) for m, c in quantities.items()], *also)


def latest(revs: DataFrame, hot: dict[int, int] | None = None, also: Sequence[str] = ()) -> DataFrame:
    """Current revisions. `also` names columns that follow from the key and by which the rows are laid out.

    One shuffle by key, which the left join with the forecast uses again. Heavy keys (at
    most as many as `hot` names) go another way: their greatest date is aggregated with
    map-side combine and joined back by broadcast, so their rows are neither shuffled nor
    gathered.
    """
    newest = F.max("creation_date").over(Window.partitionBy(*also, *KEYS))

    def current(df: DataFrame) -> DataFrame:
        return df.where(F.col("creation_date").eqNullSafe(F.col("_newest"))).drop("_newest", "creation_date")

    if not hot:
        return current(revs.withColumn("_newest", newest))
    heavy = revs.where(is_hot(KEYS, hot))
    stamps = heavy.groupBy(*KEYS).agg(F.max("creation_date").alias("_newest"))
    rest = revs.where(~is_hot(KEYS, hot)).withColumn("_newest", newest)
    return current(rest).unionByName(current(heavy.join(F.broadcast(stamps), list(KEYS))).select(*current(rest).columns))


def totals(current: DataFrame, measures: Iterable[str], count: str, labels: Sequence[str] = ()) -> DataFrame:
    """Number and quantity sums of the current revisions per key (and label)."""
    return current.groupBy(*KEYS, *labels).agg(
        F.count(F.lit(1)).alias(count), *[F.sum(m).alias(m) for m in measures])


def summarized(revs: DataFrame, measures: Iterable[str], labels: Sequence[str]) -> DataFrame:
    """Revisions as one row per key, creation date and label, with their number (`rows`) and sums."""
    return revs.groupBy(*KEYS, "creation_date", *labels).agg(
        F.count(F.lit(1)).alias("rows"), *[F.sum(m).alias(m) for m in measures])


def merged(summaries: Sequence[DataFrame], measures: Iterable[str], labels: Sequence[str], also: Sequence[str] = ()) -> DataFrame:
    """One summary of several, cut down to each key's newest date. `also` as in `latest`.

    What a merge drops can't become current again, so merging is associative: summaries of batches merged in any
    grouping hold what the summary of the whole log holds.
    """
    rows = reduce(DataFrame.unionByName, summaries)
    current = rows.withColumn("_newest", F.max("creation_date").over(Window.partitionBy(*also, *KEYS))).where(
        F.col("creation_date").eqNullSafe(F.col("_newest")))
    return current.groupBy(*also, *KEYS, "creation_date", *labels).agg(*[F.sum(m).alias(m) for m in ("rows", *measures)])


def summed(summary: DataFrame, measures: Iterable[str], count: str, labels: Sequence[str] = ()) -> DataFrame:
    """`totals` of a summary that holds current revisions only."""
    return summary.groupBy(*KEYS, *labels).agg(F.sum("rows").alias(count), *[F.sum(m).alias(m) for m in measures])
