"""Helpers of the operators that turn a ledger and a batch into a new ledger."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from supplyplan.plans.sizing import Tuning


def aligned(rows: DataFrame, ledger: DataFrame) -> DataFrame:
    """Rows in the columns and types of a ledger; columns they lack are NULL."""
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in ledger.schema.fields])


def append(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    return ledger.unionByName(aligned(rows, ledger))


def next_id(ledger: DataFrame, column: str) -> int:
    """One more than the greatest id; reads that column only."""
    return (ledger.agg(F.max(column)).first()[0] or 0) + 1


def numbered(batch: DataFrame, order_by: str, first: int | Callable[[int], int], name: str,
             within: DataFrame | None = None) -> DataFrame:
    """Consecutive ids from `first` in the order of a numeric column, rows without a value first.

    `first` is a number, or a function that reserves as many ids as it is asked for and returns the first.

    The batch is cut at its quantiles into pieces that fit one task (one piece, if it is small); each is numbered by
    its own task and shifted by the sizes of the pieces before it. The cuts are constants of the plan, so repeated
    tasks agree. Rows with equal values are numbered in any order. With a number, only one writer may be at work.

    `within` is a frame with the same column that holds all rows of the batch and is cheaper to read: it is counted and
    cut in place of the batch, of which nothing then runs here, and as many ids are reserved as it has rows.
    """
    source = batch if within is None else within
    rows = source.count()
    first = first(rows) if callable(first) else first
    pieces = -(-rows // Tuning.of(batch.sparkSession).window_rows)
    at = F.col(order_by).cast("double")
    cuts = sorted(set(source.select(at.alias("at")).approxQuantile(
        "at", [i / pieces for i in range(1, pieces)], 0.1 / pieces))) if pieces > 1 else []
    # a row without a value is above no cut, and so in the first piece
    piece = reduce(add, (F.coalesce((at >= c).cast("int"), F.lit(0)) for c in cuts), F.lit(0))
    cut = batch.withColumn("_piece", piece)
    position = F.row_number().over(Window.partitionBy("_piece").orderBy(order_by)) + F.lit(first - 1)
    placed = cut.withColumn(name, position.cast("long"))
    if not cuts:
        return placed.drop("_piece")
    sizes = cut.groupBy("_piece").agg(F.count(F.lit(1)).alias("size"))  # one row per piece
    earlier = Window.orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_piece", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(offsets), "_piece").withColumn(name, F.col(name) + F.col("_before")).drop("_piece", "_before")
