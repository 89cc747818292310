"""Large plans laid out by ranges of products.

The sides of a plan meet by product, and reports are sorted by product first. Where every side is dealt into the same
ranges of products, one shuffle per side serves the newest revisions, the sums, the joins and the order of the report.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyplan.plans.sizing import Tuning

PIECE = "_piece"
#: rows drawn for each range
_DRAWN = 40


def pieces(tuning: Tuning, rows: int, least: int) -> int:
    """Ranges that hold at most about half of what one window may."""
    return max(least, -(-2 * rows // tuning.window_rows))


def drawn_keys(sides: Mapping[str, DataFrame], keys: Sequence[str], share: float) -> DataFrame:
    """A share of the rows of all sides: the keys, and the name of the side. It steers placement only."""
    named = [df.select(*keys, F.lit(name).alias("side")) for name, df in sides.items()]
    return reduce(DataFrame.unionByName, named).sample(share, seed=1)


def range_share(tuning: Tuning, rows: int, n: int) -> float:
    """The share of `rows` rows that shows where `n` ranges begin."""
    return min(1.0, _DRAWN * n / max(1, rows))


def range_bounds(drawn: DataFrame, share: float, n: int, tuning: Tuning) -> list[str] | None:
    """First products of all ranges but the first, from drawn rows; None where a product is too large for a task."""
    counts = {r["product"]: r["count"] for r in drawn.groupBy("product").count().collect()}
    if counts and max(counts.values()) > max(3, tuning.hot_rows * share):
        return None
    total, seen, bounds = sum(counts.values()), 0, []
    for product in sorted(counts, key=str.encode):
        if seen and seen >= (len(bounds) + 1) * total / n:
            bounds.append(product)
        seen += counts[product]
    return bounds


def piece_of(product: Column, bounds: Sequence[str]) -> Column:
    """Number of bounds that aren't above a product, by bisection."""
    if not bounds:
        return F.lit(0)
    firsts = F.array(*[F.lit(b) for b in bounds])
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(
        (at + step <= len(bounds)) & (F.get(firsts, at + step - 1) <= product), at + step).otherwise(at))


def placed(df: DataFrame, bounds: Sequence[str]) -> DataFrame:
    """Rows with `PIECE`, the ranges of products in the order of the partitions."""
    return df.withColumn(PIECE, piece_of(F.col("product"), bounds)).repartitionById(len(bounds) + 1, F.col(PIECE))
