"""Joins that survive a key holding a large share of all rows.

Heavy keys are found with a mergeable top-k sketch over key hashes: one narrow scan,
no shuffle by key, and a bounded answer. What the sketch says decides only where rows
go, never which rows come out, so its error cannot change a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from supplyplan.plans.sizing import Size, Tuning, measure

_SKETCH_ITEMS = 4096   # finds every key above about 0.03 % of the rows
_SKETCH_GROUPS = 256   # sketches are merged in two steps
_TOP = 1000

ROW_ID = "_row_id"


def with_row_id(df: DataFrame) -> DataFrame:
    """Number the rows of a scanned table.

    The number depends on the file split only, so a repeated task draws it again; use it
    on a scan, before any shuffle.
    """
    return df.withColumn(ROW_ID, F.monotonically_increasing_id())


def key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys)


def hot_keys(df: DataFrame, keys: Sequence[str], tuning: Tuning) -> dict[int, int]:
    """Hash -> estimated rows of the keys with more than `tuning.hot_rows` rows."""
    found = (
        df.select(key_hash(keys).alias("k"))
        .groupBy(F.pmod(F.spark_partition_id(), F.lit(_SKETCH_GROUPS)).alias("g"))
        .agg(F.expr(f"approx_top_k_accumulate(k, {_SKETCH_ITEMS})").alias("s"))
        .groupBy(F.lit(0).alias("all"))  # no rows in, no row out
        .agg(F.expr(f"approx_top_k_estimate(approx_top_k_combine(s, {_SKETCH_ITEMS}), {_TOP})").alias("top"))
        .first()
    )
    return {r["item"]: r["count"] for r in (found["top"] if found else []) if r["count"] > tuning.hot_rows}


def is_hot(keys: Sequence[str], hot: dict[int, int]) -> Column:
    return key_hash(keys).isin(list(hot))


def salts_for(counts: dict[int, int], tuning: Tuning) -> dict[int, int]:
    """Number of pieces per key hash, so that no piece exceeds `tuning.hot_rows`."""
    return {k: -(-n // tuning.hot_rows) for k, n in counts.items() if n > tuning.hot_rows}


def _pieces(keys: Sequence[str], salts: dict[int, int]) -> Column:
    if not salts:
        return F.lit(1)
    table = F.create_map(*[F.lit(x).cast("long") for kv in salts.items() for x in kv])
    return F.when(is_hot(keys, salts), F.element_at(table, key_hash(keys))).otherwise(F.lit(1).cast("long"))


def _every(pieces: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), pieces - 1))


def with_key_types(right: DataFrame, left: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The right side with its keys in the left side's types; a value that doesn't fit them meets nothing."""
    return right.withColumns({k: F.col(k).try_cast(left.schema[k].dataType) for k in keys
                              if left.schema[k].dataType != right.schema[k].dataType})


def skew_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str,
              left_salts: dict[int, int] | None = None, right_salts: dict[int, int] | None = None,
              left_spread: Column | None = None, right_spread: Column | None = None) -> DataFrame:
    """Equi-join in which the rows of heavy keys are dealt out over many tasks.

    A heavy left key is dealt into pieces and its right rows are repeated per piece, and
    the other way round. `left_spread` / `right_spread` say how a row picks its piece and
    must give the same answer when a task is repeated; the default is a hash of the row.
    """
    keys, left_salts, right_salts = list(keys), left_salts or {}, right_salts or {}
    right = with_key_types(right, left, keys)
    if right_salts and how not in ("inner", "left"):
        raise ValueError(f"the right side cannot be dealt out in a {how} join")
    if not left_salts and not right_salts:
        return left.join(right, keys, how)

    def deal(df: DataFrame, spread: Column | None, salts: dict[int, int]) -> Column:
        spread = spread if spread is not None else F.xxhash64(*df.columns)
        return F.pmod(F.xxhash64(spread), _pieces(keys, salts)).cast("long")

    dealt_left = left.withColumn("_i", deal(left, left_spread, left_salts))
    dealt_right = right.withColumn("_j", deal(right, right_spread, right_salts))
    if right_salts:
        dealt_left = (dealt_left.withColumn("_n", _pieces(keys, right_salts))
                      .withColumn("_j", _every(F.col("_n"))))
        if how == "left":
            dealt_right = dealt_right.withColumn("_met", F.lit(True))
    else:
        dealt_left = dealt_left.withColumn("_j", F.lit(0).cast("long"))
    dealt_right = dealt_right.withColumn("_i", _every(_pieces(keys, left_salts)))
    joined = dealt_left.join(dealt_right, [*keys, "_i", "_j"], how)
    if right_salts and how == "left":
        # a key dealt out on the right has right rows, so an empty piece means nothing
        joined = joined.where(F.col("_met").isNotNull() | (F.col("_n") == 1))
    return joined.drop("_i", "_j", "_n", "_met")


def lookup_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str,
                size: Size | None = None, left_spread: Column | None = None) -> DataFrame:
    """Join a table with a lookup: broadcast if measured small, else shuffle with heavy keys dealt out."""
    tuning = Tuning.of(left.sparkSession)
    right = with_key_types(right, left, keys)
    size = size or measure(right=right)["right"]
    if size.fits(tuning):
        return left.join(F.broadcast(right), list(keys), how)
    salts = salts_for(hot_keys(left, keys, tuning), tuning)
    return skew_join(left, right, keys, how, salts, left_spread=left_spread)
