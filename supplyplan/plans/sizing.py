"""Measured sizes, so that a side is broadcast only when it is known to be small."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@dataclass(frozen=True)
class Tuning:
    """Limits, read from the session so that a cluster can set its own."""

    broadcast_bytes: int = 64 << 20   # largest side that is broadcast
    hot_rows: int = 5_000_000         # rows of one join key that one task may hold
    window_rows: int = 1_000_000      # rows that one window without partition keys may number

    @classmethod
    def of(cls, spark: SparkSession) -> Tuning:
        def setting(name: str, default: int) -> int:
            return int(spark.conf.get(f"spark.supplyplan.{name}", str(default)))

        return cls(setting("broadcastBytes", cls.broadcast_bytes),
                   setting("hotRows", cls.hot_rows),
                   setting("windowRows", cls.window_rows))


@dataclass(frozen=True)
class Size:
    rows: int
    bytes: int

    def fits(self, tuning: Tuning) -> bool:
        return self.bytes <= tuning.broadcast_bytes


def _row_bytes(df: DataFrame) -> Column:
    """Bytes of a row in a broadcast hash table: a word per field, one for the row, the text."""
    fixed = 8 * (len(df.columns) + 2)
    text = [F.coalesce(F.octet_length(f.name), F.lit(0)) + F.lit(8)
            for f in df.schema.fields if isinstance(f.dataType, StringType)]
    return reduce(lambda a, b: a + b, text, F.lit(fixed)).cast("long")


def measure(**frames: DataFrame) -> dict[str, Size]:
    """Row count and bytes of each frame, in one job that returns one row per frame."""
    rows = [df.select(F.lit(name).alias("name"), _row_bytes(df).alias("b")) for name, df in frames.items()]
    found = (reduce(DataFrame.unionByName, rows).groupBy("name")
             .agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")).collect())
    sizes = {r["name"]: Size(r["n"], r["b"]) for r in found}
    return {name: sizes.get(name, Size(0, 0)) for name in frames}
