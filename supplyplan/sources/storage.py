"""Reading and writing the tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from supplyplan.sources.schemas import SCHEMAS
from supplyplan.tables import Tables

# Join key of the three plan tables, under each table's own column names.
PLAN_KEYS = {
    "forecast": ("component_part", "week_id", "demand_date"),
    "commits": ("product", "week_id", "demand_date"),
    "adjustments": ("product", "week_id", "demand_date"),
}


def read_tables(spark: SparkSession, root: str, *names: str) -> Tables:
    """Scan `root`/<table> (Parquet) with the declared schemas; all tables unless named.

    The plan tables lie in a folder for each snapshot week, so that a report of one week opens no other.
    """
    return Tables(**{n: spark.read.schema(SCHEMAS[n]).parquet(os.path.join(root, n)).select(*SCHEMAS[n].names)
                     for n in names or SCHEMAS})


def _writer(df: DataFrame, table: str, mode: str):
    writer = df.write.mode(mode)
    return writer.partitionBy("week_id") if table in PLAN_KEYS else writer


def append_rows(df: DataFrame, root: str, table: str) -> None:
    """Add rows to a stored table without reading it."""
    _writer(df, table, "append").parquet(os.path.join(root, table))


def write_version(df: DataFrame, root: str, table: str) -> None:
    """Write a whole new version of a table under a fresh root; an existing one is an error.

    A ledger cannot be overwritten while the plan that makes it still reads it.
    """
    _writer(df, table, "errorifexists").parquet(os.path.join(root, table))


def save_plan_table(df: DataFrame, table: str, name: str, buckets: int, path: str | None = None) -> None:
    """Save a plan table bucketed on its join key, as catalog table `name`.

    With all three tables bucketed alike, ranking revisions and joining them with the
    forecast needs no shuffle. Rows are sorted by snapshot week inside a bucket, so that
    reading one week skips most row groups.
    """
    product, week, day = PLAN_KEYS[table]
    writer = (df.repartition(buckets, product, week, day).write.mode("errorifexists").format("parquet")
              .bucketBy(buckets, product, week, day).sortBy(week, product, day))
    (writer.option("path", path) if path else writer).saveAsTable(name)


def stamp_snapshot(forecast: DataFrame, week: int) -> DataFrame:
    """Give every row of an extract the same snapshot week."""
    return forecast.withColumn("week_id", F.lit(week).cast("int"))
