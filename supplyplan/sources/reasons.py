"""Seed rows of the reason list."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

from supplyplan.functions.calendar import as_datetime
from supplyplan.sources.schemas import SCHEMAS

# Fixed values (id, value, type): adjustment types A and commit reasons R.
SEED_REASONS = (
    ("T1", "T1", "A"),
    ("T2", "T2", "A"),
    ("T3", "T3", "A"),
    ("T4", "T4", "A"),
    ("T5", "T5", "A"),
    ("Turnkey LLM Shortages", "Component/PCA Shortage", "R"),
    ("ECR/ECN", "ECR/ECN", "R"),
    ("Eceptions/Demand Upside", "Demand Pull in /Big Deal", "R"),
    ("Production Issues", "Assembly Delay/Capacity Issue", "R"),
    ("Testing Failure/Rework/Debug", "Board Failure", "R"),
    ("Quality Issue", "Component/PCA/HLA/Box Quality", "R"),
    ("Machine Calibration", "Tester/Machine Send for Recall", "R"),
    ("MOQ/PPV Approval TAT", "Approval More Than 24 Hours", "R"),
)


def seed_reasons(spark: SparkSession, more: Sequence[tuple[str, str, str]] = (),
                 as_of: date | datetime | None = None) -> DataFrame:
    """The seed list and the deployment's own rows (those that name the company), created at `as_of`."""
    made = None if as_of is None else as_datetime(as_of).replace(microsecond=0)
    rows = [(*r, made) for r in (*SEED_REASONS, *more)]
    return spark.createDataFrame(rows, SCHEMAS["adj_reasons"])
