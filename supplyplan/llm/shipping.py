"""Arrow functions over partitions, with this package sent to the executors first."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_sent: set[str] = set()


def send_package(spark: SparkSession) -> None:
    """Add the package to the executors' path, once per application; Spark delivers it to later executors too."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    target = os.path.join(tempfile.mkdtemp(), "supplyplan_llm.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE)))
    context.addPyFile(target)
    _sent.add(context.applicationId)


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    """mapInArrow; `function` takes and gives iterators of record batches."""
    send_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def give_back() -> None:
    """Return freed memory to the system, at the end of a task: workers live on, and several of them share an executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
