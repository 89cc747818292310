"""Ids that are reserved in blocks, so that writers need not read the log nor wait for each other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from supplyplan.sources.files import create_once, names, read_text


class IdBlocks:
    """Consecutive blocks of ids of one table.

    A block is a file named by its first id that holds the first id after it. The next block begins there, and only one
    writer can create the file of that name; the others try the one after. Ids of a batch that is never stored are lost,
    as with a sequence. Call an object with a number of ids to reserve a block; it returns the first of them.
    """

    def __init__(self, spark: SparkSession, folder: str, first: int | Callable[[], int] = 1):
        self._spark, self._folder, self._first = spark, folder.rstrip("/"), first

    def _next(self) -> int:
        taken = names(self._spark, self._folder)
        if taken:
            return int(read_text(self._spark, f"{self._folder}/{taken[-1]}"))
        return self._first() if callable(self._first) else self._first

    def __call__(self, count: int) -> int:
        while True:
            first = self._next()
            if count <= 0 or create_once(self._spark, f"{self._folder}/{first:020d}", str(first + count)):
                return first
