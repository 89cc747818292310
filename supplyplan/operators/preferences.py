"""Replacing user preferences."""

from __future__ import annotations

from pyspark.sql import DataFrame

from supplyplan.functions.text import normalized
from supplyplan.plans.ledger import append
from supplyplan.plans.skew import lookup_join
from supplyplan.sources.ledgers import StoredLedger


def _users(batch: DataFrame) -> DataFrame:
    return batch.select("user_id").where("user_id IS NOT NULL").distinct()


def _without(preferences: DataFrame, users: DataFrame) -> DataFrame:
    return lookup_join(preferences, users, ["user_id"], "left_anti").select(*preferences.columns)


def replace_preferences(preferences: DataFrame, batch: DataFrame) -> DataFrame:
    """Drop every preference of the users in the batch, then add the batch."""
    return append(_without(preferences, _users(batch)), normalized(batch))


def store_preferences(ledger: StoredLedger, batch: DataFrame) -> int:
    """`replace_preferences` on a stored ledger: only files with preferences of the batch's users are rewritten."""
    users = _users(batch)
    return ledger.change(users, lambda rows: _without(rows, users), normalized(batch))
