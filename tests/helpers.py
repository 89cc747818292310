"""Comparing results without regard to row order."""

from __future__ import annotations

import datetime
from collections import Counter
from decimal import Decimal


def _plain(value):
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else value
    return value


def bag(rows, columns):
    """Multiset of rows with the columns in name order; rows are mappings."""
    order = sorted(columns)
    return Counter(tuple(_plain(r[c]) for c in order) for r in rows)


def frame_bag(df):
    return bag((r.asDict() for r in df.collect()), df.columns)


def duck_bag(con, sql):
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    return bag((dict(zip(columns, r)) for r in cursor.fetchall()), columns), sorted(columns)


def same(a, b):
    """True if two frames hold the same rows under the same column names."""
    return sorted(a.columns) == sorted(b.columns) and frame_bag(a) == frame_bag(b)
