"""Text rules: an empty string is the same as NULL, and NULL joins as nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def null_if_empty(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def normalized(df: DataFrame) -> DataFrame:
    """Every empty text of a frame as NULL."""
    return df.withColumns({f.name: null_if_empty(F.col(f.name)) for f in df.schema.fields
                           if isinstance(f.dataType, StringType)})


def supplier_key(supplier: Column) -> Column:
    """Supplier text of a forecast row as it is matched with vendor names."""
    return null_if_empty(F.upper(F.translate(supplier, ".", "")))


def clean_department(department: Column) -> Column:
    """Department without line feeds and carriage returns."""
    return null_if_empty(F.translate(department, "\n\r", ""))


def join_text(*parts: Column | str) -> Column:
    """Concatenation in which a NULL part adds nothing; of nothing at all it is NULL."""
    return null_if_empty(F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts]))


def contains_pattern(column: Column, pattern: str) -> Column:
    """LIKE '%pattern%': % and _ inside stay wildcards, a backslash is an ordinary character."""
    return column.like("%" + pattern.replace("\\", "\\\\") + "%")
