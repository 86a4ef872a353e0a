"""One rule for missing values: NULL and NaN are missing, infinities aren't."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def is_numeric(df: DataFrame, name: str) -> bool:
    """Numeric columns are those of a number type; booleans are categories."""
    return isinstance(df.schema[name].dataType, T.NumericType)


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN as NULL, as double if it is a number."""
    c = F.col(name)
    if not is_numeric(df, name):
        return c
    c = c.cast("double")
    return F.when(~F.isnan(c), c)


def columns(df: DataFrame, kind: str | None = None) -> list[str]:
    """Column names, of a kind ("numeric" or "categorical") or all."""
    if kind is None:
        return df.columns
    return [c for c in df.columns if is_numeric(df, c) == (kind == "numeric")]
