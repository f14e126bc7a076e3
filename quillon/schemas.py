"""Schema checks at the edge of the engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def assert_schema(df: DataFrame, required: list[str]) -> DataFrame:
    """The table itself, or an error that names the columns it lacks."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def optional_col(df: DataFrame, name: str, kind: str) -> Column:
    """A column, or a typed null where the table has none of that name."""
    return F.col(name) if name in df.columns else F.lit(None).cast(kind).alias(name)
