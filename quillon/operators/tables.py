"""Projections, fills, lookups and set operations over plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reorder(df: DataFrame, front: list[str], last: str | None = None) -> DataFrame:
    """The columns in ``front`` that exist, then the others, then ``last``."""
    head = [c for c in front if c in df.columns and c != last]
    rest = [c for c in df.columns if c not in head and c != last]
    return df.select(*head, *rest, *([last] if last in df.columns else []))


def first_columns(df: DataFrame) -> DataFrame:
    """Of columns with one name, the first."""
    names = [f"_{i}" for i in range(len(df.columns))]
    own, seen = df.toDF(*names), {}
    for n, c in zip(names, df.columns, strict=True):
        seen.setdefault(c, n)
    return own.select(*(F.col(n).alias(c) for c, n in seen.items()))


def fill_default(value: Column, default: Column) -> Column:
    """The value, or the default where it is missing."""
    return F.coalesce(value, default)


def median_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values become the column's median."""
    medians = df.agg(*(F.percentile(c, F.lit(0.5)).alias(f"_m_{c}") for c in columns))
    joined = df.crossJoin(F.broadcast(medians))
    return joined.select(*(F.coalesce(c, f"_m_{c}").alias(c) if c in columns else F.col(c) for c in df.columns))


def add_group_fields(df: DataFrame, own: str = "seep_id", discard_class: bool = False) -> DataFrame:
    """Group ids seeded with the own id and flags with 0 where missing; classes emptied on request."""
    group = F.col("seep_group_id") if "seep_group_id" in df.columns else F.lit(None)
    flag = F.col("is_pregrouped") if "is_pregrouped" in df.columns else F.lit(None)
    out = df.withColumn("seep_group_id", F.coalesce(group.cast("long"), F.col(own))).withColumn("is_pregrouped", F.coalesce(flag.cast("int"), F.lit(0)))
    return out.withColumn("class", F.when(F.col("class").isNotNull(), F.lit(""))) if discard_class and "class" in df.columns else out


def new_ids(df: DataFrame, known: DataFrame, name: str, width: int = 23) -> DataFrame:
    """Rows whose id's first characters no known id begins with."""
    seen = known.select(F.substring(name, 1, width).alias("_p")).distinct()
    return df.join(seen, F.substring(df[name], 1, width) == F.col("_p"), "left_anti")


def lookup(df: DataFrame, table: DataFrame, keys: list[str], value: str, default: Column) -> DataFrame:
    """A looked-up value by a compound key, with a default; the table has one row a key."""
    return df.join(table.select(*keys, F.col(value).alias("_v")), keys, "left").withColumn(value, F.coalesce("_v", default)).drop("_v")


def update_by(df: DataFrame, newer: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Columns take the newer table's value where it has one."""
    fresh = newer.select(key, *(F.col(c).alias(f"_n_{c}") for c in columns))
    joined = df.join(fresh, key, "left")
    return joined.select(*(F.coalesce(f"_n_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns))


def remap_index(indices: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """(idx, name, new_idx) of positions in one folder found by name in another; null where it is not there."""
    named = indices.join(source, "idx")
    return named.join(target.withColumnRenamed("idx", "new_idx"), "name", "left").select("idx", "name", "new_idx")


def in_all(df: DataFrame, member: str, keys: list[str], n: int) -> DataFrame:
    """The keys that all of ``n`` members have."""
    return df.groupBy(*keys).agg(F.count_distinct(member).alias("_n")).where(F.col("_n") == n).select(*keys)
