"""Cloud rules and mosaics of scenes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scene classes that count as cloud (fixed values).
CLOUD_CLASSES = (3, 8, 9, 10)


def is_clear(scl: Column) -> Column:
    """A pixel with data that is no cloud."""
    return (scl > 0) & ~scl.isin(*CLOUD_CLASSES)


def cloud_fraction(scl: Column) -> Column:
    """The share of cloud classes over pixels with data; null where there is none."""
    return F.avg(F.when(scl > 0, scl.isin(*CLOUD_CLASSES).cast("double")))


def nearest_date_mosaic(scenes: DataFrame, place: list[str], target: str, clear: Column) -> DataFrame:
    """(*place, v, filled): the clear value nearest in time, and in gaps the nearest value at all.

    Ties: scene, part, price. Both choices are one partial aggregation.
    """
    days = F.abs(F.datediff("acquired", F.lit(target)))
    rows = scenes.where(F.col("v").isNotNull()).withColumn("_k", F.struct(days.alias("days"), "scene", "part", "price")).withColumn("_c", clear)
    best = rows.groupBy(*place).agg(F.min_by("v", F.when(F.col("_c"), F.col("_k"))).alias("base"), F.min_by("v", "_k").alias("fill"))
    return best.select(*place, F.coalesce("base", "fill").alias("v"), F.col("base").isNull().alias("filled"))
