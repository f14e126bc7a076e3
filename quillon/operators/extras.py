"""Smaller rules on rasters, geometries as coordinate arrays, and parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators.spatial import overlap_pairs


def ema(df: DataFrame, by: str, order: str, value: str, decay: float) -> DataFrame:
    """(by, ema): the exponential mean of a key's values in order, started by the first one."""
    steps = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda s: s[value])
    start = F.element_at("_s", 1)
    fold = F.aggregate(F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0))), start, lambda a, x: F.lit(decay) * a + F.lit(1 - decay) * x)
    return df.groupBy(by).agg(steps.alias("_s")).select(by, fold.alias("ema"))


def near_square(n: Column) -> tuple[Column, Column]:
    """(rows, columns) of a grid for n panels."""
    cols = F.ceil(F.sqrt(n)).cast("int")
    return F.ceil(n / cols).cast("int"), cols


def boundary_sides(labelled: DataFrame) -> DataFrame:
    """(image, label, r, c, side): the pixel sides between a region and what is not the region, as a table of edges."""
    place = ["image", "label", "r", "c"]
    moves = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.lit(a).alias("dr"), F.lit(b).alias("dc")) for s, a, b in (("n", -1, 0), ("s", 1, 0), ("w", 0, -1), ("e", 0, 1))))).alias("m")
    own = labelled.select(*place, moves).select(*place, "m.side", (F.col("r") + F.col("m.dr")).alias("nr"), (F.col("c") + F.col("m.dc")).alias("nc"))
    other = labelled.select("image", "label", F.col("r").alias("nr"), F.col("c").alias("nc"))
    return own.join(other, ["image", "label", "nr", "nc"], "left_anti").select(*place, "side")


def usable_rasters(pixels: DataFrame, band: str, nodata: float) -> DataFrame:
    """Pixels of the images whose band is not empty, with nodata as null; nothing is deleted."""
    some = pixels.groupBy("image").agg(F.max(F.when(F.col(band) != nodata, F.abs(F.col(band)))).alias("_m")).where(F.col("_m") > 0)
    return pixels.join(some.select("image"), "image", "left_semi").withColumn(band, F.when(F.col(band) != nodata, F.col(band)))


def clamped(p: Column, eps: float = 1e-6) -> Column:
    """A probability kept away from 0 and 1."""
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def interval_columns(names: list[str]) -> tuple[str, str]:
    """The columns of an interval's lower and upper end, by number in names such as hdi_3% and hdi_97%."""
    found = sorted((float(m[1]), n) for n in names if (m := re.fullmatch(r"(?:hdi|eti)_([0-9.]+)%", n)))
    if len(found) < 2:
        raise ValueError("no interval columns")
    return found[0][1], found[-1][1]


def polygon_parts(df: DataFrame, geometry: str) -> DataFrame:
    """One row a polygon of array<polygon: array<ring: array<point>>>: outer ring alone, and its vertices."""
    one = df.select("*", F.posexplode(geometry).alias("part", "_rings")).drop(geometry)
    return one.withColumn("n_rings", F.size("_rings")).withColumn("ring", F.col("_rings")[0]).withColumn("n_vertices", F.size("ring")).drop("_rings")


def box_or(geometry: Column, box: Column) -> Column:
    """The box where a geometry could not be read."""
    return F.coalesce(geometry, box)


def same_srid(*frames: DataFrame) -> list[DataFrame]:
    """The tables, if all their rows have one reference system; nothing is reprojected."""
    found = {r.srid for f in frames for r in f.select("srid").distinct().limit(2).collect()}
    if len(found) > 1:
        raise ValueError(f"different reference systems: {sorted(map(str, found))}")
    return list(frames)


def in_bounds(objects: DataFrame, images: DataFrame, cell: float) -> DataFrame:
    """Objects whose bounds meet an image's, in one reference system (column ``srid``)."""
    return overlap_pairs(objects, images, ["srid"], cell)


@dataclass(frozen=True)
class ChipParameters:
    """Sizes of chips as shares of their side, with defaults."""

    side: float
    pad: float = 0.1
    least: float = 0.25

    @property
    def padded(self) -> float:
        return self.side * (1 + 2 * self.pad)


def search_space(spark, choices: dict[str, list], log_ranges: dict[str, tuple[float, float, int]]) -> DataFrame:
    """A table of all combinations of choices and of log-spaced steps; a few rows, made on the driver."""
    import itertools

    names = [*choices, *log_ranges]
    steps = [[lo * (hi / lo) ** (i / (n - 1)) for i in range(n)] for lo, hi, n in log_ranges.values()]
    return spark.createDataFrame(list(itertools.product(*choices.values(), *steps)), names)
