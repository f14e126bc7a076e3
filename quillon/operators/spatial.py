"""Range, nearest and overlap joins on a grid.

Points are bucketed by cell; one side is repeated into the neighbouring cells, so the
join is an equi-join on (keys, cell) with an exact residual. No cross join is planned
and a dense image splits over its cells. Cells are as wide as the reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.scratch import by_shuffle


def dist2(ax, ay, bx, by) -> Column:
    return (F.col(ax) - F.col(bx)) * (F.col(ax) - F.col(bx)) + (F.col(ay) - F.col(by)) * (F.col(ay) - F.col(by))


def range_join(left: DataFrame, right: DataFrame, keys: list[str], radius: float, xy: tuple[str, str] = ("x", "y"), reach: str | None = None) -> DataFrame:
    """Pairs within ``radius`` (inclusive); right columns get the prefix ``r_``.

    ``reach`` names a right column with a radius of its own, at most ``radius`` (J18).
    """
    x, y = xy
    cell = lambda c: F.floor(F.col(c) / F.lit(float(radius))).cast("long")
    a = left.withColumn("_cx", cell(x)).withColumn("_cy", cell(y))
    steps = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    b = b.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    b = b.withColumn("_cx", cell(f"r_{x}") + F.col("_dx")).withColumn("_cy", cell(f"r_{y}") + F.col("_dy")).drop("_dx", "_dy")
    for k in keys:
        b = b.withColumn(k, F.col(f"r_{k}"))
    limit = F.col(f"r_{reach}") if reach else F.lit(float(radius))
    joined = a.join(by_shuffle(b), [*keys, "_cx", "_cy"]).withColumn("d", F.sqrt(dist2(x, y, f"r_{x}", f"r_{y}")))
    return joined.where(F.col("d") <= limit).drop("_cx", "_cy", *(f"r_{k}" for k in keys))


def argbest(df: DataFrame, partition: list[str], order: list[Column]) -> DataFrame:
    """One row of each partition, the first in a total order."""
    rank = F.row_number().over(Window.partitionBy(*partition).orderBy(*order))
    return df.withColumn("_n", rank).where("_n = 1").drop("_n")


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, radius: float, reach: str | None = None) -> DataFrame:
    """(keys, left id, nearest, d) of the nearest right row in reach; ties go to the smaller id."""
    pairs = range_join(left, right, keys, radius, reach=reach)
    best = pairs.groupBy(*keys, left_id).agg(F.min(F.struct("d", F.col(f"r_{right_id}").alias("nearest"))).alias("b"))
    return best.select(*keys, left_id, "b.nearest", "b.d")


def overlap_pairs(a: DataFrame, b: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """Pairs of boxes (x0, y0, x1, y1) that share area; columns of ``b`` get the prefix ``r_``.

    Each pair is made in the one cell that holds the lower corner of its intersection.
    """

    def cells(df: DataFrame, p: str) -> DataFrame:
        span = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(f"{p}{lo}") / cell), F.floor(F.col(f"{p}{hi}") / cell)))
        return df.withColumn("_cx", span("x0", "x1")).withColumn("_cy", span("y0", "y1"))

    right = b.select(*keys, *(F.col(c).alias(f"r_{c}") for c in b.columns if c not in keys))
    j = cells(a, "").join(by_shuffle(cells(right, "r_")), [*keys, "_cx", "_cy"])
    lo_x, lo_y = F.greatest("x0", "r_x0"), F.greatest("y0", "r_y0")
    w, h = F.least("x1", "r_x1") - lo_x, F.least("y1", "r_y1") - lo_y
    one = (F.floor(lo_x / cell) == F.col("_cx")) & (F.floor(lo_y / cell) == F.col("_cy"))
    j = j.where(one & (w > 0) & (h > 0)).withColumn("inter", w * h)
    return j.withColumn("iou", F.col("inter") / (F.col("area") + F.col("r_area") - F.col("inter"))).drop("_cx", "_cy")
