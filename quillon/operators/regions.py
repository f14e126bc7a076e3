"""Regions of set pixels (R1-R9, R13-R15, R21, A2-A4, A30, D11, E1) and merged boxes (C9): a mask is a table (image, r, c)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.graph import connected_components
from quillon.operators.metrics import EIGHT, FOUR, neighbours
from quillon.operators.spatial import overlap_pairs
from quillon.scratch import Scratch, by_shuffle

_PLACE = ["image", "r", "c"]


def label_regions(mask: DataFrame, diagonal: bool = True) -> DataFrame:
    """(image, r, c, label) with labels from 1 in the order of the regions' first pixels.

    Neighbours meet by an equi-join on shifted places, each pair once. Labels are
    numbered in a window over the regions of an image, not over its pixels.
    """
    half = [(a, b) for a, b in (EIGHT if diagonal else FOUR) if (a, b) > (0, 0)]
    moves = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in half))).alias("m")
    at = F.struct("r", "c")
    ahead = mask.select("image", at.alias("src"), "r", "c", moves).select("image", "src", (F.col("r") + F.col("m.dr")).alias("r"), (F.col("c") + F.col("m.dc")).alias("c"))
    edges = ahead.join(by_shuffle(mask.select(*_PLACE)), _PLACE).select("image", "src", at.alias("dst"))
    roots = connected_components(edges, scope=["image"]).select("image", "id.r", "id.c", "root")
    found = mask.select(*_PLACE).join(roots, _PLACE, "left").select(*_PLACE, F.coalesce("root", at).alias("root"))
    numbers = found.select("image", "root").distinct().withColumn("label", F.row_number().over(Window.partitionBy("image").orderBy("root")).cast("long"))
    return found.join(numbers, ["image", "root"]).select(*_PLACE, "label")


def region_table(labelled: DataFrame) -> DataFrame:
    """Area, centroid and bounding slices of each region; the slices' ends are exclusive."""
    box = [F.min("r").alias("r0"), (F.max("r") + 1).alias("r1"), F.min("c").alias("c0"), (F.max("c") + 1).alias("c1")]
    return labelled.groupBy("image", "label").agg(F.count("*").alias("area"), F.avg("r").alias("cr"), F.avg("c").alias("cc"), *box)


def smooth(mask: DataFrame, sizes: DataFrame) -> DataFrame:
    """Closing and then opening with a cross of five pixels; sizes: (image, rows, cols).

    Nothing grows past an image's border, and places past it never wear a region away.
    """
    inner = F.lit(1) + sum(((c).cast("int") for c in (F.col("r") > 0, F.col("r") < F.col("rows") - 1, F.col("c") > 0, F.col("c") < F.col("cols") - 1)), F.lit(0))

    def step(pixels: DataFrame, erode: bool) -> DataFrame:
        near = neighbours(pixels, [*FOUR, (0, 0)]).join(sizes, "image").where("r >= 0 and c >= 0 and r < rows and c < cols")
        return (near.where(F.col("n") == inner) if erode else near).select(*_PLACE)

    out = mask
    for erode in (False, True, True, False):
        out = step(out, erode)
    return out


def merge_boxes(boxes: DataFrame, keys: list[str], cell: float) -> DataFrame:
    """(*keys, id, x0, y0, x1, y1, n): boxes that share area become their common bounds, until none do.

    ``id`` is the least id of the merged boxes and ``n`` their number. Each round merges
    whole components of the overlap graph; only the question whether one is left reaches the driver.
    """
    scratch, turn = Scratch(boxes.sparkSession, "boxes"), 0
    now = boxes.select(*keys, "id", "x0", "y0", "x1", "y1", F.lit(1).cast("long").alias("n"))
    while True:
        sized = now.withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
        pairs = scratch.write(f"pairs{turn}", overlap_pairs(sized, sized, keys, cell).where("id < r_id").select(*keys, "id", "r_id"))
        if pairs.isEmpty():
            return now
        roots = connected_components(pairs, "id", "r_id", keys)
        joined = now.join(roots, [*keys, "id"], "left").withColumn("id", F.coalesce("root", "id"))
        bounds = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
        now = scratch.write(f"merged{turn}", joined.groupBy(*keys, "id").agg(*bounds, F.sum("n").alias("n")))
        turn += 1


def perimeters(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, perimeter): the weighted length of each region's border pixels.

    A border pixel is one with an unset side neighbour in its region; its weight follows
    from how many border pixels are beside (s) and diagonal to it (d). The weights are
    fixed values of the usual estimate.
    """
    place = [*keys, "r", "c"]
    rows = labelled.select(*place)

    def near(df: DataFrame, steps: list[tuple[int, int]], name: str) -> DataFrame:
        moves = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in steps))).alias("m")
        moved = df.select(*place, moves).select(*keys, (F.col("r") + F.col("m.dr")).alias("r"), (F.col("c") + F.col("m.dc")).alias("c"))
        return moved.groupBy(*place).agg(F.count("*").alias(name))

    border = rows.join(near(rows, FOUR, "n").where("n = 4").select(*place), place, "left_anti")
    diagonal = [m for m in EIGHT if m not in FOUR]
    both = border.join(near(border, FOUR, "s"), place, "left").join(near(border, diagonal, "d"), place, "left")
    s, d = F.coalesce("s", F.lit(0)), F.coalesce("d", F.lit(0))
    weight = F.when(s.isin(2, 3) & (d <= 2), 1.0).when((s == 0) & (d == 2) | (s == 1) & (d == 3), 2**0.5).when((s == 1) & d.isin(1, 2), (1 + 2**0.5) / 2).otherwise(0.0)
    return both.groupBy(*keys).agg(F.sum(weight).alias("perimeter"))


def shapes(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, area, perimeter, circularity, eccentricity) of each region, from sums over its pixels."""
    a, b, c = F.var_pop("r"), F.covar_pop("r", "c"), F.var_pop("c")
    half, root = (a + c) / 2, F.sqrt(4 * b * b + (a - c) * (a - c)) / 2
    ecc = F.when(half + root > 0, F.sqrt(F.greatest(1 - (half - root) / (half + root), F.lit(0.0)))).otherwise(0.0)
    sums = labelled.groupBy(*keys).agg(F.count("*").alias("area"), ecc.alias("eccentricity"))
    joined = sums.join(perimeters(labelled, keys), keys)
    p = F.greatest("perimeter", F.lit(1e-9))
    return joined.withColumn("circularity", 4 * F.pi() * F.col("area") / (p * p))


def hull_areas(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, hull): pixels whose centres lie in the convex hull of the region's pixel sides; solidity is area / hull.

    A region goes to its task as one row a pixel row (its ends), not as its pixels.
    """
    import numpy as np
    import pandas as pd

    kinds = dict(labelled.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "hull long"])

    def chain(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
        out: list[tuple[float, float]] = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        points = set()
        for r, lo, hi in zip(frame["r"], frame["lo"], frame["hi"], strict=True):
            points |= {(r, lo - 0.5), (r, hi + 0.5), *((r + s, c) for s in (-0.5, 0.5) for c in (lo, hi))}
        points = sorted(points)
        low, high = chain(points), chain(points[::-1])[::-1]  # by rows: the sides of greater and of lesser columns
        rows = np.arange(frame["r"].min(), frame["r"].max() + 1)
        ends = [np.interp(rows, [p[0] for p in side], [p[1] for p in side]) for side in (low, high)]
        lo, hi = np.minimum(*ends), np.maximum(*ends)
        n = int((np.floor(hi + 1e-9) - np.ceil(lo - 1e-9) + 1).clip(min=0).sum())
        return pd.DataFrame([[*(frame[k].iloc[0] for k in keys), n]], columns=[*keys, "hull"])

    ends = labelled.groupBy(*keys, "r").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    return ends.groupBy(*keys).applyInPandas(count, schema)


def dissolve(pixels: DataFrame, keys: list[str], group: str) -> DataFrame:
    """A2-A4: (*keys, group, area, perimeter): the union of each group's members, whose pixels may repeat.

    The perimeter counts the union's outer pixel sides.
    """
    place = [*keys, group, "r", "c"]
    union = pixels.select(*place).distinct()
    moves = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in FOUR))).alias("m")
    sides = union.select(*place, moves).select(*keys, group, (F.col("r") + F.col("m.dr")).alias("r"), (F.col("c") + F.col("m.dc")).alias("c"))
    outer = sides.join(union, place, "left_anti").groupBy(*keys, group).agg(F.count("*").alias("perimeter"))
    return union.groupBy(*keys, group).agg(F.count("*").alias("area")).join(outer, [*keys, group])


def drop_by_share(labelled: DataFrame, flagged: DataFrame, share: float) -> DataFrame:
    """The pixels of regions of which at most ``share`` is flagged."""
    marks = flagged.select(*_PLACE, F.lit(1).alias("_f"))
    rate = labelled.join(by_shuffle(marks), _PLACE, "left").groupBy("image", "label").agg(F.avg(F.coalesce("_f", F.lit(0))).alias("rate"))
    return labelled.join(rate.where(F.col("rate") > share), ["image", "label"], "left_anti")


def grow(mask: DataFrame, sizes: DataFrame, steps: int = 1) -> DataFrame:
    """Dilation by a cross of five pixels, inside the image."""
    out = mask.select(*_PLACE)
    for _ in range(steps):
        out = neighbours(out, [*FOUR, (0, 0)]).join(sizes, "image").where("r >= 0 and c >= 0 and r < rows and c < cols").select(*_PLACE)
    return out


def rasterize(boxes: DataFrame, id_col: str, res: float, touched: bool = False) -> DataFrame:
    """(image, r, c, id): pixels whose centre (or, ``touched``, any part) lies in a box; the greatest id wins."""
    lo = lambda c: F.floor(F.col(c) / res) if touched else F.ceil(F.col(c) / res - 0.5)
    hi = lambda c: F.ceil(F.col(c) / res) - 1 if touched else F.ceil(F.col(c) / res - 0.5) - 1
    span = lambda a, b: F.explode(F.when(hi(b) >= lo(a), F.sequence(lo(a), hi(b))).otherwise(F.array().cast("array<bigint>")))
    rows = boxes.select("image", F.col(id_col).alias("id"), span("y0", "y1").alias("r"), "x0", "x1")
    return rows.select("image", "id", "r", span("x0", "x1").alias("c")).groupBy("image", "r", "c").agg(F.max("id").alias("id"))


def patch_starts(sizes: DataFrame, patch: int, step: int) -> DataFrame:
    """(image, pr, pc): starts of a grid of patches; the last partial start is left out, a small side gives 0."""
    start = lambda side: F.explode(F.when(F.col(side) <= patch, F.array(F.lit(0).cast("bigint"))).otherwise(F.sequence(F.lit(0).cast("bigint"), F.col(side) - patch - 1, F.lit(step).cast("bigint"))))
    return sizes.select("image", start("rows").alias("pr"), "cols").select("image", "pr", start("cols").alias("pc"))


def mosaic(patches: DataFrame) -> DataFrame:
    """(image, r, c, prob): the mean of overlapping patches' values, between 0 and 1."""
    mean = F.sum("prob") / F.count("prob")
    return patches.groupBy(*_PLACE).agg(F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0)).alias("prob"))


def place_boxes(sizes: DataFrame, occupied: DataFrame, side: float, n: int, cell: float) -> DataFrame:
    """N boxes an image from a grid of candidates, in a fixed hash order, that meet nothing and each other not.

    A grid of disjoint candidates stands for rejection sampling, so that no candidate can
    be in another's way; occupied: boxes of ``image``. Each occupied box names the candidates
    that it may meet (``cell`` is kept for callers), and the exact overlap decides.
    """
    steps = lambda extent: F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col(extent) / side) - 1))
    grid = sizes.where((F.col("width") >= side) & (F.col("height") >= side)).select("image", steps("width").alias("i"), "height").select("image", "i", steps("height").alias("j"))
    near = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / side) - 1, F.floor(F.col(hi) / side) + 1))  # noqa: E731  one more on each side, for rounding
    meets = lambda lo, hi, k: F.least(F.col(hi), (F.col(k) + 1) * side) > F.greatest(F.col(lo), F.col(k) * side)
    across = occupied.select("image", "x0", "x1", "y0", "y1", near("x0", "x1").alias("i")).where(meets("x0", "x1", "i"))
    taken = across.select("image", "i", "y0", "y1", near("y0", "y1").alias("j")).where(meets("y0", "y1", "j")).select("image", "i", "j").distinct()
    free = grid.select("image", "i", "j").join(by_shuffle(taken), ["image", "i", "j"], "left_anti")
    order = Window.partitionBy("image").orderBy((F.col("i") * 7919 + F.col("j") * 104729) % 10007, "i", "j")
    corners = [(F.col("i") * side).alias("x0"), (F.col("j") * side).alias("y0"), ((F.col("i") + 1) * side).alias("x1"), ((F.col("j") + 1) * side).alias("y1")]
    return free.withColumn("k", F.row_number().over(order)).where(F.col("k") <= n).select("image", "i", "j", *corners, F.lit(side * side).alias("area"), "k")
