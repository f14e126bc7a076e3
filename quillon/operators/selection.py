"""Sampling, splitting and scene selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.scratch import Scratch


def strata(df: DataFrame, value: str, points: list[float]) -> DataFrame:
    """Bin number by percentile edges (upper bin on an edge)."""
    edges = df.agg(*(F.percentile(value, F.lit(p)).alias(f"e{i}") for i, p in enumerate(points)))
    bin_ = F.lit(0)
    for i in range(len(points)):
        bin_ = bin_ + (F.col(value) >= F.col(f"e{i}")).cast("int")
    return df.crossJoin(F.broadcast(edges)).withColumn("bin", bin_).drop(*(f"e{i}" for i in range(len(points))))


def ranked(df: DataFrame, cells: list[str], order: list[Column], name: str = "k") -> DataFrame:
    """``df`` with each row's place (from 1) in its cell, in a total order whose first part is a hash number.

    Rows are numbered inside (cell, hash number) and begin after the cell's smaller hash
    numbers, which are counted before: a cell of any size spreads over its hash numbers.
    """
    first = df.withColumn("_h", order[0])
    counts = first.groupBy(*cells, "_h").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*cells).orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*cells, "_h")]
    joined = first.alias("a").join(counts.withColumn("_before", before).alias("b"), same).select("a.*", "_before")
    place = F.row_number().over(Window.partitionBy(*cells, "_h").orderBy(*order[1:]))
    return joined.withColumn(name, F.col("_before") + place).drop("_h", "_before")


def stratified_take(df: DataFrame, cells: list[str], order: list[Column], n: int) -> DataFrame:
    """N rows, an equal share of each cell; what small cells lack is taken from the fullest cells.

    The quota is found on the counts of the cells, of which there are few.
    """
    counts = df.groupBy(*cells).agg(F.count("*").alias("size"))
    total = Window.partitionBy()
    share = counts.withColumn("base", F.least("size", F.floor(F.lit(n) / F.count("*").over(total))))
    spare = share.withColumn("room", F.col("size") - F.col("base")).withColumn("lack", F.lit(n) - F.sum("base").over(total))
    filled = F.sum("room").over(Window.orderBy(F.desc("size"), *cells).rowsBetween(Window.unboundedPreceding, -1))
    quota = F.col("base") + F.greatest(F.lit(0), F.least("room", F.col("lack") - F.coalesce(filled, F.lit(0))))
    return ranked(df, cells, order).join(F.broadcast(spare.withColumn("quota", quota).select(*cells, "quota")), cells).where("k <= quota").drop("k", "quota")


def split(df: DataFrame, cells: list[str], order: list[Column], train: float, val: float) -> DataFrame:
    """Train, val and test in every stratum by rank in a fixed order, not by a random generator."""
    sizes = df.groupBy(*cells).agg(F.count("*").alias("_size"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cells]
    rows = ranked(df, cells, order, "_k").alias("a").join(F.broadcast(sizes).alias("b"), same).select("a.*", "_size")
    at = (F.col("_k") - F.lit(0.5)) / F.col("_size")
    return rows.withColumn("split", F.when(at <= train, "train").when(at <= train + val, "val").otherwise("test")).drop("_k", "_size")


def folds(df: DataFrame, order: list[Column], cells: list[str], k: int) -> DataFrame:
    """Fold number of each row, balanced in every stratum."""
    return ranked(df, cells, order, "_k").withColumn("fold", F.pmod(F.col("_k") - 1, F.lit(k)).cast("int")).drop("_k")


def rank_key(cloud: Column, days: Column, scene_cloud: Column) -> Column:
    """cloud share * 1e6 + days * 1e3 + the scene's cloud percentage; missing ones count as 1, 9999 and 100."""
    return F.coalesce(cloud, F.lit(1.0)) * 1e6 + F.coalesce(days.cast("double"), F.lit(9999.0)) * 1e3 + F.coalesce(scene_cloud, F.lit(100.0))


def top_scene(scenes: DataFrame, target: str, max_cloud: float) -> DataFrame:
    """Each tile's scene of least rank key (ties: scene, part, price); the cloud limit comes after the choice."""
    days = F.abs(F.datediff("acquired", F.lit(target)))
    key = F.struct(rank_key(F.col("cloud"), days, F.col("scene_cloud")).alias("rank"), "scene", "part", "price", F.coalesce("cloud", F.lit(1.0)).alias("cloud"))
    best = scenes.groupBy("aoi", "strip").agg(F.min(key).alias("b")).select("aoi", "strip", "b.cloud", F.round("b.rank", 6).alias("rank_key"), "b.scene")
    return best.where(F.col("cloud") <= max_cloud)


def greedy_cover(scenes: DataFrame, enough: float, least_gain: int, cells: int) -> DataFrame:
    """Scenes picked until a share of an area's cells is covered, each time the one that adds most.

    Sequential inside an area, whose candidates (one row for each scene) go to one task.
    """
    import pandas as pd

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["cloud", "scene", "part", "first_cell"])
        ranges = [set(range(a, b + 1)) for a, b in zip(frame["first_cell"], frame["last_cell"], strict=True)]
        covered, out, left = set(), [], list(range(len(frame)))
        while left and len(covered) < enough * cells:
            gains = [len(ranges[i] - covered) for i in left]
            best = max(range(len(left)), key=lambda j: gains[j])
            if gains[best] < least_gain:
                break
            i = left.pop(best)
            covered |= ranges[i]
            out.append((frame["aoi"].iloc[i], frame["scene"].iloc[i], len(out) + 1, gains[best]))
        return pd.DataFrame(out, columns=["aoi", "scene", "turn", "gain"]).astype("int64")

    one = scenes.select("aoi", "scene", "part", "cloud", "first_cell", "last_cell").distinct()
    return one.groupBy("aoi").applyInPandas(pick, "aoi long, scene long, turn long, gain long")


def best_cut(df: DataFrame, value: str, positive: Column) -> DataFrame:
    """Midpoint between neighbouring values with the best balanced accuracy (first on ties); one row.

    Values are counted, written in ranges, and summed range by range: only the ranges'
    totals (a row a partition) go through one task.
    """
    scratch = Scratch(df.sparkSession, "cut")
    per = df.groupBy(F.col(value).alias("v")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    rows = scratch.write("ranges", per.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    totals = rows.groupBy("part").agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"), F.min("v").alias("low"))
    w = Window.orderBy("part")
    so_far = lambda c: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(c)
    everything = Window.partitionBy()
    ranges = totals.select("part", so_far("sp").alias("bp"), so_far("sq").alias("bq"), F.lead("low").over(w).alias("after"), F.sum("sp").over(everything).alias("pt"), F.sum("sq").over(everything).alias("qt"))
    own = Window.partitionBy("part").orderBy("v")
    joined = rows.join(F.broadcast(ranges), "part")
    pb, qb = F.col("bp") + F.sum("p").over(own), F.col("bq") + F.sum("q").over(own)
    score = ((F.col("pt") - pb) / F.col("pt") + qb / F.col("qt")) / 2
    cut = joined.select(((F.col("v") + F.coalesce(F.lead("v").over(own), F.col("after"))) / 2).alias("cut"), score.alias("score")).where("cut is not null")
    return cut.select(F.min(F.struct((-F.round("score", 9)).alias("s"), "cut")).alias("b")).select("b.cut", (-F.col("b.s")).alias("score"))
