"""Point clustering inside images (C1-C5, C8); the steps that need components run when a function is called."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.operators.graph import connected_components
from quillon.operators.spatial import argbest, dist2, nearest_join, range_join
from quillon.scratch import Scratch, by_shuffle

KEY = ["image", "bubble_id"]


def anchor_cluster(bubbles: DataFrame, anchor_area: float, radius: float, cap: float | None = None) -> DataFrame:
    """Satellites of at most ``cap`` join the nearest anchor within ``radius``; others keep their own id."""
    able = F.col("area") <= cap if cap is not None else F.lit(True)
    flagged = bubbles.withColumn("is_anchor", F.col("area") >= anchor_area).withColumn("is_satellite_eligible", ~F.col("is_anchor") & able)
    anchors = flagged.where("is_anchor").select("image", "bubble_id", "x", "y")
    near = nearest_join(flagged.where("is_satellite_eligible").select("image", "bubble_id", "x", "y"), anchors, ["image"], "bubble_id", "bubble_id", radius)
    return flagged.join(near.drop("d"), KEY, "left").withColumn("cluster_id", F.coalesce("nearest", "bubble_id")).drop("nearest")


def _components(points: DataFrame, radius: float) -> DataFrame:
    """(image, bubble_id, root) of points with a neighbour within ``radius``."""
    pairs = range_join(points, points, ["image"], radius).where("bubble_id < r_bubble_id")
    return connected_components(pairs, "bubble_id", "r_bubble_id", ["image"]).withColumnRenamed("id", "bubble_id")


def lonely_cluster(clustered: DataFrame, r_in: float, r_halo: float, max_halo: int, strict_singletons: bool = False) -> DataFrame:
    """Groups of unattached points with a sparse halo (fewer than ``max_halo`` others) get their largest member's id.

    A point counts as unattached if its cluster id is its own, even if it is an anchor
    that owns satellites; ``strict_singletons`` leaves such anchors out.
    """
    scratch = Scratch(clustered.sparkSession, "lonely")
    clustered = by_shuffle(scratch.write("clustered", clustered))
    alone = clustered.where("cluster_id = bubble_id")
    if strict_singletons:
        alone = alone.join(clustered.groupBy("image", "cluster_id").count().where("count = 1"), ["image", "cluster_id"], "left_semi")
    points = alone.select("image", "bubble_id", "x", "y", "area")
    member = by_shuffle(scratch.write("member", points.join(_components(points, r_in), KEY)))
    total = F.sum("area")
    weight = F.when(total > 0, total).otherwise(F.lit(1.0))
    biggest = F.max_by("bubble_id", F.struct("area", -F.col("bubble_id"))).alias("new_id")
    center = member.groupBy("image", "root").agg((F.sum(F.col("x") * F.col("area")) / weight).alias("x"), (F.sum(F.col("y") * F.col("area")) / weight).alias("y"), biggest)
    near = range_join(center, clustered.select("image", "bubble_id", "x", "y"), ["image"], r_halo).select("image", "root", F.col("r_bubble_id").alias("bubble_id"))
    others = near.join(member.select("image", "root", "bubble_id"), ["image", "root", "bubble_id"], "left_anti").groupBy("image", "root").agg(F.count("*").alias("halo"))
    good = center.join(others, ["image", "root"], "left").where(F.coalesce("halo", F.lit(0)) < max_halo).select("image", "root", "new_id")
    moved = by_shuffle(scratch.write("moved", member.select("image", "bubble_id", "root").join(good, ["image", "root"]).select("image", "bubble_id", "new_id")))
    scratch.drop("member")
    out = clustered.join(moved, KEY, "left")
    return out.withColumn("lonely_pass", F.col("new_id").isNotNull()).withColumn("cluster_id", F.coalesce("new_id", "cluster_id")).drop("new_id")


def local_max_anchor_cluster(bubbles: DataFrame, nms_radius: float, scale: float) -> DataFrame:
    """Points without a larger neighbour (equal areas: larger id) are anchors; their reach grows with their size."""
    points = bubbles.select("image", "bubble_id", "x", "y", "area")
    bigger = range_join(points, points, ["image"], nms_radius).where("r_area > area or (r_area = area and r_bubble_id > bubble_id)").select("image", "bubble_id").distinct()
    flagged = bubbles.join(bigger.withColumn("_s", F.lit(True)), KEY, "left").withColumn("is_anchor", F.col("_s").isNull()).drop("_s")
    return _attach(Scratch(bubbles.sparkSession, "local_max").write("flagged", flagged), scale, None)


def absolute_anchor_cluster(bubbles: DataFrame, anchor_area: float, scale: float, cap: float) -> DataFrame:
    """C4: anchors by area, reach grows with their size up to half the cap."""
    return _attach(bubbles.withColumn("is_anchor", F.col("area") >= anchor_area), scale, cap / 2)


def _attach(flagged: DataFrame, scale: float, most: float | None) -> DataFrame:
    """The widest reach, one number, sizes the grid."""
    reach = F.lit(float(scale)) * F.sqrt(F.col("area") / F.pi())
    anchors = flagged.where("is_anchor").select("image", "bubble_id", "x", "y", (F.least(reach, F.lit(float(most))) if most is not None else reach).alias("reach"))
    widest = anchors.agg(F.max("reach")).first()[0]
    if not widest:
        return flagged.withColumn("cluster_id", F.col("bubble_id"))
    near = nearest_join(flagged.where("not is_anchor").select("image", "bubble_id", "x", "y"), anchors, ["image"], "bubble_id", "bubble_id", widest, reach="reach")
    return flagged.join(near.drop("d"), KEY, "left").withColumn("cluster_id", F.coalesce("nearest", "bubble_id")).drop("nearest")


def density_merge(clustered: DataFrame, r_density: float, min_dense: int) -> DataFrame:
    """Singletons with ``min_dense`` neighbours merge with such singletons within twice the radius; id = least."""
    clustered = by_shuffle(Scratch(clustered.sparkSession, "density").write("clustered", clustered))
    single = clustered.groupBy("image", "cluster_id").count().where("count = 1")
    alone = by_shuffle(clustered.join(single, ["image", "cluster_id"], "left_semi").select("image", "bubble_id", "x", "y"))
    everyone = clustered.select("image", "bubble_id", "x", "y")
    count = range_join(alone, everyone, ["image"], r_density).where("bubble_id <> r_bubble_id").groupBy(*KEY).agg(F.count("*").alias("n"))
    dense = alone if min_dense <= 0 else alone.join(count.where(F.col("n") >= min_dense).drop("n"), KEY)
    roots = _components(dense, 2 * r_density)
    return clustered.join(roots, KEY, "left").withColumn("cluster_id", F.coalesce("root", "cluster_id")).drop("root")


def consensus_groups(labels: DataFrame, n_labelers: int) -> DataFrame:
    """Items that a majority of labelers put together form one group (image, seep_id, root)."""
    a = labels.select("image", "labeler", "grp", F.col("seep_id").alias("a"))
    b = labels.select("image", "labeler", "grp", F.col("seep_id").alias("b"))
    votes = a.join(b, ["image", "labeler", "grp"]).where("a < b").groupBy("image", "a", "b").agg(F.count_distinct("labeler").alias("votes"))
    roots = connected_components(votes.where(F.col("votes") >= n_labelers // 2 + 1), "a", "b", ["image"])
    return labels.select("image", "seep_id").distinct().join(roots.withColumnRenamed("id", "seep_id"), ["image", "seep_id"], "left").withColumn("root", F.coalesce("root", "seep_id"))


def cluster_features(clustered: DataFrame) -> DataFrame:
    """A1: one row for each (image, cluster) with sizes, the anchor's distance and area-weighted means."""
    if "lonely_pass" not in clustered.columns:
        clustered = clustered.withColumn("lonely_pass", F.lit(False))
    first = argbest(clustered.where("is_anchor"), ["image", "cluster_id"], [F.col("bubble_id")]).select("image", "cluster_id", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("area").alias("anchor_area"))
    rows = clustered.join(first, ["image", "cluster_id"], "left").withColumn("d", F.sqrt(dist2("x", "y", "ax", "ay")))
    total = F.sum("area")
    weighted = lambda c: F.sum(c * F.col("area")) / F.when(total > 0, total).otherwise(F.lit(1.0))
    circularity = 4 * F.pi() * F.col("area") / F.pow(F.greatest("perim", F.lit(1e-9)), 2)
    solidity = F.when(F.col("hull") > 0, F.col("area") / F.col("hull")).otherwise(0.0)
    means = {"cx": F.col("x"), "cy": F.col("y"), "mean_r": F.col("red"), "mean_g": F.col("green"), "mean_b": F.col("blue"), "circularity": circularity, "solidity": solidity, "eccentricity": F.col("eccentricity")}
    return rows.groupBy("image", "cluster_id").agg(
        F.count("*").alias("n_bubbles"), F.bool_or("is_anchor").alias("has_anchor"), F.bool_or("lonely_pass").alias("is_lonely"),
        F.max("anchor_area").alias("anchor_area"), total.alias("total_area"), F.max("area").alias("max_area"), F.avg("area").alias("mean_area"),
        F.coalesce(F.stddev_samp("area"), F.lit(0.0)).alias("std_area"), (F.max("area") / F.avg("area")).alias("max_to_mean"),
        F.coalesce(F.max("d"), F.lit(0.0)).alias("radius"), *(weighted(c).alias(name) for name, c in means.items()),
    )
