"""Segmentation metrics and raster algebra over a pixel relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The divisors' guards: of summed counts, and of one image.
EPS, IMAGE_EPS = 1e-9, 1e-6


def confusion(pixels: DataFrame, by: list[str], threshold: float = 0.5) -> DataFrame:
    """Tp, fp, fn, tn of each group; partial counts are combined map-side."""
    hit, yes = F.col("prob") >= threshold, F.col("gt") > 0
    return pixels.groupBy(*by).agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"))


def ratios(beta: float = 2.0) -> dict[str, Column]:
    """M1: ratios of the four summed counts."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    e, b = F.lit(EPS), F.lit(beta * beta)
    p, r = tp / (tp + fp + e), tp / (tp + fn + e)
    return {
        "dice": 2 * tp / (2 * tp + fp + fn + e), "iou": tp / (tp + fp + fn + e), "accuracy": (tp + tn) / (tp + fp + fn + tn + e), "sensitivity": r, "specificity": tn / (tn + fp + e),
        "precision_": p, "f1": 2 * p * r / (p + r + e), "f_beta": (1 + b) * p * r / (b * p + r + e),
    }


def image_scores(pixels: DataFrame, beta: float = 2.0, alpha: float = 0.5, gamma: float = 0.5, eps: float = IMAGE_EPS) -> DataFrame:
    """Scores of each image; dice, IoU, F1 and Tversky from the probabilities, the others from counts at 0.5.

    F1 is the soft dice by definition; ``alpha`` and ``gamma`` weigh Tversky's false positives and negatives.
    """
    y, p, e, b = F.col("gt").cast("double"), F.col("prob"), F.lit(eps), F.lit(beta * beta)
    hit, yes = p >= 0.5, F.col("gt") > 0
    sums = pixels.groupBy("image").agg(
        F.sum(y * p).alias("inter"), F.sum(y).alias("y"), F.sum(p).alias("p"), F.sum(p * (1 - y)).alias("sfp"), F.sum((1 - p) * y).alias("sfn"), F.count("*").alias("n"),
        F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"),
    )
    c = F.col
    dice = (2 * c("inter") + e) / (c("y") + c("p") + e)
    prec, rec = (c("tp") + e) / (c("tp") + c("fp") + e), (c("tp") + e) / (c("tp") + c("fn") + e)
    scores = {
        "soft_dice": dice, "dice_loss": 1 - dice, "soft_iou": (c("inter") + e) / (c("y") + c("p") - c("inter") + e), "accuracy": (c("tp") + c("tn")) / c("n"),
        "sensitivity": rec, "specificity": (c("tn") + e) / (c("tn") + c("fp") + e), "f1": dice, "f_beta": (1 + b) * prec * rec / (b * prec + rec + e),
        "tversky": (c("inter") + e) / (c("inter") + alpha * c("sfp") + gamma * c("sfn") + e),
    }
    return sums.select("image", *(v.alias(k) for k, v in scores.items()))


def neighbours(mask: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """(image, r, c, n): how many of a pixel's neighbours are set; an equi-join on shifted places."""
    moves = F.explode(F.array(*(F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in steps))).alias("m")
    shifted = mask.select("image", "r", "c", moves).select("image", (F.col("r") + F.col("m.dr")).alias("r"), (F.col("c") + F.col("m.dc")).alias("c"))
    return shifted.groupBy("image", "r", "c").agg(F.count("*").alias("n"))


EIGHT = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]
FOUR = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def surface(mask: DataFrame) -> DataFrame:
    """Set pixels with at least one unset neighbour, outside counting as unset."""
    full = neighbours(mask, EIGHT).where("n = 8").select("image", "r", "c")
    return mask.select("image", "r", "c").join(full, ["image", "r", "c"], "left_anti")


def surface_dice(truth: DataFrame, predicted: DataFrame, images: DataFrame) -> DataFrame:
    """Share of both surfaces within one pixel of the other; both empty 1, one empty 0."""
    a, b = surface(truth), surface(predicted)
    near = lambda s, other: s.join(neighbours(other, [*FOUR, (0, 0)]).drop("n"), ["image", "r", "c"], "left_semi")
    count = lambda df, name: df.groupBy("image").agg(F.count("*").alias(name))
    out = images
    for df, name in ((a, "na"), (b, "nb"), (near(a, b), "ha"), (near(b, a), "hb")):
        out = out.join(count(df, name), "image", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = zero("na") + zero("nb")
    return out.select("image", F.when(total == 0, 1.0).otherwise((zero("ha") + zero("hb")) / total).alias("nsd"))


def boundary_iou(truth: DataFrame, predicted: DataFrame, images: DataFrame) -> DataFrame:
    """Overlap of the two surfaces; an empty union is 1."""
    both = surface(truth).withColumn("a", F.lit(1)).join(surface(predicted).withColumn("b", F.lit(1)), ["image", "r", "c"], "full_outer")
    found = both.groupBy("image").agg((F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()) / F.count("*")).alias("v"))
    return images.join(found, "image", "left").select("image", F.coalesce("v", F.lit(1.0)).alias("boundary_iou"))


def surface_distances(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(image, side, d) of each surface pixel to the nearest pixel of the other surface; images with both surfaces.

    Exact, and separable: the nearest pixel of each column first (running positions
    down and up the rows), then the least sum of squares over the columns. A surface
    pixel meets as many rows as the other surface has columns, not all of its pixels.
    """
    sides = {"pred": (surface(predicted), surface(truth)), "gt": (surface(truth), surface(predicted))}
    out = None
    for side, (own, other) in sides.items():
        columns = other.groupBy("image", "c").agg(F.array_sort(F.collect_list("r")).alias("rows"))
        met = own.alias("a").join(columns.alias("b"), "image").select("image", F.col("a.r").alias("r"), F.col("a.c").alias("c"), F.col("b.c").alias("oc"), "rows")
        near = F.array_min(F.transform("rows", lambda x: F.abs(x - F.col("r"))))
        least = met.select("image", "r", "c", (near * near + (F.col("c") - F.col("oc")) * (F.col("c") - F.col("oc"))).alias("d2")).groupBy("image", "r", "c").agg(F.min("d2").alias("d2"))
        part = least.select("image", F.lit(side).alias("side"), F.sqrt("d2").alias("d"))
        out = part if out is None else out.unionByName(part)
    return out


def hausdorff(truth: DataFrame, predicted: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image, assd, hd95); both surfaces empty 0, one empty the image's diagonal; sizes: (image, rows, cols)."""
    per = surface_distances(truth, predicted).groupBy("image", "side").agg(F.avg("d").alias("m"), F.percentile("d", F.lit(0.95)).alias("q"))
    both = per.groupBy("image").agg(F.avg("m").alias("assd"), F.max("q").alias("hd95"))
    any_ = truth.select("image").unionByName(predicted.select("image")).distinct().withColumn("some", F.lit(True))
    diagonal = F.when(F.col("some"), F.sqrt(F.col("rows") * F.col("rows") + F.col("cols") * F.col("cols"))).otherwise(0.0)
    joined = sizes.join(both, "image", "left").join(any_, "image", "left")
    return joined.select("image", F.coalesce("assd", diagonal).alias("assd"), F.coalesce("hd95", diagonal).alias("hd95"))


def normalise_bands(pixels: DataFrame, bands: list[str], nodata: float | None = None) -> DataFrame:
    """Per-image z-scores of each band; a pixel with nodata in any band is null in all."""
    bad = F.lit(False)
    for b in bands:
        bad = bad | (F.col(b) == nodata if nodata is not None else F.col(b).isNull())
    clean = pixels.select(*(c for c in pixels.columns if c not in bands), *(F.when(~bad, F.col(b)).alias(b) for b in bands))
    stats = clean.groupBy("image").agg(*(F.avg(b).alias(f"m_{b}") for b in bands), *(F.stddev_pop(b).alias(f"s_{b}") for b in bands))
    joined = clean.join(stats, "image")
    return joined.select(*pixels.columns[: -len(bands)], *(((F.col(b) - F.col(f"m_{b}")) / F.greatest(f"s_{b}", F.lit(1e-12))).alias(b) for b in bands))


def snow_mask(v_min: float, s_max: float, scale: float = 255.0) -> Column:
    """Bright and little saturated pixels."""
    hi, lo = F.greatest("b1", "b2", "b3"), F.least("b1", "b2", "b3")
    return (hi / scale >= v_min) & (F.when(hi > 0, (hi - lo) / hi).otherwise(0.0) <= s_max)


def sample_uncertainty(samples: DataFrame) -> DataFrame:
    """Mean, aleatoric and epistemic parts of a pixel's sampled probabilities."""
    p = F.col("prob")
    return samples.groupBy("image", "r", "c").agg(F.avg(p).alias("mean"), F.avg(p * (1 - p)).alias("aleatoric"), (F.avg(p * p) - F.avg(p) * F.avg(p)).alias("epistemic"))
