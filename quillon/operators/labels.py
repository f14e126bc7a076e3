"""Label consensus and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value that is neither null nor empty; ties go to the first in order."""
    counted = df.where(F.col(value).isNotNull() & (F.col(value) != "")).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), value)).alias("b")).select(*keys, F.col(f"b.{value}").alias(value))


def fleiss_kappa(votes: DataFrame, item: list[str], category: str) -> DataFrame:
    """One row; items with fewer than two votes do not count, certain chance agreement gives 1."""
    per = votes.groupBy(*item, category).agg(F.count("*").alias("n"))
    items = per.groupBy(*item).agg(F.sum("n").alias("t"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agree")).where("t >= 2")
    kept = per.join(items.select(*item, "t"), item, "left_semi")
    chance = kept.groupBy(category).agg(F.sum("n").alias("n")).agg((F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("pe"))
    observed = items.agg(F.avg(F.col("agree") / (F.col("t") * (F.col("t") - 1))).alias("pa"), F.count("*").alias("n_items"))
    near_one = F.col("pe") > 1 - 1e-12
    return observed.crossJoin(chance).select("n_items", F.when(near_one, 1.0).otherwise((F.col("pa") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"))


def rand_scores(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index and Cohen's kappa on the pair relation, from contingency counts alone."""
    two = lambda n: n * (n - 1) / 2
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n")).agg(F.sum(two(F.col("n"))).alias("ab"), F.sum("n").alias("n"))
    left = pairs.groupBy(a).agg(F.count("*").alias("n")).agg(F.sum(two(F.col("n"))).alias("sa"))
    right = pairs.groupBy(b).agg(F.count("*").alias("n")).agg(F.sum(two(F.col("n"))).alias("sb"))
    all_ = cells.crossJoin(left).crossJoin(right).withColumn("t", two(F.col("n")))
    expected, top = F.col("sa") * F.col("sb") / F.col("t"), (F.col("sa") + F.col("sb")) / 2
    po = (F.col("t") + 2 * F.col("ab") - F.col("sa") - F.col("sb")) / F.col("t")
    pe = (F.col("sa") * F.col("sb") + (F.col("t") - F.col("sa")) * (F.col("t") - F.col("sb"))) / (F.col("t") * F.col("t"))
    return all_.select(F.when(top == expected, 1.0).otherwise((F.col("ab") - expected) / (top - expected)).alias("ari"), F.when(pe > 1 - 1e-12, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


def grouping_kappa(labels: DataFrame) -> DataFrame:
    """L3: Fleiss' kappa of "together or apart" over all pairs of an image's items that two labelers or more rated.

    Pairs are counted, not made: items are told apart by who rated them, and all counts
    come from the sizes of groups (of one labeler, and of two labelers at once).
    """
    one = labels.select("image", "seep_id", "labeler", "grp").distinct()
    raters = one.groupBy("image", "seep_id").agg(F.array_sort(F.collect_set("labeler")).alias("who"))
    rows = one.join(raters, ["image", "seep_id"])
    kinds = raters.groupBy("image", "who").agg(F.count("*").alias("n"))
    pairs_of = lambda x, y: F.when(F.col("x.who") == F.col("y.who"), F.col(x) * (F.col(x) - 1) / 2).otherwise(F.col(x) * F.col(y))
    order = F.col("x.who") <= F.col("y.who")
    common = F.array_intersect("x.who", "y.who")
    items = kinds.alias("x").join(kinds.alias("y"), (F.col("x.image") == F.col("y.image")) & order & (F.size(common) >= 2))
    items = items.select(F.col("x.image").alias("image"), F.col("x.who").alias("a"), F.col("y.who").alias("b"), common.alias("both"), pairs_of("x.n", "y.n").alias("n"))

    def together(groups: DataFrame, keys: list[str]) -> DataFrame:
        """Pairs that the labelers in ``keys`` all put together, by the kinds of the two items."""
        sizes = groups.groupBy(*keys, "who").agg(F.count("*").alias("n"))
        same = [F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}")) for k in keys]
        met = sizes.alias("x").join(sizes.alias("y"), [*same, order])
        names = [F.col(f"x.{k}").alias(k) for k in keys if not k.startswith("grp")]
        return met.select(*names, F.col("x.who").alias("a"), F.col("y.who").alias("b"), pairs_of("x.n", "y.n").alias("t")).groupBy(*(k for k in keys if not k.startswith("grp")), "a", "b").agg(F.sum("t").alias("t"))

    single = together(rows, ["image", "labeler", "grp"])
    two = rows.alias("p").join(rows.alias("q"), F.expr("p.image = q.image and p.seep_id = q.seep_id and p.labeler < q.labeler"))
    two = two.select("p.image", "p.who", F.col("p.labeler").alias("l1"), F.col("q.labeler").alias("l2"), F.col("p.grp").alias("grp1"), F.col("q.grp").alias("grp2"))
    double = together(two, ["image", "l1", "l2", "grp1", "grp2"])
    votes = items.select("image", "a", "b", "n", F.size("both").alias("k"), F.explode("both").alias("labeler")).join(single, ["image", "a", "b", "labeler"], "left")
    per = votes.groupBy("image", "a", "b", "n", "k").agg(F.sum(F.coalesce("t", F.lit(0.0))).alias("t"))
    meet = items.select("image", "a", "b", "n", F.explode("both").alias("l1"), "both").select("image", "a", "b", "n", "l1", F.explode("both").alias("l2")).where("l1 < l2")
    half = lambda name: single.select("image", "a", "b", F.col("labeler").alias(name), F.col("t").alias(f"t_{name}"))
    meet = meet.join(half("l1"), ["image", "a", "b", "l1"], "left").join(half("l2"), ["image", "a", "b", "l2"], "left").join(double, ["image", "a", "b", "l1", "l2"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    agree = F.sum(2 * (2 * zero("t") + F.col("n") - zero("t_l1") - zero("t_l2"))).alias("agree")
    full = per.join(meet.groupBy("image", "a", "b").agg(agree), ["image", "a", "b"])
    sums = full.agg(F.sum("n").alias("n"), F.sum(F.col("agree") / (F.col("k") * (F.col("k") - 1))).alias("pa"), F.sum("t").alias("t"), F.sum(F.col("n") * F.col("k")).alias("all"))
    share = F.col("t") / F.col("all")
    pe, pa = share * share + (1 - share) * (1 - share), F.col("pa") / F.col("n")
    return sums.select(F.col("n").cast("long").alias("n_items"), F.when(pe > 1 - 1e-12, 1.0).otherwise((pa - pe) / (1 - pe)).alias("kappa"))


def group_measures(members: DataFrame, keys: list[str]) -> DataFrame:
    """A5: of groups of two or more, the largest member's area, its distance to the farthest, the largest other area."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("area"), "seep_id"))
    ranked = members.withColumn("k", rank)
    head = ranked.where("k = 1").select(*keys, F.col("area").alias("anchor_area"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    d = F.sqrt((F.col("x") - F.col("ax")) * (F.col("x") - F.col("ax")) + (F.col("y") - F.col("ay")) * (F.col("y") - F.col("ay")))
    rest = ranked.where("k > 1").join(head, keys).groupBy(*keys, "anchor_area").agg(F.max(d).alias("reach"), F.max("area").alias("satellite_area"))
    return rest


def percentiles(value: str, points: list[int]) -> list[Column]:
    """Exact interpolated percentiles of the finite values."""
    v = F.when(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")), F.col(value))
    return [F.percentile(v, F.lit(p / 100)).alias(f"p{p}") for p in points]


def partition_scores(pairs: DataFrame, human: str, rule: str) -> DataFrame:
    """How many groups each side has, human groups split by the rule, rule groups that bridge humans."""
    one = pairs.agg(F.count_distinct(human).alias("n_human"), F.count_distinct(rule).alias("n_rule"))
    split = pairs.groupBy(human).agg(F.count_distinct(rule).alias("n")).agg(F.count_if(F.col("n") > 1).alias("fragmented"))
    bridge = pairs.groupBy(rule).agg(F.count_distinct(human).alias("n")).agg(F.count_if(F.col("n") > 1).alias("bridges"))
    return one.crossJoin(split).crossJoin(bridge)
