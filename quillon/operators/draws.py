"""Posterior-draw statistics (W5, W6, W12, B1-B22, E3, E5, E6, E8) over (sample, grp, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summary(draws: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """B1: mean and equal-tailed interval."""
    return draws.groupBy(*by).agg(F.avg("value").alias("mean"), F.percentile("value", F.lit(alpha / 2)).alias("low"), F.percentile("value", F.lit(1 - alpha / 2)).alias("high"))


def density_at_zero(draws: DataFrame, by: list[str], factor: str = "scott") -> DataFrame:
    """B2: Gaussian kernel density at 0, bandwidth by Scott's or Silverman's rule."""
    stats = draws.groupBy(*by).agg(F.stddev_samp("value").alias("s"), F.count("*").alias("n"))
    base = F.col("n") if factor == "scott" else F.col("n") * 3 / F.lit(4.0)
    h = F.col("s") * F.pow(base.cast("double"), F.lit(-0.2))
    rows = draws.join(stats, by).withColumn("h", h)
    return rows.groupBy(*by).agg((F.avg(F.exp(-F.col("value") * F.col("value") / (2 * F.col("h") * F.col("h")))) / (F.max("h") * F.sqrt(2 * F.pi()))).alias("density"))


def bayes_factor(posterior_density, prior_density):
    """Savage-Dickey ratio, infinite when tiny or huge."""
    ratio = prior_density / posterior_density
    return F.when((posterior_density < 1e-10) | (ratio > 1e6), F.lit(float("inf"))).otherwise(ratio)


def ranks(draws: DataFrame) -> DataFrame:
    """Rank of each group within a draw, best first, ties by group."""
    return draws.withColumn("rank", F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("value"), "grp")))


def rank_probabilities(draws: DataFrame, top: int = 2) -> DataFrame:
    """Expected rank, chance to be best and among the best, and the rank interval."""
    r = F.col("rank")
    return ranks(draws).groupBy("grp").agg(F.avg("rank").alias("e_rank"), F.avg((r == 1).cast("double")).alias("p_best"), F.avg((r <= top).cast("double")).alias("p_top"), F.percentile("rank", F.lit(0.025)).alias("rank_low"), F.percentile("rank", F.lit(0.975)).alias("rank_high"))


def rank_table(draws: DataFrame, n_groups: int) -> DataFrame:
    """The chance of every rank, one column for each."""
    return ranks(draws).groupBy("grp").agg(*(F.avg((F.col("rank") == k).cast("double")).alias(f"p{k}") for k in range(1, n_groups + 1)))


def contrast_summary(deltas: DataFrame, by: list[str], rope: float) -> DataFrame:
    """Interval, direction and the share strictly inside the region of practical equivalence."""
    d = F.col("delta")
    share = lambda c: F.avg(c.cast("double"))
    return deltas.groupBy(*by).agg(F.avg(d).alias("mean"), F.percentile("delta", F.lit(0.025)).alias("low"), F.percentile("delta", F.lit(0.975)).alias("high"), share(d > 0).alias("p_pos"), share(d < 0).alias("p_neg"), share(F.abs(d) < rope).alias("p_rope"))


def contrasts(cells: DataFrame, level: str, within: list[str], baseline) -> DataFrame:
    """Each level minus the baseline in the same draw; average first for overall contrasts."""
    means = cells.groupBy("sample", *within, level).agg(F.avg("value").alias("value"))
    base = means.where(F.col(level) == baseline).select("sample", *within, F.col("value").alias("base"))
    return means.where(F.col(level) != baseline).join(base, ["sample", *within]).withColumn("delta", F.col("value") - F.col("base"))


def pairwise(draws: DataFrame) -> DataFrame:
    """Differences of all pairs of groups in a draw; groups are few and fixed."""
    a, b = draws.select("sample", F.col("grp").alias("a"), F.col("value").alias("va")), draws.select("sample", F.col("grp").alias("b"), F.col("value").alias("vb"))
    return a.join(b, "sample").where("a < b").withColumn("delta", F.col("va") - F.col("vb"))


def composite(metrics: DataFrame, weights: dict[str, float], lower: tuple[str, ...] = ()) -> DataFrame:
    """Weighted sum of values divided by the metric's overall deviation (not centred); metrics: (metric, sample, grp, value).

    Of the metrics in ``lower`` less is better.
    """
    total = sum(weights.values())
    scale = metrics.groupBy("metric").agg(F.stddev_pop("value").alias("s"))
    signed = {k: (-1 if k in lower else 1) * v / total for k, v in weights.items()}
    w = F.element_at(F.create_map(*(F.lit(x) for k, v in signed.items() for x in (k, v))), F.col("metric"))
    rows = metrics.join(scale, "metric").withColumn("v", w * F.col("value") / (F.col("s") + F.lit(1e-12)))
    return rows.groupBy("sample", "grp").agg(F.sum("v").alias("value"))


def density_zero_factor(draws: DataFrame, by: list[str], factor: float) -> DataFrame:
    """B2: density at 0 with a bandwidth of ``factor`` sample deviations."""
    stats = draws.groupBy(*by).agg((F.stddev_samp("value") * F.lit(factor)).alias("h"))
    kernel = F.exp(-F.col("value") * F.col("value") / (2 * F.col("h") * F.col("h")))
    return draws.join(stats, by).groupBy(*by).agg((F.avg(kernel) / (F.max("h") * F.sqrt(2 * F.pi()))).alias("density"))


def savage_dickey(post: DataFrame, prior: DataFrame, by: list[str], guarded: bool = True) -> DataFrame:
    """(*by, bf10) from two draw tables; without ``guarded`` the plain ratio of the densities."""
    a = density_at_zero(post, by).withColumnRenamed("density", "post")
    b = density_at_zero(prior, by).withColumnRenamed("density", "prior")
    both = a.join(b, by)
    ratio = bayes_factor(F.col("post"), F.col("prior")) if guarded else F.col("prior") / F.col("post")
    return both.select(*by, ratio.alias("bf10"))


def row_scores(draws: DataFrame, mode: str, clip: float = 8.0) -> DataFrame:
    """Each draw's values as z (mean and population deviation) or robust_z (median and MAD), cut off at ``clip``."""
    if mode == "z":
        stats = draws.groupBy("sample").agg(F.avg("value").alias("m"), (F.stddev_pop("value") + F.lit(1e-12)).alias("s"))
    else:
        center = draws.groupBy("sample").agg(F.percentile("value", F.lit(0.5)).alias("m"))
        spread = draws.join(center, "sample").groupBy("sample").agg(F.percentile(F.abs(F.col("value") - F.col("m")), F.lit(0.5)).alias("mad"))
        stats = center.join(spread.select("sample", (F.lit(1.4826) * F.col("mad") + F.lit(1e-12)).alias("s")), "sample")
    z = (F.col("value") - F.col("m")) / F.col("s")
    return draws.join(stats, "sample").select("sample", "grp", F.greatest(F.least(z, F.lit(clip)), F.lit(-clip)).alias("value"))


def composite_mode(metrics: DataFrame, weights: dict[str, float], mode: str, n_groups: int, lower: tuple[str, ...] = ()) -> DataFrame:
    """Weighted utility of ranks (best = number of groups), or of each draw's z or robust z."""
    total, parts = sum(weights.values()), None
    for name, weight in weights.items():
        own = metrics.where(F.col("metric") == name).select("sample", "grp", ((-1 if name in lower else 1) * F.col("value")).alias("value"))
        scored = ranks(own).select("sample", "grp", (F.lit(n_groups + 1.0) - F.col("rank")).alias("value")) if mode == "rank" else row_scores(own, mode)
        part = scored.withColumn("value", F.lit(weight / total) * F.col("value"))
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("sample", "grp").agg(F.sum("value").alias("value"))


def diagnostics(draws: DataFrame, top: int = 2, ci: tuple[float, float] = (0.05, 0.95), tie: float = 0.1) -> DataFrame:
    """Of each group the chance of the first places, the rank interval and the entropy of its ranks; of all the
    effective number of winners; of the best group its runner-up, and how often it wins against it or ties.

    The groups are few: the two best ones are a row of their own.
    """
    ranked = ranks(draws)
    share = ranked.groupBy("grp", "rank").agg(F.count("*").alias("n")).join(ranked.groupBy("grp").agg(F.count("*").alias("all")), "grp")
    p = F.col("n") / F.col("all")
    entropy = share.groupBy("grp").agg((-F.sum(p * F.ln(p))).alias("entropy"))
    r = F.col("rank")
    rows = ranked.groupBy("grp").agg(F.avg(r).alias("e_rank"), F.avg((r == 1).cast("double")).alias("p_best"), F.avg((r <= top).cast("double")).alias("p_top"), F.percentile("rank", F.lit(ci[0])).alias("rank_low"), F.percentile("rank", F.lit(ci[1])).alias("rank_high"))
    winners = rows.where("p_best > 1e-12").agg((1 / F.sum(F.col("p_best") * F.col("p_best"))).alias("n_eff"))
    two = rows.select(F.slice(F.array_sort(F.collect_list(F.struct("e_rank", "grp")).over(Window.partitionBy())), 1, 2).alias("s")).limit(1)
    two = two.select(F.col("s")[0]["grp"].alias("grp"), F.col("s")[1]["grp"].alias("runner_up"))
    value = lambda name: draws.select("sample", F.col("grp").alias(name), F.col("value").alias(f"v_{name}"))
    duel = value("grp").join(F.broadcast(two), "grp").join(value("runner_up"), ["sample", "runner_up"]).withColumn("delta", F.col("v_grp") - F.col("v_runner_up"))
    won = duel.groupBy("grp", "runner_up").agg(F.avg((F.col("delta") > 0).cast("double")).alias("p_win"), F.avg((F.abs("delta") < tie).cast("double")).alias("p_tie"))
    return rows.join(entropy, "grp").crossJoin(F.broadcast(winners)).join(won, "grp", "left")


def best_odds(post: DataFrame, prior: DataFrame) -> DataFrame:
    """(grp, bf_best): odds of being best in the posterior over those in the prior."""
    from quillon.functions.scalars import odds

    both = rank_probabilities(post).select("grp", "p_best").join(rank_probabilities(prior).select("grp", F.col("p_best").alias("prior")), "grp")
    return both.select("grp", (odds(F.col("p_best")) / odds(F.col("prior"))).alias("bf_best"))


def uniform_best_odds(post: DataFrame, n_groups: int) -> DataFrame:
    """(grp, bf_best): odds of being best against groups that are equally good beforehand."""
    p = F.col("p_best")
    return rank_probabilities(post).select("grp", (p / (1 - p) / F.lit((1 / n_groups) / (1 - 1 / n_groups))).alias("bf_best"))


def pairwise_density_ratio(deltas: DataFrame, by: list[str], tau: float, factor: float = 0.3) -> DataFrame:
    """Density of differences at 0 over that of a normal prior with deviation sqrt(2) * tau."""
    prior = F.lit(1 / (2**0.5 * tau)) / F.sqrt(2 * F.pi())
    return density_zero_factor(deltas.withColumn("value", F.col("delta")), by, factor).select(*by, (F.col("density") / prior).alias("ratio"))


def effect_codes(levels: list[int]) -> list[list[int]]:
    """Effects coding: a column for each level but the last, whose row is -1 throughout."""
    return [[int(i == j) if i < len(levels) - 1 else -1 for j in range(len(levels) - 1)] for i in range(len(levels))]


def implied_effects(effects: DataFrame, a: str, b: str) -> DataFrame:
    """The last level of each factor is minus the sum of the others; effects: (sample, a, b, value), null for none.

    Main effects have one factor null; interactions get the missing row, column and corner.
    """
    own = effects.select("sample", a, b, "value")
    both = own.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    main_a = own.where(F.col(a).isNotNull() & F.col(b).isNull()).groupBy("sample").agg((-F.sum("value")).alias("value")).select("sample", F.lit(-1).alias(a), F.lit(None).cast("int").alias(b), "value")
    main_b = own.where(F.col(b).isNotNull() & F.col(a).isNull()).groupBy("sample").agg((-F.sum("value")).alias("value")).select("sample", F.lit(None).cast("int").alias(a), F.lit(-1).alias(b), "value")
    rows = both.groupBy("sample", b).agg((-F.sum("value")).alias("value")).select("sample", F.lit(-1).alias(a), b, "value")
    columns = both.groupBy("sample", a).agg((-F.sum("value")).alias("value")).select("sample", a, F.lit(-1).alias(b), "value")
    corner = both.groupBy("sample").agg(F.sum("value").alias("value")).select("sample", F.lit(-1).alias(a), F.lit(-1).alias(b), "value")
    return own.unionByName(main_a).unionByName(main_b).unionByName(rows).unionByName(columns).unionByName(corner)


def cell_predictions(coefficients: DataFrame, design: DataFrame) -> DataFrame:
    """(sample, cell, value): coefficients (sample, term, beta) times a design (cell, term, x), summed."""
    return coefficients.join(F.broadcast(design), "term").groupBy("sample", "cell").agg(F.sum(F.col("x") * F.col("beta")).alias("value"))


def factor_effects(cells: DataFrame, a: str, b: str) -> DataFrame:
    """Each draw's main effects (against the grand mean) and interactions: (sample, a, b, delta)."""
    mean = lambda *by: F.avg("value").over(Window.partitionBy("sample", *by))
    rows = cells.select("sample", a, b, "value", mean().alias("g"), mean(a).alias("ma"), mean(b).alias("mb"))
    none = F.lit(None).cast("long")
    main_a = rows.select("sample", F.col(a).cast("long").alias(a), none.alias(b), (F.col("ma") - F.col("g")).alias("delta")).distinct()
    main_b = rows.select("sample", none.alias(a), F.col(b).cast("long").alias(b), (F.col("mb") - F.col("g")).alias("delta")).distinct()
    inter = rows.select("sample", F.col(a).cast("long").alias(a), F.col(b).cast("long").alias(b), (F.col("value") - F.col("ma") - F.col("mb") + F.col("g")).alias("delta"))
    return main_a.unionByName(main_b).unionByName(inter)


def consecutive(draws: DataFrame) -> DataFrame:
    """(rank, grp, next_grp, p_better, density): each group against the next one by expected rank.

    The prior of the difference is the normal density at 0 with the draws' overall deviation.
    """
    order = rank_probabilities(draws).select("grp", "e_rank")
    w = Window.orderBy("e_rank", "grp")  # over the groups
    steps = order.select(F.row_number().over(w).alias("rank"), "grp", F.lead("grp").over(w).alias("next_grp")).where("next_grp is not null")
    a = draws.join(F.broadcast(steps), "grp")
    other = draws.select("sample", F.col("grp").alias("next_grp"), F.col("value").alias("v"))
    delta = a.join(other, ["sample", "next_grp"]).select("rank", "grp", "next_grp", (F.col("value") - F.col("v")).alias("value"))
    by = ["rank", "grp", "next_grp"]
    better = delta.groupBy(*by).agg(F.avg((F.col("value") > 0).cast("double")).alias("p_better"))
    prior = draws.agg((1 / (F.stddev_pop("value") * F.sqrt(2 * F.pi()))).alias("prior"))
    dens = density_at_zero(delta, by).crossJoin(F.broadcast(prior))
    return better.join(dens.select(*by, bayes_factor(F.col("density"), F.col("prior")).alias("bf10")), by)


def superiority(draws: DataFrame, higher: bool = True) -> DataFrame:
    """(a, b, p): the chance that group a beats b, a half on the diagonal."""
    a, b = draws.select("sample", F.col("grp").alias("a"), F.col("value").alias("va")), draws.select("sample", F.col("grp").alias("b"), F.col("value").alias("vb"))
    won = F.when(F.col("a") == F.col("b"), 0.5).otherwise(((F.col("va") > F.col("vb")) if higher else (F.col("va") < F.col("vb"))).cast("double"))
    return a.join(b, "sample").groupBy("a", "b").agg(F.avg(won).alias("p"))


def best_share(draws: DataFrame, higher: bool = True) -> DataFrame:
    """(grp, p): the share of draws that a group wins; ties go to the lesser group."""
    best = draws.groupBy("sample").agg(F.min(F.struct(((-1 if higher else 1) * F.col("value")).alias("v"), "grp")).alias("b"))
    return best.groupBy(F.col("b.grp").alias("grp")).agg(F.count("*").alias("n")).crossJoin(F.broadcast(best.agg(F.count("*").alias("all")))).select("grp", (F.col("n") / F.col("all")).alias("p"))


def strong_effects(effects: DataFrame, least: float = 1e-6) -> DataFrame:
    """Effects that are not zero, by their Bayes factors; effects: (effect, bf10, ...)."""
    return effects.where(F.abs("effect") > least).orderBy(F.desc("bf10"))


def stacked(draws: DataFrame, chain: str, draw: str, n_draws: int) -> DataFrame:
    """Chains one after the other: sample = chain * n_draws + draw."""
    return draws.withColumn("sample", F.col(chain) * n_draws + F.col(draw)).drop(chain, draw)
