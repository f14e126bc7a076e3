"""Queries on posterior draws beyond those of the analytics module."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import fixtures as X
from quillon.functions import scalars as S
from quillon.operators import draws
from quillon.plans.base import catalogue, r6

PLANS, plan = catalogue()
_D = f"with dr as ({X.DRAWS_ORACLE})"
_RK = f"{_D}, rk as (select sample, grp, row_number() over (partition by sample order by value desc, grp) as rank from dr)"
_PRIOR = "select sample, grp, value*((sample % 5)-2) + 0.1*(sample % 3 - 1) as value from dr"
_H = "select {by}, stddev_samp(value)*pow(count(*),-0.2) as h from {t} group by {by}"
_DENS = "select t.{by}, avg(exp(-value*value/(2*h*h)))/(max(h)*sqrt(2*pi())) as density from {t} t join h{t} k on t.{by} = k.{by} group by t.{by}"


def _prior(spark, d):
    v = F.col("value") * ((F.col("sample") % 5) - 2) + F.lit(0.1) * (F.col("sample") % 3 - 1)
    return X.draws(spark, d).withColumn("value", v)


_BF = f"""{_D}, pr as ({_PRIOR}), hdr as ({_H.format(by='grp', t='dr')}), hpr as ({_H.format(by='grp', t='pr')}), a as ({_DENS.format(by='grp', t='dr')}), b as ({_DENS.format(by='grp', t='pr')}),
 q as (select a.grp, a.density as post, b.density as prior from a join b on a.grp = b.grp)"""


@plan(f"{_BF} select grp, round(case when post < 1e-10 or prior/post > 1e6 then 'infinity'::double else prior/post end,6) as bf10, round(prior/post,6) as plain from q")
def savage_dickey(spark, d):
    """Bayes factors from prior and posterior draws, guarded and plain."""
    post, prior = X.draws(spark, d), _prior(spark, d)
    plain = draws.savage_dickey(post, prior, ["grp"], False).withColumnRenamed("bf10", "plain")
    return draws.savage_dickey(post, prior, ["grp"]).join(plain, "grp").select("grp", *r6("bf10", "plain"))


@plan(f"{_D} select grp, case when v < 1.0/10 then 'strong evidence for H0 (no effect)' when v < 1.0/3 then 'moderate evidence for H0' when v < 1 then 'anecdotal evidence for H0' when v < 3 then 'anecdotal evidence for H1 (effect)' when v < 10 then 'moderate evidence for H1' when v < 30 then 'strong evidence for H1' when v < 100 then 'very strong evidence for H1' else 'extreme evidence for H1' end as label, case when v < 3 then 'anecdotal' when v < 10 then 'moderate' when v < 30 then 'strong' when v < 100 then 'very strong' else 'extreme' end as five, count(*) as n from (select grp, abs(value)*pow(10, sample % 4) as v from dr) t group by all")
def evidence_labels(spark, d):
    """F12, B23."""
    v = X.draws(spark, d).withColumn("v", F.abs("value") * F.pow(F.lit(10.0), F.col("sample") % 4))
    return v.groupBy("grp", S.evidence_label(F.col("v")).alias("label"), S.jeffreys_label(F.col("v")).alias("five")).agg(F.count("*").alias("n"))


_CELL = f"{_D}, ce as (select sample, grp // 3 as dataset, grp % 3 as arch, value from dr)"
_SUM = "round(avg(delta),6) as mean, round(quantile_cont(delta,0.025),6) as low, round(quantile_cont(delta,0.975),6) as high, round(avg(cast(delta > 0 as int)),6) as p_pos, round(avg(cast(delta < 0 as int)),6) as p_neg, round(avg(cast(abs(delta) < 0.02 as int)),6) as p_rope"
_CS = ("mean", "low", "high", "p_pos", "p_neg", "p_rope")


def _cells(spark, d):
    return X.draws(spark, d).select("sample", F.floor(F.col("grp") / 3).alias("dataset"), (F.col("grp") % 3).alias("arch"), "value")


@plan(f"{_CELL}, dl as (select a.arch, a.dataset, a.value-b.value as delta from ce a join ce b on a.sample = b.sample and a.arch = b.arch and b.dataset = 0 and a.dataset <> 0) select arch, dataset, {_SUM} from dl group by 1,2")
def dataset_contrasts(spark, d):
    """Datasets against the first one, model by model."""
    return draws.contrast_summary(draws.contrasts(_cells(spark, d), "dataset", ["arch"], 0), ["arch", "dataset"], 0.02).select("arch", "dataset", *r6(*_CS))


@plan(f"{_CELL}, m as (select sample, arch, avg(value) as v from ce group by 1,2), dl as (select a.arch, a.v-b.v as delta from m a join m b on a.sample = b.sample and b.arch = 0 and a.arch <> 0) select arch, {_SUM} from dl group by 1")
def overall_arch_contrasts(spark, d):
    """Models against the first one, over all datasets."""
    return draws.contrast_summary(draws.contrasts(_cells(spark, d), "arch", [], 0), ["arch"], 0.02).select("arch", *r6(*_CS))


_EFF = f"""{_CELL}, w as (select *, avg(value) over (partition by sample) as g, avg(value) over (partition by sample, dataset) as ma, avg(value) over (partition by sample, arch) as mb from ce),
 e as (select distinct sample, dataset, null::bigint as arch, ma-g as delta from w union all select distinct sample, null, arch, mb-g from w union all select sample, dataset, arch, value-ma-mb+g from w)"""


@plan(f"{_EFF} select dataset, arch, {_SUM}, round(avg(exp(delta)),6) as odds_ratio, round(avg((exp(delta)-1)*100),6) as percent from e group by 1, 2")
def factor_effects(spark, d):
    """Main effects and interactions against the grand mean, as odds ratios and percent changes."""
    e = draws.factor_effects(_cells(spark, d), "dataset", "arch")
    more = e.groupBy("dataset", "arch").agg(F.round(F.avg(F.exp("delta")), 6).alias("odds_ratio"), F.round(F.avg((F.exp("delta") - 1) * 100), 6).alias("percent"))
    own = draws.contrast_summary(e, ["dataset", "arch"], 0.02).select("dataset", "arch", *r6(*_CS))
    same = F.col("a.dataset").eqNullSafe(F.col("b.dataset")) & F.col("a.arch").eqNullSafe(F.col("b.arch"))
    return own.alias("a").join(more.alias("b"), same).select("a.*", "odds_ratio", "percent")


_FREE = f"""{_D}, ef as (select sample, case when grp < 2 then grp when grp >= 4 and grp < 8 then (grp-4)//2 end as a, case when grp in (2,3) then grp-2 when grp >= 4 and grp < 8 then (grp-4) % 2 end as b, value from dr where grp < 8),
 al as (select * from ef union all select sample, -1, null, -sum(value) from ef where a is not null and b is null group by 1 union all select sample, null, -1, -sum(value) from ef where b is not null and a is null group by 1
  union all select sample, -1, b, -sum(value) from ef where a is not null and b is not null group by sample, b union all select sample, a, -1, -sum(value) from ef where a is not null and b is not null group by sample, a
  union all select sample, -1, -1, sum(value) from ef where a is not null and b is not null group by 1)"""


def _free(spark, d):
    g = F.col("grp")
    inter = (g >= 4) & (g < 8)
    a, b = F.when(g < 2, g).when(inter, F.floor((g - 4) / 2)).cast("int"), F.when(g.isin(2, 3), g - 2).when(inter, (g - 4) % 2).cast("int")
    return X.draws(spark, d).where("grp < 8").select("sample", a.alias("a"), b.alias("b"), "value")


@plan(f"{_FREE} select cast(a as int) as a, cast(b as int) as b, count(*) as n, round(avg(value),6) as mean, round(avg(cast(value > 0 as int)),6) as p_pos from al group by 1, 2")
def implied_effects(spark, d):
    """The effects of the last levels, from those of the others (-1 stands for the last level)."""
    e = draws.implied_effects(_free(spark, d), "a", "b")
    return e.groupBy("a", "b").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg((F.col("value") > 0).cast("int")), 6).alias("p_pos"))


@plan(f"""{_D}, lv as (select 0 as l, 1 as c0, 0 as c1 union all select 1, 0, 1 union all select 2, -1, -1),
 ds as (select d.l*3+m.l as cell, unnest([0,1,2,3,4,5,6,7,8]) as term, unnest([1, d.c0, d.c1, m.c0, m.c1, d.c0*m.c0, d.c0*m.c1, d.c1*m.c0, d.c1*m.c1]) as x from lv d cross join lv m)
 select cast(cell as int) as cell, round(avg(value),6) as mean, round(stddev_samp(value),6) as sd from (select sample, cell, sum(x*value) as value from dr join ds on grp = term group by 1, 2) t group by 1""")
def cell_predictions(spark, d):
    """Effects coding of two factors, and the cells' values in each draw."""
    codes = draws.effect_codes([0, 1, 2])
    rows = [(i * 3 + j, t, x) for i, p in enumerate(codes) for j, q in enumerate(codes) for t, x in enumerate([1, *p, *q, *(u * v for u in p for v in q)])]
    design = spark.createDataFrame(rows, "cell int, term long, x int")
    cells = draws.cell_predictions(X.draws(spark, d).withColumnsRenamed({"grp": "term", "value": "beta"}), design)
    return cells.groupBy("cell").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"))


@plan(f"""{_RK}, p as (select grp, rank, count(*)/sum(count(*)) over (partition by grp) as p from rk group by 1, 2), en as (select grp, -sum(p*ln(p)) as entropy from p group by 1),
 r as (select grp, avg(rank) as e_rank, avg(cast(rank = 1 as int)) as p_best, avg(cast(rank <= 2 as int)) as p_top, quantile_cont(rank,0.05) as lo, quantile_cont(rank,0.95) as hi from rk group by 1),
 t as (select (select grp from r order by e_rank, grp limit 1) as grp, (select grp from r order by e_rank, grp limit 1 offset 1) as runner_up),
 w as (select t.grp, t.runner_up, avg(cast(a.value > b.value as int)) as p_win, avg(cast(abs(a.value-b.value) < 0.1 as int)) as p_tie from t join dr a on a.grp = t.grp join dr b on b.grp = t.runner_up and a.sample = b.sample group by 1, 2)
 select r.grp, round(e_rank,6) as e_rank, round(p_best,6) as p_best, round(p_top,6) as p_top, cast(lo as double) as rank_low, cast(hi as double) as rank_high, round(entropy,6) as entropy,
  round((select 1/sum(p_best*p_best) from r where p_best > 1e-12),6) as n_eff, runner_up, round(p_win,6) as p_win, round(p_tie,6) as p_tie from r join en using (grp) left join w on w.grp = r.grp""")
def draw_diagnostics(spark, d):
    """B12."""
    out = draws.diagnostics(X.draws(spark, d))
    return out.select("grp", *r6("e_rank", "p_best", "p_top"), F.col("rank_low").cast("double").alias("rank_low"), F.col("rank_high").cast("double").alias("rank_high"), *r6("entropy", "n_eff"), "runner_up", *r6("p_win", "p_tie"))


_WIN = "{p} as (select grp, avg(cast(k = 1 as int)) as p from (select grp, row_number() over (partition by sample order by value desc, grp) as k from {t}) q group by 1)"


@plan(f"{_D}, pr as ({_PRIOR}), {_WIN.format(p='a', t='dr')}, {_WIN.format(p='b', t='pr')}, c as (select a.grp, least(greatest(a.p,1e-12),1-1e-12) as x, least(greatest(b.p,1e-12),1-1e-12) as y, a.p from a join b using (grp)) select grp, round(x/(1-x)/(y/(1-y)),6) as bf_best, round(p/(1-p)/((1.0::double/9)/(1-1.0::double/9)),6) as bf_uniform from c")
def best_factors(spark, d):
    """B13, B21, F11."""
    post = X.draws(spark, d)
    uniform = draws.uniform_best_odds(post, 9).withColumnRenamed("bf_best", "bf_uniform")
    return draws.best_odds(post, _prior(spark, d)).join(uniform, "grp").select("grp", *r6("bf_best", "bf_uniform"))


@plan(f"{_D}, dl as (select a.grp as a, b.grp as b, a.value-b.value as value from dr a join dr b on a.sample = b.sample and a.grp < b.grp), h as (select a, b, stddev_samp(value)*0.3 as h from dl group by 1, 2) select a, b, round(avg(exp(-value*value/(2*h*h)))/(max(h)*sqrt(2*pi()))/(1/(sqrt(2)*0.5*sqrt(2*pi()))),6) as ratio from dl join h using (a, b) group by 1, 2")
def pairwise_density(spark, d):
    """Density ratios of all pairs against a normal prior."""
    return draws.pairwise_density_ratio(draws.pairwise(X.draws(spark, d)), ["a", "b"], 0.5).select("a", "b", *r6("ratio"))


@plan(f"""{_RK}, o as (select grp, avg(rank) as er from rk group by 1), s as (select row_number() over (order by er, grp) as rank, grp, lead(grp) over (order by er, grp) as next_grp from o),
 dl as (select s.rank, s.grp, s.next_grp, a.value-b.value as value from s join dr a on a.grp = s.grp join dr b on b.grp = s.next_grp and a.sample = b.sample), h as (select rank, stddev_samp(value)*pow(count(*),-0.2) as h from dl group by 1),
 q as (select dl.rank, grp, next_grp, avg(cast(value > 0 as int)) as pb, avg(exp(-value*value/(2*h*h)))/(max(h)*sqrt(2*pi())) as post, (select 1/(stddev_pop(value)*sqrt(2*pi())) from dr) as prior from dl join h on h.rank = dl.rank group by 1, 2, 3)
 select cast(rank as int) as rank, grp, next_grp, round(pb,6) as p_better, round(case when post < 1e-10 or prior/post > 1e6 then 'infinity'::double else prior/post end,6) as bf10 from q""")
def consecutive_ranks(spark, d):
    """W6, B18."""
    return draws.consecutive(X.draws(spark, d)).select("rank", "grp", "next_grp", *r6("p_better", "bf10"))


@plan(f"{_D} select a.grp as a, b.grp as b, round(avg(case when a.grp = b.grp then 0.5 when a.value > b.value then 1 else 0 end),6) as p from dr a join dr b on a.sample = b.sample group by 1, 2")
def superiority_matrix(spark, d):
    """B22."""
    return draws.superiority(X.draws(spark, d)).select("a", "b", *r6("p"))


@plan(f"{_D}, b as (select sample, arg_min(grp, (value, grp)) as grp from dr group by 1) select grp, round(count(*)/(select count(*) from b),6) as p from b group by 1")
def lowest_share(spark, d):
    """B20, where less is better."""
    return draws.best_share(X.draws(spark, d), higher=False).select("grp", *r6("p"))


def _z(value: str) -> str:
    return f"greatest(least({value}, 8), -8)"


_M = f"{_D}, me as (select 'a' as metric, sample, grp, value from dr union all select 'b', sample, grp, -exp(value) from dr)"



@plan(f"""{_M}, m as (select *, median(value) over p as md, avg(value) over p as mu, stddev_pop(value) over p as sd, row_number() over (partition by metric, sample order by value desc, grp) as rk from me window p as (partition by metric, sample)),
 n as (select *, median(abs(value-md)) over (partition by metric, sample) as mad from m),
 u as (select sample, grp, sum(w*(10-rk)) as by_rank, sum(w*{_z('(value-mu)/(sd+1e-12)')}) as by_z, sum(w*{_z('(value-md)/(1.4826*mad+1e-12)')}) as by_robust from (select *, case metric when 'a' then 0.75 else 0.25 end as w from n) q group by 1, 2)
 select grp, round(avg(by_rank),5) as by_rank, round(avg(by_z),5) as by_z, round(avg(by_robust),5) as by_robust, round(max(by_robust),5) as top from u group by 1""")
def composite_modes(spark, d):
    """Utilities of ranks, of z scores and of robust z scores."""
    one = X.draws(spark, d).withColumn("metric", F.lit("a"))
    both = one.unionByName(one.withColumn("metric", F.lit("b")).withColumn("value", F.exp("value")))
    mode = lambda m, name: draws.composite_mode(both, {"a": 3.0, "b": 1.0}, m, 9, ("b",)).withColumnRenamed("value", name)
    all_ = mode("rank", "by_rank").join(mode("z", "by_z"), ["sample", "grp"]).join(mode("robust_z", "by_robust"), ["sample", "grp"])
    return all_.groupBy("grp").agg(*(F.round(F.avg(c), 5).alias(c) for c in ("by_rank", "by_z", "by_robust")), F.round(F.max("by_robust"), 5).alias("top"))


@plan(f"{_D}, s as (select (sample % 4)*1000 + sample // 4 as sample, grp, value from dr), e as (select grp, avg(value) as effect, avg(cast(value > 0 as int))/avg(cast(value <= 0 as int)) as bf10, min(sample) as first, max(sample) as last from s group by 1) select grp, round(effect,6) as effect, round(bf10,6) as bf10, first, last from e where abs(effect) > 1e-6")
def stacked_effects(spark, d):
    """Chains stacked to samples, and the effects that are not zero."""
    parts = X.draws(spark, d).withColumn("chain", F.col("sample") % 4).withColumn("draw", F.floor(F.col("sample") / 4)).drop("sample")
    s = draws.stacked(parts, "chain", "draw", 1000)
    pos = F.avg((F.col("value") > 0).cast("int")) / F.avg((F.col("value") <= 0).cast("int"))
    e = s.groupBy("grp").agg(F.avg("value").alias("effect"), pos.alias("bf10"), F.min("sample").alias("first"), F.max("sample").alias("last"))
    return draws.strong_effects(e).select("grp", *r6("effect", "bf10"), "first", "last")



