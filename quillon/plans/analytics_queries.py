"""Queries on pixels, labels, draws, times, scenes and scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon import fixtures as X
from quillon.functions import scalars as S
from quillon.operators import cluster, draws, labels, metrics, regions, selection, temporal
from quillon.operators.spatial import argbest


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


def on(sql):
    return lambda spark, d: X.project(spark, d, sql)


pixels, runs, acq, weather, scenes, log, hist, packs = (on(s) for s in (X.PIXELS, X.RUNS, X.ACQUISITIONS, X.WEATHER, X.SCENES, X.TRAIN_LOG, X.HISTORICAL, X.LABELS))
_P, _L, _W, _S, _T, _H, _D = f"px as ({X.PIXELS})", f"lab as ({X.LABELS})", f"w as ({X.WEATHER})", f"sc as ({X.SCENES})", f"lg as ({X.TRAIN_LOG})", f"hi as ({X.HISTORICAL})", f"dr as ({X.DRAWS_ORACLE})"
PLANS: dict = {}


def plan(sql):
    """Registers a query under its function's name, with its SQL."""

    def put(f):
        PLANS[f.__name__] = (f, sql)
        return f

    return put


_CONF = "count(*) filter (where prob >= 0.5 and gt > 0) as tp, count(*) filter (where prob >= 0.5 and gt = 0) as fp, count(*) filter (where prob < 0.5 and gt > 0) as fn, count(*) filter (where prob < 0.5 and gt = 0) as tn"
_RATIOS = """2*tp/(2*tp+fp+fn+1e-9) as dice, tp/(tp+fp+fn+1e-9) as iou, (tp+tn)/(tp+fp+fn+tn+1e-9) as accuracy, tp/(tp+fn+1e-9) as sensitivity, tn/(tn+fp+1e-9) as specificity,
 tp/(tp+fp+1e-9) as precision_, 2*(tp/(tp+fp+1e-9))*(tp/(tp+fn+1e-9))/(tp/(tp+fp+1e-9)+tp/(tp+fn+1e-9)+1e-9) as f1,
 5*(tp/(tp+fp+1e-9))*(tp/(tp+fn+1e-9))/(4*(tp/(tp+fp+1e-9))+tp/(tp+fn+1e-9)+1e-9) as f_beta"""
_NAMES = ["dice", "iou", "accuracy", "sensitivity", "specificity", "precision_", "f1", "f_beta"]
_R6 = ", ".join(f"round({n},6) as {n}" for n in _NAMES)


_IMAGE = f"""with {_P}, c as (select image, sum(gt*prob) as i, sum(gt) as y, sum(prob) as p, sum(prob*(1-gt)) as sfp, sum((1-prob)*gt) as sfn, count(*) as n, {_CONF} from px group by image),
 r as (select *, (2*i+1e-6)/(y+p+1e-6) as d, (tp+1e-6)/(tp+fp+1e-6) as pr, (tp+1e-6)/(tp+fn+1e-6) as re from c),
 q as (select image, d as soft_dice, 1-d as dice_loss, (i+1e-6)/(y+p-i+1e-6) as soft_iou, (tp+tn)/n as accuracy, re as sensitivity, (tn+1e-6)/(tn+fp+1e-6) as specificity, d as f1,
  5*pr*re/(4*pr+re+1e-6) as f_beta, (i+1e-6)/(i+0.5*sfp+0.5*sfn+1e-6) as tversky from r)"""
_SCORES = ["soft_dice", "dice_loss", "soft_iou", "accuracy", "sensitivity", "specificity", "f1", "f_beta", "tversky"]


@plan(f"{_IMAGE} select image, {', '.join(f'round({n},6) as {n}' for n in _SCORES)} from q")
def image_metrics(spark, d):
    """M2-M10, per image."""
    return metrics.image_scores(pixels(spark, d)).select("image", *r6(*_SCORES))


@plan(f"{_IMAGE} select {', '.join(f'round(avg({n}),6) as {n}' for n in _SCORES)} from q")
def epoch_metrics(spark, d):
    """Means of the images' scores."""
    return metrics.image_scores(pixels(spark, d)).agg(*(F.round(F.avg(n), 6).alias(n) for n in _SCORES))


@plan(f"with {_P}, c as (select {_CONF} from px), q as (select {_RATIOS} from c) select {_R6} from q")
def micro_metrics(spark, d):
    """Per-image counts, then their sums."""
    per = metrics.confusion(pixels(spark, d), ["image"])
    return per.agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn"))).select(*(F.round(c, 6).alias(n) for n, c in metrics.ratios().items()))


@plan(f"with {_P}, c as (select image, {_CONF} from px group by image), q as (select {_RATIOS} from c) select {', '.join(f'round(avg({n}),6) as {n}' for n in _NAMES)} from q")
def macro_metrics(spark, d):
    """A24."""
    per = metrics.confusion(pixels(spark, d), ["image"]).select(*(c.alias(n) for n, c in metrics.ratios().items()))
    return per.agg(*(F.round(F.avg(n), 6).alias(n) for n in _NAMES))


_SURF = """{n} as (select image, r, c from {m} a where (select count(*) from {m} b where b.image = a.image and abs(b.r-a.r) <= 1 and abs(b.c-a.c) <= 1) < 9)"""
_MASKS = f"with {_P}, t as (select image, r, c from px where gt > 0), p as (select image, r, c from px where prob >= 0.5), {_SURF.format(n='st', m='t')}, {_SURF.format(n='sp', m='p')}"


def _masks(spark, d):
    px = pixels(spark, d)
    return px.where("gt > 0").select("image", "r", "c"), px.where("prob >= 0.5").select("image", "r", "c"), px.select("image").distinct()


@plan(f"""{_MASKS}, a as (select image, count(*) as n, count(*) filter (where exists (select 1 from sp where sp.image = st.image and abs(sp.r-st.r)+abs(sp.c-st.c) <= 1)) as h from st group by image),
 b as (select image, count(*) as n, count(*) filter (where exists (select 1 from st where st.image = sp.image and abs(sp.r-st.r)+abs(sp.c-st.c) <= 1)) as h from sp group by image)
 select i.image, round(case when coalesce(a.n,0)+coalesce(b.n,0) = 0 then 1 else (coalesce(a.h,0)+coalesce(b.h,0))/(coalesce(a.n,0)+coalesce(b.n,0)) end, 6) as nsd from (select distinct image from px) i left join a using (image) left join b using (image)""")
def surface_dice(spark, d):
    """M11, R23."""
    return metrics.surface_dice(*_masks(spark, d)).select("image", F.round("nsd", 6).alias("nsd"))


@plan(f"{_MASKS}, j as (select image, st.r is not null and sp.r is not null as both_ from st full join sp using (image, r, c)) select image, round(avg(cast(both_ as int)),6) as boundary_iou from j group by image")
def boundary_iou(spark, d):
    """M13, R24."""
    return metrics.boundary_iou(*_masks(spark, d)).select("image", F.round("boundary_iou", 6).alias("boundary_iou"))


@plan(f"with {_P} select image, r, c, {', '.join(f'round((b{i}-avg(b{i}) over (partition by image))/greatest(stddev_pop(b{i}) over (partition by image),1e-12),6) as b{i}' for i in (1, 2, 3))} from px")
def band_normalise(spark, d):
    """R12."""
    return metrics.normalise_bands(pixels(spark, d).select("image", "r", "c", "b1", "b2", "b3"), ["b1", "b2", "b3"]).select("image", "r", "c", *r6("b1", "b2", "b3"))


@plan(f"with {_P} select image, round(avg(case when greatest(b1,b2,b3)/255 >= 0.6 and (case when greatest(b1,b2,b3) > 0 then (greatest(b1,b2,b3)-least(b1,b2,b3))/greatest(b1,b2,b3) else 0 end) <= 0.5 then 1 else 0 end),6) as snow from px group by image")
def snow_fraction(spark, d):
    """R5, A30."""
    return pixels(spark, d).groupBy("image").agg(F.round(F.avg(metrics.snow_mask(0.6, 0.5).cast("int")), 6).alias("snow"))


@plan(f"with {_P}, s as (select image % 3 as image, r, c, prob from px) select image, r, c, round(avg(prob),6) as mean, round(avg(prob*(1-prob)),6) as aleatoric, round(avg(prob*prob)-avg(prob)*avg(prob),6) as epistemic from s group by image, r, c")
def sample_uncertainty(spark, d):
    """Images taken as repeated samples of three."""
    return metrics.sample_uncertainty(pixels(spark, d).withColumn("image", F.col("image") % 3)).select("image", "r", "c", *r6("mean", "aleatoric", "epistemic"))


@plan(f"with {_P} select image, round(sum(case when gt > 0 then 1 else 0 end)/(count(*)+1e-6),6) as pos_rate from px group by image")
def positive_rate(spark, d):
    """R22."""
    return pixels(spark, d).groupBy("image").agg(F.round(F.count_if(F.col("gt") > 0) / (F.count("*") + F.lit(1e-6)), 6).alias("pos_rate"))


def _region_sql(steps):
    return f"""with recursive {_P}, t as (select image, r, c, r*1000000+c as k from px where gt > 0), e as (select a.image, a.k as u, b.k as v from t a join t b on a.image = b.image and abs(a.r-b.r) <= 1 and abs(a.c-b.c) <= 1 and abs(a.r-b.r)+abs(a.c-b.c) between 1 and {steps}),
 reach(image, u, v) as (select image, k, k from t union select q.image, q.u, e.v from reach q join e on q.image = e.image and q.v = e.u), g as (select image, u, min(v) as root from reach group by 1, 2),
 n as (select image, u, cast(dense_rank() over (partition by image order by root) as bigint) as label from g)
 select n.image, label, count(*) as area, round(avg(r),6) as cr, round(avg(c),6) as cc, min(r) as r0, max(r)+1 as r1, min(c) as c0, max(c)+1 as c1 from n join t on n.image = t.image and n.u = t.k group by 1, 2"""


def _regions(spark, d, diagonal):
    found = regions.region_table(regions.label_regions(_masks(spark, d)[0], diagonal))
    return found.select("image", "label", "area", *r6("cr", "cc"), "r0", "r1", "c0", "c1")


@plan(_region_sql(2))
def regions_eight(spark, d):
    """R1, R3."""
    return _regions(spark, d, True)


@plan(_region_sql(1))
def regions_four(spark, d):
    """R2, R3."""
    return _regions(spark, d, False)


_GROW = "{n} as (select p.image, p.r, p.c from (select distinct image, r, c from px) p where exists (select 1 from {m} a where a.image = p.image and abs(a.r-p.r)+abs(a.c-p.c) <= 1))"
_WEAR = "{n} as (select p.image, p.r, p.c from (select distinct image, r, c from px) p where not exists (select 1 from px q where q.image = p.image and abs(q.r-p.r)+abs(q.c-p.c) <= 1 and not exists (select 1 from {m} a where a.image = q.image and a.r = q.r and a.c = q.c)))"


@plan(None)
def merged_boxes(spark, d):
    """C9, over boxes padded by a quarter of a metre."""
    b = X.project(spark, d, X.TRUTH)
    padded = b.select("image", F.col("gt_id").alias("id"), *((F.col(c) - 0.25).alias(c) for c in ("x0", "y0")), *((F.col(c) + 0.25).alias(c) for c in ("x1", "y1")))
    return regions.merge_boxes(padded, ["image"], 2.0).select("image", "id", *r6("x0", "y0", "x1", "y1"), "n")


@plan(f"with {_P}, m0 as (select image, r, c from px where prob >= 0.5), {_GROW.format(n='m1', m='m0')}, {_WEAR.format(n='m2', m='m1')}, {_WEAR.format(n='m3', m='m2')}, {_GROW.format(n='m4', m='m3')} select image, r, c from m4")
def smoothed_mask(spark, d):
    """R4."""
    sizes = pixels(spark, d).groupBy("image").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"))
    return regions.smooth(_masks(spark, d)[1], sizes)


@plan(f"with {_P}, e as (select b1, image, quantile_cont(b1,0.02) over (partition by image) as lo, quantile_cont(b1,0.98) over (partition by image) as hi, r, c from px) select image, r, c, round(least(greatest((b1-lo)/(hi-lo),0),1),6) as b1 from e")
def percentile_stretch(spark, d):
    """R18."""
    px = pixels(spark, d)
    edge = px.groupBy("image").agg(F.percentile("b1", F.lit(0.02)).alias("lo"), F.percentile("b1", F.lit(0.98)).alias("hi"))
    v = F.least(F.greatest((F.col("b1") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0))
    return px.join(edge, "image").select("image", "r", "c", F.round(v, 6).alias("b1"))


@plan(f"with {_P}, t as (select image, cast(floor(r/8) as bigint) as tr, cast(floor(c/8) as bigint) as tc, gt from px) select image, tr, tc, count(*) as n, bool_or(gt > 0) as any_pos, avg(gt) >= 0.3 as dense from t group by image, tr, tc")
def patches(spark, d):
    """R13, D10."""
    t = pixels(spark, d).select("image", F.floor(F.col("r") / 8).alias("tr"), F.floor(F.col("c") / 8).alias("tc"), "gt")
    return t.groupBy("image", "tr", "tc").agg(F.count("*").alias("n"), F.bool_or(F.col("gt") > 0).alias("any_pos"), (F.avg("gt") >= F.lit(0.3)).alias("dense"))


@plan(f"with {_L}, c as (select image, seep_id, class, count(*) as n from lab where class <> '' group by 1,2,3) select image, seep_id, class from (select *, row_number() over (partition by image, seep_id order by n desc, class) as k from c) t where k = 1")
def label_mode(spark, d):
    """A11, L5."""
    return labels.mode(packs(spark, d), ["image", "seep_id"], "class")


_FLEISS = """per as (select {i}, {c} as cat, count(*) as n from {t} group by all), it as (select {i}, sum(n) as t, sum(n*(n-1)) as ag from per group by all having sum(n) >= 2),
 ch as (select sum(n) as n from per join it using ({i}) group by cat), s as (select (select count(*) from it) as n_items, (select avg(ag/(t*(t-1))) from it) as pa, (select sum(n*n)/(sum(n)*sum(n)) from ch) as pe)
 select n_items, round(case when pe > 1-1e-12 then 1 else (pa-pe)/(1-pe) end, 6) as kappa from s"""


@plan(f"with {_L}, {_FLEISS.format(i='image, seep_id', c='class', t='lab')}")
def class_kappa(spark, d):
    """L4, M17."""
    return labels.fleiss_kappa(packs(spark, d), ["image", "seep_id"], "class").select("n_items", *r6("kappa"))


_VOTES = """pv as (select a.image, a.seep_id as a, b.seep_id as b, a.grp = b.grp as same from lab a join lab b on a.image = b.image and a.labeler = b.labeler and a.seep_id < b.seep_id
 where a.is_calibration and b.is_calibration)"""


@plan(f"with {_L}, {_VOTES}, {_FLEISS.format(i='image, a, b', c='same', t='pv')}")
def grouping_kappa(spark, d):
    """L3: all pairs of the calibration items of an image."""
    return labels.grouping_kappa(packs(spark, d).where("is_calibration")).select("n_items", *r6("kappa"))


@plan(f"""with recursive {_L}, cal as (select * from lab where is_calibration), e as (select a.image, a.seep_id as u, b.seep_id as v from cal a join cal b on a.image = b.image and a.labeler = b.labeler and a.grp = b.grp and a.seep_id <> b.seep_id group by all having count(distinct a.labeler) >= 2),
 reach(image,u,v) as (select image,u,v from e union select r.image, r.u, e.v from reach r join e on r.image = e.image and r.v = e.u) select i.image, i.seep_id, least(i.seep_id, coalesce(min(v), i.seep_id)) as root from (select distinct image, seep_id from cal) i left join reach on reach.image = i.image and u = i.seep_id group by i.image, i.seep_id""")
def consensus(spark, d):
    """C8, L5."""
    return cluster.consensus_groups(packs(spark, d).where("is_calibration"), 3)


@plan(f"""with {_L}, p as (select x.image || ':' || x.grp as g1, y.image || ':' || y.grp as g2 from lab x join lab y on x.image = y.image and x.seep_id = y.seep_id and x.labeler = 1 and y.labeler = 2), s as (select sum(n*(n-1)/2) as ab, sum(n) as n from (select count(*) as n from p group by g1, g2) t),
 l as (select sum(n*(n-1)/2) as sa from (select count(*) as n from p group by g1) t), r as (select sum(n*(n-1)/2) as sb from (select count(*) as n from p group by g2) t), q as (select ab, sa, sb, n*(n-1)/2 as t from s, l, r)
 select round((ab-sa*sb/t)/((sa+sb)/2-sa*sb/t),6) as ari, round(((t+2*ab-sa-sb)/t-(sa*sb+(t-sa)*(t-sb))/(t*t))/(1-(sa*sb+(t-sa)*(t-sb))/(t*t)),6) as kappa from q""")
def rand_index(spark, d):
    """Two labelers' groups."""
    p = packs(spark, d).selectExpr("image", "seep_id", "labeler", "concat_ws(':', image, grp) as g")
    both = p.where("labeler = 1").withColumnRenamed("g", "g1").drop("labeler").join(p.where("labeler = 2").withColumnRenamed("g", "g2").drop("labeler"), ["image", "seep_id"])
    return labels.rand_scores(both, "g1", "g2").select(*r6("ari", "kappa"))


@plan(f"""with {_L}, k as (select *, row_number() over (partition by image, grp order by area desc, seep_id) as k from lab where labeler = 1 and is_calibration), g as (select a.image, a.grp, max(a.area) as anchor_area, max(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) as reach, max(b.area) as satellite_area
 from k a join k b on a.image = b.image and a.grp = b.grp and a.k = 1 and b.k > 1 group by a.image, a.grp) select round(quantile_cont(anchor_area,0.05),6) as p5_anchor, round(quantile_cont(reach,0.9),6) as p90_reach, round(quantile_cont(satellite_area,0.95),6) as p95_satellite, count(*) as n from g""")
def fitted_parameters(spark, d):
    """A5, A6, L6."""
    g = labels.group_measures(packs(spark, d).where("labeler = 1 and is_calibration"), ["image", "grp"])
    pct = lambda c, p, n: F.round(F.percentile(c, F.lit(p)), 6).alias(n)
    return g.agg(pct("anchor_area", 0.05, "p5_anchor"), pct("reach", 0.9, "p90_reach"), pct("satellite_area", 0.95, "p95_satellite"), F.count("*").alias("n"))


@plan(f"with {_L} select labeler, image, grp, count(distinct nullif(class,'')) as n_classes from lab group by 1,2,3 having count(distinct nullif(class,'')) <> 1")
def label_conflicts(spark, d):
    """L2, P3."""
    return packs(spark, d).groupBy("labeler", "image", "grp").agg(F.count_distinct(F.nullif("class", F.lit(""))).alias("n_classes")).where("n_classes <> 1")


@plan(f"with {_L} select image, seep_id, cast(round_even(avg(is_pregrouped),0) as int) as pregrouped, bool_or(is_pregrouped = 1) as any_pregrouped from lab group by 1,2")
def pregrouped(spark, d):
    """Q15: half-even mean against any."""
    return packs(spark, d).groupBy("image", "seep_id").agg(F.bround(F.avg("is_pregrouped"), 0).cast("int").alias("pregrouped"), F.bool_or(F.col("is_pregrouped") == 1).alias("any_pregrouped"))


_BINS = f"with {_H}, e as (select quantile_cont(length_cm,0.25) as a, quantile_cont(length_cm,0.75) as b from hi)"


@plan(f"{_BINS} select (cast(length_cm >= a as int)+cast(length_cm >= b as int)) as bin, count(*) filter (where type_flux = 'a') as a, count(*) filter (where type_flux = 'b') as b, count(*) filter (where type_flux = 'c') as c from hi, e group by 1")
def strata_crosstab(spark, d):
    """D1, D6, A13."""
    s = selection.strata(hist(spark, d), "length_cm", [0.25, 0.75])
    return s.groupBy("bin").agg(*(F.count_if(F.col("type_flux") == k).alias(k) for k in "abc"))


@plan(f"""with {_H}, c as (select type_flux as t, count(*) as size from hi where type_flux is not null group by 1), b as (select t, size, least(size, floor(100/(count(*) over ()))) as base from c), s as (select *, size-base as room, 100-sum(base) over () as lack, coalesce(sum(size-base) over (order by size desc, t rows between unbounded preceding and 1 preceding),0) as before from b),
 q as (select t, base+greatest(0,least(room,lack-before)) as quota from s) select id, type_flux from (select id, type_flux, row_number() over (partition by type_flux order by (id*7919)%10007, id) as k from hi) r join q on r.type_flux = q.t where k <= quota""")
def stratified_take(spark, d):
    """O8, D2."""
    rows = hist(spark, d).where("type_flux is not null")
    return selection.stratified_take(rows, ["type_flux"], [(F.col("id") * 7919) % 10007, F.col("id")], 100).select("id", "type_flux")


@plan(f"{_BINS}, s as (select id, (cast(length_cm >= a as int)+cast(length_cm >= b as int)) as bin from hi, e), r as (select id, bin, (row_number() over (partition by bin order by (id*7919)%10007, id)-0.5)/count(*) over (partition by bin) as share from s) select id, bin, case when share <= 0.7 then 'train' when share <= 0.85 then 'val' else 'test' end as split from r")
def stratified_split(spark, d):
    """D7."""
    return selection.split(selection.strata(hist(spark, d), "length_cm", [0.25, 0.75]), ["bin"], [(F.col("id") * 7919) % 10007, F.col("id")], 0.7, 0.15).select("id", "bin", "split")


@plan(f"with {_H} select id, cast((row_number() over (partition by type_flux order by (id*7919)%10007, id)-1) % 5 as int) as fold from hi")
def k_folds(spark, d):
    """D8."""
    return selection.folds(hist(spark, d), [(F.col("id") * 7919) % 10007, F.col("id")], ["type_flux"], 5).select("id", "fold")


@plan(f"""with {_S}, r as (select *, cloud*1e6 + abs(date_diff('day', date '2000-01-01', cast(acquired as date)))*1e3 + coalesce(scene_cloud, 100) as rk from sc),
 k as (select *, row_number() over (partition by aoi, strip order by rk, scene, part, price) as n from r)
 select aoi, strip, round(cloud,6) as cloud, round(rk,6) as rank_key, scene from k where n = 1 and cloud <= 0.2""")
def top_scene(spark, d):
    """O4, F29, P22."""
    return selection.top_scene(scenes(spark, d), "2000-01-01", 0.2).select("aoi", "strip", F.round("cloud", 6).alias("cloud"), "rank_key", "scene")


@plan(None)
def scene_cover(spark, d):
    """O6."""
    return selection.greedy_cover(scenes(spark, d).where("cloud <= 0.4"), 0.9, 1, 100)


@plan(f"with {_S} select aoi, scene, part, cloud from (select aoi, scene, part, round(cloud,6) as cloud, row_number() over (partition by aoi order by cloud, acquired, scene, part, price, strip) as k from sc) t where k <= 3")
def scene_candidates(spark, d):
    """The first three of each area, a feature of the operator."""
    w = Window.partitionBy("aoi").orderBy("cloud", "acquired", "scene", "part", "price", "strip")
    return scenes(spark, d).withColumn("k", F.row_number().over(w)).where("k <= 3").select("aoi", "scene", "part", F.round("cloud", 6).alias("cloud"))


@plan(f"""with {_H}, p as (select round(length_cm*width_cm,6) as v, count(*) filter (where type_flux = 'c') as p, count(*) filter (where type_flux <> 'c') as q from hi where type_flux is not null group by 1), r as (select v, lead(v) over (order by v) as nx, sum(p) over (order by v) as pb, sum(q) over (order by v) as qb, sum(p) over () as pt, sum(q) over () as qt from p),
 s as (select (v+nx)/2 as cut, round(((pt-pb)/pt+qb/qt)/2,9) as score from r where nx is not null) select round(cut,6) as cut, round(score,6) as score from s order by score desc, cut limit 1""")
def best_cut(spark, d):
    """O11, L11."""
    rows = hist(spark, d).where("type_flux is not null").withColumn("v", F.round(F.col("length_cm") * F.col("width_cm"), 6))
    return selection.best_cut(rows, "v", F.col("type_flux") == "c").select(*r6("cut", "score"))


_NEAR = f"with ac as ({X.ACQUISITIONS}), ae as (select distinct aoi, t as ta from ac where sensor = 'Aerial'), j as (select ac.aoi, ac.event_id, ac.sensor, ae.ta, date_diff('microsecond', ae.ta, ac.t)/3.6e9 as h, row_number() over (partition by ac.event_id order by abs(date_diff('microsecond', ae.ta, ac.t)), ae.ta) as k from ac left join ae using (aoi) where sensor <> 'Aerial')"


def _near(spark, d):
    a = acq(spark, d)
    return temporal.nearest_asof(a.where("sensor <> 'Aerial'"), a.where("sensor = 'Aerial'").select("aoi", "t"), "aoi", "t", "nearest")


@plan(f"{_NEAR} select event_id, round(h,6) as diff_hours from j where k = 1")
def nearest_acquisition(spark, d):
    """J25."""
    return _near(spark, d).select("event_id", *r6("diff_hours"))


@plan(f"{_NEAR} select sensor, aoi, count(h) as n, round(avg(h),6) as mean_h, round(quantile_cont(h,0.5),6) as median_h, round(min(abs(h)),6) as min_abs, round(max(abs(h)),6) as max_abs from j where k = 1 group by grouping sets ((sensor, aoi), (sensor))")
def acquisition_stats(spark, d):
    """By area and over all areas in one pass."""
    h = F.col("diff_hours")
    g = _near(spark, d).groupingSets([["sensor", "aoi"], ["sensor"]], "sensor", "aoi")
    return g.agg(F.count(h).alias("n"), F.round(F.avg(h), 6).alias("mean_h"), F.round(F.percentile(h, F.lit(0.5)), 6).alias("median_h"), F.round(F.min(F.abs(h)), 6).alias("min_abs"), F.round(F.max(F.abs(h)), 6).alias("max_abs"))


@plan(f"with ac as ({X.ACQUISITIONS}), g as (select aoi, date_diff('microsecond', lag(t) over (partition by aoi order by t, event_id), t)/3.6e9 as h from ac) select aoi, count(h) as n, round(avg(h),6) as mean_gap, round(max(h),6) as max_gap from g group by aoi")
def gap_stats(spark, d):
    """W2, A16."""
    h = F.col("gap_hours")
    return temporal.gaps(acq(spark, d), "aoi", "t", "event_id").groupBy("aoi").agg(F.count(h).alias("n"), F.round(F.avg(h), 6).alias("mean_gap"), F.round(F.max(h), 6).alias("max_gap"))


_NUM = "case when {c} <> -9999 then {c} end"
_PREP = f"""with {_W}, a as (select event_id, ts, {', '.join(f'{_NUM.format(c=c)} as {c}' for c in ('temp', 'dew', 'pressure', 'wind', 'sky', 'wind_dir', 'precip_1h', 'precip_6h'))} from w),
 pr as (select event_id, ts, temp/10.0::double as temp, dew/10.0::double as dew, pressure/10.0::double as pressure, wind/10.0::double as wind, sky,
  coalesce(precip_1h = -1, false) as trace_1h, coalesce(precip_6h = -1, false) as trace_6h, case when precip_1h <> -1 then precip_1h/10.0::double end as precip_1h, case when precip_6h <> -1 then precip_6h/10.0::double end as precip_6h,
  case when wind_dir = 360 then 0 when wind_dir <> 0 then wind_dir end as wind_dir from a)"""


@plan(f"{_PREP} select event_id, temp, dew, pressure, wind, sky, wind_dir, precip_1h, precip_6h, trace_1h, trace_6h from pr")
def weather_prepare(spark, d):
    """P16."""
    return temporal.prepare_weather(weather(spark, d)).select("event_id", "temp", "dew", "pressure", "wind", "sky", "wind_dir", "precip_1h", "precip_6h", "trace_1h", "trace_6h")


_DRY = "temp between 15 and 25 and coalesce(precip_1h,0) = 0"


@plan(f"""{_PREP}, f as (select event_id, {_DRY} and wind > 0 and wind <= 2 and sky in (2,3,4) as perfect,
  {_DRY} and ((wind > 0 and wind <= 2) or wind is null) and (sky in (2,3,4) or sky is null) as not_sure, temp <= 15 as too_cold, temp >= 25 as too_hot, precip_1h > 0 as rain
  from pr where strftime(ts, '%H:%M:%S') between '08:00:00' and '18:00:00')
 select event_id, {', '.join(f'coalesce({c}, false) as {c}' for c in ('perfect', 'not_sure', 'too_cold', 'too_hot', 'rain'))} from f""")
def weather_cases(spark, d):
    """P6, P7, P8."""
    day = temporal.prepare_weather(weather(spark, d)).where(F.date_format("ts", "HH:mm:ss").between("08:00:00", "18:00:00"))
    return day.select("event_id", *(c.alias(n) for n, c in temporal.weather_cases().items()))


_MAGNUS = "6.1094*exp(17.625*{c}/(243.04+{c}))"


@plan(f"""{_PREP}, h as (select event_id, temp, greatest(0, least(100, 100*({_MAGNUS.format(c='dew')})/({_MAGNUS.format(c='temp')}))) as rh from pr where temp is not null),
 b as (select event_id, rh, temp*atan(0.151977*sqrt(rh+8.313659))+atan(temp+rh)-atan(rh-1.676331)+0.00391838*pow(rh,1.5)*atan(0.023101*rh)-4.686035 as wb from h)
 select event_id, round(rh,6) as rh, round(wb,6) as wet_bulb, case when f < 18 then 0 when f < 20 then 1 when f < 23 then 2 when f < 27 then 3 when f < 28 then 4 else 5 end as snow from (select *, round(wb,6)*9/5+32 as f from b) t""")
def wet_bulb(spark, d):
    """F8, F9."""
    rows = temporal.prepare_weather(weather(spark, d)).where("temp is not null")
    rh, wet = temporal.humidity("temp", "dew")
    out = rows.select("event_id", F.round(rh, 6).alias("rh"), F.round(wet, 6).alias("wet_bulb"))
    return out.withColumn("snow", S.digitize(F.col("wet_bulb") * 9 / 5 + 32, [18, 20, 23, 27, 28]))


@plan(f"with {_T} select run, epoch, loss, metric from (select *, row_number() over (partition by run order by loss, epoch) as k from lg) t where k = 1")
def best_epoch(spark, d):
    """A27, E41."""
    return temporal.best_epoch(log(spark, d))


@plan(f"with {_T} select run, epoch, min(loss) over (partition by run order by epoch rows unbounded preceding) as best from lg")
def running_best(spark, d):
    """W7."""
    return temporal.running_best(log(spark, d)).select("run", "epoch", "best")


@plan(f"""with recursive {_T}, f(run, epoch, best, wait, stop) as (select run, epoch, loss, 0, cast(null as bigint) from lg where epoch = 1 union all
 select f.run, lg.epoch, case when lg.loss < f.best - 10 then lg.loss else f.best end, case when lg.loss < f.best - 10 then 0 else f.wait+1 end, case when lg.loss < f.best - 10 then null when f.wait+1 >= 20 then lg.epoch end from f join lg on lg.run = f.run and lg.epoch = f.epoch+1 where f.stop is null)
 select run, max(stop) as stop_epoch from f group by run""")
def early_stop(spark, d):
    """W8."""
    return temporal.early_stop(log(spark, d), 20, 10.0)


@plan(f"""with recursive {_T}, f(run, epoch, best, wait, stop) as (select run, epoch, metric, 0, cast(null as bigint) from lg where epoch = 1 union all
 select f.run, lg.epoch, case when lg.metric - f.best > 1 then lg.metric else f.best end, case when lg.metric - f.best > 1 then 0 else f.wait+1 end, case when lg.metric - f.best > 1 then null when f.wait+1 >= 15 then lg.epoch end
 from f join lg on lg.run = f.run and lg.epoch = f.epoch+1 where f.stop is null) select run, max(stop) as stop_epoch from f group by run""")
def early_stop_max(spark, d):
    """W8, where more is better."""
    return temporal.early_stop(log(spark, d).withColumn("loss", F.col("metric")), 15, 1.0, "max")


@plan(f"with r as ({X.RUNS}) select dataset, arch, count(*) as n, round(avg(iou),6) as iou, round(avg(ln(least(greatest(iou,1e-6),1-1e-6)/(1-least(greatest(iou,1e-6),1-1e-6)))),6) as logit_iou, round(avg(ln(greatest(unc,1e-6))),6) as log_unc from r group by 1,2")
def run_metrics(spark, d):
    """A14, F10."""
    return runs(spark, d).groupBy("dataset", "arch").agg(F.count("*").alias("n"), F.round(F.avg("iou"), 6).alias("iou"), F.round(F.avg(S.logit(F.col("iou"))), 6).alias("logit_iou"), F.round(F.avg(F.ln(F.greatest("unc", F.lit(1e-6)))), 6).alias("log_unc"))


_RK = f"with {_D}, rk as (select sample, grp, row_number() over (partition by sample order by value desc, grp) as rank from dr)"


@plan(f"with {_D} select grp, round(avg(value),6) as mean, round(quantile_cont(value,0.025),6) as low, round(quantile_cont(value,0.975),6) as high from dr group by grp")
def draw_summary(spark, d):
    """B1."""
    return draws.summary(X.draws(spark, d), ["grp"]).select("grp", *r6("mean", "low", "high"))


@plan(f"{_RK} select grp, round(avg(rank),6) as e_rank, round(avg(cast(rank = 1 as int)),6) as p_best, round(avg(cast(rank <= 2 as int)),6) as p_top, quantile_cont(rank,0.025) as rank_low, quantile_cont(rank,0.975) as rank_high from rk group by grp")
def rank_probabilities(spark, d):
    """W5, B4, B12, B20."""
    return draws.rank_probabilities(X.draws(spark, d)).select("grp", *r6("e_rank", "p_best", "p_top"), F.col("rank_low").cast("double").alias("rank_low"), F.col("rank_high").cast("double").alias("rank_high"))


@plan(f"{_RK} select grp, {', '.join(f'round(avg(cast(rank = {k} as int)),6) as p{k}' for k in range(1, 10))} from rk group by grp")
def rank_table(spark, d):
    """B4."""
    return draws.rank_table(X.draws(spark, d), 9).select("grp", *r6(*(f"p{k}" for k in range(1, 10))))


@plan(f"with {_D}, s as (select grp, stddev_samp(value)*pow(count(*),-0.2) as h from dr group by grp) select grp, round(avg(exp(-value*value/(2*h*h)))/(max(h)*sqrt(2*pi())),6) as density from dr join s using (grp) group by grp")
def density_at_zero(spark, d):
    """B2."""
    return draws.density_at_zero(X.draws(spark, d), ["grp"]).select("grp", *r6("density"))


_CELL = f"with {_D}, ce as (select sample, grp // 3 as dataset, grp % 3 as arch, value from dr)"


def _cells(spark, d):
    return X.draws(spark, d).select("sample", F.floor(F.col("grp") / 3).alias("dataset"), (F.col("grp") % 3).alias("arch"), "value")


_SUM = "round(avg(delta),6) as mean, round(quantile_cont(delta,0.025),6) as low, round(quantile_cont(delta,0.975),6) as high, round(avg(cast(delta > 0 as int)),6) as p_pos, round(avg(cast(delta < 0 as int)),6) as p_neg, round(avg(cast(abs(delta) < 0.02 as int)),6) as p_rope"
_CS = ("mean", "low", "high", "p_pos", "p_neg", "p_rope")


@plan(f"{_CELL}, dl as (select a.dataset, a.arch, a.value-b.value as delta from ce a join ce b on a.sample = b.sample and a.dataset = b.dataset and b.arch = 0 and a.arch <> 0) select dataset, arch, {_SUM} from dl group by 1,2")
def arch_contrasts(spark, d):
    """B5, B6."""
    return draws.contrast_summary(draws.contrasts(_cells(spark, d), "arch", ["dataset"], 0), ["dataset", "arch"], 0.02).select("dataset", "arch", *r6(*_CS))


@plan(f"{_CELL}, m as (select sample, dataset, avg(value) as v from ce group by 1,2), dl as (select a.dataset, a.v-b.v as delta from m a join m b on a.sample = b.sample and b.dataset = 0 and a.dataset <> 0) select dataset, {_SUM} from dl group by 1")
def overall_contrasts(spark, d):
    """B9, A34."""
    return draws.contrast_summary(draws.contrasts(_cells(spark, d), "dataset", [], 0), ["dataset"], 0.02).select("dataset", *r6(*_CS))


@plan(f"with {_D}, dl as (select a.grp as a, b.grp as b, a.value-b.value as delta from dr a join dr b on a.sample = b.sample and a.grp < b.grp) select a, b, {_SUM} from dl group by 1,2")
def pairwise_contrasts(spark, d):
    """B19, B22."""
    return draws.contrast_summary(draws.pairwise(X.draws(spark, d)), ["a", "b"], 0.02).select("a", "b", *r6(*_CS))


@plan(f"with {_D}, v as (select sample, grp, 0.75*value/((select stddev_pop(value) from dr)+1e-12) - 0.25*exp(value)/((select stddev_pop(exp(value)) from dr)+1e-12) as value from dr), rk as (select grp, row_number() over (partition by sample order by round(value,9) desc, grp) as rank from v) select grp, round(avg(rank),6) as e_rank, round(avg(cast(rank = 1 as int)),6) as p_best from rk group by grp")
def composite_ranks(spark, d):
    """B10, Q7."""
    one = X.draws(spark, d).withColumn("metric", F.lit("a"))
    both = one.unionByName(one.withColumn("metric", F.lit("b")).withColumn("value", F.exp("value")))
    ranked = draws.composite(both, {"a": 3.0, "b": 1.0}, lower=("b",)).withColumn("value", F.round("value", 9))
    return draws.rank_probabilities(ranked).select("grp", *r6("e_rank", "p_best"))


@plan(f"with {_H} select id, round(pi()/4*length_cm*width_cm,6) as area, case when pi()/4*length_cm*width_cm < 137 then 'A' when pi()/4*length_cm*width_cm < 520 then 'B' else 'C' end as size_class, case when type_flux like 'hs%' then substr(type_flux,3,1) else substr(type_flux,1,1) end as base, coalesce(type_flux like '%p', false) as partial, coalesce(type_flux like 'hs%', false) as hotspot, greatest(length_cm,width_cm) as major from hi")
def size_priors(spark, d):
    """F4-F6, L11."""
    area = S.ellipse_area(F.col("length_cm"), F.col("width_cm"))
    base, partial, hot = S.flux_parts(F.col("type_flux"))
    return hist(spark, d).select("id", F.round(area, 6).alias("area"), S.size_class(area).alias("size_class"), base.alias("base"), partial.alias("partial"), hot.alias("hotspot"), F.greatest("length_cm", "width_cm").alias("major"))


@plan(f"with {_H} select type_flux, count(*) as n, {', '.join(f'round_even(quantile_cont(length_cm*width_cm,{p / 100}),2) as p{p}' for p in (5, 25, 50, 75, 95, 99))} from hi where type_flux is not null group by type_flux")
def class_percentiles(spark, d):
    """A7, P4."""
    v = hist(spark, d).dropna(subset=["type_flux"]).withColumn("v", F.col("length_cm") * F.col("width_cm"))
    points = [5, 25, 50, 75, 95, 99]
    return v.groupBy("type_flux").agg(F.count("*").alias("n"), *labels.percentiles("v", points)).select("type_flux", "n", *(F.bround(f"p{p}", 2).alias(f"p{p}") for p in points))


@plan("select c_custkey, case when c_acctbal % 360 - 180 is not null then cast(case when c_acctbal >= 0 then 32600 else 32700 end + floor(((c_custkey % 360 - 180)+180)/6)+1 as int) end as epsg, coalesce(nullif(trim(c_mktsegment),''),'none') as segment, cast(floor(c_custkey/3600) as bigint) as hours, regexp_replace('val_' || c_mktsegment, '^val_', '') as metric from customer")
def scalar_catalogue(spark, d):
    """F13, F17, F19."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    return c.select("c_custkey", S.utm_epsg(F.col("c_custkey") % 360 - 180, F.col("c_acctbal")).alias("epsg"), S.safe_string(F.col("c_mktsegment"), "none").alias("segment"), F.floor(F.col("c_custkey") / 3600).alias("hours"), S.base_metric(F.concat(F.lit("val_"), "c_mktsegment")).alias("metric"))


@plan("select n.n_name, r.r_name, count(s.s_suppkey) as suppliers, count(c.cust) as customers from nation n join region r on n_regionkey = r_regionkey left join supplier s on s_nationkey = n_nationkey left join (select c_nationkey, count(*) as cust from customer group by 1) c on c.c_nationkey = n_nationkey group by 1,2")
def joins(spark, d):
    """Equi joins, inner and left."""
    t = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("nation", "region", "supplier", "customer")}
    cust = t["customer"].groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("cust"))
    j = t["nation"].join(t["region"], t["nation"].n_regionkey == t["region"].r_regionkey).join(t["supplier"].withColumnRenamed("s_nationkey", "n_nationkey"), "n_nationkey", "left").join(cust, "n_nationkey", "left")
    return j.groupBy("n_name", "r_name").agg(F.count("s_suppkey").alias("suppliers"), F.count("cust").alias("customers"))


@plan("select o_custkey as k, 'both' as side from orders intersect select c_custkey, 'both' from customer union all select c_custkey, 'none' from customer where c_custkey not in (select o_custkey from orders)")
def set_operations(spark, d):
    """Intersection, union by name, anti join."""
    o, c = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("k")), spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("k"))
    return o.intersect(c).withColumn("side", F.lit("both")).unionByName(c.join(o, "k", "left_anti").withColumn("side", F.lit("none")))


@plan("with a as (select l_orderkey as k, sum(l_quantity) as q from lineitem where l_linenumber % 2 = 0 group by 1), b as (select l_orderkey as k, sum(l_quantity) as q from lineitem where l_linenumber % 2 = 1 group by 1) select coalesce(a.k,b.k) as k, round(coalesce(a.q,0)-coalesce(b.q,0),6) as diff from a full join b on a.k = b.k")
def aligned_difference(spark, d):
    """Outer alignment and difference."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    side = lambda odd, n: li.where(F.col("l_linenumber") % 2 == odd).groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_quantity").alias(n))
    return side(0, "a").join(side(1, "b"), "k", "full_outer").select("k", F.round(F.coalesce("a", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)), 6).alias("diff"))


@plan(f"with {_S} select aoi, row_number() over (partition by aoi order by scene, part, price, strip) as aoi_idx, scene, part, price from sc")
def numbered_targets(spark, d):
    """W1, O1."""
    w = Window.partitionBy("aoi").orderBy("scene", "part", "price", "strip")
    return scenes(spark, d).select("aoi", F.row_number().over(w).alias("aoi_idx"), "scene", "part", "price")


@plan("select o_custkey, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as k from orders) t where k = 1")
def latest_row(spark, d):
    """One row of each key by a total order."""
    return argbest(spark.read.parquet(f"{d}/orders.parquet"), ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")
