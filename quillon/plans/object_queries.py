"""Queries on regions, groups of objects, consolidated labels, samples of patches and parameter sweeps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon import fixtures as X
from quillon.operators import cluster, grouping, labels, matching, metrics, regions, selection, spatial
from quillon.plans.analytics_queries import _region_sql
from quillon.plans.base import catalogue, ctes, on, r6
from quillon.plans.spatial_queries import _A1, _C1, _C2, ANCHOR, CAP, MAX_HALO, R_HALO, R_IN, RADIUS

PLANS, plan = catalogue()
bubbles, truth, packs, areas, pixels, hist, scenes, log = (on(s) for s in (X.BUBBLES, X.TRUTH, X.LABELS, X.AREAS, X.PIXELS, X.HISTORICAL, X.SCENES, X.TRAIN_LOG))
_P, _L = ctes(px=X.PIXELS), ctes(lab=X.LABELS)
_REG = _region_sql(2).rsplit("\n select n.image", 1)[0] + ", reg as (select n.image, label, r, c from n join t on n.image = t.image and n.u = t.k)"
_SIZES = "sz as (select image, max(r)+1 as rows, max(c)+1 as cols from px group by 1)"


def _sizes(spark, d):
    return pixels(spark, d).groupBy("image").agg((F.max("r") + 1).alias("rows"), (F.max("c") + 1).alias("cols"))


def _labelled(spark, d):
    return regions.label_regions(pixels(spark, d).where("gt > 0").select("image", "r", "c"))


@plan(f"""{_REG}, bo as (select * from reg a where (select count(*) from reg b where b.image = a.image and b.label = a.label and abs(b.r-a.r)+abs(b.c-a.c) = 1) < 4),
 nb as (select a.image, a.label, count(*) filter (where abs(b.r-a.r)+abs(b.c-a.c) = 1) as s, count(*) filter (where abs(b.r-a.r) = 1 and abs(b.c-a.c) = 1) as d from bo a left join bo b on a.image = b.image and a.label = b.label and abs(a.r-b.r) <= 1 and abs(a.c-b.c) <= 1 group by a.image, a.label, a.r, a.c),
 pe as (select image, label, sum(case when s in (2,3) and d <= 2 then 1 when (s = 0 and d = 2) or (s = 1 and d = 3) then sqrt(2) when s = 1 and d in (1,2) then (1+sqrt(2))/2 else 0 end) as p from nb group by 1, 2),
 mo as (select image, label, count(*) as area, (var_pop(r)+var_pop(c))/2 as h, sqrt(4*covar_pop(r,c)*covar_pop(r,c)+(var_pop(r)-var_pop(c))*(var_pop(r)-var_pop(c)))/2 as q from reg group by 1, 2)
 select image, label, area, round(p,6) as perimeter, round(4*pi()*area/(greatest(p,1e-9)*greatest(p,1e-9)),3) as circularity, round(case when h+q > 0 then sqrt(greatest(1-(h-q)/(h+q),0)) else 0 end,6) as eccentricity from mo join pe using (image, label)""")
def region_shapes(spark, d):
    """Perimeter, circularity and eccentricity of regions."""
    out = regions.shapes(_labelled(spark, d), ["image", "label"])
    return out.select("image", "label", "area", F.round("perimeter", 6).alias("perimeter"), F.round("circularity", 3).alias("circularity"), F.round("eccentricity", 6).alias("eccentricity"))


@plan(None)
def region_hulls(spark, d):
    """Convex hull and solidity of regions; the hull is a numpy kernel, unit-tested."""
    r = _labelled(spark, d)
    hull = regions.hull_areas(r, ["image", "label"])
    return r.groupBy("image", "label").agg(F.count("*").alias("area")).join(hull, ["image", "label"]).withColumn("solidity", F.col("area") / F.col("hull"))


@plan(f"""{_REG}, gg as (select distinct image, label // 3 as grp, r, c from reg), ed as (select g.image, g.grp, count(*) as perimeter from gg g, (values (0,1),(1,0),(0,-1),(-1,0)) m(dr,dc) where not exists (select 1 from gg h where h.image = g.image and h.grp = g.grp and h.r = g.r+dr and h.c = g.c+dc) group by 1, 2),
 aa as (select image, grp, count(*) as area from gg group by 1, 2), kk as (select image, grp, count(distinct label) as n from (select image, label, label // 3 as grp from reg) q group by 1, 2) select image, grp, area, perimeter, n from aa join ed using (image, grp) join kk using (image, grp)""")
def dissolved_groups(spark, d):
    """A2-A4: unions of groups of regions."""
    r = _labelled(spark, d).withColumn("grp", F.floor(F.col("label") / 3))
    return regions.dissolve(r, ["image"], "grp").join(r.groupBy("image", "grp").agg(F.count_distinct("label").alias("n")), ["image", "grp"])


@plan(f"""with {_L}, c as (select image, grp, class, count(*) as n from lab where labeler = 1 and class <> '' group by 1, 2, 3), m as (select image, grp, class, row_number() over (partition by image, grp order by n desc, class) as k from c)
 select l.image, l.grp, max(m.class) as class, max(is_pregrouped) as is_pregrouped, count(*) as n, round(sum(area),6) as area, round(sum(x*area)/sum(area),6) as cx from lab l left join m on l.image = m.image and l.grp = m.grp and m.k = 1 where labeler = 1 group by 1, 2""")
def dissolved_seeps(spark, d):
    """A2: what a dissolved group takes from its members: majority class, any flag, count and weighted means."""
    one = packs(spark, d).where("labeler = 1")
    sums = one.groupBy("image", "grp").agg(F.max("is_pregrouped").alias("is_pregrouped"), F.count("*").alias("n"), F.round(F.sum("area"), 6).alias("area"), F.round(F.sum(F.col("x") * F.col("area")) / F.sum("area"), 6).alias("cx"))
    return sums.join(labels.mode(one, ["image", "grp"], "class"), ["image", "grp"], "left")


@plan(f"""{_REG}, f as (select image, r, c from px where prob >= 0.7), s as (select reg.image, label, avg(case when f.r is null then 0 else 1 end) as rate from reg left join f on f.image = reg.image and f.r = reg.r and f.c = reg.c group by 1, 2)
 select reg.image, reg.label, r, c from reg join s on reg.image = s.image and reg.label = s.label where rate <= 0.5""")
def regions_without_snow(spark, d):
    """Regions of which at most half is flagged."""
    return regions.drop_by_share(_labelled(spark, d), pixels(spark, d).where("prob >= 0.7"), 0.5).select("image", "label", "r", "c")


@plan(f"with {_P}, m as (select image, r, c from px where prob >= 0.8), p as (select distinct image, r, c from px) select p.image, p.r, p.c from p where exists (select 1 from m where m.image = p.image and abs(m.r-p.r)+abs(m.c-p.c) <= 2)")
def grown_mask(spark, d):
    """A mask dilated twice."""
    return regions.grow(pixels(spark, d).where("prob >= 0.8"), _sizes(spark, d), 2)


@plan(f"{_REG} select image, r, c, label % 4 as cluster_id from reg")
def remapped_labels(spark, d):
    """Pixels of regions with their clusters' numbers, by a lookup table."""
    r = _labelled(spark, d)
    table = r.select("image", "label").distinct().withColumn("cluster_id", F.col("label") % 4)
    return r.join(table, ["image", "label"]).select("image", "r", "c", "cluster_id")


@plan(f"""with {ctes(gt=X.TRUTH)}, b as (select image, gt_id, x0, y0, x1, y1 from gt), p as (select image, gt_id, unnest(range(cast(ceil(y0/0.1-0.5) as bigint), cast(ceil(y1/0.1-0.5) as bigint))) as r, x0, x1 from b),
 q as (select image, gt_id, r, unnest(range(cast(ceil(x0/0.1-0.5) as bigint), cast(ceil(x1/0.1-0.5) as bigint))) as c from p) select image, r, c, max(gt_id) as id from q group by 1, 2, 3""")
def rasterized_boxes(spark, d):
    """Boxes as pixels, by their centres."""
    return regions.rasterize(truth(spark, d), "gt_id", 0.1)


@plan(f"with {_P} select image, r // 4 as br, c // 4 as bc, round(avg(case when gt > 0 then 0 else b1*2 end),6) as v from px group by 1, 2, 3")
def block_averages(spark, d):
    """A band with a mask set to zero, scaled and averaged by blocks."""
    px = pixels(spark, d)
    v = F.when(F.col("gt") > 0, 0.0).otherwise(F.col("b1") * 2)
    return px.groupBy("image", F.floor(F.col("r") / 4).alias("br"), F.floor(F.col("c") / 4).alias("bc")).agg(F.round(F.avg(v), 6).alias("v"))


_STARTS = f"{_SIZES}, st as (select image, unnest(case when rows <= 8 then [0::bigint] else range(0, rows-8, 4) end) as pr, cols from sz), gr as (select image, pr, unnest(case when cols <= 8 then [0::bigint] else range(0, cols-8, 4) end) as pc from st)"


@plan(f"with {_P}, {_STARTS} select gr.image, pr, pc, count(*) as n, cast(sum(gt) as bigint) as n_pos from gr join px on px.image = gr.image and r >= pr and r < pr+8 and c >= pc and c < pc+8 group by 1, 2, 3")
def grid_patches(spark, d):
    """Patches of a sliding grid; a pixel finds its patches by their starts."""
    px = pixels(spark, d).select("image", "r", "c", "gt")
    own = lambda c: F.explode(F.transform(F.array(F.lit(0), F.lit(1)), lambda i: (F.floor(F.col(c) / 4) - i) * 4))
    met = px.withColumn("pr", own("r")).withColumn("pc", own("c"))
    return met.join(regions.patch_starts(_sizes(spark, d), 8, 4), ["image", "pr", "pc"]).groupBy("image", "pr", "pc").agg(F.count("*").alias("n"), F.sum("gt").cast("long").alias("n_pos"))


@plan(f"with {_P}, {_STARTS}, m as (select px.image, r, c, prob*(1+0.1*((pr+pc) % 3)) as prob from gr join px on px.image = gr.image and r >= pr and r < pr+8 and c >= pc and c < pc+8) select image, r, c, round(least(greatest(sum(prob)/count(*),0),1),6) as prob from m group by 1, 2, 3")
def sliding_mosaic(spark, d):
    """The mean of overlapping patches' predictions."""
    px = pixels(spark, d).select("image", "r", "c", "prob")
    own = lambda c: F.explode(F.transform(F.array(F.lit(0), F.lit(1)), lambda i: (F.floor(F.col(c) / 4) - i) * 4))
    met = px.withColumn("pr", own("r")).withColumn("pc", own("c")).join(regions.patch_starts(_sizes(spark, d), 8, 4), ["image", "pr", "pc"])
    return regions.mosaic(met.withColumn("prob", F.col("prob") * (1 + F.lit(0.1) * ((F.col("pr") + F.col("pc")) % 3)))).select("image", "r", "c", *r6("prob"))


@plan(f"with {_P} select image, r, c, round(prob,6) as z from px where r % 5 = 0 and c % 5 = 0 and prob > 0.05")
def point_cloud(spark, d):
    """Every fifth pixel with a value."""
    return pixels(spark, d).where("r % 5 = 0 and c % 5 = 0 and prob > 0.05").select("image", "r", "c", F.round("prob", 6).alias("z"))


@plan(f"with {_P} select round(sum(prob) filter (where prob < 0.9)/count(*) filter (where prob < 0.9),6) as valid_mean, round(sum(prob) filter (where prob < 0.9)/count(*),6) as all_mean from px")
def mean_uncertainty(spark, d):
    """The mean over valid pixels of all rasters, and the compatible one over all pixels."""
    v = F.when(F.col("prob") < 0.9, F.col("prob"))
    return pixels(spark, d).agg(F.round(F.avg(v), 6).alias("valid_mean"), F.round(F.sum(v) / F.count("*"), 6).alias("all_mean"))


@plan(f"with {_P}, t as (select image, avg(gt) as f from px group by image, r // 8, c // 8) select round(avg(f),6) as mean, round(quantile_cont(f,0.5),6) as median, round(quantile_cont(f,0.9),6) as p90, round(avg(cast(f = 0 as int)),6) as empty from t")
def patch_audit(spark, d):
    """How positive patches are."""
    t = pixels(spark, d).groupBy("image", F.floor(F.col("r") / 8), F.floor(F.col("c") / 8)).agg(F.avg("gt").alias("f"))
    return t.agg(F.round(F.avg("f"), 6).alias("mean"), *(F.round(F.percentile("f", F.lit(q)), 6).alias(n) for n, q in (("median", 0.5), ("p90", 0.9))), F.round(F.avg((F.col("f") == 0).cast("int")), 6).alias("empty"))


@plan(f"""with {_P}, {_SIZES}, t as (select image, r, c from px where gt > 0), p as (select image, r, c from px where prob >= 0.5),
 st as (select * from t a where (select count(*) from t b where b.image = a.image and abs(b.r-a.r) <= 1 and abs(b.c-a.c) <= 1) < 9), sp as (select * from p a where (select count(*) from p b where b.image = a.image and abs(b.r-a.r) <= 1 and abs(b.c-a.c) <= 1) < 9),
 dp as (select a.image, sqrt(min((a.r-b.r)*(a.r-b.r)+(a.c-b.c)*(a.c-b.c))) as d from sp a join st b on a.image = b.image group by a.image, a.r, a.c), dt as (select a.image, sqrt(min((a.r-b.r)*(a.r-b.r)+(a.c-b.c)*(a.c-b.c))) as d from st a join sp b on a.image = b.image group by a.image, a.r, a.c),
 x as (select image, avg(d) as m, quantile_cont(d, 0.95) as q from dp group by 1), y as (select image, avg(d) as m, quantile_cont(d, 0.95) as q from dt group by 1)
 select sz.image, round((x.m+y.m)/2,6) as assd, round(greatest(x.q,y.q),6) as hd95 from sz join x using (image) join y using (image)""")
def surface_distances(spark, d):
    """Mean surface distance and 95th percentile Hausdorff distance; empty masks are unit-tested."""
    px = pixels(spark, d)
    return metrics.hausdorff(px.where("gt > 0").select("image", "r", "c"), px.where("prob >= 0.5").select("image", "r", "c"), _sizes(spark, d)).select("image", *r6("assd", "hd95"))


def _rule_pairs(spark, d):
    b = cluster.anchor_cluster(bubbles(spark, d), ANCHOR, RADIUS, CAP).select("image", F.col("bubble_id").alias("seep_id"), F.concat_ws(":", "image", "cluster_id").alias("rule"))
    lab = packs(spark, d).where("labeler = 1").select("image", "seep_id", F.concat_ws(":", "image", "grp").alias("human"), F.col("class").alias("hclass"))
    return lab.join(b, ["image", "seep_id"])


_PAIRS = f"with {_C1}, {_L}, pa as (select l.image || ':' || l.grp as human, c1.image || ':' || c1.cluster_id as rule, l.class as hclass from lab l join c1 on l.image = c1.image and l.seep_id = c1.bubble_id where labeler = 1)"


@plan(f"""{_PAIRS}, o as (select human, min(hclass) as hclass, count(distinct rule) as n from pa group by 1), m as (select distinct human, rule from pa), k as (select rule, count(*) as humans, array_to_string(list_sort(list(distinct o.hclass)),'+') as classes, count(distinct o.hclass) as nc from m join o using (human) group by 1)
 select 'fragmented' as kind, hclass as classes, count(*) as n, cast(sum(n-1) as bigint) as extra from o where n > 1 group by 2 union all select case when nc > 1 then 'cross' else 'within' end, classes, count(*), 0 from k where humans > 1 group by 1, 2""")
def grouping_errors(spark, d):
    """A rule's errors against a labeler's groups."""
    return grouping.error_decomposition(_rule_pairs(spark, d))


@plan(f"""{_PAIRS}, c as (select rule, hclass, count(*) as n from pa group by 1, 2), m as (select rule, hclass from (select *, row_number() over (partition by rule order by n desc, hclass) as k from c) t where k = 1), x as (select count(*) filter (where hclass = 'A') as a, count(*) filter (where hclass = 'B') as b, count(*) filter (where hclass = 'C') as c from m),
 h as (select human, min(hclass) as hclass from pa group by 1), y as (select count(*) filter (where hclass = 'A') as a, count(*) filter (where hclass = 'B') as b, count(*) filter (where hclass = 'C') as c from h) select x.a as n_a, x.b as n_b, x.c as n_c, x.a+8.0::double*x.b+25.0::double*x.c as flux, round(100.0::double*((x.a+8*x.b+25*x.c)-(y.a+8*y.b+25*y.c))/(y.a+8*y.b+25*y.c),6) as error from x, y""")
def flux_error(spark, d):
    """Class counts of a rule's groups, their flux, and its error against the labeler's groups."""
    p, rates = _rule_pairs(spark, d), {"A": 1.0, "B": 8.0, "C": 25.0}
    ours = labels.mode(p, ["rule"], "hclass").agg(*(F.count_if(F.col("hclass") == k).alias(f"n_{k.lower()}") for k in rates))
    human = p.groupBy("human").agg(F.min("hclass").alias("hclass")).agg(*(F.count_if(F.col("hclass") == k).alias(f"h_{k.lower()}") for k in rates))
    f = lambda s: grouping.flux({k: F.col(f"{s}_{k.lower()}") for k in rates}, rates)
    return ours.crossJoin(human).select("n_a", "n_b", "n_c", f("n").alias("flux"), F.round(100 * (f("n") - f("h")) / f("h"), 6).alias("error"))


@plan(f"""{_C2}, z as (select image, cluster_id, count(*) as n, bool_or(lonely_pass) as lonely from c2 group by 1, 2), a as (select count(*) as n_bubbles, count(*) filter (where is_anchor) as n_anchors, count(*) filter (where not is_anchor and cluster_id <> bubble_id) as n_satellites, count(*) filter (where not is_anchor and area > {CAP!r}) as n_medium from c2)
 select a.*, (select count(*) from z) as n_clusters, (select count(*) from z where n = 1) as n_singletons, (select count(*) from z where lonely) as n_lonely, cast((select coalesce(sum(n),0) from z where lonely) as bigint) as n_lonely_members, (select count(*) from z where n > 1 and not lonely) as n_anchor_multi from a""")
def cluster_summary(spark, d):
    """A29."""
    return grouping.summary(cluster.lonely_cluster(cluster.anchor_cluster(bubbles(spark, d), ANCHOR, RADIUS, CAP), R_IN, R_HALO, MAX_HALO))


@plan(f"with {_P}, f as (select image, 100*avg(gt) as v, case image % 3 when 0 then 'train' else 'val' end as split from px group by image), n(split) as (values ('train'), ('val'), ('test')) select n.split, count(v) as n, round(coalesce(avg(v),0),6) as mean, round(coalesce(median(v),0),6) as median, round(coalesce(stddev_pop(v),0),6) as std, round(coalesce(min(v),0),6) as lo, round(coalesce(max(v),0),6) as hi from n left join f using (split) group by 1")
def set_summary(spark, d):
    """Positive rates of the sets, zeros for an empty one."""
    f = pixels(spark, d).groupBy("image").agg((100 * F.avg("gt")).alias("v")).withColumn("split", F.when(F.col("image") % 3 == 0, "train").otherwise("val"))
    names = spark.createDataFrame([("train",), ("val",), ("test",)], "split string")
    zero = lambda c, n: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(n)
    return names.join(f, "split", "left").groupBy("split").agg(F.count("v").alias("n"), zero(F.avg("v"), "mean"), zero(F.percentile("v", F.lit(0.5)), "median"), zero(F.stddev_pop("v"), "std"), zero(F.min("v"), "lo"), zero(F.max("v"), "hi"))


@plan(f"with {ctes(hi=X.HISTORICAL)} select type_flux, count(*) as n, round(avg(length_cm),6) as mean, round(stddev_samp(length_cm),6) as std, min(length_cm) as lo, round(quantile_cont(length_cm,0.25),6) as q25, round(quantile_cont(length_cm,0.5),6) as q50, round(quantile_cont(length_cm,0.75),6) as q75, max(length_cm) as hi from hi group by 1")
def value_counts(spark, d):
    """Counts with missing labels, and the description of a column."""
    q = [F.round(F.percentile("length_cm", F.lit(p / 100)), 6).alias(f"q{p}") for p in (25, 50, 75)]
    return hist(spark, d).groupBy("type_flux").agg(F.count("*").alias("n"), F.round(F.avg("length_cm"), 6).alias("mean"), F.round(F.stddev_samp("length_cm"), 6).alias("std"), F.min("length_cm").alias("lo"), *q, F.max("length_cm").alias("hi"))


@plan("with e as (select quantile_cont(length_cm,0.25) as a, quantile_cont(length_cm,0.5) as b, quantile_cont(length_cm,0.75) as c, min(length_cm) as lo, max(length_cm) as hi from ({0}) h) select count(*) filter (where length_cm between lo and a) as n1, count(*) filter (where length_cm between a and b) as n2, count(*) filter (where length_cm between b and c) as n3, count(*) filter (where length_cm between c and hi) as n4 from ({0}) h, e".format(X.HISTORICAL))
def quartile_bins(spark, d):
    """Counts in quartile bins that are closed at both ends, so that edges count twice."""
    h, v = hist(spark, d), F.col("length_cm")
    e = h.agg(F.percentile("length_cm", F.array(*(F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("q"))
    return h.crossJoin(F.broadcast(e)).agg(*(F.count_if(v.between(F.col("q")[i], F.col("q")[i + 1])).alias(f"n{i + 1}") for i in range(4)))


@plan("select aoi, cast(acquired as date) as day, string_agg(part || ':' || first_cell, ' ' order by scene, part, first_cell, strip, price) as line from ({0}) s group by 1, 2".format(X.SCENES))
def day_lines(spark, d):
    """A day's points in order, as one line."""
    s = scenes(spark, d).groupBy("aoi", F.col("acquired").cast("date").alias("day")).agg(F.array_sort(F.collect_list(F.struct("scene", "part", "first_cell", "strip", "price"))).alias("p"))
    return s.select("aoi", "day", F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["part"], x["first_cell"])), " ").alias("line"))


@plan(f"with {ctes(gt=X.TRUTH)} select image, round(min(x0)-1,6) as x0, round(min(y0)-1,6) as y0, round(max(x1)+1,6) as x1, round(max(y1)+1,6) as y1 from gt group by 1")
def padded_bounds(spark, d):
    """Bounds of an image's objects, padded by a metre."""
    return truth(spark, d).groupBy("image").agg(*(F.round(F.min(c) - 1, 6).alias(c) for c in ("x0", "y0")), *(F.round(F.max(c) + 1, 6).alias(c) for c in ("x1", "y1")))


@plan(f"with {_L} select l.image, l.seep_id, lag(l.seep_id) over (partition by image order by seep_id) as before, dense_rank() over (partition by image order by f) as number from (select *, min(seep_id) over (partition by image, grp) as f from lab where labeler = 1) l")
def renumbered_groups(spark, d):
    """Groups numbered by their first appearance."""
    one = packs(spark, d).where("labeler = 1").select("image", "seep_id", "grp")
    out = grouping.renumber(one, ["image"], ["grp"], "seep_id", "number")
    return out.select("image", "seep_id", F.lag("seep_id").over(Window.partitionBy("image").orderBy("seep_id")).alias("before"), "number")


@plan(f"""with recursive {_L}, cal as (select * from lab where is_calibration), e as (select a.image, a.seep_id as u, b.seep_id as v from cal a join cal b on a.image = b.image and a.labeler = b.labeler and a.grp = b.grp and a.seep_id <> b.seep_id group by all having count(distinct a.labeler) >= 2),
 reach(image,u,v) as (select image,u,v from e union select r.image, r.u, e.v from reach r join e on r.image = e.image and r.v = e.u), ro as (select i.image, i.seep_id, least(i.seep_id, coalesce(min(v), i.seep_id)) as root from (select distinct image, seep_id from cal) i left join reach on reach.image = i.image and u = i.seep_id group by 1, 2),
 mc as (select image, seep_id, class from (select *, row_number() over (partition by image, seep_id order by n desc, class) as k from (select image, seep_id, class, count(*) as n from cal where class <> '' group by 1,2,3) c) t where k = 1),
 al as (select ro.image, ro.seep_id, 0 as src, root as g, coalesce(class,'') as class, (select cast(round_even(avg(is_pregrouped),0) as int) from cal where cal.image = ro.image and cal.seep_id = ro.seep_id) as pre from ro left join mc using (image, seep_id)
  union all select image, seep_id, labeler, grp, class, is_pregrouped from (select *, row_number() over (partition by image, seep_id order by labeler, grp, class) as k from lab where not is_calibration) u where k = 1),
 f as (select *, min(case when src > 0 then 1000000 else 0 end + seep_id) over (partition by image, src, g) as f from al) select image, seep_id, class, cast(pre as int) as is_pregrouped, dense_rank() over (partition by image order by f) as seep_group_id from f""")
def consolidated_labels(spark, d):
    """Consensus of the calibration items, the others as they are, and groups renumbered."""
    return grouping.consolidate(packs(spark, d), 3).select("image", "seep_id", "class", "is_pregrouped", "seep_group_id")


@plan(f"with {ctes(gt=X.TRUTH, pr=X.PREDICTED)} select image, gt_id from gt where image in (select image from pr where pred_id < 100000 and image % 2 = 0)")
def exported_truth(spark, d):
    """Objects of the images that have predictions."""
    p = X.project(spark, d, X.PREDICTED).where("pred_id < 100000 and image % 2 = 0").select("image").distinct()
    return truth(spark, d).join(p, "image", "left_semi").select("image", "gt_id")


@plan(f"""with {_L}, a as (select distinct image, seep_id from lab where labeler = 1), m as (select l.image, l.seep_id, l.class as x, k.class as y from lab l join lab k on l.image = k.image and l.seep_id = k.seep_id and l.labeler = 1 and k.labeler = 2 where l.class <> '' and k.class <> '') select count(*) as n, round(avg(cast(x = y as int)),6) as agreement from m""")
def class_agreement(spark, d):
    """How often two labelers give a clean pair one class."""
    lab = packs(spark, d).where("class <> ''")
    a, b = (lab.where(F.col("labeler") == k).select("image", "seep_id", F.col("class").alias(n)) for k, n in ((1, "x"), (2, "y")))
    return a.join(b, ["image", "seep_id"]).agg(F.count("*").alias("n"), F.round(F.avg((F.col("x") == F.col("y")).cast("int")), 6).alias("agreement"))


@plan(f"""with {_L}, f as (select image, seep_id, case when area < 0.005 then 0 when area < 0.02 then 1 when area < 0.05 then 2 else 3 end as bin, area, (seep_id*7919+image*31) % 10007 as h from lab where labeler = 1), c as (select image, seep_id, bin, 'calibration' as role from f where bin = 3),
 r as (select *, row_number() over (partition by bin order by h, image, seep_id) as k from f where bin < 3) select image, seep_id, bin, 'calibration' as role from r where k <= 5 union all select image, seep_id, bin, 'labeler ' || ((k-6) % 2 + 1) from r where k > 5 and k <= 25 union all select * from c""")
def allocated_sets(spark, d):
    """All large items and a few of each size for everyone, and disjoint sets for each of two labelers."""
    f = packs(spark, d).where("labeler = 1").withColumn("bin", F.when(F.col("area") < 0.005, 0).when(F.col("area") < 0.02, 1).when(F.col("area") < 0.05, 2).otherwise(3))
    large = f.where("bin = 3").select("image", "seep_id", "bin", F.lit("calibration").alias("role"))
    r = selection.ranked(f.where("bin < 3"), ["bin"], [(F.col("seep_id") * 7919 + F.col("image") * 31) % 10007, F.col("image"), F.col("seep_id")]).where("k <= 25")
    role = F.when(F.col("k") <= 5, "calibration").otherwise(F.concat(F.lit("labeler "), ((F.col("k") - 6) % 2 + 1).cast("string")))
    return large.unionByName(r.select("image", "seep_id", "bin", role.alias("role")))


@plan(f"""with {_L}, o as (select * from lab where labeler = 1), m as (select image, median(x) as mx, median(y) as my from o group by 1), q as (select o.*, x >= mx and y >= my as member from o join m using (image)), b as (select image, min(x)-1 as x0, max(x)+1 as x1, min(y)-1 as y0, max(y)+1 as y1 from q where member group by 1)
 select q.image, seep_id, member from q join b using (image) where member or (x between x0 and x1 and y between y0 and y1)""")
def quarter_pack(spark, d):
    """A quadrant's items, and the context within a metre of their bounds that is not theirs."""
    o = packs(spark, d).where("labeler = 1")
    mid = o.groupBy("image").agg(F.percentile("x", F.lit(0.5)).alias("mx"), F.percentile("y", F.lit(0.5)).alias("my"))
    q = o.join(mid, "image").withColumn("member", (F.col("x") >= F.col("mx")) & (F.col("y") >= F.col("my")))
    box = q.where("member").groupBy("image").agg((F.min("x") - 1).alias("x0"), (F.max("x") + 1).alias("x1"), (F.min("y") - 1).alias("y0"), (F.max("y") + 1).alias("y1"))
    return q.join(box, "image").where("member or (x between x0 and x1 and y between y0 and y1)").select("image", "seep_id", "member")


@plan(f"""with {ctes(gt=X.TRUTH)}, s as (select image, i, j, i*0.5::double as x0, j*0.5::double as y0 from (select distinct image from gt) t, range(40) a(i), range(40) b(j)), f as (select * from s where not exists (select 1 from gt where gt.image = s.image and least(gt.x1, s.x0+0.5) > greatest(gt.x0, s.x0) and least(gt.y1, s.y0+0.5) > greatest(gt.y0, s.y0)))
 select image, x0, y0 from (select *, row_number() over (partition by image order by (i*7919+j*104729) % 10007, i, j) as k from f) t where k <= 5""")
def negative_boxes(spark, d):
    """Boxes that meet no object and each other not."""
    gt = truth(spark, d)
    sizes = gt.select("image").distinct().withColumn("width", F.lit(20.0)).withColumn("height", F.lit(20.0))
    return regions.place_boxes(sizes, gt, 0.5, 5, 1.0).select("image", "x0", "y0")


@plan(f"with {ctes(gt=X.TRUTH, ar=X.AREAS)} select gt.image, gt_id, area_id, case when area_id % 2 = 0 then 'train' else 'val' end as split, round(gt.area,6) as area, round(sqrt(gt.area/pi()),6) as radius, cast(round_even(sqrt(gt.area/pi())/0.05,0) as int) as radius_px from gt join ar on gt.image = ar.image and gt.x0 >= ar.x0 and gt.x1 <= ar.x1 and gt.y0 >= ar.y0 and gt.y1 <= ar.y1")
def focus_chips(spark, d):
    """Objects within areas, with the areas' split and a pseudo-radius in metres and pixels."""
    from quillon.functions.scalars import metres_to_pixels

    hit = spatial.overlap_pairs(truth(spark, d), areas(spark, d), ["image"], 4.0).where("x0 >= r_x0 and x1 <= r_x1 and y0 >= r_y0 and y1 <= r_y1")
    radius = F.sqrt(F.col("area") / F.pi())
    return hit.select("image", "gt_id", F.col("r_area_id").alias("area_id"), F.when(F.col("r_area_id") % 2 == 0, "train").otherwise("val").alias("split"), F.round("area", 6).alias("area"), F.round(radius, 6).alias("radius"), metres_to_pixels(radius, 0.05).alias("radius_px"))


@plan(None)
def positive_boxes(spark, d):
    """Boxes around regions, padded, cut to the image and merged."""
    table = regions.region_table(regions.label_regions(pixels(spark, d).where("gt > 0").select("image", "r", "c"), False)).join(_sizes(spark, d), "image")
    pad = lambda lo, hi, side: (F.greatest(F.col(lo) - 1, F.lit(0)).cast("double"), F.least(F.col(hi) + 1, F.col(side)).cast("double"))
    (y0, y1), (x0, x1) = pad("r0", "r1", "rows"), pad("c0", "c1", "cols")
    boxes = table.where("area >= 2").select("image", F.col("label").alias("id"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
    return regions.merge_boxes(boxes, ["image"], 8.0)


@plan(None)
def learned_groups(spark, d):
    """Pairs held for one group by a forest of the other folds, and their components."""
    b = bubbles(spark, d).withColumn("bright", (F.col("red") + F.col("green") + F.col("blue")) / 3).select("image", "bubble_id", "x", "y", "area", "bright")
    pairs = grouping.pair_features(b, b, 0.6)
    g = cluster.anchor_cluster(bubbles(spark, d), ANCHOR, RADIUS, CAP).select("image", "bubble_id", "cluster_id")
    side = lambda s: g.select("image", F.col("bubble_id").alias(s), F.col("cluster_id").alias(f"g{s}"))
    marked = pairs.join(side("a"), ["image", "a"]).join(side("b"), ["image", "b"]).withColumn("same", (F.col("ga") == F.col("gb")).cast("double"))
    return grouping.learned_groups(marked, 0.5)


@plan(None)
def tree_classes(spark, d):
    """A depth-3 tree of size and brightness, applied where its features are there."""
    rows = bubbles(spark, d).select("image", "bubble_id", F.when(F.col("bubble_id") % 9 != 0, F.col("area")).alias("area"), "red", F.when(F.col("area") < 0.02, "A").when(F.col("area") < 0.05, "B").otherwise("C").alias("cls"))
    return grouping.apply_tree(grouping.class_tree(rows, ["area", "red"], "cls"), rows, ["area", "red"])


@plan("select value, n_clusters, n_multi from (" + " union all ".join(f"select {r!r}::double as value, count(*) as n_clusters, count(*) filter (where n > 1) as n_multi from (with {_C1.replace(f'<= {RADIUS}', f'<= {r}')} select image, cluster_id, count(*) as n from c1 group by 1, 2) t{i}" for i, r in enumerate((0.2, 0.45, 0.9))) + ") q")
def radius_sweep(spark, d):
    """A rule at several values of a parameter."""
    b = bubbles(spark, d)

    def score(radius):
        sizes = cluster.anchor_cluster(b, ANCHOR, radius, CAP).groupBy("image", "cluster_id").agg(F.count("*").alias("n"))
        return sizes.agg(F.count("*").alias("n_clusters"), F.count_if(F.col("n") > 1).alias("n_multi"))

    return grouping.sweep([0.2, 0.45, 0.9], score)


@plan(f"with a as ({_A1}) select image, count(*) as n, round(corr(total_area, n_bubbles),6) as r, round((select corr(total_area, n_bubbles) from a),6) as r_all from a group by 1")
def size_correlation(spark, d):
    """Pearson's r of finite pairs, over all images and in each."""
    f = cluster.cluster_features(cluster.lonely_cluster(cluster.anchor_cluster(bubbles(spark, d), ANCHOR, RADIUS, CAP), R_IN, R_HALO, MAX_HALO)).select("image", F.round("total_area", 6).alias("total_area"), F.col("n_bubbles").cast("double").alias("n_bubbles"))
    all_ = f.agg(matching.pearson("total_area", "n_bubbles").alias("r_all"))
    per = f.groupBy("image").agg(F.count("*").alias("n"), matching.pearson("total_area", "n_bubbles").alias("r"))
    return per.crossJoin(F.broadcast(all_)).select("image", "n", *r6("r", "r_all"))
