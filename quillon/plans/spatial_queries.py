"""Queries on points, boxes and clusters."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quillon import fixtures as X
from quillon.operators import cluster, matching, spatial
from quillon.operators.labels import partition_scores

ANCHOR, CAP, RADIUS = math.pi * 0.125**2, math.pi * 0.1**2, 0.45
R_IN, R_HALO, MAX_HALO = 0.4, 1.0, 12
A, C = repr(ANCHOR), repr(CAP)
_B = f"bub as ({X.BUBBLES})"


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def bubbles(spark, d):
    return X.project(spark, d, X.BUBBLES)


def _anchored(spark, d):
    return cluster.anchor_cluster(bubbles(spark, d), ANCHOR, RADIUS, CAP)


def flags(spark, d):
    """P2."""
    return _anchored(spark, d).groupBy("image", "is_anchor", "is_satellite_eligible").agg(F.count("*").alias("n"))


def anchor_clusters(spark, d):
    """C1, J17."""
    return _anchored(spark, d).select("image", "bubble_id", "is_anchor", "cluster_id")


_C1 = f"""{_B}, near as (select s.image, s.bubble_id, a.bubble_id as anchor, row_number() over (partition by s.image, s.bubble_id order by sqrt((s.x-a.x)*(s.x-a.x)+(s.y-a.y)*(s.y-a.y)), a.bubble_id) as k
 from bub s join bub a on s.image = a.image and a.area >= {A} and s.area <= {C} and s.area < {A} and sqrt((s.x-a.x)*(s.x-a.x)+(s.y-a.y)*(s.y-a.y)) <= {RADIUS}),
 c1 as (select b.*, b.area >= {A} as is_anchor, coalesce(n.anchor, b.bubble_id) as cluster_id from bub b left join near n on b.image = n.image and b.bubble_id = n.bubble_id and n.k = 1)"""


def lonely_clusters(spark, d):
    """C2, J19, J20, C7."""
    return cluster.lonely_cluster(_anchored(spark, d), R_IN, R_HALO, MAX_HALO).select("image", "bubble_id", "cluster_id", "lonely_pass")


_C2 = f"""with recursive {_C1}, alone as (select image, bubble_id, x, y, area from c1 where cluster_id = bubble_id),
 e as (select a.image, a.bubble_id as u, b.bubble_id as v from alone a join alone b on a.image = b.image and a.bubble_id <> b.bubble_id and sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= {R_IN}),
 reach(image, u, v) as (select image, u, v from e union select r.image, r.u, e.v from reach r join e on r.image = e.image and r.v = e.u),
 comp as (select image, u as bubble_id, least(u, min(v)) as root from reach group by image, u),
 mem as (select c.image, c.bubble_id, c.root, a.x, a.y, a.area from comp c join alone a using (image, bubble_id)),
 cen as (select image, root, sum(x*area)/sum(area) as x, sum(y*area)/sum(area) as y, first(bubble_id order by area desc, bubble_id) as new_id from mem group by image, root),
 halo as (select c.image, c.root, count(*) as n from cen c join bub b on b.image = c.image and sqrt((c.x-b.x)*(c.x-b.x)+(c.y-b.y)*(c.y-b.y)) <= {R_HALO}
   left join mem m on m.image = c.image and m.root = c.root and m.bubble_id = b.bubble_id where m.bubble_id is null group by c.image, c.root),
 good as (select cen.image, cen.root, cen.new_id from cen left join halo using (image, root) where coalesce(halo.n, 0) < {MAX_HALO}),
 c2 as (select c1.* exclude (cluster_id), coalesce(g.new_id, c1.cluster_id) as cluster_id, g.new_id is not null as lonely_pass from c1 left join comp using (image, bubble_id) left join good g on g.image = comp.image and g.root = comp.root)"""


def _features(clustered):
    return cluster.cluster_features(clustered).select("image", "cluster_id", "n_bubbles", "has_anchor", "is_lonely", *r6("anchor_area", "total_area", "max_area", "mean_area", "std_area", "max_to_mean", "radius", "cx", "cy", "mean_r", "mean_g", "mean_b", "circularity", "solidity", "eccentricity"))


def cluster_features(spark, d):
    """A1 after C1 and C2."""
    return _features(cluster.lonely_cluster(_anchored(spark, d), R_IN, R_HALO, MAX_HALO))


_A1 = f"""{_C2}, fa as (select image, cluster_id, arg_min(x, bubble_id) as ax, arg_min(y, bubble_id) as ay, arg_min(area, bubble_id) as aa from c2 where is_anchor group by image, cluster_id)
 select image, cluster_id, count(*) as n_bubbles, bool_or(is_anchor) as has_anchor, bool_or(lonely_pass) as is_lonely, round(max(aa),6) as anchor_area, round(sum(area),6) as total_area, round(max(area),6) as max_area,
 round(avg(area),6) as mean_area, round(coalesce(stddev_samp(area),0),6) as std_area, round(max(area)/avg(area),6) as max_to_mean, round(coalesce(max(sqrt((x-ax)*(x-ax)+(y-ay)*(y-ay))),0),6) as radius,
 round(sum(x*area)/sum(area),6) as cx, round(sum(y*area)/sum(area),6) as cy, round(sum(red*area)/sum(area),6) as mean_r, round(sum(green*area)/sum(area),6) as mean_g, round(sum(blue*area)/sum(area),6) as mean_b,
 round(sum(4*pi()*area/pow(greatest(perim,1e-9),2)*area)/sum(area),6) as circularity, round(sum(area/hull*area)/sum(area),6) as solidity, round(sum(eccentricity*area)/sum(area),6) as eccentricity
 from c2 left join fa using (image, cluster_id) group by image, cluster_id"""


def local_max_clusters(spark, d):
    """C3, J18."""
    return cluster.local_max_anchor_cluster(bubbles(spark, d), 0.5, 3.0).select("image", "bubble_id", "is_anchor", "cluster_id")


def _attach_sql(anchor: str, reach: str) -> str:
    return f"""near as (select s.image, s.bubble_id, a.bubble_id as anchor, row_number() over (partition by s.image, s.bubble_id order by sqrt((s.x-a.x)*(s.x-a.x)+(s.y-a.y)*(s.y-a.y)), a.bubble_id) as k
 from f s join f a on s.image = a.image and a.{anchor} and not s.{anchor} and sqrt((s.x-a.x)*(s.x-a.x)+(s.y-a.y)*(s.y-a.y)) <= {reach})
 select f.image, f.bubble_id, f.is_anchor, coalesce(n.anchor, f.bubble_id) as cluster_id from f left join near n on f.image = n.image and f.bubble_id = n.bubble_id and n.k = 1"""


_C3 = f"""with {_B}, f as (select b.*, not exists (select 1 from bub o where o.image = b.image and o.bubble_id <> b.bubble_id and sqrt((b.x-o.x)*(b.x-o.x)+(b.y-o.y)*(b.y-o.y)) <= 0.5
 and (o.area > b.area or (o.area = b.area and o.bubble_id > b.bubble_id))) as is_anchor from bub b), {_attach_sql("is_anchor", "3.0*sqrt(a.area/pi())")}"""


def absolute_clusters(spark, d):
    """C4."""
    return cluster.absolute_anchor_cluster(bubbles(spark, d), ANCHOR, 3.0, 0.9).select("image", "bubble_id", "is_anchor", "cluster_id")


_C4 = f"""with {_B}, f as (select b.*, area >= {A} as is_anchor from bub b), {_attach_sql("is_anchor", "least(3.0*sqrt(a.area/pi()), 0.45)")}"""


def density_clusters(spark, d):
    """C5 on C1."""
    return cluster.density_merge(_anchored(spark, d), 0.3, 1).select("image", "bubble_id", "cluster_id")


_C5 = f"""with recursive {_C1}, sz as (select image, cluster_id from c1 group by image, cluster_id having count(*) = 1),
 alone as (select c1.image, c1.bubble_id, c1.x, c1.y from c1 join sz using (image, cluster_id)),
 dense as (select a.image, a.bubble_id, a.x, a.y from alone a join bub b on a.image = b.image and a.bubble_id <> b.bubble_id and sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 0.3 group by all),
 e as (select a.image, a.bubble_id as u, b.bubble_id as v from dense a join dense b on a.image = b.image and a.bubble_id <> b.bubble_id and sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) <= 0.6),
 reach(image, u, v) as (select image, u, v from e union select r.image, r.u, e.v from reach r join e on r.image = e.image and r.v = e.u),
 comp as (select image, u as bubble_id, least(u, min(v)) as root from reach group by image, u)
 select c1.image, c1.bubble_id, coalesce(comp.root, c1.cluster_id) as cluster_id from c1 left join comp using (image, bubble_id)"""


def cluster_size_histogram(spark, d):
    """A28, A29."""
    return _anchored(spark, d).groupBy("image", "cluster_id").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))


def over_cap(spark, d):
    """A10: clusters whose widest pair exceeds a cap; pairs stay inside a cluster, which the radius bounds."""
    c = _anchored(spark, d).select("image", "cluster_id", "bubble_id", "x", "y")
    pairs = spatial.range_join(c, c, ["image", "cluster_id"], 2 * RADIUS).where("bubble_id < r_bubble_id")
    return pairs.groupBy("image", "cluster_id").agg(F.max("d").alias("span")).where("span > 0.6").agg(F.count("*").alias("n_over"))


def rule_partition_scores(spark, d):
    """C1 against C4 as if the latter were the human grouping."""
    rule = _anchored(spark, d).selectExpr("image", "bubble_id", "concat_ws(':', image, cluster_id) as rule")
    human = cluster.absolute_anchor_cluster(bubbles(spark, d), ANCHOR, 3.0, 0.9).selectExpr("image", "bubble_id", "concat_ws(':', image, cluster_id) as human")
    return partition_scores(rule.join(human, cluster.KEY), "human", "rule")


def chip_quadrants(spark, d):
    """Counts by quadrant around each image's median centre."""
    b = bubbles(spark, d)
    mid = b.groupBy("image").agg(F.percentile("x", F.lit(0.5)).alias("mx"), F.percentile("y", F.lit(0.5)).alias("my"))
    quad = (F.col("x") >= F.col("mx")).cast("int") + 2 * (F.col("y") >= F.col("my")).cast("int")
    return b.join(mid, "image").groupBy("image", quad.alias("quadrant")).agg(F.count("*").alias("n"), F.count_if(F.col("area") >= ANCHOR).alias("n_anchor"))


def _boxes(spark, d):
    return X.project(spark, d, X.TRUTH), X.project(spark, d, X.PREDICTED)


_IOU = f"""with gt as ({X.TRUTH}), pr as ({X.PREDICTED}), ov as (select g.image, g.gt_id, p.pred_id, g.area as ga, p.area as pa, (least(g.x1,p.x1)-greatest(g.x0,p.x0))*(least(g.y1,p.y1)-greatest(g.y0,p.y0)) as inter
 from gt g join pr p on g.image = p.image and least(g.x1,p.x1) > greatest(g.x0,p.x0) and least(g.y1,p.y1) > greatest(g.y0,p.y0)), iou as (select *, inter/(ga+pa-inter) as iou from ov),
 m as (select image, gt_id, pred_id, iou, ga, pa from (select *, row_number() over (partition by image, gt_id order by iou desc, pred_id) as k from iou where iou >= 0.1) t where k = 1)"""


def iou_match(spark, d):
    """J22, J24."""
    return matching.match_truth(*_boxes(spark, d)).select("image", "gt_id", "pred_id", F.round("iou", 6).alias("iou"), "n_pred_matches")


def overlap_join(spark, d):
    """All overlapping pairs with their share."""
    return spatial.overlap_pairs(*_boxes(spark, d), ["image"], 1.0).select("image", "gt_id", F.col("r_pred_id").alias("pred_id"), *r6("inter", "iou"))


def first_overlap(spark, d):
    """Left overlap join that keeps the first match."""
    gt, pr = _boxes(spark, d)
    one = spatial.argbest(spatial.overlap_pairs(gt, pr, ["image"], 1.0), ["image", "gt_id"], [F.col("r_pred_id")]).select("image", "gt_id", F.col("r_pred_id").alias("pred_id"))
    return gt.select("image", "gt_id").join(one, ["image", "gt_id"], "left")


def detection_per_image(spark, d):
    """Counts and the correlation of matched areas of each image."""
    gt, pr = _boxes(spark, d)
    m = matching.match_truth(gt, pr)
    r = m.groupBy("image").agg(matching.pearson("area_gt", "area_pred").alias("r"))
    return matching.detection_counts(m, gt, pr).join(r, "image", "left").select("image", "n_gt", "n_pred", "tp", "fn", "fp", F.round("r", 6).alias("r"))


_DET = f"""{_IOU}, det as (select g.image, g.n as n_gt, coalesce(p.n,0) as n_pred, coalesce(t.tp,0) as tp, g.n-coalesce(t.tp,0) as fn, coalesce(p.n,0)-coalesce(t.used,0) as fp, t.r
 from (select image, count(*) as n from gt group by image) g left join (select image, count(*) as n from pr group by image) p using (image)
 left join (select image, count(*) as tp, count(distinct pred_id) as used, case when count(*) >= 5 then corr(ga, pa) end as r from m group by image) t using (image))"""


def detection_scores(spark, d):
    """A22, M16."""
    gt, pr = _boxes(spark, d)
    return matching.scores(matching.detection_counts(matching.match_truth(gt, pr), gt, pr)).select("tp", "fn", "fp", *r6("precision", "recall", "f1"))


def one_to_one_match(spark, d):
    """Sequential matching; sizes only, the rest is unit-tested."""
    pairs = spatial.overlap_pairs(*_boxes(spark, d), ["image"], 1.0).where("iou >= 0.1").withColumnRenamed("r_pred_id", "pred_id")
    return matching.match_one_to_one(pairs)


PLANS = {
    "flags": (flags, f"with {_B} select image, area >= {A} as is_anchor, area < {A} and area <= {C} as is_satellite_eligible, count(*) as n from bub group by 1, 2, 3"),
    "anchor_clusters": (anchor_clusters, f"with {_C1} select image, bubble_id, is_anchor, cluster_id from c1"),
    "lonely_clusters": (lonely_clusters, f"{_C2} select image, bubble_id, cluster_id, lonely_pass from c2"),
    "cluster_features": (cluster_features, _A1),
    "local_max_clusters": (local_max_clusters, _C3),
    "absolute_clusters": (absolute_clusters, _C4),
    "density_clusters": (density_clusters, _C5),
    "cluster_size_histogram": (cluster_size_histogram, f"with {_C1} select size, count(*) as clusters from (select count(*) as size from c1 group by image, cluster_id) t group by size"),
    "over_cap": (over_cap, f"with {_C1} select count(*) as n_over from (select max(sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y))) as span from c1 a join c1 b on a.image = b.image and a.cluster_id = b.cluster_id and a.bubble_id < b.bubble_id group by a.image, a.cluster_id) t where span > 0.6"),
    "rule_partition_scores": (rule_partition_scores, f"""with h as ({_C4}), r as (with {_C1} select image, bubble_id, cluster_id from c1), p as (select h.image || ':' || h.cluster_id as human, r.image || ':' || r.cluster_id as rule from h join r using (image, bubble_id))
 select (select count(distinct human) from p) as n_human, (select count(distinct rule) from p) as n_rule, (select count(*) from (select human from p group by human having count(distinct rule) > 1) t) as fragmented, (select count(*) from (select rule from p group by rule having count(distinct human) > 1) t) as bridges"""),
    "chip_quadrants": (chip_quadrants, f"with {_B}, m as (select image, quantile_cont(x, 0.5) as mx, quantile_cont(y, 0.5) as my from bub group by image) select image, cast(x >= mx as int) + 2*cast(y >= my as int) as quadrant, count(*) as n, count(*) filter (where area >= {A}) as n_anchor from bub join m using (image) group by 1, 2"),
    "iou_match": (iou_match, f"{_IOU} select image, gt_id, pred_id, round(iou,6) as iou, count(*) over (partition by image, pred_id) as n_pred_matches from m"),
    "overlap_join": (overlap_join, f"{_IOU} select image, gt_id, pred_id, round(inter,6) as inter, round(iou,6) as iou from iou"),
    "first_overlap": (first_overlap, f"{_IOU} select gt.image, gt.gt_id, f.pred_id from gt left join (select image, gt_id, min(pred_id) as pred_id from iou group by image, gt_id) f using (image, gt_id)"),
    "detection_per_image": (detection_per_image, f"{_DET} select image, n_gt, n_pred, tp, fn, fp, round(r,6) as r from det"),
    "detection_scores": (detection_scores, f"""{_DET}, s as (select cast(sum(tp) as bigint) as tp, cast(sum(fn) as bigint) as fn, cast(sum(fp) as bigint) as fp, sum(tp)/greatest(1,sum(tp)+sum(fp)) as p, sum(tp)/greatest(1,sum(tp)+sum(fn)) as r from det)
 select tp, fn, fp, round(p,6) as precision, round(r,6) as recall, round(2*p*r/greatest(1e-6,p+r),6) as f1 from s"""),
    "one_to_one_match": (one_to_one_match, None),
}
