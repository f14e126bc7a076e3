"""Queries on the smaller rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import fixtures as X
from quillon.functions import scalars as S
from quillon.operators import extras, regions
from quillon.plans.base import catalogue, ctes, on
from quillon.plans.object_queries import _REG

PLANS, plan = catalogue()
pixels, log, truth, areas = (on(s) for s in (X.PIXELS, X.TRAIN_LOG, X.TRUTH, X.AREAS))


@plan(f"with {ctes(lg=X.TRAIN_LOG)} select run, round(list_reduce(list(loss order by epoch), lambda a, b: 0.9*a + 0.1*b),4) as ema from lg group by 1")
def ema_loss(spark, d):
    """W9."""
    return extras.ema(log(spark, d), "run", "epoch", "loss", 0.9).select("run", F.round("ema", 4).alias("ema"))


@plan("select c_custkey, cast(ceil(c_custkey/ceil(sqrt(c_custkey))) as int) as grid_rows, cast(ceil(sqrt(c_custkey)) as int) as grid_cols from customer where c_custkey between 1 and 100")
def panel_grids(spark, d):
    """O12."""
    c = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey between 1 and 100")
    rows, cols = extras.near_square(F.col("c_custkey"))
    return c.select("c_custkey", rows.alias("grid_rows"), cols.alias("grid_cols"))


@plan(f"""{_REG} select reg.image, reg.label, reg.r, reg.c, side from reg, (values ('n',-1,0),('s',1,0),('w',0,-1),('e',0,1)) m(side,dr,dc) where not exists (select 1 from reg o where o.image = reg.image and o.label = reg.label and o.r = reg.r+dr and o.c = reg.c+dc)""")
def region_outlines(spark, d):
    """R8."""
    return extras.boundary_sides(regions.label_regions(pixels(spark, d).where("gt > 0").select("image", "r", "c")))


@plan(f"with {ctes(px=X.PIXELS)}, z as (select image, r, c, case when image % 2 = 1 then 0 when b1 < 20 then -1 else b1 end as v from px), k as (select image from z where v <> -1 group by 1 having max(abs(v)) > 0) select image, r, c, case when v <> -1 then v end as v from z join k using (image)")
def usable_rasters(spark, d):
    """R26."""
    v = F.when(F.col("image") % 2 == 1, 0.0).when(F.col("b1") < 20, -1.0).otherwise(F.col("b1"))
    return extras.usable_rasters(pixels(spark, d).select("image", "r", "c", v.alias("v")), "v", -1.0)


@plan(f"with {ctes(px=X.PIXELS)} select image, round(avg(least(greatest(prob,1e-6),1-1e-6)),6) as p, round(avg(case image % 5 when 0 then b3 when 1 then b2 when 2 then b1 else b1 end),6) as channel from px group by 1")
def channels(spark, d):
    """Clamped probabilities, and a channel of the reversed bands by a number that is cut off."""
    picked = S.clamped_channel(F.array("b3", "b2", "b1"), F.col("image") % 5)
    return pixels(spark, d).groupBy("image").agg(F.round(F.avg(extras.clamped(F.col("prob"))), 6).alias("p"), F.round(F.avg(picked), 6).alias("channel"))


@plan(f"with {ctes(gt=X.TRUTH, ar=X.AREAS)} select gt.image, gt_id, area_id from gt join ar on gt.image = ar.image and area_id < 2 and gt.gt_id % 2 = 0 and least(gt.x1,ar.x1) > greatest(gt.x0,ar.x0) and least(gt.y1,ar.y1) > greatest(gt.y0,ar.y0)")
def objects_in_bounds(spark, d):
    """Objects that meet bounds of their own reference system."""
    gt = truth(spark, d).where("gt_id % 2 = 0").withColumn("srid", F.col("image"))
    return extras.in_bounds(gt, areas(spark, d).where("area_id < 2").withColumnRenamed("image", "srid"), 4.0).select("image", "gt_id", F.col("r_area_id").alias("area_id"))


@plan(f"with {ctes(gt=X.TRUTH)} select image, gt_id, p.part, case when p.part = 0 and gt_id % 7 <> 0 then 2 else 1 end as n_rings, 4 as n_vertices from gt, (select 0 as part union all select 1) p where p.part = 0 or (gt_id % 3 = 0 and gt_id % 7 <> 0)")
def polygon_parts(spark, d):
    """Polygons of collections without holes, their vertices, and a box where there is no geometry."""
    ring = F.array(*(F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))))
    two = F.when(F.col("gt_id") % 3 == 0, F.array(F.array(ring, ring), F.array(ring))).otherwise(F.array(F.array(ring, ring)))
    rows = truth(spark, d).withColumn("g", extras.box_or(F.when(F.col("gt_id") % 7 != 0, two), F.array(F.array(ring))))
    return extras.polygon_parts(rows, "g").select("image", "gt_id", "part", "n_rings", "n_vertices")


@plan("select o as optimizer, b as batch, round(cast(1e-4 as double)*pow(100::double, i/2.0::double),9) as rate from (select unnest(['adam','sgd']) as o) x, (select unnest([8::bigint,16]) as b) y, range(3) t(i)")
def search_space(spark, d):
    """E33."""
    out = extras.search_space(spark, {"optimizer": ["adam", "sgd"], "batch": [8, 16]}, {"rate": (1e-4, 1e-2, 3)})
    return out.withColumn("rate", F.round("rate", 9))



