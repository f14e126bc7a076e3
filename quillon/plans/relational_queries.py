"""Queries on joins, projections, fills, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillon import fixtures as X
from quillon.functions import scalars as S
from quillon.operators import spatial, tables, temporal
from quillon.plans.base import catalogue, ctes, on, r6

PLANS, plan = catalogue()
bubbles, truth, predicted, packs, areas, track, pixels, scenes, runs = (on(s) for s in (X.BUBBLES, X.TRUTH, X.PREDICTED, X.LABELS, X.AREAS, X.TRACK, X.PIXELS, X.SCENES, X.RUNS))
_G = f"with {ctes(gt=X.TRUTH, ar=X.AREAS, pr=X.PREDICTED, bub=X.BUBBLES, lab=X.LABELS)}"


@plan(f"{_G} select bub.image, bubble_id, round(bub.area,6) as area, round(x1-x0,6) as width from bub left join gt on bub.image = gt.image and bubble_id = gt_id and gt_id % 5 <> 0")
def features_to_polygons(spark, d):
    """Every feature row with its polygon, if it has one."""
    gt = truth(spark, d).where("gt_id % 5 <> 0").select("image", F.col("gt_id").alias("bubble_id"), (F.col("x1") - F.col("x0")).alias("width"))
    return bubbles(spark, d).select("image", "bubble_id", "area").join(gt, ["image", "bubble_id"], "left").select("image", "bubble_id", *r6("area", "width"))


@plan(f"{_G} select bub.image, bubble_id, round(x1-x0,6) as width from bub join gt on bub.image = gt.image and bubble_id = gt_id and gt_id % 5 <> 0")
def features_with_geometry(spark, d):
    """Inner join of features and polygons."""
    gt = truth(spark, d).where("gt_id % 5 <> 0").select("image", F.col("gt_id").alias("bubble_id"), (F.col("x1") - F.col("x0")).alias("width"))
    return bubbles(spark, d).join(gt, ["image", "bubble_id"]).select("image", "bubble_id", *r6("width"))


@plan(f"{_G}, st as (select image, grp, count(*) as n from lab where labeler = 1 group by 1, 2) select lab.image, seep_id, lab.grp, n from lab left join st on lab.image = st.image and lab.grp = st.grp where labeler = 2")
def cluster_structure(spark, d):
    """A table's rows with the structure of their group; columns of both are taken once."""
    lab = packs(spark, d)
    structure = lab.where("labeler = 1").groupBy("image", "grp").agg(F.count("*").alias("n"), F.first("area").alias("area"))
    own = lab.where("labeler = 2").select("image", "seep_id", "grp", "area")
    return own.join(structure.select("image", "grp", *(c for c in structure.columns if c not in own.columns)), ["image", "grp"], "left").select("image", "seep_id", "grp", "n")


@plan(f"{_G} select l.image, l.seep_id, coalesce(m.grp, l.seep_id) as grp from lab l left join lab m on l.image = m.image and l.seep_id = m.seep_id and m.labeler = 3 where l.labeler = 1")
def group_lookup(spark, d):
    """Another labeler's group of each item, its own id where there is none."""
    lab = packs(spark, d)
    return tables.lookup(lab.where("labeler = 1").select("image", "seep_id"), lab.where("labeler = 3"), ["image", "seep_id"], "grp", F.col("seep_id"))


@plan(f"""{_G}, o as (select seep_id, min(class) as class from lab where labeler = 2 and image = 0 group by 1)
 select l.image, l.seep_id, coalesce(m.class, o.class, '') as class from lab l left join lab m on l.image = m.image and l.seep_id = m.seep_id and m.labeler = 3 left join o on l.seep_id = o.seep_id where l.labeler = 1""")
def class_lookup(spark, d):
    """A class by image and item, else by the item alone, else empty."""
    lab = packs(spark, d)
    other = lab.where("labeler = 2 and image = 0").groupBy("seep_id").agg(F.min("class").alias("second"))
    rows = tables.lookup(lab.where("labeler = 1").select("image", "seep_id"), lab.where("labeler = 3"), ["image", "seep_id"], "class", F.lit(None))
    return rows.join(other, "seep_id", "left").select("image", "seep_id", F.coalesce("class", "second", F.lit("")).alias("class"))


@plan("select o.o_orderkey, coalesce(n.o_totalprice, o.o_totalprice) as o_totalprice from orders o left join (select o_orderkey, case when o_orderkey % 4 = 0 then null else o_totalprice*2 end as o_totalprice from orders where o_orderkey % 2 = 0) n using (o_orderkey)")
def updated_prices(spark, d):
    """Values take the newer table's, where it has one."""
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_totalprice")
    newer = o.where("o_orderkey % 2 = 0").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice") * 2))
    return tables.update_by(o, newer, "o_orderkey", ["o_totalprice"])


@plan(f"{_G}, a as (select image, count(*) as n_pred from pr group by 1), b as (select image, count(*) as n_chip from gt where image % 4 <> 1 group by 1) select image, n_pred, n_chip from a join b using (image)")
def paired_files(spark, d):
    """Predictions and chips of one name."""
    a = predicted(spark, d).groupBy("image").agg(F.count("*").alias("n_pred"))
    return a.join(truth(spark, d).where("image % 4 <> 1").groupBy("image").agg(F.count("*").alias("n_chip")), "image")


_HIT = "gt.image = ar.image and least(gt.x1,ar.x1) > greatest(gt.x0,ar.x0) and least(gt.y1,ar.y1) > greatest(gt.y0,ar.y0)"
_CLIP = "greatest(gt.x0,ar.x0) as cx0, greatest(gt.y0,ar.y0) as cy0, least(gt.x1,ar.x1) as cx1, least(gt.y1,ar.y1) as cy1"


def _hits(spark, d):
    clip = {"cx0": F.greatest("x0", "r_x0"), "cy0": F.greatest("y0", "r_y0"), "cx1": F.least("x1", "r_x1"), "cy1": F.least("y1", "r_y1")}
    return spatial.overlap_pairs(truth(spark, d), areas(spark, d), ["image"], 4.0).select("image", "gt_id", F.col("r_area_id").alias("area_id"), *(c.alias(n) for n, c in clip.items()))


@plan(f"{_G} select gt.image, gt_id, area_id from gt join ar on {_HIT}")
def objects_in_areas(spark, d):
    """Each object with every area that it meets."""
    return _hits(spark, d).select("image", "gt_id", "area_id")


@plan(f"{_G}, h as (select gt.image, gt_id, min(area_id) as area_id from gt join ar on {_HIT} and area_id <> 0 group by 1, 2) select gt.image, gt.gt_id, area_id from gt left join h using (image, gt_id)")
def first_area(spark, d):
    """Each object with the first area that it meets, or none."""
    one = spatial.argbest(_hits(spark, d).where("area_id <> 0"), ["image", "gt_id"], [F.col("area_id")]).select("image", "gt_id", "area_id")
    return truth(spark, d).select("image", "gt_id").join(one, ["image", "gt_id"], "left")


@plan(f"{_G}, c as (select gt.image, gt_id, area_id, {_CLIP} from gt join ar on {_HIT}) select image, gt_id, area_id, round((cx1-cx0)*(cy1-cy0),6) as clipped, row_number() over (partition by image, area_id order by gt_id) as chip_id from c")
def clipped_objects(spark, d):
    """Objects cut to the areas, numbered in each area."""
    size = (F.col("cx1") - F.col("cx0")) * (F.col("cy1") - F.col("cy0"))
    return _hits(spark, d).select("image", "gt_id", "area_id", F.round(size, 6).alias("clipped"), F.row_number().over(Window.partitionBy("image", "area_id").orderBy("gt_id")).cast("long").alias("chip_id"))


@plan("select a.image, a.r, a.c from ({0}) a where a.gt > 0 and a.prob < 0.5".format(X.PIXELS))
def mask_difference(spark, d):
    """What of one cover is outside of another, over pixel sets."""
    px = pixels(spark, d)
    return px.where("gt > 0").select("image", "r", "c").join(px.where("prob >= 0.5").select("image", "r", "c"), ["image", "r", "c"], "left_anti")


@plan(f"""{_G}, s as (select image, gt_id, (x0+x1)/2-(x1-x0) as x0, (y0+y1)/2-(y1-y0) as y0, (x0+x1)/2+(x1-x0) as x1, (y0+y1)/2+(y1-y0) as y1 from gt)
 select a.image, a.gt_id, b.gt_id as other from s a join s b on a.image = b.image and a.gt_id <> b.gt_id and least(a.x1,b.x1) > greatest(a.x0,b.x0) and least(a.y1,b.y1) > greatest(a.y0,b.y0)""")
def scaled_neighbours(spark, d):
    """Objects that meet when they are scaled by two."""
    half = lambda a, b: (F.col(b) - F.col(a)) / 2
    wide = truth(spark, d).select("image", "gt_id", *((F.col(c) + s * half(lo, hi)).alias(c) for c, s, lo, hi in (("x0", -1, "x0", "x1"), ("y0", -1, "y0", "y1"), ("x1", 1, "x0", "x1"), ("y1", 1, "y0", "y1"))), "area")
    return spatial.overlap_pairs(wide, wide, ["image"], 2.0).where("gt_id <> r_gt_id").select("image", "gt_id", F.col("r_gt_id").alias("other"))


@plan("select n_name, r_name, s_suppkey from nation join region on n_regionkey = r_regionkey left join supplier on s_nationkey = n_nationkey and s_acctbal > 5000 where n_nationkey % 2 = 0")
def linked_areas(spark, d):
    """Areas linked by an attribute; those without a partner are kept, to warn of."""
    n, r, s = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region", "supplier"))
    linked = n.where("n_nationkey % 2 = 0").join(r, n.n_regionkey == r.r_regionkey)
    return linked.join(s.where("s_acctbal > 5000"), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_name", "r_name", "s_suppkey")


@plan(f"{_G}, t as (select track.flight, track.event_id from ({X.TRACK}) track), m as (select aoi, strip from ({X.SCENES}) s where cloud < 0.1 group by 1, 2) select flight, event_id, count(*) as n from t join m on aoi = flight group by 1, 2")
def images_by_aoi(spark, d):
    """Images of each area of interest, counted."""
    m = scenes(spark, d).where("cloud < 0.1").select(F.col("aoi").alias("flight"), "strip").distinct()
    return track(spark, d).select("flight", "event_id").join(m, "flight").groupBy("flight", "event_id").agg(F.count("*").alias("n"))


@plan(f"{_G} select distinct image, seep_id, l.labeler from lab cross join (select 1 as labeler union all select 2 union all select 3) l where is_calibration")
def calibration_master(spark, d):
    """Every calibration item for every labeler; the labelers are three rows."""
    lab = packs(spark, d)
    return lab.where("is_calibration").select("image", "seep_id").distinct().crossJoin(F.broadcast(lab.select("labeler").distinct()))


@plan(f"select a.idx, a.name, b.idx as new_idx from ({X.FOLDER_A}) a left join ({X.FOLDER_B}) b on a.name = b.name where a.idx % 2 = 0")
def remapped_indices(spark, d):
    """Positions in one folder, by name in another."""
    a, b = X.project(spark, d, X.FOLDER_A), X.project(spark, d, X.FOLDER_B)
    return tables.remap_index(a.where("idx % 2 = 0").select("idx"), a, b)


@plan(f"""with px as (select image % 3 as folder, image // 3 as name, r, c, prob from ({X.PIXELS}) p), k as (select name from px group by name having count(distinct folder) = 3)
 select name, r, c, round(sum(prob),6) as total from px join k using (name) group by 1, 2, 3""")
def summed_rasters(spark, d):
    """Rasters of the names that all three folders have, added up."""
    px = pixels(spark, d).select((F.col("image") % 3).alias("folder"), F.floor(F.col("image") / 3).alias("name"), "r", "c", "prob")
    shared = tables.in_all(px.select("folder", "name").distinct(), "folder", ["name"], 3)
    return px.join(shared, "name").groupBy("name", "r", "c").agg(F.round(F.sum("prob"), 6).alias("total"))


@plan(f"""with tr as ({X.TRACK}), w as (select *, stati - lag(stati) over p = 1 and x is not null as ok from tr window p as (partition by flight order by event_id)),
 v as (select flight, event_id, ok, lag(ok) over p as pre, lag(event_id) over p as start_event_id, lag(x) over p as start_x, lag(y) over p as start_y, x, y from w window p as (partition by flight order by event_id))
 select flight, start_event_id, round(start_x,6) as start_x, round(start_y,6) as start_y, event_id as end_event_id, round(x,6) as end_x, round(y,6) as end_y from v where ok and pre""")
def track_segments(spark, d):
    """Pieces of a flight line without gaps."""
    return temporal.segments(track(spark, d), "flight", "event_id", "stati", ["x", "y"]).select("flight", "start_event_id", *r6("start_x", "start_y"), "end_event_id", *r6("end_x", "end_y"))


@plan(f"""with tr as ({X.TRACK}), ti as (select distinct flight, date_trunc('day', t) as tick from tr) select ti.flight, ti.tick, cast(count(tr.t) as bigint) as position from ti left join tr on tr.flight = ti.flight and tr.t <= ti.tick group by 1, 2""")
def snapshot_positions(spark, d):
    """How many points a flight had at the start of each of its days."""
    tr = track(spark, d)
    ticks = tr.select("flight", F.date_trunc("day", "t").alias("tick")).distinct()
    return temporal.asof_position(tr, ticks, "flight", "t", "tick")


@plan("select s_suppkey, 'kept' as tag, s_name as label, s_acctbal, s_nationkey as nation from supplier where s_nationkey in (1, 2, 3, 5, 8) and s_suppkey not in (select s_suppkey from supplier where s_acctbal < 0) and s_acctbal between 0 and 8000")
def projections(spark, d):
    """Selected, tagged, renamed and reordered columns of rows in and not in sets."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    rows = s.where(F.col("s_nationkey").isin(1, 2, 3, 5, 8) & F.col("s_acctbal").between(0, 8000)).join(s.where("s_acctbal < 0").select("s_suppkey"), "s_suppkey", "left_anti")
    twice = rows.select("s_suppkey", F.lit("kept").alias("tag"), "s_acctbal", F.col("s_nationkey").alias("nation"), F.col("s_name").alias("label"), F.col("s_nationkey").alias("nation"))
    return tables.reorder(tables.first_columns(twice), ["s_suppkey", "tag", "label"], "nation")


@plan(f"with h as ({X.HISTORICAL}), f as (select id, type_flux, case when id % 5 = 0 then null else length_cm end as v from h) select id, coalesce(type_flux, 'none') as type_flux, coalesce(v, (select quantile_cont(v, 0.5) from f)) as v from f")
def filled(spark, d):
    """A label with a default, and a column's median where the value is missing."""
    h = X.project(spark, d, X.HISTORICAL).select("id", "type_flux", F.when(F.col("id") % 5 != 0, F.col("length_cm")).alias("v"))
    return tables.median_fill(h, ["v"]).withColumn("type_flux", tables.fill_default(F.col("type_flux"), F.lit("none")))


@plan("select count(*) as n, count(distinct (image, grp)) as pairs from ({0}) l".format(X.LABELS))
def distinct_pairs(spark, d):
    """Rows and distinct pairs of keys."""
    return packs(spark, d).agg(F.count("*").alias("n"), F.count_distinct("image", "grp").alias("pairs"))


@plan(f"{_G} select image, seep_id, labeler, case when seep_id % 3 = 0 then seep_id else grp end as seep_group_id, case when seep_id % 4 = 0 then 0 else is_pregrouped end as is_pregrouped, '' as class from lab")
def group_fields(spark, d):
    """Group fields seeded where they are missing, classes emptied."""
    lab = packs(spark, d).select("image", "seep_id", "labeler", F.when(F.col("seep_id") % 3 != 0, F.col("grp")).alias("seep_group_id"), F.when(F.col("seep_id") % 4 != 0, F.col("is_pregrouped")).alias("is_pregrouped"), "class")
    return tables.add_group_fields(lab, discard_class=True)


@plan("select c_custkey from customer where substr(c_name, 1, 15) not in (select substr(c_name, 1, 15) from customer where c_custkey % 7 = 0)")
def unseen_ids(spark, d):
    """Rows whose id's beginning is new."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    return tables.new_ids(c, c.where("c_custkey % 7 = 0"), "c_name", 15).select("c_custkey")


@plan(f"""with s as (select aoi, min(acquired) as first_day, bool_or(cloud < 0.005) as clear from ({X.SCENES}) s group by 1), o as (select aoi, row_number() over (order by clear desc, first_day, aoi) as place from s) select aoi, place from o""")
def aoi_order(spark, d):
    """Areas with a clear scene by first date, then the others by first date."""
    s = scenes(spark, d).groupBy("aoi").agg(F.min("acquired").alias("first_day"), F.bool_or(F.col("cloud") < 0.005).alias("clear"))
    part = lambda c: s.agg(F.array_sort(F.collect_list(F.when(c, F.struct("first_day", "aoi")))).alias("a"))
    lists = part(F.col("clear")).crossJoin(part(~F.col("clear")).withColumnRenamed("a", "b"))  # two single rows
    return lists.select(F.posexplode(F.concat("a", "b")).alias("place", "s")).select("s.aoi", (F.col("place") + 1).cast("long").alias("place"))


@plan("select cast(regexp_extract(c_name, '([0-9]+)$', 1) as int) as stem, row_number() over (order by cast(regexp_extract(c_name, '([0-9]+)$', 1) as int)) as place from customer where c_custkey % 10 = 3 order by 1 limit 12")
def numeric_stems(spark, d):
    """Files in the order of their numbers, the first twelve."""
    c = spark.read.parquet(f"{d}/customer.parquet").where("c_custkey % 10 = 3")
    first = c.select(F.regexp_extract("c_name", "([0-9]+)$", 1).cast("int").alias("stem")).orderBy("stem").limit(12)
    return first.withColumn("place", F.row_number().over(Window.orderBy("stem")).cast("long"))


@plan(f"""with s as (select *, case when scene % 5 = 0 then null else price end as v from ({X.SCENES}) s), k as (select aoi, strip, first_cell, v, abs(date_diff('day', date '2000-01-01', cast(acquired as date))) as days, scene, part, price, cloud from s),
 b as (select aoi, strip, first_cell, arg_min(v, (days, scene, part, price)) as v from k where cloud <= 0.2 and v is not null group by 1, 2, 3), f as (select aoi, strip, first_cell, arg_min(v, (days, scene, part, price)) as v from k where v is not null group by 1, 2, 3)
 select f.aoi, f.strip, f.first_cell, coalesce(b.v, f.v) as v, b.v is null as filled from f left join b using (aoi, strip, first_cell)""")
def gap_filled_mosaic(spark, d):
    """Each place by its nearest clear date, and places without one by the nearest date at all."""
    from quillon.operators.scenes import nearest_date_mosaic

    s = scenes(spark, d).withColumn("v", F.when(F.col("scene") % 5 != 0, F.col("price")))
    return nearest_date_mosaic(s, ["aoi", "strip", "first_cell"], "2000-01-01", F.col("cloud") <= 0.2)


@plan(f"""with s as (select aoi, scene, cast(floor(price) as bigint) % 12 as scl, part, cloud from ({X.SCENES}) s) select aoi, round(avg(case when scl in (3,8,9,10) then 1 else 0 end) filter (where scl > 0),6) as cloud_frac,
 count(*) filter (where scl > 0 and scl not in (3,8,9,10)) as clear, cast(coalesce(sum(part) filter (where cloud <= 0.1), 0) as bigint) as clear_area from s group by 1""")
def cloud_fractions(spark, d):
    """The share of cloud classes over pixels with data, the pixels kept, and the area of the scenes chosen."""
    from quillon.operators.scenes import cloud_fraction, is_clear

    s = scenes(spark, d).withColumn("scl", F.floor("price") % 12)
    area = F.coalesce(F.sum(F.when(F.col("cloud") <= 0.1, F.col("part"))), F.lit(0)).cast("long")
    return s.groupBy("aoi").agg(F.round(cloud_fraction(F.col("scl")), 6).alias("cloud_frac"), F.count_if(is_clear(F.col("scl"))).alias("clear"), area.alias("clear_area"))


_NAMES = "select c_custkey as k, case c_custkey % 8 when 0 then 'run_AE_1' when 1 then 'AE_x' when 2 then 'x aerial y' when 3 then 'S2A_1' when 4 then 'Sentinel-2b' when 5 then 'Swin | S2' when 6 then 'TerraMind unet' else 'fn' end as s from customer"


@plan(f"""with n as ({_NAMES}) select k, case when contains(upper(s), '_AE') or contains(upper(s), 'AE_') or contains(upper(s), ' AE ') then 'AE' when contains(upper(s), 'AERIAL') then 'Aerial'
 when contains(upper(s), 'S2') or contains(upper(s), 'SENTINEL-2') or contains(upper(s), 'SENTINEL2') then 'Sentinel-2' else 'Other' end as sensor,
 case when contains(lower(s), 'terramind') or contains(lower(s), 'terraminf') then 'FN' when contains(lower(s), 'unet') then 'UNet' when contains(lower(s), 'swin') then 'Swin' when contains(lower(s), 'fn') then 'FN' else 'Other' end as model,
 case when contains(s, ' | ') then case when contains(s, 'Swin') then 'Swin' when contains(s, 'Terramind') then 'Terramind' else 'U-Net' end end as arch, case when contains(s, ' | ') then trim(split_part(s, ' | ', 2)) end as dataset from n""")
def inferred_names(spark, d):
    """F14-F16."""
    n = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey as k", _NAMES.split(", ", 1)[1].split(" from ")[0])
    arch, dataset = S.split_label(F.col("s"))
    return n.select("k", S.infer_sensor(F.col("s")).alias("sensor"), S.infer_model(F.col("s")).alias("model"), arch.alias("arch"), dataset.alias("dataset"))


@plan("""select o_orderkey, cast(o_orderdate as timestamp) - interval 30 day as lo, cast(o_orderdate as timestamp) + interval 30 day as hi, round(0.001*111320*cos(radians(abs(o_orderkey % 90))),6) as xm, round(0.001*cast(110540 as double),6) as ym,
 cast(least(greatest(floor((o_totalprice/10000)*10000), 0), 65535) as int) as scaled, case when o_totalprice > 100000 then round(log10(o_totalprice),6) end as log_area, make_timestamp(2000, 1, cast(o_orderkey % 28 + 1 as int), cast(o_orderkey % 24 as int), 0, 0.0) as at,
 round(o_totalprice*cast(3100000 as double)/1800000,4) as carbon, coalesce(case when o_orderkey % 3 = 0 then 'nan'::double else o_totalprice end, 0) as x from orders where o_orderkey % 3 <> 0""")
def scalar_functions(spark, d):
    """F18, F21, F26, F27, F32-F34."""
    o = spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 3 <> 0")
    lo, hi = S.date_window(F.col("o_orderdate").cast("timestamp"), 30, F.lit("2024-01-01").cast("timestamp"))
    xm, ym = S.degrees_to_metres(F.lit(0.001), F.lit(0.001), F.col("o_orderkey") % 90)
    at = S.assemble_time(F.lit(2000), F.lit(1), (F.col("o_orderkey") % 28 + 1).cast("int"), (F.col("o_orderkey") % 24).cast("int"))
    price = F.col("o_totalprice")
    return o.select("o_orderkey", lo.alias("lo"), hi.alias("hi"), F.round(xm, 6).alias("xm"), F.round(ym, 6).alias("ym"), S.to_uint16(price / 10000).alias("scaled"),
        F.round(S.log_area(F.when(price > 100000, price)), 6).alias("log_area"), at.alias("at"), F.round(S.carbon(price), 4).alias("carbon"), S.finite_or(price, 0.0).alias("x"))


@plan("""select c_custkey, case c_custkey % 4 when 0 then '(1.5, 2.0)' when 1 then 'x' when 2 then '3' else null end as raw, case c_custkey % 4 when 0 then 1.5::double when 2 then 3.0::double end as first_number,
 coalesce(nullif(trim(regexp_replace(c_name || '/ä b', '[^A-Za-z0-9._-]+', '_', 'g'), '_'), ''), 'unknown') as fs_name, coalesce(nullif(trim(regexp_replace(lower(c_name || '/# b'), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'item') as slug,
 case c_custkey % 5 when 0 then 'GTiff' when 1 then 'JP2OpenJPEG' when 2 then 'ESRI Shapefile' when 3 then 'GPKG' end as driver, cast(3 as int) as epoch, case c_custkey % 3 when 0 then 'train' when 1 then 'val' else 'unknown' end as split,
 cast(ceil(ceil((c_custkey % 900 + 1)/4)/56)*56*4 as int) as snapped, case when c_custkey % 6 = 0 then '' else '1e3' end as compact, c_custkey % 2 = 0 as higher, true as bounded from customer""")
def string_functions(spark, d):
    """F13, F19, F23, F25, F30, E32, E34, E36, E37."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, "(1.5, 2.0)").when(k % 4 == 1, "x").when(k % 4 == 2, "3")
    ext = F.element_at(F.array(*(F.lit(x) for x in ("a.TIF", "b.jp2", "c.shp", "d.gpkg", "e.txt"))), (k % 5 + 1).cast("int"))
    split = F.when(k % 3 == 0, "train").when(k % 3 == 1, "val")
    return c.select("c_custkey", raw.alias("raw"), S.first_number(raw).alias("first_number"), S.file_name(F.concat("c_name", F.lit("/ä b"))).alias("fs_name"), S.slug(F.concat("c_name", F.lit("/# b"))).alias("slug"),
        S.driver_name(ext).alias("driver"), S.resume_epoch(F.lit("3/20")).alias("epoch"), S.split_of(split).alias("split"), S.snap((k % 900 + 1).cast("int"), 4, 7, 3).alias("snapped"),
        S.compact_number(F.when(k % 6 == 0, F.lit(0.0)).otherwise(F.lit(1000.0))).alias("compact"), S.higher_is_better(F.when(k % 2 == 0, "val_IoU").otherwise("loss")).alias("higher"), S.is_bounded(F.lit("val_IoU")).alias("bounded"))


@plan("""select o_orderkey, greatest(o_totalprice - 1000, 0) as x, round(ln(greatest(greatest(o_totalprice - 1000, 0), 1e-12)),6) as logged from orders where o_totalprice - 1000 >= -1e-6""")
def strict_log(spark, d):
    """Logarithms that clamp tiny negative values and refuse others."""
    o = spark.read.parquet(f"{d}/orders.parquet").withColumn("y", F.col("o_totalprice") - 1000).where("y >= -1e-6")
    return o.select("o_orderkey", F.greatest("y", F.lit(0.0)).alias("x"), F.round(S.strict_log(F.col("y")), 6).alias("logged"))


@plan("with f as (select p_name as n, p_partkey from part) select p_partkey from f where n like '%e' and (contains(n, 'a') or contains(n, 'oo'))")
def copied_files(spark, d):
    """Files by suffix and by any of several words."""
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.where(S.wanted_file(F.col("p_name"), "e", ["a", "oo"])).select("p_partkey")


@plan(f"{_G} select image, gt_id, cast(floor(x0/0.5) as bigint) as col0, cast(ceil(x1/0.5) as bigint) as col1, cast(floor(y0/0.5) as bigint) as row0, cast(ceil(y1/0.5) as bigint) as row1, round((floor(x0/0.5)+0.5)*0.5,6) as cx, round((floor(y0/0.5)+0.5)*0.5,6) as cy from gt")
def raster_windows(spark, d):
    """Windows of pixels that a box covers, and the centre of the first one."""
    gt, res = truth(spark, d), F.lit(0.5)
    lo, hi = (lambda c: F.floor(F.col(c) / res)), (lambda c: F.ceil(F.col(c) / res))
    cx, cy = S.pixel_centre(lo("x0"), lo("y0"), 0.0, 0.5, 0.0, 0.0, 0.0, 0.5)
    return gt.select("image", "gt_id", lo("x0").alias("col0"), hi("x1").alias("col1"), lo("y0").alias("row0"), hi("y1").alias("row1"), F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"))


@plan("select l_suppkey as run, count(*) as n, cast(sum(case when l_linenumber % 3 = 0 then 1 else 0 end) as bigint) as n_oom, cast(to_json({'run': l_suppkey, 'best': min(l_extendedprice)}) as varchar) as meta from lineitem group by 1")
def run_log(spark, d):
    """A typed log of runs with their state, and their settings as JSON."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    meta = F.to_json(F.struct(F.col("l_suppkey").alias("run"), F.min("l_extendedprice").alias("best")))
    return li.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum(F.when(F.col("l_linenumber") % 3 == 0, 1).otherwise(0)).alias("n_oom"), meta.alias("meta")).withColumnRenamed("l_suppkey", "run")

