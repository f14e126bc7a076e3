"""Projections of the test tables into the engine's input schemas.

The SQL is portable: Spark runs it over temporary views and the oracle runs the same
text as a subquery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_U = "cast((o_orderkey*o_orderkey*359 + o_orderkey*8191) % 9973 as double)/9973"
_RADIUS = "(cast(0.03 as double)+cast(0.15 as double)*u*u*u)"

BUBBLES = f"""select cast(floor(o_orderkey/500) as bigint) as image, cast(o_orderkey % 500 + 1 as bigint) as bubble_id,
 cast((o_orderkey*o_orderkey*7919 + o_orderkey*101) % 10007 as double)/10007*20 as x,
 cast((o_orderkey*o_orderkey*6007 + o_orderkey*337 + 31) % 10009 as double)/10009*20 as y,
 pi()*{_RADIUS}*{_RADIUS} as area, 2*pi()*{_RADIUS}*(1+cast(o_orderkey % 7 as double)/20) as perim,
 pi()*{_RADIUS}*{_RADIUS}*(1+cast(o_orderkey % 5 as double)/10) as hull, cast(o_orderkey % 13 as double)/13 as eccentricity,
 cast((o_orderkey*37) % 256 as double) as red, cast((o_orderkey*61) % 256 as double) as green, cast((o_orderkey*89) % 256 as double) as blue
 from (select o_orderkey, {_U} as u from orders) t"""

_SQUARE = f"select image, bubble_id, x, y, sqrt(area)/2 as h from ({BUBBLES}) b"
TRUTH = f"select image, bubble_id as gt_id, x-h as x0, y-h as y0, x+h as x1, y+h as y1, h*h*4 as area from ({_SQUARE}) s"
_SHIFT = "cast((bubble_id*31) % 17 - 8 as double)/100"
PREDICTED = f"""select image, bubble_id as pred_id, x+{_SHIFT}-h as x0, y-h as y0, x+{_SHIFT}+h as x1, y+h as y1, h*h*4 as area from ({_SQUARE}) s where bubble_id % 11 <> 0
 union all select image, bubble_id+100000, x+50-h, y-h, x+50+h, y+h, h*h*4 from ({_SQUARE}) s where bubble_id % 13 = 0"""

LABELS = f"""select image, bubble_id as seep_id, labeler, cast(floor((bubble_id-1)/3) as bigint) + case when (bubble_id + labeler) % 7 = 0 then 1 else 0 end as grp,
 case when (bubble_id*labeler) % 10 = 0 then case when area < 0.02 then 'B' when area < 0.05 then 'C' else 'A' end
  else case when area < 0.02 then 'A' when area < 0.05 then 'B' else 'C' end end as class,
 case when bubble_id % 17 = labeler % 2 then 1 else 0 end as is_pregrouped, case when bubble_id <= 75 then true else false end as is_calibration, area, x, y
 from ({BUBBLES}) b cross join (select 1 as labeler union all select 2 union all select 3) l where bubble_id <= 75 or bubble_id % 3 + 1 = labeler"""

PIXELS = """select cast(floor(o_orderkey/500) as bigint) as image, cast(floor((o_orderkey % 500)/25) as bigint) as r, cast(o_orderkey % 25 as bigint) as c,
 case when (o_orderkey*7919) % 100 < 30 then 1 else 0 end as gt,
 cast(0.4 as double)*(case when (o_orderkey*7919) % 100 < 30 then 1 else 0 end) + cast(0.6 as double)*(cast((o_orderkey*6007+31) % 1009 as double)/1009) as prob,
 cast((o_orderkey*37) % 256 as double) as b1, cast((o_orderkey*61) % 256 as double) as b2, cast((o_orderkey*89) % 256 as double) as b3 from orders"""

RUNS = """select case l_returnflag when 'A' then 'AE' when 'N' then 'PS' else 'S2' end as dataset,
 case l_linenumber % 3 when 0 then 'U-Net' when 1 then 'Swin' else 'Terramind' end as arch, l_discount*9+cast(0.05 as double) as iou, l_tax as unc from lineitem"""

ACQUISITIONS = """select user_id as aoi, case event_type when 'purchase' then 'Aerial' when 'view' then 'Sentinel-2' when 'click' then 'PS' else 'Other' end as sensor,
 cast(ts as timestamp) as t, event_id from events"""

_TEMP = "cast(floor((value - 40*floor(value/40) - 5)*10) as int)"
WEATHER = f"""select event_id, cast(ts as timestamp) as ts, case event_id % 31 when 7 then -9999 else {_TEMP} end as temp, {_TEMP} - cast(event_id % 70 as int) as dew,
 10130 as pressure, case event_id % 13 when 5 then -9999 else cast(event_id % 5 * 9 as int) end as wind, case event_id % 11 when 3 then -9999 else cast(user_id % 6 as int) end as sky,
 case event_id % 9 when 0 then -1 when 1 then -9999 else cast(event_id % 4 as int) end as precip_1h, case event_id % 7 when 0 then -1 when 1 then -9999 else cast(event_id % 6 as int) end as precip_6h,
 cast((event_id*30) % 390 as int) as wind_dir from events"""

SCENES = """select l_suppkey as aoi, l_orderkey as scene, l_linenumber as part, l_partkey % 20 as strip, cast(l_shipdate as timestamp) as acquired, l_discount*8 as cloud,
 case when l_linenumber = 7 then null else cast(l_partkey % 101 as double) end as scene_cloud,
 cast(l_partkey % 100 as int) as first_cell, cast(l_partkey % 100 + l_linenumber as int) as last_cell, l_extendedprice as price from lineitem"""

TRAIN_LOG = """select l_suppkey as run, row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) as epoch,
 l_extendedprice as loss, l_quantity as metric from lineitem"""

HISTORICAL = """select p_partkey as id, case p_size % 6 when 0 then 'a' when 1 then 'b' when 2 then 'c' when 3 then 'ap' when 4 then 'hso' else null end as type_flux,
 cast(p_size as double) as length_cm, p_size*cast(0.7 as double)+cast(p_partkey % 5 as double) as width_cm from part"""

#: Nine groups (three datasets by three models): the first nine places of each vector; the others are no groups.
DRAWS_ORACLE = "select cast(vec_id as bigint) as sample, cast(unnest(range(9)) as bigint) as grp, cast(embedding[unnest(range(1,10))] as double) as value from embeddings"

#: Four overlapping label areas an image, and the images' bounds.
_IMAGES = "select distinct cast(floor(o_orderkey/500) as bigint) as image from orders"
AREAS = f"""select image, q as area_id, cast(q % 2 as double)*8 as x0, cast(floor(q/2) as double)*8 as y0, cast(q % 2 as double)*8+12 as x1, cast(floor(q/2) as double)*8+12 as y1, cast(144 as double) as area
 from ({_IMAGES}) i cross join (select cast(0 as bigint) as q union all select 1 union all select 2 union all select 3) a"""

#: A flight track: a counter with gaps, and a place that is missing now and then.
TRACK = """select user_id as flight, cast(ts as timestamp) as t, event_id, event_id - cast(floor(event_id/7) as bigint) % 3 as stati,
 case when event_id % 17 = 3 then null else value end as x, value*2 as y from events"""

#: Names of files in two folders, by position.
FOLDER_A = "select cast(row_number() over (order by c_custkey) - 1 as bigint) as idx, c_name as name from customer where c_custkey % 3 <> 0"
FOLDER_B = "select cast(row_number() over (order by c_custkey desc) - 1 as bigint) as idx, c_name as name from customer where c_custkey % 4 <> 0"

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


def project(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The projection over the tables of ``sf_dir``; only the tables that it names are read."""
    args = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in sql}
    for name in args:
        sql = sql.replace(f"from {name}", f"from {{{name}}}")
    return spark.sql(sql, **args)


def draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior draws (sample, grp, value): nine groups from the first places of the vectors."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("cast(vec_id as bigint) as sample", "posexplode(embedding) as (grp, v)")
    return rows.where("grp < 9").selectExpr("sample", "cast(grp as bigint) as grp", "cast(v as double) as value")
