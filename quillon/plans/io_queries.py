"""Queries that write tables, logs and documents and read them back, on the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import fixtures as X
from quillon.functions.scalars import elapsed_text
from quillon.operators import matching
from quillon.plans.base import catalogue, ctes, on, r6
from quillon.plans.spatial_queries import _DET
from quillon.scratch import Scratch
from quillon.sinks import tables as sinks
from quillon.sources import files

PLANS, plan = catalogue()
bubbles, pixels, runs, log, scenes, truth, predicted, hist = (on(s) for s in (X.BUBBLES, X.PIXELS, X.RUNS, X.TRAIN_LOG, X.SCENES, X.TRUTH, X.PREDICTED, X.HISTORICAL))


def _folder(spark, name: str) -> str:
    return Scratch(spark, name).root


def _text(spark, rows: list[str], path: str) -> str:
    """Lines as one text file, written through Spark."""
    spark.createDataFrame([("\n".join(rows),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return path


@plan(f"with {ctes(bub=X.BUBBLES)} select image, bubble_id, round(area,6) as area from bub")
def feature_files(spark, d):
    """A feature table as CSV files, read back."""
    path = sinks.write_csv(bubbles(spark, d).select("image", "bubble_id", *r6("area")), f"{_folder(spark, 'features')}/bubbles")
    return spark.read.option("header", True).csv(path, schema="image long, bubble_id long, area double")


@plan(f"""{_DET}, p as (select count(*) as n_pairs, sum(iou) as s from m) select (select count(*) from det) as n_images, n_pairs, round(s,4) as iou_sum, (select cast(sum(tp) as bigint) from det) as tp from p""")
def evaluation_files(spark, d):
    """K2: the tables of an evaluation, written and read back."""
    gt, pr = truth(spark, d), predicted(spark, d)
    m = matching.match_truth(gt, pr)
    counts = matching.detection_counts(m, gt, pr)
    paths = sinks.write_evaluation({"per_image": counts, "pairs": m, "summary": matching.scores(counts)}, _folder(spark, "evaluation"))
    read = {k: spark.read.option("header", True).option("inferSchema", True).csv(p) for k, p in paths.items()}
    n = read["per_image"].agg(F.count("*").alias("n_images"))
    pairs = read["pairs"].agg(F.count("*").alias("n_pairs"), F.round(F.sum("iou"), 4).alias("iou_sum"))
    return n.crossJoin(pairs).crossJoin(read["summary"].select(F.col("tp").cast("long").alias("tp")))


@plan(f"with {ctes(gt=X.TRUTH)} select image, gt_id, round(area,6) as area, '' as class from gt where gt_id % 2 = 0")
def layer_files(spark, d):
    """K3, K4: a layer replaced by a smaller one with an empty class column."""
    path = _folder(spark, "layers")
    sinks.write_layer(truth(spark, d), path, "seeps")
    at = sinks.write_layer(truth(spark, d).where("gt_id % 2 = 0"), path, "seeps", class_column=True)
    return spark.read.parquet(at).select("image", "gt_id", *r6("area"), "class")


@plan(f"with {ctes(lg=X.TRAIN_LOG)} select run, epoch, loss, case when epoch > 2 then metric end as metric from lg where epoch <= 4")
def appended_log(spark, d):
    """K5, K6, S3: epochs added to a log whose columns grow."""
    rows, path = log(spark, d).where("epoch <= 4"), f"{_folder(spark, 'log')}/log"
    sinks.append_rows(rows.where("epoch <= 2").select("run", "epoch", "loss"), path)
    sinks.append_rows(rows.where("epoch > 2"), path)
    return spark.read.option("mergeSchema", True).parquet(path).select("run", F.col("epoch").cast("long").alias("epoch"), "loss", "metric")


@plan(f"with {ctes(px=X.PIXELS)} select image, r, c, cast(prob >= 0.5 as int) as mask, cast(round(prob*255) as int) as scaled from px where image = 1 and r between 2 and 6 and c between 3 and 8")
def raster_window(spark, d):
    """Bands of a raster, and a window of one image of them."""
    bands = {"mask": (F.col("prob") >= 0.5).cast("int"), "scaled": F.round(F.col("prob") * 255).cast("int")}
    path = sinks.write_pixels(pixels(spark, d), f"{_folder(spark, 'rasters')}/pixels", bands)
    return files.window(spark.read.parquet(path).where("image = 1"), 2, 7, 3, 9).select(F.col("image").cast("long").alias("image"), "r", "c", "mask", "scaled")


@plan(f"with {ctes(hi=X.HISTORICAL)} select id as frame_idx, case id % 3 when 0 then 'train' when 1 then 'val' else 'test' end as split from hi where id between 0 and 99")
def split_files(spark, d):
    """A split as JSON, read back; frames out of range are dropped."""
    s = hist(spark, d).select(F.col("id").alias("frame_idx"), F.when(F.col("id") % 3 == 0, "train").when(F.col("id") % 3 == 1, "val").otherwise("test").alias("split"))
    return files.split_table(spark, sinks.write_split(s, f"{_folder(spark, 'split')}/split"), 100)


@plan(f"with {ctes(hi=X.HISTORICAL)} select type_flux, count(*) as n, round(quantile_cont(length_cm,0.95),6) as p95 from hi where type_flux is not null group by 1")
def priors_files(spark, d):
    """Nested JSON documents, read back."""
    h = hist(spark, d).where("type_flux is not null").groupBy("type_flux").agg(F.count("*").alias("n"), F.round(F.percentile("length_cm", F.lit(0.95)), 6).alias("p95"))
    path = sinks.write_json(h.select("type_flux", F.struct("n", F.struct("p95").alias("size")).alias("stats")), f"{_folder(spark, 'priors')}/priors")
    doc = spark.read.schema("type_flux string, stats struct<n: bigint, size: struct<p95: double>>").json(path)
    return doc.select("type_flux", "stats.n", "stats.size.p95")


@plan(f"with {ctes(sc=X.SCENES)} select strip, count(*) as n from sc where strip < 5 group by 1")
def layer_split(spark, d):
    """One folder a value."""
    path = sinks.write_by_value(scenes(spark, d).where("strip < 5").select("scene", "strip"), f"{_folder(spark, 'strips')}/strips", "strip")
    return spark.read.parquet(path).groupBy(F.col("strip").cast("long").alias("strip")).agg(F.count("*").alias("n"))


@plan(f"with {ctes(r=X.RUNS)}, n as (select dataset, arch, count(*) as n, round(sum(iou),4) as s from r group by 1, 2) select dataset, arch, n, s, cast(3723 as bigint)*n as seconds from n")
def checkpoint_files(spark, d):
    """Result files of every group, united by name, with elapsed times."""
    r, root, specs = runs(spark, d).withColumn("elapsed", elapsed_text(F.lit(3723))), _folder(spark, "results"), []
    for dataset in ("AE", "PS", "S2"):
        for arch in ("U-Net", "Swin", "Terramind"):
            part = r.where((F.col("dataset") == dataset) & (F.col("arch") == arch)).select(F.col("iou").alias("IoU"), "elapsed")
            path = sinks.write_csv(part if arch == "Swin" else part.withColumn("checkpoint_id", F.lit("x")), f"{root}/{dataset}-{arch}")
            specs.append((path, f"{arch} | {dataset}", dataset, arch))
    rows = files.checkpoint_metrics(spark, specs, ["IoU", "dice_coef"])
    return rows.groupBy("dataset", "arch").agg(F.count("*").alias("n"), F.round(F.sum("IoU"), 4).alias("s"), F.sum(F.col("elapsed_s").cast("long")).alias("seconds"))


@plan(f"with {ctes(w=X.WEATHER)} select cast(year(ts) as int) as year, cast(month(ts) as int) as month, count(*) as n, cast(sum(temp) as bigint) as temp, cast(sum(precip_6h) as bigint) as rain from w group by 1, 2")
def weather_files(spark, d):
    """White-space separated observations."""
    w = X.project(spark, d, X.WEATHER)
    parts = [F.year("ts"), F.month("ts"), F.dayofmonth("ts"), F.hour("ts"), "temp", "dew", "pressure", "wind_dir", "wind", "sky", "precip_1h", "precip_6h"]
    path = f"{_folder(spark, 'weather')}/obs"
    w.select(F.concat_ws("   ", *parts).alias("value")).write.mode("overwrite").text(path)
    return files.weather(spark, path).groupBy("year", "month").agg(F.count("*").alias("n"), F.sum("air_temp").alias("temp"), F.sum("precip_6h").alias("rain"))


@plan("select cast(i as varchar) as a, cast(i*i as varchar) as b from range(1, 6) t(i)")
def tab_files(spark, d):
    """Tab-separated values after a preamble of 17 lines."""
    path = _text(spark, [*(f"line {i}" for i in range(17)), *(f"{i}\t{i * i}" for i in range(1, 6))], f"{_folder(spark, 'tab')}/tab")
    return files.tab_tables(spark, path, 17, ["a", "b"])


@plan(f"with {ctes(hi=X.HISTORICAL)} select id, length_cm, width_cm, 'one' as sheet from hi where id % 2 = 0 union all select id, length_cm, width_cm, 'three' from hi where id % 5 = 0")
def sheet_tables(spark, d):
    """Sheets that have all target columns; workbooks come as one table a sheet."""
    h = hist(spark, d)
    return files.sheets({"one": h.where("id % 2 = 0"), "two": h.drop("width_cm"), "three": h.where("id % 5 = 0")}, ["id", "length_cm", "width_cm"])


@plan(f"with {ctes(gt=X.TRUTH)} select gt_id as id, 'Polygon' as kind, round(x0,6) as x0, round(y0,6) as y0, round(x1,6) as x1, round(y1,6) as y1 from gt where image = 0")
def geojson_features(spark, d):
    """Features of a GeoJSON file with their bounds."""
    gt = truth(spark, d).where("image = 0")
    ring = F.format_string("[[[%.9f, %.9f], [%.9f, %.9f], [%.9f, %.9f], [%.9f, %.9f]]]", "x0", "y0", "x1", "y0", "x1", "y1", "x0", "y0")
    one = F.concat(F.lit('{"type": "Feature", "properties": {"id": '), F.col("gt_id").cast("string"), F.lit('}, "geometry": {"type": "Polygon", "coordinates": '), ring, F.lit("}}"))
    doc = gt.agg(F.concat(F.lit('{"type": "FeatureCollection", "features": ['), F.array_join(F.sort_array(F.collect_list(one)), ","), F.lit("]}")).alias("value"))
    path = f"{_folder(spark, 'geojson')}/features"
    doc.coalesce(1).write.mode("overwrite").text(path)
    return files.geojson(spark, path, "id: bigint").select("id", "kind", *r6("x0", "y0", "x1", "y1"))


@plan("select 'Northern_lake_20200705_3m_T1' as filename, 'Northern' as region, 'lake' as target, timestamp '2020-07-05' as date, '3m' as resolution, 'T1' as tile union all select 'Plain', 'Plain', 'unknown', null, 'unknown', 'unknown'")
def aoi_files(spark, d):
    """Area files and what their names say."""
    root = _folder(spark, "aois")
    names = ("Northern_lake_20200705_3m_T1", "Plain")
    sc = spark.sparkContext
    for name in names:  # two files of one byte, made through the file system that Spark uses
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}.gpkg")
        stream = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path)
        stream.write(1)
        stream.close()
    return files.aois(spark, root)
