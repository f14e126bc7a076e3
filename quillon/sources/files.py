"""File scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.scalars import elapsed_seconds

WEATHER = ["year", "month", "day", "hour", "air_temp", "dew_point", "pressure", "wind_direction", "wind_speed", "sky_condition", "precip_1h", "precip_6h"]


def checkpoint_metrics(spark: SparkSession, specs: list[tuple[str, str, str, str]], metrics: list[str]) -> DataFrame:
    """CSV files (path, group, dataset, arch) united by column name; the metrics present, and elapsed seconds.

    No spec gives an empty typed table; a metric that no file has is left out.
    """
    parts = []
    for path, group, dataset, arch in specs:
        rows = spark.read.option("header", True).csv(path)
        have = [m for m in metrics if m in rows.columns]
        seconds = elapsed_seconds(F.col("elapsed")) if "elapsed" in rows.columns else F.lit(None).cast("int")
        numbers = [F.when(~F.isnan(F.expr(f"try_cast(`{m}` as double)")), F.expr(f"try_cast(`{m}` as double)")).alias(m) for m in have]
        parts.append(rows.select(F.lit(group).alias("group"), F.lit(dataset).alias("dataset"), F.lit(arch).alias("arch"), *numbers, seconds.alias("elapsed_s")))
    if not parts:
        return spark.createDataFrame([], "group string, dataset string, arch string, elapsed_s int")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def training_log(spark: SparkSession, path: str, run: str) -> DataFrame:
    """S3: a log with any columns as (run, epoch, metric, value)."""
    rows = spark.read.option("header", True).csv(path)
    names = [c for c in rows.columns if c != "epoch"]
    wide = rows.select(F.lit(run).alias("run"), F.col("epoch").cast("int").alias("epoch"), *(F.expr(f"try_cast(`{c}` as double)").alias(c) for c in names))
    return wide.unpivot(["run", "epoch"], names, "metric", "value")


def weather(spark: SparkSession, path: str) -> DataFrame:
    """White-space separated observations without a header."""
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select(*(part[i].cast("int").alias(n) for i, n in enumerate(WEATHER)))


def split_table(spark: SparkSession, path: str, n_frames: int, ids: list[int] | None = None) -> DataFrame:
    """A split file with long or short keys as (frame_idx, split); indices out of range are dropped.

    With ``ids`` the file's numbers are places in that list, which names the frames.
    """
    keys = {"train": ("training_frames", "train"), "val": ("validation_frames", "val"), "test": ("testing_frames", "test")}
    schema = ", ".join(f"{k} array<bigint>" for pair in keys.values() for k in pair)
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("s"))
    parts = [doc.select(F.explode(F.coalesce(F.col(f"s.{a}"), F.col(f"s.{b}"))).alias("frame_idx"), F.lit(name).alias("split")) for name, (a, b) in keys.items()]
    out = reduce(DataFrame.unionByName, parts)
    if ids is not None:
        table = spark.createDataFrame(list(enumerate(ids)), "frame_idx long, id long")
        out = out.join(F.broadcast(table), "frame_idx").select(F.col("id").alias("frame_idx"), "split")
    return out.where(F.col("frame_idx").between(0, n_frames - 1))


def tab_tables(spark: SparkSession, path: str, skip: int, names: list[str]) -> DataFrame:
    """Tab-separated files whose first lines are a preamble; a file is read whole, as such logs are small."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    part = F.split("line", "\t")
    return lines.where((F.col("at") >= skip) & (F.trim("line") != "")).select(*(F.trim(F.get(part, F.lit(i))).alias(n) for i, n in enumerate(names)))


def sheets(tables: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """The sheets that have all target columns, with their name; other sheets are left out."""
    parts = [df.select(*columns, F.lit(name).alias("sheet")) for name, df in tables.items() if set(columns) <= set(df.columns)]
    if not parts:
        raise ValueError("no sheet has all columns")
    return reduce(DataFrame.unionByName, parts)


def geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON files as their properties and (kind, bounds of all coordinates)."""
    schema = f"features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>"
    doc = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", schema)["features"]).alias("f"))
    pair = F.regexp_extract_all(F.col("f.geometry.coordinates"), F.lit(r"\[\s*(-?[0-9.eE+-]+\s*,\s*-?[0-9.eE+-]+)"), 1)
    side = lambda i: F.transform(pair, lambda p: F.trim(F.split(p, ",")[i]).cast("double"))
    bounds = {"x0": F.array_min(side(0)), "y0": F.array_min(side(1)), "x1": F.array_max(side(0)), "y1": F.array_max(side(1))}
    return doc.select("f.properties.*", F.col("f.geometry.type").alias("kind"), *(c.alias(n) for n, c in bounds.items()))


def aois(spark: SparkSession, path: str) -> DataFrame:
    """Area files with what their names say: region, target, date, resolution and tile, by underscores."""
    stem = F.regexp_extract(F.col("path"), r"([^/]+)\.[^./]+$", 1)
    part = F.split(stem, "_")
    safe = lambda i: F.coalesce(F.nullif(F.trim(F.get(part, F.lit(i))), F.lit("")), F.lit("unknown"))
    day = F.when(F.rlike(safe(2), F.lit(r"^\d{8}$")), F.try_to_timestamp(safe(2), F.lit("yyyyMMdd")))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.select(stem.alias("filename"), safe(0).alias("region"), safe(1).alias("target"), day.alias("date"), safe(3).alias("resolution"), safe(4).alias("tile"))


def window(pixels: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """The pixels of a window; ends are exclusive."""
    return pixels.where(F.col("r").between(r0, r1 - 1) & F.col("c").between(c0, c1 - 1))


def synthetic_runs(spark: SparkSession, groups: list[str], runs: int, seed: int = 7) -> DataFrame:
    """Seeded fixture of run metrics, beta-distributed around a mean of each group's own."""
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(seed))
    rows = [(g, i, float(rng.beta(8 + k, 4))) for k, g in enumerate(groups) for i in range(runs)]
    return spark.createDataFrame(rows, "group string, run int, iou double")


def listing(spark: SparkSession, path: str, exclude: str) -> DataFrame:
    """Files under a folder whose names do not match a pattern."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    return rows.where(~F.rlike("path", F.lit(exclude)))
