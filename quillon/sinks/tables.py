"""Writers of tables, logs and JSON documents.

Tables go to a folder that all machines share, through Spark's writers, one file a task.
JSON documents hold one row (a split, priors) and are made by aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> str:
    """K1: a table as CSV files with a header, replaced if it exists."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def write_evaluation(tables: dict[str, DataFrame], path: str) -> dict[str, str]:
    """K2: the tables of an evaluation, each in a folder of its own; ``summary`` has one row."""
    return {name: write_csv(df, f"{path}/{name}") for name, df in tables.items()}


def write_layer(df: DataFrame, path: str, layer: str, class_column: bool = False) -> str:
    """K3, K4: a layer as Parquet with WKB geometry, replaced if it exists; with an empty class column on request."""
    out = df.withColumn("class", F.lit("")) if class_column and "class" not in df.columns else df
    out.write.mode("overwrite").parquet(f"{path}/{layer}")
    return f"{path}/{layer}"


def append_rows(df: DataFrame, path: str) -> str:
    """K5, K6: rows added to a log; its schema may grow, readers merge it."""
    df.write.mode("append").parquet(path)
    return path


def write_pixels(pixels: DataFrame, path: str, bands: dict[str, Column]) -> str:
    """K7: bands of a pixel relation, partitioned by image for readers of single rasters."""
    rows = pixels.select("image", "r", "c", *(c.alias(n) for n, c in bands.items()))
    rows.repartition("image").write.mode("overwrite").partitionBy("image").parquet(path)
    return path


def write_split(split: DataFrame, path: str) -> str:
    """K8: (frame_idx, split) as one JSON object of three sorted lists."""
    names = {"train": "training_frames", "val": "validation_frames", "test": "testing_frames"}
    lists = [F.sort_array(F.collect_list(F.when(F.col("split") == k, F.col("frame_idx")))).alias(n) for k, n in names.items()]
    split.agg(*lists).select(F.to_json(F.struct(*names.values())).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return path


def write_json(df: DataFrame, path: str) -> str:
    """Each row as a JSON document; nested columns become nested objects."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)
    return path


def write_by_value(df: DataFrame, path: str, column: str) -> str:
    """One folder for each value of a column."""
    df.write.mode("overwrite").partitionBy(column).parquet(path)
    return path
