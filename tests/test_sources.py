import sqlite3
import struct

from pyspark.sql import functions as F

from quillon import fixtures
from quillon.plans.spatial_queries import ANCHOR, CAP, RADIUS
from quillon.sources import files
from quillon.sources.gpkg import GpkgSource, srid_of
from quillon.streaming.clusters import cluster_stream, windowed_counts


def test_metric_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("run_name,iou,elapsed\nx,0.5,01:00:01\ny,nan,00:00:02\n")
    (tmp_path / "b.csv").write_text("checkpoint_id,run_name,unc,iou,elapsed\n7,z,0.1,0.25,00:01:00\n")
    specs = [(str(tmp_path / "a.csv"), "g", "AE", "U"), (str(tmp_path / "b.csv"), "h", "PS", "S")]
    got = {(r.group, r.iou, r.unc, r.elapsed_s) for r in files.checkpoint_metrics(spark, specs, ["iou", "unc", "absent"]).collect()}
    assert got == {("g", 0.5, None, 3601), ("g", None, None, 2), ("h", 0.25, 0.1, 60)}
    assert files.checkpoint_metrics(spark, [], ["iou"]).count() == 0


def test_logs_weather_and_splits(spark, tmp_path):
    (tmp_path / "log.csv").write_text("epoch,loss,val_iou\n1,0.5,\n2,0.4,0.3\n")
    got = {(r.epoch, r.metric, r.value) for r in files.training_log(spark, str(tmp_path / "log.csv"), "r").collect()}
    assert got == {(1, "loss", 0.5), (1, "val_iou", None), (2, "loss", 0.4), (2, "val_iou", 0.3)}
    (tmp_path / "w.txt").write_text(" 2020 01 02  03 -105 -9999 10132 360 51 8 -1 -9999\n\n")
    row = files.weather(spark, str(tmp_path / "w.txt")).collect()
    assert len(row) == 1 and (row[0].hour, row[0].air_temp, row[0].precip_1h) == (3, -105, -1)
    (tmp_path / "s.json").write_text('{"training_frames": [0, 1, 99],\n "val": [2], "test": []}')
    assert {(r.frame_idx, r.split) for r in files.split_table(spark, str(tmp_path / "s.json"), 10).collect()} == {(0, "train"), (1, "train"), (2, "val")}
    assert files.listing(spark, str(tmp_path), r"\.json$").count() == 2


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "x.gpkg")
    blob = b"GP\x00\x01" + struct.pack("<i", 4326) + struct.pack("<BIdd", 1, 1, 2.0, 3.0)
    with sqlite3.connect(path) as con:
        con.executescript("create table gpkg_contents (table_name text, data_type text); create table gpkg_geometry_columns (table_name text, column_name text); create table pts (fid integer primary key, geom blob, name text, ok boolean, v double);")
        con.execute("insert into gpkg_contents values ('pts', 'features')")
        con.execute("insert into gpkg_geometry_columns values ('pts', 'geom')")
        con.executemany("insert into pts values (?, ?, ?, ?, ?)", [(i, blob, f"n{i}", i % 2, i / 2) for i in range(1, 8)])
    spark.dataSource.register(GpkgSource)
    df = spark.read.format("gpkg").option("path", path).option("rows", "3").load()
    rows = df.orderBy("fid").collect()
    assert len(rows) == 7 and rows[0].ok is True and rows[1].v == 1.0 and struct.unpack("<dd", bytes(rows[0].geom)[5:]) == (2.0, 3.0)
    assert srid_of(blob) == 4326 and df.rdd.getNumPartitions() == 3


def test_streams(spark, tmp_path):
    points = fixtures.project(spark, "/root/testdata/sf0.001", fixtures.BUBBLES)
    points.write.parquet(str(tmp_path / "in"))
    schema = ", ".join(f"{n} {t}" for n, t in points.dtypes)
    cluster_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "ck"), ANCHOR, RADIUS, CAP).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.agg(F.sum("n_bubbles")).first()[0] == points.count()
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()
