"""Hand-made cases of regions, tables, groupings, draws and files."""

import math

import pytest
from pyspark.sql import functions as F

from quillon import scratch
from quillon.functions import scalars as S
from quillon.operators import draws, extras, grouping, regions, selection, tables
from quillon.sinks import tables as sinks
from quillon.sources import files


def region(spark, rows, label=1):
    at = [(0, label, r, c) for r, line in enumerate(rows) for c, x in enumerate(line) if x == "#"]
    return spark.createDataFrame(at, "image int, label int, r int, c int")


def test_hulls(spark):
    """Solid shapes fill their hull; of a corner the hull takes the pixels under its slope."""
    for rows, area, hull in ((["###", "###"], 6, 6), (["#"], 1, 1), (["#..", "#..", "###"], 5, 6), (["#.#", "...", "#.#"], 4, 9)):
        got = regions.hull_areas(region(spark, rows), ["image", "label"]).first()
        assert (region(spark, rows).count(), got.hull) == (area, hull), rows


def test_shapes(spark):
    square = regions.shapes(region(spark, ["####"] * 4), ["image", "label"]).first()
    assert (square.area, square.perimeter, square.eccentricity) == (16, 12.0, 0.0)
    line = regions.shapes(region(spark, ["#####"]), ["image", "label"]).first()
    assert line.eccentricity == 1.0
    wide = regions.shapes(region(spark, ["####", "####"]), ["image", "label"]).first()
    assert wide.eccentricity == pytest.approx(math.sqrt(1 - 0.25 / 1.25))


def test_dissolve_counts_repeated_pixels_once(spark):
    two = region(spark, ["##", "##"], 1).unionByName(region(spark, [".##", ".##"], 2)).withColumn("g", F.lit(1))
    row = regions.dissolve(two, ["image"], "g").first()
    assert (row.area, row.perimeter) == (6, 10)


def test_share_on_the_limit_is_kept(spark):
    r = region(spark, ["##"], 1).unionByName(region(spark, ["...", "###"], 2))
    flagged = spark.createDataFrame([(0, 0, 0), (0, 1, 0), (0, 1, 1)], "image int, r int, c int")
    assert {x.label for x in regions.drop_by_share(r, flagged, 0.5).collect()} == {1}


def test_rasterize_touched(spark):
    box = spark.createDataFrame([(0, 1, 0.2, 0.2, 1.4, 0.9)], "image int, id int, x0 double, y0 double, x1 double, y1 double")
    at = lambda touched: sorted((r.r, r.c) for r in regions.rasterize(box, "id", 1.0, touched).collect())
    assert at(False) == [(0, 0)] and at(True) == [(0, 0), (0, 1)]


def test_patch_starts_leave_out_the_last(spark):
    sizes = spark.createDataFrame([(0, 10, 5)], "image int, rows long, cols long")
    assert sorted((r.pr, r.pc) for r in regions.patch_starts(sizes, 6, 2).collect()) == [(0, 0), (2, 0)]


def test_tables(spark):
    df = spark.createDataFrame([(1, "x", None), (2, None, 4.0), (3, "y", 6.0)], "id int, name string, v double")
    assert tables.reorder(df, ["v", "none"], "id").columns == ["v", "name", "id"]
    assert tables.first_columns(df.select("id", "name", F.lit(9).alias("id"))).collect()[0].id == 1
    assert [r.v for r in tables.median_fill(df, ["v"]).orderBy("id").collect()] == [5.0, 4.0, 6.0]
    seeded = tables.add_group_fields(df.select(F.col("id").alias("seep_id"), F.col("name").alias("class")), discard_class=True).orderBy("seep_id").collect()
    assert [(r.seep_group_id, r.is_pregrouped, r["class"]) for r in seeded] == [(1, 0, ""), (2, 0, None), (3, 0, "")]
    newer = spark.createDataFrame([(1, 7.0), (2, None)], "id int, v double")
    assert [r.v for r in tables.update_by(df, newer, "id", ["v"]).orderBy("id").collect()] == [7.0, 4.0, 6.0]


def test_ranked_equals_a_plain_window(spark):
    from pyspark.sql import Window

    df = spark.range(500).select("id", F.when(F.col("id") % 7 != 0, F.col("id") % 3).alias("cell"))
    order = [(F.col("id") * 31) % 17, F.col("id")]
    plain = df.withColumn("k", F.row_number().over(Window.partitionBy("cell").orderBy(*order)).cast("long"))
    assert sorted(selection.ranked(df, ["cell"], order).collect(), key=str) == sorted(plain.collect(), key=str)


def test_best_cut_over_many_ranges(spark):
    df = spark.range(2000).select((F.col("id") % 500).cast("double").alias("v"), (F.col("id") % 500 >= 321).alias("p"))
    row = selection.best_cut(df.repartition(7), "v", F.col("p")).first()
    assert (row.cut, row.score) == (320.5, 1.0)


def test_error_decomposition(spark):
    rows = [("h1", "r1", "A"), ("h1", "r2", "A"), ("h2", "r3", "A"), ("h3", "r3", "B"), ("h4", "r4", "C"), ("h5", "r4", "C")]
    got = {(r.kind, r.classes, r.n, r.extra) for r in grouping.error_decomposition(spark.createDataFrame(rows, "human string, rule string, hclass string")).collect()}
    assert got == {("fragmented", "A", 1, 1), ("cross", "A+B", 1, 0), ("within", "C", 1, 0)}


def test_tree_leaves_missing_features_empty(spark):
    rows = spark.createDataFrame([(float(i), "A" if i < 20 else "B") for i in range(40)] + [(None, "A")], "v double, c string")
    got = grouping.apply_tree(grouping.class_tree(rows, ["v"], "c"), rows, ["v"]).collect()
    assert all(r.predicted == ("" if r.v is None else r.c) for r in got)


def test_effects(spark):
    assert draws.effect_codes(["a", "b", "c"]) == [[1, 0], [0, 1], [-1, -1]]
    cells = spark.createDataFrame([(0, i, j, float(i + 2 * j)) for i in range(2) for j in range(2)], "sample int, d int, a int, value double")
    got = {(r.d, r.a): r.delta for r in draws.factor_effects(cells, "d", "a").collect()}
    assert got[(0, None)] == -0.5 and got[(None, 1)] == 1.0 and got[(1, 1)] == 0.0
    free = spark.createDataFrame([(0, 0, None, 1.0), (0, 1, None, 2.0), (0, None, 0, 4.0), (0, 0, 0, 0.5), (0, 1, 0, 0.25)], "sample int, a int, b int, value double")
    last = {(r.a, r.b): r.value for r in draws.implied_effects(free, "a", "b").collect() if -1 in (r.a, r.b)}
    assert last == {(-1, None): -3.0, (None, -1): -4.0, (-1, 0): -0.75, (0, -1): -0.5, (1, -1): -0.25, (-1, -1): 0.75}


def test_robust_scores_are_cut_off(spark):
    df = spark.createDataFrame([(0, g, v) for g, v in enumerate([1.0, 2.0, 3.0, 4.0, 500.0])], "sample int, grp int, value double")
    got = {r.grp: r.value for r in draws.row_scores(df, "robust_z").collect()}
    assert got[2] == 0 and got[4] == 8.0 and got[0] == pytest.approx(-2 / 1.4826)


def test_labels_of_factors(spark):
    cuts = [0.05, 0.1, 0.5, 1.0, 3.0, 100.0, None]
    row = [r.x for r in spark.createDataFrame([(i, c) for i, c in enumerate(cuts)], "i int, b double").orderBy("i").select(S.evidence_label(F.col("b")).alias("x")).collect()]
    assert row[0].startswith("strong evidence for H0") and row[1].startswith("moderate evidence for H0") and row[3].startswith("anecdotal evidence for H1")
    assert row[4] == "moderate evidence for H1" and row[5] == "extreme evidence for H1" and row[6] is None


def test_strict_log_refuses(spark):
    df = spark.createDataFrame([(-1e-7,), (1.0,)], "y double")
    assert [round(r.x, 3) for r in df.select(S.strict_log(F.col("y")).alias("x")).collect()] == [-27.631, 0.0]
    with pytest.raises(Exception, match="no logarithm"):
        spark.createDataFrame([(-1.0,)], "y double").select(S.strict_log(F.col("y")).alias("x")).collect()


def test_interval_columns_and_systems(spark):
    assert extras.interval_columns(["mean", "hdi_97%", "hdi_3%", "sd"]) == ("hdi_3%", "hdi_97%")
    a = spark.createDataFrame([(1,)], "srid int")
    assert extras.same_srid(a, a) == [a, a]
    with pytest.raises(ValueError, match="reference"):
        extras.same_srid(a, spark.createDataFrame([(2,)], "srid int"))
    assert extras.ChipParameters(10.0).padded == pytest.approx(12.0)


def test_split_with_ids(spark, tmp_path):
    split = spark.createDataFrame([(0, "train"), (2, "val"), (9, "test")], "frame_idx long, split string")
    path = sinks.write_split(split, str(tmp_path / "split"))
    assert {(r.frame_idx, r.split) for r in files.split_table(spark, path, 100, ids=[40, 41, 42]).collect()} == {(40, "train"), (42, "val")}


def test_scratch_keeps_one_table_and_clears(spark, tmp_path):
    import os

    own = scratch.Scratch(spark, "test")
    for name in ("a", "b"):
        own.write(name, spark.range(3))
    own.keep("b")
    folder = own.root.removeprefix("file:")
    assert os.path.isdir(f"{folder}/b") and not os.path.isdir(f"{folder}/a")
