"""Hand-made cases for ties, edges and defects that are kept on purpose."""

import math

import pytest
from pyspark.sql import functions as F

from quillon.functions import scalars as S
from quillon.operators import cluster, draws, labels, matching, metrics, regions, selection, temporal
from quillon.operators.graph import connected_components
from quillon.schemas import assert_schema, optional_col


def points(spark, rows):
    return spark.createDataFrame([(0, i, float(x), float(y), float(a)) for i, x, y, a in rows], "image long, bubble_id long, x double, y double, area double")


def ids(df):
    return {r.bubble_id: r.cluster_id for r in df.select("bubble_id", "cluster_id").collect()}


def test_anchor_edges(spark):
    """Radius and thresholds are inclusive; equal distances go to the smaller id; medium points stay alone."""
    df = points(spark, [(1, 0, 0, 1.0), (2, 2, 0, 1.0), (3, 1, 0, 0.1), (4, -1, 0, 0.1), (5, 0, -1.5, 0.1), (6, 0, 0.5, 0.5)])
    got = ids(cluster.anchor_cluster(df, 1.0, 1.0, 0.1))
    assert got == {1: 1, 2: 2, 3: 1, 4: 1, 5: 5, 6: 6}


def test_lonely_keeps_the_defect(spark):
    """An anchor that owns a satellite can be relabelled while the satellite keeps its id."""
    df = points(spark, [(1, 0, 0, 1.0), (2, 0.5, 0, 0.1), (3, -0.3, 0, 2.0)])
    first = cluster.anchor_cluster(df.where("bubble_id <> 3"), 1.0, 0.6, 0.1).unionByName(cluster.anchor_cluster(df.where("bubble_id = 3"), 1.0, 0.6, 0.1))
    assert ids(cluster.lonely_cluster(first, 0.4, 1.0, 2)) == {1: 3, 2: 1, 3: 3}
    assert ids(cluster.lonely_cluster(first, 0.4, 1.0, 1)) == {1: 1, 2: 1, 3: 3}  # the halo count equals the limit
    assert ids(cluster.lonely_cluster(first, 0.4, 1.0, 2, strict_singletons=True)) == {1: 1, 2: 1, 3: 3}


def test_single_member_features(spark):
    df = points(spark, [(1, 0, 0, 1.0)])
    for c in ("perim", "hull", "red", "green", "blue", "eccentricity"):
        df = df.withColumn(c, F.lit(1.0))
    row = cluster.cluster_features(cluster.anchor_cluster(df, 1.0, 1.0)).first()
    assert (row.std_area, row.radius, row.n_bubbles) == (0.0, 0.0, 1)


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = connected_components(edges)
    assert got.count() == 201 and got.select("root").distinct().collect()[0].root == 0
    assert connected_components(edges.where("src < 0")).count() == 0


def test_matching_ties(spark):
    box = "image long, {} long, x0 double, y0 double, x1 double, y1 double, area double"
    gt = spark.createDataFrame([(0, 1, 0.0, 0.0, 1.0, 1.0, 1.0), (0, 2, 5.0, 5.0, 6.0, 6.0, 1.0)], box.format("gt_id"))
    pred = spark.createDataFrame([(0, 7, 0.5, 0.0, 1.5, 1.0, 1.0), (0, 6, -0.5, 0.0, 0.5, 1.0, 1.0)], box.format("pred_id"))
    found = matching.match_truth(gt, pred).collect()
    assert [(r.gt_id, r.pred_id) for r in found] == [(1, 6)]
    fn, fp = matching.unmatched(matching.match_truth(gt, pred), gt, pred)
    assert [r.gt_id for r in fn.collect()] == [2] and [r.pred_id for r in fp.collect()] == [7]


def test_one_to_one_is_greedy(spark):
    pairs = spark.createDataFrame([(0, 1, 5, 0.5), (0, 1, 6, 0.4), (0, 2, 5, 0.9), (0, 3, 5, 0.2), (0, 3, 6, 0.3)], "image long, gt_id long, pred_id long, iou double")
    got = {(r.gt_id, r.pred_id) for r in matching.match_one_to_one(pairs).collect()}
    assert got == {(1, 5), (3, 6)}


def test_correlation_needs_five(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(5)], "a double, b double")
    assert df.limit(4).agg(matching.pearson("a", "b").alias("r")).first().r is None
    assert df.agg(matching.pearson("a", "b").alias("r")).first().r == pytest.approx(1)


def test_surfaces_of_empty_masks(spark):
    images = spark.createDataFrame([(0,), (1,)], "image long")
    one = spark.createDataFrame([(1, 0, 0)], "image long, r long, c long")
    got = {r.image: r.nsd for r in metrics.surface_dice(one, one.where("r < 0"), images).collect()}
    assert got == {0: 1.0, 1: 0.0}


def test_label_rules(spark):
    df = spark.createDataFrame([(1, "B"), (1, "A"), (1, ""), (1, None), (2, "C")], "k long, v string")
    assert {r.k: r.v for r in labels.mode(df, ["k"], "v").collect()} == {1: "A", 2: "C"}
    same = spark.createDataFrame([(i, "A") for i in (1, 1, 2, 2)], "item long, c string")
    assert labels.fleiss_kappa(same, ["item"], "c").first().kappa == 1.0


def test_nearest_time_ties_go_to_the_earlier(spark):
    left = spark.createDataFrame([(1, "2024-01-02 00:00:00"), (2, "2024-01-02 00:00:00")], "k long, t string").withColumn("t", F.to_timestamp("t"))
    right = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-03 00:00:00")], "k long, t string").withColumn("t", F.to_timestamp("t"))
    got = {r.k: r.diff_hours for r in temporal.nearest_asof(left, right, "k", "t", "near").collect()}
    assert got == {1: 24.0, 2: None}


def test_weather_cases_overlap(spark):
    rows = [(15.0, 2.0, None, 3), (20.0, None, 0.0, None), (25.0, 2.1, 0.0, 3), (20.0, 0.0, 0.0, 3), (20.0, 1.0, 0.1, 3), (None, None, None, None)]
    df = spark.createDataFrame(rows, "temp double, wind double, precip_1h double, sky int").select(*(c.alias(n) for n, c in temporal.weather_cases().items()))
    got = [[n for n in df.columns if r[n]] for r in df.collect()]
    assert got == [["perfect", "not_sure", "too_cold"], ["not_sure"], ["too_hot"], [], ["rain"], []]


def test_weather_is_prepared(spark):
    rows = [(150, -9999, 30, 360, -1, 5), (-9999, 100, 0, 0, -9999, -1), (200, 90, 20, 90, 12, 0)]
    df = temporal.prepare_weather(spark.createDataFrame(rows, "temp int, dew int, wind int, wind_dir int, precip_1h int, precip_6h int"))
    got = [tuple(r) for r in df.select("temp", "dew", "wind", "wind_dir", "precip_1h", "precip_6h", "trace_1h", "trace_6h").collect()]
    assert got == [(15.0, None, 3.0, 0, None, 0.5, True, False), (None, 10.0, 0.0, None, None, None, False, True), (20.0, 9.0, 2.0, 90, 1.2, 0.0, False, False)]


def test_humidity_by_hand(spark):
    rh, wet = temporal.humidity("t", "d")
    row = spark.createDataFrame([(20.0, 20.0), (20.0, 10.0)], "t double, d double").select(rh.alias("rh"), wet.alias("wet")).collect()
    assert row[0].rh == 100 and row[1].rh == pytest.approx(100 * math.exp(17.625 * 10 / 253.04 - 17.625 * 20 / 263.04))
    assert row[1].wet == pytest.approx(14.05, abs=0.1)


def test_rank_key_weighs_days_against_cloud(spark):
    rows = [(1, 1, 1, 1, "2000-01-01", 0.005, 50.0, 1.0), (1, 2, 1, 1, "2000-01-05", 0.0, 50.0, 1.0), (1, 3, 1, 2, "2000-01-02", None, None, 1.0), (1, 4, 1, 3, "2000-01-07", 0.0, None, 1.0), (1, 5, 1, 3, "2000-01-02", 0.005, 3.0, 1.0)]
    df = spark.createDataFrame(rows, "aoi int, scene int, part int, strip int, acquired string, cloud double, scene_cloud double, price double")
    got = {r.strip: (r.scene, r.rank_key) for r in selection.top_scene(df, "2000-01-01", 0.5).collect()}
    assert got == {1: (2, 4050.0), 3: (5, 6003.0)}  # 0.005 of cloud weighs five days; strip 2 counts as all cloud


def test_metrics_by_hand(spark):
    rows = [(0, 1, 0.9), (0, 1, 0.4), (0, 0, 0.6), (0, 0, 0.1), (1, 0, 0.0)]
    got = {r.image: r for r in metrics.image_scores(spark.createDataFrame(rows, "image int, gt int, prob double")).collect()}
    assert got[0].soft_dice == got[0].f1 == pytest.approx((2 * 1.3 + 1e-6) / (4 + 1e-6)) and got[0].soft_iou == pytest.approx(1.3 / 2.7, abs=1e-5)
    assert got[0].tversky == pytest.approx(1.3 / (1.3 + 0.35 + 0.35), abs=1e-5) and got[0].sensitivity == pytest.approx(0.5, abs=1e-5)
    assert got[1].soft_dice == 1 and got[1].sensitivity == 1 and got[1].accuracy == 1


def test_grouping_kappa_by_hand(spark):
    """Two labelers, items 1-4 and a fifth that one rated: six pairs, five of them agreed on."""
    rows = [(0, i, 1, g) for i, g in ((1, 1), (2, 1), (3, 2), (4, 3), (5, 1))] + [(0, i, 2, g) for i, g in ((1, 7), (2, 7), (3, 8), (4, 8))]
    row = labels.grouping_kappa(spark.createDataFrame(rows, "image int, seep_id int, labeler int, grp int")).first()
    pe = (3 / 12) ** 2 + (9 / 12) ** 2
    assert row.n_items == 6 and row.kappa == pytest.approx((5 / 6 - pe) / (1 - pe))


def test_composite_direction_and_guard(spark):
    rows = [("a", 0, 0, 1.0), ("a", 0, 1, 3.0), ("b", 0, 0, 5.0), ("b", 0, 1, 5.0)]
    got = {r.grp: r.value for r in draws.composite(spark.createDataFrame(rows, "metric string, sample int, grp int, value double"), {"a": 1.0, "b": 1.0}, lower=("a",)).collect()}
    assert got[0] - got[1] == pytest.approx(1.0, rel=1e-3) and all(v is not None for v in got.values())


def test_early_stop_modes(spark):
    log = spark.createDataFrame([(1, e, v) for e, v in enumerate([1.0, 2.0, 2.5, 2.4, 2.6, 2.55])], "run int, epoch long, loss double")
    assert temporal.early_stop(log, 2, 0.4, "max").first().stop_epoch == 4 and temporal.early_stop(log, 2, 0.0).first().stop_epoch == 2


def test_track_gaps_and_positions(spark):
    track = spark.createDataFrame([(1, i, c, float(i), None if i == 7 else 0.0) for i, c in enumerate([1, 2, 3, 5, 6, 7, 8, 9, 10, 11])], "k int, t int, stati int, x double, y double")
    got = sorted((r.start_t, r.end_t) for r in temporal.segments(track, "k", "t", "stati", ["x", "y"]).collect())
    assert got == [(1, 2), (4, 5), (5, 6), (8, 9)]
    ends = spark.createDataFrame([(1, "2024-01-01 00:00:01"), (1, "2024-01-01 00:00:03")], "k int, e string").withColumn("e", F.to_timestamp("e"))
    ticks = spark.createDataFrame([(1, f"2024-01-01 00:00:0{s}") for s in range(5)], "k int, tick string").withColumn("tick", F.to_timestamp("tick"))
    assert [r.position for r in temporal.asof_position(ends, ticks, "k", "e", "tick").orderBy("tick").collect()] == [0, 1, 1, 2, 2]


def test_hausdorff_by_hand(spark):
    at = lambda rows: spark.createDataFrame(rows, "image int, r int, c int")
    sizes = spark.createDataFrame([(0, 6, 8), (1, 6, 8), (2, 6, 8)], "image int, rows int, cols int")
    got = {r.image: (r.assd, r.hd95) for r in metrics.hausdorff(at([(0, 0, 0), (0, 3, 4), (1, 1, 1)]), at([(0, 0, 0)]), sizes).collect()}
    assert got == {0: (pytest.approx(0.5 * (0 + 2.5)), pytest.approx(4.75)), 1: (10.0, 10.0), 2: (0.0, 0.0)}


def test_nearest_time_of_a_hot_key(spark):
    """One key of 200,000 rows, in linear time."""
    left = spark.range(200_000).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 10).alias("t"), "id")
    right = spark.range(20_000).select(F.lit(1).alias("k"), F.timestamp_seconds(F.col("id") * 100).alias("t"))
    row = temporal.nearest_asof(left, right, "k", "t", "near").agg(F.max(F.abs("diff_hours")).alias("m"), F.count("*").alias("n")).first()
    assert row.n == 200_000 and row.m == pytest.approx(90 / 3600)


def test_scalars(spark):
    row = spark.range(1).select(
        S.digitize(F.lit(20.0), [18, 20, 23]).alias("d"), S.logit(F.lit(2.0)).alias("l"), S.metres_to_pixels(F.lit(2.5), 1.0).alias("px"),
        S.guarded_date(F.lit("2024-01-01")).alias("bad"), S.guarded_date(F.lit("20240102")).alias("good"), S.elapsed_seconds(F.lit("01:02:03")).alias("s"),
        S.elapsed_text(F.lit(3723)).alias("text"), S.evidence_label(F.lit(5.0)).alias("bf"), S.inv_logit(F.lit(0.0)).alias("half"), S.odds(F.lit(0.5)).alias("odds"),
    ).first()
    assert (row.d, row.px, row.bad, row.good.day, row.s, row.text, row.bf, row.half) == (2, 2, None, 2, 3723, "01:02:03", "moderate evidence for H1", 0.5)
    assert row.l == pytest.approx(math.log((1 - 1e-6) / 1e-6)) and row.odds == pytest.approx(1)


def test_schema_checks(spark):
    df = spark.range(1)
    assert assert_schema(df, ["id"]) is df
    with pytest.raises(ValueError, match="area"):
        assert_schema(df, ["id", "area"])
    assert df.select(optional_col(df, "area", "double")).dtypes == [("area", "double")]


def test_merged_boxes(spark):
    """Bounds grow until nothing overlaps; shared edges are no overlap."""
    rows = [(0, i, float(x), float(y), float(x + w), float(y + h)) for i, x, y, w, h in [(1, 0, 0, 2, 2), (2, 1, 1, 3, 1), (3, 0.5, 2.5, 1, 1), (4, 3, 0.2, 0.5, 0.5), (5, 4, 0, 2, 2), (6, 9, 9, 1, 1), (7, 9, 9, 1, 1), (8, 1, 1.9, 0.2, 1)]]
    rows += [(1, 1, 0.0, 0.0, 1.0, 1.0)]
    boxes = spark.createDataFrame(rows, "image long, id long, x0 double, y0 double, x1 double, y1 double")
    got = {(r.image, r.id): (r.x0, r.y0, r.x1, r.y1, r.n) for r in regions.merge_boxes(boxes, ["image"], 1.0).collect()}
    assert got == {(0, 1): (0, 0, 4, 3.5, 5), (0, 5): (4, 0, 6, 2, 1), (0, 6): (9, 9, 10, 10, 2), (1, 1): (0, 0, 1, 1, 1)}
    assert regions.merge_boxes(boxes.limit(0), ["image"], 1.0).count() == 0
