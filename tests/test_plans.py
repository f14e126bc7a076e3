"""Large sides are not broadcast: small files can hold more rows than a driver."""

import pytest
from compare import DATA

from quillon.plans import registry
from quillon.scratch import Scratch


def static_plans(monkeypatch, build):
    """The plans, as planned before they run, of every table that a query writes and of its result."""
    seen, write = [], Scratch.write
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()

    def spied(self, name, df):
        seen.append(plan(df))
        return write(self, name, df)

    monkeypatch.setattr(Scratch, "write", spied)
    result = build()
    return [*seen, plan(result)]


@pytest.mark.parametrize(
    "name",
    [
        "density_clusters",
        "lonely_clusters",
        "cluster_features",
        "cluster_summary",
        "local_max_clusters",
        "dissolved_groups",
        "region_shapes",
        "region_hulls",
        "region_outlines",
        "regions_eight",
        "regions_without_snow",
        "remapped_labels",
        "learned_groups",
    ],
)
def test_no_broadcast_by_file_size(spark, monkeypatch, name):
    plans = static_plans(monkeypatch, lambda: registry.QUERIES[name](spark, f"{DATA}/sf0.01"))
    assert len(plans) > 1
    assert not [p for p in plans if "BroadcastHashJoin" in p]


def test_placed_boxes_by_one_join(spark):
    """Each occupied box names the candidates it meets, by one anti-join of the grid; the result is that of all pairs."""
    import random

    from quillon.operators.regions import place_boxes

    rng = random.Random(3)
    taken = [(0, x := rng.uniform(-1, 6), y := rng.uniform(-1, 6), x + rng.uniform(0, 0.9), y + rng.uniform(0, 0.9)) for _ in range(40)] + [(0, 2.0, 2.0, 2.5, 2.5), (1, 1.0, 0.0, 1.0, 3.0)]
    sizes = spark.createDataFrame([(0, 6.2, 6.0), (1, 3.0, 3.0), (2, 0.4, 9.0)], "image long, width double, height double")
    occupied = spark.createDataFrame([(*t, (t[3] - t[1]) * (t[4] - t[2])) for t in taken], "image long, x0 double, y0 double, x1 double, y1 double, area double")
    out = place_boxes(sizes, occupied, 0.5, 7, 1.0)
    want = set()
    for image, cols, rows in ((0, 12, 12), (1, 6, 6)):
        meets = lambda i, j: any(t[0] == image and min(t[3], (i + 1) * 0.5) > max(t[1], i * 0.5) and min(t[4], (j + 1) * 0.5) > max(t[2], j * 0.5) for t in taken)  # noqa: B023, E731
        free = [(i, j) for i in range(cols) for j in range(rows) if not meets(i, j)]
        want |= {(image, i, j) for i, j in sorted(free, key=lambda p: ((p[0] * 7919 + p[1] * 104729) % 10007, *p))[:7]}
    assert {(r.image, r.i, r.j) for r in out.collect()} == want
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
