"""Points and shapes that lie on each other many times over, against plain loops."""

import random

import pytest

from geoweave.operators import spatial


@pytest.fixture(scope="module")
def rows():
    r = random.Random(7)
    points = [(k, r.randrange(0, 60) * 5.0, r.randrange(0, 60) * 5.0) for k in range(400)] + [(400, None, 1.0), (401, float("nan"), 1.0)]
    boxes = []
    for b in range(200):
        x, y, h = r.randrange(0, 300) * 1.0, r.randrange(0, 300) * 1.0, r.choice([4.0, 16.0, 60.0, 200.0])
        boxes.append((b, x - h, y - h, x + h, y + h))
    return points, boxes


def _holds(b, p):
    return p[1] is not None and b[1] <= p[1] <= b[3] and b[2] <= p[2] <= b[4]


def test_holders_of_dense_points(spark, rows):
    points, boxes = rows
    p, b = spark.createDataFrame(points, "k long, x double, y double"), spark.createDataFrame(boxes, "b long, x0 double, y0 double, x1 double, y1 double")
    held = {q[0]: [c[0] for c in boxes if _holds(c, q)] for q in points}
    assert {r.k: r.b for r in spatial.first_box(p, b).collect()} == {k: min(v) for k, v in held.items() if v}
    assert {r.k: min(r.n, 2) for r in spatial.holders(p, b).collect()} == {k: min(len(v), 2) for k, v in held.items()}
    counts = {c[0]: sum(c[0] in v for v in held.values()) for c in boxes}
    assert {r.b: r.n for r in spatial.counts_in_boxes(p, b).collect()} == {k: n for k, n in counts.items() if n}
    assert spatial.first_box(p, b.limit(0)).count() == 0 and {r.n for r in spatial.holders(p, b.limit(0)).collect()} == {0}


def test_least_point_within(spark, rows):
    points, boxes = rows
    p, q = spark.createDataFrame(points, "k long, x double, y double"), spark.createDataFrame([c[:3] for c in boxes], "q long, x double, y double")
    near = {c[0]: [k for k, x, y in points if x is not None and (x - c[1]) ** 2 + (y - c[2]) ** 2 <= 2500] for c in boxes}
    assert {r.q: r.k for r in spatial.least_within(q, p, 50.0, 16.0).collect()} == {k: min(v) for k, v in near.items() if v}


def test_cells_are_never_broadcast(spark):
    """Their estimate is that of the shapes before they are repeated, so Spark would broadcast what doesn't fit the driver."""
    b = spark.createDataFrame([(1, 0.0, 0.0, 9.0, 9.0)], "b long, x0 double, y0 double, x1 double, y1 double")
    a = b.selectExpr("b AS area", "x0 AS ax0", "y0 AS ay0", "x1 AS ax1", "y1 AS ay1")
    for df in (spatial.boxes_in_areas(b, a), spatial.points_in_boxes(b.selectExpr("b AS k", "x0 AS x", "y0 AS y"), b)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
