"""What keeps work in proportion to the input: plans without expressions put in many places, and short ways that give the same rows."""

import math
import random

import numpy as np

import geoweave.plans.route_queries  # noqa: F401  (these register their queries)
import geoweave.plans.text_queries  # noqa: F401
from geoweave.operators import mesh, outlines, polygons, spatial, triangulation
from geoweave.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
RING = "array<struct<x:double,y:double>>"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_rings_alone_need_no_join(spark):
    """Stars that cross themselves, and rings that run over their own points, have the outlines that the joins give."""
    rng = random.Random(4)

    def star():
        x, y, n = rng.uniform(-90, 90), rng.uniform(-90, 90), rng.randint(3, 12)
        return [(x + r * math.cos(t), y + r * math.sin(t)) for t, r in ((2 * math.pi * (i + 1.7 * rng.random()) / n * rng.choice((1, 1, 2)), rng.uniform(5, 60)) for i in range(n))]

    rows = [(i, i, star()) for i in range(120)] + [(200 + i, 200 + i, [(float(rng.randint(0, 5)), float(rng.randint(0, 5))) for _ in range(rng.randint(2, 9))]) for i in range(80)]
    rings = spark.createDataFrame([*rows, (900, 900, None)], f"grp long, rid long, ring {RING}")
    found = [sorted((r.grp, r.hole, [(p.x, p.y) for p in r.ring]) for r in df.collect()) for df in (outlines.alone(rings), outlines.outlines(rings))]
    assert found[0] == found[1] and len(found[0]) > 150
    assert "Join" not in plan_of(outlines.alone(rings)) and outlines.alone(rings.limit(0)).collect() == []


def test_rings_are_worked_out_once(spark):
    """Without a generator in between, each use of a corner repeats the expressions of all coordinates."""
    assert "Generate" in plan_of(QUERIES["ring_verdicts"](spark, SMALL))


def test_mapping_audit_makes_no_row_for_each_triangle(spark):
    """A range of 10^12 triangles is a few numbers; small ones count as by lists."""
    total = spark.createDataFrame([(300_000,)], "n long")
    rng = random.Random(8)
    rows = [(i, s, s + rng.randint(-3, 900)) for i, s in enumerate(rng.randint(-500, 300_400) for _ in range(700))] + [(900, 65_530, 131_080), (901, 5, 5), (902, None, 7)]
    count: dict = {}
    for _, s, e in rows[:-1]:
        for t in range(s, e):
            count[t] = count.get(t, 0) + 1
    held = sum(0 <= t < 300_000 for t in count)
    want = (sum(c > 1 for c in count.values()), 300_000 - held, sum(e <= s for _, s, e in rows[:-1]), len(count) - held)
    ranges = spark.createDataFrame(rows, "poly long, s long, e long")
    assert tuple(mesh.mapping_audit(ranges, total).first()) == want
    assert tuple(mesh.mapping_audit(ranges.limit(0), total).first()) == (0, 300_000, 0, 0)
    assert "hashpartitioning(item" not in plan_of(mesh.mapping_audit(ranges, total))


def test_flat_corners_of_few_vertices_as_by_arrays():
    rng = random.Random(6)
    for n in range(0, 40):
        for _ in range(20):
            t = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
            x, y = (np.array([round(30 * f(a) + rng.uniform(-3, 3), 2) for a in t]) for f in (math.cos, math.sin))
            area = rng.choice((1.75, 5.0, 40.0))
            assert polygons._flat_of_few(x.tolist(), y.tolist(), area) == polygons._flat_of_many(x, y, area).tolist() == polygons.flat_of(x, y, area).tolist()


def test_ears_of_few_corners_as_by_arrays():
    rng = random.Random(9)
    for n in [*range(3, 20)] * 6:
        p = np.array([(r * math.cos(t), r * math.sin(t)) for t, r in ((2 * math.pi * (i + 0.8 * rng.random()) / n, rng.uniform(5, 60)) for i in range(n))])
        assert triangulation._ears_of_few(list(map(tuple, p.tolist())), list(range(n))) == triangulation._ears(p, list(range(n)))


def test_centres_of_buildings_are_found_before_blobs_are_joined(spark):
    plan = plan_of(QUERIES["building_blobs"](spark, SMALL))
    assert "held" in plan


def test_cuts_are_found_by_arrays(spark):
    """The formulas stay out of the generated join, which would be too large to be compiled; edges that cross, touch and pass."""
    rows = [(1, 1, 0, 0.0, 0.0, 10.0, 10.0), (1, 2, 0, 0.0, 10.0, 10.0, 0.0), (1, 3, 0, 10.0, 10.0, 20.0, 10.0), (1, 4, 0, 5.0, 5.0, 5.0, 9.0), (2, 5, 0, 0.0, 10.0, 10.0, 0.0), (1, 6, 0, 15.0, 10.0, 15.0, 30.0)]
    cuts = outlines._cuts(spark.createDataFrame(rows, "grp long, rid long, i long, ax double, ay double, bx double, by double"), 64.0, outlines.STEP)
    assert {(r.rid, r.px, r.py) for r in cuts.collect()} == {(1, 5.0, 5.0), (2, 5.0, 5.0), (3, 15.0, 10.0)}
    plan = plan_of(cuts)
    assert "MapInArrow" in plan and "SQRT" not in plan


def test_cells_of_areas_are_dealt_to_a_set_number_of_tasks(spark):
    """Small tables give many pairs: Spark would put the cells' tasks together by their bytes. Pairs are those of plain loops."""
    rng = random.Random(2)
    rows = [(b, x, y, x + rng.uniform(0, 900), y + rng.uniform(0, 900)) for b, x, y in ((b, rng.uniform(-3000, 3000), rng.uniform(-3000, 3000)) for b in range(150))]
    boxes = spark.createDataFrame(rows, "b long, x0 double, y0 double, x1 double, y1 double")
    pairs = spatial.boxes_in_areas(boxes, boxes.selectExpr("b AS area", "x0 AS ax0", "y0 AS ay0", "x1 AS ax1", "y1 AS ay1"))
    want = sorted((p[0], q[0]) for p in rows for q in rows if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    plan = plan_of(pairs)
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan
    assert sorted((r.area, r.b) for r in pairs.collect()) == want
