"""Triangulation: every edge stays, areas add up, circles are empty, and tiles fit together."""

import math
import random

import numpy as np
import pytest

from geoweave.operators import mesh, triangulation
from geoweave.operators.triangulation import triangles_of

RING = "array<struct<x:double,y:double>>"


def area(r):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, list(r[1:]) + list(r[:1]))) / 2


def star(rng, x, y, low, high, n):
    return np.array([(x + r * math.cos(t), y + r * math.sin(t)) for t, r in ((2 * math.pi * (i + 0.8 * rng.random()) / n, rng.uniform(low, high)) for i in range(n))])


def checked(rings):
    """Edges of all rings are edges of triangles, the areas add up, none is turned, and no edge that may move has a neighbour in its circle."""
    p, t = triangles_of(rings)
    where = {tuple(q): i for i, q in enumerate(p.tolist())}
    sides = {frozenset((where[tuple(p[a])], where[tuple(p[b])])) for x in t for a, b in ((x[0], x[1]), (x[1], x[2]), (x[2], x[0]))}
    fixed = {frozenset((where[tuple(a)], where[tuple(b)])) for r in rings for a, b in zip(r.tolist(), r.tolist()[1:] + r.tolist()[:1])}
    assert fixed <= sides
    areas = [area(p[x].tolist()) for x in t]
    assert min(areas) > 0 and math.isclose(sum(areas), abs(area(rings[0].tolist())) - sum(abs(area(h.tolist())) for h in rings[1:]), rel_tol=1e-9)
    assert len(t) == sum(map(len, rings)) + 2 * len(rings) - 4
    of = {}
    for x in t.tolist():
        for a, b, c in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
            of.setdefault(frozenset((where[tuple(p[x[a]])], where[tuple(p[x[b]])])), []).append((x, x[c]))
    for e, sharing in of.items():
        assert len(sharing) == (1 if e in fixed else 2)
        if len(sharing) == 2:
            (x, _), (_, d) = sharing
            m = p[x] - p[d]
            assert np.linalg.det(np.column_stack((m, (m * m).sum(axis=1)))) <= 1e-6 * np.abs(m).max() ** 4
    return p, t


@pytest.mark.parametrize("seed", range(30))
def test_rings_with_holes(seed):
    rng = random.Random(seed)
    outer = star(rng, 0, 0, 60, 100, rng.randint(12, 40))
    spots = [(x, y) for x in (-25, 0, 25) for y in (-25, 0, 25)]
    holes = [star(rng, x, y, 2, 11, rng.randint(3, 8)) for x, y in rng.sample(spots, rng.randint(0, 6))]
    holes = [h for h in holes if abs(area(h.tolist())) > 1]
    checked([outer[:: rng.choice((1, -1))], *[h[:: rng.choice((1, -1))] for h in holes]])


def test_odd_rings():
    box = np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float)
    checked([box])
    checked([np.array([(0, 0), (5, 0), (10, 0), (10, 10), (0, 10), (0, 5)], float)])  # corners on straight sides
    comb = [(x, y) for i in range(6) for x, y in ((4 * i, 10), (4 * i + 1, 1), (4 * i + 2, 1), (4 * i + 3, 10))]
    checked([np.array([(-1, 0), (24, 0), (24, 10), *comb[::-1], (-1, 10)], float)])
    checked([box * 10, box + [20, 20], box + [20, 60], box + [60, 20], box + [60, 60]])  # holes side by side and above each other
    assert all(len(x) == 0 for x in triangles_of([box[:2]]))
    assert len(triangles_of([np.repeat(box, 2, axis=0), box[:1]])[1]) == 2


def test_polygons_as_rows(spark):
    box = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)]
    rows = [(1, box, None), (2, box, [[(3.0, 3.0), (6.0, 3.0), (6.0, 6.0)]]), (3, None, None), (4, box[:2], []), (1, box, None)]
    polygons = spark.createDataFrame(rows, f"id long, ring {RING}, holes array<{RING}>")
    got = triangulation.triangulated(polygons).toPandas()
    assert got.groupby("id").size().to_dict() == {1: 4, 2: 7}
    assert triangulation.triangulated(polygons.limit(0)).collect() == []


def test_tiles_of_free_space_fit_together(spark):
    """Blobs that overlap, cross sides and corners of tiles, and surround free space: the mesh has no gap and no edge shared by three."""
    rng = random.Random(3)
    blobs = [(i, [tuple(q) for q in star(rng, rng.uniform(0, 200), rng.uniform(0, 200), 5, 18, 7).round(2).tolist()]) for i in range(25)]
    blobs = [(i, r) for i, r in blobs if area(r) > 0] + [(100, [(90.0, 90.0), (110.0, 90.0), (110.0, 110.0), (90.0, 110.0)])]
    df = spark.createDataFrame(blobs, f"blob long, ring {RING}")
    vertices, triangles = triangulation.free_mesh(df, (0.0, 0.0, 199.0, 199.0), size=50.0)
    at = {r.vid: (r.x, r.y) for r in vertices.collect()}
    rows = triangles.collect()
    sizes = [area([at[v] for v in (r.v1, r.v2, r.v3)]) for r in rows]
    assert min(sizes) > -1e-9
    grid = [(x + 0.371, y + 0.113) for x in range(0, 200, 2) for y in range(0, 200, 2)]
    inside = lambda q, r: sum((a[1] > q[1]) != (b[1] > q[1]) and q[0] < a[0] + (b[0] - a[0]) * (q[1] - a[1]) / (b[1] - a[1]) for a, b in zip(r, r[1:] + r[:1])) % 2 == 1
    free = [[at[v] for v in (r.v1, r.v2, r.v3)] for r in rows if r.blob is None]
    for q in rng.sample(grid, 600):
        assert sum(inside(q, t) for t in free) == (not any(inside(q, r) for _, r in blobs))
    walk = triangles.where("blob is null")
    edges = mesh.triangle_edges(walk).groupBy("lo", "hi").count().collect()
    assert max(r["count"] for r in edges) == 2
    assert len({r.tid for r in rows}) == len(rows)


def test_free_space_of_a_heap_cuts_little(spark, monkeypatch):
    """What 60 boxes on each other leave free is right, and where a large one lies over them their crossings are not looked for."""
    from geoweave.operators import outlines

    cuts, cut = [], outlines._cuts
    monkeypatch.setattr(outlines, "_cuts", lambda *a: cuts.append(cut(*a)) or cuts[-1])
    rows = [(i, [(100.0 + i, 90.0 + 2 * i), (500.0 + i, 90.0 + 2 * i), (500.0 + i, 700.0 - 3 * i), (100.0 + i, 700.0 - 3 * i)]) for i in range(60)]
    blobs = spark.createDataFrame(rows, "blob long, ring array<struct<x:double,y:double>>")
    large = spark.createDataFrame([(60, [(20.0, 20.0), (900.0, 20.0), (900.0, 900.0), (20.0, 900.0)])], blobs.schema)
    free = triangulation.free_space(blobs, (1.0, 1.0, 1000.0, 1000.0), 1024.0).collect()
    area = lambda r: abs(sum(a.x * b.y - b.x * a.y for a, b in zip(r, [*r[1:], r[0]]))) / 2
    covered = 400 * 610.0 + sum(610.0 - 5 * i for i in range(1, 60))
    assert len(free) == 1 and abs(area(free[0].ring) - sum(map(area, free[0].holes)) - (1024.0**2 - covered)) < 1e-6
    cuts.clear()
    (under,) = triangulation.free_space(blobs.union(large), (1.0, 1.0, 1000.0, 1000.0), 1024.0).collect()
    assert area(under.ring) - sum(map(area, under.holes)) == 1024.0**2 - 880.0**2 and not cuts[0].count()
