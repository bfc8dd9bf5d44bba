"""Searches, strings and corridors along the line against plain versions."""

import heapq
import math
import random

import numpy as np
import pytest

from geoweave.operators import corridors
from geoweave.operators.corridors import pulled, shortened


def grid(rng, n, blocked):
    """Cells of a grid with slanted middles, some of them not walkable, and the edges between the others."""
    at = {y * 100 + x: (x * 10 + rng.uniform(-3, 3), y * 10 + rng.uniform(-3, 3)) for x in range(n) for y in range(n) if rng.random() > blocked}
    edges = {(v, w) for v in at for w in (v + 1, v - 1, v + 100, v - 100) if w in at}
    return at, edges


def cheapest(at, edges, start, goal, free, stray):
    """Dijkstra with the same tolls."""
    (sx, sy), (gx, gy) = at[start], at[goal]
    length = math.hypot(gx - sx, gy - sy)

    def toll(v):
        x, y = at[v][0] - sx, at[v][1] - sy
        far = math.hypot(x, y)
        off = abs((gx - sx) * y - (gy - sy) * x) / length if length else far
        ahead = (x * (gx - sx) + y * (gy - sy)) / (length * far) if length and far else 1
        return max(off - free, 0) * stray * (2 - ahead)

    best, heap, out = {}, [(0.0, start)], {}
    for a, b in edges:
        out.setdefault(a, []).append(b)
    while heap:
        c, v = heapq.heappop(heap)
        if v in best:
            continue
        best[v] = c
        for w in out.get(v, ()):
            heapq.heappush(heap, (c + math.dist(at[v], at[w]) + toll(w), w))
    return best.get(goal)


@pytest.mark.parametrize("free,stray", [(0.0, 0.0), (8.0, 0.7)])
def test_corridors_are_the_cheapest(spark, free, stray):
    rng = random.Random(3)
    at, edges = grid(rng, 9, 0.25)
    pairs = [(i, *rng.sample(sorted(at), 2)) for i in range(25)] + [(90, 77777, min(at)), (91, min(at), min(at))]
    centres = spark.createDataFrame([(v, *p) for v, p in at.items()], "v long, x double, y double")
    got: dict = {}
    for r in corridors.search(spark.createDataFrame(pairs + pairs[:1], "p long, start long, goal long"), centres, spark.createDataFrame(sorted(edges), "a long, b long"), free, stray).collect():
        got.setdefault(r.p, {})[r.step] = (r.v, r.cost)
    for p, start, goal in pairs:
        want = cheapest(at, edges, start, goal, free, stray) if start in at else None
        if want is None:
            assert p not in got
            continue
        way = [got[p][i] for i in range(len(got[p]))]
        assert way[0] == (start, 0) and way[-1][0] == goal and math.isclose(way[-1][1], want, rel_tol=1e-9, abs_tol=1e-9)
        assert all((a[0], b[0]) in edges for a, b in zip(way, way[1:]))


def test_strings():
    """Straight through, around one corner on either side, and along a wall."""
    line = lambda *ps: np.array(ps, float)
    assert pulled(line((0, 0), (5, 5), (10, 0)), line((0, 0), (5, -5), (10, 0))) == [(2, 0)]
    assert pulled(line((0, 0), (5, 9), (10, 0)), line((0, 0), (5, 4), (10, 0))) == [(1, 1), (2, 0)]
    assert pulled(line((0, 0), (5, -4), (10, 0)), line((0, 0), (5, -9), (10, 0))) == [(1, 0), (2, 0)]
    assert pulled(line((0, 0), (2, 9), (4, 9), (10, 0)), line((0, 0), (2, 5), (4, 5), (10, 0))) == [(1, 1), (2, 1), (3, 0)]
    assert pulled(line((0, 0), (7, 7)), line((0, 0), (7, 7))) == [(1, 0)]


@pytest.mark.parametrize("seed", range(20))
def test_strings_are_the_shortest_way(seed):
    """Against the cheapest way over the ends of doors that see each other through all doors between."""
    rng = random.Random(seed)
    n = rng.randint(1, 7)
    doors = [((0.0, 0.0),) * 2, *(((10.0 * (i + 1), y + rng.uniform(1, 8)), (10.0 * (i + 1), y)) for i, y in enumerate(rng.uniform(-12, 12) for _ in range(n))), ((10.0 * (n + 1), rng.uniform(-9, 9)),) * 2]
    left, right = np.array([a for a, _ in doors]), np.array([b for _, b in doors])
    spots = [(i, k) for i in range(n + 2) for k in (0, 1)]

    def sees(a, b):
        (i, p), (j, q) = (a[0], doors[a[0]][a[1]]), (b[0], doors[b[0]][b[1]])
        return all(doors[m][1][1] - 1e-9 <= p[1] + (q[1] - p[1]) * (doors[m][0][0] - p[0]) / (q[0] - p[0]) <= doors[m][0][1] + 1e-9 for m in range(i + 1, j))

    best = {(0, 0): 0.0}
    for b in spots:
        if b[0]:
            best[b] = min(best[a] + math.dist(doors[a[0]][a[1]], doors[b[0]][b[1]]) for a in best if a[0] < b[0] and sees(a, b))
    way = [doors[0][0]] + [(left, right)[k][i] for i, k in pulled(left, right)]
    assert math.isclose(sum(map(math.dist, way, way[1:])), best[n + 1, 0], rel_tol=1e-9)


def test_loops_and_short_cuts_go():
    near = {v: {v - 1, v + 1} for v in range(10)}
    assert shortened([0, 1, 2, 3, 2, 1, 2, 3, 4], near) == [0, 1, 2, 3, 4]
    near[1] |= {3}
    near[4] |= {7}
    assert shortened(list(range(10)), near) == [0, 1, 3, 4, 7, 8, 9]
    assert shortened([5], near) == [5] and shortened([5, 6], near) == [5, 6]


def test_corners_move_away_from_their_blob(spark):
    ring = "array<struct<x:double,y:double,v:long>>"
    blobs = spark.createDataFrame([(2, [(0.0, 0.0, 1), (10.0, 0.0, 2), (10.0, 10.0, 3), (0.0, 10.0, 4)]), (1, [(10.0, 0.0, 2), (20.0, 0.0, 5), (20.0, -10.0, 6), (10.0, -10.0, 7)])], f"blob long, ring {ring}")
    found = spark.createDataFrame([(1, 0, 50.0, 50.0, None), (1, 1, 10.0, 10.0, 3), (1, 2, 10.0, 0.0, 2), (1, 3, 30.0, 30.0, 99)], "p long, i int, x double, y double, v long")
    got = {r.i: (round(r.x, 6), round(r.y, 6), r.blob) for r in corridors.offset_corners(found, blobs, math.sqrt(2)).collect()}
    assert got == {0: (50, 50, None), 1: (11, 11, 2), 2: (9, 1, 1), 3: (30, 30, None)}


def test_corridors_along_the_line(spark):
    """A wall with a gap far off: the line's free polygons are kept, the rest is the cheapest way around; all steps are edges."""
    rng = random.Random(5)
    at, _ = grid(rng, 10, 0)
    for y in range(1, 10):
        del at[y * 100 + 4]
    for v in (707, 708, 807, 607):
        at.pop(v)
    edges = {(v, w) for v in at for w in (v + 1, v - 1, v + 100, v - 100) if w in at}
    at[5050] = (500.0, 500.0)
    pairs = [(1, 501, 508), (2, 501, 503), (3, 700, 709), (4, 501, 5050), (5, 501, 501)]
    passed = [(p, (x - 1) / 10, y * 100 + x) for p, y, lo, hi in ((1, 5, 1, 8), (2, 5, 1, 3), (3, 7, 0, 9)) for x in range(lo, hi + 1)]
    got: dict = {}
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    for r in corridors.along_line(frame(pairs, "p long, start long, goal long"), frame(passed, "p long, t double, v long"), frame([(v, *q) for v, q in at.items()], "v long, x double, y double"), frame(sorted(edges), "a long, b long")).collect():
        got.setdefault(r.p, {})[r.step] = r.v
    ways = {p: [w[i] for i in range(len(w))] for p, w in got.items()}
    assert set(ways) == {1, 2, 3, 5} and ways[2] == [501, 502, 503] and ways[5] == [501]
    for p, start, goal in pairs:
        if p in ways:
            assert (ways[p][0], ways[p][-1]) == (start, goal) and all(e in edges for e in zip(ways[p], ways[p][1:])) and len(set(ways[p])) == len(ways[p])
    assert ways[1][-3:] == [506, 507, 508] and 4 in ways[1]
