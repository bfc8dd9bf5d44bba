"""Convex merging and colouring against plain versions."""

import random

import pytest

from geoweave.operators import graph, merging, triangulation
from tests.test_triangulation import area, star


def turn(a, b, c):
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def plain(tris, at):
    """By searching all triangles for each edge, again and again from the polygon's first edge."""
    used, out = set(), []
    shares = lambda s, t: len(set(tris[s]) & set(tris[t])) == 2
    while len(used) < len(tris):
        free = [t for t in range(len(tris)) if t not in used]
        ends = [t for t in free if sum(shares(t, n) for n in free if n != t) <= 1]
        t = (ends or free)[0]
        used.add(t)
        ring, held, grew = list(tris[t]), [t], True
        while grew:
            grew = False
            for i in range(len(ring)):
                a, b = ring[i], ring[(i + 1) % len(ring)]
                found = [n for n in range(len(tris)) if n not in used and {a, b} <= set(tris[n])]
                if found:
                    (v,) = set(tris[found[0]]) - {a, b}
                    if turn(at[ring[i - 1]], at[a], at[v]) >= 0 and turn(at[v], at[b], at[ring[(i + 2) % len(ring)]]) >= 0:
                        ring.insert(i + 1, v)
                        used.add(found[0])
                        held.append(found[0])
                        grew = True
                        break
        out.append((ring, held))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_polygons_are_those_of_a_plain_search(seed):
    rng = random.Random(seed)
    p, t = triangulation.triangles_of([star(rng, 0, 0, 40, 90, rng.randint(12, 50)), star(rng, 0, 0, 5, 20, 6)])
    at, tris = dict(enumerate(map(tuple, p.tolist()))), list(map(tuple, t.tolist()))
    got = merging.convex_parts(tris, at)
    assert got == plain(tris, at)
    for ring, held in got:
        assert all(turn(at[ring[i - 2]], at[ring[i - 1]], at[ring[i]]) >= 0 for i in range(len(ring)))
        assert abs(area([at[v] for v in ring]) - sum(area([at[v] for v in tris[k]]) for k in held)) < 1e-6
    assert len(got) < len(tris) / 1.5


def test_groups_and_cells(spark):
    rows = []
    for x in range(6):
        for y in range(3):
            v = [x + 10 * y, x + 1 + 10 * y, x + 11 + 10 * y, x + 10 + 10 * y]
            at = {n: (float(n % 10), float(n // 10)) for n in v}
            for k, (a, b, c) in enumerate(((v[0], v[1], v[2]), (v[0], v[2], v[3]))):
                rows.append((1 if y < 2 else 2, 2 * (x + 6 * y) + k, a, b, c, *at[a], *at[b], *at[c]))
    df = spark.createDataFrame(rows, "grp long, tid long, v1 long, v2 long, v3 long, ax double, ay double, bx double, by double, cx double, cy double")
    whole = merging.merged_polygons(df).collect()
    assert sorted(t for r in whole for t in r.tids) == list(range(36)) and {t < 24 for r in whole for t in r.tids[:1]} == {True, False}
    assert all(len({t < 24 for t in r.tids}) == 1 for r in whole)
    cut = merging.merged_polygons(df, 3.0).collect()
    assert sorted(t for r in cut for t in r.tids) == list(range(36)) and all(len({t // 2 % 6 < 3 for t in r.tids}) == 1 for r in cut)
    assert merging.merged_polygons(df.limit(0)).collect() == []


def test_colours(spark):
    rng = random.Random(1)
    edges = list({tuple(sorted(rng.sample(range(60), 2))) for _ in range(150)}) + [(3, 3), (5, None)]
    nodes = spark.createDataFrame([(i,) for i in [*range(60), 3, 99]], "v long")
    e = spark.createDataFrame(edges + edges[:10], "a long, b long")
    got = {r.v: r.colour for r in graph.coloured(nodes, e).collect()}
    assert set(got) == {*range(60), 99} and got[99] == 0
    around = {v: {b if a == v else a for a, b in edges if v in (a, b) and a != b and b is not None} for v in got}
    for v, c in got.items():
        assert c not in {got[n] for n in around[v]} and set(range(c)) <= {got[n] for n in around[v]}
    assert got == {r.v: r.colour for r in graph.coloured(nodes.repartition(5), e.repartition(3)).collect()}
    assert graph.coloured(nodes.limit(0), e).collect() == []
