"""Steps and chains that take corners out of rings, against searches over many places and by what they must keep."""

import math
import random

import numpy as np
import pytest

from geoweave.operators import reshaping
from geoweave.operators.reshaping import cornered, point_for, pulled_apart, unrounded

RING = "array<struct<x:double,y:double>>"


def off(p, a, b):
    d = b - a
    t = max(0, min(1, ((p - a) * d.conjugate()).real / abs(d) ** 2)) if abs(d) > 1e-6 else 0
    return abs(p - a - t * d)


def area(p):
    return sum((a.conjugate() * b).imag for a, b in zip(p, np.roll(p, -1))) / 2


@pytest.mark.parametrize("seed", range(12))
def test_the_point_for_a_short_edge_is_the_best_on_its_line(seed):
    """Against a fine row of places between the meeting of the edges beside it and the place where both ends are as far off."""
    rng = random.Random(seed)
    b, c = 0j, complex(rng.uniform(1, 4), 0)
    a, d = complex(rng.uniform(-9, -2), rng.uniform(-12, -3)), c + complex(rng.uniform(2, 9), rng.uniform(-12, -3) * rng.choice((1, 1, -1)))
    m, e = point_for(a, b, c, d)
    balance = min((abs(off(b, a, b + t * (c - b)) - off(c, d, b + t * (c - b))), b + t * (c - b)) for t in np.linspace(0, 1, 4001))[1]
    u, v = b - a, c - d
    det = u.real * v.imag - u.imag * v.real
    tip = a + ((d - a).real * v.imag - (d - a).imag * v.real) / det * u
    error = lambda q: max(off(b, a, q), off(c, d, q))
    if d.imag > 0:  # the ring turns both ways
        assert abs(m - balance) < 1e-3 and abs(e - error(balance)) < 1e-3
    else:
        assert abs(e - min(max(error(q), off(q, b, c)) for q in (tip + s * (balance - tip) for s in np.linspace(0, 1, 4001)))) < 1e-3
    assert point_for(b, b, c, d) == (None, math.inf) and point_for(-5 + 5j, 0j, 2 + 0j, 7 + 5j)[0] is not None


def test_parallel_neighbours_meet_in_the_middle():
    m, e = point_for(0j, 10j, 1 + 10j, 1 + 0j)
    assert abs(m - (0.5 + 10j)) < 1e-9 and abs(e - off(10j, 0j, m)) < 1e-9


def test_short_edges_go():
    box = np.array([0, 40, 40 + 29j, 39 + 30j, 30j, 0], complex)  # closed, one corner cut
    got = unrounded(box, 5, 0.9)
    assert len(got) == 4 and abs(got[2] - (40 + 30j)) < 1
    assert len(unrounded(box, 5, 0.1)) == 5 and len(unrounded(box, 1, 0.9)) == 5
    assert len(unrounded(np.array([1, 40, 40 + 30j, 30j, 1j], complex), 5, 0.9)) == 4  # the last corner and the first
    assert len(unrounded(np.array([0, 1, 1j], complex), 5, 9)) == 3 and len(unrounded(np.zeros(0, complex), 5, 9)) == 0


def test_rings_of_a_batch_look_for_points_together(monkeypatch):
    """As many searches as a ring has short edges, not one for each ring's edge; and each ring comes out as it does alone."""
    rng = random.Random(5)
    rings = [np.array([rng.uniform(2, 15) * np.exp(2j * np.pi * (i + rng.random() / 2) / n) for i in range(n)], complex) for n in (rng.randint(0, 9) for _ in range(200))]
    alone, asked, search = [unrounded(p, 9, 0.9) for p in rings], [], reshaping.points_for
    monkeypatch.setattr(reshaping, "points_for", lambda *corners: asked.append(len(corners[0])) or search(*corners))
    together = reshaping.all_unrounded(rings, 9, 0.9)
    assert len(asked) <= 10 and sum(asked) > 200 and all(len(p) == len(q) and (p == q).all() for p, q in zip(alone, together))


def test_corners_come_back():
    original = np.array([0, 40, 40 + 30j, 30j], complex)
    cut = np.array([0, 40, 40 + 28j, 38 + 30j, 30j], complex)
    assert np.allclose(np.sort_complex(cornered(cut, original, 3.7, 1)), np.sort_complex(original))
    assert len(cornered(cut, original + 100, 3.7, 1)) == 5  # no vertex near
    assert len(cornered(cut, original, 2, 1)) == 5 and len(cornered(original[:3], original, 9, 1)) == 3


@pytest.mark.parametrize("seed", range(6))
def test_corners_keep_off_other_edges(seed):
    """Moved corners are as far from the line that they were near as is wanted, on an edge of theirs, and the area changes little."""
    rng = random.Random(seed)
    near = rng.uniform(0.1, 0.6)
    p = np.array([0, 40, 40 + 20j, 22 + 20j, complex(20, near), 18 + 20j, 20j], complex)
    got = pulled_apart(p, 1.0, 50.0)
    assert abs(got[4].imag - 1) < 1e-9 and np.allclose(np.delete(got, 4), np.delete(p, 4))
    assert abs(area(got) - area(p)) <= 50 and (pulled_apart(p, 1.0, 1e-6) == p).all() and (pulled_apart(got, 1.0, 50.0) == got).all()


def test_chains(spark):
    rng = random.Random(2)

    def house(x, y):
        return [(x + u + rng.uniform(-0.05, 0.05), y + v + rng.uniform(-0.05, 0.05)) for u, v in ((0, 0), (10, 0), (20, 0), (20, 14), (19, 15), (10, 15), (0, 15), (0, 8))]

    rows = [(i, house(40.0 * i, 0.0)) for i in range(4)] + [(4, house(40.0 * 3 + 23, 0.0))]
    rings = spark.createDataFrame([*rows, (9, None)], f"id long, ring {RING}")
    light = {r.id: r.ring for r in reshaping.light_rings(rings).collect()}
    assert set(light) - {9} == {0, 1, 2, 3, 4} and all(len(light[i]) <= 6 for i in range(5))
    strong = {r.id: np.array([complex(p.x, p.y) for p in r.ring]) for r in reshaping.strong_rings(rings.where("ring is not null")).collect()}
    assert set(strong) == {0, 1, 2, 3, 4} and all(len(p) == 4 and abs(area(p) - 300) < 8 for p in strong.values())
    blobs = {r.id: (r.buildings, np.array([complex(p.x, p.y) for p in r.ring])) for r in reshaping.blobs_of(rings.where("ring is not null")).collect()}
    assert {k: v[0] for k, v in blobs.items()} == {0: [0], 1: [1], 2: [2], 3: [3, 4]}
    assert abs(area(blobs[0][1]) - 300) < 10 and abs(area(blobs[3][1]) - 645) < 20 and all(len(p) <= 6 for _, p in blobs.values())
    assert reshaping.light_rings(rings.limit(0)).collect() == []


def test_rings_of_many_corners_as_of_few(monkeypatch):
    """Edges and vertices in cells: corners come back, and move away from edges, just as where all of a ring is looked at."""
    rng, changed = random.Random(3), [0, 0]
    for t in range(150):
        n = rng.randint(3, 60)
        p = np.array([rng.uniform(4, 9) * np.exp(2j * np.pi * (i + rng.random() * 0.9) / n) for i in range(n)])
        p = np.round(p) if t % 2 else p
        back = np.roll(p, -1)
        vertices = np.concatenate([p + rng.uniform(-1, 1), (p + back) / 2 + 1j * (p - back) / 2 * rng.choice((1, -1))])
        few, many = (f(p, vertices, 2.1, 0.5) for f in (reshaping._cornered_of_few, reshaping._cornered_of_many))
        assert len(few) == len(many) and np.allclose(few, many, atol=1e-9)
        apart = pulled_apart(p, 1, 5)
        monkeypatch.setattr(reshaping, "FEW", 0)
        assert np.allclose(pulled_apart(p, 1, 5), apart, atol=1e-9)
        monkeypatch.undo()
        changed = [changed[0] + (len(few) < n or bool((few != p).any())), changed[1] + bool((apart != p).any())]
    assert min(changed) > 20


def test_only_vertices_near_short_edges_go_to_a_blob(spark):
    """A long house of many small bays: its blob's corners are held against the vertices at their own short edges, not against all in it."""
    rings = spark.createDataFrame([(1, [(0.0, 0.0), (400.0, 0.0), (400.0, 1.0), (399.0, 2.0), (0.0, 2.0)])], f"id long, ring {RING}")
    vertices = spark.createDataFrame([(i % 2 + 1, float(i), 1.0) for i in range(400)], "id long, x double, y double")
    (row,) = reshaping._near_short(rings, vertices, 2.1).collect()
    xs = {p.x for p in row.other}
    assert row.id == 1 and {392.0, 394.0, 396.0, 398.0} <= xs and all(x % 2 == 0 and (x > 360 or x < 40) for x in xs)
