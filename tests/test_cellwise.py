"""Points and rings held against each other cell by cell, against plain loops."""

import random
from collections import Counter

from geoweave.operators import alike, dedup, locate
from geoweave.plans.queries import QUERIES
import geoweave.plans.route_queries  # noqa: F401  (these register their queries)
from test_routes import plain_doubles

SMALL = "/root/testdata/sf0.001"
RING = "array<struct<x:double,y:double>>"


def plain_winding(x, y, ring):
    turns = 0
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        left = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
        turns += 1 if ay <= y < by and left > 0 else -1 if by <= y < ay and left < 0 else 0
    return turns


def test_windings_of_crowded_and_repeated_points(spark):
    rng = random.Random(11)
    at = lambda n: (rng.randrange(-n, n) * 1.0, rng.randrange(-n, n) * 1.0)
    points = [(k, *at(70)) for k in range(300)] + [(k + 500, *at(4)) for k in range(200)] + [(7, 0.0, 0.0), (None, 1.0, 1.0), (None, 1.0, 1.0), (901, None, 1.0), (902, 1.0, float("nan"))]
    rings = [(b, [at(90) for _ in range(rng.randint(1, 9))]) for b in range(60)]
    rings += [(100, [(-50.0, -50.0), (50.0, -50.0), (50.0, 50.0), (-50.0, 50.0)] * 2), (100, [(0.0, 0.0), (0.0, 9.0), (9.0, 0.0)]), (101, []), (102, None)]
    want = Counter((k, b, plain_winding(x, y, r)) for k, x, y in points if x is not None and y is not None and y == y for b, r in rings if r and plain_winding(x, y, r))
    assert {2, 1, -1} <= {t for _, _, t in want}
    p, s = spark.createDataFrame(points, "k long, x double, y double"), spark.createDataFrame(rings, f"b long, ring {RING}")
    for size, most in ((64.0, 2**19), (16.0, 7), (4096.0, 40)):
        assert Counter(map(tuple, locate.windings(p, s, "b", size, most).collect())) == want
    assert locate.windings(p.limit(0), s, "b").count() == locate.windings(p, s.limit(0), "b").count() == 0


def test_hits_are_not_joined_to_points_again(spark):
    """A pair of a place and a ring is no row of a shuffle: places lie on each other many times over in large tables."""
    plan = QUERIES["winding_hits"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "lambdafunction" not in plan


def _rings(rng):
    """Rings of three to seven vertices about few places, many of them nearly alike or congruent, some without a centre of their own."""
    rows = {}
    for i in range(260):
        x, y, h, n = rng.randrange(4) * 300.0, rng.randrange(2) * 40.0, rng.choice([3.0, 20.0, 60.0, 90.0, 400.0]), rng.choice([3, 4, 4, 5, 7])
        at = [(x + h * rng.choice([-1, 1, 0.5]) + rng.randrange(3), y + h * rng.choice([-1, 1, -0.5]) + rng.randrange(3)) for _ in range(n)]
        square = [(x - h, y - h), (x + h, y - h + rng.randrange(3)), (x + h, y + h), (x - h, y + h + 0.25 * rng.randrange(3))]
        k = rng.randrange(4)
        rows[i] = at if i % 3 == 0 else square[k:] + square[:k]
    return rows


def test_doubles_of_crowded_rings(spark):
    rings = _rings(random.Random(5))
    same, odd = plain_doubles(rings)
    rows = [*rings.items(), (900, []), (901, None), (902, [(0.0, 0.0), (1.0, 1.0)]), (903, [(None, 0.0), (20.0, 0.0), (20.0, 20.0)]), (904, [(float("nan"), 0.0), (20.0, 0.0), (20.0, 20.0)])]
    df = spark.createDataFrame(rows, f"id long, ring {RING}")
    assert dedup._measured(df).where("mx is null").count() and dedup._measured(df).count() == len(rings)
    assert len(odd) > 300 and len(same) > 50
    for size in (16.0, 256.0):
        got = dedup.suspicious_pairs(df, size=size).collect()
        assert len(got) == len(odd) and {tuple(r) for r in got} == odd
        assert {r.id for r in dedup._smaller_ones(df, size=size).collect()} == {c for _, _, c in odd}
    whole = spark.createDataFrame(rows[: len(rings) + 3], f"id long, ring {RING}")
    assert {tuple(r) for r in dedup.congruent_pairs(whole).collect()} == same


def test_pairs_of_rings_are_made_in_their_cell(spark):
    """No pair goes through a shuffle to be joined to its rings, and no function of rings is called for it."""
    plan = QUERIES["suspicious_pairs"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "lambdafunction" not in plan


def test_report_compares_few_of_many_pairs(spark, monkeypatch):
    """400 rings about one place make some 80,000 pairs; that each but the widest is the smaller one of a pair needs few of them."""
    rows = [(i, [(-h, -h), (h, -h), (h, h), (-h, h)]) for i, h in ((i, 200.0 + i) for i in range(400))]
    df = spark.createDataFrame(rows, f"id long, ring {RING}")
    assert dedup._smaller_ones(df).count() == 399 and dedup.suspicious_pairs(df).count() == 79800
    seen, whole = [], alike.alike
    monkeypatch.setattr(alike, "alike", lambda r, s, i, j, t: seen.append(len(i)) or whole(r, s, i, j, t))
    found = {i for b in alike.smaller(iter(dedup._cells(dedup._measured(df), 256.0).toArrow().to_batches(max_chunksize=50)), 1.0) for i in b.column(0).to_pylist()}
    assert found == set(range(399)) and sum(seen) < 8000


def test_congruent_rings_are_compared_in_few_cells(spark):
    rows = [(i, [(x, 7.0), (x + 9, 7.0), (x + 9, 16.0)]) for i, x in ((i, 0.9 * i) for i in range(1000))]
    df = spark.createDataFrame(rows, f"id long, ring {RING}")
    pairs = dedup.congruent_pairs(df)
    assert {tuple(r) for r in pairs.collect()} == {(i, i + 1) for i in range(999)}
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" in plan and "Generate explode([" not in plan  # a list of nine neighbours for each ring
