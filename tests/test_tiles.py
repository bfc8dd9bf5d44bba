"""Lines and polygons in the tiles of a zoom: stretches, borders and rows without shape."""

from geoweave.operators.tiles import tile_lines, tile_polygons

POINTS = "array<struct<x:double,y:double>>"


def test_a_line_that_comes_back_makes_two_stretches(spark):
    line = [(10.0, 10.0), (60.0, 10.0), (60.0, 40.0), (20.0, 40.0)]  # leaves the tile at x = 50 and comes back
    rows = [(1, line), (2, [(-80.0, -10.0), (-120.0, -10.0)]), (3, [(5.0, 5.0)]), (4, None), (5, [(200.0, 0.0), (300.0, 0.0)])]
    got = {(r.tx, r.ty, r.id, r.part): [(p.x, p.y) for p in r.line] for r in tile_lines(spark.createDataFrame(rows, f"id long, line {POINTS}"), [2], 100.0, 50).collect()}
    assert got == {
        (2, 2, 1, 0): [(10, 10), (50, 10)], (2, 2, 1, 1): [(50, 40), (20, 40)], (3, 2, 1, 0): [(0, 10), (10, 10), (10, 40), (0, 40)], (0, 1, 2, 0): [(20, 40), (0, 40)],
    }


def test_polygons_in_two_zooms(spark):
    box = [(-10.0, -10.0), (30.0, -10.0), (30.0, 20.0), (-10.0, 20.0)]
    rows = [(1, box), (2, None), (3, [(5.0, 5.0), (5.001, 5.0), (5.0, 5.001)]), (4, [(500.0, 0.0), (600.0, 0.0), (600.0, 9.0)])]
    got = {(r.z, r.tx, r.ty, r.id): sorted((p.x, p.y) for p in r.ring) for r in tile_polygons(spark.createDataFrame(rows, f"id long, ring {POINTS}"), [0, 1], 100.0, 100).collect()}
    assert got[0, 0, 0, 1] == [(45, 45), (45, 60), (65, 45), (65, 60)]
    assert got[1, 1, 1, 1] == [(0, 0), (0, 20), (30, 0), (30, 20)] and got[1, 0, 0, 1] == [(90, 90), (90, 100), (100, 90), (100, 100)]
    assert set(got) == {(0, 0, 0, 1), (1, 0, 0, 1), (1, 0, 1, 1), (1, 1, 0, 1), (1, 1, 1, 1)}
