"""Feature files, point location and nearest neighbours: the cases that files and tables of the driver do not hold."""

from pyspark.sql import functions as F

from geoweave.operators import cleaning, locate, spatial
from geoweave.sources import features as f
from geoweave.functions import shapes as s

C = F.col
POINT = '"geometry": {"type": "Point", "coordinates": [1, 2]}'


def test_lines_with_spaces_and_any_order_of_keys(spark, tmp_path):
    lines = [
        '{"type": "FeatureCollection", "features": [', '{"type": "Feature", "id": "a", ' + POINT + ', "properties": {"name": "x"}},',
        '  {' + POINT + ', "properties": null, "type": "Feature"} ,', '{"type":"Feature","properties":{},' + POINT + ',"bbox":[0,1]}', ']}', '{"type": "Other"}',
    ]
    (tmp_path / "a.geojson").write_text("\n".join(lines))
    got = f.read_geojson_lines(spark, str(tmp_path)).collect()
    assert [(r.id, r.geom_type, r.coordinates, dict(r.props)) for r in got] == [("a", "Point", "[1,2]", {"name": "x"}), (None, "Point", "[1,2]", {}), (None, "Point", "[1,2]", {})]
    assert [r.value for r in f.rejected_lines(spark, str(tmp_path)).collect()] == ['{"type": "Other"}']


def test_ids_with_quotes_come_back(spark, tmp_path):
    rows = [('a"b', "Point", "[1,2]", {"k": 'v"\\'}), (None, "Point", "[3,4]", None)]
    f.write_geojson_lines(spark.createDataFrame(rows, "id string, geom_type string, coordinates string, props map<string,string>"), f"{tmp_path}/out")
    got = sorted(((r.id, r.coordinates, dict(r.props)) for r in f.read_geojson_lines(spark, f"{tmp_path}/out").collect()), key=str)
    assert got == sorted([('a"b', "[1,2]", {"k": 'v"\\'}), (None, "[3,4]", {})], key=str)


def test_buildings_come_back(spark, tmp_path):
    ring = [(0.0, 0.0), (1.5, 0.0), (1.0, 2.25)]
    f.write_buildings(spark.createDataFrame([("7", {"name": "[x]"}, ring)], "osm_id string, props map<string,string>, ring array<struct<x:double,y:double>>"), f"{tmp_path}/out")
    got = f.read_buildings(spark, f"{tmp_path}/out").first()
    assert (got.osm_id, dict(got.props), [(p.x, p.y) for p in got.ring]) == ("7", {"name": "[x]"}, ring)


def test_atlas(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"b": {"x": 8, "y": 0, "w": 8, "h": 4}, "a": {"x": 0, "y": 4, "w": 4, "h": 4}}')
    got = [tuple(r) for r in f.atlas_coordinates(f.read_atlas(spark, f"{tmp_path}/a.json"), 16.0, 8.0).orderBy("sprite_id").collect()]
    assert got == [("a", 0, 0.0, 4.0, 4.0, 4.0, 0.0, 0.5, 0.25, 1.0), ("b", 1, 8.0, 0.0, 8.0, 4.0, 0.5, 0.0, 1.0, 0.5)]


def test_nearest_ends_with_null_and_far_queries(spark):
    q = spark.createDataFrame([(1, None, 0.0), (2, 1e7, 1e7), (3, float("nan"), 1.0), (4, 0.0, 0.0)], "q long, x double, y double")
    p = spark.createDataFrame([(5, 3.0, 4.0), (6, -3.0, 4.0), (7, None, 1.0)], "k long, x double, y double")
    assert sorted((r.q, r.k) for r in spatial.nearest(q, p).collect()) == [(2, 5), (4, 5)]
    assert spatial.nearest(q, p.limit(0)).collect() == [] and spatial.nearest(q.limit(0), p).collect() == []


def test_large_and_small_boxes_on_their_own_grids(spark):
    p = spark.createDataFrame([(1, 5.0, 5.0), (2, 90_000.0, -3.0), (3, None, 5.0)], "k long, x double, y double")
    b = spark.createDataFrame([(1, -1e5, -1e5, 1e5, 1e5), (2, 4.0, 4.0, 6.0, 6.0), (3, 5.0, 5.0, 5.0, 5.0), (4, None, 0.0, 9.0, 9.0)], "b long, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.k, r.b) for r in spatial.points_in_boxes(p, b).collect()) == [(1, 1), (1, 2), (1, 3), (2, 1)]


def test_pairs_at_the_radius(spark):
    p = spark.createDataFrame([(2, 0.0, 0.0), (1, 1.0, 0.0), (3, -0.5, 0.0), (3, -0.5, 0.0)], "k long, x double, y double")
    assert {(r.a, r.b) for r in spatial.pairs_within(p, 1.0).collect()} == {(1, 2), (2, 3)}
    assert {(r.a, r.b) for r in spatial.pairs_within(p, 1.0, strict=True).collect()} == {(2, 3)}


def test_shared_edges_go_to_the_first_triangle_and_gaps_to_none(spark):
    rows = [(1, 0, 1, 2, 0.0, 0.0, 4.0, 0.0, 4.0, 4.0), (2, 0, 2, 3, 0.0, 0.0, 4.0, 4.0, 0.0, 4.0)]
    t = locate.triangle_rings(spark.createDataFrame(rows, "tid long, v1 long, v2 long, v3 long, ax double, ay double, bx double, by double, cx double, cy double"))
    p = spark.createDataFrame([(1, 2.0, 2.0), (2, 0.0, 4.0), (3, 9.0, 9.0), (4, 1.0, 3.0), (5, None, 1.0)], "k long, x double, y double")
    assert sorted((r.k, r.tid) for r in locate.first_hit(p, t, "tid").collect()) == [(1, 1), (2, 2), (4, 2)]
    assert locate.match_counts(p, t).first().asDict() == {"zero_matches": 2, "multi_matches": 1, "n_points": 5}


def test_mostly_inside_lets_a_ninth_be_outside(spark):
    square = lambda *v: [(float(v[i]), float(v[j])) for i, j in ((0, 1), (2, 1), (2, 3), (0, 3))]
    fine = [(x / 5, 0.0) for x in range(5)] + [(1.0, y / 5) for y in range(5)] + [(1 - x / 5, 1.0) for x in range(5)] + [(0.0, 1 - y / 5) for y in range(5)]
    rows = [(square(0, 0, 1, 1), square(0, 0, 1, 1)), (square(0, 0, 1, 1), square(0.4, 0, 1, 1)), (fine, square(0, 0, 1.0, 0.9)), ([(0.5, 0.5)], square(0, 0, 1, 1)), ([], square(0, 0, 1, 1))]
    got = spark.createDataFrame(rows, "a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>").select(s.mostly_inside(C("a"), C("b")).alias("m"))
    assert [r.m for r in got.collect()] == [True, False, False, True, False]


def test_side_of_a_line_with_bends(spark):
    line = [(0.0, 0.0), (4.0, 1.0), (4.0, 4.0), (8.0, 5.0)]
    p = spark.createDataFrame([(1.0, 2.0), (1.0, -1.0), (5.0, 2.0), (3.0, 2.0), (-50.0, 9.0), (60.0, 3.0)], "x double, y double")
    got = [r[0] for r in p.select(s.line_side(C("x"), C("y"), line)).collect()]
    above = [got[0], got[3], got[4]]
    assert len(set(above)) == 1 and {got[1], got[2], got[5]} == {1 - above[0]}


def test_cleaning_of_odd_rows(spark):
    rows = [("1", "Polygon", None, None), ("2", None, None, {"building": "yes"}), ("3", "Polygon", None, {"building": "yes", "payment:x": ""}), ("3", "Polygon", None, {"building": "yes", "payment:x": ""}), ("4", "Polygon", None, {})]
    got = cleaning.judged(spark.createDataFrame(rows, "id string, geom_type string, closed boolean, props map<string,string>"))
    assert [(r.id, r.kept, [tuple(e) for e in r.log]) for r in got.collect()] == [
        ("1", False, []), ("2", False, [("removed", "invalid_geometry", "missing")]),
        *[("3", True, [("modified", "building_yes_to_commercial_by_props", "payment:x"), ("modified", "building_category_condensed", "commercial_to_commercial")])] * 2, ("4", False, []),
    ]
