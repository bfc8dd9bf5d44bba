"""Cases that the tables do not hold, and queries without SQL."""

import heapq

import pytest
from pyspark.sql import functions as F

from geoweave.functions import geometry as g
from geoweave.operators import graph, mesh, rules, sequences, simulation, spatial

C = F.col


def test_rounding_goes_up_at_halves(spark):
    rows = spark.createDataFrame([(-2.5,), (2.5,), (0.005,), (-0.005,)], "v double")
    assert [r[0] for r in rows.select(g.round_half_up(C("v"), 0)).collect()] == [-2.0, 3.0, 0.0, 0.0]


def test_empty_tag_is_missing(spark):
    rows = spark.createDataFrame([({"name": "", "alt": "x"},), ({"alt": ""},)], "props map<string,string>")
    assert [r[0] for r in rows.select(rules.first_of(C("props"), ["name", "alt"])).collect()] == ["x", None]


def test_points_on_borders_and_in_two_boxes(spark):
    p = spark.createDataFrame([(1, 64.0, 64.0), (2, 500.0, 500.0)], "k long, x double, y double")
    b = spark.createDataFrame([(1, 0.0, 0.0, 64.0, 64.0), (2, 64.0, 0.0, 128.0, 64.0)], "b long, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.k, r.b) for r in spatial.points_in_boxes(p, b).collect()) == [(1, 1), (1, 2)]
    assert spatial.points_in_boxes(p.limit(0), b).count() == 0


def test_collisions_need_a_common_cell_and_distance(spark):
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.02, 1.0), (3, 4.9, 1.0), (4, 127.9, 1.0), (5, 128.1, 1.0)], "k long, x double, y double")
    assert sorted((r.a, r.b) for r in spatial.collisions(p).collect()) == [(1, 3), (2, 3)]


def test_non_manifold_edge_has_no_neighbour(spark):
    t = spark.createDataFrame([(1, 1, 2, 3), (2, 2, 1, 4), (3, 1, 2, 5)], "tid long, v1 long, v2 long, v3 long")
    assert {r.neighbour for r in mesh.triangle_neighbours(t).collect()} == {-1}


def test_squeezed_keeps_nulls_apart(spark):
    rows = spark.createDataFrame([([1, 1, None, None, 2, 1],)], "v array<int>")
    assert rows.select(sequences.squeezed(C("v"))).first()[0] == [1, None, 2, 1]


def test_components_of_a_chain_and_a_lone_node(spark):
    nodes = spark.range(1, 12).select(C("id").alias("v"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 9)], "a long, b long")
    got = {r.v: r.label for r in graph.components(nodes, edges).collect()}
    assert got == {**{i: 1 for i in range(1, 10)}, 10: 10, 11: 11}


def test_route_costs_against_a_heap(spark):
    edges = [(a, b, float((a * 7 + b * 3) % 5 + 1)) for a in range(12) for b in range(12) if a != b and (a * b) % 4 == 1]
    best, heap = {}, [(0.0, 1)]
    while heap:
        c, v = heapq.heappop(heap)
        if v not in best:
            best[v] = c
            for a, b, w in edges:
                if a == v:
                    heapq.heappush(heap, (c + w, b))
    start = spark.createDataFrame([(1,)], "v long")
    got = graph.route_costs(start, spark.createDataFrame(edges, "a long, b long, cost double"))
    assert {r.v: r.cost for r in got.collect()} == best


def test_hop_distances_have_no_end_but_the_graph(spark, tmp_path):
    from geoweave.plans.queries import QUERIES, _edges
    from geoweave.sources.driver_tables import city

    # points that lie in the first cells of the grid only, in rows full enough to be walked
    near = F.pmod(C("id") * 7919, F.lit(2_000_001)) < 600_000
    low = F.pmod(C("id") * 104729, F.lit(2_000_001)) < 300_000
    spark.range(1, 20_000).where(near & low).select(C("id").alias("o_orderkey")).write.parquet(f"{tmp_path}/orders.parquet")
    nodes = [r.v for r in city(spark, tmp_path).collect()]
    onward: dict = {}
    for r in _edges(spark, tmp_path).collect():
        onward.setdefault(r.a, []).append(r.b)
    best, layer = {min(nodes): 0}, [min(nodes)]
    while layer:
        layer = sorted({b for a in layer for b in onward.get(a, []) if b not in best})
        best |= {b: max(best.values()) + 1 for b in layer}
    assert max(best.values()) > 8
    assert {r.v: r.hops for r in QUERIES["hop_distances"](spark, tmp_path).collect()} == best


def test_spawner_spawns_once_a_tick(spark):
    ticks = spark.createDataFrame([(1, t, 25.0) for t in range(3)], "spawner long, t long, dt double")
    r = simulation.spawn_schedule(ticks, 10.0).first()
    assert (r.spawned, r.left) == (3, 45.0)


def test_stuck_score_is_reset_by_a_new_target(spark):
    steps = spark.createDataFrame([(1, 1, "a", False), (1, 2, "a", False), (1, 3, "b", False), (1, 4, "b", False)], "agent long, t long, target string, moved boolean")
    assert simulation.stuck_score(steps).first().score == 1.0


@pytest.mark.parametrize("n", [1, 5])
def test_group_sizes(spark, n):
    rows = spark.createDataFrame([(i % n,) for i in range(10)], "k int")
    r = mesh.group_sizes(rows, "k").first()
    assert (r.groups, r.largest, r.singles) == (n, 10 // n, 0)


def test_frame_rates_stream(spark, tmp_path):
    from geoweave.streaming.metrics import frame_rates

    spark.sql("SELECT timestamp_seconds(id) AS ts, 1L AS user_id FROM range(20)").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, user_id long").parquet(str(tmp_path / "in"))
    q = frame_rates(stream, "10 seconds", "10 seconds").writeStream.format("memory").queryName("rates").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.n for r in spark.table("rates").collect()) == [10, 10]


def test_hulls_in_stages(spark):
    import numpy as np

    from geoweave.operators.polygons import convex_hulls, hull_of

    rng = np.random.default_rng(5)
    x, y = rng.integers(0, 50, 400) / 2.0, rng.integers(0, 50, 400) / 2.0
    rows = spark.createDataFrame([(i % 3, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "g int, x double, y double")
    got = convex_hulls(rows, "g").toPandas().sort_values(["g", "seq"])
    for k in range(3):
        own = hull_of(x[k::3], y[k::3])
        assert list(zip(got[got.g == k].x, got[got.g == k].y)) == list(zip(x[k::3][own], y[k::3][own]))


def test_flattening_keeps_three(spark):
    from geoweave.operators.polygons import flattened

    ring = [(0.0, 0.0), (5.0, 0.01), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    rows = spark.createDataFrame([(1, ring), (2, ring[:3])], "id int, ring array<struct<x double, y double>>")
    assert {r.id: len(r.ring) for r in flattened(rows, 1.0).collect()} == {1: 4, 2: 3}


def test_rings_round_trip_and_malformed_lines(spark, tmp_path):
    from geoweave.sources.features import read_buildings, read_rings, write_rings

    (tmp_path / "a.txt").write_text("1;[a,b];[0,0,1,0,1,1]\n2;[];[5,5,6,5,99,9]\nbad;line\n3;[c];[0,x,1,1]\n\n4;[c];[0,0];9\n")
    got = read_rings(spark, str(tmp_path / "a.txt"))
    assert {r.blob_id: (r.building_ids, len(r.ring)) for r in got.collect()} == {1: (["a", "b"], 3), 2: ([], 3)}
    assert [r.blob_id for r in read_rings(spark, str(tmp_path / "a.txt"), (0, 0, 10, 10)).collect()] == [1]
    write_rings(got, str(tmp_path / "out"))
    assert sorted(map(str, read_rings(spark, str(tmp_path / "out")).collect())) == sorted(map(str, got.collect()))
    (tmp_path / "b.txt").write_text('w1;{"name":"A [x]"}[0,0,1,1]\nw2;{}\n')
    assert [(r.osm_id, r.props["name"], len(r.ring)) for r in read_buildings(spark, str(tmp_path / "b.txt")).collect()] == [("w1", "A [x]", 2)]


def test_geojson(spark, tmp_path):
    from geoweave.sources.features import read_geojson, read_geojson_lines, write_geojson_lines

    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[\n{"type":"Feature","id":"w1","geometry":{"type":"Point","coordinates":[1,2]},"properties":{"k":"v"}},\n{"type":"Feature","id":"w2","geometry":{"type":"Point","coordinates":[3,4]},"properties":{"id":"own"}}\n]}')
    whole, lines = read_geojson(spark, str(tmp_path / "a.geojson")).drop("file"), read_geojson_lines(spark, str(tmp_path / "a.geojson")).drop("file")
    assert sorted(map(str, whole.collect())) == sorted(map(str, lines.collect())) and {r.id for r in whole.collect()} == {"w1", "own"}
    write_geojson_lines(whole, str(tmp_path / "out"))
    assert sorted(r.coordinates for r in read_geojson_lines(spark, str(tmp_path / "out")).collect()) == ["[1,2]", "[3,4]"]


def test_clear_deletes_what_was_written(spark):
    from geoweave.shared import clear, fresh_path, written

    kept = written(spark.range(3).toDF("v"), "kept")
    folder = fresh_path(spark, "x").removeprefix("file://").rpartition("/")[0]
    assert kept.count() == 3 and len(__import__("os").listdir(folder)) > 0
    assert clear(spark) and not __import__("os").path.exists(folder)


def test_extracts_hold_whole_features(spark):
    """A line that crosses the box comes with its points outside; points of no feature, lost names and groups have their own rules."""
    from geoweave.operators.spatial import extracted

    points = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 0.0), (3, 5.0, 5.0), (4, 99.0, 99.0), (5, 10.0, 10.0), (6, None, 1.0)], "v long, x double, y double")
    uses = spark.createDataFrame([(10, 1), (10, 2), (10, 777), (11, 4), (11, 2), (12, 6)], "id long, v long")
    members = spark.createDataFrame([(100, 10), (100, 11), (101, 11)], "grp long, id long")
    found = [sorted(r[0] for r in df.collect()) for df in extracted(points, uses, members, (0.0, 0.0, 10.0, 10.0))]
    assert found == [[1, 2, 3, 5], [10], [100]]
    assert all(df.count() == 0 for df in extracted(points.limit(0), uses, members, (0.0, 0.0, 1.0, 1.0)))
