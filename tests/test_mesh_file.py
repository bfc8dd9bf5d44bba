"""The columnar mesh file and building properties."""

import struct

import numpy as np
import pytest

from geoweave.sources import mesh_file as m


def test_mesh_comes_back_from_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 7)
    vertices, triangles = [i * 0.5 for i in range(20)], list(range(15, 0, -1))
    frame = lambda v: spark.createDataFrame(list(enumerate(map(float, v))), "at long, v double").repartition(3)
    path = f"{tmp_path}/deep/mesh.bin"
    m.write_mesh(spark, {"vertices": frame(vertices), "triangles": frame(triangles)}, tuple(range(8)), {"walkable_triangle_count": 4}, path)
    raw = open(path, "rb").read()
    assert struct.unpack("<8f13i", raw[:84]) == (*map(float, range(8)), 20, 15, *[0] * 9, 4, 0)
    assert np.frombuffer(raw[84:164], "<f4").tolist() == vertices and np.frombuffer(raw[164:], "<i4").tolist() == triangles
    got = {(r.array, r.at): r.v for r in m.read_mesh(spark, path).collect()}
    assert got == {("vertices", i): v for i, v in enumerate(vertices)} | {("triangles", i): v for i, v in enumerate(triangles)}
    assert m.read_mesh(spark, path, ["triangles"]).count() == 15 and m.read_mesh(spark, path, ["buildings"]).count() == 0
    m.write_mesh_text(m.read_mesh(spark, path, ["triangles"]), f"{tmp_path}/text")
    assert [r.value for r in spark.read.text(f"{tmp_path}/text").collect()][:2] == ["triangles;0;15.0", "triangles;1;14.0"]


def test_mesh_in_a_folder_of_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 7)
    v = spark.createDataFrame([(i, i * 0.25) for i in range(20)], "at long, v double").repartition(3)
    said = m.write_mesh_parts(spark, {"poly_centroids": v}, (1.0,) * 8, {"walkable_polygon_count": 2}, f"{tmp_path}/mesh")
    assert [(f["array"], f["first"], f["n"]) for f in said["files"]] == [("poly_centroids", 0, 7), ("poly_centroids", 7, 7), ("poly_centroids", 14, 6)]
    head = m.mesh_header(f"{tmp_path}/mesh")
    assert (head["poly_centroids"], head["vertices"], head["walkable_polygon_count"], head["boxes"]) == (20, 0, 2, [1.0] * 8)
    assert {r.at: r.v for r in m.read_mesh(spark, f"{tmp_path}/mesh").collect()} == {i: i * 0.25 for i in range(20)}
    assert m.read_mesh(spark, f"{tmp_path}/mesh", ["vertices"]).count() == 0


def test_places_with_gaps_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="gaps"):
        m.write_mesh(spark, {"vertices": spark.createDataFrame([(0, 1.0), (2, 1.0)], "at long, v double")}, (0.0,) * 8, {}, f"{tmp_path}/x.bin")
    with pytest.raises(ValueError):
        m.write_mesh(spark, {"other": spark.range(1).toDF("at")}, (0.0,) * 8, {}, f"{tmp_path}/x.bin")


def test_properties(spark, tmp_path):
    rows = spark.createDataFrame([(2, {"name": 'b"'}), (1, {"name": "a", "num": "7"})], "id long, props map<string,string>")
    m.write_properties(rows, f"{tmp_path}/lines")
    assert [dict(r.props) for r in m.read_properties(spark, f"{tmp_path}/lines").collect()] == [{"name": "a", "num": "7"}, {"name": 'b"'}]
    (tmp_path / "array.json").write_text('[\n{"name": "a"},\n{"name": "b"}]')
    assert [dict(r.props) for r in m.read_properties(spark, f"{tmp_path}/array.json").collect()] == [{"name": "a"}, {"name": "b"}]
    for k, text in enumerate(('[{"name": "a"}, {"name": "b]"}]', '[{"name": "a"},\n{"name": "b]"}\n]\n', '[\n  {\n    "name": "a"\n  },\n  {\n    "name": "b]"\n  }\n]\n', '{"name": "a"}\n\n{"name": "b]"}\n', "[]", "")):
        (tmp_path / f"p{k}.json").write_text(text)
        assert [dict(r.props) for r in m.read_properties(spark, f"{tmp_path}/p{k}.json").collect()] == [{"name": "a"}, {"name": "b]"}] * (k < 4)
