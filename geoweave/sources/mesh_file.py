"""The columnar mesh file: two boxes, numbers of elements, then arrays of 32-bit floats or whole numbers, little-endian.

Arrays are DataFrames (at, v): place and value. They are written as blocks by tasks, each a file of its own in a folder, and
a manifest says which is where; a folder is read by tasks, block by block. Only where a single file is asked for, one task strings the
blocks together, a block in memory at a time, because a file has one end; a file is read by tasks, each its own range of it.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from geoweave.shared import fresh_path

# The arrays in their order, and what they hold.
ARRAYS = {
    "vertices": "<f4", "triangles": "<i4", "neighbors": "<i4", "polygons": "<i4", "poly_centroids": "<f4", "poly_verts": "<i4", "poly_tris": "<i4",
    "poly_neighbors": "<i4", "buildings": "<i4", "building_verts": "<i4", "blob_buildings": "<i4",
}
COUNTS = ["walkable_triangle_count", "walkable_polygon_count"]
_HEAD = struct.Struct(f"<8f{len(ARRAYS) + len(COUNTS)}i")
#: Values of a block, and the file that names the blocks of a folder.
BLOCK, MANIFEST = 1 << 20, "manifest.json"


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_mesh_parts(spark: SparkSession, arrays: dict[str, DataFrame], boxes: tuple[float, ...], counts: dict[str, int], folder: str) -> dict:
    """Writes arrays as blocks of BLOCK values under folder, with the manifest that it gives: boxes, sizes, and files (array, first, n, file).

    arrays: (at long, v) for some of ARRAYS, places from 0 without gaps; those left out are empty. boxes: 8 numbers. The driver
    sees a row for each block. A task that runs twice leaves a file that the manifest doesn't name.
    """
    unknown = set(arrays) - set(ARRAYS)
    if unknown:
        raise ValueError(f"no such arrays: {sorted(unknown)}")
    rows = spark.createDataFrame([], "array int, at long, v double")
    for i, name in enumerate(ARRAYS):
        if name in arrays:
            rows = rows.unionAll(arrays[name].select(F.lit(i), F.col("at").cast("long"), F.col("v").cast("double")))
    kinds = list(ARRAYS.values())

    def block(table: pa.Table) -> pa.Table:
        i, b = (table.column(c)[0].as_py() for c in ("array", "block"))
        at, v = (table.column(c).to_numpy() for c in ("at", "v"))
        order = np.argsort(at)
        if (at[order] != b * BLOCK + np.arange(len(at))).any():
            raise ValueError(f"{list(ARRAYS)[i]}: places have gaps or stand twice in block {b}")
        system, place = _at(folder)
        system.create_dir(place, recursive=True)
        own = f"{list(ARRAYS)[i]}-{b:08d}-{uuid.uuid4().hex[:12]}"
        with system.open_output_stream(f"{place}/{own}") as out:
            out.write(v[order].astype(kinds[i]).tobytes())
        return pa.table({"array": pa.array([i], pa.int32()), "block": pa.array([b], pa.int64()), "n": pa.array([len(at)], pa.int64()), "file": [own]})

    blocks = rows.withColumn("block", F.floor(F.col("at") / BLOCK)).groupBy("array", "block").applyInArrow(block, "array int, block long, n long, file string")
    listed = blocks.orderBy("array", "block").collect()  # a row for each million values
    sizes = [sum(r["n"] for r in listed if r["array"] == i) for i in range(len(ARRAYS))]
    if any(r["n"] < BLOCK for r, after in zip(listed, listed[1:]) if r["array"] == after["array"]):
        raise ValueError("places have gaps")
    names = list(ARRAYS)
    files = [{"array": names[r["array"]], "first": r["block"] * BLOCK, "n": r["n"], "file": r["file"]} for r in listed]
    manifest = {"boxes": list(boxes), **dict(zip(names, sizes)), **{c: counts.get(c, 0) for c in COUNTS}, "files": files}
    system, place = _at(folder)
    system.create_dir(place, recursive=True)
    with system.open_output_stream(f"{place}/{MANIFEST}") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


def write_mesh(spark: SparkSession, arrays: dict[str, DataFrame], boxes: tuple[float, ...], counts: dict[str, int], path: str) -> None:
    """The same as one file: the blocks are written to the shared folder and strung together by one task."""
    draft = fresh_path(spark, "mesh")
    manifest = write_mesh_parts(spark, arrays, boxes, counts, draft)
    sizes = [manifest[name] for name in ARRAYS]
    head, files = _HEAD.pack(*boxes, *sizes, *(manifest[c] for c in COUNTS)), [f["file"] for f in manifest["files"]]

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            pass
        (system, to), (parts, place) = _at(path), _at(draft)
        system.create_dir(to.rpartition("/")[0], recursive=True)
        own = f"{to}.{uuid.uuid4().hex}"
        with system.open_output_stream(own) as out:
            out.write(head)
            for name in files:
                with parts.open_input_file(f"{place}/{name}") as block:
                    out.write(block.read())
        system.move(own, to)
        yield pa.RecordBatch.from_arrays([pa.array([sum(sizes)], pa.int64())], names=["values"])

    spark.range(1).coalesce(1).mapInArrow(together, "values long").collect()


def mesh_header(path: str) -> dict:
    """boxes, and the number of values of each array and of what is walkable; for a folder its whole manifest."""
    system, at = _at(path)
    if system.get_file_info(at).type == fs.FileType.Directory:
        with system.open_input_file(f"{at}/{MANIFEST}") as f:
            return json.loads(f.read())
    with system.open_input_file(at) as f:
        numbers = _HEAD.unpack(f.read(_HEAD.size))
    return {"boxes": numbers[:8], **dict(zip([*ARRAYS, *COUNTS], numbers[8:]))}


def read_mesh(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(array, at, v) of the arrays named, or all, from a file or a folder: v is a double, exact for both kinds.

    Only the ranges or blocks of these arrays are read.
    """
    head, start, ranges = mesh_header(path), _HEAD.size, []
    for name, kind in ARRAYS.items():
        if names is None or name in names:
            if "files" in head:
                ranges += [(name, kind, 0, f["first"], f["n"], f"/{f['file']}") for f in head["files"] if f["array"] == name]
            else:
                ranges += [(name, kind, start + 4 * i, i, min(BLOCK, head[name] - i), "") for i in range(0, head[name], BLOCK)]
        start += 4 * head[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, kind, offset, first, n, file in zip(*(c.to_pylist() for c in batch.columns)):
                system, at = _at(path)
                with system.open_input_file(at + file) as f:
                    v = np.frombuffer(f.read_at(4 * n, offset), kind)
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(first + np.arange(n)), pa.array(v.astype(float))], names=["array", "at", "v"])

    shape = "name string, kind string, offset long, first long, n long, file string"
    rows = spark.createDataFrame(ranges, shape).repartition(max(1, min(len(ranges), 1000))) if ranges else spark.createDataFrame([], shape)
    return rows.mapInArrow(run, "array string, at long, v double")


def write_mesh_text(arrays: DataFrame, path: str) -> None:
    """(array, at, v) as text, a line `array;at;v` for each value, in files of ranges in order."""
    ordered = arrays.orderBy("array", "at")
    ordered.select(F.concat_ws(";", "array", F.col("at").cast("string"), F.col("v").cast("string")).alias("value")).write.text(path)


def write_properties(buildings: DataFrame, path: str) -> None:
    """buildings (id, props) as JSON lines in order of id; missing tags are left out."""
    buildings.orderBy("id").select(F.to_json("props").alias("value")).write.text(path)


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """Properties of buildings as (props MAP), from JSON lines or JSON arrays, on one line or with an object or several on each.

    Files are read line by line; only where an object itself goes over several lines (a first line that opens one and no more) is
    each file taken as a whole. Lines without an object are left out.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")
    if any(r.value in ("{", "[{") for r in lines.limit(2).collect()):
        lines = spark.read.text(path, wholetext=True).select(F.trim(F.regexp_replace("value", r"\s+$|^\s+", "")).alias("value"))
    inner = F.regexp_replace(F.regexp_replace("value", r"^\[\s*", ""), r"[,\]\s]+$", "")
    objects = lines.select(inner.alias("value")).where(F.col("value").startswith("{"))
    return objects.select(F.explode(F.from_json(F.concat(F.lit("["), "value", F.lit("]")), "ARRAY<MAP<STRING,STRING>>")).alias("props"))
