"""Shapes cut to the tiles of several zooms, in whole steps of each tile.

At zoom z the square world from -extent to extent has 2**z tiles a side. A shape is repeated for the tiles that its box meets,
cut to each, and put in whole steps from the tile's lower left corner: lines by expressions, rings an Arrow batch at a time. Shapes
may be outside the world in part: what lies there is in no tile. Null shapes have no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from geoweave.functions import clip, geometry as g
from geoweave.operators.locate import with_box

C = F.col
_WHOLE = ArrayType(StructType([StructField("x", LongType()), StructField("y", LongType())]))


def _tiled(boxed: DataFrame, zooms: list[int], extent: float, within: str = "") -> DataFrame:
    """Rows with a box (x0, y0, x1, y1) once for each tile (z, tx, ty) that it meets, with the tile's corner (ox, oy) and size.

    A box that begins on the side between two tiles is in the second one; in both if a larger box, with columns that have
    `within` before their names, reaches into the first.
    """
    rows = boxed.withColumn("z", F.explode(F.array(*map(F.lit, zooms)))).withColumn("n", F.pow(F.lit(2.0), C("z"))).withColumn("size", 2 * extent / C("n"))
    place = lambda c: (C(c) + extent) / C("size")
    at = lambda c: F.floor(place(c)).cast("long")
    first = lambda c: F.greatest(at(f"{within}{c}"), F.ceil(place(c)).cast("long") - 1) if within else at(c)
    low, high = (lambda c: F.greatest(first(c), F.lit(0).cast("long"))), (lambda c: F.least(at(c), (C("n") - 1).cast("long")))
    span = lambda c: F.when(low(f"{c}0") <= high(f"{c}1"), F.sequence(low(f"{c}0"), high(f"{c}1")))
    rows = rows.withColumn("tx", F.explode(span("x"))).withColumn("ty", F.explode(span("y")))
    return rows.withColumns({"ox": C("tx") * C("size") - extent, "oy": C("ty") * C("size") - extent}).drop("n", "x0", "y0", "x1", "y1")


def _steps(v: Column, steps: int) -> Column:
    return F.floor(v / C("size") * steps + 0.5).cast("long")


def tile_polygons(shapes: DataFrame, zooms: list[int], extent: float, steps: int = 4096) -> DataFrame:
    """(z, tx, ty, id, ring) for shapes (id, ring): rings of whole numbers without repeated corners; those without area are left out.

    Parts of a ring that is not convex stay joined along the tile's border.
    """
    rows = _tiled(with_box(shapes.select("id", "ring")), zooms, extent)
    near = F.transform("ring", lambda p: g.point(p["x"] - C("ox"), p["y"] - C("oy")))
    keys = ["z", "tx", "ty", "id"]
    given = rows.select(*keys, near.alias("ring"), C("size").cast("double"))
    kind = StructType([*given.select(*keys).schema.fields, StructField("ring", _WHOLE)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(5).to_numpy(zero_copy_only=False)
            x, y, at = clip.cut_to_boxes(*clip.ring_arrays(batch.column(4)), np.zeros(len(size)), np.zeros(len(size)), size, size)
            x, y = (np.floor(v / np.repeat(size, np.diff(at)) * steps + 0.5).astype(np.int64) for v in (x, y))
            # without corners on the one before, the first one's being the last
            before = np.arange(-1, len(x) - 1)
            before[at[:-1][np.diff(at) > 0]] = at[1:][np.diff(at) > 0] - 1
            new = (x != x[before]) | (y != y[before])
            at = np.append(0, np.cumsum(new))[at]
            x, y = x[new], y[new]
            follow = np.arange(1, len(x) + 1)
            follow[at[1:][np.diff(at) > 0] - 1] = at[:-1][np.diff(at) > 0]
            twice = np.append(0, np.cumsum(x * y[follow] - x[follow] * y))[at]
            out = pa.RecordBatch.from_arrays([*batch.columns[:4], clip.rings_column(x, y, at)], names=[*keys, "ring"])
            yield out.filter(pa.array((np.diff(at) > 2) & (np.diff(twice) != 0)))

    return given.mapInArrow(run, kind)


def tile_lines(lines: DataFrame, zooms: list[int], extent: float, steps: int = 4096) -> DataFrame:
    """(z, tx, ty, id, part, line) for lines (id, line): one row for each stretch of a line within a tile, in order.

    Tiles are those that the whole line's box meets, each with its border: what runs along the side between two of them is in
    both. A stretch ends where the line leaves the tile. Points that fall on the one before are left out; a stretch of one point stays.
    """
    n = F.size("line")
    pair = F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.struct(i.alias("i"), F.get("line", i).alias("a"), F.get("line", i + 1).alias("b")))
    whole = with_box(lines.where(n > 1), "line").select("id", *[C(c).alias(f"l{c}") for c in ("x0", "y0", "x1", "y1")], F.explode(pair).alias("s"))
    rows = whole.select("id", "lx0", "ly0", "lx1", "ly1", "s.i", C("s.a.x").alias("ax"), C("s.a.y").alias("ay"), C("s.b.x").alias("bx"), C("s.b.y").alias("by"))
    boxed = rows.withColumns({"x0": F.least("ax", "bx"), "y0": F.least("ay", "by"), "x1": F.greatest("ax", "bx"), "y1": F.greatest("ay", "by")})
    tiled = _tiled(boxed, zooms, extent, within="l")
    cut = tiled.withColumn("t", F.explode(F.array(clip.clipped_span(C("ax"), C("ay"), C("bx"), C("by"), C("ox"), C("oy"), C("ox") + C("size"), C("oy") + C("size"))))).where("t is not null")
    place = lambda t, d: F.when(C(f"t.{t}") == 0, C(f"a{d}")).when(C(f"t.{t}") == 1, C(f"b{d}")).otherwise(C(f"a{d}") + C(f"t.{t}") * (C(f"b{d}") - C(f"a{d}")))
    at = lambda t: F.struct(*[_steps(place(t, d) - C(f"o{d}"), steps).alias(d) for d in "xy"])
    each = cut.select("z", "tx", "ty", "id", "i", "t", at("t0").alias("p"), at("t1").alias("q"))
    w = Window.partitionBy("z", "tx", "ty", "id").orderBy("i")
    goes_on = (F.lag("i").over(w) == C("i") - 1) & (F.lag("t.t1").over(w) == 1) & (C("t.t0") == 0)
    parts = each.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("part", F.sum("new").over(w) - 1)
    held = parts.groupBy("z", "tx", "ty", "id", "part").agg(F.array_sort(F.collect_list(F.struct("i", "p", "q"))).alias("s"))
    line = F.concat(F.array(F.get("s", F.lit(0))["p"]), F.transform("s", lambda x: x["q"]))
    return held.withColumn("line", line).withColumn("line", F.filter("line", lambda p, i: (i == 0) | (p != F.get("line", i - 1)))).drop("s")
