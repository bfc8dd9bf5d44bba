"""Point location: which triangle, polygon, blob or building holds a point, by equi-joins on grid cells.

Shapes are repeated for the cells that they really meet (not for all of their box), points have one cell. The join is one
that Spark broadcasts or splits by itself; the first hit is an aggregate with partial results, so a crowded cell is no task
of its own. Points with a null coordinate, and those outside all shapes, have no row. Repeated points of one key are one
point. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from geoweave.functions import geometry as g, shapes as s
from geoweave.functions.geometry import cell, point
from geoweave.operators import cellwise
from geoweave.operators.polygons import convex_hulls
from geoweave.operators.spatial import least_holder, places, points_in_boxes, with_cells
from geoweave.shared import written

C = F.col


def with_box(shapes: DataFrame, ring: str = "ring") -> DataFrame:
    """shapes with the box (x0, y0, x1, y1) of their ring; rings without vertices are left out."""
    ends = lambda f, c: f(f"{ring}.{c}")
    return shapes.where(F.size(ring) > 0).withColumns({"x0": ends(F.array_min, "x"), "y0": ends(F.array_min, "y"), "x1": ends(F.array_max, "x"), "y1": ends(F.array_max, "y")})


def shape_cells(shapes: DataFrame, size: float) -> DataFrame:
    """shapes (ring, ...) once for each cell (cx, cy) of a grid that the ring meets: the bridge table of a polygon index."""
    held = lambda c: (C(c) * size, (C(c) + 1) * size)
    (x0, x1), (y0, y1) = held("cx"), held("cy")
    return with_cells(with_box(shapes), size).where(s.ring_meets_box(C("ring"), x0, y0, x1, y1)).drop("x0", "y0", "x1", "y1")


def triangle_rings(triangles: DataFrame) -> DataFrame:
    """triangles (tid, v1, v2, v3, ax, ay, bx, by, cx, cy) as (tid, ring) with vertex numbers."""
    corner = lambda x, y, v: F.struct(C(x).cast("double").alias("x"), C(y).cast("double").alias("y"), C(v).alias("v"))
    return triangles.select("tid", F.array(corner("ax", "ay", "v1"), corner("bx", "by", "v2"), corner("cx", "cy", "v3")).alias("ring"))


def hits(points: DataFrame, shapes: DataFrame, test: Column, size: float) -> DataFrame:
    """Rows of points (k, x, y) and shapes (ring, ...) of a common cell for which test holds."""
    p = points.withColumn("_cx", cell(C("x"), size)).withColumn("_cy", cell(C("y"), size))
    cells = shape_cells(shapes, size).withColumnsRenamed({"cx": "_cx", "cy": "_cy"})
    return p.join(cells, ["_cx", "_cy"]).where(test).drop("_cx", "_cy", "ring")


def numbered() -> Column:
    return s.in_numbered_ring(C("x"), C("y"), C("ring"))


def even_odd() -> Column:
    return s.in_ring(C("x"), C("y"), C("ring"))


def triangle_hits(points: DataFrame, triangles: DataFrame, size: float = 256.0) -> DataFrame:
    """Rows of points (k, x, y) and triangles (tid, v1, v2, v3, ax, ..) that hold them, in plain columns: no ring goes through the join."""
    corner = lambda v, c: (C(f"{c}x"), C(f"{c}y"), C(v))
    named = [corner(v, c) for v, c in (("v1", "ta"), ("v2", "tb"), ("v3", "tc"))]
    plain = triangles.select("tid", "v1", "v2", "v3", *[C(f"{c}{d}").cast("double").alias(f"t{c}{d}") for c in "abc" for d in "xy"])
    ends = lambda f, d: f(*[f"t{c}{d}" for c in "abc"])
    boxed = plain.withColumns({"x0": ends(F.least, "x"), "y0": ends(F.least, "y"), "x1": ends(F.greatest, "x"), "y1": ends(F.greatest, "y")})
    ring = ring_of_xy(*[(C(f"t{c}x"), C(f"t{c}y")) for c in "abc"])
    held = lambda c: (C(c) * size, (C(c) + 1) * size)
    (x0, x1), (y0, y1) = held("cx"), held("cy")
    cells = with_cells(boxed, size).where(s.ring_meets_box(ring, x0, y0, x1, y1)).withColumnsRenamed({"cx": "_cx", "cy": "_cy"})
    p = points.withColumn("_cx", cell(C("x"), size)).withColumn("_cy", cell(C("y"), size))
    near = (C("x") >= C("x0")) & (C("x") <= C("x1")) & (C("y") >= C("y0")) & (C("y") <= C("y1"))
    return p.join(cells, ["_cx", "_cy"]).where(near & s.in_numbered_triangle(C("x"), C("y"), named)).select(*points.columns, "tid")


def first_hit(points: DataFrame, shapes: DataFrame, key: str, test: Callable[[], Column] = numbered, size: float = 256.0) -> DataFrame:
    """(k, key): the least key of the shapes (key, ring) that hold each of points (k, x, y); see spatial.least_holder."""
    cells = edge_cells(shapes.select(key, "ring"), size)
    centre = cells.withColumns({"x": (C("cx") + 0.5) * size, "y": (C("cy") + 0.5) * size})
    cells = written(centre.withColumn("whole", ~C("met") & test()).where("met or whole").select(key, "cx", "cy", "whole", F.when(C("met"), C("ring")).alias("ring")), "cells")
    at = places(points).withColumns({"cx": cell(C("x"), size), "cy": cell(C("y"), size)})
    return least_holder(points, at, cells, key, test(), ["cx", "cy"])


def edge_cells(shapes: DataFrame, size: float) -> DataFrame:
    """shape_cells with `met`, whether an edge of the ring comes into the cell; where none does, all of the cell is inside or outside."""
    cells = shape_cells(shapes, size)
    return cells.withColumn("met", s.border_meets_box(C("ring"), C("cx") * size, C("cy") * size, (C("cx") + 1) * size, (C("cy") + 1) * size))


def windings(points: DataFrame, shapes: DataFrame, key: str, size: float = 256.0, most: int = cellwise.MOST) -> DataFrame:
    """(k, key, turns): points (k, x, y) and the shapes (key, ring) that go around them.

    The points of a cell are held, the shapes whose box meets it go past them; a place is tested once, however many points it
    has, and its hits are given to all of them in the task, so no pair goes through a shuffle. Edges with a coordinate that is null count for nothing.
    """
    good = points.select("k", "x", "y").where("not isnan(x) and not isnan(y) and x is not null and y is not null")
    at = good.withColumns({"cx": cell(C("x"), size), "cy": cell(C("y"), size)})
    boxed = with_box(shapes.select(key, "ring")).select(key, "x0", "y0", "x1", "y1", *[C(f"ring.{c}").cast("array<double>").alias(f"{c}s") for c in "xy"])
    both = cellwise.dealt(at, with_cells(boxed, size).select(C(key).alias("s"), "xs", "ys", "cx", "cy"), ["cx", "cy"], "k", most)
    kinds = {f.name: f.dataType.simpleString() for f in both.schema.fields}
    found = both.mapInArrow(_wound, f"k {kinds['k']}, s {kinds['s']}, turns int")
    return found.withColumnRenamed("s", key)


def _wound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cx, cy, _part, _passing, k, x, y, s, xs, ys) as cellwise.dealt gives them to (k, s, turns): points and how often a ring goes around them."""
    def keep(rows: pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray, pa.ListArray]]:
        """Places (x, y) with the keys of their points, some at a time."""
        x, y = (cellwise.numbers(rows.column(i)) for i in (5, 6))
        order = np.lexsort((y, x))
        x, y, k = x[order], y[order], rows.column(4).take(pa.array(order))
        new = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1]), [True])))
        x, y, ks = x[new[:-1]], y[new[:-1]], pa.ListArray.from_arrays(pa.array(new, pa.int32()), k)
        return [(x[i : i + 2**12], y[i : i + 2**12], ks.slice(i, 2**12)) for i in range(0, len(x), 2**12)]

    for held, rows in cellwise.met(batches, 3, keep):
        xs, at = cellwise.lists(rows.column(8))
        ys, _ = cellwise.lists(rows.column(9))
        after, of = cellwise.next_in_ring(at), np.repeat(np.arange(rows.num_rows), np.diff(at))
        e = np.stack((xs, ys, xs[after], ys[after]))
        for px, py, ks in held:
            near = (e[1] != e[3]) & (np.minimum(e[1], e[3]) <= py.max()) & (np.maximum(e[1], e[3]) > py.min())
            yield from _wound_cell(px, py, ks, rows.column(7), e[:, near], of[near])


def _wound_cell(px: np.ndarray, py: np.ndarray, ks: pa.ListArray, names: pa.Array, e: np.ndarray, of: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (k, s, turns) of places with the keys of their points and of edges e (ax, ay, bx, by) that belong to rows `of` of names, ascending; see shapes.winding_number."""
    first = np.flatnonzero(np.diff(of, prepend=-1))
    ends, i = np.append(first, len(of)), 0
    ax, ay, bx, by = e[:, :, None]
    sign = np.where(by > ay, 1, -1)
    low, high, dx, dy = np.minimum(ay, by), np.maximum(ay, by), sign * (bx - ax), sign * (by - ay)
    sizes, found = np.diff(ks.offsets.to_numpy()), []
    room = min(cellwise.AT_ONCE // len(px), 2**22 // sizes.sum())  # edges against places; and a ring may hold all points
    while i < len(first):
        to = max(i + 1, int(np.searchsorted(ends, ends[i] + room, "right")) - 1)
        c = slice(ends[i], ends[to])
        crossed = (dx[c] * (py - ay[c]) - dy[c] * (px - ax[c]) > 0) & (low[c] <= py) & (high[c] > py)
        turns = np.add.reduceat(sign[c].astype(np.int32) * crossed, first[i:to] - ends[i], axis=0)
        row, place = np.nonzero(turns)
        if len(row):
            t = turns[row, place]
            found.append((of[first[i + row]], t, place))
        i = to
        if found and (i == len(first) or sum(sizes[f[2]].sum() for f in found) > 2**18):
            row, t, place = map(np.concatenate, zip(*found))
            n = sizes[place]
            columns = [ks.take(pa.array(place)).flatten(), names.take(pa.array(np.repeat(row, n))), pa.array(np.repeat(t, n), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["k", "s", "turns"])
            found = []


def match_counts(points: DataFrame, shapes: DataFrame, test: Callable[[], Column] = numbered, size: float = 256.0) -> DataFrame:
    """One row: zero_matches, multi_matches and n_points of points (k, x, y)."""
    return counted(points, hits(points.select("k", "x", "y"), shapes.select("ring"), test(), size))


def counted(points: DataFrame, found: DataFrame) -> DataFrame:
    """One row: how many points (k) have no row and several rows in found (k), and how many there are."""
    n = found.groupBy("k").agg(F.count("*").alias("n"))
    all_ = points.select("k").join(n, "k", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return all_.agg(F.count_if(C("n") == 0).alias("zero_matches"), F.count_if(C("n") > 1).alias("multi_matches"), F.count("*").alias("n_points"))


def near_vertex(queries: DataFrame, triangles: DataFrame, size: float = 256.0) -> DataFrame:
    """(k, tid): for queries (k, x, y, v) the least triangle with vertex v among those that meet the cell of (x, y)."""
    q = queries.select("k", "v", cell(C("x"), size).alias("cx"), cell(C("y"), size).alias("cy"))
    cells = shape_cells(triangle_rings(triangles), size).select("tid", "cx", "cy", F.explode(F.transform("ring", lambda p: p["v"])).alias("v"))
    return q.join(cells, ["cx", "cy", "v"]).groupBy("k").agg(F.min("tid").alias("tid"))


def in_known_polygon(queries: DataFrame, triangles: DataFrame) -> DataFrame:
    """(k, tid, at_vertex) for queries (k, poly, x, y, v): the first triangle of the polygon that holds the point, and the first with vertex v.

    triangles (poly, tid, v1, v2, v3, ax, ..). Where the polygon has no such triangle the number is null; queries of a polygon
    without triangles have no row. Other polygons' triangles are not looked at, though they may hold the point too.
    """
    corner = lambda v, c: (C(f"{c}x"), C(f"{c}y"), C(v))
    inside = s.in_numbered_triangle(C("x"), C("y"), [corner("v1", "a"), corner("v2", "b"), corner("v3", "c")])
    both = queries.select("k", "poly", "x", "y", "v").join(triangles, "poly")
    return both.groupBy("k").agg(F.min(F.when(inside, C("tid"))).alias("tid"), F.min(F.when(C("v").isin(C("v1"), C("v2"), C("v3")), C("tid"))).alias("at_vertex"))


def assigned(buildings: DataFrame, blobs: DataFrame, size: float = 512.0, band: float = 32.0) -> DataFrame:
    """(b, blob): the first of blobs (blob, ring) that mostly contains each of buildings (b, ring); those in none have no row.

    The centres that count are points: each goes to the blobs whose box holds it, and there to the edges in its band of y, so
    that no ring goes through a join, however many corners it has. A building that may have all its centres outside, as one that
    holds none of them, is contained by every blob that it is near, which is one that meets a cell of the building's box.
    """
    ringed = lambda df, key: with_box(df.select(key, g.once(C("ring")).alias("ring")))
    few, first = F.size("ring") < 3, F.transform(F.slice("ring", 1, 1), lambda p: point(p["x"], p["y"]))
    held = ringed(buildings, "b").withColumn("held", g.once(F.when(few, first).otherwise(s.held_centres(C("ring")))))  # the same for all blobs
    least = F.when(few, 1).otherwise(F.size("held") - F.greatest(F.floor(F.size("ring") / 9), F.lit(1)) + 1)
    own = written(held.select(F.monotonically_increasing_id().alias("u"), "b", "held", least.cast("long").alias("least"), "x0", "y0", "x1", "y1"), "centres")
    boxed = written(ringed(blobs, "blob").withColumn("r", F.monotonically_increasing_id()), "boxed")  # numbered, since keys may be repeated
    at = own.where("least > 0").select("u", "b", "least", F.posexplode("held").alias("i", "p")).select("u", "b", "least", "i", "p.x", "p.y")
    at = points_in_boxes(at, boxed.select("blob", "r", "x0", "y0", "x1", "y1")).drop("x0", "y0", "x1", "y1").withColumn("band", cell(C("y"), band))
    walls = boxed.select("r", F.explode(g._edges(C("ring"))).alias("e")).select("r", *[C(f"e.{p}.{c}").alias(p + c) for p in "ab" for c in "xy"]).where("ay <> by")
    walls = walls.withColumn("band", F.explode(F.sequence(cell(F.least("ay", "by"), band), cell(F.greatest("ay", "by"), band))))
    crosses = ((C("ay") > C("y")) != (C("by") > C("y"))) & (C("x") < C("ax") + (C("bx") - C("ax")) * (C("y") - C("ay")) / (C("by") - C("ay")))
    inside = at.join(walls.hint("merge"), ["r", "band"]).where(crosses).groupBy("u", "b", "least", "i", "r", "blob").agg(F.count("*").alias("n")).where("n % 2 = 1")
    found = inside.groupBy("u", "b", "least", "r", "blob").agg(F.count("*").alias("n")).where("n >= least").select("b", "blob")
    if own.where("least <= 0").limit(1).count():
        found = found.union(_near(own.where("least <= 0").select("b", "x0", "y0", "x1", "y1"), boxed, size))
    return found.groupBy("b").agg(F.min("blob").alias("blob"))


def _near(boxes: DataFrame, shapes: DataFrame, size: float) -> DataFrame:
    """(b, blob): boxes (b, x0, ..) and the shapes (r, blob, ring, x0, ..) that meet one of their cells, as shape_cells has it, edge by edge."""
    own = written(with_cells(boxes, size).select("b", "cx", "cy"), "own")
    cells = with_cells(shapes.select("r", "blob", "x0", "y0", "x1", "y1"), size).join(own.select("cx", "cy").distinct(), ["cx", "cy"], "left_semi").select("r", "blob", "cx", "cy")
    corners = shapes.select("r", F.explode("ring").alias("p")).select("r", "p.x", "p.y")
    hulls = convex_hulls(corners, "r").groupBy("r").agg(F.collect_list(point(C("x"), C("y"))).alias("hull"))
    normal = shapes.select("r", F.explode(g._edges(C("ring"))).alias("e")).select("r", (C("e.a.y") - C("e.b.y")).alias("nx"), (C("e.b.x") - C("e.a.x")).alias("ny")).distinct()
    along = F.transform("hull", lambda p: p["x"] * C("nx") + p["y"] * C("ny"))
    sides = normal.join(hulls, "r").select("r", "nx", "ny", F.array_min(along).alias("low"), F.array_max(along).alias("high"))
    middle, reach = ((2 * C("cx") + 1) * C("nx") + (2 * C("cy") + 1) * C("ny")) * size / 2, (F.abs("nx") + F.abs("ny")) * size / 2
    apart = cells.join(sides, "r").where((C("low") > middle + reach) | (C("high") < middle - reach)).select("r", "cx", "cy").distinct()
    return cells.join(apart, ["r", "cx", "cy"], "left_anti").join(own, ["cx", "cy"]).select("b", "blob")


def ring_of_xy(*corners: tuple[Column, Column]) -> Column:
    return F.array(*[point(x, y) for x, y in corners])
