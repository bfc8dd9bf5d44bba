"""Geometry as Column expressions: everything stays in generated code, no UDFs.

A ring is ARRAY<STRUCT<x DOUBLE, y DOUBLE>> without a closing vertex.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Origin of the projection in degrees, and the earth's radius in metres.
ORIGIN_LAT, ORIGIN_LON, RADIUS = 43.242502, 76.948339, 6371000.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def once(v: Column) -> Column:
    """v as a column worked out once: out of a generator, so that Spark doesn't put its expression wherever the column is used."""
    return F.explode(F.array(v))


def round_half_up(v: Column, decimals: int = 2) -> Column:
    """Nearest multiple of 10**-decimals, halves towards plus infinity."""
    scale = float(10**decimals)
    return F.floor(v * scale + 0.5) / scale


def project(lon: Column, lat: Column) -> Column:
    """Metres east and north of the origin, to 0.01 m."""
    x = F.radians(lon - ORIGIN_LON) * (RADIUS * math.cos(math.radians(ORIGIN_LAT)))
    return point(round_half_up(x), round_half_up(F.radians(lat - ORIGIN_LAT) * RADIUS))


def _edges(ring: Column) -> Column:
    """Structs (a, b) of each vertex and the next, the last with the first."""
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def signed_area(ring: Column) -> Column:
    """Positive for counter-clockwise rings."""
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + cross(e)) / 2


def counter_clockwise(ring: Column) -> Column:
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def vertex_mean(ring: Column) -> Column:
    n = F.nullif(F.size(ring), F.lit(0)).cast("double")
    total = lambda c: F.aggregate(ring, F.lit(0.0), lambda s, p: s + p[c])
    return point(total("x") / n, total("y") / n)


def canonical(ring: Column) -> Column:
    """The ring begun at its vertex of least x, then least y."""
    at = F.array_position(ring, F.array_min(ring)).cast("int")
    return F.concat(F.slice(ring, at, F.size(ring)), F.slice(ring, 1, at - 1))


def is_convex(ring: Column, eps: float = 1e-7) -> Column:
    """No two turns of different sign; fewer than four vertices are convex."""
    n = F.size(ring)

    def turn(i: Column) -> Column:
        a, b, c = (F.element_at(ring, ((i + k) % n + 1).cast("int")) for k in range(3))
        return (b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"])

    turns = F.transform(F.sequence(F.lit(0), n - 1), turn)
    return (n < 4) | ~(F.exists(turns, lambda t: t > eps) & F.exists(turns, lambda t: t < -eps))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment; a segment shorter than 1e-6 is a point."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.when(length2 < 1e-12, F.lit(0.0)).otherwise(((px - ax) * dx + (py - ay) * dy) / F.nullif(length2, F.lit(0.0)))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))
    return distance(px, py, ax + t * dx, ay + t * dy)


def segment_meeting(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """Where ab and cd meet; null if they don't, or are parallel."""
    det = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
    safe = F.nullif(det, F.lit(0.0))
    t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / safe
    u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / safe
    return F.when(t.between(0, 1) & u.between(0, 1), point(ax + t * (bx - ax), ay + t * (by - ay)))


def side(px, py, ax, ay, bx, by) -> Column:
    """Positive left of a towards b."""
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def boxes_meet(a: str, b: str) -> Column:
    """Whether boxes with columns {a}x0 .. {a}y1 and {b}x0 .. {b}y1 share a point."""
    c = F.col
    return (c(f"{a}x0") <= c(f"{b}x1")) & (c(f"{b}x0") <= c(f"{a}x1")) & (c(f"{a}y0") <= c(f"{b}y1")) & (c(f"{b}y0") <= c(f"{a}y1"))


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def tile(v: Column, extent: float, tiles: int) -> Column:
    """Tile number from 0 of a coordinate in -extent..extent, held inside."""
    return F.least(F.greatest(F.floor((v + extent) / (2 * extent / tiles)), F.lit(0)), F.lit(tiles - 1)).cast("long")


def halton(i: int, base: int) -> float:
    out, f = 0.0, 1.0
    while i > 0:
        f /= base
        out += f * (i % base)
        i //= base
    return out


def project_nested(rings: Column) -> Column:
    """Rings of a polygon, ARRAY<ARRAY<STRUCT<x, y>>> in degrees, in metres; for several polygons use it in a transform."""
    return F.transform(rings, lambda r: F.transform(r, lambda p: project(p["x"], p["y"])))


def wound(rings: Column) -> Column:
    """Rings of a polygon with the first counter-clockwise and the others, holes, clockwise."""
    return F.transform(rings, lambda r, i: F.when(F.when(i == 0, signed_area(r) < 0).otherwise(signed_area(r) > 0), F.reverse(r)).otherwise(r))


def wound_line(line: Column) -> Column:
    """A closed line of four points or more counter-clockwise; any other as it is."""
    closed = (F.size(line) >= 4) & (F.get(line, F.lit(0)) == F.get(line, F.size(line) - 1))
    return F.when(closed & (signed_area(line) < 0), F.reverse(line)).otherwise(line)


def vertex_mean_of_all(rings: Column) -> Column:
    """The mean of all vertices of all rings, holes and closing ones included, to 0.01; null without vertices."""
    m = vertex_mean(F.flatten(rings))
    return F.when(F.size(F.flatten(rings)) > 0, point(round_half_up(m["x"]), round_half_up(m["y"])))
