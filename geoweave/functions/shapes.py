"""Predicates and measures of triangles, lines and rings as Column expressions.

A ring is ARRAY<STRUCT<x, y>> without a closing vertex. A null coordinate gives null; a ring without vertices holds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from geoweave.functions.geometry import _edges, point, side


def cross(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def dot(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * bx + ay * by


def unit(x: Column, y: Column) -> Column:
    """The vector of length one in the direction of (x, y); that of (0, 0) is itself."""
    n = F.sqrt(x * x + y * y)
    return point(F.when(n > 0, x / F.nullif(n, F.lit(0.0))).otherwise(x), F.when(n > 0, y / F.nullif(n, F.lit(0.0))).otherwise(y))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def clamp(v: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, v))


def remapped(v: Column, a: Column, b: Column, c: Column, d: Column, held: bool = False) -> Column:
    """v as a place between a and b, put between c and d; outside too unless held. Null where a = b."""
    t = (v - a) / F.nullif(b - a, F.lit(0.0))
    return lerp(c, d, clamp(t, F.lit(0.0), F.lit(1.0)) if held else t)


def remapped_by_powers(v: Column, a: Column, b: Column, c: Column, d: Column, held: bool = False) -> Column:
    """The same with equal steps of v making equal factors between c and d; as remapped() where one of these isn't positive."""
    t = (v - a) / F.nullif(b - a, F.lit(0.0))
    t = clamp(t, F.lit(0.0), F.lit(1.0)) if held else t
    return F.when((c > 0) & (d > 0), c * F.pow(d / F.nullif(c, F.lit(0.0)), t)).otherwise(remapped(v, a, b, c, d, held))


def triangle_area(ax, ay, bx, by, cx, cy) -> Column:
    return F.abs(side(cx, cy, ax, ay, bx, by)) / 2


def slab_area(ring: Column, heights: Column) -> Column:
    """The area of a counter-clockwise ring of level and upright edges, whose corners lie at some of the ascending heights.

    It is the sum over slabs between heights of width times height, so only differences of given coordinates are rounded.
    """
    def width(low: Column, high: Column) -> Column:
        across = lambda e: F.when((e["a"]["y"] <= low) & (e["b"]["y"] >= high), e["b"]["x"]).when((e["a"]["y"] >= high) & (e["b"]["y"] <= low), -e["b"]["x"]).otherwise(0.0)
        return F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + across(e))

    slab = lambda i: F.when(F.get(heights, i) > F.get(heights, i - 1), width(F.get(heights, i - 1), F.get(heights, i)) * (F.get(heights, i) - F.get(heights, i - 1))).otherwise(0.0)
    return F.aggregate(F.sequence(F.lit(1), F.size(heights) - 1), F.lit(0.0), lambda s, i: s + slab(i))


def line_distance(px, py, ax, ay, dx, dy) -> Column:
    """Distance of a point from the line through a in direction d, positive to its left; null without a direction."""
    return cross(dx, dy, px - ax, py - ay) / F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0))


def line_meeting(ax, ay, adx, ady, bx, by, bdx, bdy) -> Column:
    """Where two lines, each a point and a direction, meet; null if they are parallel to 1e-9."""
    det = cross(adx, ady, bdx, bdy)
    t = cross(bx - ax, by - ay, bdx, bdy) / F.nullif(det, F.lit(0.0))
    return F.when(F.abs(det) >= 1e-9, point(ax + t * adx, ay + t * ady))


def segments_meet(ax, ay, bx, by, cx, cy, dx, dy, eps: float = 1e-10) -> Column:
    """Whether ab and cd share a point; those on one line do where they overlap."""
    rx, ry, sx, sy, qx, qy = bx - ax, by - ay, dx - cx, dy - cy, cx - ax, cy - ay
    det, off, length2 = cross(rx, ry, sx, sy), cross(qx, qy, rx, ry), F.nullif(dot(rx, ry, rx, ry), F.lit(0.0))
    begin = dot(qx, qy, rx, ry) / length2
    end = begin + dot(sx, sy, rx, ry) / length2
    along = (F.greatest(begin, end) >= -eps) & (F.least(begin, end) <= 1 + eps)
    safe = F.nullif(det, F.lit(0.0))
    inside = lambda v: v.between(-eps, 1 + eps)
    return F.when(F.abs(det) < eps, F.when(F.abs(off) < eps, F.coalesce(along, F.lit(False))).otherwise(F.lit(False))).otherwise(inside(cross(qx, qy, sx, sy) / safe) & inside(off / safe))


def in_triangle(px, py, ax, ay, bx, by, cx, cy, eps: float = 1e-12) -> Column:
    """By barycentric coordinates, borders included to eps; a flat triangle holds nothing."""
    det = F.nullif(cross(bx - ax, by - ay, cx - ax, cy - ay), F.lit(0.0))
    s, t = cross(px - ax, py - ay, cx - ax, cy - ay) / det, cross(bx - ax, by - ay, px - ax, py - ay) / det
    return F.coalesce((s >= -eps) & (t >= -eps) & (s + t <= 1 + eps), F.lit(False))


def directed_side(px, py, ax, ay, a, bx, by, b) -> Column:
    """side() of the edge from a to b, always reckoned from the vertex of smaller number: both shapes at an edge get the same size."""
    return F.when(a > b, -side(px, py, bx, by, ax, ay)).otherwise(side(px, py, ax, ay, bx, by))


def in_numbered_triangle(px, py, corners: list[tuple[Column, Column, Column]]) -> Column:
    """Whether a counter-clockwise triangle of corners (x, y, vertex number) holds a point, borders included."""
    (ax, ay, a), (bx, by, b), (cx, cy, c) = corners
    return (directed_side(px, py, ax, ay, a, bx, by, b) >= 0) & (directed_side(px, py, bx, by, b, cx, cy, c) >= 0) & (directed_side(px, py, cx, cy, c, ax, ay, a) >= 0)


def in_numbered_ring(px: Column, py: Column, ring: Column) -> Column:
    """The same for a convex ring whose vertices have a number v."""
    return (F.size(ring) > 2) & F.forall(_edges(ring), lambda e: directed_side(px, py, e["a"]["x"], e["a"]["y"], e["a"]["v"], e["b"]["x"], e["b"]["y"], e["b"]["v"]) >= 0)


def in_ring(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd rule: whether a ray to greater x crosses an odd number of edges."""
    return within_edges(px, py, _edges(ring))


def within_edges(px: Column, py: Column, edges: Column) -> Column:
    """in_ring for the edges (a, b) of a ring."""
    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = a["x"] + (b["x"] - a["x"]) * (py - a["y"]) / F.nullif(b["y"] - a["y"], F.lit(0.0))
        return ((a["y"] > py) != (b["y"] > py)) & (px < at)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def winding_number(px: Column, py: Column, ring: Column) -> Column:
    """How often the ring goes around a point, counter-clockwise turns counted as positive."""
    def turn(e: Column) -> Column:
        a, b = e["a"], e["b"]
        left = side(px, py, a["x"], a["y"], b["x"], b["y"])
        return F.when((a["y"] <= py) & (b["y"] > py) & (left > 0), 1).when((a["y"] > py) & (b["y"] <= py) & (left < 0), -1).otherwise(0)

    return F.aggregate(_edges(ring), F.lit(0), lambda s, e: s + turn(e))


def ring_meets_box(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether no axis, and no normal of an edge, separates a ring from a box; touching is meeting. Exact for convex rings."""
    least = lambda f: F.array_min(F.transform(ring, f))
    most = lambda f: F.array_max(F.transform(ring, f))
    near = (least(lambda p: p["x"]) <= x1) & (most(lambda p: p["x"]) >= x0) & (least(lambda p: p["y"]) <= y1) & (most(lambda p: p["y"]) >= y0)

    def together(e: Column) -> Column:
        nx, ny = e["a"]["y"] - e["b"]["y"], e["b"]["x"] - e["a"]["x"]
        middle = ((x0 + x1) * nx + (y0 + y1) * ny) / 2
        reach = (F.abs(nx) * (x1 - x0) + F.abs(ny) * (y1 - y0)) / 2
        along = lambda p: p["x"] * nx + p["y"] * ny
        return (least(along) <= middle + reach) & (most(along) >= middle - reach)

    return F.coalesce(near & F.forall(_edges(ring), together), F.lit(False))


def border_meets_box(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column, margin: float = 1e-6) -> Column:
    """Whether an edge of a ring comes into a box or within margin of it; if none does, the box is all inside or all outside."""
    def comes(e: Column) -> Column:
        a, b = e["a"], e["b"]
        near = (F.least(a["x"], b["x"]) <= x1 + margin) & (F.greatest(a["x"], b["x"]) >= x0 - margin) & (F.least(a["y"], b["y"]) <= y1 + margin) & (F.greatest(a["y"], b["y"]) >= y0 - margin)
        nx, ny = a["y"] - b["y"], b["x"] - a["x"]
        reach = (F.abs(nx) * (x1 - x0 + 2 * margin) + F.abs(ny) * (y1 - y0 + 2 * margin)) / 2
        return near & (F.abs(((x0 + x1) / 2 - a["x"]) * nx + ((y0 + y1) / 2 - a["y"]) * ny) <= reach)

    return F.exists(_edges(ring), comes)


def miter(ax, ay, bx, by, cx, cy, offset: float) -> Column:
    """Corner b moved by offset along the sum of the directions a to b and c to b; null where they cancel."""
    u, w = unit(bx - ax, by - ay), unit(bx - cx, by - cy)
    mx, my = u["x"] + w["x"], u["y"] + w["y"]
    d = unit(mx, my)
    return F.when(mx * mx + my * my > 1e-6, point(bx + d["x"] * offset, by + d["y"] * offset))


def trio_centres(ring: Column) -> Column:
    """Centres of each three vertices in a row, around the ring; none for fewer than three."""
    n = F.size(ring)

    def centre(i: Column) -> Column:
        p, q, r = (F.element_at(ring, ((i + k) % n + 1).cast("int")) for k in range(3))
        return point((p["x"] + q["x"] + r["x"]) / 3, (p["y"] + q["y"] + r["y"]) / 3)

    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 1), centre)).otherwise(F.array().cast("array<struct<x:double,y:double>>"))


def held_centres(ring: Column) -> Column:
    """The trio centres of ring that ring itself holds."""
    return F.filter(trio_centres(ring), lambda c: in_ring(c["x"], c["y"], ring))


def mostly_inside(ring: Column, other: Column) -> Column:
    """Whether other holds the trio centres of ring that ring itself holds, but for fewer than a ninth of its vertices.

    With fewer than 18 vertices one centre outside is too many; with fewer than three the first vertex decides.
    """
    return centres_inside(ring, held_centres(ring), _edges(other))


def centres_inside(ring: Column, held: Column, edges: Column) -> Column:
    """mostly_inside for the held_centres of ring and the edges of the other."""
    outside = F.size(F.filter(held, lambda c: ~within_edges(c["x"], c["y"], edges)))
    allowed = F.greatest(F.floor(F.size(ring) / 9), F.lit(1))
    first = F.get(ring, F.lit(0))
    return F.when(F.size(ring) < 3, F.coalesce(within_edges(first["x"], first["y"], edges), F.lit(False))).otherwise(outside < allowed)


def line_side(px: Column, py: Column, line: list[tuple[float, float]]) -> Column:
    """0 or 1: the side of a polyline, its ends drawn on, by the crossings of a ray. The ray's direction is the one of eight
    that is least along any part of the line, end parts counted half."""
    far = 1e9
    parts = list(zip(line[:-1], line[1:]))

    def along(d: tuple[float, float]) -> float:
        worst = 0.0
        for i, ((x0, y0), (x1, y1)) in enumerate(parts):
            n = ((x1 - x0) ** 2 + (y1 - y0) ** 2) ** 0.5 or 1.0
            worst = max(worst, abs(d[0] * (x1 - x0) + d[1] * (y1 - y0)) / n / (2 if i in (0, len(parts) - 1) else 1))
        return worst

    # The directions and their order, which decides between equals.
    dx, dy = min([(1, 0), (-1, 0), (0, 1), (0, -1), (0.707, 0.707), (-0.707, 0.707), (0.707, -0.707), (-0.707, -0.707)], key=along)
    (hx, hy), (ix, iy), (jx, jy), (kx, ky) = line[0], line[1], line[-2], line[-1]
    drawn = [((hx - (ix - hx) * far, hy - (iy - hy) * far), line[0]), *parts, (line[-1], (kx + (kx - jx) * far, ky + (ky - jy) * far))]
    count = F.lit(0)
    for (ax, ay), (bx, by) in drawn:
        det = (by - ay) * dx - (bx - ax) * dy
        if det:
            t, u = ((bx - ax) * (py - ay) - (by - ay) * (px - ax)) / (det * far), (dx * (py - ay) - dy * (px - ax)) / det
            count = count + F.when(t.between(0, 1) & u.between(0, 1), 1).otherwise(0)
    return count % 2
