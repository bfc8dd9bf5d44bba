"""Queries over a mesh of triangles that are no boxes, its quadrilaterals and blobs, and L-shaped buildings.

The mesh is derived from the grid of cells that hold a point: vertex v has the place (v % 128, v // 128), moved by up to
199 m, so neighbouring shapes share slanted edges. All coordinates are whole or of two decimals.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from geoweave.functions import geometry as g, shapes as s
from geoweave.operators import locate
from geoweave.plans.queries import _B, _P, _T, _triangles, query
from geoweave.sources.driver_tables import boxes, city, points

C = F.col


def _place(v):
    """The coordinates of vertices."""
    return ((v % 128 - 64) * 512 + (v * 7919) % 200).cast("double"), ((F.floor(v / 128) - 64) * 512 + (v * 104729) % 200).cast("double")


def _sx(v: str) -> str:
    return f"(({v} % 128 - 64) * 512 + ({v} * 7919) % 200)::DOUBLE"


def _sy(v: str) -> str:
    return f"(({v} // 128 - 64) * 512 + ({v} * 104729) % 200)::DOUBLE"


def mesh(spark, d):
    """(tid, v1, v2, v3, ax, ay, bx, by, cx, cy), counter-clockwise."""
    t = _triangles(spark, d)
    for c, v in (("a", "v1"), ("b", "v2"), ("c", "v3")):
        x, y = _place(C(v))
        t = t.withColumns({f"{c}x": x, f"{c}y": y})
    return t


def quads(spark, d):
    """(poly, ring): the quadrilateral of each cell, two triangles, with vertex numbers."""
    corner = lambda v: F.struct(_place(v)[0].alias("x"), _place(v)[1].alias("y"), v.alias("v"))
    return city(spark, d).select(C("v").alias("poly"), F.array(*[corner(C("v") + i) for i in (0, 1, 129, 128)]).alias("ring"))


def ells(spark, d):
    """(b, ring): an L of each box, without its upper right quarter."""
    mx, my = (C("x0") + C("x1")) / 2, (C("y0") + C("y1")) / 2
    ring = locate.ring_of_xy((C("x0"), C("y0")), (C("x1"), C("y0")), (C("x1"), my), (mx, my), (mx, C("y1")), (C("x0"), C("y1")))
    return boxes(spark, d).select("b", g.once(ring).alias("ring"))


_M = _T + ", ms AS (SELECT tid, v1, v2, v3, " + ", ".join(f"{f(v)} AS {c}" for f, v, c in ((_sx, "v1", "ax"), (_sy, "v1", "ay"), (_sx, "v2", "bx"), (_sy, "v2", "by_"), (_sx, "v3", "cx"), (_sy, "v3", "cy"))) + " FROM tr)"
_SIDE = "CASE WHEN {i} < {j} THEN ({bx} - {ax}) * (y - {ay}) - ({by} - {ay}) * (x - {ax}) ELSE -(({ax} - {bx}) * (y - {by}) - ({ay} - {by}) * (x - {bx})) END >= 0"
_IN = " AND ".join(_SIDE.format(i=i, j=j, ax=ax, ay=ay, bx=bx, by=by) for (i, ax, ay), (j, bx, by) in ((("v1", "ax", "ay"), ("v2", "bx", "by_")), (("v2", "bx", "by_"), ("v3", "cx", "cy")), (("v3", "cx", "cy"), ("v1", "ax", "ay"))))
_HIT = f"{_M}, hit AS (SELECT k, tid FROM pts JOIN ms ON x BETWEEN least(ax, bx, cx) AND greatest(ax, bx, cx) AND y BETWEEN least(ay, by_, cy) AND greatest(ay, by_, cy) WHERE {_IN})"


@query(f"WITH {_HIT} SELECT k, min(tid) AS tid FROM hit GROUP BY k")
def mesh_point_triangle(spark, d):
    """Each point's triangle, with sides reckoned from the vertex of smaller number; the least at shared edges."""
    return locate.triangle_hits(points(spark, d).select("k", "x", "y"), mesh(spark, d)).groupBy("k").agg(F.min("tid").alias("tid"))


@query(f"WITH {_HIT}, n AS (SELECT pts.k, count(tid) AS n FROM pts LEFT JOIN hit ON pts.k = hit.k GROUP BY pts.k) SELECT count(*) FILTER (n = 0) AS zero_matches, count(*) FILTER (n > 1) AS multi_matches, count(*) AS n_points FROM n")
def mesh_location_qa(spark, d):
    """How many points are in no triangle and in several."""
    p = points(spark, d).select("k", "x", "y")
    return locate.counted(p, locate.triangle_hits(p, mesh(spark, d)))


_Q = f"{_P}, qd AS (SELECT v AS poly, list_transform([0, 1, 129, 128], lambda i: v + i) AS vs FROM city), qe AS (SELECT poly, unnest([[vs[1], vs[2]], [vs[2], vs[3]], [vs[3], vs[4]], [vs[4], vs[1]]]) AS e FROM qd)"


@query(
    f"WITH {_T}, {_Q.removeprefix(_P + ', ')}, qf AS (SELECT poly, e[1] AS i, e[2] AS j, {_sx('e[1]')} AS ax, {_sy('e[1]')} AS ay, {_sx('e[2]')} AS bx, {_sy('e[2]')} AS by_ FROM qe), "
    "qb AS (SELECT poly, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM qf GROUP BY poly), qc AS (SELECT k, x, y, poly FROM pts JOIN qb ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1), "
    f"qg AS (SELECT k, qc.poly, bool_and({_SIDE.format(i='i', j='j', ax='ax', ay='ay', bx='bx', by='by_')}) AS inside FROM qc JOIN qf ON qc.poly = qf.poly GROUP BY ALL) SELECT k, min(poly) AS poly FROM qg WHERE inside GROUP BY k"
)
def mesh_point_polygon(spark, d):
    """Each point's quadrilateral, by its own edges."""
    return locate.first_hit(points(spark, d), quads(spark, d), "poly")


@query(f"WITH {_HIT} SELECT k, min(tid // 2 // 512) AS blob FROM hit GROUP BY k")
def mesh_point_blob(spark, d):
    """Each point's blob (four rows of cells), by its triangles."""
    found = locate.triangle_hits(points(spark, d).select("k", "x", "y"), mesh(spark, d))
    return found.groupBy("k").agg(F.min(F.floor(C("tid") / 2 / 512)).alias("blob"))


_ELL = [("x0", "y0"), ("x1", "y0"), ("x1", "(y0 + y1) / 2"), ("(x0 + x1) / 2", "(y0 + y1) / 2"), ("(x0 + x1) / 2", "y1"), ("x0", "y1")]
_L = (
    f"{_P}, {_B}, le AS (SELECT b, unnest([" + ", ".join(f"{{'ax': {p[0]}, 'ay': {p[1]}, 'bx': {q[0]}, 'by_': {q[1]}}}" for p, q in zip(_ELL, _ELL[1:] + _ELL[:1])) + "], recursive := true) FROM boxes), "
    "lh AS (SELECT k, le.b, count(*) FILTER ((ay > y) <> (by_ > y) AND x < ax + (bx - ax) * (y - ay) / nullif(by_ - ay, 0)) % 2 = 1 AS inside, "
    "sum(CASE WHEN ay <= y AND by_ > y AND (bx - ax) * (y - ay) - (by_ - ay) * (x - ax) > 0 THEN 1 WHEN ay > y AND by_ <= y AND (bx - ax) * (y - ay) - (by_ - ay) * (x - ax) < 0 THEN -1 ELSE 0 END) AS turns "
    "FROM pts JOIN boxes ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 JOIN le ON le.b = boxes.b GROUP BY ALL)"
)


@query(f"WITH {_L} SELECT k, min(b) AS b FROM lh WHERE inside GROUP BY k")
def building_click(spark, d):
    """The first L-shaped building that holds each point, by the even-odd rule."""
    return locate.first_hit(points(spark, d), ells(spark, d), "b", locate.even_odd, 128.0)


@query(f"WITH {_L} SELECT k, b, CAST(turns AS INT) AS turns FROM lh WHERE turns <> 0")
def winding_hits(spark, d):
    """Points and the buildings that go around them, with the winding number."""
    return locate.windings(points(spark, d), ells(spark, d), "b")


def _apart(corners: list[tuple[str, str]]) -> str:
    """Whether a normal of an edge keeps corners away from the cell (mx, my, 128): projections of corners against those of the cell's."""
    cell = [(f"mx {i} 128", f"my {j} 128") for i in "+-" for j in "+-"]
    tests = []
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1]):
        on = lambda x, y: f"(({x}) * ({ay} - {by}) + ({y}) * ({bx} - {ax}))"  # noqa: B023, E731
        own, other = ", ".join(on(*p) for p in corners), ", ".join(on(*p) for p in cell)
        tests.append(f"greatest({own}) < least({other}) OR greatest({other}) < least({own})")
    return " OR ".join(tests)


@query(
    f"WITH {_M}, mc AS (SELECT *, unnest(range(floor(least(ax, bx, cx) / 256)::BIGINT, floor(greatest(ax, bx, cx) / 256)::BIGINT + 1)) AS gx FROM ms), md AS (SELECT *, unnest(range(floor(least(ay, by_, cy) / 256)::BIGINT, floor(greatest(ay, by_, cy) / 256)::BIGINT + 1)) AS gy FROM mc), "
    f"mk AS (SELECT *, gx * 256 + 128 AS mx, gy * 256 + 128 AS my FROM md) SELECT tid, gx AS cx, gy AS cy FROM mk WHERE NOT ({_apart([('ax', 'ay'), ('bx', 'by_'), ('cx', 'cy')])})"
)
def mesh_cells(spark, d):
    """The cells of 256 m that each triangle really meets."""
    return locate.shape_cells(locate.triangle_rings(mesh(spark, d)), 256.0).select("tid", "cx", "cy")


@query(
    f"WITH {_T}, qv AS (SELECT v AS poly, " + ", ".join(f"{f(f'(v + {i})')} AS {c}{n}" for n, i in enumerate((0, 1, 129, 128)) for f, c in ((_sx, "x"), (_sy, "y"))) + " FROM city), "
    "qx AS (SELECT *, unnest(range(floor(least(x0, x1, x2, x3) / 256)::BIGINT, floor(greatest(x0, x1, x2, x3) / 256)::BIGINT + 1)) AS gx FROM qv), qy AS (SELECT *, unnest(range(floor(least(y0, y1, y2, y3) / 256)::BIGINT, floor(greatest(y0, y1, y2, y3) / 256)::BIGINT + 1)) AS gy FROM qx), "
    f"qk AS (SELECT *, gx * 256 + 128 AS mx, gy * 256 + 128 AS my FROM qy) SELECT poly, gx AS cx, gy AS cy FROM qk WHERE NOT ({_apart([(f'x{i}', f'y{i}') for i in range(4)])})"
)
def polygon_cells(spark, d):
    """The cells of 256 m that each quadrilateral really meets."""
    return locate.shape_cells(quads(spark, d), 256.0).select("poly", "cx", "cy")


@query(
    f"WITH {_M}, vq AS (SELECT k, x, y, ((floor(y / 512)::BIGINT + 64) * 128 + floor(x / 512)::BIGINT + 64) AS v, floor(x / 256)::BIGINT * 256 + 128 AS mx, floor(y / 256)::BIGINT * 256 + 128 AS my FROM pts) "
    f"SELECT k, min(tid) AS tid FROM vq JOIN ms ON v IN (v1, v2, v3) AND least(ax, bx, cx) <= mx + 128 AND greatest(ax, bx, cx) >= mx - 128 AND least(ay, by_, cy) <= my + 128 AND greatest(ay, by_, cy) >= my - 128 "
    f"AND floor(least(ax, bx, cx) / 256) * 256 <= mx AND floor(greatest(ax, bx, cx) / 256) * 256 >= mx - 128 AND floor(least(ay, by_, cy) / 256) * 256 <= my AND floor(greatest(ay, by_, cy) / 256) * 256 >= my - 128 AND NOT ({_apart([('ax', 'ay'), ('bx', 'by_'), ('cx', 'cy')])}) GROUP BY k"
)
def triangle_at_vertex(spark, d):
    """For each point and the lower left vertex of its cell, the first triangle with that vertex near the point."""
    v = (F.floor(C("y") / 512) + 64) * 128 + F.floor(C("x") / 512) + 64
    return locate.near_vertex(points(spark, d).withColumn("v", v), mesh(spark, d))


@query(f"WITH {_M} SELECT tid, abs((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) / 2 AS area FROM ms ORDER BY area DESC, tid LIMIT 50")
def largest_triangles(spark, d):
    """The fifty largest triangles, ties by number."""
    area = s.triangle_area(*[C(c) for c in ("ax", "ay", "bx", "by", "cx", "cy")])
    return mesh(spark, d).select("tid", area.alias("area")).orderBy(F.desc("area"), "tid").limit(50)


@query(
    f"WITH {_HIT}, kp AS (SELECT k, min(tid // 2) AS poly, any_value((floor(y / 512)::BIGINT + 64) * 128 + floor(x / 512)::BIGINT + 64) AS v FROM hit JOIN pts USING (k) GROUP BY k) "
    "SELECT kp.k, kp.poly, (SELECT min(tid) FROM hit WHERE hit.k = kp.k AND tid // 2 = kp.poly) AS tid, (SELECT min(tid) FROM ms WHERE tid // 2 = kp.poly AND (v1 = kp.v OR v2 = kp.v OR v3 = kp.v)) AS at_vertex FROM kp"
)
def triangle_in_polygon(spark, d):
    """For each point whose quadrilateral is known, the triangle of it that holds the point, and the first at a vertex."""
    p = points(spark, d).select("k", "x", "y")
    t = mesh(spark, d).withColumn("poly", F.floor(C("tid") / 2).cast("long"))
    v = (F.floor(C("y") / 512) + 64) * 128 + F.floor(C("x") / 512) + 64
    poly = locate.triangle_hits(p, t).groupBy("k").agg(F.min(F.floor(C("tid") / 2).cast("long")).alias("poly"))
    known = p.join(poly, "k").withColumn("v", v)
    return locate.in_known_polygon(known, t).join(poly, "k").select("k", "poly", "tid", "at_vertex")


@query(f"WITH {_M}, ar AS (SELECT tid, abs((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) / 2 AS area FROM ms), po AS (SELECT tid // 2 AS poly, sum(area) AS area FROM ar GROUP BY 1) SELECT (SELECT sum(area) / count(*) FROM ar) AS triangle_area, (SELECT sum(area) / count(*) FROM po) AS polygon_area")
def mean_areas(spark, d):
    """Mean area of triangles and of polygons; areas are halves of whole numbers, so sums are exact."""
    area = s.triangle_area(*[C(c) for c in ("ax", "ay", "bx", "by", "cx", "cy")])
    poly = mesh(spark, d).select(F.floor(C("tid") / 2).alias("poly"), area.alias("area")).groupBy("poly").agg(F.sum("area").alias("area"), F.count("*").alias("n"))
    return poly.agg((F.sum("area") / F.sum("n")).alias("triangle_area"), (F.sum("area") / F.count("*")).alias("polygon_area"))


@query(f"WITH {_M}, pm AS (SELECT k, x, y, (k % 3200)::BIGINT AS r FROM pts), nm AS (SELECT *, row_number() OVER (ORDER BY tid) - 1 AS r FROM ms), w AS (SELECT k, x, y, ax, ay, bx, by_, cx, cy, (bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax) AS det FROM pts, ms WHERE tid = 2 * ((floor(y / 512)::BIGINT + 64) * 128 + floor(x / 512)::BIGINT + 64)) "
       "SELECT k, ((x - ax) * (cy - ay) - (y - ay) * (cx - ax)) / det >= -1e-12 AND ((bx - ax) * (y - ay) - (by_ - ay) * (x - ax)) / det >= -1e-12 AND ((x - ax) * (cy - ay) - (y - ay) * (cx - ax)) / det + ((bx - ax) * (y - ay) - (by_ - ay) * (x - ax)) / det <= 1 + 1e-12 AS inside, "
       "floor(((bx - ax) * (y - ay) - (by_ - ay) * (x - ax)) / sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)) * 100 + 0.5)::BIGINT AS d_cm FROM w")
def barycentric(spark, d):
    """Whether the first triangle of its cell holds a point, and the point's signed distance from the line of its first edge."""
    tid = 2 * ((F.floor(C("y") / 512) + 64) * 128 + F.floor(C("x") / 512) + 64)
    p = points(spark, d).withColumn("tid", tid).join(mesh(spark, d), "tid")
    x, y, ax, ay, bx, by, cx, cy = (C(c) for c in ("x", "y", "ax", "ay", "bx", "by", "cx", "cy"))
    return p.select("k", s.in_triangle(x, y, ax, ay, bx, by, cx, cy).alias("inside"), F.floor(s.line_distance(x, y, ax, ay, bx - ax, by - ay) * 100 + 0.5).alias("d_cm"))


@query(
    f"WITH {_M}, lm AS (SELECT tid, ax, ay, bx - ax AS ux, by_ - ay AS uy, -(cy - by_) AS wx, cx - bx AS wy, cx AS ox, cy AS oy FROM ms), lt AS (SELECT *, ux * wy - uy * wx AS det FROM lm) "
    "SELECT tid, CASE WHEN abs(det) >= 1e-9 THEN floor((ax + ((ox - ax) * wy - (oy - ay) * wx) / det * ux) * 10 + 0.5)::BIGINT END AS x_dm, CASE WHEN abs(det) >= 1e-9 THEN floor((ay + ((ox - ax) * wy - (oy - ay) * wx) / det * uy) * 10 + 0.5)::BIGINT END AS y_dm FROM lt"
)
def line_meetings(spark, d):
    """Where the line of each triangle's first edge meets the normal of its second edge through the third corner."""
    ax, ay, bx, by, cx, cy = (C(c) for c in ("ax", "ay", "bx", "by", "cx", "cy"))
    m = s.line_meeting(ax, ay, bx - ax, by - ay, cx, cy, -(cy - by), cx - bx)
    return mesh(spark, d).select("tid", m.alias("m")).select("tid", F.floor(C("m.x") * 10 + 0.5).alias("x_dm"), F.floor(C("m.y") * 10 + 0.5).alias("y_dm"))


@query(
    f"WITH {_M}, a AS (SELECT tid // 2 AS poly, ax, ay, cx, cy FROM ms WHERE tid % 2 = 0) SELECT p.poly AS a, q.poly AS b, CASE WHEN q.poly = p.poly + 1 THEN p.cx = q.ax AND p.cy = q.ay OR (sign((p.cx - p.ax) * (q.ay - p.ay) - (p.cy - p.ay) * (q.ax - p.ax)) * sign((p.cx - p.ax) * (q.cy - p.ay) - (p.cy - p.ay) * (q.cx - p.ax)) <= 0 "
    "AND sign((q.cx - q.ax) * (p.ay - q.ay) - (q.cy - q.ay) * (p.ax - q.ax)) * sign((q.cx - q.ax) * (p.cy - q.ay) - (q.cy - q.ay) * (p.cx - q.ax)) <= 0) ELSE p.cx = q.ax AND p.cy = q.ay END AS meet FROM a p JOIN a q ON q.poly IN (p.poly + 1, p.poly + 129)"
)
def diagonals_meet(spark, d):
    """Whether the diagonals of neighbouring cells share a point: those in a row by their places, those along a diagonal at a vertex."""
    a = mesh(spark, d).where("tid % 2 = 0").select(F.floor(C("tid") / 2).alias("a"), "ax", "ay", "cx", "cy")
    q = a.select(C("a").alias("b"), *[C(c).alias(f"q{c}") for c in ("ax", "ay", "cx", "cy")])
    both = a.withColumn("b", F.explode(F.array(C("a") + 1, C("a") + 129))).join(q, "b")
    return both.select("a", "b", s.segments_meet(*[C(c) for c in ("ax", "ay", "cx", "cy", "qax", "qay", "qcx", "qcy")]).alias("meet"))


@query(
    f"WITH {_B} SELECT b, x0 AS outer_x, CASE WHEN x1 > x0 THEN y0 END AS outer_y2, floor((3 * x0 + 2 * x1 + 3 * (x0 + (x1 - x0) / 4) + 2 * (x1 - (x1 - x0) / 4)) / 10 * 100 + 0.5)::BIGINT AS mean_x_cm, x0 + (x1 - x0) / 4 AS hole_x, y1 - (x1 - x0) / 4 AS hole_y2 FROM boxes"
)
def polygons_with_holes(spark, d):
    """Closed rings wound the right way, the outer one and a hole, and the mean of all their vertices."""
    b = boxes(spark, d)
    q = (C("x1") - C("x0")) / 4

    def ring(m, turned):
        at = [(C("x0") + m, C("y0") + m), (C("x1") - m, C("y0") + m), (C("x1") - m, C("y1") - m), (C("x0") + m, C("y1") - m)]
        at = [at[0], *at[:0:-1]] if turned else at
        return locate.ring_of_xy(*at, at[0])

    given = F.when(C("b") % 2 == 0, F.array(ring(F.lit(0.0), True), ring(q, False))).otherwise(F.array(ring(F.lit(0.0), False), ring(q, True)))
    r = b.select("b", "x0", "x1", given.alias("given")).select("b", "x0", "x1", "given", g.wound(C("given")).alias("r"))
    second = lambda i: C("r")[i][1]["y"]
    return r.select(
        "b", C("r")[0][0]["x"].alias("outer_x"), F.when(C("x1") > C("x0"), second(0)).alias("outer_y2"), F.floor(g.vertex_mean_of_all(C("r"))["x"] * 100 + 0.5).alias("mean_x_cm"),
        C("r")[1][0]["x"].alias("hole_x"), second(1).alias("hole_y2"),
    )


@query(
    "SELECT p_partkey AS b, floor(radians((p_partkey % 2001 - 1000) / 20000.0::DOUBLE + 76.948339 - 76.948339) * (6371000.0::DOUBLE * cos(radians(43.242502::DOUBLE))) * 100 + 0.5)::BIGINT AS x_cm, floor(radians((p_partkey % 1999 - 1000) / 20000.0::DOUBLE + 43.242502 - 43.242502) * 6371000.0::DOUBLE * 100 + 0.5)::BIGINT AS y_cm, 2::INT AS n_rings FROM part WHERE p_partkey % 7 > 0"
)
def nested_projection(spark, d):
    """The second corner of the second ring of polygons in degrees, in metres."""
    from geoweave.sources.driver_tables import table

    p = table(spark, d, "part").where("p_partkey % 7 > 0")
    lon, lat = F.lit(g.ORIGIN_LON), F.lit(g.ORIGIN_LAT)
    at = (C("p_partkey") % 2001 - 1000) / F.lit(20000.0) + lon, (C("p_partkey") % 1999 - 1000) / F.lit(20000.0) + lat
    rings = F.array(locate.ring_of_xy((lon, lat)), locate.ring_of_xy((lon, lat), at))
    m = p.select("p_partkey", g.project_nested(rings).alias("r"))
    return m.select(C("p_partkey").alias("b"), F.floor(C("r")[1][1]["x"] * 100 + 0.5).alias("x_cm"), F.floor(C("r")[1][1]["y"] * 100 + 0.5).alias("y_cm"), F.size("r").alias("n_rings"))
