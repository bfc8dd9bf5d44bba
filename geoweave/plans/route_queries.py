"""Queries over adjacency: portals, inspection of polygons, routes with their paths, rays, containment and near-doubles."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoweave.functions import geometry as g, shapes as s
from geoweave.operators import dedup, graph, locate, mesh, polygons, routes
from geoweave.plans.mesh_queries import _L, _M, _sx, _sy, ells, mesh as triangles, quads
from geoweave.plans.queries import _B, _P, _T, _V, _edges, _suppliers, _S, query
from geoweave.shared import written
from geoweave.sources.driver_tables import boxes, city, points

C = F.col
_E = "pe AS (SELECT v AS poly, unnest([{'i': 0, 'v1': v, 'v2': v + 1}, {'i': 1, 'v1': v + 1, 'v2': v + 129}, {'i': 2, 'v1': v + 129, 'v2': v + 128}, {'i': 3, 'v1': v + 128, 'v2': v}], recursive := true) FROM city)"
_PE = f"{_P}, {_V}, {_E}, pn AS (SELECT e.poly, e.i, e.v1, e.v2, o.poly AS neighbour FROM pe e JOIN pe o ON least(e.v1, e.v2) = least(o.v1, o.v2) AND greatest(e.v1, e.v2) = greatest(o.v1, o.v2) AND e.poly <> o.poly)"


@query(
    f"WITH {_PE}, ce AS (SELECT poly, avg({_sx('v1')}) AS mx, avg({_sy('v1')}) AS my FROM pe GROUP BY poly), "
    f"tu AS (SELECT pn.poly, neighbour, v1, v2, (b.mx - a.mx) * ({_sy('v2')} - {_sy('v1')}) - (b.my - a.my) * ({_sx('v2')} - {_sx('v1')}) > 0 AS flip FROM pn JOIN ce a ON a.poly = pn.poly JOIN ce b ON b.poly = pn.neighbour) "
    "SELECT poly, neighbour, CASE WHEN flip THEN v2 ELSE v1 END AS left_v, CASE WHEN flip THEN v1 ELSE v2 END AS right_v FROM tu"
)
def polygon_portals(spark, d):
    """The edge to each neighbouring quadrilateral, its left and right vertex on the way there."""
    return routes.portals(quads(spark, d)).select("poly", "neighbour", "left_v", "right_v")


@query(f"WITH {_PE} SELECT c.v AS poly, count(DISTINCT neighbour) AS neighbours, array_to_string(list_sort(list(DISTINCT neighbour)), ',') AS which, c.v % 128 < 70 AS walkable FROM city c LEFT JOIN pn ON pn.poly = c.v GROUP BY c.v")
def polygon_inspection(spark, d):
    """Each polygon's neighbours, and whether all its triangles are walkable."""
    n = routes.polygon_edges(quads(spark, d)).groupBy("poly").agg(F.array_sort(F.collect_set("neighbour")).alias("n"))
    t = triangles(spark, d).select(F.floor(C("tid") / 2).alias("poly"), (F.floor(C("tid") / 2) % 128 < 70).alias("walkable")).groupBy("poly").agg(F.every("walkable").alias("walkable"))
    return n.join(t, "poly").select("poly", F.size("n").cast("long").alias("neighbours"), F.nullif(F.array_join("n", ","), F.lit("")).alias("which"), "walkable")


def _tree(spark, d):
    e = written(_edges(spark, d).withColumn("cost", (1 + F.pmod(C("a") * 31 + C("b") * 17, F.lit(7))).cast("double")), "edges")
    return written(graph.route_costs(city(spark, d).agg(F.min("v").alias("v")), e), "tree")


@query()
def route_paths(spark, d):
    """The nodes of the cheapest route from the first cell to every fifth cell; the tests hold it against a plain version."""
    return routes.paths(_tree(spark, d), city(spark, d).where("v % 5 = 0").select(C("v").alias("goal")))


_R = (
    f"{_M}, {_S}, ry AS (SELECT q AS r, x AS sx0, y AS sy0, x + ((q * 37) % 4001 - 2000) AS ex0, y + ((q * 91) % 4001 - 2000) AS ey0 FROM sup), "
    "me AS (SELECT tid, unnest([{'e': 0, 'lo': least(v1, v2), 'hi': greatest(v1, v2), 'px': ax, 'py': ay, 'qx': bx, 'qy': by_}, {'e': 1, 'lo': least(v2, v3), 'hi': greatest(v2, v3), 'px': bx, 'py': by_, 'qx': cx, 'qy': cy}, {'e': 2, 'lo': least(v3, v1), 'hi': greatest(v3, v1), 'px': cx, 'py': cy, 'qx': ax, 'qy': ay}], recursive := true) FROM ms), "
    "mn AS (SELECT *, count(*) OVER (PARTITION BY lo, hi) < 2 AS wall FROM me), "
    "mt AS (SELECT r, tid, e, wall, ((px - sx0) * (qy - py) - (py - sy0) * (qx - px)) / nullif((ex0 - sx0) * (qy - py) - (ey0 - sy0) * (qx - px), 0) AS t, ((px - sx0) * (ey0 - sy0) - (py - sy0) * (ex0 - sx0)) / nullif((ex0 - sx0) * (qy - py) - (ey0 - sy0) * (qx - px), 0) AS u FROM ry JOIN mn ON least(px, qx) <= greatest(sx0, ex0) AND greatest(px, qx) >= least(sx0, ex0) AND least(py, qy) <= greatest(sy0, ey0) AND greatest(py, qy) >= least(sy0, ey0)), "
    "mx AS (SELECT * FROM mt WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1), "
    "st AS (SELECT r, min(tid) AS first FROM ry JOIN ms ON sx0 BETWEEN least(ax, bx, cx) AND greatest(ax, bx, cx) AND sy0 BETWEEN least(ay, by_, cy) AND greatest(ay, by_, cy) "
    "WHERE (bx - ax) * (sy0 - ay) - (by_ - ay) * (sx0 - ax) >= 0 AND (cx - bx) * (sy0 - by_) - (cy - by_) * (sx0 - bx) >= 0 AND (ax - cx) * (sy0 - cy) - (ay - cy) * (sx0 - cx) >= 0 GROUP BY r), "
    "wl AS (SELECT st.r, min(t) AS t FROM st LEFT JOIN mx ON mx.r = st.r AND wall GROUP BY st.r)"
)


def _rays(spark, d):
    q = C("q")
    far = lambda c, m: C(c) + (q * m) % 4001 - 2000
    return _suppliers(spark, d).select(q.alias("r"), C("x").alias("ax"), C("y").alias("ay"), far("x", 37).alias("bx"), far("y", 91).alias("by"))


@query(f"WITH {_R} SELECT r, floor(t * 1000000 + 0.5)::BIGINT AS t_ppm FROM wl")
def ray_walls(spark, d):
    """How far along each ray the mesh ends, in millionths; null for rays that reach their end."""
    t = written(triangles(spark, d), "mesh")
    walls, _ = routes.ray_walks(_rays(spark, d), t, mesh.triangle_neighbours(t))
    return walls.select("r", F.floor(C("t") * 1000000 + 0.5).alias("t_ppm"))


@query(
    f"WITH {_R}, th AS (SELECT mx.r, tid, min(t) AS t, max(t) AS o, count(*) AS n FROM mx JOIN st ON st.r = mx.r AND tid <> first GROUP BY ALL), al AS (SELECT r, tid, t FROM th WHERE n = 1 OR t < o UNION ALL SELECT r, first, 0 FROM st) "
    "SELECT al.r, count(*) AS n, sum(tid)::BIGINT AS checksum FROM al JOIN wl ON wl.r = al.r WHERE wl.t IS NULL OR al.t < wl.t GROUP BY al.r"
)
def ray_corridors(spark, d):
    """How many triangles each ray passes before a wall, and the sum of their numbers."""
    t = written(triangles(spark, d), "mesh")
    _, corridors = routes.ray_walks(_rays(spark, d), t, mesh.triangle_neighbours(t))
    return corridors.groupBy("r").agg(F.count("*").alias("n"), F.sum("tid").alias("checksum"))


_Z = _L[: _L.index("lh AS (")] + (
    f"{_V}, lv AS (SELECT b, 0 AS o, x0 AS x, y0 AS y FROM boxes UNION ALL SELECT b, 1, x1, y0 FROM boxes UNION ALL SELECT b, 2, x1, (y0 + y1) / 2 FROM boxes UNION ALL SELECT b, 3, (x0 + x1) / 2, (y0 + y1) / 2 FROM boxes UNION ALL SELECT b, 4, (x0 + x1) / 2, y1 FROM boxes UNION ALL SELECT b, 5, x0, y1 FROM boxes), "
    "lc AS (SELECT p.b, p.o, (p.x + q.x + r.x) / 3 AS x, (p.y + q.y + r.y) / 3 AS y FROM lv p JOIN lv q ON p.b = q.b AND q.o = (p.o + 1) % 6 JOIN lv r ON p.b = r.b AND r.o = (p.o + 2) % 6), "
    "lo AS (SELECT lc.b, lc.o, lc.x, lc.y FROM lc JOIN le ON le.b = lc.b GROUP BY ALL HAVING count(*) FILTER ((ay > lc.y) <> (by_ > lc.y) AND lc.x < ax + (bx - ax) * (lc.y - ay) / nullif(by_ - ay, 0)) % 2 = 1), "
    f"qe AS (SELECT v AS blob, unnest([{{'i': v, 'j': v + 1}}, {{'i': v + 1, 'j': v + 129}}, {{'i': v + 129, 'j': v + 128}}, {{'i': v + 128, 'j': v}}], recursive := true) FROM city), qf AS (SELECT blob, {_sx('i')} AS ax, {_sy('i')} AS ay, {_sx('j')} AS bx, {_sy('j')} AS by_ FROM qe), "
    "qb AS (SELECT blob, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM qf GROUP BY blob), "
    "nb AS (SELECT boxes.b, blob FROM boxes JOIN qb ON boxes.x0 <= qb.x1 AND qb.x0 <= boxes.x1 AND boxes.y0 <= qb.y1 AND qb.y0 <= boxes.y1 WHERE x1 > x0), "
    "no AS (SELECT nb.b, nb.blob, lo.o, count(*) FILTER ((ay > lo.y) <> (by_ > lo.y) AND lo.x < ax + (bx - ax) * (lo.y - ay) / nullif(by_ - ay, 0)) % 2 = 1 AS inside FROM nb JOIN lo ON lo.b = nb.b JOIN qf ON qf.blob = nb.blob GROUP BY ALL)"
).replace("WHERE x1 > x0", "WHERE boxes.x1 > boxes.x0")


@query(f"WITH {_Z} SELECT b, min(blob) AS blob FROM (SELECT b, blob FROM no GROUP BY ALL HAVING bool_and(inside)) GROUP BY b")
def building_blobs(spark, d):
    """The first quadrilateral that mostly contains each L-shaped building."""
    blobs = quads(spark, d).select(C("poly").alias("blob"), F.transform("ring", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("ring"))
    return locate.assigned(ells(spark, d), blobs)


def _doubles(spark, d):
    """Boxes, and for a seventh of them a copy moved by 0.5 m (congruent), 3 m (suspicious) or half its width (neither)."""
    b = boxes(spark, d).where("x1 > x0")
    ring = lambda m: locate.ring_of_xy((C("x0") + m, C("y0")), (C("x1") + m, C("y0")), (C("x1") + m, C("y1") + m / 4), (C("x0") + m, C("y1")))
    moved = F.when(C("b") % 3 == 0, F.lit(0.5)).when(C("b") % 3 == 1, F.lit(3.0)).otherwise((C("x1") - C("x0")) / 2)
    return b.select(C("b").alias("id"), ring(F.lit(0.0)).alias("ring")).union(b.where("b % 7 = 0").select(C("b") + 10**9, ring(moved)))


@query()
def suspicious_pairs(spark, d):
    """Shapes that hold each other's trio centres without being congruent, and the smaller one; the tests hold it against a plain version."""
    return dedup.suspicious_pairs(_doubles(spark, d))


@query()
def dedup_report(spark, d):
    """How many shapes are congruent copies, suspicious, and left, and their vertices; the tests hold it against a plain version."""
    return dedup.report(_doubles(spark, d))


@query()
def triangle_groups(spark, d):
    """Triangles with the least triangle that a flood over admissible steps comes from; the tests hold it against a plain flood."""
    t = written(triangles(spark, d), "mesh")
    return graph.reached_by(t.select(C("tid").alias("v")), mesh.admissible_steps(t))


@query()
def flat_corners(spark, d):
    """How many corners are left of rings with flat ones, and which comes first; the tests hold it against a plain scan."""
    return polygons.flattened(_bumpy(spark, d), 40.0).select("id", F.size("ring").cast("long").alias("n"), F.get("ring", F.lit(0))["x"].alias("first_x"))


def _bumpy(spark, d):
    """Rings of twelve corners about each box: three on each side, the middle ones a little off."""
    b = boxes(spark, d).where("x1 > x0")
    off = lambda i: ((C("b") * (i + 3)) % 11).cast("double") / 4
    at = lambda a, z, t: C(a) + (C(z) - C(a)) * t
    corners = []
    for i, (x, y, u, v) in enumerate((("x0", "y0", "x1", "y0"), ("x1", "y0", "x1", "y1"), ("x1", "y1", "x0", "y1"), ("x0", "y1", "x0", "y0"))):
        corners += [(C(x), C(y)), (at(x, u, 0.25), at(y, v, 0.25) + off(i)), (at(x, u, 0.75) + off(i + 4), at(y, v, 0.75))]
    return b.select(C("b").alias("id"), g.once(locate.ring_of_xy(*corners)).alias("ring"))


@query(
    f"WITH {_M}, bm AS (SELECT tid, tid // 2 // 512 AS blob, (ax + bx + cx) / 3 AS x, (ay + by_ + cy) / 3 AS y FROM ms), bn AS (SELECT *, avg(x) OVER w AS mx, avg(y) OVER w AS my FROM bm WINDOW w AS (PARTITION BY blob)), "
    "br AS (SELECT *, row_number() OVER (PARTITION BY blob ORDER BY floor(((x - mx) * (x - mx) + (y - my) * (y - my)) / 10), tid) AS o FROM bn) SELECT blob, tid FROM br WHERE o = 1"
)
def blob_centres(spark, d):
    """The triangle of each blob whose centre is nearest to the mean of all, to 10 square metres."""
    mean = lambda c: (C(f"a{c}") + C(f"b{c}") + C(f"c{c}")) / 3
    t = triangles(spark, d).select("tid", F.floor(C("tid") / 2 / 512).alias("blob"), mean("x").alias("x"), mean("y").alias("y"))
    m = t.groupBy("blob").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    d2 = (C("x") - C("mx")) * (C("x") - C("mx")) + (C("y") - C("my")) * (C("y") - C("my"))
    return t.join(m, "blob").groupBy("blob").agg(F.min_by("tid", F.struct(F.floor(d2 / 10), "tid")).alias("tid"))


@query(
    f"WITH {_P}, {_B}, {_V}, ec AS (SELECT count(*) FILTER (x1 > x0) AS n FROM boxes) SELECT (SELECT count(*) FROM city) + n AS shapes, n AS concave FROM ec"
)
def convexity_counts(spark, d):
    """How many of the quadrilaterals and L-shaped buildings there are, and how many are not convex."""
    plain = F.transform("ring", lambda p: g.point(p["x"], p["y"]))
    both = quads(spark, d).select(plain.alias("ring")).union(ells(spark, d).where(g.signed_area(C("ring")) > 0).select("ring"))
    return both.agg(F.count("*").alias("shapes"), F.count_if(~g.is_convex(C("ring"))).alias("concave"))


@query(
    f"WITH {_P}, e AS (SELECT max(x) - min(x) + 20 AS w, max(y) - min(y) + 20 AS h FROM pts), f AS (SELECT floor(w * w / 2 + h * h / 2 + w * h * 3 / 4 + 0.5)::BIGINT AS area FROM e) "
    "SELECT 'outside' || n AS id, 6::INT AS corners, area FROM f, (SELECT unnest([1, 2]) AS n)"
)
def boundary_blobs(spark, d):
    """The two blobs that close the mesh off around all points, with their areas."""
    e = points(spark, d).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()  # one row
    blobs, _ = mesh.boundary(tuple(e), 10.0)
    rows = spark.createDataFrame([(name, [tuple(map(float, p)) for p in ring]) for name, ring in blobs], "id string, ring array<struct<x:double,y:double>>")
    return rows.select("id", F.size("ring").alias("corners"), F.floor(F.abs(g.signed_area(C("ring"))) + 0.5).alias("area"))
