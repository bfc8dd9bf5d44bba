"""Queries on triangulations: buildings with courtyards, the space between boxes, convex polygons of a mesh, and colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoweave.functions import geometry as g, shapes as s
from geoweave.operators import graph, locate, merging, mesh, routes, triangulation
from geoweave.plans.mesh_queries import _M, ells, mesh as triangles, quads
from geoweave.plans.queries import _B, _P, query
from geoweave.plans.route_queries import _PE
from geoweave.shared import written
from geoweave.sources.driver_tables import boxes

C = F.col


def _area():
    return s.triangle_area(*[C(c) for c in ("ax", "ay", "bx", "by", "cx", "cy")])


@query(
    f"WITH {_P}, {_B}, e AS (SELECT b, x1 - x0 AS w, y1 - y0 AS h FROM boxes WHERE x1 > x0), c AS (SELECT 2 * b AS id, 6 AS corners, 0 AS holes, w * h * 3 / 4 AS area FROM e UNION ALL SELECT 2 * b + 1, 8, 1, w * h * 3 / 4 FROM e) "
    "SELECT id, corners + 2 * holes - 2 AS n, floor(area + 0.3711)::BIGINT AS area, corners AS kept FROM c"
)
def triangulated_buildings(spark, d):
    """Triangles of L-shaped buildings and of boxes with a courtyard: how many, their area, and how many edges of the rings are theirs."""
    b = boxes(spark, d).where("x1 > x0")
    x, y = (lambda t: C("x0") + (C("x1") - C("x0")) * t), (lambda t: C("y0") + (C("y1") - C("y0")) * t)
    square = lambda lo, hi: locate.ring_of_xy((x(lo), y(lo)), (x(hi), y(lo)), (x(hi), y(hi)), (x(lo), y(hi)))
    none = F.array().cast("array<array<struct<x:double,y:double>>>")
    rows = ells(spark, d).where(g.signed_area(C("ring")) > 0).select((2 * C("b")).alias("id"), "ring", none.alias("holes"))
    rows = written(rows.union(b.select(2 * C("b") + 1, square(0.0, 1.0), F.array(square(0.25, 0.75)))), "buildings")
    t = written(triangulation.triangulated(rows), "triangles")
    point = lambda c: g.point(C(f"{c}x"), C(f"{c}y"))
    side = lambda p, q: F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q"))
    sides = t.select("id", F.explode(F.array(*[side(point(a), point(c)) for a, c in ("ab", "bc", "ca")])).alias("e")).distinct()
    edge = lambda ring: F.transform(ring, lambda p, i: side(p, F.get(ring, (i + 1) % F.size(ring))))
    own = rows.select("id", F.explode(F.flatten(F.transform(F.concat(F.array("ring"), "holes"), edge))).alias("e"))
    kept = own.join(sides, ["id", "e"], "left_semi").groupBy("id").agg(F.count("*").alias("kept"))
    return t.groupBy("id").agg(F.count("*").alias("n"), F.floor(F.sum(_area()) + 0.3711).alias("area")).join(kept, "id")


@query(
    f"WITH {_P}, {_B}, ex AS (SELECT floor(min(x0) / 1024)::BIGINT AS a, floor(max(x1) / 1024)::BIGINT AS b, floor(min(y0) / 1024)::BIGINT AS c, floor(max(y1) / 1024)::BIGINT AS d FROM boxes), "
    "tx AS (SELECT unnest(range(a, b + 1)) AS tx FROM ex), ty AS (SELECT unnest(range(c, d + 1)) AS ty FROM ex), "
    "bt AS (SELECT tx, ty, greatest(x0, tx * 1024) AS x0, least(x1, tx * 1024 + 1024) AS x1, greatest(y0, ty * 1024) AS y0, least(y1, ty * 1024 + 1024) AS y1 FROM tx, ty, boxes WHERE x0 < tx * 1024 + 1024 AND x1 > tx * 1024 AND y0 < ty * 1024 + 1024 AND y1 > ty * 1024), "
    "xs AS (SELECT tx, ty, x0 AS x FROM bt UNION SELECT tx, ty, x1 FROM bt), st AS (SELECT tx, ty, x AS xa, lead(x) OVER (PARTITION BY tx, ty ORDER BY x) AS xb FROM xs), "
    "cv AS (SELECT st.*, y0, y1, max(y1) OVER (PARTITION BY st.tx, st.ty, xa ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM st JOIN bt ON bt.tx = st.tx AND bt.ty = st.ty AND x0 <= xa AND x1 >= xb), "
    "ar AS (SELECT tx, ty, sum((xb - xa) * greatest(0, y1 - greatest(y0, coalesce(top, y0)))) AS area FROM cv GROUP BY tx, ty) "
    "SELECT tx.tx, ty.ty, floor(1048576 - coalesce(area, 0) + 0.3711)::BIGINT AS free FROM tx CROSS JOIN ty LEFT JOIN ar ON ar.tx = tx.tx AND ar.ty = ty.ty WHERE 1048576 - coalesce(area, 0) > 0.01"
)
def free_space(spark, d):
    """The area of the triangles between the boxes in each tile of 1024 m."""
    b = boxes(spark, d)
    e = b.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()  # one row
    blobs = b.select(C("b").alias("blob"), locate.ring_of_xy((C("x0"), C("y0")), (C("x1"), C("y0")), (C("x1"), C("y1")), (C("x0"), C("y1"))).alias("ring"))
    free = triangulation.free_space(blobs, tuple(e), 1024.0)
    t = triangulation.triangulated(free.select(F.struct("tx", "ty", "part").alias("id"), "ring", "holes"))
    return t.groupBy("id.tx", "id.ty").agg(F.floor(F.sum(_area()) + 0.3711).alias("free"))


def _groups(spark, d):
    t = written(triangles(spark, d), "mesh")
    grp = graph.reached_by(t.select(C("tid").alias("v")), mesh.admissible_steps(t))
    return t.join(grp.select(C("v").alias("tid"), C("label").alias("grp")), "tid")


@query()
def merged_polygons(spark, d):
    """The convex polygons of each flood of triangles, with their triangles; the tests hold it against a plain version."""
    m = merging.merged_polygons(_groups(spark, d), 4096.0)
    return m.select("poly", F.size("ring").cast("long").alias("corners"), F.array_join(F.array_sort("tids"), ",").alias("tids"))


@query(f"WITH {_M} SELECT tid, 1::BIGINT AS n_polygons, true AS convex, floor(((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) / 2 + 0.5)::BIGINT AS area FROM ms")
def merged_triangles(spark, d):
    """Each triangle's polygons, whether these are convex, and what the triangle adds to their area: its own area by the polygon's share."""
    m = written(merging.merged_polygons(_groups(spark, d), 4096.0), "merged")
    plain = F.transform("ring", lambda p: g.point(p["x"], p["y"]))
    held = m.select("poly", plain.alias("ring"), "tids").select("poly", g.is_convex(C("ring")).alias("convex"), g.signed_area(C("ring")).alias("whole"), "tids")
    held = held.select("poly", "convex", "whole", F.explode("tids").alias("tid"))
    own = triangles(spark, d).select("tid", _area().alias("own"))
    rows = held.join(own, "tid")
    share = rows.groupBy("poly").agg(F.sum("own").alias("sum"))
    each = rows.join(share, "poly").groupBy("tid").agg(F.count("*").alias("n_polygons"), F.every("convex").alias("convex"), F.first(C("own") * C("whole") / C("sum")).alias("area"))
    return each.select("tid", "n_polygons", "convex", F.floor(C("area") + 0.5).alias("area"))


@query(f"WITH {_PE} SELECT c.v AS poly, count(DISTINCT neighbour) AS neighbours, 0::BIGINT AS clashes, true AS few FROM city c LEFT JOIN pn ON pn.poly = c.v GROUP BY c.v")
def polygon_colours(spark, d):
    """Polygons in colours so that neighbours differ: how many neighbours each has, how many of its colour, and whether twelve colours are enough."""
    q = quads(spark, d)
    e = written(routes.polygon_edges(q).where("neighbour is not null").select(C("poly").alias("a"), C("neighbour").alias("b")).distinct(), "edges")
    colours = graph.coloured(q.select(C("poly").alias("v")), e)
    own, other = colours.select(C("v").alias("a"), C("colour").alias("c")), colours.select(C("v").alias("b"), C("colour").alias("o"))
    met = e.join(own, "a").join(other, "b").groupBy(C("a").alias("v")).agg(F.count("*").alias("neighbours"), F.count_if(C("c") == C("o")).alias("clashes"))
    return colours.join(met, "v", "left").select(C("v").alias("poly"), F.coalesce("neighbours", F.lit(0)).alias("neighbours"), F.coalesce("clashes", F.lit(0)).alias("clashes"), (C("colour") < 12).alias("few"))
