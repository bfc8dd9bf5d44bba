"""Queries on what is in view, along corridors and measured between points."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoweave.functions import geometry as g, shapes as s
from geoweave.operators import rings, spatial
from geoweave.plans.mesh_queries import _ELL, _M, ells, mesh as triangles
from geoweave.plans.queries import _B, _P, query
from geoweave.shared import written
from geoweave.sources.driver_tables import boxes, points, table

C = F.col
_BOX = (-2100.0, -1900.0, 1700.0, 2300.0)


def _within(x: str, y: str) -> str:
    return f"({x} BETWEEN {_BOX[0]} AND {_BOX[2]} AND {y} BETWEEN {_BOX[1]} AND {_BOX[3]})"


@query(
    f"WITH {_M}, v AS (SELECT * FROM ms WHERE {_within('ax', 'ay')} OR {_within('bx', 'by_')} OR {_within('cx', 'cy')}) "
    "SELECT DISTINCT least(a, b) AS lo, greatest(a, b) AS hi FROM (SELECT v1 AS a, v2 AS b FROM v UNION ALL SELECT v2, v3 FROM v UNION ALL SELECT v3, v1 FROM v)"
)
def viewport_triangles(spark, d):
    """Distinct edges of the triangles that have a corner in a window; those that only cover it are not meant."""
    from geoweave.operators.mesh import triangle_edges

    inside = lambda p: C(f"{p}x").between(_BOX[0], _BOX[2]) & C(f"{p}y").between(_BOX[1], _BOX[3])
    return triangle_edges(triangles(spark, d).where(inside("a") | inside("b") | inside("c"))).select("lo", "hi").distinct()


@query(
    f"WITH {_B}, le AS (SELECT b, unnest([" + ", ".join(f"{{'ax': {p[0]}, 'ay': {p[1]}, 'bx': {q[0]}, 'by_': {q[1]}}}" for p, q in zip(_ELL, _ELL[1:] + _ELL[:1])) + f"], recursive := true) FROM boxes) "
    f"SELECT b FROM le GROUP BY b HAVING min(ax) <= {_BOX[2]} AND max(ax) >= {_BOX[0]} AND min(ay) <= {_BOX[3]} AND max(ay) >= {_BOX[1]}"
)
def polygons_in_extent(spark, d):
    """L-shaped buildings whose box meets a window; all their edges lie along its sides, so no other axis parts them."""
    x0, y0, x1, y1 = map(F.lit, _BOX)
    return ells(spark, d).where(s.ring_meets_box(C("ring"), x0, y0, x1, y1)).select("b")


@query(
    "WITH c AS (SELECT o_custkey AS route, list(o_orderkey % 2000 + 1 ORDER BY o_orderkey) AS polys FROM orders GROUP BY o_custkey), e AS (SELECT route, unnest(polys) AS poly, unnest(range(len(polys))) AS seq FROM c) "
    "SELECT route, seq::INT AS seq, unnest(range(poly * 100, poly * 100 + p_size)) AS tid FROM e JOIN part ON p_partkey = poly"
)
def corridor_triangles(spark, d):
    """Corridors of polygons as the triangles of each, in order."""
    c = table(spark, d, "orders").groupBy(C("o_custkey").alias("route")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", (C("o_orderkey") % 2000 + 1).alias("poly")))).alias("s"))
    e = c.select("route", F.posexplode(F.transform("s", lambda x: x["poly"])).alias("seq", "p_partkey")).join(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    first = C("p_partkey") * 100
    return e.where("p_size > 0").select("route", "seq", F.explode(F.sequence(first, first + C("p_size") - 1)).alias("tid"))


@query(f"WITH {_P}, {_B} SELECT b, x0, y0 FROM boxes ORDER BY x0, y0, b LIMIT 100")
def sorted_corners(spark, d):
    """The hundred least lower left corners, by x, then y."""
    return boxes(spark, d).select("b", "x0", "y0").orderBy("x0", "y0", "b").limit(100)


@query("SELECT s_suppkey AS id, row_number() OVER (ORDER BY s_suppkey) AS place FROM supplier WHERE s_suppkey % 3 = 1")
def marks_by_id(spark, d):
    """Marks in order of their numbers, with their place; marks are few."""
    from pyspark.sql import Window

    return table(spark, d, "supplier").where("s_suppkey % 3 = 1").select(C("s_suppkey").alias("id"), F.row_number().over(Window.orderBy("s_suppkey")).alias("place"))


@query(f"WITH {_P} SELECT k, floor(sqrt((x - 100.5) * (x - 100.5) + (y + 20.25) * (y + 20.25)) * 100 + 0.5)::BIGINT AS d_cm FROM pts")
def measured_distance(spark, d):
    """Distance of each point from a fixed one, to the centimetre."""
    return points(spark, d).select("k", F.floor(g.distance(C("x"), C("y"), F.lit(100.5), F.lit(-20.25)) * 100 + 0.5).alias("d_cm"))


@query(f"WITH {_B} SELECT b FROM boxes WHERE b % 3 <> 0 AND b % 4 IN (0, 2)")
def dedup_input(spark, d):
    """Buildings that are polygons, or lines closed to 1e-9: what is looked at for doubles."""
    b = boxes(spark, d)
    corner = lambda x, y, m=0.0: g.point(C(x) + m, C(y))
    line = F.array(corner("x0", "y0"), corner("x1", "y1"), F.when(C("b") % 4 == 1, corner("x0", "y0", 1e-3)).otherwise(corner("x0", "y0", 5e-10)))
    shape = F.when(C("b") % 4 == 0, F.lit("Polygon")).when(C("b") % 4 == 3, F.lit("Point")).otherwise(F.lit("LineString"))
    rows = b.select("b", shape.alias("shape"), line.alias("line"), F.when(C("b") % 3 > 0, F.lit("yes")).alias("building"))
    whole = (C("shape") == "Polygon") | ((C("shape") == "LineString") & rings.is_closed(C("line"), 1e-9))
    return rows.where(C("building").isNotNull() & whole).select("b")


@query(
    f"WITH {_M}, us AS (SELECT tid AS id, unnest([{{'v': v1, 'x': ax, 'y': ay}}, {{'v': v2, 'x': bx, 'y': by_}}, {{'v': v3, 'x': cx, 'y': cy}}], recursive := true) FROM ms), ins AS (SELECT DISTINCT v FROM us WHERE {_within('x', 'y')}), "
    "ft AS (SELECT DISTINCT id FROM us WHERE v IN (SELECT v FROM ins)), pt AS (SELECT v FROM ins UNION SELECT v FROM us WHERE id IN (SELECT id FROM ft)) "
    "SELECT 'point' AS kind, v AS id FROM pt UNION ALL SELECT 'feature', id FROM ft UNION ALL SELECT DISTINCT 'group', id // 2 // 512 FROM ft"
)
def extract_by_box(spark, d):
    """What an extract by a box holds of the mesh: whole triangles, all their corners, and the blobs they belong to."""
    t = written(triangles(spark, d), "mesh")
    corner = lambda v, c: F.struct(C(v).alias("v"), C(f"{c}x").alias("x"), C(f"{c}y").alias("y"))
    uses = t.select(C("tid").alias("id"), F.explode(F.array(corner("v1", "a"), corner("v2", "b"), corner("v3", "c"))).alias("p")).select("id", "p.*")
    found = spatial.extracted(uses.select("v", "x", "y").distinct(), uses.select("id", "v"), t.select(F.floor(C("tid") / 2 / 512).alias("grp"), C("tid").alias("id")), _BOX)
    return found[0].select(F.lit("point").alias("kind"), C("v").alias("id")).union(found[1].select(F.lit("feature"), "id")).union(found[2].select(F.lit("group"), "grp"))
