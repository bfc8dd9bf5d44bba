"""Queries on routes between many pairs: cheapest corridors, their corners, and corridors along the straight line."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from geoweave.functions import geometry as g
from geoweave.operators import corridors, locate, mesh, routes
from geoweave.plans.mesh_queries import _SIDE, _sx, _sy, mesh as triangles, quads
from geoweave.plans.queries import _S, _suppliers, query
from geoweave.plans.route_queries import _PE
from geoweave.shared import written

C = F.col


def _walkable(v):
    """Four of five polygons can be walked on."""
    return (v * 31 + 7) % 5 != 0


def _ground(spark, d):
    """Pairs of walkable polygons that hold a supplier and its goal, with these points; middles of and edges between walkable polygons, portals, and all polygons."""
    all_ = written(quads(spark, d), "polygons")
    walk = all_.where(_walkable(C("poly")))
    far = lambda c, m: C(c) + (C("q") * m) % 6001 - 3000
    sup = _suppliers(spark, d).select("q", C("x").alias("sx"), C("y").alias("sy"), far("x", 37).alias("ex"), far("y", 91).alias("ey"))
    at = lambda c, name: locate.first_hit(sup.select(C("q").alias("k"), C(f"{c}x").alias("x"), C(f"{c}y").alias("y")), all_, "poly").where(_walkable(C("poly"))).select(C("k").alias("q"), C("poly").alias(name))
    pairs = written(sup.join(at("s", "start"), "q").join(at("e", "goal"), "q").withColumnRenamed("q", "p"), "pairs")
    middle = g.vertex_mean(C("ring"))
    centres = written(walk.select(C("poly").alias("v"), middle["x"].alias("x"), middle["y"].alias("y")), "middles")
    doors = written(routes.portals(walk), "portals")
    return pairs, centres, doors.select(C("poly").alias("a"), C("neighbour").alias("b")), doors, all_


_G = (
    f"{_PE}, {_S}, pl AS (SELECT q, 0 AS far, x, y FROM sup UNION ALL SELECT q, 1, x + (q * 37) % 6001 - 3000, y + (q * 91) % 6001 - 3000 FROM sup), "
    f"qf AS (SELECT poly, v1 AS i, v2 AS j, {_sx('v1')} AS ax, {_sy('v1')} AS ay, {_sx('v2')} AS bx, {_sy('v2')} AS by_ FROM pe), qb AS (SELECT poly, min(ax) AS x0, max(ax) AS x1, min(ay) AS y0, max(ay) AS y1 FROM qf GROUP BY poly), "
    "qc AS (SELECT q, far, x, y, poly FROM pl JOIN qb ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1), "
    f"qg AS (SELECT q, far, qc.poly, bool_and({_SIDE.format(i='i', j='j', ax='ax', ay='ay', bx='bx', by='by_')}) AS inside FROM qc JOIN qf ON qc.poly = qf.poly GROUP BY ALL), "
    "qh AS (SELECT q, far, min(poly) AS poly FROM qg WHERE inside GROUP BY q, far), pr AS (SELECT a.q AS p, a.poly AS start, b.poly AS goal FROM qh a JOIN qh b ON a.q = b.q AND a.far = 0 AND b.far = 1 WHERE (a.poly * 31 + 7) % 5 <> 0 AND (b.poly * 31 + 7) % 5 <> 0), "
    f"ce AS (SELECT poly, avg({_sx('v1')}) AS mx, avg({_sy('v1')}) AS my FROM pe GROUP BY poly), "
    "ed AS (SELECT DISTINCT pn.poly AS a, neighbour AS b, sqrt((p.mx - q.mx) * (p.mx - q.mx) + (p.my - q.my) * (p.my - q.my)) AS w FROM pn JOIN ce p ON p.poly = pn.poly JOIN ce q ON q.poly = neighbour WHERE (pn.poly * 31 + 7) % 5 <> 0 AND (neighbour * 31 + 7) % 5 <> 0), "
    "best(p, v, cost) USING KEY (p, v) AS (SELECT p, start, 0::DOUBLE FROM pr UNION SELECT t.p, t.v, t.cost FROM (SELECT best.p, ed.b AS v, min(best.cost + w) AS cost FROM best JOIN ed ON ed.a = best.v GROUP BY ALL) t "
    "LEFT JOIN recurring.best r ON r.p = t.p AND r.v = t.v WHERE r.cost IS NULL OR t.cost < r.cost)"
)


@query(f"WITH RECURSIVE {_G} SELECT pr.p, start, goal, floor(cost + 0.3711)::BIGINT AS cost FROM pr JOIN best ON best.p = pr.p AND best.v = goal")
def route_searches(spark, d):
    """The cost of the cheapest corridor from each supplier's polygon to its goal's, over the distances between middles."""
    pairs, centres, edges, *_ = _ground(spark, d)
    found = corridors.search(pairs, centres, edges)
    return found.groupBy("p").agg(F.max("cost").alias("cost")).join(pairs, "p").select("p", "start", "goal", F.floor(C("cost") + 0.3711).alias("cost"))


@query()
def route_corners(spark, d):
    """The corners of each supplier's way, 2 m away from the blocked polygons, with those; the tests hold the parts against plain versions."""
    pairs, centres, edges, doors, all_ = _ground(spark, d)
    found = written(corridors.search(pairs, centres, edges, free=512.0, stray=0.5), "corridors")
    bends = corridors.corners(found, doors, pairs.select("p", "sx", "sy", "ex", "ey"))
    blobs = all_.where(~_walkable(C("poly"))).select(C("poly").alias("blob"), "ring")
    return corridors.offset_corners(bends, blobs, 2.0).select("p", "i", "x", "y", "v", "poly", "blob")


@query(
    f"WITH RECURSIVE {_G} SELECT pr.p, true AS starts, true AS ends, true AS joined, cost IS NOT NULL AS found FROM pr JOIN best ON best.p = pr.p AND best.v = goal"
)
def line_corridors(spark, d):
    """Corridors that keep to the line where it is free: whether each begins at the start, ends at the goal, and goes from neighbour to neighbour."""
    pairs, centres, edges, *_ = _ground(spark, d)
    t = written(triangles(spark, d), "mesh")
    rays = pairs.select(C("p").alias("r"), C("sx").alias("ax"), C("sy").alias("ay"), C("ex").alias("bx"), C("ey").alias("by"))
    _, through = routes.ray_walks(rays, t, mesh.triangle_neighbours(t))
    passed = through.select(C("r").alias("p"), "t", F.floor(C("tid") / 2).cast("long").alias("v"))
    way = written(corridors.along_line(pairs, passed, centres, edges), "corridors")
    pair = way.alias("a").join(way.alias("b"), (C("a.p") == C("b.p")) & (C("a.step") + 1 == C("b.step"))).select(C("a.p").alias("p"), C("a.v").alias("a"), C("b.v").alias("b"))
    steps = pair.join(edges, ["a", "b"], "left_semi").groupBy("p").agg(F.count("*").alias("steps"))
    ends = way.groupBy("p").agg(F.min_by("v", "step").alias("first"), F.max_by("v", "step").alias("last"), F.count("*").alias("n"))
    rows = ends.join(pairs, "p").join(steps, "p", "left")
    return rows.select("p", (C("first") == C("start")).alias("starts"), (C("last") == C("goal")).alias("ends"), (F.coalesce("steps", F.lit(0)) == C("n") - 1).alias("joined"), F.lit(True).alias("found"))


@query(
    f"WITH {_PE}, le AS (SELECT poly, neighbour, sum(sqrt(({_sx('v1')} - {_sx('v2')}) * ({_sx('v1')} - {_sx('v2')}) + ({_sy('v1')} - {_sy('v2')}) * ({_sy('v1')} - {_sy('v2')}))) AS l FROM pn GROUP BY poly, neighbour) "
    "SELECT poly, neighbour, floor(l * 100 + 0.3711)::BIGINT AS length, floor(l / sum(l) OVER (PARTITION BY poly) * 1000000 + 0.3711)::BIGINT AS share_ppm FROM le"
)
def shared_edges(spark, d):
    """Each polygon's neighbours with the length of the edges shared with them, and its share of all: the chance to go there."""
    e = routes.polygon_edges(quads(spark, d)).where("neighbour is not null")
    length = e.groupBy("poly", "neighbour").agg(F.sum(g.distance(C("ax"), C("ay"), C("bx"), C("by"))).alias("l"))
    share = C("l") / F.sum("l").over(Window.partitionBy("poly"))
    return length.select("poly", "neighbour", F.floor(C("l") * 100 + 0.3711).alias("length"), F.floor(share * 1000000 + 0.3711).alias("share_ppm"))
