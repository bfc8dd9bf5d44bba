"""Portals between polygons, paths along cheapest routes, and rays through a mesh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geoweave.functions import geometry as g, shapes as s
from geoweave.operators import locate
from geoweave.operators.spatial import with_cells
from geoweave.shared import written

C = F.col


def polygon_edges(polygons: DataFrame) -> DataFrame:
    """(poly, i, v1, v2, ax, ay, bx, by, neighbour) for polygons (poly, ring with vertex numbers): one row for each edge.

    neighbour is the other polygon with the same two vertices, null unless there is exactly one.
    """
    n = F.size("ring")
    edge = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), F.get("ring", i).alias("a"), F.get("ring", (i + 1) % n).alias("b")))
    rows = polygons.where(n > 1).select("poly", F.explode(edge).alias("e"))
    rows = rows.select("poly", "e.i", C("e.a.v").alias("v1"), C("e.b.v").alias("v2"), C("e.a.x").alias("ax"), C("e.a.y").alias("ay"), C("e.b.x").alias("bx"), C("e.b.y").alias("by"))
    rows = rows.withColumns({"lo": F.least("v1", "v2"), "hi": F.greatest("v1", "v2")})
    pairs = rows.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.min("poly").alias("p"), F.max("poly").alias("q")).where("n = 2 and p <> q")
    other = F.when(C("poly") == C("p"), C("q")).when(C("poly") == C("q"), C("p"))
    return rows.join(pairs, ["lo", "hi"], "left").select("poly", "i", "v1", "v2", "ax", "ay", "bx", "by", other.alias("neighbour"))


def portals(polygons: DataFrame) -> DataFrame:
    """(poly, neighbour, left_v, right_v, lx, ly, rx, ry): the edge to each neighbour as seen on the way there.

    Of several shared edges the first counts. The way goes from one polygon's mean vertex to the other's.
    """
    edges = polygon_edges(polygons).where("neighbour is not null")
    first = edges.groupBy("poly", "neighbour").agg(F.min_by(F.struct("v1", "v2", "ax", "ay", "bx", "by"), "i").alias("e"))
    centre = polygons.select("poly", g.vertex_mean(C("ring")).alias("m"))
    both = first.join(centre.withColumnRenamed("m", "here"), "poly").join(centre.select(C("poly").alias("neighbour"), C("m").alias("there")), "neighbour")
    turn = s.cross(C("there.x") - C("here.x"), C("there.y") - C("here.y"), C("e.bx") - C("e.ax"), C("e.by") - C("e.ay"))
    side = lambda a, b: F.when(turn > 0, C(f"e.{a}")).otherwise(C(f"e.{b}"))
    return both.select("poly", "neighbour", side("v2", "v1").alias("left_v"), side("v1", "v2").alias("right_v"), side("bx", "ax").alias("lx"), side("by", "ay").alias("ly"), side("ax", "bx").alias("rx"), side("ay", "by").alias("ry"))


def paths(tree: DataFrame, goals: DataFrame) -> DataFrame:
    """(goal, step, v): the nodes from each of goals (goal) back to the start, for a tree (v, via) with via < 0 at the start.

    Step 0 is the goal. Ways twice as long are made from ways to the middle, so a path of n nodes takes log n joins. Goals
    that the tree doesn't hold have no row.
    """
    jump = written(tree.select("v", F.when(C("via") >= 0, C("via")).alias("up")), "jumps")
    jumps = []
    while jump.where("up is not null").limit(1).count():
        jumps.append(jump)
        onward = jump.select(C("v").alias("up"), C("up").alias("far"))
        jump = written(jump.where("up is not null").join(onward, "up").select("v", C("far").alias("up")), "jumps")
    rows = goals.select("goal").distinct().join(tree.select(C("v").alias("goal")), "goal", "left_semi").select("goal", F.lit(0).alias("step"), C("goal").alias("v"))
    for j, table in reversed(list(enumerate(jumps))):
        more = rows.join(table.where("up is not null"), "v").select("goal", (C("step") + (1 << j)).alias("step"), C("up").alias("v"))
        rows = written(rows.union(more), "paths")
    return rows


def crossing(ax, ay, bx, by, cx, cy, dx, dy) -> Column:
    """How far along ab, from 0 to 1, it crosses cd; null if it doesn't."""
    rx, ry, sx, sy = bx - ax, by - ay, dx - cx, dy - cy
    det = F.nullif(s.cross(rx, ry, sx, sy), F.lit(0.0))
    t, u = s.cross(cx - ax, cy - ay, sx, sy) / det, s.cross(cx - ax, cy - ay, rx, ry) / det
    return F.when(t.between(0, 1) & u.between(0, 1), t)


def ray_walks(rays: DataFrame, triangles: DataFrame, neighbours: DataFrame, size: float = 256.0) -> tuple[DataFrame, DataFrame]:
    """Rays (r, ax, ay, bx, by) from a to b through triangles, as far as the mesh goes on: (walls, corridors).

    walls (r, t, tid, e): where the ray first meets an edge without a triangle behind it, and that edge; t null if it
    reaches b. corridors (r, tid, t): the triangles on the way and where each is entered, 0 for the first. Rays that begin
    outside the mesh have no row. All crossings are found at once by a join on cells, not by going from one triangle to the
    next, so a ray's length makes rows and no rounds.
    """
    corners = triangles.select("tid", F.explode(F.array(*[F.struct(F.lit(i).alias("e"), *[C(f"{p}{c}").alias(f"{q}{c}") for p, q in ((a, "p"), (b, "q")) for c in "xy"]) for i, (a, b) in enumerate((("a", "b"), ("b", "c"), ("c", "a")))])).alias("s"))
    edges = corners.select("tid", "s.*").join(neighbours.select("tid", "e", "neighbour"), ["tid", "e"])
    box = lambda df, a, b: df.withColumns({"x0": F.least(f"{a}x", f"{b}x"), "y0": F.least(f"{a}y", f"{b}y"), "x1": F.greatest(f"{a}x", f"{b}x"), "y1": F.greatest(f"{a}y", f"{b}y")})
    mid = lambda c: (C(c) * size, (C(c) + 1) * size)
    line = F.array(g.point(C("ax"), C("ay")), g.point(C("bx"), C("by")))
    far = with_cells(box(rays, "a", "b"), size).where(s.ring_meets_box(line, mid("cx")[0], mid("cy")[0], mid("cx")[1], mid("cy")[1])).drop("x0", "y0", "x1", "y1")
    celled = with_cells(box(edges, "p", "q"), size).drop("x0", "y0", "x1", "y1")
    t = crossing(*[C(c) for c in ("ax", "ay", "bx", "by", "px", "py", "qx", "qy")])
    met = far.join(celled, ["cx", "cy"]).withColumn("t", t).where("t is not null").groupBy("r", "tid", "e", "neighbour").agg(F.min("t").alias("t"))
    begin = locate.first_hit(rays.select(C("r").alias("k"), C("ax").alias("x"), C("ay").alias("y")), locate.triangle_rings(triangles), "tid").withColumnsRenamed({"k": "r", "tid": "first"})
    met = written(met.join(begin, "r"), "crossings")
    wall = met.where("neighbour < 0").groupBy("r").agg(F.min(F.struct("t", "tid", "e")).alias("w"))
    walls = begin.join(wall, "r", "left").select("r", "w.t", "w.tid", "w.e")
    through = met.groupBy("r", "tid", "first").agg(F.min("t").alias("t"), F.max("t").alias("out"), F.count("*").alias("n")).where("tid <> first and (n = 1 or t < out)")
    inside = through.select("r", "tid", "t").union(begin.select("r", C("first").alias("tid"), F.lit(0.0)))
    reached = inside.join(walls.select("r", C("t").alias("end")), "r").where(C("end").isNull() | (C("t") < C("end")))
    return walls, reached.select("r", "tid", "t")
