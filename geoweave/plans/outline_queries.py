"""Queries on outlines: unions of boxes, offset buildings, and blobs of buildings near each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoweave.functions import geometry as g
from geoweave.operators import locate, outlines, reshaping
from geoweave.plans.mesh_queries import ells
from geoweave.plans.queries import _B, _P, query
from geoweave.plans.route_queries import _bumpy
from geoweave.shared import written
from geoweave.sources.driver_tables import boxes

C = F.col


@query(
    f"WITH RECURSIVE {_P}, {_B}, pr AS (SELECT p.b AS p, q.b AS q FROM boxes p JOIN boxes q ON p.b <> q.b AND p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1), "
    "rc(b, r) AS (SELECT b, b FROM boxes UNION SELECT rc.b, pr.q FROM rc JOIN pr ON pr.p = rc.r), lb AS (SELECT boxes.*, g.grp FROM boxes JOIN (SELECT b, min(r) AS grp FROM rc GROUP BY b) g ON g.b = boxes.b), "
    "xs AS (SELECT grp, x0 AS x FROM lb UNION SELECT grp, x1 FROM lb), st AS (SELECT grp, x AS xa, lead(x) OVER (PARTITION BY grp ORDER BY x) AS xb FROM xs), "
    "cv AS (SELECT st.*, y0, y1, max(y1) OVER (PARTITION BY st.grp, xa ORDER BY y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM st JOIN lb ON lb.grp = st.grp AND x0 <= xa AND x1 >= xb), "
    "ar AS (SELECT grp, sum((xb - xa) * greatest(0, y1 - greatest(y0, coalesce(top, y0)))) AS area FROM cv GROUP BY grp) "
    "SELECT grp, (SELECT count(*) FROM lb WHERE lb.grp = ar.grp) AS n_boxes, floor(area + 0.3711)::BIGINT AS area FROM ar"
)
def united_boxes(spark, d):
    """What the boxes that hang together cover, each spot counted once: the area within their outlines, less that of holes."""
    ring = locate.ring_of_xy((C("x0"), C("y0")), (C("x1"), C("y0")), (C("x1"), C("y1")), (C("x0"), C("y1")))
    grouped = written(outlines.touching_groups(boxes(spark, d).select(C("b").alias("id"), ring.alias("ring"))), "grouped")
    area = outlines.union(grouped, plain=True).groupBy("grp").agg(F.floor(F.sum(g.signed_area(C("ring"))) + 0.3711).alias("area"))
    return grouped.groupBy("grp").agg(F.count("*").alias("n_boxes")).join(area, "grp")


@query(
    f"WITH {_P}, {_B}, e AS (SELECT b, x1 - x0 AS w, y1 - y0 AS h FROM boxes WHERE x1 > x0) SELECT b, floor(w * h * 3 / 4 + (2 * w + 2 * h) * 3 + 4 * 9 + 0.3711)::BIGINT AS grown, "
    "floor(w * h * 3 / 4 - (2 * w + 2 * h) * 1.5 + 4 * 2.25 + 0.3711)::BIGINT AS shrunk FROM e WHERE w > 6"
)
def offset_buildings(spark, d):
    """The areas of L-shaped buildings grown by 3 m and shrunk by 1.5 m, corners mitered."""
    rings = ells(spark, d).where(g.signed_area(C("ring")) > 0).select(C("b").alias("id"), "ring")
    of = lambda by, name: outlines.offset(rings, by).groupBy(C("id").alias("b")).agg(F.floor(F.sum(g.signed_area(C("ring"))) + 0.3711).alias(name))
    return of(3.0, "grown").join(of(-1.5, "shrunk"), "b")


@query()
def united_buildings(spark, d):
    """The blob of each L-shaped building that stands nearer than 7.2 m to others, and the blob's corners; the tests hold the operator against plain cases."""
    rings = ells(spark, d).where(g.signed_area(C("ring")) > 0).select(C("b").alias("id"), "ring")
    blobs, members = outlines.united(rings, 3.6)
    least = members.groupBy("blob").agg(F.min("id").alias("name"), F.count("*").alias("n_buildings"))
    return members.join(least, "blob").join(blobs, "blob").select(C("id").alias("b"), C("name").alias("blob"), "n_buildings", F.size("ring").cast("long").alias("corners"))


@query()
def light_outlines(spark, d):
    """Corners left of the uneven rings about each box by the light chain, and their area; the tests hold the steps against plain versions."""
    r = reshaping.light_rings(_bumpy(spark, d))
    return r.select("id", F.size("ring").cast("long").alias("corners"), F.floor(F.abs(g.signed_area(C("ring"))) + 0.3711).alias("area"))


@query()
def strong_outlines(spark, d):
    """The same by the strong chain: bays closed, short edges and flat corners out, corners held against the original."""
    r = reshaping.strong_rings(_bumpy(spark, d))
    return r.select("id", F.size("ring").cast("long").alias("corners"), F.floor(F.abs(g.signed_area(C("ring"))) + 0.3711).alias("area"))


@query()
def simplified_blobs(spark, d):
    """Blobs of L-shaped buildings within 4 m of each other: how many buildings and corners each has."""
    rings = ells(spark, d).where(g.signed_area(C("ring")) > 0).select(C("b").alias("id"), "ring")
    blobs, members = reshaping.simplified_blobs(rings)
    n = members.groupBy(C("id").alias("blob")).agg(F.count("*").alias("n_buildings"))
    return blobs.select(C("id").alias("blob"), F.size("ring").cast("long").alias("corners")).join(n, "blob").select("blob", "n_buildings", "corners")
