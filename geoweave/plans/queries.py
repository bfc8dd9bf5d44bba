"""Registered queries over the driver tables, each with the DuckDB SQL for the same rows (None where SQL has no form)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from geoweave.functions import geometry as g
from geoweave.operators import dedup, graph, mesh, polygons, rules, sequences as seq, simulation, spatial
from geoweave.shared import written
from geoweave.sources.driver_tables import agents, boxes, city, frames, points, table

C = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_P = "pts AS (SELECT o_orderkey AS k, ((o_orderkey * 7919) % 2000001 - 1000000) / 100.0::DOUBLE AS x, ((o_orderkey * 104729) % 2000001 - 1000000) / 100.0::DOUBLE AS y FROM orders)"
_B = (
    "ctr AS (SELECT p_partkey AS b, ((p_partkey * 15485863) % 2000001 - 1000000) / 100.0::DOUBLE AS x, ((p_partkey * 32452843) % 2000001 - 1000000) / 100.0::DOUBLE AS y, "
    "(p_size * 4)::DOUBLE AS h FROM part), boxes AS (SELECT b, x - h AS x0, y - h AS y0, x + h AS x1, y + h AS y1 FROM ctr)"
)
_A = "ag AS (SELECT c_custkey AS k, ((c_custkey * c_custkey * 7919) % 30001) / 100.0::DOUBLE AS x, ((c_custkey * c_custkey * c_custkey) % 29989) / 100.0::DOUBLE AS y FROM customer)"
_F = "fr AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events)"
_V = (
    "cells AS (SELECT DISTINCT floor(x / 512)::BIGINT AS cx, floor(y / 512)::BIGINT AS cy FROM pts), city AS (SELECT (cy + 64) * 128 + cx + 64 AS v, cx, cy FROM cells), "
    "city_edges AS (SELECT p.v AS a, q.v AS b FROM city p JOIN city q ON abs(p.cx - q.cx) + abs(p.cy - q.cy) = 1 WHERE (p.v + q.v) % 3 <> 0)"
)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# points, boxes and cells ---------------------------------------------------------------------------------------------


@query(f"WITH {_P}, {_B} SELECT b, count(*) AS n FROM pts JOIN boxes ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY b")
def point_in_box_count(spark, d):
    return spatial.counts_in_boxes(points(spark, d), boxes(spark, d))


@query(
    f"WITH {_P}, {_B}, m AS (SELECT k, count(b) AS n FROM pts LEFT JOIN boxes ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY k) "
    "SELECT count(*) FILTER (n = 0) AS zero_matches, count(*) FILTER (n > 1) AS multi_matches, count(*) AS n_points FROM m"
)
def location_qa(spark, d):
    n = spatial.holders(points(spark, d), boxes(spark, d))
    return n.agg(F.count_if(C("n") == 0).alias("zero_matches"), F.count_if(C("n") > 1).alias("multi_matches"), F.count("*").alias("n_points"))


@query(f"WITH {_P}, {_B} SELECT k, min(b) AS first_box FROM pts JOIN boxes ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY k")
def point_first_box(spark, d):
    return spatial.first_box(points(spark, d), boxes(spark, d)).withColumnRenamed("b", "first_box")


@query(
    f"WITH {_P}, {_B}, t AS (SELECT 2 * b AS tid, x0 AS ax, y0 AS ay, x1 AS bx, y0 AS by_, x1 AS cx, y1 AS cy FROM boxes UNION ALL SELECT 2 * b + 1, x0, y0, x1, y1, x0, y1 FROM boxes) "
    "SELECT k, min(tid) AS tid FROM pts JOIN t ON (bx - ax) * (y - ay) - (by_ - ay) * (x - ax) >= 0 AND (cx - bx) * (y - by_) - (cy - by_) * (x - bx) >= 0 AND (ax - cx) * (y - cy) - (ay - cy) * (x - cx) >= 0 GROUP BY k"
)
def point_in_triangle(spark, d):
    half = lambda i: F.struct((2 * C("b") + i).alias("tid"), C("x0").alias("ax"), C("y0").alias("ay"), C("x1").alias("bx"), C("y1" if i else "y0").alias("by"), C("x0" if i else "x1").alias("cx"), C("y1").alias("cy"))
    t = boxes(spark, d).select("x0", "y0", "x1", "y1", F.inline(F.array(half(0), half(1)))).withColumnsRenamed({"ax": "tax", "ay": "tay", "bx": "tbx", "by": "tby", "cx": "tcx", "cy": "tcy"})
    side = lambda a, b: lambda x, y: g.side(x, y, C(f"t{a}x"), C(f"t{a}y"), C(f"t{b}x"), C(f"t{b}y"))
    sides = [side("a", "b"), side("b", "c"), side("c", "a")]
    p = points(spark, d)
    at, cells = spatial.graded_cells(spatial.places(p), t)
    inside = reduce(lambda u, v: u & v, [f(C("x"), C("y")) >= 0 for f in sides])
    return spatial.least_holder(p, at, spatial.with_whole(cells, sides, 1e-3), "tid", inside, ["_class", "cx", "cy"])


@query(f"WITH {_P} SELECT k, floor(x / 64)::BIGINT AS cx, floor(y / 64)::BIGINT AS cy FROM pts")
def grid_cell(spark, d):
    return points(spark, d).select("k", g.cell(C("x"), 64.0).alias("cx"), g.cell(C("y"), 64.0).alias("cy"))


@query(f"WITH {_P} SELECT k, greatest(least(floor((x + 10000) / (20000 / 64.0::DOUBLE)), 63), 0)::BIGINT AS tx, greatest(least(floor((y + 10000) / (20000 / 64.0::DOUBLE)), 63), 0)::BIGINT AS ty FROM pts")
def tile_coord(spark, d):
    return points(spark, d).select("k", g.tile(C("x"), 10000.0, 64).alias("tx"), g.tile(C("y"), 10000.0, 64).alias("ty"))


@query(f"WITH {_P} SELECT k, x, y FROM pts WHERE x BETWEEN -2000 AND 2000 AND y BETWEEN -2000 AND 2000")
def filter_bbox(spark, d):
    return points(spark, d).where(C("x").between(-2000, 2000) & C("y").between(-2000, 2000))


@query(f"WITH {_B} SELECT a.b AS area, c.b FROM boxes a JOIN boxes c ON a.x0 <= c.x1 AND c.x0 <= a.x1 AND a.y0 <= c.y1 AND c.y0 <= a.y1 WHERE a.b % 50 = 0")
def area_query(spark, d):
    b = boxes(spark, d)
    areas = b.where("b % 50 = 0").select(C("b").alias("area"), *[C(c).alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")])
    return spatial.boxes_in_areas(b, areas)


@query(f"WITH {_B} SELECT a.b AS area, c.b FROM boxes a JOIN boxes c ON a.x0 - 100 <= c.x1 AND c.x0 <= a.x1 + 100 AND a.y0 - 100 <= c.y1 AND c.y0 <= a.y1 + 100 WHERE a.b <> c.b")
def neighbourhood(spark, d):
    b = boxes(spark, d)
    areas = b.select(C("b").alias("area"), *[(C(c) + (-100 if c[1] == "0" else 100)).alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")])
    return spatial.boxes_in_areas(b, areas).where("area <> b")


@query(f"WITH {_P} SELECT p.k AS a, q.k AS b, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) AS d2 FROM pts p JOIN pts q ON p.k < q.k AND abs(p.x - q.x) <= 160 AND abs(p.y - q.y) <= 160 WHERE (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 25600")
def pairs_within(spark, d):
    return spatial.pairs_within(points(spark, d), 160.0)


_CP = f"{_A}, cp AS (SELECT *, floor(x / 128) AS cx, floor(y / 128) AS cy FROM ag), cq AS (SELECT *, row_number() OVER (PARTITION BY cx, cy ORDER BY k) AS o FROM cp), ce AS (SELECT * FROM cq WHERE o <= 256), co AS (SELECT p.k AS a, q.k AS b, q.x - p.x AS dx, q.y - p.y AS dy FROM ce p JOIN ce q ON p.cx = q.cx AND p.cy = q.cy AND p.k < q.k), cd AS (SELECT *, dx * dx + dy * dy AS d2 FROM co WHERE dx * dx + dy * dy > 0.001 AND dx * dx + dy * dy < 25)"


@query(f"WITH {_CP} SELECT a, b, d2 FROM cd")
def collision_pairs(spark, d):
    return spatial.collisions(agents(spark, d)).select("a", "b", "d2")


@query(
    f"WITH {_CP}, ps AS (SELECT a AS k, -dx * ((5 - sqrt(d2)) / sqrt(d2) / 2) AS fx, -dy * ((5 - sqrt(d2)) / sqrt(d2) / 2) AS fy FROM cd UNION ALL SELECT b, dx * ((5 - sqrt(d2)) / sqrt(d2) / 2), dy * ((5 - sqrt(d2)) / sqrt(d2) / 2) FROM cd) "
    "SELECT k, floor(sum(fx) * 1000 + 0.5)::BIGINT AS fx_mm, floor(sum(fy) * 1000 + 0.5)::BIGINT AS fy_mm FROM ps GROUP BY k"
)
def collision_push(spark, d):
    p = spatial.pushes(spatial.collisions(agents(spark, d)))
    return p.select("k", F.floor(C("fx") * 1000 + 0.5).alias("fx_mm"), F.floor(C("fy") * 1000 + 0.5).alias("fy_mm"))


_S = "sup AS (SELECT s_suppkey AS q, ((s_suppkey * 15485863) % 2000001 - 1000000) / 100.0::DOUBLE AS x, ((s_suppkey * 32452843) % 2000001 - 1000000) / 100.0::DOUBLE AS y FROM supplier)"


def _suppliers(spark, d):
    at = lambda f: (F.pmod(C("s_suppkey") * f, F.lit(2000001)) - 1000000) / F.lit(100.0)
    return table(spark, d, "supplier").select(C("s_suppkey").alias("q"), at(15485863).alias("x"), at(32452843).alias("y"))


@query(
    f"WITH {_P}, {_S}, a AS (SELECT q, k, (pts.x - sup.x) * (pts.x - sup.x) + (pts.y - sup.y) * (pts.y - sup.y) AS d2 FROM sup, pts), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, k) AS o FROM a) SELECT q, k, d2 FROM r WHERE o = 1"
)
def nearest_neighbour(spark, d):
    return spatial.nearest(_suppliers(spark, d), points(spark, d))


@query(f"WITH {_P}, {_S} SELECT q, min(k) AS k FROM sup JOIN pts ON (pts.x - sup.x) * (pts.x - sup.x) + (pts.y - sup.y) * (pts.y - sup.y) <= 250000 GROUP BY q")
def radius_pick(spark, d):
    return spatial.least_within(_suppliers(spark, d), points(spark, d), 500.0)


# expressions ---------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, floor(c_acctbal * 10 + 0.5) / 10 AS r1, floor(c_acctbal / 3 * 100 + 0.5) / 100 AS r2 FROM customer")
def round_js(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", g.round_half_up(C("c_acctbal"), 1).alias("r1"), g.round_half_up(C("c_acctbal") / 3, 2).alias("r2"))


@query(
    "SELECT o_orderkey AS k, floor(radians(76.948339::DOUBLE + (o_orderkey % 2001 - 1000) / 20000.0::DOUBLE - 76.948339) * (6371000.0::DOUBLE * cos(radians(43.242502::DOUBLE))) * 100 + 0.5)::BIGINT AS x_cm, "
    "floor(radians(43.242502::DOUBLE + (o_orderkey % 1999 - 1000) / 20000.0::DOUBLE - 43.242502) * 6371000.0::DOUBLE * 100 + 0.5)::BIGINT AS y_cm FROM orders"
)
def project_lonlat(spark, d):
    o = table(spark, d, "orders")
    lon = F.lit(g.ORIGIN_LON) + (C("o_orderkey") % 2001 - 1000) / F.lit(20000.0)
    lat = F.lit(g.ORIGIN_LAT) + (C("o_orderkey") % 1999 - 1000) / F.lit(20000.0)
    p = g.project(lon, lat)
    return o.select(C("o_orderkey").alias("k"), F.floor(p["x"] * 100 + 0.5).alias("x_cm"), F.floor(p["y"] * 100 + 0.5).alias("y_cm"))


def _rings(spark, d):
    """A clockwise quadrilateral and its box's number."""
    b = boxes(spark, d)
    return b.select("b", F.array(g.point(C("x0"), C("y0")), g.point(C("x0"), C("y1")), g.point(C("x1"), C("y1") + 4), g.point(C("x1"), C("y0"))).alias("ring"))


_RING = "rg AS (SELECT b, x0 AS px0, y0 AS py0, x0 AS px1, y1 AS py1, x1 AS px2, y1 + 4 AS py2, x1 AS px3, y0 AS py3 FROM boxes)"


@query(
    f"WITH {_B}, {_RING} SELECT b, floor((((px0 * py1 - px1 * py0) + (px1 * py2 - px2 * py1) + (px2 * py3 - px3 * py2) + (px3 * py0 - px0 * py3)) / 2) * 10 + 0.5)::BIGINT AS area_dm, "
    "floor(abs(((px0 * py1 - px1 * py0) + (px1 * py2 - px2 * py1) + (px2 * py3 - px3 * py2) + (px3 * py0 - px0 * py3)) / 2) * 10 + 0.5)::BIGINT AS fixed_dm FROM rg"
)
def shoelace_area(spark, d):
    r = _rings(spark, d)
    return r.select("b", F.floor(g.signed_area(C("ring")) * 10 + 0.5).alias("area_dm"), F.floor(g.signed_area(g.counter_clockwise(C("ring"))) * 10 + 0.5).alias("fixed_dm"))


@query(f"WITH {_B}, {_RING} SELECT b, px3 AS first_x, py3 AS first_y, floor((px0 + px1 + px2 + px3) / 4 * 100 + 0.5)::BIGINT AS mean_x_cm, floor((py0 + py1 + py2 + py3) / 4 * 100 + 0.5)::BIGINT AS mean_y_cm FROM rg")
def winding_fix_and_mean(spark, d):
    r = _rings(spark, d).select("b", g.counter_clockwise(C("ring")).alias("ring"))
    m = g.vertex_mean(C("ring"))
    return r.select("b", C("ring")[0]["x"].alias("first_x"), C("ring")[0]["y"].alias("first_y"), F.floor(m["x"] * 100 + 0.5).alias("mean_x_cm"), F.floor(m["y"] * 100 + 0.5).alias("mean_y_cm"))


@query(f"WITH {_B} SELECT b, x0 AS first_x, y0 AS first_y, true AS convex FROM boxes")
def ring_canonical(spark, d):
    b = boxes(spark, d)
    ring = F.array(g.point(C("x1"), C("y1")), g.point(C("x0"), C("y1")), g.point(C("x0"), C("y0")), g.point(C("x1"), C("y0")))
    r = b.select("b", g.canonical(ring).alias("ring"))
    return r.select("b", C("ring")[0]["x"].alias("first_x"), C("ring")[0]["y"].alias("first_y"), g.is_convex(C("ring")).alias("convex"))


@query(
    f"WITH {_P}, u AS (SELECT k, x, y, greatest(0, least(1, ((x + 5000) * 9000 + (y + 4000) * 7000) / (9000.0::DOUBLE * 9000 + 7000.0::DOUBLE * 7000))) AS t FROM pts) "
    "SELECT k, floor(sqrt((x - (-5000 + t * 9000)) * (x - (-5000 + t * 9000)) + (y - (-4000 + t * 7000)) * (y - (-4000 + t * 7000))) * 100 + 0.5)::BIGINT AS d_cm FROM u"
)
def seg_distance(spark, d):
    dist = g.segment_distance(C("x"), C("y"), F.lit(-5000.0), F.lit(-4000.0), F.lit(4000.0), F.lit(3000.0))
    return points(spark, d).select("k", F.floor(dist * 100 + 0.5).alias("d_cm"))


@query(f"WITH {_B} SELECT b, floor((x0 + x1) / 2 * 100 + 0.5)::BIGINT AS x_cm, floor((y0 + y1) / 2 * 100 + 0.5)::BIGINT AS y_cm FROM boxes WHERE x1 > x0")
def seg_intersection(spark, d):
    m = g.segment_meeting(C("x0"), C("y0"), C("x1"), C("y1"), C("x0"), C("y1"), C("x1"), C("y0"))
    return boxes(spark, d).select("b", m.alias("m")).where("m is not null").select("b", F.floor(C("m.x") * 100 + 0.5).alias("x_cm"), F.floor(C("m.y") * 100 + 0.5).alias("y_cm"))


# rules ---------------------------------------------------------------------------------------------------------------


def _tagged(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", F.create_map(
        F.lit("building"), F.when(C("p_size") % 3 == 0, F.lit("yes")).otherwise(F.lower("p_brand")),
        F.lit("name"), F.when(C("p_size") % 5 == 0, F.lit("")).otherwise(C("p_name")),
        F.lit("official_name"), C("p_type"),
        F.when(C("p_size") % 2 == 0, F.lit("shop")).otherwise(F.lit("payment:cash")), F.lit(""),
    ).alias("props"), "p_size", "p_brand", "p_type")


@query(
    "SELECT p_partkey, CASE WHEN p_size % 5 = 0 OR p_name = '' THEN p_type ELSE p_name END AS name, CASE WHEN p_size % 3 = 0 THEN 'commercial' ELSE lower(p_brand) END AS building, "
    "CASE WHEN p_size % 3 = 0 THEN CASE WHEN p_size % 2 = 0 THEN 'shop' ELSE 'payment:cash' END END AS triggers FROM part"
)
def refine_category(spark, d):
    t = _tagged(spark, d)
    kind, why = rules.refine(C("props"), rules.tag(C("props"), "building"), {"commercial": (["shop", "office"], ["payment:"]), "amenity": (["amenity"], [])})
    return t.select("p_partkey", rules.first_of(C("props"), ["name", "official_name"]).alias("name"), kind.alias("building"), why.alias("triggers"))


@query(
    "WITH r AS (SELECT CASE WHEN p_size % 3 = 0 THEN 'refined' WHEN p_size % 5 = 0 THEN 'renamed' END AS rule, p_brand AS trigger FROM part) SELECT 'building' AS section, rule, trigger, count(*) AS n FROM r WHERE rule IS NOT NULL GROUP BY ALL"
)
def rule_log(spark, d):
    t = _tagged(spark, d)
    rule = F.when(C("p_size") % 3 == 0, F.lit("refined")).when(C("p_size") % 5 == 0, F.lit("renamed"))
    return rules.rule_log(t.select(F.lit("building").alias("section"), rule.alias("rule"), C("p_brand").alias("trigger")), "section", "rule", "trigger")


@query(
    "WITH a AS (SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey::VARCHAR END AS m, CASE WHEN c_custkey % 4 > 0 THEN (c_custkey % 7)::VARCHAR END AS o, CASE WHEN c_custkey % 5 = 0 THEN 'B' END AS u FROM customer), "
    "b AS (SELECT *, CASE WHEN m IS NOT NULL AND o IS NOT NULL AND m <> o THEN m || '/' || o ELSE coalesce(m, o) END AS n FROM a) "
    "SELECT c_custkey, CASE WHEN u IS NULL THEN n WHEN n IS NULL THEN u ELSE n || '-' || u END AS num FROM b"
)
def house_number(spark, d):
    c = table(spark, d, "customer")
    k = C("c_custkey")
    return c.select(k, rules.house_number(F.when(k % 3 > 0, C("c_nationkey").cast("string")), F.when(k % 4 > 0, (k % 7).cast("string")), F.when(k % 5 == 0, F.lit("B"))).alias("num"))


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 'home' WHEN c_mktsegment = 'MACHINERY' THEN 'industrial' ELSE 'amenity' END AS category FROM customer")
def map_category(spark, d):
    return table(spark, d, "customer").select("c_custkey", rules.category(C("c_mktsegment"), {"home": ["BUILDING", "HOUSEHOLD"], "industrial": ["MACHINERY"]}, "amenity").alias("category"))


@query("SELECT 'M' || n_regionkey || o AS id, CAST(o AS INT) AS part_no, n_name AS part FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS o FROM nation)")
def explode_parts(spark, d):
    n = table(spark, d, "nation").groupBy(C("n_regionkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda s: s["n_name"]).alias("parts"))
    return rules.exploded_parts(n)


@query(
    "WITH e AS (SELECT 'segment' AS key, c_mktsegment AS value FROM customer UNION ALL SELECT 'nation', c_nationkey::VARCHAR FROM customer), c AS (SELECT key, value, count(*) AS n FROM e GROUP BY ALL), "
    "k AS (SELECT key, sum(n)::BIGINT AS present, count(*) AS n_values FROM c GROUP BY key), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS o FROM c) "
    "SELECT k.key, present, n_values, value, n FROM r JOIN k USING (key) WHERE o <= 12"
)
def profile_columns(spark, d):
    props = F.create_map(F.lit("segment"), C("c_mktsegment"), F.lit("nation"), C("c_nationkey").cast("string"))
    return rules.profile(table(spark, d, "customer").select(props.alias("props")), "props", 12)


# sequences and windows -----------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, coalesce(sum(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM lineitem")
def csr_offsets(spark, d):
    li = table(spark, d, "lineitem").withColumn("o", F.struct("l_linenumber", "l_partkey"))
    return li.select("l_orderkey", "l_linenumber", seq.exclusive_sum("l_partkey", "o", by=["l_orderkey"]).cast("long").alias("at"))


@query("SELECT c_nationkey, c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1 AS INT) AS no FROM customer")
def dense_renumber(spark, d):
    return seq.renumbered(table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_acctbal"), ["c_nationkey"], F.desc("c_acctbal"), "c_custkey").drop("c_acctbal")


@query(
    "WITH o AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, ts FROM events) SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS path FROM o WHERE b IS DISTINCT FROM event_type GROUP BY user_id"
)
def dedup_consecutive(spark, d):
    e = seq.without_repeats(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type")
    steps = F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type")))  # the answer is one text for each user
    return e.groupBy("user_id").agg(F.array_join(F.transform(steps, lambda s: s["event_type"]), ">").alias("path"))


@query(
    "WITH o AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events) SELECT user_id, island::BIGINT AS island, count(*) AS n FROM o WHERE event_type <> 'error' GROUP BY ALL"
)
def islands(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return seq.islands(e, "user_id", ["ts", "event_id"], C("event_type") != "error").groupBy("user_id", "island").agg(F.count("*").alias("n"))


@query(f"WITH {_A}, c AS (SELECT k, row_number() OVER (PARTITION BY floor(x / 128), floor(y / 128) ORDER BY k) AS o FROM ag) SELECT k FROM c WHERE o <= 16")
def cap_per_cell(spark, d):
    return spatial.capped_cells(agents(spark, d), 128.0, 16).select("k")


@query(
    "WITH r AS (SELECT p_brand, p_partkey, sum(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS run, sum(p_size) OVER (PARTITION BY p_brand) AS al FROM part), m AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS o FROM r WHERE run >= 0.6::DOUBLE * al) SELECT p_brand, p_partkey FROM m WHERE o = 1"
)
def weighted_pick(spark, d):
    return seq.weighted_pick(table(spark, d, "part").select("p_brand", "p_partkey", "p_size"), "p_brand", "p_size", "p_partkey", 0.6).select("p_brand", "p_partkey")


_H = 3_600_000_000


@query(
    f"WITH {_F}, w AS (SELECT *, count(*) OVER v AS n, min(us) OVER v AS f FROM fr WINDOW v AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN {10 * _H} PRECEDING AND CURRENT ROW)) "
    "SELECT user_id, event_id, n, CASE WHEN n < 2 OR us = f THEN 0 ELSE floor((n - 1) * 1e9::DOUBLE / (us - f) + 0.5)::BIGINT END AS rate FROM w"
)
def fps_window(spark, d):
    return seq.sliding_rate(frames(spark, d), 10 * _H).select("user_id", "event_id", "n", "rate")


@query(
    f"WITH {_F}, l AS (SELECT *, lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS b FROM fr) SELECT c.user_id, c.event_id, coalesce(max(CASE WHEN p.us - p.b <= {2 * _H} AND p.b >= c.us - {10 * _H} THEN p.us - p.b END), 0)::BIGINT AS gap "
    f"FROM l c JOIN l p ON c.user_id = p.user_id AND p.us BETWEEN c.us - {10 * _H} AND c.us GROUP BY ALL"
)
def max_gap(spark, d):
    return seq.largest_gap(frames(spark, d), 10 * _H, 2 * _H).select("user_id", "event_id", C("gap").cast("long").alias("gap"))


@query(
    f"WITH {_F}, l AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS s FROM fr), r AS (SELECT *, CASE WHEN s > {5 * _H} THEN 0 WHEN s >= {_H // 60} THEN floor(1e9::DOUBLE / s)::BIGINT END AS r FROM l) "
    "SELECT user_id, event_id, coalesce(last_value(r IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::BIGINT AS rate_m FROM r"
)
def instant_rate(spark, d):
    return seq.instant_rate(frames(spark, d), _H // 60, 5 * _H).select("user_id", "event_id", C("rate_m").cast("long").alias("rate_m"))


# aggregates, orders, sets --------------------------------------------------------------------------------------------


@query(f"WITH {_P} SELECT min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM pts")
def bbox_agg(spark, d):
    return points(spark, d).agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


@query(
    "WITH s AS (SELECT count(*) AS n FROM orders GROUP BY o_custkey) SELECT count(*) AS groups, max(n) AS largest, quantile_cont(n, 0.5)::DOUBLE AS median, avg(n) AS mean, count(*) FILTER (n = 1) AS singles, "
    "array_to_string((SELECT list(n ORDER BY n DESC) FROM s)[1:5], ',') AS top5 FROM s"
)
def group_median_top5(spark, d):
    return mesh.group_sizes(table(spark, d, "orders"), "o_custkey")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type")
def histogram_desc(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice / p_size, p_size DESC, p_partkey) AS o FROM part) SELECT p_brand, p_partkey FROM r WHERE o = 1")
def argmin_tiebreak(spark, d):
    least = F.min(F.struct((C("p_retailprice") / C("p_size")).alias("r"), (-C("p_size")).alias("s"), C("p_partkey")))
    return table(spark, d, "part").groupBy("p_brand").agg(least.alias("m")).select("p_brand", "m.p_partkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def topk(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT 'customer' AS kind, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier")
def union_tagged(spark, d):
    a = table(spark, d, "customer").select(F.lit("customer").alias("kind"), C("c_custkey").alias("id"))
    return a.unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("kind"), C("s_suppkey").alias("id")))


@query("SELECT DISTINCT l_suppkey FROM lineitem")
def distinct_ids(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey").distinct()


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderkey % 4 = 0)")
def except_ids(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").where("o_orderstatus = 'P' and o_orderkey % 4 = 0").select(C("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query(
    "SELECT event_id, (event_id % 65536) + (user_id % 65536) * 65536 AS word, event_id % 65536 AS low, user_id % 65536 AS high, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"
)
def event_pack(spark, d):
    word = F.shiftleft(C("user_id") % 65536, 16).bitwiseOR(C("event_id") % 65536)
    e = table(spark, d, "events").select("event_id", word.alias("word"), F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.select("event_id", "word", C("word").bitwiseAND(65535).alias("low"), F.shiftright("word", 16).alias("high"), "k")


# mesh and graph ------------------------------------------------------------------------------------------------------

_T = f"{_P}, {_V}, tr AS (SELECT 2 * v AS tid, v AS v1, v + 1 AS v2, v + 129 AS v3 FROM city UNION ALL SELECT 2 * v + 1, v, v + 129, v + 128 FROM city)"


def _triangles(spark, d):
    c = city(spark, d)
    return c.select((2 * C("v")).alias("tid"), C("v").alias("v1"), (C("v") + 1).alias("v2"), (C("v") + 129).alias("v3")).union(c.select(2 * C("v") + 1, "v", C("v") + 129, C("v") + 128))


@query(
    f"WITH {_T}, e AS (SELECT tid, 0 AS e, least(v1, v2) AS lo, greatest(v1, v2) AS hi FROM tr UNION ALL SELECT tid, 1, least(v2, v3), greatest(v2, v3) FROM tr UNION ALL SELECT tid, 2, least(v3, v1), greatest(v3, v1) FROM tr) "
    "SELECT tid, e, (CASE WHEN count(*) OVER w = 2 THEN sum(tid) OVER w - tid ELSE -1 END)::BIGINT AS neighbour FROM e WINDOW w AS (PARTITION BY lo, hi)"
)
def tri_neighbours(spark, d):
    return mesh.triangle_neighbours(_triangles(spark, d))


@query(f"WITH {_P}, s AS (SELECT DISTINCT floor(x * 100 + 0.5)::BIGINT AS sx, floor(y * 100 + 0.5)::BIGINT AS sy FROM pts) SELECT sx, sy, row_number() OVER (ORDER BY sx - ((sx % 100000) + 100000) % 100000, sx, sy) - 1 AS vid FROM s")
def vertex_dictionary(spark, d):
    return mesh.vertex_dictionary(points(spark, d))


@query("SELECT unnest(range(p_partkey * 100, p_partkey * 100 + p_size)) AS item, p_partkey FROM part")
def range_expand(spark, d):
    p = table(spark, d, "part").select("p_partkey", (C("p_partkey") * 100).alias("s"), (C("p_partkey") * 100 + C("p_size")).alias("e"))
    return mesh.expanded_ranges(p, "p_partkey", "s", "e")


@query("SELECT l.l_partkey % 97 AS bucket, count(*) AS unmatched FROM lineitem l LEFT JOIN part p ON l.l_partkey * 2 = p.p_partkey WHERE p.p_partkey IS NULL GROUP BY 1")
def unmatched_report(spark, d):
    li = table(spark, d, "lineitem").select("l_partkey", (C("l_partkey") * 2).alias("p_partkey"))
    return li.join(table(spark, d, "part").select("p_partkey"), "p_partkey", "left_anti").groupBy((C("l_partkey") % 97).alias("bucket")).agg(F.count("*").alias("unmatched"))


def _edges(spark, d):
    c = city(spark, d)
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    e = c.select(C("v").alias("a"), "cx", "cy", F.explode(steps).alias("s")).select("a", (C("cx") + C("s.i")).alias("cx"), (C("cy") + C("s.j")).alias("cy"))
    return e.join(c.select(C("v").alias("b"), "cx", "cy"), ["cx", "cy"]).where((C("a") + C("b")) % 3 != 0).select("a", "b")


@query(f"WITH RECURSIVE {_P}, {_V}, r(v, l) AS (SELECT v, v FROM city UNION SELECT r.v, e.b FROM r JOIN city_edges e ON e.a = r.l) SELECT v, min(l) AS label FROM r GROUP BY v")
def components(spark, d):
    return graph.components(city(spark, d).select("v"), _edges(spark, d))


@query(
    f"WITH RECURSIVE {_P}, {_V}, h(v, hops) AS (SELECT min(v), 0 FROM city UNION SELECT e.b, h.hops + 1 FROM h JOIN city_edges e ON e.a = h.v WHERE h.hops < 8) SELECT v, min(hops) AS hops FROM h GROUP BY v"
)
def hop_bfs(spark, d):
    """Cells within eight steps of the first; hop_distances has no such limit."""
    return graph.hops(city(spark, d).agg(F.min("v").alias("v")), _edges(spark, d), most=8)


@query()
def hop_distances(spark, d):
    """hop_bfs to the end: every cell that can be reached, however far; the tests hold it against a plain version."""
    return graph.hops(city(spark, d).agg(F.min("v").alias("v")), written(_edges(spark, d), "edges"))


@query(f"WITH {_P}, {_V} SELECT DISTINCT p.a, q.b AS c FROM city_edges p JOIN city_edges q ON p.b = q.a WHERE p.a <> q.b AND NOT EXISTS (SELECT 1 FROM city_edges x WHERE x.a = p.a AND x.b = q.b)")
def two_hop(spark, d):
    return graph.two_hop_neighbours(_edges(spark, d))


@query()
def route_costs(spark, d):
    """Cheapest routes from the first cell; the tests hold it against a plain version."""
    e = _edges(spark, d).withColumn("cost", (1 + F.pmod(C("a") * 31 + C("b") * 17, F.lit(7))).cast("double"))
    return graph.route_costs(city(spark, d).agg(F.min("v").alias("v")), e)


@query(
    "WITH o AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT user_id, floor(sum(abs(value - b)) * 100 + 0.5)::BIGINT AS length_cm FROM o WHERE b IS NOT NULL GROUP BY user_id"
)
def path_length(spark, d):
    from pyspark.sql import Window

    b = F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = table(spark, d, "events").select("user_id", F.abs(C("value") - b).alias("s")).where("s is not null")
    return e.groupBy("user_id").agg(F.floor(F.sum("s") * 100 + 0.5).alias("length_cm"))


@query()
def spawn_schedule(spark, d):
    e = table(spark, d, "events").select(C("user_id").alias("spawner"), C("event_id").alias("t"), (C("event_id") % 7).cast("double").alias("dt"))
    return simulation.spawn_schedule(e, 10.0)


@query()
def stuck_score(spark, d):
    e = table(spark, d, "events").select(C("user_id").alias("agent"), C("event_id").alias("t"), C("event_type").alias("target"), (C("value") > 50).alias("moved"))
    return simulation.stuck_score(e)


@query(f"WITH {_B}, t AS (SELECT *, unnest(range(floor(x0 / 512)::BIGINT, floor(x1 / 512)::BIGINT + 1)) AS tx FROM boxes), u AS (SELECT *, unnest(range(floor(y0 / 512)::BIGINT, floor(y1 / 512)::BIGINT + 1)) AS ty FROM t) SELECT b, tx, ty, greatest(x0, tx * 512.0::DOUBLE) AS x0, greatest(y0, ty * 512.0::DOUBLE) AS y0, least(x1, (tx + 1) * 512.0::DOUBLE) AS x1, least(y1, (ty + 1) * 512.0::DOUBLE) AS y1 FROM u")
def clip_tiles(spark, d):
    return polygons.clipped_boxes(boxes(spark, d), 512.0)


@query()
def convex_hull(spark, d):
    """Hulls of the points of each customer; the tests hold them against a plain version."""
    p = points(spark, d).join(table(spark, d, "orders").select(C("o_orderkey").alias("k"), C("o_custkey").alias("c")), "k")
    return polygons.convex_hulls(p, "c")


@query("SELECT p_partkey AS id, CAST(4 AS INT) AS n_vertices, CASE WHEN p_partkey % 3 = 0 THEN 'copy,name' ELSE 'name' END AS keys FROM part")
def dedup_features(spark, d):
    """Boxes and copies of a third of them shifted by 0.5 m."""
    b = boxes(spark, d)
    ring = lambda s: F.array(g.point(C("x0") + s, C("y0")), g.point(C("x1") + s, C("y0")), g.point(C("x1") + s, C("y1")), g.point(C("x0") + s, C("y1")))
    one = b.select(C("b").alias("id"), ring(0.0).alias("ring"), F.create_map(F.lit("name"), C("b").cast("string")).alias("props"))
    two = b.where("b % 3 = 0").select((C("b") + 10**9).alias("id"), ring(0.5).alias("ring"), F.create_map(F.lit("copy"), F.lit("yes")).alias("props"))
    out = dedup.deduplicated(one.union(two))
    return out.select("id", F.size("ring").alias("n_vertices"), F.array_join(F.array_sort(F.map_keys("props")), ",").alias("keys"))


@query(f"WITH {_P} SELECT k FROM pts WHERE ((floor(x / 64)::BIGINT % 2) + 2) % 2 = 0 AND ((floor(y / 64)::BIGINT % 2) + 2) % 2 = 1")
def checkerboard(spark, d):
    even = lambda c: F.pmod(g.cell(C(c), 64.0), F.lit(2))
    return points(spark, d).where((even("x") == 0) & (even("y") == 1)).select("k")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 36 HOUR")
def ttl_filter(spark, d):
    e = table(spark, d, "events").select("event_id", "ts")
    newest = e.agg(F.max("ts").alias("newest"))
    return e.join(F.broadcast(newest)).where(C("ts") >= C("newest") - F.expr("INTERVAL 36 HOURS")).select("event_id")


@query("SELECT n_name AS name, CAST(row_number() OVER (ORDER BY n_name) - 1 AS INT) AS sprite_id, (n_nationkey % 8) / 8.0::DOUBLE AS u0, floor(n_nationkey / 8) / 8.0::DOUBLE AS v0 FROM nation")
def sprite_ids(spark, d):
    from pyspark.sql import Window

    n = table(spark, d, "nation")
    no = F.row_number().over(Window.orderBy("n_name")) - 1
    return n.select(C("n_name").alias("name"), no.alias("sprite_id"), ((C("n_nationkey") % 8) / F.lit(8.0)).alias("u0"), (F.floor(C("n_nationkey") / 8) / F.lit(8.0)).alias("v0"))


@query("WITH l AS (SELECT event_id, '[' || event_id || '] Started traveling. nextCorner: (' || user_id || ', ' || (event_id % 100) || ')' AS line FROM events) SELECT event_id, CAST(regexp_extract(line, 'nextCorner: \\(([0-9.-]+), ([0-9.-]+)\\)', 1) AS DOUBLE) AS x, CAST(regexp_extract(line, 'nextCorner: \\(([0-9.-]+), ([0-9.-]+)\\)', 2) AS DOUBLE) AS y FROM l")
def log_regex(spark, d):
    e = table(spark, d, "events")
    line = F.concat(F.lit("["), C("event_id").cast("string"), F.lit("] Started traveling. nextCorner: ("), C("user_id").cast("string"), F.lit(", "), (C("event_id") % 100).cast("string"), F.lit(")"))
    part = lambda i: F.regexp_extract(line, r"nextCorner: \(([0-9.-]+), ([0-9.-]+)\)", i).cast("double")
    return e.select("event_id", part(1).alias("x"), part(2).alias("y"))


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def marked_pairs(spark, d):
    s = table(spark, d, "supplier")
    return s.select(C("s_suppkey").alias("a"), "s_nationkey").join(s.select(C("s_suppkey").alias("b"), "s_nationkey"), "s_nationkey").where("a < b").select("a", "b")


@query(
    f"WITH {_T}, v AS (SELECT tid, v1, v2, v3 FROM tr WHERE greatest(v1 % 128, v2 % 128, v3 % 128) >= 60 AND least(v1 % 128, v2 % 128, v3 % 128) <= 70 AND greatest(v1 // 128, v2 // 128, v3 // 128) >= 60 AND least(v1 // 128, v2 // 128, v3 // 128) <= 70), "
    "e AS (SELECT least(v1, v2) AS lo, greatest(v1, v2) AS hi FROM v UNION SELECT least(v2, v3), greatest(v2, v3) FROM v UNION SELECT least(v3, v1), greatest(v3, v1) FROM v) SELECT lo, hi FROM e"
)
def viewport_edges(spark, d):
    """Distinct edges of the triangles whose box meets a window."""
    corner = lambda f, part: f(*[part(C(c)) for c in ("v1", "v2", "v3")])
    col, row = (lambda v: v % 128), (lambda v: F.floor(v / 128))
    t = _triangles(spark, d).where((corner(F.greatest, col) >= 60) & (corner(F.least, col) <= 70) & (corner(F.greatest, row) >= 60) & (corner(F.least, row) <= 70))
    return mesh.triangle_edges(t).select("lo", "hi").distinct()


@query(
    "WITH m AS (SELECT o_orderkey % 5000 AS tid, o_custkey AS poly FROM orders), n AS (SELECT tid, count(DISTINCT poly) AS n FROM m GROUP BY tid) "
    "SELECT (SELECT count(*) FROM n WHERE n > 1) AS duplicates, (SELECT count(*) FROM range(5000) t(i) WHERE i NOT IN (SELECT tid FROM m)) AS orphans, (SELECT count(*) FROM m WHERE poly NOT IN (SELECT c_custkey FROM customer)) AS out_of_range"
)
def mapping_validation(spark, d):
    m = table(spark, d, "orders").select((C("o_orderkey") % 5000).alias("tid"), C("o_custkey").alias("poly"))
    duplicates = m.distinct().groupBy("tid").count().where(C("count") > 1).agg(F.count("*").alias("duplicates"))
    orphans = spark.range(5000).select(C("id").alias("tid")).join(m, "tid", "left_anti").agg(F.count("*").alias("orphans"))
    outside = m.join(table(spark, d, "customer").select(C("c_custkey").alias("poly")), "poly", "left_anti").agg(F.count("*").alias("out_of_range"))
    return duplicates.join(F.broadcast(orphans)).join(F.broadcast(outside))


@query(
    f"WITH {_P}, c AS (SELECT k, x, y, avg(x) OVER w AS mx, avg(y) OVER w AS my, floor(x / 2048)::BIGINT AS gx, floor(y / 2048)::BIGINT AS gy FROM pts WINDOW w AS (PARTITION BY floor(x / 2048), floor(y / 2048))), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY gx, gy ORDER BY floor(((x - mx) * (x - mx) + (y - my) * (y - my)) * 100), k) AS o FROM c) SELECT gx, gy, k FROM r WHERE o = 1"
)
def blob_centroid(spark, d):
    """The member nearest to the mean of each group, to 0.01 square metres."""
    p = points(spark, d).withColumn("gx", g.cell(C("x"), 2048.0)).withColumn("gy", g.cell(C("y"), 2048.0))
    mean = p.groupBy("gx", "gy").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    d2 = (C("x") - C("mx")) * (C("x") - C("mx")) + (C("y") - C("my")) * (C("y") - C("my"))
    return p.join(mean, ["gx", "gy"]).groupBy("gx", "gy").agg(F.min(F.struct(F.floor(d2 * 100), "k")).alias("m")).select("gx", "gy", "m.k")
