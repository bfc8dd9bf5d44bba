"""More registered queries: road rules, cyclic turns, polygon adjacency, weighted neighbours, split lines and summaries."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from geoweave.functions import geometry as g, shapes as s
from geoweave.operators import mesh, rules, spatial
from geoweave.plans.queries import _A, _B, _P, _RING, _T, _edges, _rings, _triangles, _V, query
from geoweave.sources.driver_tables import agents, boxes, points, table

C = F.col


@query(
    "SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN 'Int ' || s_suppkey WHEN s_suppkey % 3 > 0 THEN s_name END AS name, CASE WHEN s_nationkey % 5 = 1 THEN 'primary' WHEN s_nationkey % 5 = 2 THEN 'service' ELSE 'footway' END AS class "
    "FROM supplier WHERE s_nationkey % 5 <> 3 AND s_suppkey % 7 <> 0"
)
def road_rules(spark, d):
    """Roads without proposed ones and areas, their names and classes."""
    s = table(spark, d, "supplier")
    n, k = C("s_nationkey") % 5, C("s_suppkey")
    props = F.map_filter(
        F.create_map(
            F.lit("highway"), F.element_at(F.array(*[F.lit(x) for x in ("path", "trunk", "service", "proposed", "steps")]), (n + 1).cast("int")),
            F.lit("area"), F.when(k % 7 == 0, F.lit("yes")).otherwise(F.lit("")),
            F.lit("int_name"), F.when(k % 4 == 0, F.concat(F.lit("Int "), k.cast("string"))),
            F.lit("name"), F.when(k % 3 > 0, C("s_name")),
        ),
        lambda _, v: v.isNotNull(),
    )
    roads = s.select("s_suppkey", props.alias("props")).where((rules.tag(C("props"), "highway") != "proposed") & rules.tag(C("props"), "area").isNull())
    kind = rules.category(rules.tag(C("props"), "highway"), {"primary": ["trunk", "primary"], "service": ["service"]}, "footway")
    return roads.select("s_suppkey", rules.first_of(C("props"), ["int_name", "name"]).alias("name"), kind.alias("class"))


@query(
    f"WITH {_B}, {_RING}, t AS (SELECT b, unnest([(px1 - px0) * (py2 - py1) - (py1 - py0) * (px2 - px1), (px2 - px1) * (py3 - py2) - (py2 - py1) * (px3 - px2), (px3 - px2) * (py0 - py3) - (py3 - py2) * (px0 - px3), (px0 - px3) * (py1 - py0) - (py0 - py3) * (px1 - px0)]) AS c FROM rg) "
    "SELECT b, count(*) FILTER (c < 0) AS right_turns, count(*) FILTER (c > 0) AS left_turns FROM t GROUP BY b"
)
def cyclic_turns(spark, d):
    """Turns to either side around each ring."""
    n = F.size("ring")

    def turn(i):
        p, q, r = (F.element_at("ring", ((i + k) % n + 1).cast("int")) for k in range(3))
        return g.side(r["x"], r["y"], p["x"], p["y"], q["x"], q["y"])

    turns = _rings(spark, d).select("b", F.transform(F.sequence(F.lit(0), n - 1), turn).alias("t"))
    some = lambda test: F.size(F.filter("t", test)).cast("long")
    return turns.select("b", some(lambda t: t < 0).alias("right_turns"), some(lambda t: t > 0).alias("left_turns"))


@query(
    f"WITH {_T}, e AS (SELECT tid, least(v1, v2) AS lo, greatest(v1, v2) AS hi FROM tr UNION ALL SELECT tid, least(v2, v3), greatest(v2, v3) FROM tr UNION ALL SELECT tid, least(v3, v1), greatest(v3, v1) FROM tr) "
    "SELECT DISTINCT p.tid // 2 AS poly, q.tid // 2 AS neighbour FROM e p JOIN e q ON p.lo = q.lo AND p.hi = q.hi AND p.tid // 2 <> q.tid // 2"
)
def poly_neighbours(spark, d):
    """Polygons that share an edge; two triangles make a polygon."""
    n = mesh.triangle_neighbours(_triangles(spark, d)).where("neighbour >= 0")
    poly = lambda c: F.floor(C(c) / 2)
    return n.select(poly("tid").alias("poly"), poly("neighbour").alias("neighbour")).where("poly <> neighbour").distinct()


@query(
    f"WITH {_P}, {_V}, w AS (SELECT a, b, (a * 31 + b * 17) % 7 + 1 AS w FROM city_edges), r AS (SELECT *, sum(w) OVER (PARTITION BY a ORDER BY b) AS run, sum(w) OVER (PARTITION BY a) AS al FROM w), "
    "m AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS o FROM r WHERE run * 2 >= al) SELECT a, b FROM m WHERE o = 1"
)
def weighted_neighbour(spark, d):
    """Each node's neighbour at half of the running weight of its edges."""
    own = Window.partitionBy("a")
    w = _edges(spark, d).withColumn("w", F.pmod(C("a") * 31 + C("b") * 17, F.lit(7)) + 1)
    run = w.select("a", "b", F.sum("w").over(own.orderBy("b")).alias("run"), F.sum("w").over(own).alias("all"))
    return run.where("run * 2 >= all").groupBy("a").agg(F.min("b").alias("b"))


@query(f"WITH {_P} SELECT (CASE WHEN 9000 * (y + 4000) - 7000 * (x + 5000) > 0 THEN 1 ELSE 0 END + CASE WHEN -8000 * (y - 5000) + 9000 * (x - 3000) > 0 THEN 2 ELSE 0 END) AS part, count(*) AS n FROM pts GROUP BY 1")
def split_line_parts(spark, d):
    """Points in the four parts that two lines make."""
    left = lambda a, b: g.side(C("x"), C("y"), *[F.lit(float(v)) for v in (*a, *b)]) > 0
    part = F.when(left((-5000, -4000), (4000, 3000)), 1).otherwise(0) + F.when(left((3000, 5000), (-5000, -4000)), 2).otherwise(0)
    return points(spark, d).select(part.alias("part")).groupBy("part").agg(F.count("*").alias("n"))


@query(
    "WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) SELECT count(*) AS polygons, max(n) AS most, sum(n)::BIGINT AS triangles, count(*) FILTER (n = 1) AS singles, floor(sum(n)::DOUBLE / count(*) * 100 + 0.5)::BIGINT AS mean_percent FROM s"
)
def tri_per_poly(spark, d):
    s = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return s.agg(
        F.count("*").alias("polygons"), F.max("n").alias("most"), F.sum("n").alias("triangles"), F.count_if(C("n") == 1).alias("singles"),
        F.floor(F.sum("n").cast("double") / F.count("*") * 100 + 0.5).alias("mean_percent"),
    )


@query("SELECT count(*) AS seen, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type NOT IN ('view', 'error')) AS remaining FROM events")
def totals(spark, d):
    t = C("event_type")
    return table(spark, d, "events").agg(F.count("*").alias("seen"), F.count_if(t == "view").alias("views"), F.count_if(t == "error").alias("errors"), F.count_if(~t.isin("view", "error")).alias("remaining"))


@query(f"WITH {_B} SELECT b, x0 <= 0 AND x1 >= -4000 AND y0 <= 3000 AND y1 >= -1000 AS meets FROM boxes")
def aabb_overlap(spark, d):
    window = boxes(spark, d).select("*", *[F.lit(v).alias(f"w{c}") for c, v in (("x0", -4000.0), ("y0", -1000.0), ("x1", 0.0), ("y1", 3000.0))])
    return window.select("b", g.boxes_meet("", "w").alias("meets"))


@query(f"WITH {_P} SELECT k, floor((x - 0.375 * 128) / 128)::BIGINT AS cx, floor((y - (1.0::DOUBLE / 3 + 0.0) * 128) / 128)::BIGINT AS cy FROM pts")
def halton_cell(spark, d):
    """Cells whose borders are moved by the Halton numbers 6 (base 2) and 1 (base 3)."""
    return points(spark, d).select("k", g.cell(C("x") - g.halton(6, 2) * 128, 128.0).alias("cx"), g.cell(C("y") - g.halton(1, 3) * 128, 128.0).alias("cy"))


@query(
    f"WITH {_P} SELECT k, floor(0.72 * 60 / (1 + greatest(0, least(1, (x + 10000) / 20000.0::DOUBLE))) * 1000 + 0.5)::BIGINT AS speed, floor((x + 10000) / 20000.0::DOUBLE * 90 * 1000 + 0.5)::BIGINT AS remap FROM pts"
)
def linear_remap(spark, d):
    """A coordinate remapped to 0..90 without a bound, and one held in 0..1 in a speed."""
    t = (C("x") + 10000) / F.lit(20000.0)
    held = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    # 0.72 * 60 is 43.2 in decimals, as in SQL; the product of the doubles is a digit less
    return points(spark, d).select("k", F.floor(F.lit(43.2) / (held + 1) * 1000 + 0.5).alias("speed"), F.floor(t * 90 * 1000 + 0.5).alias("remap"))


@query(f"WITH {_P} SELECT user_id, arg_max(event_type, event_id) AS action, max(event_id) AS event_id FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY user_id")
def latest_command(spark, d):
    """Each agent's last command."""
    e = table(spark, d, "events").where(C("event_type").isin("click", "view", "purchase"))
    return e.groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("action"), F.max("event_id").alias("event_id"))


@query(
    "WITH l AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '{\"x\":' || user_id || ',\"y\":' || (event_id % 50) || '}' WHEN 1 THEN user_id || ', ' || (event_id % 50) ELSE 'none' END AS t, user_id FROM events) "
    "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN user_id::DOUBLE END AS x, CASE WHEN event_id % 3 < 2 THEN (event_id % 50)::DOUBLE END AS y FROM l"
)
def parse_points(spark, d):
    """Points pasted as JSON or as two numbers; null where a text is neither."""
    k, y = C("event_id"), (C("event_id") % 50).cast("string")
    u = C("user_id").cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit('{"x":'), u, F.lit(',"y":'), y, F.lit("}"))).when(k % 3 == 1, F.concat(u, F.lit(", "), y)).otherwise(F.lit("none"))
    t = table(spark, d, "events").select("event_id", text.alias("t"))
    number = r"^\s*(-?[0-9.]+)\s*,\s*(-?[0-9.]+)\s*$"
    either = lambda c, i: F.coalesce(F.get_json_object("t", f"$.{c}").try_cast("double"), F.regexp_extract("t", number, i).try_cast("double"))
    return t.select("event_id", either("x", 1).alias("x"), either("y", 2).alias("y"))


@query(
    f"WITH {_P}, t AS (SELECT k, (x + 5000) / 10000.0::DOUBLE AS t, x, y FROM pts), h AS (SELECT *, greatest(0, least(1, t)) AS held FROM t) SELECT k, floor((20 + t * (0.15 - 20)) * 1000 + 0.5)::BIGINT AS linear, floor((20 + held * (0.15 - 20)) * 1000 + 0.5)::BIGINT AS held, "
    "floor(20 * pow(0.15 / 20, held) * 1000 + 0.5)::BIGINT AS powers, floor((-1 + t * 3) * 1000 + 0.5)::BIGINT AS crossing, floor(x / sqrt(x * x + y * y) * 1000000 + 0.5)::BIGINT AS east FROM h WHERE x * x + y * y > 0"
)
def remapped_values(spark, d):
    """A coordinate put between two values: in equal steps, held at the ends, by equal factors, and across 0; and the direction of each point."""
    p = points(spark, d).where(C("x") * C("x") + C("y") * C("y") > 0)
    n, whole = (lambda v: F.lit(float(v))), (lambda v, m=1000: F.floor(v * m + 0.5))
    at = (C("x"), n(-5000), n(5000))
    return p.select(
        "k", whole(s.remapped(*at, n(20), n(0.15))).alias("linear"), whole(s.remapped(*at, n(20), n(0.15), held=True)).alias("held"), whole(s.remapped_by_powers(*at, n(20), n(0.15), held=True)).alias("powers"),
        whole(s.remapped_by_powers(*at, n(-1), n(2))).alias("crossing"), whole(s.unit(C("x"), C("y"))["x"], 1000000).alias("east"),
    )


@query(
    f"WITH {_P}, c AS (SELECT k, ((floor(x / 64)::BIGINT % 2) + 2) % 2 AS u, ((floor(y / 64)::BIGINT % 2) + 2) % 2 AS v FROM pts) "
    "SELECT k, CASE WHEN u = v THEN 1 ELSE 2 END AS pattern, CASE WHEN v = 0 THEN 'yellow' ELSE 'blue' END AS colour FROM c"
)
def checkerboard_patterns(spark, d):
    """The pattern and colour of each point's cell: both numbers even or both odd in the first, one of each in the second."""
    odd = lambda c: F.pmod(g.cell(C(c), 64.0), F.lit(2))
    return points(spark, d).select("k", F.when(odd("x") == odd("y"), 1).otherwise(2).alias("pattern"), F.when(odd("y") == 0, "yellow").otherwise("blue").alias("colour"))


@query(
    f"WITH {_A}, aw AS (SELECT k, x * 2 AS x, y * 2 AS y FROM ag), fr AS (SELECT unnest([{{'f': 1, 'ox': 64.0::DOUBLE, 'oy': 128.0::DOUBLE / 3}}, {{'f': 2, 'ox': 32.0, 'oy': 256.0::DOUBLE / 3}}, {{'f': 3, 'ox': 96.0, 'oy': 128.0::DOUBLE / 9}}], recursive := true)), "
    "cp AS (SELECT f, k, x, y, floor((x - ox) / 128) AS cx, floor((y - oy) / 128) AS cy FROM aw, fr), cq AS (SELECT *, row_number() OVER (PARTITION BY f, cx, cy ORDER BY k) AS o FROM cp), ce AS (SELECT * FROM cq WHERE o <= 256), "
    "co AS (SELECT p.f, p.k AS a, q.k AS b, (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) AS d2 FROM ce p JOIN ce q ON p.f = q.f AND p.cx = q.cx AND p.cy = q.cy AND p.k < q.k) SELECT a, b, count(*) AS frames FROM co WHERE d2 > 0.001 AND d2 < 25 GROUP BY a, b"
)
def moving_collisions(spark, d):
    """Pairs that meet in the cells of three frames, whose borders move, and in how many of them."""
    p = agents(spark, d).select("k", (C("x") * 2).alias("x"), (C("y") * 2).alias("y"))
    met = [spatial.collisions(p, shift=spatial.frame_shift(f)).select("a", "b") for f in (1, 2, 3)]
    return met[0].union(met[1]).union(met[2]).groupBy("a", "b").agg(F.count("*").alias("frames"))
