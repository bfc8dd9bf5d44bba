"""Queries on text forms, seeded numbers, clipping, lookups by position and rules on rings."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from geoweave.functions import clip, geometry as g, shapes as s, texts
from geoweave.functions.seeded import seeded
from geoweave.operators import locate, mesh, rings, sequences as seq, spatial, tiles
from geoweave.plans.mesh_queries import _L, _M, ells, mesh as triangles
from geoweave.plans.queries import _B, _P, query
from geoweave.sources.driver_tables import boxes, points, table

C = F.col


@query(
    "WITH l AS (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN '[' || event_id || '] ' ELSE '' END || CASE event_id % 5 WHEN 0 THEN 'Started traveling. nextCorner: (' WHEN 1 THEN 'Updated corners. newCorner: (' WHEN 2 THEN 'preEscapeCorner saved as: (' WHEN 3 THEN 'Escaped! nextCorner: (' ELSE 'Idle (' END || user_id || ', -' || (event_id % 100) || '.5)' AS line, user_id FROM events) "
    "SELECT event_id, CASE WHEN event_id % 7 > 0 THEN event_id::VARCHAR ELSE 'unknown' END AS time, CASE event_id % 5 WHEN 0 THEN 'initial_pathfinding' WHEN 1 THEN 'corner_update' WHEN 2 THEN 'save_preEscape' ELSE 'restore_from_preEscape' END AS action, "
    "CAST(regexp_extract(line, '\\(([^,]+), ([^)]+)\\)', 1) AS DOUBLE) AS x, CAST(regexp_extract(line, '\\(([^,]+), ([^)]+)\\)', 2) AS DOUBLE) AS y FROM l WHERE event_id % 5 < 4"
)
def log_actions(spark, d):
    """What each line of an agent's log tells; other lines are left out."""
    k = C("event_id")
    says = F.element_at(F.array(*[F.lit(t) for t in ("Started traveling. nextCorner: (", "Updated corners. newCorner: (", "preEscapeCorner saved as: (", "Escaped! nextCorner: (", "Idle (")]), (k % 5 + 1).cast("int"))
    line = F.concat(F.when(k % 7 > 0, F.concat(F.lit("["), k.cast("string"), F.lit("] "))).otherwise(F.lit("")), says, C("user_id").cast("string"), F.lit(", -"), (k % 100).cast("string"), F.lit(".5)"))
    return table(spark, d, "events").select("event_id", texts.log_entry(line).alias("e")).where("e is not null").select("event_id", "e.*")


@query(
    "WITH t AS (SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 5 = 0 THEN 'no bounds' ELSE '[' || (c_custkey % 40 - 20) || '.5, ' || (c_custkey % 9) || '] - [-0.25, ' || c_custkey || '.49]' END AS b FROM customer) "
    "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN b ELSE '[' || CASE WHEN c_custkey % 40 < 20 THEN '-' || CASE WHEN c_custkey % 40 = 20 THEN 1 ELSE 20 - c_custkey % 40 + 1 END ELSE (c_custkey % 40 - 20 + 1)::VARCHAR END || ',' || (c_custkey % 9) || ']-[-0,' || c_custkey || ']' END AS short FROM t"
)
def bounds_short(spark, d):
    """Bounds in whole numbers, halves away from zero; other texts as they are."""
    k = C("c_custkey")
    text = F.when(k % 5 == 0, F.lit("no bounds")).otherwise(F.concat(F.lit("["), (k % 40 - 20).cast("string"), F.lit(".5, "), (k % 9).cast("string"), F.lit("] - [-0.25, "), k.cast("string"), F.lit(".49]")))
    return table(spark, d, "customer").select("c_custkey", texts.bounds_text(text).alias("short"))


@query("SELECT n_nationkey, array_to_string(list_transform(string_split_regex(lower(n_name) || '_map-' || n_regionkey || '_x', '[-_]'), lambda p: upper(p[1:1]) || p[2:]), '') AS name FROM nation")
def type_names(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", texts.type_name(F.concat(F.lower("n_name"), F.lit("_map-"), C("n_regionkey").cast("string"), F.lit("_x"))).alias("name"))


@query(f"WITH {_B} SELECT b, x0::BIGINT || ';' || y0::BIGINT || ';' || x1::BIGINT || ';' || y1::BIGINT AS plain, (floor(x0 / 3 * 10 + 0.5) / 10)::BIGINT || ',1' AS rounded FROM (SELECT b, floor(x0) AS x0, floor(y0) AS y0, floor(x1) AS x1, floor(y1) AS y1 FROM boxes) WHERE (floor(x0 / 3 * 10 + 0.5) / 10) = floor(x0 / 3)")
def ring_texts(spark, d):
    """Rings as text: all corners with semicolons, and one rounded to a decimal with commas."""
    b = boxes(spark, d).select("b", *[F.floor(C(c)).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])
    third = g.round_half_up(C("x0") / 3, 1)
    plain = texts.ring_text(locate.ring_of_xy((C("x0"), C("y0")), (C("x1"), C("y1"))), ";")
    return b.where(third == F.floor(C("x0") / 3)).select("b", plain.alias("plain"), texts.ring_text(locate.ring_of_xy((C("x0") / 3, F.lit(1.0))), ",", 1).alias("rounded"))


def _times(a: str, b: str) -> str:
    """Product of unsigned 64-bit numbers, the lower 64 bits, from halves so that nothing overflows."""
    low = f"(({a})::UHUGEINT % 4294967296)"
    high = f"(({a})::UHUGEINT // 4294967296)"
    return f"(({low} * {b}::UHUGEINT + (({high} * ({b}::UHUGEINT % 4294967296)) % 4294967296) * 4294967296) % 18446744073709551616)::UBIGINT"


@query(
    f"WITH s0 AS (SELECT o_orderkey AS k, xor((o_orderkey * 40503 % 4294967296)::UBIGINT, 11400714819323198485::UBIGINT) AS x FROM orders), s1 AS (SELECT k, {_times('x', '13787848793156543929')} AS x FROM s0), "
    f"s2 AS (SELECT k, {_times('xor(x, x >> 30)', '10723151780598845931')} AS x FROM s1), s3 AS (SELECT k, {_times('xor(x, x >> 27)', '11400714819323198485')} AS x FROM s2), s4 AS (SELECT k, xor(x, x >> 31) AS x FROM s3), "
    f"s5 AS (SELECT k, (xor(x, x >> 18) >> 27) & 4294967295 AS low, x >> 59 AS r, {_times('x', '6364136223846793005')} AS m FROM s4) "
    "SELECT k, (((low >> r) | (low << ((32 - r) & 31))) & 4294967295)::BIGINT AS number, (((m::UHUGEINT + 1442695040888963407::UHUGEINT) % 18446744073709551616) // 4294967296)::BIGINT AS next FROM s5"
)
def seeded_numbers(spark, d):
    """A number and the next seed for each seed."""
    return table(spark, d, "orders").select(C("o_orderkey").alias("k"), seeded(C("o_orderkey") * 40503).alias("s")).select("k", "s.number", "s.next")


@query(
    f"WITH {_P}, sg AS (SELECT k, x, y, x + (k % 301 - 150) * 8 AS bx, y + (k % 211 - 105) * 8 AS by_ FROM pts), tl AS (SELECT *, unnest(range(floor(least(x, bx) / 1024)::BIGINT, floor(greatest(x, bx) / 1024)::BIGINT + 1)) AS tx FROM sg), tm AS (SELECT *, unnest(range(floor(least(y, by_) / 1024)::BIGINT, floor(greatest(y, by_) / 1024)::BIGINT + 1)) AS ty FROM tl), "
    "tp AS (SELECT *, bx - x AS dx, by_ - y AS dy, tx * 1024 - x AS xl, tx * 1024 + 1024 - x AS xh, ty * 1024 - y AS yl, ty * 1024 + 1024 - y AS yh FROM tm), "
    "tt AS (SELECT k, tx, ty, dx, dy, greatest(0, CASE WHEN dx > 0 THEN xl / dx WHEN dx < 0 THEN xh / dx ELSE 0 END, CASE WHEN dy > 0 THEN yl / dy WHEN dy < 0 THEN yh / dy ELSE 0 END) AS t0, least(1, CASE WHEN dx > 0 THEN xh / dx WHEN dx < 0 THEN xl / dx ELSE 1 END, CASE WHEN dy > 0 THEN yh / dy WHEN dy < 0 THEN yl / dy ELSE 1 END) AS t1 FROM tp) "
    "SELECT k, tx, ty, floor((t1 - t0) * sqrt(dx * dx + dy * dy) * 10 + 0.5)::BIGINT AS length_dm FROM tt WHERE t0 <= t1"
)
def clipped_lines(spark, d):
    """Segments cut at the lines of tiles of 1024 m: what part of each lies in each tile."""
    k, size = C("k"), 1024.0
    line = points(spark, d).select("k", C("x").alias("ax"), C("y").alias("ay"), (C("x") + (k % 301 - 150) * 8).alias("bx"), (C("y") + (k % 211 - 105) * 8).alias("by"))
    box = line.withColumns({"x0": F.least("ax", "bx"), "y0": F.least("ay", "by"), "x1": F.greatest("ax", "bx"), "y1": F.greatest("ay", "by")})
    span = clip.clipped_span(C("ax"), C("ay"), C("bx"), C("by"), C("cx") * size, C("cy") * size, (C("cx") + 1) * size, (C("cy") + 1) * size)
    rows = spatial.with_cells(box, size).select("k", C("cx").alias("tx"), C("cy").alias("ty"), span.alias("s"), (C("bx") - C("ax")).alias("dx"), (C("by") - C("ay")).alias("dy"))
    length = (C("s.t1") - C("s.t0")) * F.sqrt(C("dx") * C("dx") + C("dy") * C("dy"))
    return rows.where("s is not null").select("k", "tx", "ty", F.floor(length * 10 + 0.5).alias("length_dm"))


@query(
    f"WITH {_B}, t AS (SELECT *, unnest(range(floor(x0 / 256)::BIGINT, floor(x1 / 256)::BIGINT + 1)) AS tx FROM boxes WHERE x1 > x0), u AS (SELECT *, unnest(range(floor(y0 / 256)::BIGINT, floor(y1 / 256)::BIGINT + 1)) AS ty FROM t), "
    "v AS (SELECT b, tx, ty, x0, (x0 + x1) / 2 AS mx, x1, y0, (y0 + y1) / 2 AS my, y1, tx * 256.0::DOUBLE AS l, tx * 256.0::DOUBLE + 256 AS r, ty * 256.0::DOUBLE AS o, ty * 256.0::DOUBLE + 256 AS h FROM u), "
    "w AS (SELECT b, tx, ty, greatest(0, least(x1, r) - greatest(x0, l)) * greatest(0, least(my, h) - greatest(y0, o)) + greatest(0, least(mx, r) - greatest(x0, l)) * greatest(0, least(y1, h) - greatest(my, o)) AS area FROM v) "
    "SELECT b, tx, ty, floor(area + 0.5)::BIGINT AS area FROM w WHERE area > 0.5"
)
def clipped_polygons(spark, d):
    """L-shaped buildings cut at the lines of tiles of 256 m: the area of each in each tile."""
    size = 256.0
    rows = spatial.with_cells(locate.with_box(ells(spark, d).where(g.signed_area(C("ring")) > 0)), size)
    side = lambda c, k: (C(c) + k) * F.lit(size)
    # the heights of the whole shape's corners, held in the tile: SQL adds up the areas between them
    held = F.transform(F.array_sort(F.transform("ring", lambda p: p["y"])), lambda y: F.greatest(F.least(y, side("cy", 1)), side("cy", 0)))
    rows = rows.select("b", "cx", "cy", "ring", held.alias("heights"))
    cut = clip.clipped_rings(rows, "ring", side("cx", 0), side("cy", 0), side("cx", 1), side("cy", 1))
    # out of a generator, through which the engine pushes no filter, else the area is worked out again in it
    cut = cut.select("b", C("cx").alias("tx"), C("cy").alias("ty"), F.explode(F.array(s.slab_area(C("ring"), C("heights")))).alias("a"))
    return cut.where("a > 0.5").select("b", "tx", "ty", F.floor(C("a") + 0.5).alias("area"))


_ZOOMS, _WORLD = (3, 5), 10240.0
_TILED = (
    "zo AS (SELECT unnest([3, 5]) AS z), zs AS (SELECT z, CAST(pow(2, z) AS BIGINT) AS n, 20480.0::DOUBLE / pow(2, z) AS size FROM zo), "
    "za AS (SELECT *, unnest(range(greatest(0, floor((x0 + 10240) / size)::BIGINT), least(n - 1, floor((x1 + 10240) / size)::BIGINT) + 1)) AS tx FROM zb, zs), "
    "zt AS (SELECT *, unnest(range(greatest(0, floor((y0 + 10240) / size)::BIGINT), least(n - 1, floor((y1 + 10240) / size)::BIGINT) + 1)) AS ty FROM za)"
)
_STEP = "floor(greatest(0, least(size, {0} - (t{1} * size - 10240))) / size * 4096 + 0.5)::BIGINT"


@query(
    f"WITH {_B}, zb AS (SELECT b, x0, (x0 + x1) / 2 AS mx, x1, y0, (y0 + y1) / 2 AS my, y1 FROM boxes WHERE x1 > x0), {_TILED}, q AS (SELECT z, tx, ty, b, "
    + ", ".join(f"{_STEP.format(c, c[-1] if c[0] == 'm' else c[0])} AS {c}" for c in ("x0", "mx", "x1", "y0", "my", "y1"))
    + " FROM zt), a AS (SELECT *, (x1 - x0) * (my - y0) + (mx - x0) * (y1 - my) AS area FROM q) SELECT z, tx, ty, b, area FROM a WHERE area <> 0"
)
def tile_polygons(spark, d):
    """L-shaped buildings in whole steps of the tiles of two zooms: the area of each in each tile, in squared steps."""
    rings = ells(spark, d).where(g.signed_area(C("ring")) > 0).select(C("b").alias("id"), "ring")
    t = tiles.tile_polygons(rings, list(_ZOOMS), _WORLD)
    return t.select("z", "tx", "ty", C("id").alias("b"), g.signed_area(C("ring")).cast("long").alias("area"))


@query(
    f"WITH {_B}, zb AS (SELECT b, least(x0, x1) AS x0, y0, x1, y1 FROM boxes WHERE x1 > x0), {_TILED}, q AS (SELECT z, tx, ty, b, x1 >= tx * size - 10240 AND x1 <= (tx + 1) * size - 10240 AS upright, y0 >= ty * size - 10240 AND y0 <= (ty + 1) * size - 10240 AS level, "
    + ", ".join(f"{_STEP.format(c, c[0])} AS {c}" for c in ("x0", "x1", "y0", "y1"))
    + " FROM zt) SELECT z, tx, ty, b, (CASE WHEN level THEN x1 - x0 ELSE 0 END + CASE WHEN upright THEN y1 - y0 ELSE 0 END)::BIGINT AS length FROM q WHERE level OR upright"
)
def tile_lines(spark, d):
    """The lower and right sides of boxes as lines in the tiles of two zooms: how long each is in each tile, in steps."""
    b = boxes(spark, d).where("x1 > x0")
    line = locate.ring_of_xy((C("x0"), C("y0")), (C("x1"), C("y0")), (C("x1"), C("y1")))
    t = tiles.tile_lines(b.select(C("b").alias("id"), line.alias("line")), list(_ZOOMS), _WORLD)
    ends = lambda p, q: F.abs(p["x"] - q["x"]) + F.abs(p["y"] - q["y"])
    length = F.aggregate(F.sequence(F.lit(1), F.size("line")), F.lit(0).cast("long"), lambda s, i: s + F.coalesce(ends(F.get("line", i), F.get("line", i - 1)), F.lit(0).cast("long")))
    return t.select("z", "tx", "ty", C("id").alias("b"), length.alias("l")).groupBy("z", "tx", "ty", "b").agg(F.sum("l").alias("length"))


@query(
    f"WITH {_B}, t AS (SELECT b, x0, y0, floor(x0 / 512)::BIGINT AS tx, floor(y0 / 512)::BIGINT AS ty FROM boxes) SELECT b, tx, ty, floor((x0 - tx * 512) / 512.0::DOUBLE * 4096 + 0.5)::BIGINT AS qx, floor((1 - (y0 - ty * 512) / 512.0::DOUBLE) * 4096 + 0.5)::BIGINT AS qy FROM t"
)
def tile_points(spark, d):
    """The first corner of each box in the 4096 steps of its tile, y downwards."""
    b = boxes(spark, d).select("b", "x0", "y0", g.cell(C("x0"), 512.0).alias("tx"), g.cell(C("y0"), 512.0).alias("ty"))
    q = clip.in_tile(locate.ring_of_xy((C("x0"), C("y0")), (C("x0"), C("y0"))), C("tx") * 512, C("ty") * 512, 512.0)
    return b.select("b", "tx", "ty", q[0]["x"].alias("qx"), q[0]["y"].alias("qy"))


_J = (
    "bl AS (SELECT o_custkey AS blob, list(o_orderkey * 3 % 20000 ORDER BY o_orderkey) AS ids FROM orders GROUP BY o_custkey), un AS (SELECT blob, unnest(ids) AS id, unnest(range(len(ids))) AS o FROM bl), "
    "fd AS (SELECT un.*, p.p_partkey IS NOT NULL AS found FROM un LEFT JOIN part p ON p.p_partkey = un.id)"
)


def _blob_ids(spark, d):
    o = table(spark, d, "orders").groupBy(C("o_custkey").alias("blob")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", (C("o_orderkey") * 3 % 20000).alias("id")))).alias("s"))
    return o.select("blob", F.transform("s", lambda x: x["id"]).alias("ids"))


@query(f"WITH {_J} SELECT blob, id, (row_number() OVER (ORDER BY blob, o) - 1)::BIGINT AS new_id FROM fd WHERE found")
def ordered_lookup(spark, d):
    """Parts that blobs list, numbered anew in the order of the lists; an id that is listed twice has two numbers."""
    return seq.looked_up(_blob_ids(spark, d), "blob", "ids", table(spark, d, "part").select(C("p_partkey").alias("id")), "id").select("blob", "id", "new_id")


@query(f"WITH {_J}, m AS (SELECT blob, o, id FROM fd WHERE NOT found) SELECT (SELECT count(*) FROM fd WHERE found) AS found, (SELECT count(*) FROM m) AS missing, (SELECT string_agg(id, ', ' ORDER BY blob, o) FROM (SELECT * FROM m ORDER BY blob, o LIMIT 10)) AS sample")
def lookup_report(spark, d):
    """How many listed ids there are, how many not, and the first ten of these."""
    return seq.lookup_report(_blob_ids(spark, d), "blob", "ids", table(spark, d, "part").select(C("p_partkey").alias("id")), "id", 10)


@query("WITH n AS (SELECT s_suppkey AS old, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) - 1 AS no, s_nationkey FROM supplier) SELECT l_orderkey, l_linenumber, l_partkey, s_nationkey, no::INT AS no FROM lineitem JOIN n ON l_suppkey = old")
def renumbered_references(spark, d):
    """Line items whose supplier is named by its new number within its nation."""
    new = seq.renumbered(table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), ["s_nationkey"], F.desc("s_acctbal"), "s_suppkey")
    return seq.remapped(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_suppkey", new, "s_suppkey").select("l_orderkey", "l_linenumber", "l_partkey", "s_nationkey", "no")


@query(
    f"WITH {_M}, sn AS (SELECT DISTINCT floor(ax * 100 + 0.5)::BIGINT AS sx, floor(ay * 100 + 0.5)::BIGINT AS sy FROM ms WHERE tid % 3 > 0), vd AS (SELECT sx, sy, row_number() OVER (ORDER BY sx - ((sx % 100000) + 100000) % 100000, sx, sy) - 1 AS vid FROM sn) "
    "SELECT tid, vd.vid FROM ms LEFT JOIN vd ON floor(ax * 100 + 0.5)::BIGINT = sx AND floor(ay * 100 + 0.5)::BIGINT = sy"
)
def triangle_vertex_ids(spark, d):
    """The number of each triangle's first corner in the dictionary of some triangles' corners; null where it is not in it."""
    t = triangles(spark, d)
    known = mesh.vertex_dictionary(t.where("tid % 3 > 0").select(C("ax").alias("x"), C("ay").alias("y")))
    return mesh.vertex_ids(t.select("tid", C("ax").alias("x"), C("ay").alias("y")), known).select("tid", "vid")


@query("SELECT s_suppkey AS id, s_nationkey % 4 = 1 AS marked, EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = s_suppkey * 20) AS known FROM supplier WHERE s_suppkey % 3 = 0")
def pasted_ids(spark, d):
    """Ids of a pasted list, whether they are marked, and whether a table knows them."""
    s = table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(C("s_suppkey").alias("id"), (C("s_nationkey") % 4 == 1).alias("marked"))
    known = table(spark, d, "customer").where("c_custkey % 20 = 0").select((C("c_custkey") / 20).cast("long").alias("id"), F.lit(True).alias("known"))
    return s.join(known, "id", "left").select("id", "marked", F.coalesce("known", F.lit(False)).alias("known"))


@query("SELECT c_custkey AS id, c_acctbal AS x, c_acctbal / 2 AS y, n_name AS state, c_custkey % 7 <> 0 AS alive FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 7 <> 0")
def agent_records(spark, d):
    """Columns of agents as one record each, of those alive, read back from the record."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), C("c_nationkey") == C("n_nationkey"))
    record = F.struct(C("c_custkey").alias("id"), g.point(C("c_acctbal"), C("c_acctbal") / 2).alias("at"), C("n_name").alias("state"), (C("c_custkey") % 7 != 0).alias("alive"))
    return c.select(record.alias("r")).where("r.alive").select("r.id", "r.at.x", "r.at.y", "r.state", "r.alive")


@query(
    f"WITH {_B} SELECT b, CASE WHEN b % 4 = 1 THEN 'open line' WHEN b % 4 = 3 THEN 'too few points' WHEN (x1 - x0) * (y1 - y0) < 10000 THEN 'too small' ELSE 'kept' END AS verdict FROM boxes"
)
def ring_verdicts(spark, d):
    """What becomes of polygons, closed and open lines and rings of two points; a smallest area of 10000."""
    b = boxes(spark, d)
    corners = [g.point(C(x), C(y)) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"), ("x0", "y0"))]
    shape = F.when(C("b") % 4 == 3, F.array(*corners[:2])).when(C("b") % 4 == 1, F.array(*corners[:4])).otherwise(F.array(*corners))
    kind = F.when(C("b") % 4 == 0, F.lit("Polygon")).when(C("b") % 4 == 3, F.lit("Polygon")).otherwise(F.lit("LineString"))
    shapes = b.select("b", kind.alias("kind"), g.once(shape).alias("shape"))
    return shapes.select("b", rings.verdict(C("kind"), C("shape"), 10000.0).alias("verdict"))


@query("SELECT key FROM (SELECT unnest(['segment', 'nation', 'balance']) AS key) ORDER BY key")
def property_keys(spark, d):
    """The keys of customers' properties in ascending order."""
    c = table(spark, d, "customer").select(F.explode(F.array(*[F.lit(k) for k in ("segment", "nation", "balance")])).alias("key"))
    return c.distinct().orderBy("key")


@query("WITH m AS (SELECT o_orderkey AS building, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS blob FROM orders) SELECT (SELECT count(blob) FROM m) AS mapped, (SELECT string_agg(building || '>' || coalesce(blob::VARCHAR, '-'), ' ' ORDER BY building) FROM (SELECT * FROM m ORDER BY building LIMIT 20)) AS first_rows")
def blob_audit(spark, d):
    """How many buildings have a blob, and the first twenty rows of the mapping."""
    m = table(spark, d, "orders").select(C("o_orderkey").alias("building"), F.when(C("o_orderkey") % 5 > 0, C("o_custkey")).alias("blob"))
    head = m.orderBy("building").limit(20).agg(F.array_sort(F.collect_list(F.struct("building", "blob"))).alias("h"))
    text = F.array_join(F.transform("h", lambda r: F.concat(r["building"].cast("string"), F.lit(">"), F.coalesce(r["blob"].cast("string"), F.lit("-")))), " ")
    return m.agg(F.count("blob").alias("mapped")).join(F.broadcast(head)).select("mapped", text.alias("first_rows"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def without_orders(spark, d):
    """Customers that no order names."""
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(C("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


_RANGES = (
    "rg AS (SELECT p_partkey AS poly, p_partkey * 100 - CASE WHEN p_partkey % 20 = 0 THEN 60 ELSE 0 END AS s, p_partkey * 100 + CASE WHEN p_partkey % 50 = 1 THEN -1 ELSE p_size + 45 END AS e FROM part), "
    "ut AS (SELECT max(p_partkey) * 100 AS n FROM part), it AS (SELECT poly, unnest(range(s, e)) AS tid FROM rg WHERE e > s), ct AS (SELECT tid, count(*) AS c FROM it GROUP BY tid)"
)


@query(f"WITH {_RANGES} SELECT (SELECT count(*) FROM ct WHERE c > 1) AS duplicates, (SELECT n FROM ut) - (SELECT count(*) FROM ct, ut WHERE tid >= 0 AND tid < n) AS orphans, (SELECT count(*) FROM rg WHERE e <= s) AS bad_ranges, (SELECT count(*) FROM ct, ut WHERE tid < 0 OR tid >= n) AS out_of_range")
def mapping_audit(spark, d):
    """Triangles in several polygons' ranges, in none, ranges that hold none, and triangles beyond those that there are."""
    p, k = table(spark, d, "part"), C("p_partkey")
    ranges = p.select(k.alias("poly"), (k * 100 - F.when(k % 20 == 0, 60).otherwise(0)).alias("s"), (k * 100 + F.when(k % 50 == 1, -1).otherwise(C("p_size") + 45)).alias("e"))
    return mesh.mapping_audit(ranges, p.agg((F.max("p_partkey") * 100).alias("n")))


@query("WITH b AS (SELECT o_custkey AS blob, count(*) AS n FROM orders GROUP BY 1) SELECT count(*) AS blobs, sum(n)::BIGINT AS buildings, floor(sum(n)::DOUBLE / count(*) * 100 + 0.5)::BIGINT AS mean_percent, count(*) FILTER (n = 1) AS singles FROM b")
def buildings_per_blob(spark, d):
    n = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("blobs"), F.sum("n").alias("buildings"), F.floor(F.sum("n").cast("double") / F.count("*") * 100 + 0.5).alias("mean_percent"), F.count_if(C("n") == 1).alias("singles"))
