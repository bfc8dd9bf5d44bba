"""Mesh operators: adjacency over shared edges, vertex dictionaries, range expansion, group statistics.

A repeated triangle makes its edges shared by more than two, so that they have no neighbour; triangles with a null vertex have
no neighbours. Empty tables give empty results, group statistics one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def triangle_edges(triangles: DataFrame) -> DataFrame:
    """triangles (tid, v1, v2, v3) as (tid, e, lo, hi)."""
    edges = F.array(*[F.struct(F.lit(i).alias("e"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")) for i, (a, b) in enumerate((("v1", "v2"), ("v2", "v3"), ("v3", "v1")))])
    return triangles.select("tid", F.explode(edges).alias("s")).select("tid", "s.e", "s.lo", "s.hi")


def triangle_neighbours(triangles: DataFrame) -> DataFrame:
    """(tid, e, neighbour): the triangle across each edge, -1 where the edge is not shared by exactly two."""
    edges = triangle_edges(triangles)
    w = Window.partitionBy("lo", "hi")
    other = F.when(F.count("*").over(w) == 2, F.sum("tid").over(w) - F.col("tid")).otherwise(F.lit(-1))
    return edges.select("tid", "e", other.cast("long").alias("neighbour"))


def vertex_dictionary(points: DataFrame, scale: int = 100) -> DataFrame:
    """(sx, sy, vid): distinct vertices snapped to 1/scale, numbered from 0 by place within blocks, densely over all.

    Blocks are counted first, so no task numbers all vertices.
    """
    snapped = points.select(F.floor(F.col("x") * scale + 0.5).cast("long").alias("sx"), F.floor(F.col("y") * scale + 0.5).cast("long").alias("sy")).distinct()
    rows = snapped.withColumn("block", F.col("sx").cast("long") - F.pmod(F.col("sx"), F.lit(100_000)))
    sizes = rows.groupBy("block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("block", before.alias("start"))
    place = F.row_number().over(Window.partitionBy("block").orderBy("sx", "sy")) - 1
    return rows.withColumn("p", place).join(starts, "block").select("sx", "sy", (F.col("start") + F.col("p")).cast("long").alias("vid"))


def expanded_ranges(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """(item, key): one row for each item of start..end - 1."""
    return rows.where(F.col(end) > F.col(start)).select(F.explode(F.sequence(F.col(start), F.col(end) - 1)).alias("item"), F.col(key))


def group_sizes(rows: DataFrame, key: str) -> DataFrame:
    """One row: groups, largest, exact median, mean, groups of one, and the five largest sizes."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("n"))
    hist = sizes.groupBy("n").agg(F.count("*").alias("g"))
    top = F.slice(F.sort_array(F.flatten(F.collect_list(F.array_repeat("n", F.least("g", F.lit(5)).cast("int")))), asc=False), 1, 5)
    large = hist.orderBy(F.desc("n")).limit(5).agg(F.array_join(top, ",").alias("top5"))
    all_ = sizes.agg(F.count("*").alias("groups"), F.max("n").alias("largest"), F.percentile("n", F.lit(0.5)).alias("median"), F.avg("n").alias("mean"), F.count_if(F.col("n") == 1).alias("singles"))
    return all_.join(F.broadcast(large))


def vertex_ids(points: DataFrame, dictionary: DataFrame, scale: int = 100) -> DataFrame:
    """points (x, y, ...) with vid of the vertex that they snap to in dictionary (sx, sy, vid); null where there is none."""
    snap = lambda c: F.floor(F.col(c) * scale + 0.5).cast("long")
    return points.withColumns({"sx": snap("x"), "sy": snap("y")}).join(dictionary, ["sx", "sy"], "left").drop("sx", "sy")


def admissible_steps(triangles: DataFrame) -> DataFrame:
    """(a, b): from triangle a to its neighbour b, where b's own corner lies within the angle of a that faces it.

    triangles (tid, v1, v2, v3, ax, ay, bx, by, cx, cy) are counter-clockwise. A step may be open one way only.
    """
    corner = {"v1": "a", "v2": "b", "v3": "c"}
    edges = F.array(*[
        F.struct(F.least(v, w).alias("lo"), F.greatest(v, w).alias("hi"), *[F.col(f"{corner[u]}{c}").alias(f"o{c}") for c in "xy"], *[F.col(f"{corner[x]}{c}").alias(f"{n}{c}") for n, x in (("p", v), ("q", w)) for c in "xy"])
        for u, v, w in (("v3", "v1", "v2"), ("v1", "v2", "v3"), ("v2", "v3", "v1"))
    ])
    rows = triangles.select("tid", F.explode(edges).alias("e")).select("tid", "e.*")
    pairs = rows.groupBy("lo", "hi").agg(F.count("*").alias("n"), F.min_by(F.struct("tid", "ox", "oy"), "tid").alias("s"), F.max_by(F.struct("tid", "ox", "oy"), "tid").alias("t")).where("n = 2")
    both = rows.join(pairs, ["lo", "hi"]).withColumn("other", F.when(F.col("tid") == F.col("s.tid"), F.col("t")).otherwise(F.col("s")))
    turn = lambda p, q: (F.col(f"{p}x") - F.col("ox")) * (F.col(f"{q}y") - F.col("oy")) - (F.col(f"{p}y") - F.col("oy")) * (F.col(f"{q}x") - F.col("ox"))
    named = both.select(F.col("tid").alias("a"), F.col("other.tid").alias("b"), "ox", "oy", "px", "py", "qx", "qy", F.col("other.ox").alias("nx"), F.col("other.oy").alias("ny"))
    return named.where((turn("p", "n") >= 0) & (turn("n", "q") >= 0)).select("a", "b")


def boundary(box: tuple[float, float, float, float], margin: float) -> tuple[list[tuple[str, list]], list[list]]:
    """What closes a mesh off around a box: two blobs of six corners (id, ring), and their eight triangles, counter-clockwise.

    Corners stand at the box, widened by margin, and as far beyond the middle of each side as the side is long.
    """
    x0, y0, x1, y1 = box[0] - margin, box[1] - margin, box[2] + margin, box[3] + margin
    mx, my = (x0 + x1) / 2, (y0 + y1) / 2
    nw, ne, se, sw = (x0, y1), (x1, y1), (x1, y0), (x0, y0)
    north, east, south, west = (mx, y1 + x1 - x0), (x1 + y1 - y0, my), (mx, y0 - x1 + x0), (x0 - y1 + y0, my)
    blobs = [("outside1", [nw, north, east, south, se, ne]), ("outside2", [se, south, west, north, nw, sw])]
    fans = [[nw, ne, north], [ne, se, east], [north, ne, east], [east, se, south], [se, sw, south], [sw, nw, west], [south, sw, west], [west, nw, north]]
    area = lambda t: sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(t, t[1:] + t[:1]))
    return blobs, [t if area(t) > 0 else t[::-1] for t in fans]


def mapping_audit(ranges: DataFrame, total: DataFrame) -> DataFrame:
    """One row for ranges (poly, s, e), s to e - 1, of triangles numbered from 0, and total (n), one row.

    duplicates: triangles in several ranges; orphans: those in none; bad_ranges: ranges without a triangle; out_of_range:
    numbers in ranges that are no triangle's. Ranges are cut into blocks of numbers, and in each the ends of ranges are run
    through in order, so no row is made for a triangle and no task has more than a block's numbers at once.
    """
    c, size = F.col, 2**16
    first = lambda v: v - F.pmod(v, F.lit(size))
    cut = ranges.where("e > s").select("s", "e", F.explode(F.sequence(first(c("s")), first(c("e") - 1), F.lit(size).cast("long"))).alias("block"))
    ends = F.array(F.struct(F.greatest("s", "block").alias("at"), F.lit(1).alias("d")), F.struct(F.least(c("e"), c("block") + size).alias("at"), F.lit(-1).alias("d")))
    steps = cut.select("block", F.explode(ends).alias("x")).groupBy("block", "x.at").agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy("block").orderBy("at")
    runs = steps.select("at", F.sum("d").over(w).alias("c"), F.lead("at").over(w).alias("to")).where("c > 0").join(F.broadcast(total))
    inside = F.greatest(F.least("to", "n") - F.greatest(c("at"), F.lit(0)), F.lit(0))
    whole = runs.select("c", (c("to") - c("at")).alias("all"), inside.alias("inside"))
    sums = {"duplicates": F.when(c("c") > 1, c("all")), "held": c("inside"), "out_of_range": c("all") - c("inside")}
    seen = whole.agg(*[F.coalesce(F.sum(v), F.lit(0)).alias(k) for k, v in sums.items()])
    bad = ranges.agg(F.count_if(F.col("e") <= F.col("s")).alias("bad_ranges"))
    return seen.join(F.broadcast(total)).join(F.broadcast(bad)).select("duplicates", (F.col("n") - F.col("held")).alias("orphans"), "bad_ranges", "out_of_range")
