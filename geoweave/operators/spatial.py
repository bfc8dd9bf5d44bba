"""Spatial joins: a theta join is rewritten as an equi-join on grid cells with an exact residual.

The cell join is a sort merge join, which Spark splits where a cell is crowded. It is asked for by a hint, since Spark reckons
with the bytes before shapes are repeated for their cells, and would broadcast what is many times as large. Where only the
least or the number of holders is asked for, cells that a shape holds whole count at once, without a pair for each point.
cell should be about the size of the smaller shapes: each shape is repeated once for each cell it meets.

In all of them null coordinates match nothing, empty tables give empty results, and a repeated row gives its pairs again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from geoweave.functions.geometry import cell, halton
from geoweave.shared import shuffle_partitions, written


def with_cells(boxes: DataFrame, size: float) -> DataFrame:
    """boxes (x0, y0, x1, y1, ...) once for each cell (cx, cy) that they meet: the bridge table of a grid index."""
    span = lambda a, b: F.sequence(cell(F.col(a), size), cell(F.col(b), size))
    return boxes.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1"))).hint("merge")


def size_class(size: float) -> Column:
    """How often a cell is to be made four times as wide until a box (x0, y0, x1, y1) is no wider: 0, 1, 2, ..."""
    wide = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / size
    return F.greatest(F.ceil(F.log(4.0, F.greatest(wide, F.lit(1.0)))), F.lit(0)).cast("int")


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float = 64.0, by: list[str] | None = None) -> DataFrame:
    """Pairs of points (x, y) and the boxes that hold them, borders included; null coordinates and boxes match nothing.

    With `by`, columns that both have, only those with equal ones are pairs; they belong to the join's key.

    Boxes are dealt to grids of cells of size, 4 size, 16 size, ..., so that each meets four cells at most, however large
    it is. A point has a copy for each grid in use (one short aggregate of the boxes), mostly one or two.
    """
    sized = boxes.withColumn("_class", size_class(size)).where("x0 <= x1 and y0 <= y1")
    classes = [r[0] for r in sized.select("_class").distinct().collect()]  # a number for each power of four in use
    if not classes:
        return points.join(boxes.drop(*(by or [])), F.lit(False))
    width = lambda c: F.lit(size) * F.pow(F.lit(4.0), F.col(c))
    at = lambda v: F.floor(F.col(v) / width("_class")).cast("long")
    p = points.withColumn("_class", F.explode(F.array(*map(F.lit, sorted(classes))))).withColumns({"_cx": at("x"), "_cy": at("y")})
    b = sized.withColumn("_cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("_cy", F.explode(F.sequence(at("y0"), at("y1"))))
    return p.join(b.hint("merge"), [*(by or []), "_class", "_cx", "_cy"]).where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))).drop("_class", "_cx", "_cy")


def places(points: DataFrame) -> DataFrame:
    """(x, y): where points are, each place once; those with a coordinate that is null or no number are nowhere."""
    return points.select("x", "y").where("not isnan(x) and not isnan(y) and x is not null and y is not null").distinct()


def graded_cells(points: DataFrame, shapes: DataFrame, size: float = 64.0, parts: int = 4) -> tuple[DataFrame, DataFrame]:
    """points (x, y) and shapes with a box (x0, y0, x1, y1) with cells (_class, cx, cy) and, for shapes, their width `cell`.

    Shapes go to grids of cells of size / parts, twice that, ..., so that each has parts to about parts / 2 cells a side, and the
    smallest fewer. Points have a copy for each grid in use.
    """
    wide = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / size
    sized = shapes.where("x0 <= x1 and y0 <= y1").withColumn("_class", F.greatest(F.ceil(F.log2(F.greatest(wide, F.lit(1.0)))), F.lit(0)).cast("int"))
    classes = sorted(r[0] for r in sized.select("_class").distinct().collect())  # a number for each power of two in use
    width = F.lit(size / parts) * F.pow(F.lit(2.0), F.col("_class"))
    at = lambda v: F.floor(F.col(v) / width).cast("long")
    p = points.withColumn("_class", F.explode(F.array(*map(F.lit, classes)).cast("array<int>"))).withColumns({"cx": at("x"), "cy": at("y")})
    b = sized.withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("y0"), at("y1"))))
    return p, b.withColumn("cell", width).hint("merge")


def with_whole(cells: DataFrame, sides: list[Callable[[Column, Column], Column]], margin: float = 0.0) -> DataFrame:
    """cells (cx, cy, cell, ...) of convex shapes that the shape meets, and whether it holds the cell `whole`.

    sides are linear functions of a place, not less than 0 where it is inside; margin covers their rounding.
    """
    size = F.col("cell")
    corners = [((F.col("cx") + i) * size, (F.col("cy") + j) * size) for i in (0, 1) for j in (0, 1)]
    each = [[f(x, y) for x, y in corners] for f in sides]
    meets, whole = F.lit(True), F.lit(True)
    for values in each:
        meets, whole = meets & (F.greatest(*values) >= -margin), whole & (F.least(*values) >= margin)
    return cells.where(meets).withColumn("whole", whole)


def box_sides() -> list[Callable[[Column, Column], Column]]:
    c = F.col
    return [lambda x, y: x - c("x0"), lambda x, y: c("x1") - x, lambda x, y: y - c("y0"), lambda x, y: c("y1") - y]


def least_holder(points: DataFrame, at: DataFrame, cells: DataFrame, key: str, test: Column, by: list[str]) -> DataFrame:
    """(k, key): the least key of the shapes that hold each of points (k, x, y).

    at: the places (x, y) with their cells `by`; cells: those that shapes meet, with key, `whole` and what test needs. A cell's
    least whole holder holds each of its places, so only lesser keys are tested there: few, however many shapes lie on a cell.
    """
    sure = cells.where("whole").groupBy(*by).agg(F.min(key).alias("sure"))
    open_ = cells.where("not whole").join(sure.hint("merge"), by, "left").where(F.col("sure").isNull() | (F.col(key) < F.col("sure"))).drop("sure", "whole")
    tested = at.join(open_.hint("merge"), by).where(test).select("x", "y", F.col(key).alias("m"))
    held = at.join(sure.hint("merge"), by).select("x", "y", F.col("sure").alias("m"))
    least = tested.union(held).groupBy("x", "y").agg(F.min("m").alias("m"))
    return points.select("k", "x", "y").join(least, ["x", "y"]).groupBy("k").agg(F.min("m").alias(key))


def first_box(points: DataFrame, boxes: DataFrame, key: str = "b") -> DataFrame:
    """(k, key): the least of boxes (key, x0, ..) that holds each of points (k, x, y), borders included; points in none have no row."""
    at, cells = graded_cells(places(points), boxes.select(key, "x0", "y0", "x1", "y1"))
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    return least_holder(points, at, with_whole(cells, box_sides()), key, inside, ["_class", "cx", "cy"])


def holders(points: DataFrame, boxes: DataFrame, most: int = 2) -> DataFrame:
    """(k, n) of points (k, x, y): in how many boxes (x0, ..) each is, borders included; `most` or more are some number from `most` on.

    Places of which boxes that hold their cells whole are enough are not tested any more.
    """
    by = ["_class", "cx", "cy"]
    at, cells = graded_cells(places(points), boxes.select("x0", "y0", "x1", "y1"))
    cells = with_whole(cells, box_sides())
    sure = cells.where("whole").groupBy(*by).agg(F.count("*").alias("n"))
    held = written(at.join(sure.hint("merge"), by).groupBy("x", "y").agg(F.sum("n").alias("n")), "held")
    open_ = at.join(held.where(F.col("n") >= most), ["x", "y"], "left_anti")
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    tested = open_.join(cells.where("not whole").hint("merge"), by).where(inside).groupBy("x", "y").agg(F.count("*").alias("n"))
    n = held.union(tested).groupBy("x", "y").agg(F.sum("n").alias("n"))
    return points.select("k", "x", "y").join(n, ["x", "y"], "left").select("k", F.coalesce("n", F.lit(0)).alias("n"))


def counts_in_boxes(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """(b, n): how many of points (x, y) lie in each of boxes (b, x0, ..), borders included; boxes without a point have no row.

    Points of one place are one row with their number, and cells that a box holds whole add their number at once.
    """
    by = ["_class", "cx", "cy"]
    good = points.select("x", "y").where("not isnan(x) and not isnan(y) and x is not null and y is not null")
    at, cells = graded_cells(good.groupBy("x", "y").agg(F.count("*").alias("n")), boxes.select("b", "x0", "y0", "x1", "y1"), parts=8)
    cells = with_whole(cells, box_sides())
    sums = at.groupBy(*by).agg(F.sum("n").alias("n"))
    whole = cells.where("whole").join(sums.hint("merge"), by).select("b", "n")
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    part = at.join(cells.where("not whole").hint("merge"), by).where(inside).select("b", "n")
    return whole.union(part).groupBy("b").agg(F.sum("n").alias("n"))


def least_within(queries: DataFrame, points: DataFrame, radius: float, size: float = 128.0) -> DataFrame:
    """(q, k): the least of points (k, x, y) no farther than radius from each of queries (q, x, y); size about a quarter of it.

    A cell that lies within the radius gives its least key at once; of the cells on the edge only those with a lesser one are tested.
    """
    here = lambda df: df.where("not isnan(x) and not isnan(y) and x is not null and y is not null")
    c = F.col
    at = here(points).groupBy("x", "y").agg(F.min("k").alias("k")).withColumns({"cx": cell(c("x"), size), "cy": cell(c("y"), size)})
    low = at.groupBy("cx", "cy").agg(F.min("k").alias("least"))
    q = here(queries).select("q", c("x").alias("qx"), c("y").alias("qy"), *[(c(d) + r).alias(d + e) for d in ("x", "y") for e, r in (("0", -radius), ("1", radius))])
    off = lambda i, a: F.greatest(F.abs(c(i) * size - c(a)), F.abs((c(i) + 1) * size - c(a)))
    near = lambda i, a: F.greatest(c(i) * size - c(a), c(a) - (c(i) + 1) * size, F.lit(0.0))
    far2, near2 = (f("cx", "qx") * f("cx", "qx") + f("cy", "qy") * f("cy", "qy") for f in (off, near))
    cells = with_cells(q, size).select("q", "qx", "qy", "cx", "cy").where(near2 <= radius * radius * (1 + 1e-9)).withColumn("whole", far2 <= radius * radius * (1 - 1e-9))
    cells = written(cells.join(low.hint("merge"), ["cx", "cy"]), "near")
    sure = cells.where("whole").groupBy("q").agg(F.min("least").alias("sure"))
    open_ = cells.where("not whole").join(sure.hint("merge"), "q", "left").where(c("sure").isNull() | (c("least") < c("sure"))).select("q", "qx", "qy", "cx", "cy", "sure")
    d2 = (c("x") - c("qx")) * (c("x") - c("qx")) + (c("y") - c("qy")) * (c("y") - c("qy"))
    tested = open_.join(at.hint("merge"), ["cx", "cy"]).where((c("sure").isNull() | (c("k") < c("sure"))) & (d2 <= radius * radius)).select("q", "k")
    return tested.union(sure).groupBy("q").agg(F.min("k").alias("k"))


def boxes_in_areas(boxes: DataFrame, areas: DataFrame, size: float = 512.0) -> DataFrame:
    """Distinct pairs (area, b) of areas (area, ax0, ..) and boxes (b, x0, ..) that share a point.

    A pair is made in one cell only, that of the upper left corner of what the two share, so nothing is to be deduplicated.
    Cells are dealt to a set number of tasks, since few bytes give many pairs, and Spark would put them together by their bytes.
    """
    ends = ("x0", "y0", "x1", "y1")
    a = areas.select("area", *[F.col(f"a{c}").alias(c) for c in ends])
    a = with_cells(a, size).select("area", "cx", "cy", *[F.col(c).alias(f"a{c}") for c in ends])
    dealt = lambda df: df.repartition(shuffle_partitions(df.sparkSession), "cx", "cy").hint("merge")
    both = dealt(a).join(dealt(with_cells(boxes, size).select("b", "cx", "cy", *ends)), ["cx", "cy"])
    meet = (F.col("x0") <= F.col("ax1")) & (F.col("ax0") <= F.col("x1")) & (F.col("y0") <= F.col("ay1")) & (F.col("ay0") <= F.col("y1"))
    corner = (F.col("cx") == cell(F.greatest("x0", "ax0"), size)) & (F.col("cy") == cell(F.greatest("y0", "ay0"), size))
    return both.where(meet & corner).select("area", "b")


def pairs_within(points: DataFrame, radius: float, strict: bool = False) -> DataFrame:
    """(a, b, d2) of points (k, x, y) with a < b no farther apart than radius (nearer, if strict).

    Cells of that size; a point meets those of its own cell and, to see each pair once, of four of the eight around it.
    Points with a null coordinate have no pair; rows that repeat a key give no pair with themselves.
    """
    p = points.select("k", "x", "y", cell(F.col("x"), radius).alias("cx"), cell(F.col("y"), radius).alias("cy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))])
    other = p.select(F.col("k").alias("l"), F.col("x").alias("lx"), F.col("y").alias("ly"), "cx", "cy", F.explode(steps).alias("o"))
    other = other.select("l", "lx", "ly", (F.col("cx") + F.col("o.i")).alias("cx"), (F.col("cy") + F.col("o.j")).alias("cy"), ((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("own"))
    d2 = (F.col("x") - F.col("lx")) * (F.col("x") - F.col("lx")) + (F.col("y") - F.col("ly")) * (F.col("y") - F.col("ly"))
    near = F.col("d2") < radius * radius if strict else F.col("d2") <= radius * radius
    both = p.join(other.hint("merge"), ["cx", "cy"]).where(F.when(F.col("own"), F.col("k") < F.col("l")).otherwise(F.col("k") != F.col("l")))
    return both.withColumn("d2", d2).where(near).select(F.least("k", "l").alias("a"), F.greatest("k", "l").alias("b"), "d2")


def capped_cells(points: DataFrame, size: float, most: int, shift: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """points (k, x, y) with their cell, the first `most` of each cell by k; null coordinates are a cell of their own. shift moves the cells."""
    p = points.withColumn("cx", cell(F.col("x") - shift[0], size)).withColumn("cy", cell(F.col("y") - shift[1], size))
    return p.withColumn("place", F.row_number().over(Window.partitionBy("cx", "cy").orderBy("k"))).where(F.col("place") <= most)


def frame_shift(frame: int, size: float = 128.0) -> tuple[float, float]:
    """How far a frame's cells are moved, so that no two points lie in different cells for long: Halton numbers of base 2 and 3."""
    return halton(frame, 2) * size, halton(frame, 3) * size


def collisions(points: DataFrame, size: float = 128.0, reach: float = 5.0, most: int = 256, shift: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """(a, b, dx, dy, d2) of points of one cell nearer than reach and farther than the square root of 0.001.

    Neighbouring cells are not looked at: that is the meaning of this operator. A cell takes part with its first `most` points
    by k; points at the same place do not collide.
    """
    p = capped_cells(points, size, most, shift)
    q = p.select(F.col("k").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"), "cx", "cy")
    pair = p.join(q, ["cx", "cy"]).where("k < b").select(F.col("k").alias("a"), "b", (F.col("bx") - F.col("x")).alias("dx"), (F.col("by") - F.col("y")).alias("dy"))
    return pair.withColumn("d2", F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")).where((F.col("d2") > 0.001) & (F.col("d2") < reach * reach))


def pushes(pairs: DataFrame, reach: float = 5.0) -> DataFrame:
    """(k, fx, fy): the sum of what pushes each point away from those it meets, in proportion to the overlap."""
    d = F.sqrt("d2")
    f = (reach - d) / d / 2
    each = pairs.select("a", "b", (F.col("dx") * f).alias("fx"), (F.col("dy") * f).alias("fy"))
    both = each.select(F.col("a").alias("k"), (-F.col("fx")).alias("fx"), (-F.col("fy")).alias("fy")).union(each.select(F.col("b").alias("k"), "fx", "fy"))
    return both.groupBy("k").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def nearest(queries: DataFrame, points: DataFrame, start: float = 256.0) -> DataFrame:
    """(q, k, d2): for queries (q, x, y) the nearest of points (k, x, y), the smaller k at a tie.

    Rings of cells grow until each query has found a point no farther than the ring reaches; only open queries go on, as
    tables in the shared folder. The first cells are so wide that they hold some four places, or start where all lie on a line;
    points of one place are one row. Queries and points with a null or NaN coordinate are left out; no points, no rows.
    """
    whole = lambda df, k: df.select(k, "x", "y").where("x is not null and y is not null and not isnan(x) and not isnan(y)")
    points, open_ = written(whole(points, "k").groupBy("x", "y").agg(F.min("k").alias("k")).select("k", "x", "y"), "places"), whole(queries, "q")
    box = points.agg(F.count("*"), F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    none = open_.join(points.select("k"), F.lit(False)).select("q", "k", F.lit(0.0).alias("d2"))
    if not box[0]:
        return none
    area = (box[2] - box[1]) * (box[4] - box[3])
    size, done = (2 * (area / box[0]) ** 0.5 if 0 < area < float("inf") else start), []
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    d2 = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
    while True:
        p = points.select("k", F.col("x").alias("px"), F.col("y").alias("py"), cell(F.col("x"), size).alias("cx"), cell(F.col("y"), size).alias("cy"))
        q = open_.select("q", "x", "y", F.explode(around).alias("o"))
        q = q.select("q", "x", "y", (cell(F.col("x"), size) + F.col("o.i")).alias("cx"), (cell(F.col("y"), size) + F.col("o.j")).alias("cy"))
        best = q.join(p.hint("merge"), ["cx", "cy"]).withColumn("d2", d2).groupBy("q").agg(F.min(F.struct("d2", "k")).alias("m"))
        tried = written(open_.join(best, "q", "left").select("q", "x", "y", "m.k", "m.d2", F.coalesce(F.col("m.d2") <= size * size, F.lit(False)).alias("found")), "nearest")
        done.append(tried.where("found").select("q", "k", "d2"))
        open_ = tried.where("not found").select("q", "x", "y")
        if not open_.limit(1).count():
            return reduce(DataFrame.unionAll, done)
        size *= 4


def extracted(points: DataFrame, uses: DataFrame, members: DataFrame, box: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What an extract by a box holds, as (points (v), features (id), groups (grp)): whole features, not only their part inside.

    A feature of uses (id, v) belongs to it if one of its points (v, x, y) lies in the box, borders included; its other points
    belong to it too, and so do points of no feature in the box. A group of members (grp, id) belongs to it if one of its
    features does; its other features don't. Names of points that are not there count for nothing.
    """
    x0, y0, x1, y1 = box
    inside = points.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).select("v")
    features = written(uses.join(inside, "v", "left_semi").select("id").distinct(), "features")
    named = uses.join(features, "id", "left_semi").select("v").distinct().join(points.select("v"), "v", "left_semi")
    return inside.union(named).distinct(), features, members.join(features, "id", "left_semi").select("grp").distinct()
