"""Removal of congruent rings: a spatial self-join on cells of their first vertices, then the survivor by components; and rings that are nearly so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from geoweave.functions import geometry as g
from geoweave.operators import alike, cellwise, graph
from geoweave.operators.locate import with_box
from geoweave.operators.spatial import boxes_in_areas, points_in_boxes
from geoweave.shared import written


def congruent_pairs(rings: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """(a, b), a < b: rings (id, ring) of as many vertices that lie within tolerance of each other, from the canonical one on, and whose boxes share a point.

    The first vertices lie within tolerance too: a ring meets the cell of its own, the other one all that lie within tolerance,
    mostly one, since cells are 16 times as wide.
    """
    c = F.col
    reach = max(tolerance, 1e-6) * 1.001
    size = 16 * reach
    rows = with_box(rings.select("id", "ring")).withColumn("ring", g.canonical(c("ring")))
    first = F.get("ring", F.lit(0))
    rows = rows.withColumns({"n": F.size("ring"), "fx": first["x"].cast("double"), "fy": first["y"].cast("double")})
    around = lambda v: F.explode(F.sequence(g.cell(c(v) - reach, size), g.cell(c(v) + reach, size)))
    other = rows.select(c("id").alias("b"), c("ring").alias("s"), "n", *[c(e).alias(f"o_{e}") for e in ("x0", "y0", "x1", "y1", "fx", "fy")], around("fx").alias("cx"))
    other = other.select("*", around("o_fy").alias("cy"))
    both = rows.withColumnsRenamed({"id": "a", "ring": "r"}).withColumns({"cx": g.cell(c("fx"), size), "cy": g.cell(c("fy"), size)}).join(other.hint("merge"), ["n", "cx", "cy"]).where("a < b")
    near = g.distance(c("fx"), c("fy"), c("o_fx"), c("o_fy")) <= tolerance
    return both.where(g.boxes_meet("", "o_") & near & _within(c("r"), c("s"), tolerance)).select("a", "b")


def _within(r: Column, s: Column, tolerance: float) -> Column:
    return F.forall(F.zip_with(r, s, lambda p, q: g.distance(p["x"], p["y"], q["x"], q["y"])), lambda d: d <= tolerance)


def _measured(rings: DataFrame) -> DataFrame:
    """(id, area, ..) of rings of three vertices or more, with what alike.measured() tells of them, as a table."""
    flat = rings.where(F.size("ring") >= 3).select("id", *[F.col(f"ring.{d}").cast("array<double>").alias(f"{d}s") for d in "xy"])
    return written(flat.mapInArrow(alike.measured, f"id {flat.schema['id'].dataType.simpleString()}, {alike.MEASURES}"), "measured")


def _cells(rows: DataFrame, size: float) -> DataFrame:
    """Rings of _measured() with own centres, as cellwise.dealt() gives them: in a cell are rings with a centre there, and those no
    wider whose box meets it.

    A ring holds most of its own centres. The other has to hold these too, so the box of each lies about those centres of the other,
    and a pair is found by one such centre of the wider in the other's box. Cells are as wide as the boxes in them, by powers of two;
    the wider one is in all grids between the extent of its centres and its own.
    """
    c = F.col
    grade = lambda w: F.greatest(F.ceil(F.log2(F.greatest(w / size, F.lit(1.0)))), F.lit(0)).cast("long")
    wide = F.greatest(c("x1") - c("x0"), c("y1") - c("y0"))
    has = rows.where("mx is not null")
    at = lambda v: F.floor(c(v) / (size * F.pow(F.lit(2.0), c("grade")))).cast("long")
    names = ["grade", "cx", "cy", "id", *[m.split()[0] for m in alike.MEASURES.split(", ")]]
    held = has.withColumn("grade", F.explode(F.sequence(grade(F.greatest(c("u1") - c("u0"), c("v1") - c("v0"))), grade(wide))))
    held = held.withColumns({"cx": at("mx"), "cy": at("my")}).select(names)
    passing = has.withColumn("grade", grade(wide)).withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("y0"), at("y1")))).select(names)
    return cellwise.dealt(held, passing, ["grade", "cx", "cy"], "id")


def _without_own(rows: DataFrame, tolerance: float, size: float = 64.0) -> DataFrame | None:
    """(a, b, smaller) with a ring of _measured() that holds none of its own centres; None where there is no such ring."""
    c = F.col
    none = rows.where("mx is null")
    if not none.limit(1).count():
        return None
    point = rows.where("mx is not null").select(c("id").alias("p"), c("mx").alias("x"), c("my").alias("y"), *[c(e).alias(f"p_{e}") for e in ("u0", "v0", "u1", "v1")])
    box = none.select("id", "x0", "y0", "x1", "y1")
    both = points_in_boxes(point, box, size).where("p_u0 >= x0 and p_u1 <= x1 and p_v0 >= y0 and p_v1 <= y1").select(F.least("p", "id").alias("a"), F.greatest("p", "id").alias("b"))
    area = box.select(c("id").alias("area"), *[c(e).alias(f"a{e}") for e in ("x0", "y0", "x1", "y1")])
    both = both.union(boxes_in_areas(box.withColumnRenamed("id", "b"), area, size).where("area < b"))
    one = rows.select(c("id").alias("a"), "xs", "ys", "own", "turn")
    two = rows.select(c("id").alias("b"), *[c(e).alias(f"o_{e}") for e in ("xs", "ys", "own", "turn")])
    joined = both.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", *one.columns[1:], *two.columns[1:])
    kind = rows.schema["id"].dataType.simpleString()
    good = joined.mapInArrow(lambda batches: alike.alike_rows(batches, tolerance), f"a {kind}, b {kind}")
    areas = good.join(rows.select(c("id").alias("a"), c("area").alias("a_area")), "a").join(rows.select(c("id").alias("b"), c("area").alias("b_area")), "b")
    return areas.select("a", "b", F.when(c("a_area") < c("b_area"), c("a")).otherwise(c("b")).alias("smaller"))


def suspicious_pairs(rings: DataFrame, tolerance: float = 1.0, size: float = 256.0) -> DataFrame:
    """(a, b, smaller), a < b, of rings (id, ring): both hold the same of each other's trio centres, and they are not congruent.

    smaller is the one of less area, b at a tie. Rings of fewer than three vertices are in no pair, nor are those with a coordinate
    that is null or no number. ids are distinct.
    """
    rows = _measured(rings)
    kind = rows.schema["id"].dataType.simpleString()
    found = _cells(rows, size).mapInArrow(lambda batches: alike.pairs(batches, tolerance), f"a {kind}, b {kind}, smaller {kind}")
    more = _without_own(rows, tolerance)
    return found if more is None else found.union(more)


def _smaller_ones(rings: DataFrame, tolerance: float = 1.0, size: float = 256.0) -> DataFrame:
    """(id): the rings that are the smaller one of some suspicious pair, without all the pairs."""
    rows = _measured(rings)
    found = _cells(rows, size).mapInArrow(lambda batches: alike.smaller(batches, tolerance), f"id {rows.schema['id'].dataType.simpleString()}")
    more = _without_own(rows, tolerance)
    return (found if more is None else found.union(more.select("smaller"))).distinct()


def report(rings: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """One row for rings (id, ring): removed, suspicious, remaining, vertices (all) and outer (those of what remains).

    removed: congruent to one of smaller id in their group; suspicious: the smaller of a suspicious pair of those left.
    """
    removed = graph.linked(congruent_pairs(rings, tolerance)).where("node <> label").select(F.col("node").alias("id"))
    left = written(rings.join(removed, "id", "left_anti").select("id", "ring"), "left")
    odd = _smaller_ones(left, tolerance)
    marked = left.select("id", F.size("ring").cast("long").alias("n")).join(odd.withColumn("odd", F.lit(True)), "id", "left")
    n = F.coalesce(F.sum(F.size("ring").cast("long")), F.lit(0))
    after = marked.agg(F.count_if("odd").alias("suspicious"), F.count_if(F.col("odd").isNull()).alias("remaining"), F.coalesce(F.sum(F.when(F.col("odd").isNull(), F.col("n"))), F.lit(0)).alias("outer"), F.count("*").alias("left"))
    return rings.agg(F.count("*").alias("all"), n.alias("vertices")).join(F.broadcast(after)).select((F.col("all") - F.col("left")).alias("removed"), "suspicious", "remaining", "vertices", "outer")


def deduplicated(features: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """features (id, ring, props) with one row for each group of congruent rings: the least id, with keys that only others have.

    Among the others the least id wins a key. Groups are the components of congruent pairs. ids are distinct; rings without
    vertices are congruent to nothing; null props count as empty.
    """
    labels = graph.components(features.select(F.col("id").alias("v")), congruent_pairs(features, tolerance))
    tags = features.join(labels, features["id"] == labels["v"]).select("label", "id", F.explode_outer("props").alias("key", "value"))
    merged = tags.where("key is not null").groupBy("label", "key").agg(F.min_by("value", "id").alias("value")).groupBy("label").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("props"))
    kept = features.join(labels.where("v = label").select(F.col("v").alias("id")), "id").select("id", "ring")
    return kept.join(merged, kept["id"] == merged["label"], "left").select("id", "ring", F.coalesce("props", F.create_map().cast("map<string,string>")).alias("props"))
