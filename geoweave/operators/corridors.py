"""Routes between many pairs of places at once: corridors of polygons, their corners, and corridors along the straight line.

Searches are rounds of joins in which all pairs step together; a way that can't beat the pair's best is not followed. What
is sequential within one route (walking back, pulling the string, cutting loops) is a scan over its sorted rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from geoweave.functions import geometry as g, shapes as s
from geoweave.operators import graph, scans
from geoweave.shared import written

C = F.col
#: Points no farther apart than this along either axis are the same.
SAME = 1e-6


def search(pairs: DataFrame, centres: DataFrame, edges: DataFrame, free: float = 0.0, stray: float = 0.0) -> DataFrame:
    """(p, step, v, cost): the cheapest corridor of each of pairs (p, start, goal) over edges (a, b), one way, step 0 at the start.

    A step costs the distance between the middles of centres (v, x, y); v farther than `free` from the straight line from start
    to goal costs `stray` times what it is farther, too, and up to three times that if it lies back. The estimate of what is
    left is the distance to the goal, which never is too much, so the corridors are the cheapest there are; of equal ones that
    with the least node before each. Pairs without a way have no row; cost is that from the start.

    Open ways are rows (pair, node) in the shared folder; those that with the estimate come to more than the pair's best way to
    its goal are dropped. There are as many rounds as the longest corridor has steps.
    """
    at = lambda c, v: centres.select(C("v").alias(v), C("x").alias(f"{c}x"), C("y").alias(f"{c}y"))
    whole = pairs.select("p", "start", "goal").distinct().join(at("s", "start"), "start").join(at("g", "goal"), "goal")
    keep = ["p", "goal", "sx", "sy", "gx", "gy"]
    far = lambda ax, ay, bx, by: g.distance(C(ax), C(ay), C(bx), C(by))
    first = whole.select(*keep, C("start").alias("v"), C("sx").alias("x"), C("sy").alias("y"), F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("via"))
    ways = written(edges.select("a", "b").distinct().join(at("a", "a"), "a").join(at("b", "b"), "b").select("a", "b", "bx", "by", far("ax", "ay", "bx", "by").alias("w")), "ways")
    length = far("sx", "sy", "gx", "gy")
    dx, dy, vx, vy = C("gx") - C("sx"), C("gy") - C("sy"), C("bx") - C("sx"), C("by") - C("sy")
    off = F.coalesce(F.abs(s.cross(dx, dy, vx, vy)) / F.nullif(length, F.lit(0.0)), F.sqrt(vx * vx + vy * vy))
    ahead = F.coalesce(s.dot(vx, vy, dx, dy) / F.nullif(length * F.sqrt(vx * vx + vy * vy), F.lit(0.0)), F.lit(1.0))
    toll = F.greatest(off - free, F.lit(0.0)) * stray * (2 - ahead) if stray else F.lit(0.0)
    best = written(first, "best")
    open_ = best
    while True:
        tried = open_.select(*keep, C("v").alias("a"), "cost").join(ways, "a").withColumn("cost", C("cost") + C("w") + toll)
        least = tried.groupBy(*keep, C("b").alias("v"), C("bx").alias("x"), C("by").alias("y")).agg(F.min(F.struct("cost", C("a").alias("via"))).alias("n"))
        bound = best.where("v = goal").select("p", C("cost").alias("bound"))
        least = least.join(bound, "p", "left").where(C("bound").isNull() | (C("n.cost") + far("x", "y", "gx", "gy") <= C("bound") + 1e-9)).drop("bound")
        known = best.select("p", "v", C("cost").alias("old"), C("via").alias("old_via"))
        better = C("old").isNull() | (C("n.cost") < C("old")) | ((C("n.cost") == C("old")) & (C("n.via") < C("old_via")))
        fresh = written(least.join(known, ["p", "v"], "left").where(better).select(*first.columns[:9], "n.cost", "n.via"), "open")
        if not fresh.limit(1).count():
            break
        best = written(best.join(fresh.select("p", "v"), ["p", "v"], "left_anti").select(*first.columns).union(fresh.select(*first.columns)), "best")
        open_ = fresh
    return _walked(best)


def _walked(best: DataFrame) -> DataFrame:
    """The ways back from each pair's goal in best (p, v, via, cost, goal), turned around."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in scans.groups(batches, 1):
            p, cost = table.column(0), table.column(3).to_numpy()
            v, via, goal = (table.column(i).to_pylist() for i in (1, 2, 4))
            rows, steps = [], []
            for a, b in zip(edges.tolist(), edges[1:].tolist()):
                at = {v[i]: i for i in range(a, b)}
                i, way = at.get(goal[a]), []
                while i is not None:
                    way.append(i)
                    i = at.get(via[i])
                rows += way[::-1]
                steps += range(len(way))
            if rows:
                picked = pa.array(rows)
                yield pa.RecordBatch.from_arrays([p.take(picked), pa.array(steps, pa.int32()), table.column(1).take(picked), pa.array(cost[rows])], names=["p", "step", "v", "cost"])

    kinds = dict(best.dtypes)
    return scans.sorted_groups(best.select("p", "v", "via", "cost", "goal"), ["p"], "v").mapInArrow(run, f"p {kinds['p']}, step int, v {kinds['v']}, cost double")


def pulled(left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Where a string through portals, pulled tight, bends: (portal, 0 for its left end or 1 for its right), with the last portal's left.

    The first and the last portal are points. Areas decide: a side moves on as long as the opening gets no wider, and where it
    would cross the other side, that side's end is a corner and the scan goes on from there.
    """
    ends, apex, out, i = (left, right), left[0], [], 1
    side = [0, 0]  # the portals whose ends hold the opening
    point = [apex, apex]
    twice = lambda a, b, c: (c[0] - a[0]) * (b[1] - a[1]) - (b[0] - a[0]) * (c[1] - a[1])
    same = lambda a, b: abs(a[0] - b[0]) < SAME and abs(a[1] - b[1]) < SAME
    while i < len(left):
        bend = None
        for k, sign in ((1, -1), (0, 1)):
            new = ends[k][i]
            if sign * twice(apex, point[k], new) >= 0:
                if same(apex, point[k]) or sign * twice(apex, point[1 - k], new) < 0:
                    point[k], side[k] = new, i
                else:
                    bend = 1 - k
                    break
        if bend is None:
            i += 1
            continue
        if side[bend] == len(left) - 1:
            break
        out.append((side[bend], bend))
        apex, i = point[bend], side[bend] + 1
        point, side = [apex, apex], [side[bend], side[bend]]
    last = ends[out[-1][1]][out[-1][0]] if out else None
    return out if out and same(last, left[-1]) else [*out, (len(left) - 1, 0)]


def corners(corridors: DataFrame, doors: DataFrame, ends: DataFrame) -> DataFrame:
    """(p, i, x, y, v, poly): the corners of the shortest way through corridors (p, step, v), from i = 0 at the start to the end.

    doors: portals between polygons (see routes.portals). ends (p, sx, sy, ex, ey): where each route begins and ends. v is the
    vertex that a corner is, null for the ends; poly is the polygon that is left there. Routes without ends, or with a step
    between polygons that have no portal, have no row.
    """
    onward = Window.partitionBy("p").orderBy("step")
    steps = corridors.select("p", "step", C("v").alias("poly"), F.lead("v").over(onward).alias("neighbour"))
    inner = steps.join(doors, ["poly", "neighbour"]).select("p", "step", "poly", "lx", "ly", "rx", "ry", "left_v", "right_v")
    n = corridors.groupBy("p").agg(F.max("step").alias("last"), F.max_by("v", "step").alias("goal"), F.min_by("v", "step").alias("start"))
    whole = ends.join(n, "p")
    none = F.lit(None).cast("long")
    point = lambda step, poly, c: whole.select("p", step.cast("int").alias("step"), C(poly).alias("poly"), *[C(f"{c}{d}").alias(f"{e}{d}") for e in "lr" for d in "xy"], none.alias("left_v"), none.alias("right_v"))
    rows = inner.union(point(F.lit(-1), "start", "s")).union(point(C("last"), "goal", "e"))
    complete = rows.groupBy("p").agg(F.count("*").alias("k")).join(n, "p").where("k = last + 2").select("p")
    rows = rows.join(complete, "p")
    kinds = dict(corridors.dtypes)
    fields = f"p {kinds['p']}, i int, x double, y double, v long, poly {kinds['v']}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in scans.groups(batches, 1):
            lx, ly, rx, ry = (table.column(i).to_numpy() for i in range(3, 7))
            ends_, names = (np.stack((lx, ly), axis=1), np.stack((rx, ry), axis=1)), [table.column(i).to_pylist() for i in (7, 8)]
            rows, no, xy, v = [], [], [], []
            for a, b in zip(edges.tolist(), edges[1:].tolist()):
                way = [(0, 0), *pulled(ends_[0][a:b], ends_[1][a:b])]
                rows += [a + i for i, _ in way]
                no += range(len(way))
                xy += [ends_[k][a + i] for i, k in way]
                v += [names[k][a + i] for i, k in way]
            x, y = np.array(xy).T
            picked = pa.array(rows)
            yield pa.RecordBatch.from_arrays([table.column(0).take(picked), pa.array(no, pa.int32()), pa.array(x), pa.array(y), pa.array(v, pa.int64()), table.column(2).take(picked)], names=["p", "i", "x", "y", "v", "poly"])

    names = ["p", "step", "poly", "lx", "ly", "rx", "ry", "left_v", "right_v"]
    return scans.sorted_groups(rows.select(names), ["p"], "step").mapInArrow(run, fields)


def offset_corners(found: DataFrame, blobs: DataFrame, by: float) -> DataFrame:
    """Corners (p, i, x, y, v, ...) with blob, and with x and y moved away from it by `by`.

    The blob of a corner is the first of blobs (blob, ring with vertex numbers) that has its vertex; the corner moves along
    the sum of the directions of the two edges that meet in it. Ends, corners of no blob and straight ones stay.
    """
    n = F.size("ring")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.get("ring", (i + n - 1) % n).alias("a"), F.get("ring", i).alias("b"), F.get("ring", (i + 1) % n).alias("c")))
    parts = blobs.where(n > 2).select("blob", F.explode(each).alias("e"))
    around = parts.groupBy(C("e.b.v").alias("v")).agg(F.min(F.struct("blob", *[C(f"e.{k}.{d}").alias(f"{k}{d}") for k in "abc" for d in "xy"])).alias("m"))
    rows = found.join(around, "v", "left").withColumn("moved", s.miter(*[C(f"m.{k}{d}") for k in "abc" for d in "xy"], by))
    others = [c for c in found.columns if c not in ("x", "y")]
    return rows.select(*others, *[F.coalesce(C(f"moved.{d}"), C(d)).alias(d) for d in "xy"], C("m.blob").alias("blob"))


def shortened(way: list, near: dict) -> list:
    """A way without loops, and without the one or two nodes between those that are neighbours anyway."""
    out: list = []
    place: dict = {}
    for v in way:
        if v in place:
            for u in out[place[v] + 1 :]:
                del place[u]
            del out[place[v] + 1 :]
        else:
            place[v] = len(out)
            out.append(v)
    i = 0
    while i < len(out) - 2:
        if i + 3 < len(out) and out[i + 3] in near[out[i]]:
            del out[i + 1 : i + 3]
        elif out[i + 2] in near[out[i]]:
            del out[i + 1]
        else:
            i += 1
    return out


def along_line(pairs: DataFrame, passed: DataFrame, centres: DataFrame, edges: DataFrame, free: float = 0.0, stray: float = 0.0) -> DataFrame:
    """(p, step, v): corridors of pairs (p, start, goal) that keep to the straight line where it is free, and go around what isn't.

    passed (p, t, v): the polygons that the line from start to goal passes, by t. Those that edges (a, b) tie to the start are
    kept in spans; a span ends where the line leaves them, and a search (see search) leads from its last polygon to the first
    of the next span, at last to the goal. Then loops are cut, and short cuts over one or two polygons taken. Pairs whose goal
    can't be reached from the start have no row; edges go both ways.
    """
    both = written(edges.select("a", "b").union(edges.select(C("b").alias("a"), C("a").alias("b"))).distinct(), "both")
    part = written(graph.components(centres, both), "parts")
    named = pairs.select("p", "start", "goal").distinct().join(part.select(C("v").alias("start"), "label"), "start").join(part.select(C("v").alias("goal"), C("label").alias("l2")), "goal").where("label = l2").drop("l2")
    met = passed.groupBy("p", "v").agg(F.min("t").alias("t")).join(named, "p").join(part.select("v", C("label").alias("mine")), "v", "left")
    ends = named.select("p", F.lit(-1.0).alias("t"), C("start").alias("v"), F.lit(True).alias("open"), C("start").alias("gate")).union(named.select("p", F.lit(2.0), "goal", F.lit(True), C("goal")))
    line = met.where("v <> start and v <> goal").select("p", "t", "v", F.coalesce(C("mine") == C("label"), F.lit(False)).alias("open"), "v").union(ends)
    w = Window.partitionBy("p").orderBy("t", "v")
    steps = line.withColumn("no", F.row_number().over(w)).where("open").select("p", "no", "v")
    # a gap: two of the kept that no edge joins
    pair = steps.withColumns({"next": F.lead("v").over(Window.partitionBy("p").orderBy("no"))}).where("next is not null")
    gaps = written(pair.join(both.select(C("a").alias("v"), C("b").alias("next")), ["v", "next"], "left_anti").select("p", "no", C("v").alias("start"), C("next").alias("goal")), "gaps")
    key = F.struct("start", "goal")
    asked = gaps.select("start", "goal").distinct().select(F.xxhash64(key).alias("p"), "start", "goal")
    found = written(search(asked, centres, both, free, stray), "bridges").where("step > 0")
    bridges = gaps.withColumn("q", F.xxhash64(key)).join(found.select(C("p").alias("q"), C("step").alias("part"), "v"), "q").select("p", "no", "part", "v")
    rows = steps.select("p", "no", F.lit(0).alias("part"), "v").union(bridges)
    near = both.groupBy(C("a").alias("v")).agg(F.collect_set("b").alias("near"))
    rows = rows.join(near, "v", "left").select("p", "no", "part", "v", "near")
    kinds = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges_ in scans.groups(batches, 1):
            v, around = table.column(3).to_pylist(), table.column(4).to_pylist()
            rows_, no, ways = [], [], []
            for a, b in zip(edges_.tolist(), edges_[1:].tolist()):
                way = shortened(v[a:b], {v[i]: set(around[i] or ()) for i in range(a, b)})
                rows_ += [a] * len(way)
                no += range(len(way))
                ways += way
            yield pa.RecordBatch.from_arrays([table.column(0).take(pa.array(rows_)), pa.array(no, pa.int32()), pa.array(ways, table.column(3).type)], names=["p", "step", "v"])

    return scans.sorted_groups(rows, ["p"], "no", "part").mapInArrow(run, f"p {kinds['p']}, step int, v {kinds['start']}")
