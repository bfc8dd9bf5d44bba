"""Convex polygons out of triangles: within a group, a polygon takes in neighbouring triangles as long as it stays convex."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoweave.functions.geometry import cell
from geoweave.operators import scans

C = F.col


def convex_parts(corners: list[tuple[int, int, int]], at: dict[int, tuple[float, float]]) -> list[tuple[list[int], list[int]]]:
    """Polygons (vertex numbers, triangles) that counter-clockwise triangles are merged to.

    A polygon begins at the first free triangle with at most one free neighbour, or the first free one, and takes in the
    triangle beyond its first edge that lets it stay convex; straight corners are convex.
    """
    beyond = {}
    for t, (a, b, c) in enumerate(corners):
        beyond |= {(a, b): (t, c), (b, c): (t, a), (c, a): (t, b)}
    free, out = dict.fromkeys(range(len(corners))), []
    turn = lambda u, v, w: (at[v][0] - at[u][0]) * (at[w][1] - at[u][1]) - (at[v][1] - at[u][1]) * (at[w][0] - at[u][0])
    ways = lambda t: sum(beyond.get((b, a), (None,))[0] in free for a, b in zip(corners[t], corners[t][1:] + corners[t][:1]))
    loose = {t: ways(t) for t in free}  # free neighbours of each

    def take(t: int) -> None:
        del free[t]
        for a, b in zip(corners[t], corners[t][1:] + corners[t][:1]):
            n = beyond.get((b, a), (None,))[0]
            if n in free:
                loose[n] -= 1

    while free:
        t = next((t for t in free if loose[t] <= 1), None)
        t = next(iter(free)) if t is None else t
        take(t)
        ring, held, i = list(corners[t]), [t], 0
        while i < len(ring):
            a, b = ring[i], ring[(i + 1) % len(ring)]
            t, v = beyond.get((b, a), (None, None))
            if t in free and turn(ring[i - 1], a, v) >= 0 and turn(v, b, ring[(i + 2) % len(ring)]) >= 0:
                ring.insert(i + 1, v)
                take(t)
                held.append(t)
                i = 0
            else:
                i += 1
        out.append((ring, held))
    return out


def merged_polygons(triangles: DataFrame, size: float | None = None) -> DataFrame:
    """(poly, ring, tids) for triangles (grp, tid, v1, v2, v3, ax, ay, bx, by, cx, cy), merged to convex polygons within each group.

    poly is the triangle that a polygon begins with, ring has its vertices (x, y, v). Triangles are taken in the order of tid
    and are counter-clockwise. With a size, groups are cut along cells of that size first (by the triangles' middles), which
    bounds what one task takes at a time; polygons then end there. Each triangle is in one polygon; no group, no polygon.
    """
    names = ["tid", "v1", "v2", "v3", "ax", "ay", "bx", "by", "cx", "cy"]
    middle = lambda c: (C(f"a{c}") + C(f"b{c}") + C(f"c{c}")) / 3
    place = [cell(middle(c), size) if size else F.lit(0).cast("long") for c in "xy"]
    rows = triangles.where("grp is not null and v1 is not null and v2 is not null and v3 is not null").select(C("grp").cast("long").alias("grp"), place[0].alias("gx"), place[1].alias("gy"), *[C(n).cast("double" if len(n) == 2 and n[1] in "xy" else "long").alias(n) for n in names])
    point = pa.struct([("x", pa.float64()), ("y", pa.float64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in scans.groups(batches, 3):
            tid, v = table.column(3).to_numpy(), np.stack([table.column(i).to_numpy() for i in (4, 5, 6)], axis=1)
            xy = np.stack([table.column(i).to_numpy() for i in range(7, 13)], axis=1).reshape(-1, 3, 2)
            first, rings, tids = [], [], []
            for a, b in zip(edges.tolist(), edges[1:].tolist()):
                at = dict(zip(v[a:b].ravel().tolist(), map(tuple, xy[a:b].reshape(-1, 2).tolist())))
                for ring, held in convex_parts(list(map(tuple, v[a:b].tolist())), at):
                    first.append(tid[a + held[0]])
                    rings.append([{"x": at[u][0], "y": at[u][1], "v": u} for u in ring])
                    tids.append(tid[a + np.array(held)])
            yield pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(rings, pa.list_(point)), pa.array(tids, pa.list_(pa.int64()))], names=["poly", "ring", "tids"])

    return scans.sorted_groups(rows, ["grp", "gx", "gy"], "tid").mapInArrow(run, "poly long, ring array<struct<x double, y double, v long>>, tids array<long>")
