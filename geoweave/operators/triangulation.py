"""Constrained Delaunay triangulation of rings with holes, and meshes of the space between blobs.

A polygon with holes is one row and is triangulated alone. A large area is dealt to tiles first: what blobs leave free of a
tile is found by joins on cells (see outlines), so neither the outer ring nor all holes are ever in one task. Edges that
cross a tile's side are cut there, at the same points for both tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoweave.functions import geometry as g, shapes as s
from geoweave.operators import locate, outlines
from geoweave.operators.mesh import vertex_dictionary
from geoweave.shared import shuffle_partitions, written

C = F.col
#: Twice the area in square metres below which a triangle is flat.
FLAT = 1e-9
#: Corners of a ring up to which its ears are looked for without arrays.
FEW = 32


def _turn(a, b, c):
    return (b[..., 0] - a[..., 0]) * (c[..., 1] - a[..., 1]) - (b[..., 1] - a[..., 1]) * (c[..., 0] - a[..., 0])


def _bridged(p: np.ndarray, outer: list[int], hole: list[int]) -> list[int]:
    """The outer ring and a hole within as one ring of vertex numbers, joined where the hole's greatest x sees the outer ring."""
    k = max(range(len(hole)), key=lambda i: tuple(p[hole[i]]))
    m = p[hole[k]]
    a, b = p[outer], p[outer[1:] + outer[:1]]
    spans = np.flatnonzero((a[:, 1] <= m[1]) & (m[1] < b[:, 1]) | (b[:, 1] <= m[1]) & (m[1] < a[:, 1]) | (a[:, 1] == m[1]) & (b[:, 1] == m[1]))
    dy = b[spans, 1] - a[spans, 1]
    x = np.where(dy == 0, np.minimum(a[spans, 0], b[spans, 0]), a[spans, 0] + (m[1] - a[spans, 1]) / np.where(dy == 0, 1, dy) * (b[spans, 0] - a[spans, 0]))
    spans, x = spans[x >= m[0]], x[x >= m[0]]
    e = int(spans[x.argmin()])
    hit = np.array([x.min(), m[1]])
    at = e if a[e, 0] > b[e, 0] else (e + 1) % len(outer)
    # a corner that points into the triangle of m, what the ray hits and that edge's end is seen first
    q, before, after = p[outer], np.roll(p[outer], 1, axis=0), b
    tri = (m, hit, q[at]) if _turn(m, hit, q[at]) >= 0 else (m, q[at], hit)
    inside = (_turn(before, q, after) <= 0) & np.all([_turn(u, v, q) >= 0 for u, v in zip(tri, (*tri[1:], tri[0]))], axis=0)
    inside[at] = True
    near = np.flatnonzero(inside)
    d = q[near] - m
    seen = near[np.lexsort((np.hypot(*d.T), np.abs(np.arctan2(d[:, 1], d[:, 0]))))[0]]
    # where this vertex stands several times, the place whose angle holds the way to m is the right one
    for at in np.flatnonzero((q == q[seen]).all(axis=1)).tolist():
        u, v, w = before[at], q[at], after[at]
        left, right = _turn(u, v, m) >= 0, _turn(v, w, m) >= 0
        if (left and right) if _turn(u, v, w) > 0 else (left or right):
            break
    turned = hole[k:] + hole[:k]
    return outer[: at + 1] + turned + turned[:1] + outer[at:]


def _is_ear(q: np.ndarray, j: int) -> bool:
    """Whether corner j of the ring q can be cut off: no vertex lies in its triangle, and no edge leads in from a vertex at a corner."""
    n = len(q)
    own = [j - 1 if j else n - 1, j, (j + 1) % n]
    a, b, c = (q[i] for i in own)
    held = (_turn(a, b, q) >= 0) & (_turn(b, c, q) >= 0) & (_turn(c, a, q) >= 0)
    held[own] = False
    for k in np.flatnonzero(held).tolist():
        at = [i for i, v in enumerate((a, b, c)) if (q[k] == v).all()]
        if not at:
            return False
        v, right, left = ((a, b, c), (b, c, a), (c, a, b))[at[0]]
        if any(_turn(v, right, w) > FLAT and _turn(v, w, left) > FLAT for w in (q[k - 1], q[(k + 1) % n])):
            return False
    return True


def _ears(p: np.ndarray, ring: list[int]) -> list[list[int]]:
    """Triangles of a counter-clockwise ring of vertex numbers, which may meet itself in bridges."""
    ring, out, i = list(ring), [], 0
    while len(ring) > 3:
        n, q = len(ring), p[ring]
        sharp = _turn(np.roll(q, 1, axis=0), q, np.roll(q, -1, axis=0))
        turned = np.roll(np.arange(n), -i)
        j = next((k for k in turned[sharp[turned] > FLAT].tolist() if _is_ear(q, k)), None)
        if j is None:  # nothing but flat corners is left
            j = int(np.abs(sharp).argmin())
        out.append([ring[j - 1], ring[j], ring[(j + 1) % n]])
        del ring[j]
        i = (j + 1) % len(ring)
    return [*out, ring]


def _turned(a: tuple, b: tuple, c: tuple) -> float:
    """_turn of three places; for a few of them an array costs more than the sum."""
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def _ear_of_few(q: list[tuple], j: int) -> bool:
    n = len(q)
    a, b, c = corners = q[j - 1], q[j], q[(j + 1) % n]
    for k, v in enumerate(q):
        if k == j or k == (j - 1) % n or k == (j + 1) % n or _turned(a, b, v) < 0 or _turned(b, c, v) < 0 or _turned(c, a, v) < 0:
            continue
        if v not in corners:
            return False
        u, right, left = ((a, b, c), (b, c, a), (c, a, b))[corners.index(v)]
        if any(_turned(u, right, w) > FLAT and _turned(u, w, left) > FLAT for w in (q[k - 1], q[(k + 1) % n])):
            return False
    return True


def _ears_of_few(p: list[tuple], ring: list[int]) -> list[list[int]]:
    """_ears of a ring of few corners."""
    ring, out, i = list(ring), [], 0
    while len(ring) > 3:
        n, q = len(ring), [p[v] for v in ring]
        sharp = [_turned(q[k - 1], q[k], q[(k + 1) % n]) for k in range(n)]
        j = next((k for k in (*range(i, n), *range(i)) if sharp[k] > FLAT and _ear_of_few(q, k)), None)
        if j is None:  # nothing but flat corners is left
            j = min(range(n), key=lambda k: abs(sharp[k]))
        out.append([ring[j - 1], ring[j], ring[(j + 1) % n]])
        del ring[j]
        i = (j + 1) % len(ring)
    return [*out, ring]


def _flipped(p: list[tuple], triangles: list[list[int]], fixed: set[tuple[int, int]]) -> list[list[int]]:
    """The triangles after flips of edges that are not fixed, until each circle through one's corners is empty of its neighbours'."""
    of: dict = {}
    for t, (a, b, c) in enumerate(triangles):
        for u, v in ((a, b), (b, c), (c, a)):
            of[u, v] = t
    open_ = [(u, v) for u, v in of if u < v and (v, u) in of and (u, v) not in fixed]
    left = 40 * len(triangles) + 100  # rounding can't make it go on for ever
    while open_ and left:
        left -= 1
        u, v = open_.pop()
        if (u, v) not in of or (v, u) not in of:
            continue
        s_, t = of[u, v], of[v, u]
        c, d = sum(triangles[s_]) - u - v, sum(triangles[t]) - u - v
        if c == d or (c, d) in of or (d, c) in of:
            continue
        pu, pv, pc, pd = p[u], p[v], p[c], p[d]
        if _turned(pc, pd, pv) <= FLAT or _turned(pd, pc, pu) <= FLAT:
            continue  # the four corners make no convex shape
        flat = min(_turned(pu, pv, pc), _turned(pv, pu, pd)) <= FLAT
        if not flat:
            (ax, ay), (bx, by), (cx, cy) = ((q[0] - pd[0], q[1] - pd[1]) for q in (pu, pv, pc))
            a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
            if ax * (by * c2 - b2 * cy) - ay * (bx * c2 - b2 * cx) + a2 * (bx * cy - by * cx) <= 1e-9 * max(map(abs, (ax, ay, bx, by, cx, cy))) ** 4:
                continue
        triangles[s_], triangles[t] = [c, d, v], [d, c, u]
        for key in ((u, v), (v, u)):
            del of[key]
        for n, (x, y, z) in ((s_, triangles[s_]), (t, triangles[t])):
            for e in ((x, y), (y, z), (z, x)):
                of[e] = n
        for x, y in ((u, c), (c, v), (v, d), (d, u)):
            e = (min(x, y), max(x, y))
            if e not in fixed and (e[1], e[0]) in of:
                open_.append(e)
    return triangles


def triangles_of(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Corners, and triangles as rows of three numbers, counter-clockwise, for an outer ring and its holes; each ring's edges stay.

    Rings have either winding and no closing corner; corners that repeat the one before are left out. Fewer than three give nothing.
    """
    kept, numbers, n = [], [], 0
    for i, r in enumerate(rings):
        r = r[(r != np.roll(r, 1, axis=0)).any(axis=1)] if len(r) else r
        if len(r) < 3:
            if not i:
                return np.zeros((0, 2)), np.zeros((0, 3), np.int64)
            continue
        area = (r[:, 0] * np.roll(r[:, 1], -1) - r[:, 1] * np.roll(r[:, 0], -1)).sum()
        kept.append(r if (area > 0) == (not i) else r[::-1])
        numbers.append(list(range(n, n + len(r))))
        n += len(r)
    p = np.concatenate(kept)
    fixed = {(min(a, b), max(a, b)) for ring in numbers for a, b in zip(ring, ring[1:] + ring[:1])}
    ring = numbers[0]
    for hole in sorted(numbers[1:], key=lambda h: -p[h][:, 0].max()):
        ring = _bridged(p, ring, hole)
    places = list(map(tuple, p.tolist()))
    found = _flipped(places, _ears_of_few(places, ring) if len(ring) <= FEW else _ears(p, ring), fixed)
    return p, np.array([t for t in found if abs(_turned(*(places[v] for v in t))) > FLAT], np.int64).reshape(-1, 3)


def triangulated(polygons: DataFrame) -> DataFrame:
    """(id, t, ax, ay, bx, by, cx, cy) for polygons (id, ring, holes): a constrained Delaunay triangulation of each.

    holes is an array of rings, null for none; they lie inside the ring, apart from each other. Every edge of a ring is one
    of a triangle, and triangles are counter-clockwise. Null rings and such of fewer than three corners have no row.
    """
    kind = polygons.schema["id"].dataType.simpleString()
    names = ["id", "t", "ax", "ay", "bx", "by", "cx", "cy"]
    plain = lambda ring: F.transform(ring, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, counts = [np.zeros((0, 7))], []
            for rings in batch.column(1).to_pylist():
                p, t = triangles_of([np.array(r, float).reshape(-1, 2) for r in rings or []] or [np.zeros((0, 2))])
                rows.append(np.column_stack((np.arange(len(t)), p[t].reshape(-1, 6))))
                counts.append(len(t))
            flat = np.concatenate(rows)
            at = pa.array(np.repeat(np.arange(len(counts)), counts))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(flat[:, 0].astype(np.int32)), *map(pa.array, flat[:, 1:].T)], names=names)

    rings = F.transform(F.concat(F.array("ring"), F.coalesce("holes", F.array().cast(polygons.schema["holes"].dataType))), plain)
    return polygons.where("ring is not null").select("id", rings.alias("rings")).mapInArrow(run, f"id {kind}, t int, " + ", ".join(f"{n} double" for n in names[2:]))


def with_holes(outlined: DataFrame) -> DataFrame:
    """(grp, part, ring, holes) for outlines (grp, part, ring, hole): each outer ring with the holes inside it."""
    outer = outlined.where("not hole").select("grp", "part", "ring")
    inner = outlined.where("hole").select("grp", C("part").alias("h"), C("ring").alias("own"))
    first = F.get("own", F.lit(0))
    # a hole may touch the outer ring in a corner, so the middle of its first edge is asked for
    mid = g.point((first["x"] + F.get("own", F.lit(1))["x"]) / 2, (first["y"] + F.get("own", F.lit(1))["y"]) / 2)
    pairs = inner.withColumn("m", mid).join(outer, "grp").where(s.in_ring(C("m.x"), C("m.y"), C("ring")))
    least = pairs.groupBy("grp", "h").agg(F.min_by("part", F.struct(F.abs(g.signed_area(C("ring"))), "part")).alias("part"), F.first("own").alias("own"))
    held = least.groupBy("grp", "part").agg(F.collect_list("own").alias("holes"))
    return outer.join(held, ["grp", "part"], "left")


def free_space(blobs: DataFrame, box: tuple[float, float, float, float], size: float) -> DataFrame:
    """(tx, ty, part, ring, holes): what blobs (blob, ring) leave free of the tiles of a size that meet a box; blob is a long.

    Blobs may overlap and cross the sides of tiles, but none crosses itself. Tiles without a blob are one square.
    """
    spark = blobs.sparkSession
    tx0, ty0, tx1, ty1 = (int(v // size) for v in box)
    tiles = spark.range(tx0, tx1 + 1).select(C("id").alias("tx")).withColumn("ty", F.explode(F.sequence(F.lit(ty0), F.lit(ty1)))).withColumn("ty", C("ty").cast("long"))
    side = lambda c, k: (C(c) + k) * size
    square = locate.ring_of_xy((side("tx", 0), side("ty", 0)), (side("tx", 1), side("ty", 0)), (side("tx", 1), side("ty", 1)), (side("tx", 0), side("ty", 1)))
    grp = F.struct("tx", "ty")
    whole = tiles.select(grp.alias("grp"), F.struct(F.lit(-1).cast("long").alias("blob"), "tx", "ty").alias("rid"), square.alias("ring"))
    plain = outlines.cleaned(blobs.select("blob", "ring"))
    met = locate.shape_cells(plain, size).select("blob", F.reverse("ring").alias("ring"), C("cx").alias("tx"), C("cy").alias("ty")).where(C("tx").between(tx0, tx1) & C("ty").between(ty0, ty1))
    # blobs are cut out by going around them the other way
    holes = met.select(grp.alias("grp"), F.struct("blob", "tx", "ty").alias("rid"), "ring")
    rings = written(whole.union(holes).withColumn("rid", F.xxhash64("rid.blob", "rid.tx", "rid.ty")).withColumn("grp", F.xxhash64("grp.tx", "grp.ty")), "tiles")
    names = tiles.select(F.xxhash64("tx", "ty").alias("grp"), "tx", "ty")
    cell = min(size / 4, 32.0)
    full = written(outlines.full_cells(written(holes.select(F.xxhash64("grp.tx", "grp.ty").alias("grp"), "ring"), "blobs"), cell), "full")
    free = written(outlines.outlines(rings, cell, full=full), "free")
    # few bytes, but much work for each
    return with_holes(free).join(names, "grp").select("tx", "ty", "part", "ring", "holes").repartition(shuffle_partitions(spark), "tx", "ty", "part")


def free_mesh(blobs: DataFrame, box: tuple[float, float, float, float], size: float = 1024.0) -> tuple[DataFrame, DataFrame]:
    """A mesh of the space between blobs and of the blobs: (vertices (vid, x, y), triangles (tid, v1, v2, v3, tx, ty, blob)).

    blob is null for walkable triangles. Vertices are taken to centimetres and numbered by place, triangles are numbered with
    gaps. Triangles that become flat by that are left out.
    """
    free = free_space(blobs, box, size).select(F.struct("tx", "ty", F.lit(None).cast("long").alias("blob"), "part").alias("id"), "ring", "holes")
    none = F.lit(None).cast("long")
    full = blobs.select(F.struct(none.alias("tx"), none.alias("ty"), C("blob").cast("long").alias("blob"), none.alias("part")).alias("id"), "ring", F.lit(None).cast("array<array<struct<x:double,y:double>>>").alias("holes"))
    rows = written(triangulated(free.unionByName(full)), "triangles")
    corner = lambda c: F.struct(*[F.floor(C(f"{c}{d}") * 100 + 0.5).cast("long").alias(f"s{d}") for d in "xy"])
    points = rows.select(F.explode(F.array(*[F.struct(C(f"{c}x").alias("x"), C(f"{c}y").alias("y")) for c in "abc"])).alias("p")).select("p.x", "p.y")
    words = written(vertex_dictionary(points), "vertices")
    out = rows.select("id.*", F.xxhash64("id", "t").alias("tid"), *[corner(c).alias(c) for c in "abc"])
    for i, c in enumerate("abc"):
        out = out.join(words.select(C("sx"), C("sy"), C("vid").alias(f"v{i + 1}")), (C(f"{c}.sx") == C("sx")) & (C(f"{c}.sy") == C("sy"))).drop("sx", "sy")
    out = out.where("v1 <> v2 and v2 <> v3 and v3 <> v1").select("tid", "v1", "v2", "v3", "tx", "ty", "blob")
    return words.select("vid", (C("sx") / 100).alias("x"), (C("sy") / 100).alias("y")), out
