"""Rings with fewer corners: short edges made points, corners sharpened, parts kept apart; and chains of these for buildings and blobs.

Each step is a function of rings as complex numbers, without a closing vertex; rings go through a chain in Arrow batches.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from geoweave.functions import geometry as g
from geoweave.operators import outlines
from geoweave.operators.polygons import flat_of
from geoweave.shared import shuffle_partitions, written

C = F.col
RING = "array<struct<x double, y double>>"


def _cross(a, b):
    return a.real * b.imag - a.imag * b.real


def _off(p, a, b):
    """Distances of points from segments; any of the three may be arrays."""
    d = b - a
    length2 = np.abs(d) ** 2
    t = np.where(length2 < 1e-12, 0, ((p - a) * np.conj(d)).real / np.where(length2 < 1e-12, 1, length2))
    return np.abs(p - a - np.clip(t, 0, 1) * d)


def _meeting(a: complex, u: complex, b: complex, v: complex) -> complex | None:
    """Where the lines from a along u and from b along v meet."""
    det = _cross(u, v)
    return a + _cross(b - a, v) / det * u if abs(det) >= 1e-9 else None


def _closest(error: Callable[[np.ndarray], np.ndarray], low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places between low and high where error is least, and that error: ever finer rows of places around the best. A column for each of many."""
    column = np.arange(len(low))
    for _ in range(6):
        t = np.linspace(low, high, 33)
        e = error(t)
        k = e.argmin(axis=0)
        low, high = t[np.maximum(k - 1, 0), column], t[np.minimum(k + 1, 32), column]
    return t[k, column], e[k, column]


def points_for(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The points that replace the edges bc of a, b, c, d at the least error, and that error; infinite where there is none.

    The error is how far b lies from am, c from md, or m from bc. If the ring turns one way at b and another at c, m lies on
    bc, where b and c are as far off; where ab and dc are parallel it is the middle of bc; else it is looked for between the
    meeting of ab and dc and that place on bc.
    """
    m, error = np.zeros(len(a), complex), np.full(len(a), np.inf)
    good = np.flatnonzero((np.abs(b - a) >= 1e-9) & (np.abs(d - c) >= 1e-9))
    if not len(good):
        return m, error
    a, b, c, d = a[good], b[good], c[good], d[good]
    ends = lambda m, w=slice(None): np.maximum(_off(b[w], a[w], m), _off(c[w], d[w], m))
    way = lambda t: b + t * (c - b)
    t = _closest(lambda t: np.abs(_off(b, a, way(t)) - _off(c, d, way(t))), np.zeros(len(a)), np.ones(len(a)))[0]
    det = _cross(b - a, c - d)
    bent, level = _cross(b - a, c - b) * _cross(c - b, d - c) < 0, np.abs(det) < 1e-9
    best = np.where(~bent & level, (b + c) / 2, way(t))
    least = ends(best)
    w = np.flatnonzero(~bent & ~level)
    if len(w):
        tip = a[w] + _cross(d[w] - a[w], c[w] - d[w]) / det[w] * (b[w] - a[w])
        line = lambda s: tip + s * (best[w] - tip)
        s, least[w] = _closest(lambda s: np.maximum(ends(line(s), w), _off(line(s), b[w], c[w])), np.zeros(len(w)), np.ones(len(w)))
        best[w] = line(s)
    m[good], error[good] = best, least
    return m, error


def point_for(a: complex, b: complex, c: complex, d: complex) -> tuple[complex | None, float]:
    """points_for one edge; None for no point."""
    m, error = points_for(*(np.array([v]) for v in (a, b, c, d)))
    return (complex(m[0]) if error[0] < np.inf else None), float(error[0])


def all_unrounded(rings: list[np.ndarray], short: float, error: float) -> list[np.ndarray]:
    """In each ring, edges shorter than `short`, in turn from the first, become points where that is possible with less than `error`.

    All rings go on to their next short edge together, so that the points for these are looked for at once.
    """
    out = [p[:-1] if len(p) > 1 and abs(p[0] - p[-1]) < 1e-9 else p for p in rings]
    sizes = np.array([len(p) for p in out], np.int64)
    p = np.concatenate([np.zeros(0, complex), *out])
    onward = np.arange(len(p)) + 1
    onward[np.cumsum(sizes)[sizes > 0] - 1] -= sizes[sizes > 0]
    of = np.repeat(np.arange(len(out)), sizes)
    open_ = {k: (out[k].tolist(), 0) for k in np.unique(of[(np.abs(p[onward] - p) < short * (1 + 1e-9)) & (sizes[of] >= 4)]).tolist()}
    while open_:
        asked = []
        for k, (p, i) in open_.items():
            n = len(p)
            while i < n and n >= 4 and not abs(p[(i + 1) % n] - p[i]) < short:
                i += 1
            if i < n and n >= 4:
                asked.append((k, p, i))
            else:
                out[k] = np.array(p, complex)
        corners = np.array([(p[i - 1], p[i], p[(i + 1) % len(p)], p[(i + 2) % len(p)]) for _, p, i in asked], complex).reshape(-1, 4)
        found, errors = points_for(*corners.T)
        open_ = {}
        for (k, p, i), m, e in zip(asked, found.tolist(), errors.tolist()):
            if e < error and max(abs(m - p[i]), abs(m - p[(i + 1) % len(p)])) >= 1e-5:
                if i + 1 < len(p):
                    p[i : i + 2] = [m]
                else:  # the last corner and the first
                    p = [m, *p[1:-1]]
            open_[k] = p, i + 1
    return out


def unrounded(p: np.ndarray, short: float, error: float) -> np.ndarray:
    """all_unrounded of one ring."""
    return all_unrounded([np.asarray(p, complex)], short, error)[0]


def flat(p: np.ndarray, area: float) -> np.ndarray:
    p = p[:-1] if len(p) > 1 and abs(p[0] - p[-1]) < 1e-9 else p
    return p[flat_of(p.real, p.imag, area)] if len(p) else p


def all_flat(rings: list[np.ndarray], area: float) -> list[np.ndarray]:
    return [flat(p, area) for p in rings]


class _Edges:
    """Edges of a ring, each by the corner that it begins at, in the cells that they come to, give or take `reach`.

    An edge that moved is put in again. What is found in a cell are all that may be near, and are to be looked at as they now are.
    """

    def __init__(self, reach: float, size: float = 16.0):
        self.reach, self.size, self.cells = reach, size, defaultdict(list)

    def put(self, j: int, a: complex, b: complex) -> None:
        a, b = (a, b) if a.real <= b.real else (b, a)
        steep = (b.imag - a.imag) / (b.real - a.real) if b.real > a.real else 0.0
        for x in range(floor((a.real - self.reach) / self.size), floor((b.real + self.reach) / self.size) + 1):
            low, high = a.imag, b.imag
            if steep:  # of a sloping edge the part over these cells
                low, high = (a.imag + steep * (min(max(v, a.real), b.real) - a.real) for v in (x * self.size - self.reach, (x + 1) * self.size + self.reach))
            low, high = min(low, high) - self.reach, max(low, high) + self.reach
            for y in range(floor(low / self.size), floor(high / self.size) + 1):
                self.cells[x, y].append(j)

    def at(self, p: complex) -> list[int]:
        return sorted(set(self.cells.get((floor(p.real / self.size), floor(p.imag / self.size)), ())))


#: Rings of more corners are gone through with their edges in cells.
FEW = 64


def cornered(p: np.ndarray, original: np.ndarray, short: float, near: float) -> np.ndarray:
    """Cut corners made whole again where the original has one.

    An edge shorter than `short` (and longer than the diagonal of `near`) becomes the meeting of the edges beside it if an
    original vertex lies within `near` of it, none of which lies as near to the edge's ends, and no other edge within half of
    `short`. Else, if an original vertex is near one of the two points at right angles over the edge's middle, half its length
    away, and none is near the other one, the end of the edge moves there: the first to the right one, the second to the left one.
    """
    return (_cornered_of_few if len(p) <= FEW else _cornered_of_many)(p, original, short, near)


def _cornered_of_few(p: np.ndarray, original: np.ndarray, short: float, near: float) -> np.ndarray:
    p, i = list(p), 0
    least = near * (np.sqrt(2) + 0.01)
    while i < len(p) and len(p) >= 4:
        n = len(p)
        k, m = (i + 1) % n, (i + 2) % n
        a, b, c, d = p[i], p[k], p[m], p[(i + 3) % n]
        i += 1
        if not least < abs(c - b) < short:
            continue
        own = (np.abs(original - b) > near) & (np.abs(original - c) > near)
        tip = _meeting(a, b - a, d, c - d)
        if tip is not None and abs(tip - b) < short + least:
            q = np.array(p)
            others = [j for j in range(n) if j not in (k, m)]
            if (_off(tip, q[others], np.roll(q, -1)[others]) < short / 2).any():
                continue
            if (own & (np.abs(original - tip) < near)).any():
                p[m] = tip
                del p[k]
                continue
        side = 1j * (c - b) / 2
        right, left = ((own & (np.abs(original - (b + c) / 2 - s) < near)).any() for s in (-side, side))
        if right and not left:
            p[k] = (b + c) / 2 - side
        elif left and not right:
            p[m] = (b + c) / 2 + side
    return np.array(p, complex)


def _cornered_of_many(p: np.ndarray, original: np.ndarray, short: float, near: float) -> np.ndarray:
    """cornered, with a look at edges and original vertices in cells only; corners that go are left out of a chain of them."""
    n, p = len(p), p.tolist()
    onward, gone, head = [*range(1, n), 0], [False] * n, 0
    least = near * (np.sqrt(2) + 0.01)
    edges, vertices = _Edges(short), defaultdict(list)
    for j in range(n):
        edges.put(j, p[j], p[onward[j]])
    for v in original.tolist():
        vertices[floor(v.real / near), floor(v.imag / near)].append(v)

    def seen(at: complex, b: complex, c: complex) -> bool:
        """Whether an original vertex is near a place and none of b and c."""
        x, y = floor(at.real / near), floor(at.imag / near)
        around = (v for i in (-1, 0, 1) for j in (-1, 0, 1) for v in vertices.get((x + i, y + j), ()))
        return any(abs(v - at) < near and abs(v - b) > near and abs(v - c) > near for v in around)

    i, last, left_ = 0, n - 1, n
    while left_ >= 4:
        k = onward[i]
        m = onward[k]
        a, b, c, d = p[i], p[k], p[m], p[onward[m]]
        done, follow = i == last, k
        if least < abs(c - b) < short:
            tip = _meeting(a, b - a, d, c - d)
            beside = tip is not None and abs(tip - b) < short + least
            others = [j for j in edges.at(tip) if not gone[j] and j not in (k, m)] if beside else []
            if others and (_off(tip, np.array([p[j] for j in others]), np.array([p[onward[j]] for j in others])) < short / 2).any():
                pass
            elif beside and seen(tip, b, c):
                p[m], onward[i], gone[k] = tip, m, True
                head, follow, left_ = (m if k == head else head), m, left_ - 1
                edges.put(m, tip, p[onward[m]])
                edges.put(i, a, tip)
                done = done or k == last
            else:
                side = 1j * (c - b) / 2
                right, left = (seen((b + c) / 2 + s, b, c) for s in (-side, side))
                if right and not left:
                    p[k] = (b + c) / 2 - side
                    edges.put(i, a, p[k])
                    edges.put(k, p[k], c)
                elif left and not right:
                    p[m] = (b + c) / 2 + side
                    edges.put(k, b, p[m])
                    edges.put(m, p[m], d)
        if done:
            break
        i = follow
    out, i = [], head
    for _ in range(left_):
        out.append(p[i])
        i = onward[i]
    return np.array(out, complex)


def pulled_apart(p: np.ndarray, least: float, most: float) -> np.ndarray:
    """Corners nearer than `least` to an edge that is not next to them move towards a neighbour, until they are that far from its line.

    Of the moves that do, the one that changes the ring's area least is made, if by no more than `most`.
    """
    p = np.array(p, complex)
    n = len(p)
    edges = _Edges(least) if n > FEW else None
    for j in range(n) if edges else ():
        edges.put(j, p[j], p[(j + 1) % n])
    for i in range(n):
        a, b, c = p[i - 1], p[i], p[(i + 1) % n]
        apart = [j for j in (edges.at(b) if edges else range(n)) if len({j, (j + 1) % n} & {i, (i - 1) % n, (i + 1) % n}) == 0]
        if not apart:
            continue
        u, v = p[apart], p[[(j + 1) % n for j in apart]]
        far = _off(b, u, v)
        close = (far < least) & (far > 1e-6)
        u, v = u[close], v[close]
        unit = (v - u) / np.abs(v - u)
        now = _cross(unit, b - u)
        best, change = None, np.inf
        for anchor in (a, c):
            gain = _cross(unit, anchor - u) - now
            t = np.divide(np.sign(now) * least - now, gain, out=np.full(len(u), -1.0), where=np.abs(gain) >= 1e-6)
            moved = b + t[(np.abs(now) < least) & (t >= 0) & (t <= 1)] * (anchor - b)
            size = np.abs(np.abs(_cross(c - a, moved - a)) - abs(_cross(c - a, b - a))) / 2
            if len(size) and size.min() < change:
                best, change = moved[size.argmin()], size.min()
        if best is not None and change <= most:
            p[i] = best
            for j in ((i - 1) % n, i) if edges else ():
                edges.put(j, p[j], p[(j + 1) % n])
    return p


def reshaped(rings: DataFrame, f: Callable[..., list[np.ndarray]], other: bool = False) -> DataFrame:
    """rings (id, ring) with the rings of a batch as f gives them; with `other`, f gets the points of the column `other` too. Null rings stay null."""
    kind = rings.schema["id"].dataType.simpleString()
    names = ["ring", "other"] if other else ["ring"]

    def points(column: pa.Array) -> list:
        flat_ = column.flatten()
        p = np.asarray(flat_.field(0), float) + 1j * np.asarray(flat_.field(1), float)
        sizes = column.value_lengths().fill_null(0).to_numpy()
        return np.split(p, np.cumsum(sizes)[:-1]) if len(sizes) else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = f(*(points(batch.column(i + 1)) for i in range(len(names))))
            p = np.concatenate([np.zeros(0, complex), *out])
            offsets = pa.array(np.append(0, np.cumsum(list(map(len, out)))), pa.int32(), mask=np.append(batch.column(1).is_null().to_numpy(zero_copy_only=False), False))
            held = pa.StructArray.from_arrays([pa.array(p.real.copy()), pa.array(p.imag.copy())], names=["x", "y"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, held)], names=["id", "ring"])

    plain = lambda c: F.transform(c, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias(c)
    return rings.select("id", *map(plain, names)).mapInArrow(run, f"id {kind}, ring {RING}")


def _kept(rings: DataFrame, safe: float = 20.0) -> DataFrame:
    """rings in centimetres, without those of fewer than three corners and less than a safe area."""
    whole = F.transform("ring", lambda p: g.point(g.round_half_up(p["x"]), g.round_half_up(p["y"])))
    return rings.select("id", whole.alias("ring")).where((F.size("ring") >= 3) | (F.abs(g.signed_area(C("ring"))) >= safe))


def light_rings(rings: DataFrame) -> DataFrame:
    """(id, ring): buildings with short edges and flat corners taken out, little by little."""
    return _kept(reshaped(rings, lambda p: all_flat(all_unrounded(all_flat(all_unrounded(p, 5, 0.25), 1.75), 5, 0.3), 2)))


def strong_rings(rings: DataFrame, by: float = 3.6) -> DataFrame:
    """(id, ring): buildings whose narrow bays are closed, with few corners, which are those of the original where they can be."""

    def chain(p: list[np.ndarray], original: list[np.ndarray]) -> list[np.ndarray]:
        p = all_unrounded(all_flat(all_unrounded(p, 10, 0.45), 3), 10, 0.5)
        p = [cornered(q, o, by + 0.1, 1) for q, o in zip(p, original)]
        return all_unrounded(all_flat(p, 5), 5, 0.55)

    closed = outlines.dilated_eroded(rings, by)
    both = closed.join(rings.select("id", C("ring").alias("other")), "id")
    return _kept(reshaped(both, chain, other=True))


def _near_short(rings: DataFrame, vertices: DataFrame, short: float) -> DataFrame:
    """(id, other): of vertices (id, x, y) those no farther from a short edge of rings (id, ring) with that id than a corner is looked for.

    A corner comes back, and the ends of edges move, by less than two times `short` each; edges up to four times as long may become short.
    """
    size = 8 * short
    e = rings.select("id", F.explode(g._edges(C("ring"))).alias("e")).where(g.distance(C("e.a.x"), C("e.a.y"), C("e.b.x"), C("e.b.y")) < 4 * short)
    at = e.select("id", F.explode(F.array("e.a", "e.b")).alias("p"))
    around = lambda c: F.explode(F.sequence(g.cell(C(f"p.{c}"), size) - 1, g.cell(C(f"p.{c}"), size) + 1))
    cells = at.withColumn("cx", around("x")).withColumn("cy", around("y")).select("id", "cx", "cy").distinct()
    own = vertices.withColumns({"cx": g.cell(C("x"), size), "cy": g.cell(C("y"), size)})
    return own.join(cells, ["id", "cx", "cy"], "left_semi").groupBy("id").agg(F.collect_list(g.point(C("x"), C("y"))).alias("other"))


def simplified_blobs(buildings: DataFrame, by: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """Blobs of buildings (id, ring) nearer to each other than twice `by`, with few corners: (blobs (id, ring), members (id, building)).

    Corners are held against the vertices of the blob's own buildings, of which only those near its short edges go to it. ids are
    longs; a blob's id is that of its first building.
    """
    short = by + 0.1

    def chain(p: list[np.ndarray], original: list[np.ndarray]) -> list[np.ndarray]:
        p = [cornered(q, o, short, 0.5) for q, o in zip(p, original)]
        for reach, error, area in ((10, 0.45, 3), (10, 0.5, 5), (5, 0.55, 7)):
            p = all_flat(all_unrounded(p, reach, error), area)
        return all_unrounded(p, 5, 0.55)

    plain = written(reshaped(buildings, lambda p: all_flat(all_unrounded(p, 10, 0.45), 3)), "plain")
    blobs, members = outlines.united(plain, by)
    named = written(members.groupBy("blob").agg(F.min("id").alias("name")), "named")
    members = members.join(named, "blob").select(C("name").alias("id"), C("id").alias("building"))
    parts = shuffle_partitions(plain.sparkSession)
    rings = blobs.join(named, "blob").select(C("name").alias("id"), "ring").repartition(parts, "id")
    rings = written(reshaped(rings, lambda p: [pulled_apart(q, 1, 5) for q in p]), "rings")
    vertices = members.join(plain.select(C("id").alias("building"), F.explode("ring").alias("p")), "building").select("id", "p.x", "p.y")
    both = rings.join(_near_short(rings, vertices, short), "id", "left").withColumn("other", F.coalesce("other", F.array().cast(RING)))
    return _kept(reshaped(both.repartition(parts, "id"), chain, other=True)), members


def blobs_of(buildings: DataFrame, by: float = 2.0) -> DataFrame:
    """(id, ring, buildings): simplified_blobs with the ids of each blob's buildings as an array, which for a large blob is a large row."""
    blobs, members = simplified_blobs(buildings, by)
    return blobs.join(members.groupBy("id").agg(F.array_sort(F.collect_list("building")).alias("buildings")), "id")
