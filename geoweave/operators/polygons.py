"""Polygon operators whose algorithms are sequential within one ring; groups are merged in stages, never whole in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, functions as F

from geoweave.operators import scans

C = F.col


def hull_of(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Indices of the convex hull, counter-clockwise from the least x, then y; collinear vertices are left out."""
    order = np.lexsort((y, x))
    return order[_hull(x[order].tolist(), y[order].tolist())] if len(order) else order


def _hull(x: list[float], y: list[float]) -> list[int]:
    """The same for points in order of x, then y."""
    order = [i for i in range(len(x)) if not i or x[i] != x[i - 1] or y[i] != y[i - 1]]
    if len(order) < 3:
        return order

    def half(points: list[int]) -> list[int]:
        out: list[int] = []
        for p in points:
            while len(out) > 1 and (x[out[-1]] - x[out[-2]]) * (y[p] - y[out[-2]]) - (y[out[-1]] - y[out[-2]]) * (x[p] - x[out[-2]]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return half(order) + half(order[::-1])


def convex_hulls(points: DataFrame, key: str) -> DataFrame:
    """(key, seq, x, y): the hull of each group of points (key, x, y), in order.

    Groups of 64 points or more in a batch give its own hull only before the shuffle, so a group has a few corners of each
    batch: the hull of hulls is the hull. What is left is sorted, and hulls are taken group after group.
    """
    kind = points.schema[key].dataType.simpleString()

    def hulls(table: pa.RecordBatch, edges: np.ndarray, least: int) -> tuple[list[int], list[int]]:
        x, y = (table.column(i).to_pylist() for i in (1, 2))
        rows, seq = [], []
        for a, b in zip(edges.tolist(), edges[1:].tolist()):
            at = _hull(x[a:b], y[a:b]) if b - a >= least else range(b - a)
            rows += [a + i for i in at]
            seq += range(len(at))
        return rows, seq

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                names = batch.schema.names
                batch = batch.take(pa.compute.sort_indices(batch, sort_keys=[(n, "ascending") for n in names]))
                k = batch.column(0).to_numpy(zero_copy_only=False)
                edges = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1], [True])))
                yield batch.take(pa.array(hulls(batch, edges, 64)[0], pa.int64()))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in scans.groups(batches, 1):
            rows, seq = hulls(table, edges, 0)
            out = table.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([out.column(0), pa.array(seq, pa.int32()), out.column(1), out.column(2)], names=[key, "seq", "x", "y"])

    plain = points.select(key, C("x").cast("double"), C("y").cast("double")).where(f"x is not null and y is not null and {key} is not null")
    rows = plain.mapInArrow(local, f"{key} {kind}, x double, y double")
    return scans.sorted_groups(rows, [key], "x", "y").mapInArrow(merged, f"{key} {kind}, seq int, x double, y double")


def flat_of(x: np.ndarray, y: np.ndarray, area: float) -> np.ndarray:
    """Indices of the vertices of a ring that stay when flat corners go, the first in order at a time.

    The corner after vertex i goes if its triangle with its neighbours is smaller than a threshold: 3 * area where it is
    0.1 off the line between them, less along a straight line to 1 * area at a twentieth of that line's length, and beyond.
    """
    return np.array(_flat_of_few(x.tolist(), y.tolist(), area), np.int64) if len(x) <= 256 else _flat_of_many(x, y, area)


def _flat_of_few(x: list[float], y: list[float], area: float) -> list[int]:
    """flat_of for a few vertices: only the two corners beside one that went are looked at again."""

    def is_flat(i: int, j: int, k: int) -> bool:
        dx, dy, px, py = x[k] - x[i], y[k] - y[i], x[j] - x[i], y[j] - y[i]
        length2 = dx * dx + dy * dy
        t = min(max((px * dx + py * dy) / length2, 0.0), 1.0) if length2 >= 1e-12 else 0.0
        span = 0.05 * length2**0.5 - 0.1
        share = (abs(complex(px - t * dx, py - t * dy)) - 0.1) / span if span else 0.0
        return abs(dx * py - dy * px) / 2 < area * (3 - 2 * share)

    n = len(x)
    keep = list(range(n))
    flat = [is_flat(i, (i + 1) % n, (i + 2) % n) for i in keep]  # of the corner after each
    while len(keep) > 3 and True in flat:
        at = flat.index(True)
        gone = (at + 1) % len(keep)
        del keep[gone], flat[gone]
        n = len(keep)
        at -= gone < at + 1 and gone == 0
        for i in (at - 1, at):
            flat[i] = is_flat(keep[i], keep[(i + 1) % n], keep[(i + 2) % n])
    return keep


def _flat_of_many(x: np.ndarray, y: np.ndarray, area: float) -> np.ndarray:
    keep = np.arange(len(x))
    while len(keep) > 3:
        a, b, c = keep, np.roll(keep, -1), np.roll(keep, -2)
        dx, dy = x[c] - x[a], y[c] - y[a]
        twice = np.abs(dx * (y[b] - y[a]) - dy * (x[b] - x[a]))
        length2 = dx * dx + dy * dy
        t = np.clip(np.divide((x[b] - x[a]) * dx + (y[b] - y[a]) * dy, length2, out=np.zeros(len(keep)), where=length2 >= 1e-12), 0, 1)
        off = np.hypot(x[b] - x[a] - t * dx, y[b] - y[a] - t * dy)
        span = 0.05 * np.sqrt(length2) - 0.1
        share = np.divide(off - 0.1, span, out=np.zeros(len(keep)), where=span != 0)
        flat = np.flatnonzero(twice / 2 < area * (3 - 2 * share))
        if not len(flat):
            break
        keep = np.delete(keep, (flat[0] + 1) % len(keep))
    return keep


def thinned(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Indices of the points of a line that stay when those within tolerance of the rest go: farthest points first."""
    if len(x) <= 32:
        return np.array(_thinned(x.tolist(), y.tolist(), tolerance), np.int64)
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    open_ = [(0, len(x) - 1)]
    while open_:
        i, j = open_.pop()
        if j - i > 1:
            dx, dy = x[j] - x[i], y[j] - y[i]
            px, py = x[i + 1 : j] - x[i], y[i + 1 : j] - y[i]
            length2 = dx * dx + dy * dy
            t = np.clip((px * dx + py * dy) / length2, 0, 1) if length2 else np.zeros(len(px))
            off = (px - t * dx) ** 2 + (py - t * dy) ** 2
            k = int(off.argmax())
            if off[k] > tolerance * tolerance:
                keep[i + 1 + k] = True
                open_ += [(i, i + 1 + k), (i + 1 + k, j)]
    return np.flatnonzero(keep)


def _thinned(x: list[float], y: list[float], tolerance: float) -> list[int]:
    """The same for a few points, without an array for each part."""
    kept, open_ = {0, len(x) - 1}, [(0, len(x) - 1)]
    while open_:
        i, j = open_.pop()
        dx, dy = x[j] - x[i], y[j] - y[i]
        length2 = dx * dx + dy * dy
        k, most = i, -1.0
        for m in range(i + 1, j):
            px, py = x[m] - x[i], y[m] - y[i]
            t = min(max((px * dx + py * dy) / length2, 0.0), 1.0) if length2 else 0.0
            u, v = px - t * dx, py - t * dy
            off = u * u + v * v
            if off > most:
                k, most = m, off
        if most > tolerance * tolerance:
            kept.add(k)
            open_ += [(i, k), (k, j)]
    return sorted(kept)


def _each_ring(rings: DataFrame, which: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """rings (id, ring) with the vertices of each that `which` keeps, batch by batch; null rings stay null."""
    kind = rings.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat, size = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy()
            x, y = (np.asarray(flat.field(i), float) for i in (0, 1))
            ends = np.cumsum(size)
            kept = [e - n + which(x[e - n : e], y[e - n : e]) for e, n in zip(ends.tolist(), size.tolist())]
            at = np.concatenate([np.zeros(0, np.int64), *kept])
            offsets = pa.array(np.append(0, np.cumsum([len(k) for k in kept])), pa.int32(), mask=np.append(lists.is_null().to_numpy(zero_copy_only=False), False))
            points = pa.StructArray.from_arrays([pa.array(x[at]), pa.array(y[at])], names=["x", "y"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, points)], names=["id", "ring"])

    plain = F.transform("ring", lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))
    return rings.select("id", plain.alias("ring")).mapInArrow(run, f"id {kind}, ring array<struct<x double, y double>>")


def flattened(rings: DataFrame, area: float) -> DataFrame:
    """rings (id, ring) without flat corners (see flat_of); a closing vertex goes first. Three vertices stay at least."""
    def which(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n = len(x) - 1 if len(x) > 1 and np.hypot(x[0] - x[-1], y[0] - y[-1]) < 1e-9 else len(x)
        return flat_of(x[:n], y[:n], area)

    return _each_ring(rings, which)


def simplified(rings: DataFrame, tolerance: float) -> DataFrame:
    """rings (id, ring) as closed rings without points within tolerance of the rest; fewer than three points give an empty one."""
    def which(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        keep = thinned(x, y, tolerance) if len(x) > 2 else np.zeros(0, np.int64)
        if len(keep) < 3:
            return np.zeros(0, np.int64)
        return keep if (x[keep[0]], y[keep[0]]) == (x[keep[-1]], y[keep[-1]]) else np.append(keep, keep[0])

    return _each_ring(rings, which)


def clipped_boxes(boxes: DataFrame, size: float) -> DataFrame:
    """boxes (b, x0, ..) cut at the lines of a grid: (b, tx, ty, x0, y0, x1, y1), one row for each tile that a box meets."""
    from geoweave.operators.spatial import with_cells

    low = lambda c, t: F.greatest(F.col(c), F.col(t) * size)
    high = lambda c, t: F.least(F.col(c), (F.col(t) + 1) * size)
    return with_cells(boxes, size).select("b", F.col("cx").alias("tx"), F.col("cy").alias("ty"), low("x0", "cx").alias("x0"), low("y0", "cy").alias("y0"), high("x1", "cx").alias("x1"), high("y1", "cy").alias("y1"))
