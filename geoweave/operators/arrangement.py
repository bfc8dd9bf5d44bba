"""Outlines of rings of few corners, each alone: what `outlines` does by joins, over all rings of an Arrow batch by array operations.

A ring that is a group of its own and has few corners needs no join on cells: its edges are held against each other where
the ring lies. Edges, pieces and sides of all rings are rows of arrays in the order of their rings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from geoweave.operators.polygons import thinned

#: Pairs of rows looked at together.
PAIRS = 2**20


def _pairs(ga: np.ndarray, gb: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of ga with all rows of gb of the same ring, both ascending, so many at a time."""
    lo = np.searchsorted(gb, ga, "left")
    n = np.searchsorted(gb, ga, "right") - lo
    ends, at = np.cumsum(n), 0
    while at < len(ga):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + PAIRS, "right")))
        m = n[at:to]
        yield np.repeat(np.arange(at, to), m), np.arange(m.sum()) + np.repeat(lo[at:to] - np.cumsum(m) + m, m)
        at = to


def _cuts(g: np.ndarray, e: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, points): where edges e (ax, ay, bx, by) are to be cut by others of their ring; see outlines._cuts."""
    touch, rows, points = 0.75 * step, [np.zeros(0, np.int64)], [np.zeros((2, 0))]
    x0, y0, x1, y1 = np.minimum(e[0], e[2]) - touch, np.minimum(e[1], e[3]) - touch, np.maximum(e[0], e[2]) + touch, np.maximum(e[1], e[3]) + touch

    def add(of: np.ndarray, px: np.ndarray, py: np.ndarray, good: np.ndarray) -> None:
        ax, ay, bx, by = e[:, of]
        good = good & ((px != ax) | (py != ay)) & ((px != bx) | (py != by))
        rows.append(of[good])
        points.append(np.stack((px[good], py[good])))

    def touching(of: np.ndarray, px: np.ndarray, py: np.ndarray) -> None:
        ax, ay, bx, by = e[:, of]
        dx, dy = bx - ax, by - ay
        length2 = dx * dx + dy * dy
        t = np.where(length2 < 1e-12, 0.0, ((px - ax) * dx + (py - ay) * dy) / length2)
        t = np.clip(t, 0.0, 1.0)
        u, v = px - (ax + t * dx), py - (ay + t * dy)
        add(of, px, py, np.sqrt(u * u + v * v) <= touch)

    for i, j in _pairs(g, g):
        near = (i < j) & (x0[i] <= x1[j]) & (x0[j] <= x1[i]) & (y0[i] <= y1[j]) & (y0[j] <= y1[i])
        i, j = i[near], j[near]
        ax, ay, bx, by = e[:, i]
        cx, cy, dx, dy = e[:, j]
        rx, ry, sx, sy = bx - ax, by - ay, dx - cx, dy - cy
        det = rx * sy - ry * sx
        safe = np.where(det == 0, 1.0, det)
        t, u = ((cx - ax) * sy - (cy - ay) * sx) / safe, ((cx - ax) * ry - (cy - ay) * rx) / safe
        cross = (det != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1)
        px, py = np.floor((ax + t * rx) / step + 0.5) * step, np.floor((ay + t * ry) / step + 0.5) * step
        for of in (i, j):
            add(of, px, py, cross)
        touching(i, cx, cy)
        touching(i, dx, dy)
        touching(j, ax, ay)
        touching(j, bx, by)
    return np.concatenate(rows), np.concatenate(points, axis=1)


def cut_rows(batches: Iterator[pa.RecordBatch], step: float) -> Iterator[pa.RecordBatch]:
    """Pairs of edges (grp, rid, i, ax, ay, bx, by, o_ax, o_ay, o_bx, o_by, turned) to the points (.., px, py) where the first is cut.

    That is where it crosses the other one, and at ends of the other that are nearer than three quarters of a step; never at its own ends.
    """
    for batch in batches:
        mine, other = ([batch.column(i).to_numpy() for i in at] for at in (range(3, 7), range(7, 11)))
        turned = batch.column(11).to_numpy(zero_copy_only=False)
        (ax, ay, bx, by), (cx, cy, dx, dy) = ([np.where(turned, v, u) for u, v in zip(a, b)] for a, b in ((mine, other), (other, mine)))
        rx, ry, sx, sy = bx - ax, by - ay, dx - cx, dy - cy
        det = rx * sy - ry * sx
        safe = np.where(det == 0, 1.0, det)
        t, u = ((cx - ax) * sy - (cy - ay) * sx) / safe, ((cx - ax) * ry - (cy - ay) * rx) / safe
        crossing = (np.floor((ax + t * rx) / step + 0.5) * step, np.floor((ay + t * ry) / step + 0.5) * step)
        found = [((det != 0) & (t > 0) & (t < 1) & (u > 0) & (u < 1), *crossing)]
        ax, ay, bx, by = mine
        dx, dy = bx - ax, by - ay
        length2 = dx * dx + dy * dy
        point = length2 < 1e-12
        for px, py in (other[:2], other[2:]):
            t = np.clip(np.where(point, 0.0, ((px - ax) * dx + (py - ay) * dy) / np.where(point, 1.0, length2)), 0.0, 1.0)
            u, v = px - (ax + t * dx), py - (ay + t * dy)
            found.append((np.sqrt(u * u + v * v) <= 0.75 * step, px, py))
        good = [np.flatnonzero(is_cut & ((px != ax) | (py != ay)) & ((px != bx) | (py != by))) for is_cut, px, py in found]
        cut = batch.take(pa.array(np.concatenate(good)))
        points = [pa.array(np.concatenate([f[k][rows] for f, rows in zip(found, good)])) for k in (1, 2)]
        yield pa.RecordBatch.from_arrays([*cut.columns[:7], *points], names=[*batch.schema.names[:7], "px", "py"])


def _pieces(g: np.ndarray, e: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """(g, e): the edges cut where those of a ring meet, until nothing is left to cut."""
    done = []
    while len(g):
        rows, p = _cuts(g, e, step)
        again = np.isin(g, g[rows])
        done.append((g[~again], e[:, ~again]))
        own = np.flatnonzero(again)
        of = np.concatenate((own, own, rows))
        x, y = np.concatenate((e[0, own], e[2, own], p[0])), np.concatenate((e[1, own], e[3, own], p[1]))
        along = (x - e[0, of]) * (e[2, of] - e[0, of]) + (y - e[1, of]) * (e[3, of] - e[1, of])
        order = np.lexsort((y, x, along, of))
        of, x, y = of[order], x[order], y[order]
        new = np.append(True, (of[1:] != of[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[: len(of)]
        of, x, y = of[new], x[new], y[new]
        follows = of[1:] == of[:-1]
        g, e = g[of[:-1][follows]], np.stack((x[:-1], y[:-1], x[1:], y[1:]))[:, follows]
    g = np.concatenate([np.zeros(0, np.int64), *[d[0] for d in done]])
    order = np.argsort(g, kind="stable")
    return g[order], np.concatenate([np.zeros((4, 0)), *[d[1] for d in done]], axis=1)[:, order]


def _border(g: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(g, e): the pieces with a winding number of one or more on their left only; see outlines.border."""
    up = (e[1] < e[3]) | ((e[1] == e[3]) & (e[0] < e[2]))
    s = np.where(up, e, e[[2, 3, 0, 1]])
    order = np.lexsort((*s[::-1], g))
    g, s, turn = g[order], s[:, order], np.where(up, 1, -1)[order]
    new = np.append(True, (g[1:] != g[:-1]) | (s[:, 1:] != s[:, :-1]).any(axis=0))[: len(g)]
    w = np.add.reduceat(turn, np.flatnonzero(new)) if len(g) else turn
    g, s = g[new][w != 0], s[:, new][:, w != 0]
    w = w[w != 0]
    lx, ly, hx, hy = s
    x, y, r = (lx + hx) / 2, (ly + hy) / 2, np.zeros(len(g), np.int64)
    walls = np.flatnonzero(ly < hy)
    for i, k in _pairs(g, g[walls]):
        j = walls[k]
        met = (i != j) & (ly[j] < y[i]) & (y[i] <= hy[j])
        i, j = i[met], j[met]
        right = lx[j] + (y[i] - ly[j]) / (hy[j] - ly[j]) * (hx[j] - lx[j]) > x[i]
        np.add.at(r, i[right], w[j[right]])
    inside = r + w >= 1
    keep = (r >= 1) != inside
    return g[keep], np.where(inside, s, s[[2, 3, 0, 1]])[:, keep]


def _followers(g: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The row that follows each: of those that begin where it ends, the one with the sharpest turn to the left."""
    n = len(g)
    both = np.append(g, g), np.append(e[0], e[2]), np.append(e[1], e[3])
    order, vertex = np.lexsort(both[::-1]), np.zeros(2 * n, np.int64)
    vertex[order[1:]] = np.cumsum(np.any([c[order[1:]] != c[order[:-1]] for c in both], axis=0))
    order = np.argsort(vertex[:n], kind="stable")
    follow, best = np.zeros(n, np.int64), np.full(n, -np.inf)
    for i, k in _pairs(vertex[n:], vertex[:n][order]):
        j = order[k]
        ux, uy, vx, vy = e[2, i] - e[0, i], e[3, i] - e[1, i], e[2, j] - e[0, j], e[3, j] - e[1, j]
        turn = np.arctan2(ux * vy - uy * vx, ux * vx + uy * vy)
        last = np.lexsort((turn, i))
        last = last[np.append(i[last][1:] != i[last][:-1], True)] if len(i) else last
        better = turn[last] > best[i[last]]
        follow[i[last][better]], best[i[last][better]] = j[last][better], turn[last][better]
    return follow


def outlined(rings: list[np.ndarray], step: float) -> list[tuple[int, int, np.ndarray, bool]]:
    """(row, part, ring, hole): the outlines of what each of rings (rows of x and y) goes around, one ring alone."""
    sizes = np.array([r.shape[1] for r in rings] or [0])
    g = np.repeat(np.arange(len(sizes)), sizes)
    p = np.floor(np.concatenate([np.zeros((2, 0)), *rings], axis=1) / step + 0.5) * step
    follow = np.arange(len(g)) + 1
    last = np.cumsum(sizes)[sizes > 0] - 1
    follow[last] -= sizes[sizes > 0]
    e = np.concatenate((p, p[:, follow]))
    edge = ((e[0] != e[2]) | (e[1] != e[3])) & (sizes[g] > 2)
    g, e = _border(*_pieces(g[edge], e[:, edge], step))
    onward, of, x, y = _followers(g, e).tolist(), g.tolist(), e[0].tolist(), e[1].tolist()
    seen, out, part = [False] * len(of), [], 0
    for begin in range(len(of)):
        if seen[begin]:
            continue
        ring, at = [], begin
        while not seen[at]:
            seen[at] = True
            ring.append((x[at], y[at]))
            at = onward[at]
        first = min(range(len(ring)), key=ring.__getitem__)  # a corner for sure
        ring = ring[first:] + ring[: first + 1]
        q = np.array(ring).T
        q = q[:, thinned(*q, 8 * step)]  # the first corner is the last, too
        part = part + 1 if out and out[-1][0] == of[begin] else 0
        out.append((of[begin], part, q[:, :-1], bool((q[0, :-1] * q[1, 1:] - q[1, :-1] * q[0, 1:]).sum() < 0)))
    return out


def outline_rows(batches: Iterator[pa.RecordBatch], step: float) -> Iterator[pa.RecordBatch]:
    """Rings (grp, ring), each a group of its own, to their outlines (grp, part, ring, hole)."""
    for batch in batches:
        lists = batch.column(1)
        flat, sizes = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy()
        p = np.stack([np.asarray(flat.field(i), float) for i in (0, 1)])
        found = outlined(np.split(p, np.cumsum(sizes)[:-1], axis=1) if len(sizes) else [], step)
        x, y = np.concatenate([np.zeros((2, 0)), *[f[2] for f in found]], axis=1)
        ends = pa.array(np.append(0, np.cumsum([f[2].shape[1] for f in found])).astype(np.int32))
        ring = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([f[0] for f in found], pa.int64())), pa.array([f[1] for f in found], pa.int64()), ring, pa.array([f[3] for f in found], pa.bool_())], names=["grp", "part", "ring", "hole"])


def _full(sizes: np.ndarray, p: np.ndarray, size: float, margin: float = 2.0**-10) -> np.ndarray:
    """(row, cx, cy): the cells that a ring holds whole, none of its edges nearer than margin; sizes: corners of each, p: all of them."""
    starts = np.cumsum(sizes) - sizes
    low, high = (np.floor(f.reduceat(p, starts, axis=1) / size).astype(np.int64) for f in (np.minimum, np.maximum))
    follow = np.arange(p.shape[1]) + 1
    follow[starts + sizes - 1] = starts
    a, b = p, p[:, follow]
    wide = np.maximum(high - low - 1, 0)  # the outermost cells are never held whole
    n = wide[0] * wide[1]
    ends, at, out = np.cumsum(n * sizes), 0, [np.zeros((3, 0), np.int64)]
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        row = np.repeat(np.arange(at, to), n[at:to])
        k = np.arange(len(row)) - np.repeat(np.cumsum(n[at:to]) - n[at:to], n[at:to])
        cx, cy = low[0, row] + 1 + k % np.maximum(wide[0, row], 1), low[1, row] + 1 + k // np.maximum(wide[0, row], 1)
        m = sizes[row]
        first = np.cumsum(m) - m
        e = np.arange(m.sum()) + np.repeat(starts[row] - first, m)
        x, y = np.repeat((cx + 0.5) * size, m), np.repeat((cy + 0.5) * size, m)
        ux, uy, vx, vy = a[0, e] - x, a[1, e] - y, b[0, e] - x, b[1, e] - y
        half = size / 2 + margin
        side = ux * vy - uy * vx
        apart = (np.minimum(ux, vx) > half) | (np.maximum(ux, vx) < -half) | (np.minimum(uy, vy) > half) | (np.maximum(uy, vy) < -half)
        apart |= np.abs(side) > half * (np.abs(vx - ux) + np.abs(vy - uy))
        turns = ((uy <= 0) & (vy > 0) & (side > 0)).astype(np.int64) - ((vy <= 0) & (uy > 0) & (side < 0))
        if len(row):
            good = np.logical_and.reduceat(apart, first) & (np.add.reduceat(turns, first) != 0)
            out.append(np.stack((row[good], cx[good], cy[good])))
        at = to
    return np.concatenate(out, axis=1)


def full_rows(batches: Iterator[pa.RecordBatch], size: float) -> Iterator[pa.RecordBatch]:
    """Rings (grp, ring) of three corners or more to the cells (grp, cx, cy) that they hold whole."""
    for batch in batches:
        flat, sizes = batch.column(1).flatten(), batch.column(1).value_lengths().to_numpy().astype(np.int64)
        if not len(sizes):
            continue
        row, cx, cy = _full(sizes, np.stack([np.asarray(flat.field(i), float) for i in (0, 1)]), size)
        cells = pa.Table.from_arrays([batch.column(0).take(pa.array(row)), pa.array(cx), pa.array(cy)], names=["grp", "cx", "cy"])
        yield from cells.group_by(["grp", "cx", "cy"]).aggregate([]).to_batches()
