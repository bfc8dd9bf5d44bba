"""Clipping of lines and rings to boxes, and tile coordinates: expressions, save for rings, which are cut a batch at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from geoweave.functions.geometry import point


def clipped_span(ax, ay, bx, by, x0, y0, x1, y1) -> Column:
    """The part of ab in a box as (t0, t1), places from 0 at a to 1 at b; null if there is none. A single point inside is kept."""
    dx, dy = bx - ax, by - ay
    enter, leave = [F.lit(0.0)], [F.lit(1.0)]
    apart = F.lit(False)
    for d, low, high in ((dx, x0 - ax, x1 - ax), (dy, y0 - ay, y1 - ay)):
        safe = F.nullif(d, F.lit(0.0))
        apart = apart | ((d == 0) & ((low > 0) | (high < 0)))
        enter.append(F.when(d > 0, low / safe).when(d < 0, high / safe).otherwise(F.lit(0.0)))
        leave.append(F.when(d > 0, high / safe).when(d < 0, low / safe).otherwise(F.lit(1.0)))
    t0, t1 = F.greatest(*enter), F.least(*leave)
    return F.when(~apart & (t0 <= t1), F.struct(t0.alias("t0"), t1.alias("t1")))


def clipped_segment(ax, ay, bx, by, x0, y0, x1, y1) -> Column:
    """The part of ab in a box as (ax, ay, bx, by); null if there is none."""
    span, dx, dy = clipped_span(ax, ay, bx, by, x0, y0, x1, y1), bx - ax, by - ay
    at = lambda t: [(ax + span[t] * dx), (ay + span[t] * dy)]
    return F.when(span.isNotNull(), F.struct(*[c.alias(n) for c, n in zip([*at("t0"), *at("t1")], ("ax", "ay", "bx", "by"))]))


def cut_side(v: np.ndarray, w: np.ndarray, offsets: np.ndarray, bound: np.ndarray, sign: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rings of corners (v, w), ring i from offsets[i] on, cut to one side of a line v = bound[i] each: their new corners and offsets."""
    size = np.diff(offsets)
    bound = np.repeat(bound, size)
    follow = np.arange(1, len(v) + 1)
    follow[offsets[1:][size > 0] - 1] = offsets[:-1][size > 0]
    inside = (v - bound) * sign >= 0
    ends, cut = inside[follow], inside != inside[follow]
    at = np.append(0, np.cumsum(cut.astype(np.int64) + ends))
    out_v, out_w = np.empty(at[-1]), np.empty(at[-1])
    i, j = np.flatnonzero(cut), np.flatnonzero(ends)
    f = follow[i]
    out_v[at[i]] = bound[i]
    out_w[at[i]] = w[i] + (bound[i] - v[i]) / (v[f] - v[i]) * (w[f] - w[i])
    out_v[at[j] + cut[j]], out_w[at[j] + cut[j]] = v[follow[j]], w[follow[j]]
    return out_v, out_w, at[offsets]


def cut_to_boxes(x: np.ndarray, y: np.ndarray, offsets: np.ndarray, x0, y0, x1, y1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with a box for each ring, side by side of it."""
    x, y, offsets = cut_side(x, y, offsets, x0, 1)
    x, y, offsets = cut_side(x, y, offsets, x1, -1)
    y, x, offsets = cut_side(y, x, offsets, y0, 1)
    y, x, offsets = cut_side(y, x, offsets, y1, -1)
    return x, y, offsets


def ring_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Corners of a column of rings and where each ring begins, and the end; null rings have no corner."""
    flat = column.flatten()
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.asarray(flat.field(0), float), np.asarray(flat.field(1), float), np.append(0, np.cumsum(size, dtype=np.int64))


def rings_column(x: np.ndarray, y: np.ndarray, offsets: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    ends = pa.array(offsets, pa.int32()) if null is None else pa.array(offsets, pa.int32(), mask=np.append(null, False))
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"]))


def clipped_rings(rows: DataFrame, ring: str, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    """rows with column `ring` cut to a box, side by side of it; the rings of an Arrow batch go through each side together.

    Exact for convex rings; parts of others stay joined along the border, so areas are right. Null rings stay null.
    """
    others = [c for c in rows.columns if c != ring]
    plain = F.transform(ring, lambda p: point(p["x"], p["y"]))
    sides = [c.cast("double").alias(f"_{n}") for n, c in (("x0", x0), ("y0", y0), ("x1", x1), ("y1", y1))]
    given = rows.select(*others, plain.alias(ring), *sides)
    n = len(others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(n)
            box = [batch.column(n + 1 + i).to_numpy(zero_copy_only=False) for i in range(4)]
            cut = rings_column(*cut_to_boxes(*ring_arrays(held), *box), held.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], cut], names=[*others, ring])

    return given.mapInArrow(run, given.select(*others, ring).schema).select(*rows.columns)


def in_tile(ring: Column, x0: Column, y0: Column, size: Column | float, extent: int = 4096) -> Column:
    """A ring in whole steps of a tile, 0 to extent, y downwards; points that fall on the one before are left out."""
    step = lambda v: F.floor(v * extent + 0.5).cast("long")
    whole = F.transform(ring, lambda p: F.struct(step((p["x"] - x0) / size).alias("x"), step(1 - (p["y"] - y0) / size).alias("y")))
    return F.filter(whole, lambda p, i: (i == 0) | (p != F.get(whole, i - 1)))
