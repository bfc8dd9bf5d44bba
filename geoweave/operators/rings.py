"""Rules on rings before they are simplified: which lines become polygons, and which shapes are too poor to keep."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from geoweave.functions import geometry as g


def is_closed(ring: Column, within: float = 0.0) -> Column:
    """Whether the first and the last point are no farther apart than `within`; null and empty rings are not closed."""
    first, last = F.get(ring, F.lit(0)), F.get(ring, F.size(ring) - 1)
    return F.coalesce((F.size(ring) > 1) & (g.distance(first["x"], first["y"], last["x"], last["y"]) <= within), F.lit(False))


def opened(ring: Column, within: float = 0.0) -> Column:
    """A ring without its closing point."""
    return F.when(is_closed(ring, within), F.slice(ring, 1, F.greatest(F.size(ring) - 1, F.lit(0)))).otherwise(ring)


def scrubbed(ring: Column) -> Column:
    """A ring without points that lack a coordinate or have one that is no number."""
    good = lambda v: v.isNotNull() & ~F.isnan(v)
    return F.filter(ring, lambda p: p.isNotNull() & good(p["x"]) & good(p["y"]))


def verdict(geom_type: Column, ring: Column, least_area: float = 10.0) -> Column:
    """kept, or why not: open line, too few points (three at least), too small. Other geometry types are `no shape`.

    A closed line counts as the polygon that it bounds. A null ring has too few points.
    """
    whole = scrubbed(ring)
    body = opened(whole)
    return (
        F.when(~F.coalesce(geom_type.isin("Polygon", "LineString"), F.lit(False)), "no shape")
        .when((geom_type == "LineString") & ~is_closed(whole), "open line")
        .when(F.coalesce(F.size(body), F.lit(0)) < 3, "too few points")
        .when(F.abs(g.signed_area(body)) < least_area, "too small")
        .otherwise("kept")
    )
