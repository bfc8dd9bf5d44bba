"""Text forms of points, bounds, names and log lines as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from geoweave.functions.geometry import round_half_up

# The lines of the agents' log and what they tell.
LOG_LINES = {
    "initial_pathfinding": r"Started traveling\. nextCorner: \(([^,]+), ([^)]+)\)",
    "corner_update": r"Updated corners\. newCorner: \(([^,]+), ([^)]+)\)",
    "save_preEscape": r"preEscapeCorner saved as: \(([^,]+), ([^)]+)\)",
    "restore_from_preEscape": r"Escaped! nextCorner: \(([^,]+), ([^)]+)\)",
}
_NUMBER = r"(-?\d+\.?\d*)"
BOUNDS = rf"\[{_NUMBER}, {_NUMBER}\] - \[{_NUMBER}, {_NUMBER}\]"


def number_text(v: Column) -> Column:
    """A number without a fraction where it is whole, as scripts print it."""
    return F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))


def ring_text(ring: Column, between: str = ",", decimals: int | None = None) -> Column:
    """x,y,x,y,.. of a ring; rounded half up if decimals are given. Null for a null ring, empty for an empty one."""
    v = (lambda c: c) if decimals is None else (lambda c: round_half_up(c, decimals))
    return F.array_join(F.transform(ring, lambda p: F.concat(number_text(v(p["x"])), F.lit(between), number_text(v(p["y"])))), between)


def whole_text(v: Column) -> Column:
    """v to the nearest whole number, halves away from zero; a negative one keeps its sign even when it comes to 0."""
    return F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("")), F.floor(F.abs(v) + 0.5).cast("string"))


def bounds_text(text: Column) -> Column:
    """`[a, b] - [c, d]` in whole numbers; a text without such bounds stays as it is."""
    part = [whole_text(F.regexp_extract(text, BOUNDS, i).try_cast("double")) for i in (1, 2, 3, 4)]
    short = F.concat(F.lit("["), part[0], F.lit(","), part[1], F.lit("]-["), part[2], F.lit(","), part[3], F.lit("]"))
    return F.when(text.rlike(BOUNDS), short).otherwise(text)


def type_name(name: Column) -> Column:
    """A file name's parts between - and _ with a capital each, joined."""
    parts = F.split(name, "[-_]")
    capital = lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 30))
    return F.array_join(F.transform(parts, capital), "")


def log_entry(line: Column) -> Column:
    """(time, action, x, y) of a log line; null for other lines, time `unknown` without a leading [number]."""
    stamp = F.coalesce(F.nullif(F.regexp_extract(line, r"^\[(\d+)\]", 1), F.lit("")), F.lit("unknown"))
    out = None
    for action, pattern in LOG_LINES.items():
        at = lambda i: F.regexp_extract(line, pattern, i).try_cast("double")  # noqa: B023, E731
        entry = F.struct(stamp.alias("time"), F.lit(action).alias("action"), at(1).alias("x"), at(2).alias("y"))
        out = F.when(line.rlike(pattern), entry) if out is None else out.when(line.rlike(pattern), entry)
    return out
