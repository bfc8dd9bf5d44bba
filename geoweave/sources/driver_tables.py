"""Geometry derived from the star schema by whole-number arithmetic, so that any engine gets the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from geoweave.shared import shuffle_partitions

SPAN = 2_000_001


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(key: str, factor: int) -> Column:
    return (F.pmod(F.col(key) * factor, F.lit(SPAN)) - 1_000_000) / F.lit(100.0)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, x, y) in metres, within 10 km of the origin, to 0.01."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), _place("o_orderkey", 7919).alias("x"), _place("o_orderkey", 104729).alias("y"))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """rows dealt to all tasks by key: a table of few bytes is one or two splits, whatever is worked out from its rows."""
    return rows.repartition(shuffle_partitions(rows.sparkSession), key)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(b, x0, y0, x1, y1)."""
    half = (F.col("p_size") * 4).cast("double")
    part = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", _place("p_partkey", 15485863).alias("x"), _place("p_partkey", 32452843).alias("y"), half.alias("h"))
    return part.select(F.col("p_partkey").alias("b"), (F.col("x") - F.col("h")).alias("x0"), (F.col("y") - F.col("h")).alias("y0"), (F.col("x") + F.col("h")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, x, y): customers on a patch of 300 m, so that they meet."""
    k = F.col("c_custkey")
    x, y = F.pmod(k * k * 7919, F.lit(30001)) / F.lit(100.0), F.pmod(k * k * k, F.lit(29989)) / F.lit(100.0)
    return table(spark, sf_dir, "customer").select(k.alias("k"), x.alias("x"), y.alias("y"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, us): event times in microseconds."""
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


def city(spark: SparkSession, sf_dir: str, size: float = 512.0) -> DataFrame:
    """(v, cx, cy): cells of a grid that hold a point, numbered along rows."""
    p = points(spark, sf_dir)
    cx, cy = F.floor(F.col("x") / size).cast("long"), F.floor(F.col("y") / size).cast("long")
    return p.select(cx.alias("cx"), cy.alias("cy")).distinct().select(((F.col("cy") + 64) * 128 + F.col("cx") + 64).alias("v"), "cx", "cy")


#: Tags of the derived features: key, present where (part key * (2 i + 3) + i) % modulus < share, values taken in turn.
TAGS = [
    ("building", 4, 3, ["yes", "yes", "apartments", "retail", "school", "garages", "hospital", "mosque", "barn", "yes", ""]),
    ("highway", 3, 2, ["primary", "residential", "steps", "bus_stop", "secondary_link", "rest_area", "track", ""]),
    ("barrier", 31, 1, ["fence", ""]), ("bollard", 41, 1, ["yes"]), ("healthcare", 29, 1, ["doctor", ""]), ("healthcare:speciality", 43, 1, ["dentist"]),
    ("shop", 13, 1, ["bakery", ""]), ("amenity", 11, 1, ["cafe", "bank"]), ("brand:ru", 17, 1, ["x"]), ("payment:cash", 19, 1, ["", "yes"]), ("payment:cards", 23, 1, ["no"]),
    ("religion", 12, 1, ["any"]), ("sport", 14, 1, ["tennis", ""]), ("power", 15, 1, ["plant"]), ("industrial", 16, 1, ["mill"]),
    ("addr:housenumber", 3, 2, ["1", "2", "12a", ""]), ("addr2:housenumber", 5, 1, ["7"]), ("addr:housenumber2", 4, 1, ["2", "8"]), ("addr:unit", 6, 1, ["B", ""]),
    ("name", 3, 1, ["Central", ""]), ("name:ru", 7, 1, ["Ru", ""]), ("name:kk", 8, 1, ["Kk"]), ("old_name", 9, 1, ["Old"]), ("short_name:de", 10, 1, ["Kurz"]),
    ("wikimedia_commons", 5, 1, ["Category:Hall Category:Old", "Category:", "File:Hall"]), ("wikipedia", 4, 1, ["ru:Hall", "ru:", "de:Hall"]), ("int_name", 18, 1, ["Main St", ""]),
    ("building:levels", 5, 2, ["5", ""]), ("levels", 6, 1, ["3"]), ("level", 7, 1, ["-1"]), ("building:colour", 11, 2, ["red", ""]), ("roof:colour", 6, 1, ["blue"]), ("area", 20, 1, ["yes"]),
    ("crossing", 37, 1, ["zebra", ""]), ("bench", 39, 1, ["yes"]), ("description", 10, 1, ["a lane"]),
]
SHAPES = ["Polygon", "Polygon", "LineString", "MultiPolygon", "LineString", "Point", None, "LineString", "LineString"]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, geom_type, closed, n_parts, props): a raw feature for each part; some without id, shape or props."""
    k = F.col("p_partkey")
    turn = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.floor(k / 7) + i, F.lit(len(values))) + 1).cast("int"))
    tags = [F.when((k * (2 * i + 3) + i) % m < n, F.struct(F.lit(key).alias("key"), turn(values, i).alias("value"))) for i, (key, m, n, values) in enumerate(TAGS)]
    props = F.map_from_entries(F.filter(F.array(*tags), lambda e: e.isNotNull()))
    shape = F.element_at(F.array(*[F.lit(v) for v in SHAPES]), (k % len(SHAPES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.when(k % 37 > 0, k.cast("string")).alias("id"), k.alias("k"), shape.alias("geom_type"), (F.floor(k / 3) % 2 == 0).alias("closed"), (k % 3 + 1).cast("int").alias("n_parts"),
        F.when(k % 53 > 0, props).alias("props"),
    )
