"""Feature files: GeoJSON collections and the line formats of rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

_FEATURE = "STRUCT<id: STRING, geometry: STRUCT<type: STRING, coordinates: STRING>, properties: MAP<STRING, STRING>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, geom_type, coordinates JSON, props) of the collections under path; a file is one row until it is exploded.

    For large data write one feature a line and use read_geojson_lines, which splits files.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    parsed = F.from_json("value", f"STRUCT<features: ARRAY<{_FEATURE}>>")
    return _columns(whole.select("file", F.explode(parsed["features"]).alias("f")))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value, f): lines that hold an object, with what they parse to."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.regexp_replace("value", r"^[\s,]+|[\s,]+$", "").alias("value"))
    ended = F.regexp_replace("value", r"\]\s*\}$", "")  # the collection's end may stand after its last feature
    rows = lines.where(F.col("value").startswith("{")).withColumn("value", F.when(F.try_parse_json("value").isNotNull(), F.col("value")).otherwise(ended))
    return rows.select("file", "value", F.from_json("value", _FEATURE.replace("STRUCT<id", "STRUCT<type: STRING, id", 1)).alias("f"))


def _is_feature() -> Column:
    return F.coalesce((F.col("f.type") == "Feature") & F.col("f.geometry").isNotNull(), F.lit(False))


def read_geojson_lines(spark: SparkSession, path: str) -> DataFrame:
    """As read_geojson, from files with one feature a line, with or without the collection's first and last lines.

    Order of keys and white space don't matter. Other lines give no row; rejected_lines gives them.
    """
    return _columns(_lines(spark, path).where(_is_feature()))


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): lines with an object that is no feature with a geometry, but for the collection's own first line."""
    return _lines(spark, path).where(~_is_feature() & ~F.col("value").rlike(r'"features"\s*:\s*\[?$')).select("file", "value")


def _columns(rows: DataFrame) -> DataFrame:
    props = F.coalesce("f.properties", F.create_map().cast("map<string,string>"))
    own = F.coalesce(F.try_element_at(props, F.lit("id")), F.col("f.id"))
    return rows.select("file", own.alias("id"), F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"), props.alias("props"))


def feature_text(id_: Column, geom_type: Column, coordinates: Column, props: Column) -> Column:
    """One feature as JSON; coordinates are JSON already. A null id is left out, null props are an empty object."""
    quoted = lambda c, key: F.regexp_replace(F.to_json(F.struct(c.alias(key))), r"^\{|\}$", "")
    return F.concat(
        F.lit('{"type":"Feature",'), F.when(id_.isNotNull(), F.concat(quoted(id_, "id"), F.lit(","))).otherwise(F.lit("")),
        F.lit('"geometry":{'), quoted(F.coalesce(geom_type, F.lit("")), "type"), F.lit(',"coordinates":'), F.coalesce(coordinates, F.lit("null")), F.lit('},"properties":'),
        F.coalesce(F.to_json(props), F.lit("{}")), F.lit("}"),
    )


def write_geojson_lines(features: DataFrame, path: str) -> None:
    """features (id, geom_type, coordinates, props) as one feature a line, which read_geojson_lines reads back."""
    features.select(feature_text(F.col("id").cast("string"), F.col("geom_type"), F.col("coordinates"), F.col("props")).alias("value")).write.text(path)


def ring_of(numbers: Column) -> Column:
    """ARRAY<DOUBLE> x, y, x, y, .. as a ring; a last single number is dropped."""
    return F.transform(F.sequence(F.lit(1), F.floor(F.size(numbers) / 2).cast("int")), lambda i: F.struct(F.element_at(numbers, 2 * i - 1).alias("x"), F.element_at(numbers, 2 * i).alias("y")))


def _numbers(text: Column) -> Column:
    return F.transform(F.split(text, ","), lambda v: v.try_cast("double"))


def read_rings(spark: SparkSession, path: str, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(blob_id, building_ids, ring) from lines `idx;[ids];[x,y,x,y,..]`. Malformed lines are dropped; with a box, rings with a vertex outside too."""
    part = F.split("value", ";")
    rows = spark.read.text(path).where(F.size(part) == 3).select(part[0].try_cast("int").alias("blob_id"), F.trim(F.translate(part[1], "[]", "")).alias("ids"), _numbers(F.translate(part[2], "[]", "")).alias("n"))
    rows = rows.where(F.col("blob_id").isNotNull() & F.forall("n", lambda v: v.isNotNull()) & (F.size("n") >= 2))
    ids = F.when(F.col("ids") == "", F.array().cast("array<string>")).otherwise(F.split("ids", ","))
    out = rows.select("blob_id", ids.alias("building_ids"), ring_of(F.col("n")).alias("ring"))
    if bbox is None:
        return out
    x0, y0, x1, y1 = bbox
    return out.where(F.forall("ring", lambda p: p["x"].between(x0, x1) & p["y"].between(y0, y1)))


def read_buildings(spark: SparkSession, path: str) -> DataFrame:
    """(osm_id, props, ring) from lines `id;{json}[x,y,..]`; the last `[` begins the ring."""
    pattern = r"^([^;]*);(.*)\[([^\[]*)\]\s*$"
    rows = spark.read.text(path).where(F.col("value").rlike(pattern)).select(*[F.regexp_extract("value", pattern, i).alias(n) for i, n in ((1, "osm_id"), (2, "json"), (3, "xy"))])
    rows = rows.select("osm_id", F.from_json("json", "MAP<STRING,STRING>").alias("props"), _numbers(F.col("xy")).alias("n"))
    return rows.where(F.forall("n", lambda v: v.isNotNull())).select("osm_id", "props", ring_of(F.col("n")).alias("ring"))


def write_rings(blobs: DataFrame, path: str) -> None:
    """blobs (blob_id, building_ids, ring) as the lines that read_rings takes."""
    xy = F.array_join(F.flatten(F.transform("ring", lambda p: F.array(p["x"].cast("string"), p["y"].cast("string")))), ",")
    blobs.select(F.concat_ws(";", F.col("blob_id").cast("string"), F.concat(F.lit("["), F.array_join("building_ids", ","), F.lit("]")), F.concat(F.lit("["), xy, F.lit("]"))).alias("value")).write.text(path)


def write_buildings(buildings: DataFrame, path: str) -> None:
    """buildings (osm_id, props, ring) as the lines that read_buildings takes."""
    xy = F.array_join(F.flatten(F.transform("ring", lambda p: F.array(p["x"].cast("string"), p["y"].cast("string")))), ",")
    props = F.coalesce(F.to_json("props"), F.lit("{}"))
    buildings.select(F.concat(F.coalesce("osm_id", F.lit("")), F.lit(";"), props, F.lit("["), xy, F.lit("]")).alias("value")).write.text(path)


def read_atlas(spark: SparkSession, path: str) -> DataFrame:
    """(name, sprite_id, x, y, w, h) of a JSON map from names to boxes; ids are ranks of the names, from 0.

    One small file describes an image, so it is one row until it is exploded.
    """
    box = "STRUCT<x: DOUBLE, y: DOUBLE, w: DOUBLE, h: DOUBLE>"
    named = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"MAP<STRING, {box}>")).alias("name", "b"))
    return named.select("name", (F.row_number().over(Window.orderBy("name")) - 1).alias("sprite_id"), "b.*")


def atlas_coordinates(sprites: DataFrame, width: float, height: float) -> DataFrame:
    """sprites with u0, v0, u1, v1: their box as shares of an image of width by height."""
    share = lambda c, n: F.col(c) / n
    return sprites.withColumns({"u0": share("x", width), "v0": share("y", height), "u1": (F.col("x") + F.col("w")) / width, "v1": (F.col("y") + F.col("h")) / height})
