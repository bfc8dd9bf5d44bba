"""Queries over raw features: cleaning rules, their log, tag filters and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoweave.operators import cleaning as c, rules
from geoweave.plans.queries import query
from geoweave.sources.driver_tables import SHAPES, TAGS, features

C = F.col


def _q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _t(key: str) -> str:
    """The SQL column of a key's value, null where missing or empty."""
    return f'nullif("{key}", \'\')' if key in {t[0] for t in TAGS} else "NULL::VARCHAR"


def _first(keys: list[str]) -> str:
    return f"coalesce({', '.join(map(_t, keys))}, NULL)"


def _some(keys: list[str]) -> str:
    return "nullif(concat_ws(',', " + ", ".join(f"CASE WHEN {_t(k)} IS NOT NULL THEN {_q(k)} END" for k in keys) + "), '')"


def _class(value: str, classes: dict, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {value} IN ({', '.join(map(_q, v))}) THEN {_q(k)}" for k, v in classes.items()) + f" ELSE {_q(default)} END"


_COLUMNS = ", ".join(
    f"CASE WHEN p_partkey % 53 > 0 AND (p_partkey * {2 * i + 3} + {i}) % {m} < {n} THEN list_extract([{', '.join(map(_q, values))}], CAST((p_partkey // 7 + {i}) % {len(values)} + 1 AS INT)) END AS \"{key}\""
    for i, (key, m, n, values) in enumerate(TAGS)
)
_F = (
    f"ft AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 37 > 0 THEN p_partkey::VARCHAR END AS id, list_extract([{', '.join(map(_q, SHAPES))}], CAST(p_partkey % {len(SHAPES)} + 1 AS INT)) AS geom_type, "
    f"(p_partkey // 3) % 2 = 0 AS closed, p_partkey % 3 + 1 AS n_parts, p_partkey % 53 > 0 AS has_props, {_COLUMNS} FROM part), "
    f"fa AS (SELECT *, {_t('building')} IS NOT NULL AS house, {_t('building')} IS NULL AND {_t('highway')} IS NOT NULL AS road, geom_type IS NOT DISTINCT FROM 'LineString' AS line, "
    f"{_t('healthcare')} IS NOT NULL OR {_t('healthcare:speciality')} IS NOT NULL AS health, nullif(concat_ws(',', {_some(c.COMMERCIAL)}, CASE WHEN \"payment:cash\" IS NOT NULL THEN 'payment:cash' END, CASE WHEN \"payment:cards\" IS NOT NULL THEN 'payment:cards' END), '') AS trade, "
    f"{_some(c.AMENITY)} AS civil, {_some(c.INDUSTRIAL)} AS works FROM ft), "
    f"fb AS (SELECT *, CASE WHEN {_t('building')} = 'yes' AND NOT health THEN CASE WHEN trade IS NOT NULL THEN 'commercial' WHEN civil IS NOT NULL THEN 'amenity' WHEN works IS NOT NULL THEN 'industrial' END END AS refined, "
    f"CASE WHEN NOT has_props THEN NULL WHEN geom_type IS NULL OR geom_type NOT IN ('Polygon', 'MultiPolygon', 'LineString') THEN ['invalid_geometry', coalesce(geom_type, 'missing')] "
    f"WHEN house AND line AND NOT closed THEN ['building_linestring_not_closed', ''] WHEN house AND ({_t('barrier')} IS NOT NULL OR {_t('bollard')} IS NOT NULL) THEN ['building_with_barrier', ''] "
    f"WHEN road AND NOT line THEN ['highway_invalid_geometry_type', geom_type] WHEN road AND {_t('highway')} IN ({', '.join(map(_q, c.ROADS_DROPPED))}) THEN ['highway_type', {_t('highway')}] "
    f"WHEN road AND {_some(c.ROAD_TAGS_DROPPED)} IS NOT NULL THEN ['highway_with_removable_prop', {_some(c.ROAD_TAGS_DROPPED)}] END AS gone FROM fa), "
    f"fc AS (SELECT *, (house OR road) AND gone IS NULL AS kept, CASE WHEN health THEN 'healthcare' ELSE coalesce(refined, {_t('building')}) END AS was, "
    f"CASE WHEN {_t('addr:housenumber')} <> {_t('addr:housenumber2')} THEN {_t('addr:housenumber')} || '/' || {_t('addr:housenumber2')} ELSE {_first(['addr:housenumber', 'addr2:housenumber', 'addr:housenumber2'])} END AS number FROM fb)"
)


@query(
    f"WITH {_F} SELECT k, CASE WHEN geom_type = 'MultiPolygon' THEN 'M' || coalesce(id, '') || part ELSE id END AS id, CAST(part AS INT) AS part, {_class('was', c.BUILDINGS, 'amenity')} AS building, {_first(['building:levels', 'levels', 'level'])} AS levels, "
    f"{_first(['building:colour', 'roof:colour'])} AS color, nullif(concat_ws('-', number, {_t('addr:unit')}), '') AS num, {_t('amenity')} AS amenity, {_t('shop')} AS shop, {_t('area')} AS area, "
    f"coalesce({_first(c.BUILDING_NAMES)}, nullif(regexp_replace({_t('wikimedia_commons')}, 'Category:', ''), ''), nullif(regexp_replace({_t('wikipedia')}, '^(ru|en|kk):', ''), '')) AS name "
    "FROM (SELECT *, unnest(range(CASE WHEN geom_type = 'MultiPolygon' THEN n_parts ELSE 1 END)) AS part FROM fc WHERE kept AND house)"
)
def clean_buildings(spark, d):
    """Buildings that the rules keep, a row for each part of a multipolygon, with their eight tags."""
    kept = c.judged(features(spark, d)).where("kept and kind = 'building'")
    many = C("geom_type") == "MultiPolygon"
    parts = kept.withColumn("part", F.explode(F.sequence(F.lit(0), F.when(many, C("n_parts") - 1).otherwise(0))))
    named = F.when(many, F.concat(F.lit("M"), F.coalesce("id", F.lit("")), C("part").cast("string"))).otherwise(C("id"))
    return parts.select("k", named.alias("id"), "part", *[F.try_element_at("props", F.lit(t)).alias(t) for t in ("building", "levels", "color", "num", "amenity", "shop", "area", "name")])


@query(f"WITH {_F} SELECT k, id, {_class(_t('highway'), c.ROADS, 'footway')} AS highway, coalesce({_first(c.ROAD_NAMES)}, \"name\") AS name FROM fc WHERE kept AND road")
def clean_roads(spark, d):
    """Roads that the rules keep, with their class and name."""
    kept = c.judged(features(spark, d)).where("kept and kind = 'road'")
    return kept.select("k", "id", *[F.try_element_at("props", F.lit(t)).alias(t) for t in ("highway", "name")])


@query(
    f"WITH {_F}, l AS (SELECT 'removed' AS section, gone[1] AS rule, gone[2] AS trigger FROM fc WHERE gone IS NOT NULL UNION ALL SELECT 'modified', 'building_set_to_healthcare', '' FROM fc WHERE kept AND house AND health "
    "UNION ALL SELECT 'modified', 'building_yes_to_' || refined || '_by_props', coalesce(trade, civil, works) FROM fc WHERE kept AND house AND refined IS NOT NULL "
    f"UNION ALL SELECT 'modified', 'building_category_condensed', was || '_to_' || {_class('was', c.BUILDINGS, 'amenity')} FROM fc WHERE kept AND house "
    f"UNION ALL SELECT 'modified', 'highway_category_condensed', {_t('highway')} || '_to_' || {_class(_t('highway'), c.ROADS, 'footway')} FROM fc WHERE kept AND road) SELECT section, rule, trigger, count(*) AS n FROM l GROUP BY ALL"
)
def cleaning_log(spark, d):
    """How often each rule fired, by what triggered it."""
    return c.rule_counts(c.judged(features(spark, d)))


@query(f"WITH {_F} SELECT count(*) AS read, count(*) FILTER (kept) AS remaining, nullif(count(*) FILTER (kept AND house), 0) AS buildings, nullif(count(*) FILTER (kept AND road), 0) AS roads FROM fc")
def cleaning_totals(spark, d):
    """Features read and left; a kind of which none is left is null."""
    some = lambda test: F.nullif(F.count_if(F.expr(test)), F.lit(0))
    return c.judged(features(spark, d)).agg(F.count("*").alias("read"), F.count_if("kept").alias("remaining"), some("kept and kind = 'building'").alias("buildings"), some("kept and kind = 'road'").alias("roads"))


@query(f"WITH {_F} SELECT k FROM ft WHERE \"building\" IS NOT NULL OR (geom_type = 'LineString' AND \"highway\" IS NOT NULL)")
def tag_filter(spark, d):
    """Features with a building tag, and lines with a highway tag, whatever their values."""
    return c.tag_filter(features(spark, d), {"any": ["building"], "LineString": ["highway"]}).select("k")


_LONG = "fl AS (SELECT unnest([" + ", ".join(f"{{'key': {_q(t[0])}, 'value': \"{t[0]}\"}}" for t in TAGS) + "], recursive := true) FROM ft WHERE has_props)"
_KIND = "CASE WHEN regexp_full_match(value, '-?[0-9]+') THEN 'number' WHEN value IN ('yes', 'no', 'true', 'false') THEN 'boolean' WHEN value = '' THEN 'empty' ELSE 'string' END"


@query(
    f"WITH {_F}, {_LONG}, v AS (SELECT key, value, {_KIND} AS kind FROM fl WHERE value IS NOT NULL) SELECT key, count(*) AS present, count(*) < (SELECT count(*) FROM ft WHERE has_props) AS optional, "
    "array_to_string(list_sort(list_distinct(list(kind))), '|') AS types, count(DISTINCT value) AS n_values, count(DISTINCT value) <= 12 AS is_enum FROM v GROUP BY key"
)
def profile_types(spark, d):
    """Each key's presence, whether it is optional, the types of its values, and whether they are few enough for an enumeration."""
    return rules.profile_types(features(spark, d).where("props is not null"), "props", 12)


@query(f"WITH {_F} SELECT k, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN \"{t[0]}\" IS NOT NULL THEN {_q(t[0])} END" for t in TAGS) + "], lambda x: x IS NOT NULL)), ',') AS keys FROM ft WHERE has_props")
def sorted_property_keys(spark, d):
    """The keys that each feature's properties have, in ascending order."""
    return features(spark, d).where("props is not null").select("k", F.array_join(F.array_sort(F.map_keys("props")), ",").alias("keys"))
