"""Cleaning of raw map features: which are dropped, what their tags become, and a log of every rule that fired.

One pass of expressions over (id, geom_type, closed, props); no shuffle before the log is counted. A tag that is an empty
string counts as missing everywhere but where presence of the key is asked for. Features without props, and those that are
neither building nor road, go without a log entry. Rows are judged alone, so repeated rows give repeated results.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, functions as F

from geoweave.operators.rules import tag

# Tags of the open map format and the classes that they are condensed to.
GEOMETRIES = ["Polygon", "MultiPolygon", "LineString"]
COMMERCIAL = [
    "amenity", "brand", "brand:en", "brand:ru", "brand:wikidata", "brand:wikipedia", "construction", "cuisine", "fuel:diesel",
    "fuel:octane_95", "fuel:octane_98", "leisure", "opening_hours", "phone", "phone_1", "product", "shop",
]
AMENITY = ["community_centre", "government", "public_transport", "railway", "religion", "sport", "tourism"]
INDUSTRIAL = ["industrial", "power"]
PAYMENT = "payment:"
BUILDING_NAMES = [
    "name:ru", "name", "name:en", "name:es", "name:de", "name:fr", "name:kk", "name:tr", "name:tt", "name:zh", "name:cv", "name:ko",
    "name:alt", "name:old", "official_name:ru", "official_name", "official_name:kk", "old_name", "short_name", "short_name:ru",
    "short_name:en", "short_name:de",
]
ROAD_NAMES = [
    "int_name", "name", "name:ru", "name:ru:word_stress", "addr:street", "name:en", "name:kk", "old_name:ru", "old_name", "old_name_1",
    "alt_name", "description",
]
BUILDINGS = {
    "residential": ["apartments", "house", "residential", "detached", "dormitory", "hut", "yes"],
    "commercial": ["commercial", "retail", "office", "service", "hotel", "warehouse", "shop", "kiosk", "supermarket"],
    "education": ["school", "university", "kindergarten", "college", "library"],
    "industrial": ["industrial", "garages", "garage", "hangar", "shed", "greenhouse", "construction"],
    "healthcare": ["hospital", "healthcare"],
    "amenity": [
        "roof", "civic", "public", "government", "church", "toilets", "mosque", "temple", "museum", "theater", "community_centre",
        "sports_centre", "stadium", "guardhouse", "parking", "bridge", "ruins", "no",
    ],
}
ROADS = {
    "primary": ["primary", "primary_link"],
    "secondary": ["secondary", "secondary_link"],
    "tertiary": ["tertiary", "tertiary_link"],
    "service": ["service", "residential", "unclassified", "living_street", "track", "turning_circle", "raceway", "construction"],
    "footway": ["footway", "steps", "cycleway", "pedestrian", "path", "corridor", "bridleway", "platform"],
}
ROADS_DROPPED = ["crossing", "traffic_signals", "speed_camera", "bus_stop"]
ROAD_TAGS_DROPPED = ["bench", "crossing", "crossing:island", "crossing:markings", "crossing:signals", "crossing_ref"]


def condensed(value: Column, classes: dict[str, list[str]], default: str) -> Column:
    """The class that lists value."""
    pairs = [(v, c) for c, values in classes.items() for v in values]
    known = F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)])
    return F.coalesce(F.try_element_at(known, F.coalesce(value, F.lit(""))), F.lit(default))


def hits(props: Column, keys: list[str]) -> Column:
    """Those of keys that have a value, in their order, joined by commas; null if there are none."""
    return F.nullif(F.concat_ws(",", *[F.when(tag(props, k).isNotNull(), F.lit(k)) for k in keys]), F.lit(""))


def _entry(section: str, rule: Column | str, trigger: Column) -> Column:
    return F.struct(F.lit(section).alias("section"), (F.lit(rule) if isinstance(rule, str) else rule).alias("rule"), trigger.alias("trigger"))


def tag_filter(features: DataFrame, wanted: dict[str, list[str]]) -> DataFrame:
    """features whose props have one of the keys wanted for their geometry type ("any": for every type); values don't matter."""
    test = F.lit(False)
    for kind, keys in wanted.items():
        has = F.exists(F.map_keys("props"), lambda k: k.isin(keys))  # noqa: B023
        test = test | (has if kind == "any" else has & (F.col("geom_type") == kind))
    return features.where(F.coalesce(test, F.lit(False)))


def judged(features: DataFrame) -> DataFrame:
    """features (id, geom_type, closed, props, ...) with kind, kept, props as they become, and log, an array of (section, rule, trigger).

    closed: whether a line's first and last point are the same. kind: building, road or null. Rows that are dropped keep
    their props. A null props or geometry type is defined: the first is dropped silently, the second as `missing`.
    """
    p = F.col("props")
    t = lambda k: tag(p, k)
    first = lambda keys: F.coalesce(*[t(k) for k in keys])
    own = lambda name: F.col(f"_judged_{name}")
    shape = F.col("geom_type")

    def with_own(df: DataFrame, **columns: Column) -> DataFrame:
        """df with columns that come out of a generator: the optimiser can't put its step and the next together, so each is worked out once."""
        made = F.struct(*[v.alias(f"_judged_{k}") for k, v in columns.items()])
        return df.withColumn("_made", F.explode(F.array(made))).select(*df.columns, "_made.*")

    features = features.withColumn("props", F.explode(F.array("props")))
    rows = with_own(
        features, line=F.coalesce(shape == "LineString", F.lit(False)), whole=F.coalesce(shape.isin(GEOMETRIES), F.lit(False)), road_tags=hits(p, ROAD_TAGS_DROPPED),
        building=t("building"), highway=t("highway"), health=t("healthcare").isNotNull() | t("healthcare:speciality").isNotNull(),
        trade=F.nullif(F.concat_ws(",", hits(p, COMMERCIAL), F.nullif(F.array_join(F.filter(F.map_keys(p), lambda k: k.startswith(PAYMENT)), ","), F.lit(""))), F.lit("")),
        civil=hits(p, AMENITY), works=hits(p, INDUSTRIAL), fenced=t("barrier").isNotNull() | t("bollard").isNotNull(),
    )
    rows = with_own(rows, house=own("building").isNotNull(), road=own("building").isNull() & own("highway").isNotNull())
    house, road, line = own("house"), own("road"), own("line")
    dropped = (
        F.when(p.isNull(), F.lit(None))
        .when(~own("whole"), _entry("removed", "invalid_geometry", F.coalesce(shape, F.lit("missing"))))
        .when(house & line & ~F.coalesce(F.col("closed"), F.lit(False)), _entry("removed", "building_linestring_not_closed", F.lit("")))
        .when(house & own("fenced"), _entry("removed", "building_with_barrier", F.lit("")))
        .when(road & ~line, _entry("removed", "highway_invalid_geometry_type", shape))
        .when(road & own("highway").isin(ROADS_DROPPED), _entry("removed", "highway_type", own("highway")))
        .when(road & own("road_tags").isNotNull(), _entry("removed", "highway_with_removable_prop", own("road_tags")))
    )
    why = {"commercial": own("trade"), "amenity": own("civil"), "industrial": own("works")}
    vague = (own("building") == "yes") & ~own("health")
    rows = with_own(rows, dropped=dropped, refined=F.when(vague, F.coalesce(*[F.when(c.isNotNull(), F.lit(k)) for k, c in why.items()])))
    rows = with_own(rows, was=F.when(own("health"), F.lit("healthcare")).otherwise(F.coalesce(own("refined"), own("building"))), kept=F.coalesce((house | road) & own("dropped").isNull(), F.lit(False)))
    main, other = t("addr:housenumber"), t("addr:housenumber2")
    rows = with_own(
        rows, house_class=condensed(own("was"), BUILDINGS, "amenity"), road_class=condensed(own("highway"), ROADS, "footway"),
        number=F.when(main != other, F.concat_ws("/", main, other)).otherwise(first(["addr:housenumber", "addr2:housenumber", "addr:housenumber2"])),
    )
    commons = F.nullif(F.regexp_replace(t("wikimedia_commons"), "^(.*?)Category:", "$1"), F.lit(""))
    wiki = F.nullif(F.regexp_replace(t("wikipedia"), "^(ru|en|kk):", ""), F.lit(""))
    fields = {
        "building": own("house_class"), "levels": first(["building:levels", "levels", "level"]), "color": first(["building:colour", "roof:colour"]),
        "num": F.nullif(F.concat_ws("-", own("number"), t("addr:unit")), F.lit("")), "amenity": t("amenity"), "shop": t("shop"), "area": t("area"),
        "name": F.coalesce(first(BUILDING_NAMES), commons, wiki),
    }
    present = lambda m: F.map_filter(m, lambda _, v: v.isNotNull())
    house_props = present(F.create_map(*chain.from_iterable((F.lit(k), v) for k, v in fields.items())))
    road_props = present(F.create_map(F.lit("highway"), own("road_class"), F.lit("name"), F.coalesce(first(ROAD_NAMES), F.try_element_at(p, F.lit("name")))))
    changed = F.array_compact(F.array(
        F.when(house & own("health"), _entry("modified", "building_set_to_healthcare", F.lit(""))),
        F.when(house & own("refined").isNotNull(), _entry("modified", F.concat(F.lit("building_yes_to_"), own("refined"), F.lit("_by_props")), F.coalesce(*why.values()))),
        F.when(house, _entry("modified", "building_category_condensed", F.concat(own("was"), F.lit("_to_"), own("house_class")))),
        F.when(road, _entry("modified", "highway_category_condensed", F.concat(own("highway"), F.lit("_to_"), own("road_class")))),
    ))
    none = F.array().cast("array<struct<section:string,rule:string,trigger:string>>")
    out = with_own(
        rows, log=F.when(own("dropped").isNotNull(), F.array(own("dropped"))).when(own("kept"), changed).otherwise(none),
        props=F.when(~own("kept"), p).when(house, house_props).otherwise(road_props),
    )
    kind = F.when(house, F.lit("building")).when(road, F.lit("road")).alias("kind")
    same = [c for c in features.columns if c not in ("props", "kind", "kept", "log")]
    return out.select(*same, own("props").alias("props"), kind, own("kept").alias("kept"), own("log").alias("log"))


def rule_counts(rows: DataFrame) -> DataFrame:
    """(section, rule, trigger, n) of the log of judged rows.

    explode_outer, because for explode the engine tests each log for emptiness first, which works it out a second time.
    """
    entries = rows.select(F.explode_outer("log").alias("e")).where("e is not null")
    return entries.groupBy("e.section", "e.rule", "e.trigger").agg(F.count("*").alias("n"))
