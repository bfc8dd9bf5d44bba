"""Rule-based cleaning of tagged features. A tag that is empty counts as missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def tag(props: Column, key: str) -> Column:
    """The value of key, null if missing or empty."""
    return F.nullif(F.try_element_at(props, F.lit(key)), F.lit(""))


def first_of(props: Column, keys: list[str]) -> Column:
    return F.coalesce(*[tag(props, k) for k in keys])


def refine(props: Column, value: Column, classes: dict[str, tuple[list[str], list[str]]]) -> tuple[Column, Column]:
    """For value 'yes': the first class one of whose keys, or key prefixes, is present; and the keys that were, joined by commas.

    Presence of the key is enough here, whatever its value.
    """
    out, why = value, F.lit(None).cast("string")
    keys = F.map_keys(props)
    for name, (exact, prefixes) in reversed(classes.items()):
        hits = F.filter(keys, lambda k: reduce(lambda a, b: a | b, [k.isin(exact), *[F.startswith(k, F.lit(p)) for p in prefixes]]))
        hit = (value == "yes") & (F.size(hits) > 0)
        out, why = F.when(hit, F.lit(name)).otherwise(out), F.when(hit, F.array_join(F.array_sort(hits), ",")).otherwise(why)
    return out, why


def house_number(main: Column, other: Column, unit: Column) -> Column:
    """One of two numbers, `a/b` if they differ, and the unit after it or alone."""
    number = F.when(main.isNotNull() & other.isNotNull() & (main != other), F.concat_ws("/", main, other)).otherwise(F.coalesce(main, other))
    return F.when(unit.isNull(), number).when(number.isNull(), unit).otherwise(F.concat_ws("-", number, unit))


def category(value: Column, lists: dict[str, list[str]], default: str) -> Column:
    """The list that holds value."""
    out = F.lit(default)
    for name, values in lists.items():
        out = F.when(value.isin(values), F.lit(name)).otherwise(out)
    return out


def rule_log(rows: DataFrame, section: str, rule: str, trigger: str) -> DataFrame:
    """How often each trigger of each rule fired; rows without a rule are not counted."""
    return rows.where(F.col(rule).isNotNull()).groupBy(section, rule, trigger).agg(F.count("*").alias("n"))


def exploded_parts(features: DataFrame) -> DataFrame:
    """features (id, parts ARRAY) as a row for each part, with the id `M{id}{index}`."""
    return features.select(F.col("id"), F.posexplode("parts").alias("part_no", "part")).select(F.concat(F.lit("M"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("part_no").cast("string")).alias("id"), "part_no", "part")


def profile(rows: DataFrame, props: str, listed: int = 60) -> DataFrame:
    """(key, present, n_values, value, n): each key's presence and distinct values, and its most frequent values."""
    pairs = rows.select(F.explode(F.map_entries(props)).alias("e")).select("e.key", "e.value")
    counts = pairs.groupBy("key", "value").agg(F.count("*").alias("n"))
    keys = counts.groupBy("key").agg(F.sum("n").alias("present"), F.count("*").alias("n_values"))
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("n"), F.asc_nulls_first("value")))
    top = counts.withColumn("_p", place).where(F.col("_p") <= listed).drop("_p")
    return keys.join(top, "key").select("key", "present", "n_values", "value", "n")


def profile_types(rows: DataFrame, props: str, few: int = 12) -> DataFrame:
    """(key, present, optional, types, n_values, is_enum) for each key of the maps `props`.

    types: those of number, boolean, empty and string that occur, joined by `|`; optional: some row lacks the key;
    is_enum: at most `few` distinct values. Values are counted before keys, so a frequent key is no task of its own.
    """
    v = F.col("value")
    kind = F.when(v.rlike("^-?[0-9]+$"), "number").when(v.isin("yes", "no", "true", "false"), "boolean").when(v == "", "empty").otherwise("string")
    counts = rows.select(F.explode(F.map_entries(props)).alias("e")).select("e.key", "e.value").groupBy("key", "value").agg(F.count("*").alias("n"))
    keys = counts.groupBy("key").agg(F.sum("n").alias("present"), F.array_join(F.array_sort(F.collect_set(kind)), "|").alias("types"), F.count("value").alias("n_values"))
    all_ = rows.agg(F.count("*").alias("rows"))  # one row
    return keys.join(F.broadcast(all_)).select("key", "present", (F.col("present") < F.col("rows")).alias("optional"), "types", "n_values", (F.col("n_values") <= few).alias("is_enum"))
