"""Operators on ordered rows: offsets, renumbering, islands, sliding windows, ranks, weighted picks and lookups in order.

Nulls come first in an order, as Spark sorts them, and a null group is a group. Where the order leaves ties, pass a column
that breaks them: results are defined by the order given. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def exclusive_sum(value: str, order: str, *, by: list[str]) -> Column:
    """Sum of the rows before: the offset of each item in a packed column."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(value).over(w), F.lit(0))


def renumbered(rows: DataFrame, by: list[str], *order) -> DataFrame:
    """rows with `no`, dense numbers from 0 in the order given."""
    return rows.withColumn("no", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def squeezed(values: Column) -> Column:
    """An array without elements equal to the one before."""
    return F.filter(values, lambda v, i: (i == 0) | ~v.eqNullSafe(F.get(values, i - 1)))


def without_repeats(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """rows whose value differs from that of the row before it in the group; the first of a group stays, null is a value.

    A sort within groups and no array of them, so a group may be of any length.
    """
    w = Window.partitionBy(by).orderBy(*order)
    marked = rows.withColumn("_n", F.row_number().over(w)).withColumn("_b", F.lag(value).over(w))
    return marked.where((F.col("_n") == 1) | ~F.col("_b").eqNullSafe(F.col(value))).drop("_n", "_b")


def islands(rows: DataFrame, by: str, order: list[str], inside: Column) -> DataFrame:
    """Rows that are inside, with `island`: how many rows outside came before, so runs of inside rows share a number."""
    w = Window.partitionBy(by).orderBy(*order)
    marked = rows.withColumn("_in", inside).withColumn("island", F.sum(F.when(F.col("_in"), 0).otherwise(1)).over(w))
    return marked.where("_in").drop("_in")


def sliding_rate(frames: DataFrame, span_us: int) -> DataFrame:
    """frames (user_id, event_id, us) with n and rate: intervals a second over the last span, 0 for fewer than two frames.

    The rate is rounded half up to a whole number of intervals in 1000 seconds.
    """
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-span_us, 0)
    rows = frames.withColumn("n", F.count("*").over(w)).withColumn("_first", F.min("us").over(w))
    rate = F.floor((F.col("n") - 1) * 1e9 / (F.col("us") - F.col("_first")) + 0.5).cast("long")
    return rows.withColumn("rate", F.when((F.col("n") < 2) | (F.col("us") == F.col("_first")), F.lit(0)).otherwise(rate)).drop("_first")


def largest_gap(frames: DataFrame, span_us: int, ignore_us: int) -> DataFrame:
    """frames with gap: the largest time between neighbours that both lie in the last span; longer ones than ignore_us don't count.

    Frames at the same time see the same window. A frame alone in its window has gap 0.
    """
    # a gap stands at its earlier end, so that a window of rows before this one holds those whose both ends it holds
    after = F.lead("us").over(Window.partitionBy("user_id").orderBy("us", "event_id"))
    rows = frames.withColumn("_g", F.when(after - F.col("us") <= ignore_us, after - F.col("us")))
    w = Window.partitionBy("user_id").orderBy("us").rangeBetween(-span_us, -1)
    return rows.withColumn("gap", F.coalesce(F.max("_g").over(w), F.lit(0))).drop("_g")


def instant_rate(frames: DataFrame, least_us: int, most_us: int) -> DataFrame:
    """frames with rate_m, frames in 1000 seconds: shorter steps keep the rate before, longer ones give 0."""
    order = Window.partitionBy("user_id").orderBy("us", "event_id")
    step = F.col("us") - F.lag("us").over(order)
    rows = frames.withColumn("_r", F.when(step > most_us, F.lit(0)).when(step >= least_us, F.floor(F.lit(1e9) / step).cast("long")))
    return rows.withColumn("rate_m", F.coalesce(F.last("_r", ignorenulls=True).over(order), F.lit(0))).drop("_r")


def weighted_pick(rows: DataFrame, by: str, weight: str, order: str, share: float) -> DataFrame:
    """For each group the first row whose running weight reaches share of the whole."""
    w = Window.partitionBy(by)
    run = F.sum(weight).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    hit = rows.withColumn("_run", run).withColumn("_all", F.sum(weight).over(w)).where(F.col("_run") >= share * F.col("_all"))
    return hit.withColumn("_n", F.row_number().over(w.orderBy(order))).where("_n = 1").drop("_n", "_run", "_all")


def _numbered(rows: DataFrame, order: list[str], block: int = 4096) -> DataFrame:
    """rows with new_id, dense from 0 in the order given, whose first column is a whole number.

    Blocks of that column are counted first, so no task numbers all rows.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(order[0]) / block))
    sizes = blocked.groupBy("_block").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_block", before.alias("_start"))
    place = F.row_number().over(Window.partitionBy("_block").orderBy(*order)) - 1
    return blocked.withColumn("_p", place).join(starts, "_block").withColumn("new_id", (F.col("_start") + F.col("_p")).cast("long")).drop("_block", "_start", "_p")


def _listed(lists: DataFrame, by: str, ids: str, known: DataFrame, key: str) -> DataFrame:
    rows = lists.select(by, F.posexplode(ids).alias("_o", key))
    return rows.join(known.select(key).distinct().withColumn("_found", F.lit(True)), key, "left").withColumn("_found", F.coalesce("_found", F.lit(False)))


def looked_up(lists: DataFrame, by: str, ids: str, known: DataFrame, key: str) -> DataFrame:
    """(by, key, new_id): ids of lists (by, ids ARRAY) that known (key) holds, numbered from 0 in order of by and place.

    An id listed twice has two numbers; null ids are not found. known's repeated rows count once.
    """
    return _numbered(_listed(lists, by, ids, known, key).where("_found").drop("_found"), [by, "_o"]).select(by, key, "new_id")


def lookup_report(lists: DataFrame, by: str, ids: str, known: DataFrame, key: str, shown: int = 10) -> DataFrame:
    """One row: found, missing, and sample, the first missing ids joined by commas (null if there are none)."""
    rows = _listed(lists, by, ids, known, key)
    head = rows.where("not _found").orderBy(by, "_o").limit(shown).agg(F.array_sort(F.collect_list(F.struct(by, "_o", F.col(key).cast("string").alias("k")))).alias("h"))
    counts = rows.agg(F.count_if("_found").alias("found"), F.count_if(~F.col("_found")).alias("missing"))
    return counts.join(F.broadcast(head)).select("found", "missing", F.nullif(F.array_join(F.transform("h", lambda r: r["k"]), ", "), F.lit("")).alias("sample"))


def remapped(rows: DataFrame, reference: str, new: DataFrame, old: str, no: str = "no") -> DataFrame:
    """rows whose reference is replaced by the new number `no` of the row of new that has it as old; others are left out."""
    return rows.join(new.withColumnRenamed(old, reference), reference).drop(reference)
