"""Mixing sources to target weights, with DataFrame operations only.

Sizes are summed by source. Targets share a multiple of all sizes by weight, none above a multiple of its own source:
they are filled like basins up to a common level. A document's repetition rate is its source's target over its source's
size; it is emitted floor(rate) times, and once more with probability equal to the fraction, drawn from a hash of its id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cycled_weights(source: Column, weights: tuple[float, ...]) -> Column:
    """weights in turn over the sources by code point, null last; for a table with one row for each source."""
    turn = F.row_number().over(Window.orderBy(source.asc_nulls_last())) - 1
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(turn, F.lit(len(weights))) + 1).cast("int"))


def source_targets(sizes: DataFrame, share: float, most: float) -> DataFrame:
    """(source, source_size, weight, target) for sizes (source, source_size, weight): targets sum to share * all sizes.

    A target is at most most * source_size; what that cuts off goes to the others by weight, until none is above. Sorted
    by the level at which each is full, the level of the rest follows from running sums. One task sorts one row for each
    source, whatever the number of documents: meant for up to some ten million sources. If share > most, every source gets
    its most.
    """
    full = (F.lit(most) * F.col("source_size") / F.col("weight")).alias("full")
    rows = sizes.select("*", full)
    before = Window.orderBy("full", F.col("source").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    all_size, all_weight = F.sum("source_size").over(every), F.sum("weight").over(every)
    rows = rows.select(
        "*",
        (share * all_size - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("left"),
        (all_weight - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("open"),
    )
    # the first source that the level of it and all after it does not fill ends the full ones
    turn = F.row_number().over(Window.orderBy("full", F.col("source").asc_nulls_first()))
    rows = rows.withColumn("turn", turn)
    level = F.min(F.when(F.col("left") < F.col("full") * F.col("open"), F.struct("turn", (F.col("left") / F.col("open")).alias("level")))).over(every)
    rows = rows.withColumn("level", level["level"])
    target = F.when(F.col("level").isNull() | (F.col("full") <= F.col("level")), most * F.col("source_size").cast("double")).otherwise(F.col("weight") * F.col("level"))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def repetition_plan(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, seed: int = 20240) -> DataFrame:
    """docs (doc_id, text, source) as (doc_id, text, source, rest, size, source_size, target, copies).

    size: number of words of the whole text, however long; null texts have 0. Null sources are one source of their own, the last. rest: a struct of the
    other columns, whatever their names. Rows that share an id draw alike, null ids too. A source without words has target
    0 and its documents 0 copies. An empty table gives an empty one.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text", "source")]
    rows = docs.select("doc_id", "text", "source", (F.struct(*others) if others else F.lit(0)).alias("rest"), n_words(F.col("text")).alias("size"))
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes.withColumn("weight", cycled_weights(F.col("source"), weights)), share, most)
    # Spark broadcasts the few targets after checking their size, else it splits the hot source's side of the join
    targets = targets.select(F.col("source").alias("of"), "source_size", "target")
    rate = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit(seed)), 11) / F.lit(float(2**53))
    return rows.join(targets, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "text", "source", "rest", "size", "source_size", "target",
        (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("long").alias("copies"),
    )


def mix_sources(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each row of repetition_plan as often as its copies say, numbered in `copy` from 1."""
    planned = repetition_plan(docs, **settings).where("copies > 0")
    return planned.select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
