"""Labels of components as more links become known; no list of links or labels leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from geoweave.operators.graph import linked
from geoweave.shared import written


def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels (node, label) as more links (a, b) make them: only components that the links touch are worked on. links is read more than once."""
    if not links.limit(1).count():
        return links.select(F.col("a").alias("node"), F.col("b").alias("label")) if labels is None else labels
    if labels is None:
        return written(linked(links), "labels")
    known = labels.select("node", "label")
    named = links.join(known.select(F.col("node").alias("a"), F.col("label").alias("la")), "a", "left").join(known.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b", "left")
    merged = written(linked(named.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))), "merged")
    onto = merged.select(F.col("node").alias("label"), F.col("label").alias("now"))
    old = known.join(onto, "label", "left").select("node", F.coalesce("now", "label").alias("label"))
    return written(old.union(merged.join(known, "node", "left_anti").select("node", "label")), "labels")
