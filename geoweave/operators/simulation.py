"""Tick-wise state as ordered folds: each key's rows are folded in time order by higher-order functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _ordered(rows: DataFrame, key: str, *cols: str) -> DataFrame:
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("steps"))


def spawn_schedule(ticks: DataFrame, cooldown: float) -> DataFrame:
    """ticks (spawner, t, dt) as (spawner, spawned, left): a timer gains dt; at cooldown it spawns one, at most one a tick.

    A spawner's ticks are one array: sessions of a bounded number of ticks are meant.
    """

    def step(s, r):
        timer = s["timer"] + r["dt"]
        hit = timer >= cooldown
        return F.struct(F.when(hit, timer - cooldown).otherwise(timer).alias("timer"), (s["n"] + F.when(hit, 1).otherwise(0)).alias("n"))

    zero = F.struct(F.lit(0.0).alias("timer"), F.lit(0).alias("n"))
    out = F.aggregate("steps", zero, step)
    return _ordered(ticks, "spawner", "t", "dt").select("spawner", out.alias("o")).select("spawner", F.col("o.n").cast("long").alias("spawned"), F.col("o.timer").alias("left"))


def stuck_score(steps: DataFrame, decay: float = 0.5) -> DataFrame:
    """steps (agent, t, target, moved) as (agent, score): halves each step, gains 1 where nothing moved, 0 at a new target."""

    def step(s, r):
        fresh = ~s["target"].eqNullSafe(r["target"])
        gain = F.when(r["moved"], F.lit(0.0)).otherwise(F.lit(1.0))
        return F.struct(r["target"].alias("target"), F.when(fresh, F.lit(0.0)).otherwise(s["score"] * decay + gain).alias("score"))

    zero = F.struct(F.lit(None).cast("string").alias("target"), F.lit(0.0).alias("score"))
    return _ordered(steps, "agent", "t", "target", "moved").select("agent", F.aggregate("steps", zero, step)["score"].alias("score"))
