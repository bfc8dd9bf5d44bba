"""Streams: frame metrics by sliding windows, and commands by key."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def frame_rates(frames: DataFrame, window: str = "10 seconds", slide: str = "1 second", late: str = "1 minute") -> DataFrame:
    """frames (ts TIMESTAMP, user_id) as (user_id, start, end, n): frames in each sliding window; rows later than `late` are dropped."""
    counted = frames.withWatermark("ts", late).groupBy("user_id", F.window("ts", window, slide).alias("w")).agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest_commands(commands: DataFrame) -> DataFrame:
    """commands (target, seq, action, value) as (target, seq, action, value, handled): the latest of each target and how many came.

    Unknown actions are not handled. State is one row for each target.
    """
    known = ["set_corridor", "stop", "resume"]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, action, value, handled = state.get if state.exists else (-1, "", 0.0, 0)
        for rows in batches:
            good = rows[rows["action"].isin(known)]
            handled += len(good)
            if len(good):
                last = good.loc[good["seq"].idxmax()]
                if last["seq"] > seq:
                    seq, action, value = int(last["seq"]), str(last["action"]), float(last["value"])
        state.update((seq, action, value, handled))
        yield pd.DataFrame({"target": [key[0]], "seq": [seq], "action": [action], "value": [value], "handled": [handled]})

    shape = "seq long, action string, value double, handled long"
    return commands.groupBy("target").applyInPandasWithState(update, f"target long, {shape}", shape, "update", GroupStateTimeout.NoTimeout)


def frame_metrics(frames: DataFrame, span_us: int, ignore_us: int, least_us: int, most_us: int, late: str = "1 minute") -> DataFrame:
    """frames (ts TIMESTAMP, user_id, event_id) as (user_id, event_id, us, gap, rate_m), each when no earlier frame can come any more.

    gap and rate_m are those of sequences.largest_gap and sequences.instant_rate over the same rows, in whatever order they
    come: a frame waits until the watermark has passed it. Frames later than `late` are dropped. What is kept for each user is
    the frames that wait, those of the last span, and the last rate.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        wait, past, rate = json.loads(state.get[0]) if state.exists else ([], [], 0)
        for rows in batches:
            wait += zip((rows["ts"].astype("datetime64[us]").astype("int64")).tolist(), rows["event_id"].tolist())
        passed = state.getCurrentWatermarkMs() * 1000
        wait = sorted(map(tuple, wait))
        done = [x for x in wait if x[0] < passed]
        out = []
        if done:
            us = np.array(past + [u for u, _ in done], np.int64)
            steps = np.diff(us)
            counted = np.where(steps <= ignore_us, steps, 0)  # a gap stands at its earlier end
            begin, end = np.searchsorted(us, us - span_us), np.searchsorted(us, us)
            for k, (u, event) in enumerate(done, len(past)):
                if k:
                    rate = 0 if steps[k - 1] > most_us else int(1e9 // steps[k - 1]) if steps[k - 1] >= least_us else rate
                out.append((key[0], event, u, int(counted[begin[k] : end[k]].max(initial=0)), rate))
            # a window holds what lies in it, and the last frame is always needed
            past = us[min(begin[-1], len(us) - 1) :].tolist()
        wait = wait[len(done) :]
        state.update((json.dumps([wait, past, rate]),))
        if wait:
            state.setTimeoutTimestamp(max(wait[0][0] // 1000 + 1, passed // 1000 + 1))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "us", "gap", "rate_m"]).astype("int64")

    kept = frames.select("ts", "user_id", "event_id").withWatermark("ts", late)
    shape = "user_id long, event_id long, us long, gap long, rate_m long"
    return kept.groupBy("user_id").applyInPandasWithState(update, shape, "held string", "append", GroupStateTimeout.EventTimeTimeout)
