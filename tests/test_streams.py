"""Stream forms against the batch operators on the same rows."""

import random

from pyspark.sql import functions as F

from geoweave.operators import sequences
from geoweave.streaming.metrics import frame_metrics


def test_metrics_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    """Frames of three users come shuffled within two minutes, in eight files; ties, short steps and long pauses are among them."""
    rng = random.Random(4)
    rows, at = [], {u: 1_700_000_000_000_000 for u in (1, 2, 3)}
    for i in range(400):
        u = rng.choice((1, 1, 2, 3))
        at[u] += rng.choice((0, 300, 16_000, 16_000, 700_000, 2_500_000, 9_000_000))
        rows.append((u, i, at[u]))
    frames = spark.createDataFrame(rows, "user_id long, event_id long, us long")
    batch = sequences.instant_rate(sequences.largest_gap(frames, 10_000_000, 1_000_000), 1_000, 1_000_000)
    want = {(r.user_id, r.event_id): (r.gap, r.rate_m) for r in batch.collect()}
    rows.sort(key=lambda r: r[2] + rng.uniform(-50e6, 50e6))
    rows += [(u, 1000 + u, 1_800_000_000_000_000) for u in (1, 2, 3)]  # lets the watermark pass all others
    for k in range(8):
        part = rows[k * len(rows) // 8 : (k + 1) * len(rows) // 8]
        spark.createDataFrame(part, "user_id long, event_id long, us long").select("user_id", "event_id", F.timestamp_micros("us").alias("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id long, event_id long, ts timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))
    q = frame_metrics(stream, 10_000_000, 1_000_000, 1_000, 1_000_000, "10 minutes").writeStream.format("memory").queryName("metrics").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = [((r.user_id, r.event_id), (r.gap, r.rate_m)) for r in spark.table("metrics").collect()]
    assert len(got) == len(want) and dict(got) == want
