"""Readiness on a live stream against the replay of its log, in several batches and out of order."""

import random

from pyspark.sql import functions as F

from snapsift.streaming import readiness


def test_live_verdicts_are_those_of_the_replay(spark, tmp_path):
    rng = random.Random(8)
    events = []
    for page in range(40):
        t = rng.random() * 5
        for _ in range(rng.randint(1, 12)):
            events.append((page, t, rng.random() < 0.6))
            t += rng.choice([0.05, 0.2, 0.45, 0.6, 2.0])
    events.sort(key=lambda e: e[1] + rng.random() * 0.3)  # late by less than the watermark allows
    schema = "page long, at double, visual boolean"
    everything = spark.createDataFrame(events, schema)
    for k in range(0, len(events), 40):
        part = spark.createDataFrame(events[k : k + 40], schema).select("page", F.timestamp_micros((F.col("at") * 1000000).cast("long")).alias("time"), "visual")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    spark.createDataFrame([(None, 10000.0, True)], schema).select("page", F.timestamp_micros((F.col("at") * 1000000).cast("long")).alias("time"), "visual").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("page long, time timestamp, visual boolean").option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    found = readiness.live(stream, "page", "time", F.col("visual"), 0.5, 1.0, "1 second")
    found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    rounded = lambda d: sorted((r.page, round(r.started, 4), round(r.settled, 4), r.noise, r.quality) for r in d.where("page is not null").collect())
    got, want = rounded(spark.read.parquet(str(tmp_path / "out"))), rounded(readiness.replay(everything, "page", "at", F.col("visual"), 0.5, 1.0))
    assert got == want and {q for *_, q in got} == {"OPTIMAL", "STABLE", "DEGRADED"}


def test_one_page_event_by_event():
    assert readiness.settle([3.0], [True], 0.5, 1.0) == (3.0, 0.5, 0, "OPTIMAL")
    assert readiness.settle([3.0, 3.2], [False, False], 0.5, 1.0)[1:] == (0.5, 2, "STABLE")
    assert readiness.settle([0.0, 0.4, 0.8], [True, True, True], 0.5, 1.0) == (0.0, 1.0, 0, "DEGRADED")
