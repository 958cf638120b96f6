"""Readiness of a page from its log of mutations: quiet for a while after the last visual one, or a hard limit.

``replay`` answers from a stored log by event time; ``live`` gives the same verdicts on a stream, each as soon as the watermark is past it; ``sessions`` keeps
visual bursts of a live stream as session windows with a watermark.
"""

from __future__ import annotations

import math
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import scratch


def replay(log: DataFrame, page: str, at: str, visual: Column, window: float, limit: float) -> DataFrame:
    """page, started, settled (seconds after the start), noise, quality: OPTIMAL, STABLE (noise before it settled) or DEGRADED (at the limit).

    ``at`` is a time in seconds. The first event starts the clock; each visual event starts the quiet window anew.
    """
    w = Window.partitionBy(page)
    e = log.select(page, F.col(at).cast("double").alias("at"), visual.alias("visual")).withColumn("started", F.min("at").over(w))
    e = e.withColumn("since", F.col("at") - F.col("started")).where(F.col("since") <= limit)
    marks = e.where("visual or since = 0").select(page, "started", "since")  # the clock starts with the first event, whatever it is
    gap = F.lead("since").over(Window.partitionBy(page).orderBy("since")) - F.col("since")
    quiet = marks.withColumn("gap", gap).where(F.coalesce(F.col("gap") >= window, F.lit(True)) & (F.col("since") + window <= limit))
    first = quiet.groupBy(page).agg(F.min(F.col("since") + window).alias("quiet"))
    joined = e.join(first, page, "left").withColumn("settled", F.coalesce("quiet", F.lit(float(limit))))
    noise = F.count_if(~F.col("visual") & (F.col("since") < F.col("settled")))
    quality = F.when(F.max("quiet").isNull(), "DEGRADED").when(noise > 0, "STABLE").otherwise("OPTIMAL")
    return joined.groupBy(page).agg(F.max("started").alias("started"), F.max("settled").alias("settled"), noise.alias("noise"), quality.alias("quality"))


def settle(times: list[float], visual: list[bool], window: float, limit: float) -> tuple[float, float, int, str]:
    """started, settled (seconds after the start), noise, quality of one page's events so far; what comes later can only move ``settled`` on if it comes before it."""
    started = min(times)
    events = sorted((t - started, v) for t, v in zip(times, visual, strict=True) if t - started <= limit)
    marks = [0.0, *(t for t, v in events if v)]
    quiet = next((t + window for t, after in zip(marks, [*marks[1:], float("inf")], strict=True) if after - t >= window and t + window <= limit), None)
    settled = float(limit) if quiet is None else quiet
    noise = sum(1 for t, v in events if not v and t < settled)
    return started, settled, noise, "DEGRADED" if quiet is None else "STABLE" if noise else "OPTIMAL"


#: What is remembered of a page: its events until it settles, then only that it has.
STATE = "times array<double>, visual array<boolean>, done boolean"


def live(stream: DataFrame, page: str, time: str, visual: Column, window: float, limit: float, late: str) -> DataFrame:
    """The verdicts of ``replay`` on a stream: page, started, settled, noise, quality, once for each page.

    A page waits with one timer of event time, at the end of its quiet window as far as it is known, or at the hard limit; events that arrive in the meantime,
    in any order that the lateness allows, move it. When the watermark is past the timer nothing can change the verdict, and the page's events are
    forgotten. Later events of a settled page change nothing.
    """
    schema = f"page {dict(stream.dtypes)[page]}, started double, settled double, noise long, quality string"

    def run(key, frames, state):
        times, kinds, done = state.get if state.exists else ([], [], False)
        times, kinds = list(times), list(kinds)
        for frame in frames:
            times += [float(t) for t in frame["at"]]
            kinds += [bool(v) for v in frame["visual"]]
        if done or not times:
            return
        verdict = settle(times, kinds, window, limit)
        due = math.ceil(1000 * (verdict[0] + verdict[1]))
        if due <= state.getCurrentWatermarkMs():
            state.update(([], [], True))
            yield pd.DataFrame([(key[0], *verdict)], columns=["page", "started", "settled", "noise", "quality"])
        else:
            state.update((times, kinds, False))
            state.setTimeoutTimestamp(due)

    at = F.unix_micros(F.col(time).cast("timestamp")) / 1000000.0
    rows = stream.withWatermark(time, late).select(F.col(page).alias("page"), F.col(time).alias("time"), at.alias("at"), F.coalesce(visual, F.lit(False)).alias("visual"))
    done = rows.groupBy("page").applyInPandasWithState(run, schema, STATE, "append", "EventTimeTimeout")
    return done.withColumnRenamed("page", page)


def sessions(stream: DataFrame, page: str, time: str, visual: Column, gap: str, late: str) -> DataFrame:
    """Bursts of visual events of a page: page, start, end, events."""
    burst = F.session_window(time, gap)
    counted = stream.where(visual).withWatermark(time, late).groupBy(page, burst).agg(F.count("*").alias("events"))
    return counted.select(page, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def stream_of(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table, be it a folder of files or one file, as a stream of its files."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())


def _run(spark: SparkSession, path: str, page: str, time: str, visual: Column, name: str, plan) -> DataFrame:
    """What ``plan`` makes of all files under ``path``, read as a stream to its end (columns of page, time and "visual").

    The stream appends to a table in the shared checkpoint folder. What is open when the files end is closed by one far event of no page, which is taken out again.
    """
    folder = f"{scratch(spark)}/{name}-{uuid.uuid4()}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    schema = spark.read.parquet(path).schema
    events = spark.read.parquet(path).select(F.col(page), F.col(time).cast("timestamp").alias(time), visual.alias("visual"))
    last = events.agg(F.max(time).alias(time)).select(F.lit(None).cast(schema[page].dataType).alias(page), (F.col(time) + F.expr("INTERVAL 400 DAYS")).alias(time), F.lit(True).alias("visual"))
    last.write.parquet(f"{folder}/last")
    stream = stream_of(spark, path, schema).select(F.col(page), F.col(time).cast("timestamp").alias(time), visual.alias("visual"))
    tail = spark.readStream.schema(events.schema).parquet(f"{folder}/last")
    found = plan(stream.unionByName(tail))
    query = found.writeStream.format("parquet").option("path", f"{folder}/found").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/found").where(F.col(page).isNotNull())


def run_sessions(spark: SparkSession, path: str, page: str, time: str, visual: Column, gap: str, late: str) -> DataFrame:
    """The sessions of all files under ``path``: a burst is appended once the watermark is past it, so the state stays as small as the lateness that is allowed."""
    return _run(spark, path, page, time, visual, "sessions", lambda stream: sessions(stream, page, time, F.col("visual"), gap, late))


def run_live(spark: SparkSession, path: str, page: str, time: str, visual: Column, window: float, limit: float, late: str) -> DataFrame:
    """The live verdicts of all files under ``path``."""
    return _run(spark, path, page, time, visual, "live", lambda stream: live(stream, page, time, F.col("visual"), window, limit, late))
