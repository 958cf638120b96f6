"""Operational statistics: durations by operation, errors by message."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def durations(samples: DataFrame, operation: str, value: str, time: str, key: str, last: int = 100) -> DataFrame:
    """Per operation: count, total, average, min and max of all samples; deviation and nearest-rank percentiles of the last ones."""
    half_up = lambda c: F.floor(c + 0.5).cast("long")
    total = samples.groupBy(operation).agg(F.count("*").alias("count"), F.sum(value).alias("s"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    rank = F.row_number().over(Window.partitionBy(operation).orderBy(F.desc(time), F.desc(key)))
    recent = samples.select(operation, value, time, key).withColumn("rn", rank).where(F.col("rn") <= last)
    joined = recent.join(total, operation).withColumn("avg", F.col("s") / F.col("count"))
    at = lambda p: half_up(F.call_function("element_at", F.array_sort(F.collect_list(value)), F.greatest(F.ceil(F.count("*") * p), F.lit(1)).cast("int")))
    return joined.groupBy(operation).agg(
        F.first("count").alias("count"), half_up(F.first("s")).alias("total"), half_up(F.first("avg")).alias("average"), half_up(F.first("lo")).alias("min"), half_up(F.first("hi")).alias("max"),
        half_up(F.sqrt(F.avg(F.pow(F.col(value) - F.col("avg"), 2)))).alias("std_dev"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"),
    )


def errors(log: DataFrame, code: str, message: str, time: str, keep: int = 100) -> DataFrame:
    """One row per code and message with its count and times; the most recently seen stay."""
    return log.groupBy(code, message).agg(F.count("*").alias("count"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen")).orderBy(F.desc("last_seen"), code, message).limit(keep)
