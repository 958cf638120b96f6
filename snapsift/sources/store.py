"""The store of reports and comparisons as versioned Parquet tables: look-ups, appends, deletes, an operation log, gates before a comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The store's tables, those that an upgrade to a version empties, and the least version of a report.
TABLES = ["reports", "elements", "comparisons", "comparison_diffs", "comparison_summary", "visual_blobs", "visual_keyframes", "visual_element_rects", "operation_log"]
KEPT_AT_DELETE = ["operation_log"]
EMPTIED_BY = {5: ["comparisons", "comparison_diffs", "comparison_summary", "visual_blobs", "operation_log"]}
LEAST_VERSION = (3, 0)
# End of fixed values.


def pair_key(base: Column, comp: Column, mode: Column) -> Column:
    return F.concat_ws("_", base, comp, mode)


def by_pair(comparisons: DataFrame, base, comp, mode: str) -> DataFrame:
    """The comparison of two reports in a mode, if there is one; a filter that reaches the scan."""
    return comparisons.where((F.col("baseline_id") == base) & (F.col("compare_id") == comp) & (F.col("mode") == mode))


def diffs_of(comparisons: DataFrame, diffs: DataFrame) -> DataFrame:
    """The stored diffs of the given comparisons."""
    return diffs.join(comparisons.select("comparison_id").distinct(), "comparison_id", "left_semi")


def cached(wanted: DataFrame, comparisons: DataFrame, diffs: DataFrame) -> DataFrame:
    """For wanted pairs (baseline_id, compare_id, mode): the comparison's id and its number of diffs; null ids have to be computed."""
    found = wanted.join(comparisons.select("comparison_id", "baseline_id", "compare_id", "mode"), ["baseline_id", "compare_id", "mode"], "left")
    n = diffs.groupBy("comparison_id").agg(F.count("*").alias("n_diffs"))
    return found.join(n, "comparison_id", "left").select("baseline_id", "compare_id", "mode", "comparison_id", F.when(F.col("comparison_id").isNotNull(), F.coalesce("n_diffs", F.lit(0))).alias("n_diffs"))


def keyframes_of(keyframes: DataFrame, session: str) -> DataFrame:
    return keyframes.where(F.col("session_id") == session)


def put(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with ``rows`` put: a row of a known key takes its place; of several new rows of one key the last by ``put_order`` counts."""
    new = rows.groupBy(key).agg(F.max_by(F.struct(*[rows[c] for c in table.columns]), "put_order").alias("r")).select("r.*")
    return table.join(new.select(key), key, "left_anti").select(*table.columns).unionByName(new)


def without_sessions(table: DataFrame, sessions: DataFrame) -> DataFrame:
    """The table without all rows of the listed sessions (column session_id)."""
    return table.join(sessions.select("session_id").distinct(), "session_id", "left_anti")


def delete_all(spark: SparkSession, folder: str, tables: list[str] = TABLES) -> list[str]:
    """Empties every table of the store but the operation log, each by one overwrite; returns what was emptied."""
    emptied = [t for t in tables if t not in KEPT_AT_DELETE]
    for name in emptied:
        kept = spark.read.parquet(f"{folder}/{name}").schema
        spark.createDataFrame([], kept).write.mode("overwrite").parquet(f"{folder}/{name}")
    return emptied


def migrate(tables: dict[str, DataFrame], old: int, new: int) -> dict[str, DataFrame]:
    """The tables after an upgrade of the store: those that a version on the way empties have no rows."""
    gone = {t for version, names in EMPTIED_BY.items() if old < version <= new for t in names}
    return {name: table.limit(0) if name in gone else table for name, table in tables.items()}


def log_state(log: DataFrame) -> DataFrame:
    """operation_id, status, started: the last state of each logged operation (rows are only ever appended)."""
    return log.groupBy("operation_id").agg(F.max_by("status", F.struct("at", "status")).alias("status"), F.min("at").alias("started"))


def pending(log: DataFrame) -> DataFrame:
    """Operations that began and never completed; they are reported, not repeated."""
    return log_state(log).where("status = 'PENDING'").select("operation_id", "started")


def version_is_enough(version: Column) -> Column:
    """Whether a report's version (major.minor) is the least one or later; none counts as 0.0, parts that are no numbers as 0."""
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(F.get(F.split(F.coalesce(version, F.lit("0.0")), r"\."), k), r"^\s*(\d+)", 1), F.lit("")).cast("int"), F.lit(0))
    major, minor = part(0), part(1)
    return (major > LEAST_VERSION[0]) | ((major == LEAST_VERSION[0]) & (minor >= LEAST_VERSION[1]))


def comparable(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``refused``: why two reports can't be compared (same report, address, no elements, version), null if they can.

    ``pairs`` has baseline_id, compare_id, classification, base_elements, compare_elements, base_version and compare_version.
    """
    why = (
        F.when(F.col("baseline_id") == F.col("compare_id"), "same report")
        .when(F.col("classification") == "INCOMPATIBLE", "incompatible addresses")
        .when((F.coalesce("base_elements", F.lit(0)) == 0) | (F.coalesce("compare_elements", F.lit(0)) == 0), "no elements")
        .when(~version_is_enough(F.col("base_version")) | ~version_is_enough(F.col("compare_version")), "version too old")
    )
    return pairs.withColumn("refused", why)


def require_comparable(pairs: DataFrame) -> DataFrame:
    """The pairs; a job that reads one that is refused ends with the reason."""
    judged = comparable(pairs)
    checked = F.when(F.col("refused").isNull(), True).otherwise(F.raise_error(F.concat(F.lit("not comparable: "), "refused")).cast("boolean"))
    return judged.where(checked).drop("refused")
