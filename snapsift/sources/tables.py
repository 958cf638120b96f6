"""Stored reports and comparisons: reading, retention, upsert, cascading deletes, pivots."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; without one a folder of our own, which only a local master shares with its tasks."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="snapsift-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back: what is used several times, or again and again in a loop, is neither planned nor run anew, and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/snapsift-{spark.sparkContext._jvm.java.util.UUID.randomUUID()}"
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


#: Fixed value: rows of a part of a table that is dealt by report pair; what a task makes of so many rows it sorts in memory.
PART_ROWS = 200_000
# End of fixed value.


def parts_of(df: DataFrame) -> int:
    """Into how many parts a table is dealt."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // PART_ROWS))


def by_pair(df: DataFrame, key: str = "pair_id", parts: int | None = None) -> DataFrame:
    """``df`` dealt by its report pair, in as many parts as it has rows for.

    All that follows groups, sorts and joins by the pair and something else, so it stays in its part: joins are told that rows lie together if those of a pair do.
    """
    df.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return df.repartition(parts or parts_of(df), key)


def kept(df: DataFrame, parts: int, key: str = "pair_id") -> DataFrame:
    """Like ``written``, as a table bucketed by the report pair: what reads it finds the rows of a pair in one part and need not deal them anew.

    Its joins are merges: the rows lie together, and the files are packed so well that their size would have Spark send tables of many times as much through the driver.
    """
    spark = df.sparkSession
    name = f"snapsift_{spark.sparkContext._jvm.java.util.UUID.randomUUID()}".replace("-", "")
    path = f"{scratch(spark)}/{name}"
    by_pair(df, key, parts).write.bucketBy(parts, key).option("path", path).saveAsTable(name)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.table(name).hint("merge")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """A table from parquet, JSON lines or CSV with a header."""
    reader = spark.read.format(kind)
    reader = reader.schema(schema) if schema else reader
    return (reader.option("header", True) if kind == "csv" else reader).load(path)


def newest(table: DataFrame, time: str, key: str, n: int, per: list[str] | None = None) -> DataFrame:
    """The newest ``n`` rows, of all or per group. All: a sort with a limit, so no task holds more than ``n`` rows at the end."""
    if not per:
        return table.orderBy(F.desc(time), F.desc(key)).limit(n)
    rank = F.row_number().over(Window.partitionBy(*per).orderBy(F.desc(time), F.desc(key)))
    return table.withColumn("rn", rank).where(F.col("rn") <= n).drop("rn")


def upsert(table: DataFrame, pair_key: str, time: str, key: str, n: int) -> DataFrame:
    """The newest row of every pair key, and of those the newest ``n``."""
    latest = table.groupBy(pair_key).agg(F.max_by(F.struct(*[table[c] for c in table.columns]), F.struct(time, key)).alias("r")).select("r.*")
    return newest(latest, time, key, n)


def without_reports(comparisons: DataFrame, gone: DataFrame, base: str, comp: str) -> DataFrame:
    """Comparisons of which neither side is among the deleted reports (one column)."""
    ids = gone.toDF("gone").distinct()
    return comparisons.join(ids, F.col(base) == F.col("gone"), "left_anti").join(ids, F.col(comp) == F.col("gone"), "left_anti")


def role_pivot(rects: DataFrame, keys: list[str], role: str, value: str, order: str) -> DataFrame:
    """One row per element with a column for each role; of several values of a role the one with the greatest ``order`` counts."""
    return rects.groupBy(*keys).pivot(role, ["baseline", "compare"]).agg(F.max_by(value, order))


def style_columns(elements: DataFrame, keys: list[str], properties: list[str]) -> DataFrame:
    """One column per property out of the style map."""
    return elements.select(*keys, *[F.coalesce(F.col("styles")[p], F.lit("")).alias(p.replace("-", "_")) for p in properties])


def write(table: DataFrame, path: str, kind: str = "parquet", by: list[str] | None = None, mode: str = "overwrite") -> None:
    """A table to parquet, JSON lines or CSV, partitioned if asked."""
    writer = table.write.mode(mode).format(kind)
    writer = writer.partitionBy(*by) if by else writer
    (writer.option("header", True) if kind == "csv" else writer).save(path)
