"""Exact dedup (13): local dedup, salted merge of digest groups, global combining; whole contents are compared at every stage.

1. Each task of the scan groups its own rows by (digest, whole text) and keeps one row for each: its largest id and the number of its rows.
2. These are merged by (salt, digest, whole text), where the salt comes from the task that read them, so that a text which every task holds meets in
   ``SALTS`` tasks instead of one.
3. The winners of the salts, ``SALTS`` at most for a text, are combined by (digest, whole text).

Only texts with copies, and digests that different texts share, leave as groups; a document of neither is its own group. Documents find their group by
digest, hot groups by a broadcast of fewer than ``skew.HOT`` rows. Where different texts share a digest their documents are compared with the groups' whole
texts again, so results do not rest on the digest.

Defined results: a null text is an empty one; texts are equal if they are identical, white space and case included, at any length; of equal texts the
largest id stays, and rows that repeat that id all count as kept; rows count towards ``group_size`` each; a null id never wins over another id, and if a
group has no other its rows are all kept with a null ``keep_id``; other columns, of whatever name, are ignored by ``groups_of_copies`` and kept by
``keep_last``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .skew import join_groups

#: Tasks that the local winners of one text meet in before they are combined.
SALTS = 256


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _combined(texts: DataFrame) -> DataFrame:
    """digest, text, keep_id, n: one row for each distinct text."""
    salted = texts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    winners = salted.groupBy("salt", "digest", "text").agg(F.max("id").alias("keep_id"), F.count("*").alias("n"))  # within a task first, then by salt
    return winners.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def groups_of_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, digest."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    texts = docs.select(docs[id_col].cast("long").alias("id"), digest(text).alias("digest"), text.alias("text"))
    groups = _combined(texts).groupBy("digest").agg(F.count("*").alias("texts"), F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))
    groups = cut(groups.where("n > 1"))
    rows = cut(texts.select("id", "digest"))
    shared = groups.where("texts > 1").select("digest")
    found = join_groups(rows, groups, "digest", "n")
    alone = F.col("n").isNull()
    found = found.where("texts is null or texts = 1").select("id", F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).alias("n"), "digest")
    if not shared.isEmpty():  # a weak digest: tell the texts apart by themselves
        unclear = cut(texts.join(shared, "digest"))
        same = _combined(unclear)
        found = found.unionByName(unclear.join(same, ["digest", "text"]).select("id", "keep_id", "n", "digest"))
    return found.select(F.col("id").alias(id_col), "keep_id", F.col("n").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def keep_last(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns (repeated rows of a kept id all stay)."""
    gone = groups_of_copies(docs, id_col, text_col).where("not kept").select(F.col(id_col).alias("gone"), F.col("digest").alias("of")).distinct()
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.join(gone, docs[id_col].eqNullSafe(F.col("gone")) & (sha256(text) == F.col("of")), "left_anti")
