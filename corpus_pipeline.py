"""The corpus pipeline: quality rules, line dedup, near-dedup, benchmark decontamination, byte-level BPE.

Each stage takes the documents that its predecessor kept and returns them with the columns of ``documents``; the last
one returns a row of digests for each document. ``run`` writes every stage's result to the shared checkpoint folder and
rereads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snapsift.llm import byte_bpe, decontaminate, line_dedup, near_dedup, quality
from snapsift.llm.common import cut, table
from snapsift.llm.queries import _pattern, _tokenizer


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or their group's thresholds go.

    A null or empty text fails; a null language or source is a group of its own; repeated rows share their fate; no documents give none.
    """
    return quality.keep_good(docs)


def cross_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go, but where they stand first; documents of nothing else go with them.

    Null texts and sources stay; ``n_chars`` follows the text; repeated rows share their fate; no documents give none.
    """
    return line_dedup.remove_boilerplate(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id.

    Documents without words or without an id stay; repeated rows of one id are one document; no documents give none.
    """
    return near_dedup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go.

    Documents without words stay; repeated rows are judged each; without benchmark items all stay; no documents give none.
    """
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes; a null text is an empty one; repeated rows are encoded each; no documents give none."""
    return byte_bpe.encode_decode(docs, _tokenizer("byte_bpe_50k.tiktoken"), _pattern())


STAGES = [
    ("quality_rules", quality_rules),
    ("cross_site_lines", cross_site_lines),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_level_bpe", byte_level_bpe),
]
#: SQL expresses neither the signatures' groups nor the merges; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
