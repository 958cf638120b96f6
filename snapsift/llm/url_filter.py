"""URL filters (3) [native]: a blocked Bloom filter passes possible hits to an exact hash join.

A listed entry is a canonical URL prefix: a host (which stands for its subdomains too) and the start of a path, allowed or blocked.
A page asks for every pair of a suffix of its host and a beginning of its path that has a listed length, so entries are
found by equality. Its keys are first tested against the filter: the key's hash picks one block of eight 64-bit words and one
bit in each of them, so a test reads a single block. Keys that pass join the entries exactly, which removes false
positives; of several matching entries the longest wins, and a page without any gets the default verdict.

The filter has ``BITS`` bits for each entry, and a row for each block: keys find their block by an equality join, which is a broadcast while the
filter is under ``FILTER_BYTES`` and a shuffle by block beyond that, with the same test either way.

Defined results: a null url, or one without ``://``, has an empty host and path and the default verdict; urls of any length are judged whole; repeated rows are judged each; of matching entries of one length the one with the longer host wins;
null entries are ignored, and of entries that are listed twice with both verdicts allow wins; other columns are ignored;
an empty list gives every page the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Entries that a canonical list of this kind starts with: (host, path, verdict). Others can be given as a table.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
#: The method's own list comes after every rule: site names of kinds that such lists hold (invented ones, as there is no public list at hand), each
#: under every ending. A job with a list of its own gives it as the table ``listed``.
LISTED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "payday-loan", "replica-watch", "spam-farm"]
ENDINGS = ["com", "net", "org", "info", "example.com", "example.net", "example.org"]
BITS = 16
FILTER_BYTES = 64 << 20
WORDS = 8


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def listed_hosts() -> list[str]:
    return [f"{name}.{ending}" for name in LISTED_NAMES for ending in ENDINGS]


def entries(spark, rules=RULES, hosts: list[str] | None = None) -> DataFrame:
    """The list as a table: host, path, verdict, is_rule."""
    rows = [(h, p, v, True) for h, p, v in rules] + [(h, "", "block", False) for h in (listed_hosts() if hosts is None else hosts)]
    return spark.createDataFrame(rows, "host string, path string, verdict string, is_rule boolean")


def _bits(h: Column) -> list[Column]:
    """One bit of each of the block's eight words, from eight odd multiples of the hash."""
    odd = [0x47B6137B, 0x44974D91, 0x8824AD5B, 0xA2B7289D, 0x705495C7, 0x2DF1424B, 0x9EFC4947, 0x5C6BFB31]
    pick = lambda m: F.pmod(F.call_function("shiftrightunsigned", F.xxhash64(h, F.lit(m)), F.lit(40)), F.lit(64)).cast("int")
    return [F.call_function("shiftleft", F.lit(1).cast("long"), pick(m)) for m in odd]


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """block, w0..w7: the bits of every key, put together by ``bit_or``."""
    h = F.xxhash64("host", "path")
    rows = keys.select(F.pmod(h, F.lit(n_blocks)).alias("block"), *[b.alias(f"w{k}") for k, b in enumerate(_bits(h))])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS)])


def judge_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and the entry of the list that decided.

    The verdict depends on the host and the first characters of the path alone, so it is found once for each distinct such pair.
    """
    listed = listed.where("host is not null and path is not null").groupBy("host", "path").agg(F.min("verdict").alias("listed"), F.max("is_rule").alias("is_rule"))
    shape = listed.agg(F.count("*"), F.collect_set(F.length("path")), F.max(F.size(F.split("host", "[.]")))).first()
    host, path = host_and_path(pages[url_col].cast("string"))
    longest = max(shape[1], default=0)
    judged = pages.select(pages[id_col].alias("id"), host.alias("host"), path.alias("path"), F.substring(path, 1, longest).alias("head"))
    if shape[0]:
        verdicts = cut(_decide(judged.select("host", "head").distinct(), listed, shape))
        judged = judged.join(verdicts, ["host", "head"], "left")
    else:
        judged = judged.select("*", F.lit(None).cast("struct<entry:string,listed:string,is_rule:boolean>").alias("best"))
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        F.when(F.col("best.is_rule"), F.col("best.entry")).alias("rule"),
        F.coalesce("best.listed", F.lit(default)).alias("verdict"),
        F.col("best.entry").alias("entry"),
    )


def _decide(asked: DataFrame, listed: DataFrame, shape) -> DataFrame:
    """host, head, best: the entry that wins, for the pairs that have any."""
    count, lengths, labels = shape
    suffixes = F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(labels)), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n)))
    starts = F.array_compact(F.array(*[F.when(F.length("head") >= n, F.substring("head", 1, n)) for n in sorted(lengths)]))
    asked = asked.withColumn("suffix", F.explode(suffixes)).withColumn("start", F.explode(starts))
    keys = asked.select("suffix", "start").distinct()  # each key meets the filter once, however many hosts ask for it
    blocks = max(1, -(-count * BITS // (64 * WORDS)))
    own = F.xxhash64("suffix", "start")
    passes = F.lit(True)
    for k, bit in enumerate(_bits(own)):
        passes = passes & (F.col(f"w{k}").bitwiseAND(bit) != 0)
    filters = bloom_blocks(listed, blocks)
    filters = F.broadcast(filters) if blocks * WORDS * 8 <= FILTER_BYTES else filters.hint("merge")
    possible = keys.withColumn("block", F.pmod(own, F.lit(blocks))).join(filters, "block").where(passes).select("suffix", "start")
    exact = possible.join(listed.withColumnsRenamed({"host": "suffix", "path": "start"}), ["suffix", "start"])
    hits = asked.join(exact, ["suffix", "start"])
    entry = F.struct(F.concat("suffix", "start").alias("entry"), "listed", "is_rule")
    order = F.struct("is_rule", F.length(F.concat("suffix", "start")), F.length("suffix"))
    return hits.groupBy("host", "head").agg(F.max_by(entry, order).alias("best"))
