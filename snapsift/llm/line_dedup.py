"""Line dedup (8) [native]: lines that spread over many distinct sites are boilerplate.

Lines are compared by two 64-bit hashes of their trimmed text. Lines seen fewer times than ``sites`` cannot spread over so many sites and
go first, by a plain count. For the rest, a HyperLogLog sketch of the sites is kept per line hash and merged by aggregation;
a line whose estimate is clearly beyond the threshold is boilerplate, one near it gets an exact distinct count. Boilerplate lines stay
where they stand first (in the smallest id, at the first place there) and go everywhere else.

Defined results: null or empty texts and blank lines have nothing to remove; a null site counts for no site; a null id is never first unless all are
null; repeated rows are documents of their own with the same fate; other columns are ignored by ``spread_lines`` and kept by
``remove_boilerplate``; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

SITES = 5
LG_K = 12
#: Relative half-width of the band around the threshold whose lines are counted exactly (over four standard errors).
NEAR = 0.07

_BLANKS = " \t\x0b\x0c\r"


def _key(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """Two hashes that stand for a document's id and text."""
    return [F.xxhash64(F.lit(k), docs[id_col], docs[text_col]).alias(f"key{k}") for k in (1, 2)]


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """One row per line that is not blank: id, key1, key2, site, place, h1, h2."""
    trimmed = F.transform(F.split(docs[text_col].cast("string"), "\n"), lambda x: F.btrim(x, F.lit(_BLANKS)))
    hashed = F.transform(trimmed, lambda x: F.when(F.length(x) > 0, F.struct(F.xxhash64(F.lit(1), x).alias("h1"), F.xxhash64(F.lit(2), x).alias("h2"))))
    rows = docs.select(docs[id_col].alias("id"), *_key(docs, id_col, text_col), docs[site_col].alias("site"), F.posexplode(hashed).alias("place", "line"))
    return rows.where("line is not null").select("id", "key1", "key2", "site", "place", "line.h1", "line.h2")


def spread_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES) -> tuple[DataFrame, DataFrame]:
    """(occurrences of repeated lines, boilerplate lines h1, h2)."""
    lines = _lines(docs, id_col, text_col, site_col)
    often = cut(lines.groupBy("h1", "h2").agg(F.count("site").alias("n")).where(F.col("n") >= sites).select("h1", "h2"))
    seen = cut(lines.join(often, ["h1", "h2"]))
    sketched = seen.where("site is not null").groupBy("h1", "h2").agg(F.hll_sketch_agg(F.col("site").cast("string"), F.lit(LG_K)).alias("sketch"))
    estimated = cut(sketched.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("estimate")))
    band = max(1.0, NEAR * sites)
    sure = estimated.where(F.col("estimate") > sites + band).select("h1", "h2")
    near = estimated.where(F.abs(F.col("estimate") - sites) <= band).select("h1", "h2")
    exact = seen.join(near, ["h1", "h2"]).where("site is not null").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n"))
    return seen, cut(sure.unionByName(exact.where(F.col("n") >= sites).select("h1", "h2")))


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """Columns ``row`` (the document), ``lines`` (its lines) and ``kept`` (the lines that stay)."""
    seen, boilerplate = spread_lines(docs, id_col, text_col, site_col, sites)
    found = seen.join(boilerplate, ["h1", "h2"])
    order = F.struct(F.col("id").isNull().alias("last"), "id", "key1", "key2", "place")
    first = cut(found.groupBy("h1", "h2").agg(F.min(order).alias("first")))
    gone = found.join(first, ["h1", "h2"]).where(~order.eqNullSafe(F.col("first")))
    # a bit for each removed line: 64 lines to a word, a word found by its number
    word = (F.col("place") / 64).cast("int")
    bits = gone.groupBy("key1", "key2", word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("place") % 64)).alias("bits"))
    removed = cut(bits.groupBy("key1", "key2").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("removed")))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *_key(docs, id_col, text_col), F.split(docs[text_col].cast("string"), "\n").alias("lines"))
    joined = rows.join(removed, ["key1", "key2"], "left")
    stays = lambda x, i: F.call_function("shiftright", F.coalesce(F.col("removed")[(i / 64).cast("int")], F.lit(0)), i % 64).bitwiseAND(F.lit(1)) == 0
    return joined.select("row", "lines", F.when(F.col("removed").isNull(), F.col("lines")).otherwise(F.filter("lines", stays)).alias("kept"))


def line_report(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """One row per document: id, n_lines, n_removed, kept_text."""
    done = marked(docs, id_col, **how)
    n = F.coalesce(F.size("lines"), F.lit(0))
    return done.select(
        F.col("row")[id_col].alias(id_col),
        F.greatest(n, F.lit(0)).cast("long").alias("n_lines"),
        F.greatest(n - F.coalesce(F.size("kept"), F.lit(0)), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.array_join("kept", "\n"), F.lit("")).alias("kept_text"),
    )


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES, length_col: str | None = "n_chars") -> DataFrame:
    """The documents with their boilerplate lines removed (and ``length_col``, if there is one, set anew where lines went).

    A document that loses every line that is not blank goes: all it said stands elsewhere.
    """
    filled = F.filter("kept", lambda x: F.length(F.btrim(x, F.lit(_BLANKS))) > 0)
    done = marked(docs, id_col, text_col, site_col, sites)
    done = done.where(F.col("lines").isNull() | (F.size("kept") == F.size("lines")) | (F.size(filled) > 0))
    changed = F.size("kept") < F.size("lines")
    text = F.when(changed, F.array_join("kept", "\n")).otherwise(F.col("row")[text_col])
    columns = [
        (text if c == text_col else F.when(changed, F.length(text).cast(docs.schema[c].dataType)).otherwise(F.col("row")[c]) if c == length_col else F.col("row")[c]).alias(c)
        for c in docs.columns
    ]
    return done.select(*columns)
