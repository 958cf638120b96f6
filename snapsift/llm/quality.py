"""Quality rules (2) [native]: adaptive thresholds from mergeable quantile sketches, then a joined filter.

Each document gets counts by array functions only. For four ratios (symbols, characters and repeated words per word, repeated lines per line) a
quantile sketch is kept for every language and source: a histogram over logarithmic buckets with ``2 ** PRECISION`` steps to the octave, so a bucket is wrong by at most 1/16 of its value. Things that most documents have none of
are counted as one more than were seen, in a text that is a little longer (``SEEN``), so that their median is what a text of usual length could have and not 0: a
group's spread then comes from its lengths where it has no such things, and from their number where it has. Counts of buckets add up, so sketches merge by plain
aggregation, in any order and on any number of executors, to the same result. A group's threshold is its median plus ``SPREADS`` times the spread
between the median and the ``UPPER`` quantile; no fixed value bounds it. It is shrunk towards the threshold of the language (the merged sketch of
its sources), and that towards the threshold of all rows, with the weight of ``PRIOR`` rows, so a group of few rows follows its
language and one of many itself, without a switch between them. A document fails where its value lies beyond its group's threshold; at the threshold it passes. A group of
documents that are all alike has no spread, so its threshold is their value, but for what it shares with its language.

Defined results: null or empty text has 0 words and fails the base rules; texts of any length are counted whole; null languages and sources form groups of their own;
repeated rows count each; other columns are ignored by ``quality`` and kept by ``keep_good``; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SPACE = "[ \\t-\\r]+"
SYMBOLS = "#*$%&|<>"
PRECISION = 4
SCALE = 1_000
UPPER = 0.9
SPREADS = 4
PRIOR = 100
#: metric -> (count, what it is a share of, added to the count, added to the whole). A repeated window is three words.
SEEN = {
    "symbol_ratio": ("n_symbols", "n_words", 1, 50),
    "word_length": ("word_chars", "n_words", 0, 0),
    "repeat_ratio": ("n_repeat_words", "n_words", 3, 50),
    "dup_line_ratio": ("n_dup_lines", "n_lines", 1, 10),
}
METRICS = list(SEEN)

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def _repeat_words(rows: DataFrame) -> DataFrame:
    """Adds n_repeat_words: sort the windows by (hash, place), compare neighbours, join the places of those found twice or more.

    Each array is a column of its own, so that lambdas read it instead of computing it again for every element.
    """
    n = F.size("w")
    windows = F.transform(F.slice("w", 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2)))
    placed = F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p")))
    near = lambda i, x: F.get("by_hash", i)["h"] == x["h"]
    twice = F.transform("by_hash", lambda x, i: F.when(near(i - 1, x) | near(i + 1, x), x["p"]))
    gap = lambda p, i: F.least(F.coalesce(F.get("places", i + 1) - p, F.lit(3)), F.lit(3))
    rows = rows.withColumn("windows", windows)
    rows = rows.withColumn("by_hash", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(placed))).drop("windows")
    rows = rows.withColumn("places", F.sort_array(F.array_compact(twice))).drop("by_hash")
    rows = rows.withColumn("gaps", F.transform("places", gap)).drop("places")
    return rows.withColumn("n_repeat_words", F.coalesce(F.aggregate("gaps", F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")).drop("gaps")


def counts(docs: DataFrame, text_col: str, **keep: Column) -> DataFrame:
    """``keep`` and the counts of each document."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(*[c.alias(k) for k, c in keep.items()], text.alias("text"), words(text).alias("w"))
    rows = rows.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\x0b\x0c\r"))) > 0))
    return _repeat_words(rows).select(
        *keep,
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        "n_repeat_words",
    )


def bucket(value: Column) -> Column:
    """Number of the logarithmic bucket of a whole number >= 0, by integer steps only."""
    low = 1 << PRECISION
    octave = F.length(F.bin(value)) - 1 - PRECISION
    return F.when(value < low, value).otherwise(octave * low + F.call_function("shiftrightunsigned", value, octave.cast("int"))).cast("long")


def bucket_floor(b: Column) -> Column:
    """The least value of a bucket."""
    low = 1 << PRECISION
    octave = F.floor(b / low) - 1
    return F.when(b < low, b).otherwise((b - octave * low) * F.pow(F.lit(2), octave)).cast("long")


def thresholds(metrics: DataFrame) -> DataFrame:
    """lang, source, limits (metric -> threshold), from the sketches of each group, its language and all rows."""
    stacked = metrics.select("lang", "source", F.explode(F.create_map(*[x for m in METRICS for x in (F.lit(m), bucket(F.col(m)))])).alias("metric", "bucket"))
    sketch = stacked.groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))
    by_lang = sketch.groupBy("lang", "metric", "bucket").agg(F.sum("n").alias("n"))
    overall = by_lang.groupBy("metric", "bucket").agg(F.sum("n").alias("n"))

    def own(s: DataFrame, keys: list[str], rows: str, limit: str) -> DataFrame:
        """The threshold that a sketch gives by itself: whole numbers only, so that every run and engine agrees."""
        w = Window.partitionBy(*keys, "metric").orderBy("bucket")
        ranked = s.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys, "metric")))
        at = lambda q: F.min(F.when(100 * F.col("upto") >= round(100 * q) * F.col("total"), F.col("bucket")))
        found = ranked.groupBy(*keys, "metric").agg(at(0.5).alias("b"), at(UPPER).alias("c"), F.max("total").alias(rows))
        mid, up = (bucket_floor(F.col(b) + 1) - 1 for b in ("b", "c"))  # the greatest values of the two buckets
        return found.select(*keys, "metric", rows, (mid + SPREADS * (up - mid)).alias(limit))

    def shrunk(rows: str, limit: str, wider: str) -> Column:
        return F.expr(f"({rows} * {limit} + {PRIOR} * {wider}) div ({rows} + {PRIOR})")

    joined = own(by_lang, ["lang"], "lang_rows", "lang_limit").join(own(overall, [], "all_rows", "all_limit"), "metric")
    wider = joined.select(F.col("lang").alias("l"), F.col("metric").alias("m"), shrunk("lang_rows", "lang_limit", "all_limit").alias("wider"))
    both = own(sketch, ["lang", "source"], "n_rows", "own_limit").join(wider, F.col("lang").eqNullSafe(F.col("l")) & (F.col("metric") == F.col("m")))
    return both.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("metric", shrunk("n_rows", "own_limit", "wider")))).alias("limits"))


def judge(docs: DataFrame, id_cols: dict[str, Column], text_col: str, lang_col: str, source_col: str) -> DataFrame:
    share = lambda count, of, one, more: F.call_function("div", (F.col(count) + one) * SCALE, F.greatest(F.col(of) + more, F.lit(1)))
    rows = counts(docs, text_col, **id_cols, lang=docs[lang_col], source=docs[source_col])
    metrics = cut(
        rows.select(
            "*",
            *[share(*SEEN[m]).alias(m) for m in METRICS],
            ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        )
    )
    limits = thresholds(metrics).withColumnsRenamed({"lang": "l", "source": "s"})
    judged = metrics.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    failed = F.array_compact(F.array(*[F.when(F.col(m) > F.col("limits")[m], F.lit(m)) for m in METRICS]))
    return judged.withColumn("failed", failed).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: id, the counts, base_failed, kept, and the rules it failed."""
    return judge(docs, {"id": docs[id_col]}, text_col, lang_col, source_col).select(F.col("id").alias(id_col), *_COUNTS, "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The documents that pass, with all their columns. The verdict depends on text, language and source alone, so their hash is the key."""
    key = lambda df: {f"key{k}": F.xxhash64(F.lit(k), df[text_col], df[lang_col], df[source_col]) for k in (1, 2)}
    bad = judge(docs, key(docs), text_col, lang_col, source_col).where(~F.col("kept")).select("key1", "key2").distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in key(docs).items()])
    return rows.join(cut(bad), ["key1", "key2"], "left_anti").select("row.*")
