"""URL pre-flight: whether two page addresses show the same view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACKING = "(?i)^(utm_.*|gclid|gad_source|fbclid|msclkid|_ga|_gl)$"


def path(url: Column) -> Column:
    """Lower case, without one trailing slash; the root is /."""
    plain = F.regexp_replace(F.lower(F.regexp_extract(url, "^[^:]+://[^/?#]*([^?#]*)", 1)), "/$", "")
    return F.when(plain == "", "/").otherwise(plain)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, "(#.+)$", 1)


def params(url: Column) -> Column:
    """(key, value) of every query parameter that tracks nobody, in the order given."""
    plain = lambda t: F.when(t.rlike("[%+]"), F.coalesce(F.try_url_decode(t), t)).otherwise(t)
    given = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")
    pairs = F.transform(given, lambda p: F.struct(plain(F.substring_index(p, "=", 1)).alias("key"), F.when(p.contains("="), plain(F.substr(p, F.instr(p, "=") + 1))).otherwise("").alias("value")))
    return F.filter(pairs, lambda p: ~p["key"].rlike(TRACKING))


def param_diffs(base: Column, comp: Column) -> Column:
    """(key, baseline, compare) of the parameters of two addresses that differ: a full outer join by key on the row itself.

    Of a key that the compared address repeats the last value counts; a key that the baseline repeats meets it once, its further values meet none.
    """
    b, c = params(base), params(comp)
    last = lambda key: F.try_element_at(F.filter(c, lambda p: p["key"] == key), F.lit(-1))["value"]
    keys = lambda entries: F.transform(entries, lambda p: p["key"])
    none = F.lit(None).cast("string")
    of = lambda key, x, y: F.struct(key.alias("key"), x.alias("baseline"), y.alias("compare"))
    mine = F.transform(b, lambda p, i: of(p["key"], p["value"], F.when(F.array_position(keys(b), p["key"]) == i + 1, last(p["key"]))))
    theirs = F.transform(F.array_except(keys(c), keys(b)), lambda key: of(key, none, last(key)))
    return F.concat(F.filter(mine, lambda d: ~d["baseline"].eqNullSafe(d["compare"])), theirs)


def valid(url: Column) -> Column:
    return F.coalesce(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.lit(False))


def compatibility(pairs: DataFrame, base: str, comp: str) -> DataFrame:
    """``pairs`` with ``classification``: COMPATIBLE, CAUTION (fragment or parameters differ) or INCOMPATIBLE (path differs, or no url), and what differs:
    ``path_delta`` and ``hash_delta`` (baseline, compare) and ``query_delta``. Hosts don't count."""
    a, b = F.col(base), F.col(comp)
    delta = lambda x, y: F.struct(x.alias("baseline"), y.alias("compare"))
    usable = valid(a) & valid(b)
    same_path = usable & (path(a) == path(b))
    found = pairs.withColumns({"query_delta": F.when(same_path, param_diffs(a, b)), "hash_delta": F.when(same_path & (fragment(a) != fragment(b)), delta(fragment(a), fragment(b)))})
    found = found.withColumn("path_delta", F.when(~usable, delta(a, b)).when(~same_path, delta(path(a), path(b))))
    verdict = F.when(F.col("path_delta").isNotNull(), "INCOMPATIBLE").when(F.col("hash_delta").isNotNull() | (F.size("query_delta") > 0), "CAUTION").otherwise("COMPATIBLE")
    return found.withColumn("classification", verdict)
