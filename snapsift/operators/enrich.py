"""What an element's surroundings tell: section by semantics, child types, class hierarchy; mutations and signs of loading."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cascade import ancestors

# Names of page sections, patterns of unstable values, names of noise and of unfinished parts.
SECTION_TAGS = {"header": "header", "main": "main", "footer": "footer", "nav": "header", "aside": "main"}
SECTION_ROLES = {"banner": "header", "main": "main", "contentinfo": "footer", "navigation": "header", "complementary": "main"}
HEADER_CLASS = r"(?i)(^|[^a-z])(header|top|navbar|masthead)([^a-z]|$)"
FOOTER_CLASS = r"(?i)(^|[^a-z])(footer|bottom|copyright)([^a-z]|$)"
UNSTABLE_VALUES = [r"^[0-9]{8,}$", r"(?i)^[a-f0-9]{8}-[a-f0-9]{4}", r"(?i)data-aura-rendered", r"(?i)^ember\d+$", r"(?i)^react\d+$", r"^\d{13}$", r"(?i)^tt-for-\d+$", r"(?i)^[0-9]+:[0-9]+;[a-z]$", r"-\d+-\d+$"]
NOISE_TAGS = ["atomic-", "coveo-", "dyn-", "gtm-", "analytics-", "beacon-"]
NOISE_ATTRIBUTES = ["data-analytics", "data-tracking", "data-gtm", "data-layer", "aria-live"]
NOISE_CLASSES = ["analytics", "tracking", "beacon", "telemetry", "coveo", "atomic"]
UNFINISHED = ["skeleton", "shimmer", "placeholder", "loading", "spinner"]
# End of fixed values.


def stable_value(value: Column) -> Column:
    return F.coalesce(F.length(value).between(1, 200) & reduce(lambda a, b: a & b, [~value.rlike(p) for p in UNSTABLE_VALUES]), F.lit(False))


def _own_section(tag: Column, role: Column, class_name: Column, element_id: Column) -> Column:
    """The section that an element names itself: landmarks in a fixed order, then its class and id."""
    out = F.lit(None).cast("string")
    words = F.concat_ws(" ", class_name, element_id)
    for pattern, section in ((FOOTER_CLASS, "footer"), (HEADER_CLASS, "header")):
        out = F.when(words.rlike(pattern), section).otherwise(out)
    for (name, section), landmark in reversed(list(zip(SECTION_TAGS.items(), SECTION_ROLES, strict=True))):
        out = F.when((tag == name) | F.coalesce(role == landmark, F.lit(False)), section).otherwise(out)
    return F.when(~tag.isin("html", "body"), out)


def section_by_semantics(elements: DataFrame) -> DataFrame:
    """pair_id, ord, section: what the element or its nearest ancestor that names a section says; null for none."""
    own = elements.select("pair_id", "ord", "hpid", _own_section(F.col("tag_name"), F.col("attributes")["role"], F.col("class_name"), F.col("element_id")).alias("own"))
    named = own.where("own is not null").select("pair_id", F.col("hpid").alias("up"), F.col("own").alias("theirs"))
    asks = own.select("pair_id", "ord", "own", F.explode(F.concat(ancestors(F.col("hpid")), F.array("hpid"))).alias("up"))
    found = asks.join(named, ["pair_id", "up"], "left")
    nearest = F.max_by(F.col("theirs"), F.when(F.col("theirs").isNotNull(), F.size(F.split("up", r"\."))))
    return found.groupBy("pair_id", "ord").agg(nearest.alias("section"))


def child_types(elements: DataFrame, most: int = 10) -> DataFrame:
    """pair_id, hpid, children, types: of each parent path the number of children and tag(n), in the order first seen."""
    parent = F.when(F.col("hpid").contains("."), F.regexp_replace("hpid", r"\.[^.]*$", ""))
    counts = elements.select("pair_id", "ord", "tag_name", parent.alias("hpid")).where("hpid is not null").groupBy("pair_id", "hpid", "tag_name").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    text = F.when(F.col("n") > 1, F.concat("tag_name", F.lit("("), F.col("n").cast("string"), F.lit(")"))).otherwise(F.col("tag_name"))
    found = counts.groupBy("pair_id", "hpid").agg(F.sum("n").alias("children"), F.sort_array(F.collect_list(F.struct("first", text.alias("text")))).alias("found"))
    return found.select("pair_id", "hpid", "children", F.slice("found.text", 1, most).alias("types"))


def class_hierarchy(elements: DataFrame, depth: int = 3, count: int = 10, classes: int = 2) -> DataFrame:
    """pair_id, hpid, parents, children: classes of the nearest ancestors and of the first children, as (tag, classes)."""
    names = F.filter(F.split(F.coalesce("class_name", F.lit("")), r"\s+"), lambda c: c != "")
    own = elements.select("pair_id", "ord", "hpid", F.struct(F.col("tag_name").alias("tag"), F.slice(names, 1, classes).alias("classes")).alias("own"))
    classed = own.where(F.size("own.classes") > 0)
    up = own.select("pair_id", "hpid", F.posexplode(F.slice(F.reverse(ancestors(F.col("hpid"))), 1, depth)).alias("level", "up"))
    parents = up.join(classed.select("pair_id", F.col("hpid").alias("up"), "own"), ["pair_id", "up"]).groupBy("pair_id", "hpid").agg(F.sort_array(F.collect_list(F.struct("level", "own")))["own"].alias("parents"))
    parent = F.regexp_replace("hpid", r"\.[^.]*$", "")
    rank = F.row_number().over(Window.partitionBy("pair_id", "parent").orderBy("ord"))
    kids = classed.where(F.col("hpid").contains(".")).select("pair_id", "ord", "own", parent.alias("parent")).withColumn("rank", rank).where(F.col("rank") <= count)
    children = kids.groupBy("pair_id", F.col("parent").alias("hpid")).agg(F.sort_array(F.collect_list(F.struct("rank", "own")))["own"].alias("children"))
    none = F.array().cast("array<struct<tag:string,classes:array<string>>>")
    return own.select("pair_id", "hpid").join(parents, ["pair_id", "hpid"], "left").join(children, ["pair_id", "hpid"], "left").select("pair_id", "hpid", F.coalesce("parents", none).alias("parents"), F.coalesce("children", none).alias("children"))


def visual_mutation(tag: Column, kind: Column, attribute: Column, class_name: Column) -> Column:
    """Whether a mutation changes what is seen: not those of measuring tags, attributes and classes."""
    starts = reduce(lambda a, b: a | b, [F.lower(tag).startswith(p) for p in NOISE_TAGS])
    named = (kind == "attributes") & attribute.isin(NOISE_ATTRIBUTES)
    marked = (kind == "attributes") & (attribute == "class") & reduce(lambda a, b: a | b, [F.lower(class_name).contains(p) for p in NOISE_CLASSES])
    yes = lambda c: F.coalesce(c, F.lit(False))
    return ~(yes(starts) | yes(named) | yes(marked))


def document_ready(elements: DataFrame, viewport_width: int, viewport_height: int) -> DataFrame:
    """pair_id, ready: no part still loading, no unfinished image of some size in the viewport (``complete`` tells a finished one)."""
    loading = reduce(lambda a, b: a | b, [F.coalesce(F.col("class_name"), F.lit("")).contains(w) for w in UNFINISHED])
    r = F.col("rect")
    shows = ((r["width"] > 0) | (r["height"] > 0)) & (r["y"] + r["height"] >= 0) & (r["y"] <= viewport_height) & (r["x"] + r["width"] >= 0) & (r["x"] <= viewport_width)
    waits = (F.col("tag_name") == "img") & ~F.col("complete") & shows
    return elements.groupBy("pair_id").agg((~F.bool_or(F.coalesce(loading | waits, F.lit(False)))).alias("ready"))
