"""The grouped report: content verdicts applied and groups formed anew, projections of what has no match, node classes, labels, crumbs, summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import first_given
from .cascade import ancestors, descendants_of
from .diff import RANKS, worst
from .report import content_or_layout, label, proportion_error, text_divergence

#: Attributes that only repeat addresses, score classes by their least score, shown crumbs.
URL_NOISE = ["attr:href", "attr:src", "attr:srcset", "attr:action", "attr:data-href", "attr:data-url", "attr:data-link", "attr:data-src", "attr:formaction"]
SCORE_CLASSES = [(90, "score-great"), (70, "score-good"), (50, "score-warn"), (0, "score-bad")]
CRUMBS, LAST_CRUMBS, ELLIPSIS = 5, 3, "…"
# End of fixed values.


def rank(severity: Column) -> Column:
    """1 for the worst; what has no severity ranks last."""
    found = F.array_position(F.array(*[F.lit(r) for r in RANKS]), severity)
    return F.when(found > 0, found).otherwise(len(RANKS))


def apply_content(diffs: DataFrame, texts: DataFrame, items: DataFrame) -> DataFrame:
    """The diffs of the items' elements with ``action``, ``severity`` anew and ``label``: a width or height whose change the text explains weighs less.

    ``texts`` has pair_id, b_ord, base_text and compare_text; ``items`` has pair_id, b_ord and recurrence. Elements whose texts are empty or equal stay.
    """
    d = diffs.join(items.select("pair_id", "b_ord", "recurrence"), ["pair_id", "b_ord"]).join(texts, ["pair_id", "b_ord"], "left")
    a, b = (F.trim(F.coalesce(c, F.lit(""))) for c in ("base_text", "compare_text"))
    asked = F.col("property").isin("width", "height") & (a != "") & (b != "") & (a != b)
    measured = F.when(asked, F.struct(text_divergence(a, b).alias("d"), proportion_error(a, b, F.col("base_value"), F.col("compare_value"))["error"].alias("e")))
    d = d.select("*", F.inline(F.array(F.struct(measured.alias("m")))))  # a column of its own, which the verdict reads many times
    verdict = F.when(F.col("m").isNotNull(), content_or_layout(F.col("m.d"), F.col("m.e"), F.col("recurrence"), F.col("severity")))
    d = d.withColumn("verdict", verdict)
    return d.select(*[c for c in diffs.columns if c != "severity"], F.coalesce("verdict.severity", "severity").alias("severity"), F.col("verdict.action").alias("action"), F.col("verdict.label").alias("label"))


def rebucketed(items: DataFrame, judged: DataFrame) -> DataFrame:
    """The items with the severity that their judged diffs leave them (never a worse one), a content label, and their place in their group.

    An item is relabelled if all its width and height diffs are; groups are ordered by diffs, most first.
    """
    sized = F.col("property").isin("width", "height")
    of = judged.groupBy("pair_id", "b_ord").agg(worst(F.collect_set("severity")).alias("now"), F.bool_and(F.when(sized, F.coalesce(F.col("label") == "CONTENT DIVERGENCE", F.lit(False)))).alias("all_content"))
    joined = items.join(of, ["pair_id", "b_ord"], "left")
    falls = F.coalesce(rank(F.col("now")) > rank(F.col("severity")), F.lit(False))
    joined = joined.select(*[c for c in items.columns if c != "severity"], F.when(falls, F.col("now")).otherwise(F.col("severity")).alias("severity"), (falls & F.coalesce("all_content", F.lit(False))).alias("content"))
    place = F.row_number().over(Window.partitionBy("pair_id", "severity").orderBy(F.desc("total"), "b_ord"))
    return joined.withColumn("place", place.cast("long"))


def by_category(diffs: DataFrame) -> DataFrame:
    """pair_id, b_ord, groups: category -> its diffs, worst first, those of one severity by property."""
    one = F.struct(rank(F.col("severity")).alias("rank"), "property", "base_value", "compare_value", "severity")
    each = diffs.groupBy("pair_id", "b_ord", F.coalesce(F.nullif("category", F.lit("")), F.lit("other")).alias("category")).agg(F.sort_array(F.collect_list(one)).alias("diffs"))
    return each.groupBy("pair_id", "b_ord").agg(F.map_from_entries(F.collect_list(F.struct("category", "diffs"))).alias("groups"))


def property_diffs(items: DataFrame) -> DataFrame:
    """pair_id, property_diffs: diffs of all items after merging."""
    return items.groupBy("pair_id").agg(F.sum("total").alias("property_diffs"))


def root_breakdown(per_element: DataFrame, paths: DataFrame) -> DataFrame:
    """Changed elements by worst severity, without those whose parent has changed too."""
    changed = per_element.join(paths.select("pair_id", "b_ord", "hpid"), ["pair_id", "b_ord"]).where(F.coalesce("hpid", F.lit("")) != "")
    above = changed.select("pair_id", F.col("hpid").alias("parent")).distinct()
    roots = changed.withColumn("parent", F.when(F.col("hpid").contains("."), F.regexp_replace("hpid", r"\.[^.]*$", "")).otherwise("")).join(above, ["pair_id", "parent"], "left_anti")
    return roots.groupBy("pair_id").agg(*[F.count_if(F.col("overall") == r).alias(r) for r in RANKS])


def reconciled(summary: DataFrame, items: DataFrame) -> DataFrame:
    """The summary with root causes, children that items stand for, and an error where the numbers contradict each other.

    ``summary`` has matched, unchanged and modified; items by severity must add up to the root causes, and these with children and unchanged elements to the matches.
    """
    roots = items.groupBy("pair_id").agg(F.count("*").alias("root_causes"), *[F.count_if(F.col("severity") == r).alias(f"{r}_items") for r in RANKS])
    joined = summary.select("pair_id", "matched", "unchanged", "modified").join(roots, "pair_id", "left").na.fill(0)
    joined = joined.withColumn("suppressed_children", F.col("modified") - F.col("root_causes"))
    adds_up = (sum((F.col(f"{r}_items") for r in RANKS), F.lit(0)) == F.col("root_causes")) & (F.col("root_causes") + F.col("suppressed_children") + F.col("unchanged") == F.col("matched"))
    checked = F.when(adds_up, F.col("root_causes")).otherwise(F.raise_error(F.lit("the report's counts contradict each other")).cast("long"))
    return joined.select("pair_id", "matched", "unchanged", F.col("modified").alias("modified_before"), checked.alias("modified"), "suppressed_children")


def unmatched_group(unmatched: DataFrame, elements: DataFrame, status: str) -> DataFrame:
    """Added or removed elements (pair_id, ord) as rows of the report."""
    e = elements.select("pair_id", "ord", label(F.col("tag_name"), F.col("element_id"), F.col("class_name")).alias("element_key"), "tag_name", "element_id", "class_name", "hpid", "absolute_hpid", "css_selector", "xpath", "text_content")
    return unmatched.select("pair_id", "ord").join(e, ["pair_id", "ord"]).withColumn("status", F.lit(status))


def ambiguous_group(ambiguous: DataFrame, elements: DataFrame) -> DataFrame:
    """Elements with several candidates as rows of the report: label, breadcrumb, the number of candidates, the first of them."""
    own = label(F.col("tag_name"), F.col("element_id"), F.col("class_name"))
    e = elements.select("pair_id", F.col("ord").alias("b_ord"), own.alias("element_key"), first_given(F.col("css_selector"), F.col("xpath"), own).alias("breadcrumb"), "tag_name")
    a = ambiguous.select("pair_id", "b_ord", F.size("candidates").cast("long").alias("candidates"), F.array_min("candidates").alias("first"), "confidence", "strategy")
    return a.join(e, ["pair_id", "b_ord"])


def diff_descendants(nodes: DataFrame, changed: DataFrame) -> DataFrame:
    """pair_id, hpid, descendants, severe: of every node the changed elements under it, and whether one of them is critical or high (``severity`` in ``changed``)."""
    under = descendants_of(changed, nodes).join(changed, ["pair_id", "hpid"]).groupBy("pair_id", F.col("ancestor").alias("hpid")).agg(F.count("*").alias("descendants"), F.bool_or(F.col("severity").isin("critical", "high")).alias("severe"))
    joined = nodes.select("pair_id", "hpid").join(under, ["pair_id", "hpid"], "left")
    return joined.select("pair_id", "hpid", F.coalesce("descendants", F.lit(0)).alias("descendants"), F.coalesce("severe", F.lit(False)).alias("severe"))


def node_classes(nodes: DataFrame, changed: DataFrame, added: DataFrame, removed: DataFrame, apexes: DataFrame) -> DataFrame:
    """pair_id, hpid, type: inserted, deleted, changed (as an apex of others or in detail) or only structure. All tables have pair_id and hpid."""
    tables = {"node": nodes, "changed": changed, "added": added, "removed": removed, "apex": apexes}
    rows = reduce(DataFrame.unionByName, [t.select("pair_id", "hpid", F.lit(name).alias("of")) for name, t in tables.items()])
    has = lambda name: F.bool_or(F.col("of") == name)
    marked = rows.groupBy("pair_id", "hpid").agg(F.count_if(F.col("of") == "node").cast("int").alias("n"), *[has(name).alias(f"is_{name}") for name in tables if name != "node"])
    kind = F.when(F.col("is_added"), "DOM_INSERTION").when(F.col("is_removed"), "DOM_DELETION").when(F.col("is_changed") & F.col("is_apex"), "DIFF_APEX").when(F.col("is_changed"), "DIFF_DETAIL").otherwise("STRUCTURAL")
    kind = F.when(F.col("pair_id").isNull() | F.col("hpid").isNull(), "STRUCTURAL").otherwise(kind)  # what has no path is marked by nothing
    return marked.select("pair_id", "hpid", F.explode(F.array_repeat(kind, F.col("n"))).alias("type"))


def score_class(score: Column) -> Column:
    out = F.lit(SCORE_CLASSES[-1][1])
    for least, name in reversed(SCORE_CLASSES[:-1]):
        out = F.when(score >= least, name).otherwise(out)
    return out


def shares(layout: Column, style: Column, content: Column, dom: Column) -> Column:
    """struct of whole percentages; the last takes what rounding leaves."""
    total = layout + style + content + dom
    part = lambda n: F.floor(n / F.when(total == 0, 1).otherwise(total) * 100 + 0.5)
    return F.struct(part(layout).alias("layout"), part(style).alias("style"), part(content).alias("content"), F.greatest(F.lit(0), 100 - part(layout) - part(style) - part(content)).alias("dom"))


def recurrences(items: DataFrame, *more: str) -> DataFrame:
    """pair_id, b_ord, hpid, instance: every path of a merged item, the representative first, with more columns of the item."""
    return items.select("pair_id", "b_ord", *more, F.posexplode(F.split("hpids", ",")).alias("at", "hpid")).select("pair_id", "b_ord", "hpid", (F.col("at") + 1).cast("long").alias("instance"), *more)


def labels(items: DataFrame, elements: DataFrame) -> DataFrame:
    """pair_id, hpid, label: an item's for its paths, else the element's own."""
    of_items = recurrences(items, "label").groupBy("pair_id", "hpid").agg(F.min_by("label", F.struct("instance", "b_ord")).alias("given"))
    own = elements.groupBy("pair_id", "hpid").agg(F.min_by(label(F.col("tag_name"), F.col("element_id"), F.col("class_name")), "ord").alias("own"))
    return own.join(of_items, ["pair_id", "hpid"], "left").select("pair_id", "hpid", F.coalesce("given", "own").alias("label"))


def crumbs(nodes: DataFrame, labelled: DataFrame, changed: DataFrame) -> DataFrame:
    """pair_id, hpid, crumbs: the way to a node, each step (label, has_diff); of a long way the first, an ellipsis and the last ones.

    Steps without a label show their path.
    """
    steps = nodes.select("pair_id", "hpid", F.posexplode(F.concat(ancestors(F.col("hpid")), F.array("hpid"))).alias("at", "step"))
    known = labelled.select("pair_id", F.col("hpid").alias("step"), "label")
    marked = changed.select("pair_id", F.col("hpid").alias("step"), F.lit(True).alias("marked")).distinct()
    joined = steps.join(known, ["pair_id", "step"], "left").join(marked, ["pair_id", "step"], "left")
    one = F.struct(F.coalesce("label", "step").alias("label"), F.coalesce("marked", F.lit(False)).alias("has_diff"))
    whole = joined.groupBy("pair_id", "hpid").agg(F.sort_array(F.collect_list(F.struct("at", one.alias("crumb"))))["crumb"].alias("crumbs"))
    n, gap = F.size("crumbs"), F.array(F.struct(F.lit(ELLIPSIS).alias("label"), F.lit(False).alias("has_diff")))
    short = F.concat(F.slice("crumbs", 1, 1), gap, F.slice("crumbs", -LAST_CRUMBS, LAST_CRUMBS))
    return whole.select("pair_id", "hpid", F.when(n > CRUMBS, short).otherwise(F.col("crumbs")).alias("crumbs"))


def document_order(hpid: Column) -> Column:
    """A path as numbers, which sort as the document does; a part that is no number counts 0."""
    return F.transform(F.split(hpid, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)))


def shown(diffs: DataFrame, elements: DataFrame, severity: str | None = None, categories: list[str] | None = None, text: str | None = None) -> DataFrame:
    """The diffs of a severity, of some categories, of elements whose label contains a text (any case), without address noise."""
    named = elements.select("pair_id", F.col("ord").alias("b_ord"), label(F.col("tag_name"), F.col("element_id"), F.col("class_name")).alias("label"))
    d = diffs.where(~F.col("property").isin(URL_NOISE))
    d = d.where(F.col("severity") == severity) if severity else d
    d = d.where(F.col("category").isin(categories)) if categories else d
    d = d.join(named, ["pair_id", "b_ord"])
    return d.where(F.lower("label").contains(text.lower())) if text else d
