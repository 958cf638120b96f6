"""The grouped report: items of one look merged, text against layout changes told apart, score, distribution, badges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import css
from .diff import RANKS, worst

#: Penalty of an item by severity, out of 100; patterns of properties that change the layout, sizes and places.
WEIGHTS = {"critical": 10.0, "high": 4.0, "medium": 1.5, "low": 0.3}
LAYOUT = "position|display|flex|grid|float|overflow|visibility|z-index"
SIZE = "^width$|^height$|max-width|min-width|^margin|^padding"
PLACE = "^top$|^left$|^right$|^bottom$|transform"
# End of fixed values.


def label(tag: Column, element_id: Column, class_name: Column, classes: int = 2) -> Column:
    """tag#id.class.class"""
    names = F.slice(F.filter(F.split(F.coalesce(class_name, F.lit("")), r"\s+"), lambda c: c != ""), 1, classes)
    ident = F.when(F.coalesce(element_id, F.lit("")) != "", F.concat(F.lit("#"), element_id)).otherwise("")
    return F.concat(tag, ident, F.array_join(F.transform(names, lambda c: F.concat(F.lit("."), c)), ""))


def items(diffs: DataFrame, elements: DataFrame) -> DataFrame:
    """One row per changed element: its label, path, worst severity, properties and a signature of its diffs."""
    one = F.concat_ws("\x02", "property", F.coalesce("base_value", F.lit("-")), F.coalesce("compare_value", F.lit("-")))
    grouped = diffs.groupBy("pair_id", "b_ord").agg(
        worst(F.collect_set("severity")).alias("severity"),
        F.count("*").alias("total"),
        F.sort_array(F.collect_set("property")).alias("properties"),
        F.md5(F.array_join(F.sort_array(F.collect_list(one)), "\x01")).alias("signature"),
    )
    named = elements.select("pair_id", F.col("ord").alias("b_ord"), "hpid", label(F.col("tag_name"), F.col("element_id"), F.col("class_name")).alias("label"))
    return grouped.join(named, ["pair_id", "b_ord"])


def merged(all_items: DataFrame) -> DataFrame:
    """Items with one label and one signature become the first of them, with a count and all paths."""
    w = F.sort_array(F.collect_list(F.struct("b_ord", "hpid")))
    grouped = all_items.groupBy("pair_id", "severity", "label", "signature").agg(F.min("b_ord").alias("b_ord"), F.count("*").alias("recurrence"), w.alias("found"), F.first("total").alias("total"), F.first("properties").alias("properties"))
    return grouped.select("pair_id", "severity", "label", "b_ord", "recurrence", F.array_join("found.hpid", ",").alias("hpids"), "total", "properties")


def badge(properties: Column, content: Column | None = None) -> Column:
    has = lambda pattern: F.exists(properties, lambda p: p.rlike(pattern))
    out = F.when(has(LAYOUT) | has(SIZE), "LAYOUT SHIFT").when(has(PLACE), "POSITION DRIFT").otherwise("STYLE REGRESSION")
    return out if content is None else F.when(content, "CONTENT DIVERGENCE").otherwise(out)


def narrative_badge(hpid: Column, severity: Column, properties: Column, content: Column) -> Column:
    """The badge of a tree node: of a pseudo-element, of a change of content, of an inserted or deleted element, else of its properties."""
    pseudo = hpid.contains("::before") | hpid.contains("::after")
    whole = F.when(severity == "added", "DOM INSERTION").when(severity == "removed", "DOM DELETION").otherwise(badge(F.coalesce(properties, F.array().cast("array<string>"))))
    return F.when(pseudo, "PSEUDO").when(F.coalesce(content, F.lit(False)), "CONTENT DIVERGENCE").otherwise(whole)


def score(report: DataFrame) -> DataFrame:
    """pair_id, items by severity, penalty, impact_score (100 for no change), and items by kind of change."""
    counts = [F.count_if(F.col("severity") == r).alias(r) for r in RANKS]
    kinds = [F.count_if(badge(F.col("properties")) == "LAYOUT SHIFT").alias("layout"), F.count_if(badge(F.col("properties")) != "LAYOUT SHIFT").alias("style")]
    found = report.groupBy("pair_id").agg(*counts, *kinds)
    tenths = sum((F.col(r) * int(WEIGHTS[r] * 10) for r in RANKS), F.lit(0))
    return found.select("*", (tenths / 10).alias("penalty"), F.greatest(F.lit(0), F.floor((1 - tenths / 1000) * 100 + 0.5)).cast("long").alias("impact_score"))


def top(report: DataFrame, n: int = 3) -> DataFrame:
    """The items with most diffs of each pair."""
    w = Window.partitionBy("pair_id").orderBy(F.desc("total"), "b_ord")
    return report.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def distribution(items: DataFrame, unmatched: DataFrame) -> DataFrame:
    """pair_id, layout, style, content, dom: items by kind of change (``content`` marks those that a text explains), and elements without a match."""
    of = badge(F.col("properties"), F.col("content"))
    kinds = items.groupBy("pair_id").agg(
        F.count_if(of == "LAYOUT SHIFT").alias("layout"), F.count_if(of.isin("POSITION DRIFT", "STYLE REGRESSION")).alias("style"), F.count_if(of == "CONTENT DIVERGENCE").alias("content")
    )
    return kinds.join(unmatched.groupBy("pair_id").agg(F.count("*").alias("dom")), "pair_id", "full").na.fill(0)


def top_apexes(items: DataFrame, n: int = 3) -> DataFrame:
    """The apexes (``is_apex``) that stand for most suppressed diffs of each pair; a pair without any gives the items with most diffs."""
    any_apex = F.max("is_apex").over(Window.partitionBy("pair_id"))
    weight = F.when(F.col("any_apex"), F.col("suppressed")).otherwise(F.col("total"))
    rows = items.withColumn("any_apex", any_apex).where(F.col("is_apex") | ~F.col("any_apex"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("pair_id").orderBy(F.desc(weight), "b_ord")))
    return ranked.where(F.col("rank") <= n).drop("any_apex")


def text_divergence(a: Column, b: Column) -> Column:
    """0 for equal texts to 1; numbers and very short texts weigh less. The whole texts count, where the reference reads their first 500 characters."""
    x, y = (F.trim(F.coalesce(c, F.lit(""))) for c in (a, b))
    size = F.greatest(F.length(x), F.length(y))
    numeric = r"^[\d,.$%\s()\-+]+$"
    ratio = F.levenshtein(x, y) / size
    ratio = F.when(x.rlike(numeric) & y.rlike(numeric), F.least(ratio, F.lit(0.2))).otherwise(ratio)
    return F.when(size == 0, 0.0).otherwise(F.least(F.when(size < 8, ratio * 0.3).otherwise(ratio), F.lit(1.0)))


def proportion_error(base_text: Column, compare_text: Column, base_value: Column, compare_value: Column) -> Column:
    """struct(error, signal): how badly a size change fits the change of the text's length."""
    p, q = css.leading_number(base_value), css.leading_number(compare_value)
    m, n = (F.length(F.trim(F.coalesce(t, F.lit("")))) for t in (base_text, compare_text))
    grew, ratio, size = n >= m, F.least(n / m, F.lit(4.0)), q / p
    turned = grew != (q >= p)
    error = F.least(F.abs(ratio - size) / F.greatest(ratio, F.abs(size), F.lit(1.0)), F.lit(1.0))
    error = F.when(turned, F.least(error + 0.35, F.lit(1.0))).otherwise(error)
    signal = (
        F.when(p.isNull() | q.isNull(), "UNPARSEABLE").when(p == 0, "ZERO_BASELINE").when(m == 0, "NO_BASELINE_TEXT")
        .when(turned, "DIRECTION_MISMATCH").when(error < 0.2, "PROPORTIONAL").when(error > 0.65, "DISPROPORTIONAL").otherwise("AMBIGUOUS")
    )
    return F.struct(F.when(signal.isin("UNPARSEABLE", "ZERO_BASELINE", "NO_BASELINE_TEXT"), 0.5).otherwise(error).alias("error"), signal.alias("signal"))


def content_or_layout(divergence: Column, error: Column, recurrence: Column, severity: Column) -> Column:
    """struct(action, severity, label) of a width or height diff: a text that changed explains it, or the layout did. Severity never rises."""
    by_count = lambda one, few, many: F.when(recurrence == 1, one).when(recurrence <= 3, few).otherwise(many)
    content = divergence * 0.5 + (1 - error) * 0.3 + by_count(0.2, 0.05, 0.0)
    layout = (1 - divergence) * 0.4 + error * 0.35 + by_count(0.0, 0.05, 0.2)
    action = F.when(content >= 0.65, "DEMOTE").when((content >= 0.45) & (content > layout), "SOFT_DEMOTE").when(layout >= 0.65, "RETAIN").otherwise("SOFT_DEMOTE")
    target = F.when(action == "DEMOTE", "low").when(action == "SOFT_DEMOTE", "medium").otherwise(severity)
    rank = lambda s: F.array_position(F.array(*[F.lit(r) for r in RANKS]), s)
    rises = rank(target) < rank(severity)
    return F.struct(
        F.when(rises, "RETAIN").otherwise(action).alias("action"),
        F.when(rises, severity).otherwise(target).alias("severity"),
        F.when(action != "RETAIN", "CONTENT DIVERGENCE").alias("label"),
    )


def csv_field(value: Column) -> Column:
    """A text as a CSV field: formulas defused, quoted where it must be; null is empty."""
    safe = F.when(value.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), value)).otherwise(value)
    quoted = F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.coalesce(F.when(safe.rlike('[,"\n\r]'), quoted).otherwise(safe), F.lit(""))


def short_list(diffs: DataFrame, elements: DataFrame, n: int = 200) -> DataFrame:
    """The first ``n`` changed elements of each pair: tag, selector (80 characters), changed properties."""
    props = diffs.groupBy("pair_id", "b_ord").agg(F.array_join(F.sort_array(F.collect_set("property")), ", ").alias("changed"))
    named = elements.select("pair_id", F.col("ord").alias("b_ord"), "tag_name", F.substring("css_selector", 1, 80).alias("selector"))
    rank = F.row_number().over(Window.partitionBy("pair_id").orderBy("b_ord"))
    return props.join(named, ["pair_id", "b_ord"]).withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")
