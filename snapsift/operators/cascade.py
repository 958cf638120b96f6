"""Hierarchy: ancestors by exploded path prefixes (never a theta join), inherited diffs, apex suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import css
from ..sources.tables import kept, parts_of
from .diff import DERIVED

# Properties that children inherit in the two passes, and boxes whose change moves their children.
INHERITED = (
    "color visibility font-size font-weight font-style font-family font-variant font-stretch line-height letter-spacing word-spacing text-align text-indent text-transform"
    " text-decoration white-space word-break overflow-wrap direction list-style-type list-style-position border-collapse border-spacing caption-side quotes tab-size orphans widows"
).split()
INHERITED_AT_APEX = "color font-family font-size font-weight font-style line-height letter-spacing text-align word-spacing visibility text-transform white-space".split()
PROPAGATED = "width height margin-top margin-right margin-bottom margin-left padding-top padding-right padding-bottom padding-left".split()
PROPAGATED_PX = 2
# End of fixed values.


def ancestors(hpid: Column) -> Column:
    """All proper prefixes of a dotted path, the root first."""
    parts = F.split(hpid, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))).otherwise(F.array().cast("array<string>"))


def descendants_of(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    """pair_id, ancestor, hpid, depth: every node under a marked node (columns pair_id, hpid), found by equality on prefixes."""
    up = nodes.select("pair_id", "hpid", F.posexplode(ancestors(F.col("hpid"))).alias("level", "ancestor"))
    return up.join(marked.select("pair_id", F.col("hpid").alias("ancestor")).distinct(), ["pair_id", "ancestor"]).select("pair_id", "ancestor", "hpid", (F.col("level") + 1).alias("depth"))


def nearest_ancestor(nodes: DataFrame, marked: DataFrame) -> DataFrame:
    return descendants_of(nodes, marked).groupBy("pair_id", "hpid").agg(F.max_by("ancestor", "depth").alias("ancestor"))


def inherited(diffs: DataFrame, paths: DataFrame) -> DataFrame:
    """The diffs with ``inherited`` and ``derived_from``: whether the first ancestor (in result order) with a diff of the property changed alike.

    ``paths`` gives pair_id, b_ord and hpid; result order is that of b_ord. Border colours also follow an ancestor's text colour. Every diff
    stands once under its own path and asks under each ancestor's, so one window over (path, property) answers all of them.
    """
    d = diffs.join(paths.select("pair_id", "b_ord", "hpid"), ["pair_id", "b_ord"])
    asks = F.when(F.col("property").isin(*INHERITED), F.array("property")).when(F.col("property").isin(*DERIVED), F.array(F.col("property"), F.lit("color"))).otherwise(F.array().cast("array<string>"))
    spot = lambda path, asked, asking: F.struct(path.alias("path"), asked.alias("asked"), F.lit(asking).alias("asking"))
    stands = F.array(spot(F.col("hpid"), F.col("property"), False), spot(F.lit(""), F.lit(""), True))  # the second keeps diffs that ask nobody
    asked = F.flatten(F.transform(asks, lambda p: F.transform(ancestors(F.col("hpid")), lambda up: spot(up, p, True))))
    row = F.struct(*[F.col(c) for c in d.columns]).alias("row")
    rows = d.select("pair_id", row, F.inline(F.concat(stands, asked)))
    own = F.when(~F.col("asking"), F.struct(F.col("row.b_ord").alias("at"), F.col("row.hpid").alias("path"), F.col("row.base_value").alias("a"), F.col("row.compare_value").alias("b")))
    theirs = F.when(F.col("asked") != "", F.min(own).over(Window.partitionBy("pair_id", "path", "asked")))
    rows = rows.withColumn("theirs", theirs).where("asking")
    same = F.col("asked") == F.col("row.property")
    first = rows.groupBy("pair_id", F.col("row.b_ord").alias("b_ord"), F.col("row.property").alias("property")).agg(
        F.first("row").alias("row"), F.min(F.when(same, F.col("theirs"))).alias("x"), F.min(F.when(~same, F.col("theirs"))).alias("y")
    )
    alike = lambda t: F.coalesce(F.col(f"{t}.a").eqNullSafe(F.col("row.base_value")) & F.col(f"{t}.b").eqNullSafe(F.col("row.compare_value")) & F.col(t).isNotNull(), F.lit(False))
    source = F.least(F.when(alike("x"), F.col("x.path")), F.when(alike("y"), F.col("y.path")))
    return first.select("row.*", (alike("x") | alike("y")).alias("inherited"), source.alias("derived_from"))


def _repeated(change: Column, apex: Column) -> Column:
    """Whether an apex's changes hold one that this change repeats: the same inherited property changed alike, or a box by about as much."""
    inherits = change["property"].isin(*INHERITED_AT_APEX)

    def repeats(theirs: Column) -> Column:
        alike = theirs["a"].eqNullSafe(change["a"]) & theirs["b"].eqNullSafe(change["b"])
        moved = change["property"].isin(*PROPAGATED) & (F.abs(theirs["delta"] - change["delta"]) <= PROPAGATED_PX)
        return (theirs["property"] == change["property"]) & F.coalesce(F.when(inherits, alike).otherwise(moved), F.lit(False))

    return F.exists(apex, repeats)


def apex_suppression(diffs: DataFrame, paths: DataFrame) -> DataFrame:
    """pair_id, b_ord, hpid, property, suppressed, apex: a diff that repeats its apex's change is suppressed there.

    An element's apex is its nearest ancestor with diffs, or that one's own apex if all of its diffs are suppressed there. So an apex follows from the
    changes of the ancestors alone, from the root down: every element folds the changes of its ancestors into the one that is left, and no element
    waits for another. Of changes of one property under one path the first element's counts.
    """
    delta = css.leading_number(F.col("compare_value")) - css.leading_number(F.col("base_value"))
    d = diffs.join(paths.select("pair_id", "b_ord", "hpid"), ["pair_id", "b_ord"])
    parts = parts_of(paths)
    d = kept(d.select("pair_id", "b_ord", "hpid", F.struct("property", F.col("base_value").alias("a"), F.col("compare_value").alias("b"), delta.alias("delta")).alias("change")), parts)
    firsts = d.groupBy("pair_id", "hpid", "change.property").agg(F.min_by("change", "b_ord").alias("change"))
    nodes = kept(firsts.groupBy("pair_id", "hpid").agg(F.sort_array(F.collect_list("change")).alias("changes")), parts)
    above = nodes.select("pair_id", "hpid", F.posexplode(ancestors(F.col("hpid"))).alias("level", "up")).join(nodes.select("pair_id", F.col("hpid").alias("up"), "changes"), ["pair_id", "up"])
    chains = above.groupBy("pair_id", "hpid").agg(F.sort_array(F.collect_list(F.struct("level", "up", "changes"))).alias("chain"))
    inherits = lambda x, apex: F.forall(x["changes"], lambda c: _repeated(c, apex["changes"]))
    apex = F.aggregate(F.slice("chain", F.lit(2), F.size("chain")), F.get("chain", 0), lambda apex, x: F.when(inherits(x, apex), apex).otherwise(x))
    apexes = chains.select("pair_id", "hpid", apex.alias("apex"))
    suppressed = F.coalesce(F.col("apex").isNotNull() & _repeated(F.col("change"), F.col("apex.changes")), F.lit(False))
    done = d.join(apexes, ["pair_id", "hpid"], "left").withColumn("suppressed", suppressed)
    return done.select("pair_id", "b_ord", "hpid", F.col("change.property").alias("property"), "suppressed", F.when(F.col("suppressed"), F.col("apex.up")).alias("apex"))


def apex_report(suppressed: DataFrame) -> DataFrame:
    """One row per apex: children and diffs that it took over, and their kind."""
    s = suppressed.where("suppressed")
    css_n, box_n = F.count_if(F.col("property").isin(*INHERITED_AT_APEX)), F.count_if(F.col("property").isin(*PROPAGATED))
    kind = F.when((css_n > 0) & (box_n > 0), "MIXED").when(css_n > 0, "CSS_INHERIT").otherwise("LAYOUT_FLOW")
    n = F.count_distinct("hpid")
    text = F.format_string("%d child element%s suppressed (%d CSS inherited · %d layout reflow)", n, F.when(n == 1, "").otherwise("s"), css_n, box_n)
    return s.groupBy("pair_id", "apex").agg(n.alias("children"), F.count("*").alias("suppressed_diffs"), kind.alias("kind"), text.alias("summary"))


def tree(nodes: DataFrame) -> DataFrame:
    """pair_id, hpid, parent, synthetic: the nodes with every missing ancestor."""
    own = nodes.select("pair_id", "hpid").distinct()
    above = own.select("pair_id", F.explode(ancestors(F.col("hpid"))).alias("hpid")).distinct()
    made = above.join(own, ["pair_id", "hpid"], "left_anti")
    both = own.withColumn("synthetic", F.lit(False)).unionByName(made.withColumn("synthetic", F.lit(True)))
    parent = F.when(F.col("hpid").contains("."), F.regexp_replace("hpid", r"\.[^.]*$", ""))
    return both.select("pair_id", "hpid", parent.alias("parent"), "synthetic")


def expanded(nodes: DataFrame, urgent: tuple[str, ...] = ("critical", "high")) -> DataFrame:
    """pair_id, hpid, synthetic, children, expand: the tree of ``nodes`` (pair_id, hpid, severity), where a node with children opens if anything in its subtree, itself included, is urgent.

    Urgency rolls up from the urgent nodes to all their prefixes at once, whatever the depth.
    """
    whole = tree(nodes)
    children = whole.where("parent is not null").groupBy("pair_id", F.col("parent").alias("hpid")).agg(F.count("*").alias("children"))
    up = nodes.where(F.col("severity").isin(*urgent)).select("pair_id", F.explode(F.array_append(ancestors(F.col("hpid")), F.col("hpid"))).alias("hpid")).distinct().withColumn("urgent", F.lit(True))
    joined = whole.join(children, ["pair_id", "hpid"], "left").join(up, ["pair_id", "hpid"], "left")
    return joined.select("pair_id", "hpid", "synthetic", F.coalesce("children", F.lit(0)).alias("children"), (F.col("children").isNotNull() & F.col("urgent").isNotNull()).alias("expand"))
