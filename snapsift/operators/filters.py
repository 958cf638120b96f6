"""Predicates and classifications of elements: visibility, class, id and tag expressions, stability, tiers, siblings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import IRRELEVANT_TAGS

# Patterns of generated identifiers, classes, values and texts; tags and roles of tiers.
DYNAMIC_IDS = [r"^\d+$", r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", r"\d{13,}$", r"^[a-f0-9]{32,}$", r"^(ember|react|vue|angular)\d+$", r"^uid-\d+$", r"^temp[-_]?\d+$", r"-\d{2,}$"]
DYNAMIC_CLASSES = [r"^Mui[A-Z]\w+-\w+-\d+$", r"^makeStyles-", r"^css-[a-z0-9]+$", r"^jss\d+$", r"^sc-[a-z]+-[a-z]+$", r"^emotion-\d+$", r"^lwc-[a-z0-9]+"]
FRAMEWORK = [r"^ng-", r"^_ngcontent", r"^_nghost", r"^v-", r"^data-v-[a-f0-9]+$", r"^jsx-", r"^data-reactid", r"^data-react-"]
DYNAMIC_TEXTS = [r"^\d+$", r"^[0-9]{8,}$", r"(?i)^[a-f0-9]{8}-[a-f0-9]{4}", r"^\d{1,2}:\d{2}", r"^\d{1,2}/\d{1,2}/\d{2,4}$", r"(?i)^loading", r"(?i)^processing", r"^\$\d+\.\d{2}$"]
TIER3_TAGS = "button input select textarea label a dialog details output meter progress option optgroup".split()
TIER3_ROLES = "button link checkbox radio textbox combobox listbox menuitem menuitemcheckbox menuitemradio option searchbox slider spinbutton switch tab treeitem gridcell".split()
TIER2_TAGS = (
    "p span h1 h2 h3 h4 h5 h6 img svg canvas video audio picture blockquote pre code strong em figure figcaption time address q mark ins del abbr cite dfn kbd samp var small sub sup dl dt dd iframe"
).split()
# End of fixed values.


def _none(value: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [~value.rlike(p) for p in patterns])


def stable_id(value: Column) -> Column:
    return F.coalesce(F.length(value).between(2, 200) & _none(value, DYNAMIC_IDS), F.lit(False))


def stable_class(value: Column) -> Column:
    return F.coalesce((F.trim(value) != "") & _none(F.trim(value), DYNAMIC_CLASSES), F.lit(False))


def static_text(value: Column) -> Column:
    return F.coalesce(F.length(value).between(2, 200) & _none(value, DYNAMIC_TEXTS), F.lit(False))


def own_attributes(attributes: Column) -> Column:
    """Without the attributes that frameworks write."""
    return F.map_filter(attributes, lambda k, _: _none(k, FRAMEWORK))


def visible(elements: DataFrame) -> DataFrame:
    """Elements that show: neither pruned by tag nor hidden by style, of some width and height."""
    s = F.col("styles")
    shows = ~F.col("tag_name").isin(*IRRELEVANT_TAGS) & (F.coalesce(s["display"], F.lit("")) != "none") & (F.coalesce(s["visibility"], F.lit("")) != "hidden")
    opaque = F.coalesce(s["opacity"].try_cast("double"), F.lit(1.0)) > 0
    return elements.where(shows & opaque & (F.col("rect.width") > 0) & (F.col("rect.height") > 0))


def first_elements(elements: DataFrame, n: int) -> DataFrame:
    """The first ``n`` elements of each report in document order (the extraction's own limit)."""
    return elements.withColumn("rn", F.row_number().over(Window.partitionBy("pair_id").orderBy("ord"))).where(F.col("rn") <= n).drop("rn")


def expression_filter(classes: str | None = None, ids: str | None = None, tags: str | None = None) -> Column:
    """'.a b, c' keeps elements with classes a and b, or with c; ids and tags are lists. Whichever of the three fits."""
    has = F.split(F.coalesce("class_name", F.lit("")), r"\s+")
    found = []
    for group in (classes or "").split(","):
        names = [n.lstrip(".") for n in group.replace(".", " .").split() if n.lstrip(".")]
        if names:
            found.append(reduce(lambda a, b: a & b, [F.array_contains(has, n) for n in names]))
    if wanted := [i.strip().lstrip("#") for i in (ids or "").split(",") if i.strip()]:
        found.append(F.coalesce(F.col("element_id").isin(*wanted), F.lit(False)))
    if wanted := (tags or "").replace(",", " ").lower().split():
        found.append(F.col("tag_name").isin(*wanted))
    return reduce(lambda a, b: a | b, found, F.lit(False)) if found else F.lit(True)


def top_roots(candidates: DataFrame) -> DataFrame:
    """Candidates (pair_id, hpid) without those under another candidate."""
    from .cascade import descendants_of

    inside = descendants_of(candidates, candidates).select("pair_id", "hpid").distinct()
    return candidates.join(inside, ["pair_id", "hpid"], "left_anti")


def rerooted(elements: DataFrame, candidates: DataFrame) -> DataFrame:
    """The elements of a filtered extraction: those at or below a top root among ``candidates`` (pair_id, ord, hpid), with ``hpid`` counted from it.

    Roots are numbered in document order and are the first part of the paths below them; ``absolute_hpid`` keeps the path in the document; ``depth`` is 0 at each
    root and does not count the borders of shadow roots (parts 0). An element's root is the one among its own path's prefixes.
    """
    from .cascade import ancestors

    number = F.row_number().over(Window.partitionBy("pair_id").orderBy("ord"))
    roots = top_roots(candidates).select("pair_id", F.col("hpid").alias("root"), number.alias("number"))
    kept = [c for c in elements.columns if c not in ("pair_id", "hpid", "absolute_hpid", "depth")]
    asks = elements.select("pair_id", *kept, F.col("hpid").alias("absolute_hpid"), F.explode(F.array_append(ancestors(F.col("hpid")), F.col("hpid"))).alias("root"))
    below = F.expr("substring(absolute_hpid, length(root) + 1)")
    levels = F.filter(F.split(below, r"\."), lambda p: (p != "") & (p != "0"))
    return asks.join(roots, ["pair_id", "root"]).select("pair_id", *kept, F.concat(F.col("number").cast("string"), below).alias("hpid"), "absolute_hpid", F.size(levels).alias("depth"))


def tier(tag: Column, role: Column | None = None) -> Column:
    by_role = F.coalesce(role.isin(*TIER3_ROLES), F.lit(False)) if role is not None else F.lit(False)
    return F.when(tag.isin(*IRRELEVANT_TAGS), "T0").when(tag.isin(*TIER3_TAGS) | by_role, "T3").when(tag.isin(*TIER2_TAGS), "T2").otherwise("T1")


def section_by_place(top: Column, document: Column, viewport: Column) -> Column:
    header = F.least(document * 0.20, viewport * 1.5)
    footer = document - F.least(document * 0.15, viewport * 1.0)
    return F.when(top < header, "header").when(top > footer, "footer").otherwise("main")


def class_key(class_name: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.coalesce(class_name, F.lit("")), r"\s+"), lambda c: c != "")), " ")


def class_occurrence(elements: DataFrame) -> DataFrame:
    """pair_id, ord, occurrences: elements of the report with the same set of classes, counted once per set and joined back."""
    keyed = elements.select("pair_id", "ord", class_key(F.col("class_name")).alias("key"))
    counts = keyed.groupBy("pair_id", "key").agg(F.count("*").alias("occurrences"))
    return keyed.join(counts, ["pair_id", "key"]).select("pair_id", "ord", F.when(F.col("key") == "", 0).otherwise(F.col("occurrences")).cast("long").alias("occurrences"))


def siblings(elements: DataFrame) -> DataFrame:
    """pair_id, ord, previous, next, nth, nth_of_type among the elements with the same parent path."""
    parent = F.regexp_replace("hpid", r"\.?[^.]*$", "")
    w = Window.partitionBy("pair_id", "parent").orderBy("ord")
    typed = Window.partitionBy("pair_id", "parent", "tag_name").orderBy("ord")
    return elements.select("pair_id", "ord", "tag_name", parent.alias("parent")).select(
        "pair_id", "ord", F.lag("tag_name").over(w).alias("previous"), F.lead("tag_name").over(w).alias("next"), F.row_number().over(w).cast("long").alias("nth"), F.row_number().over(typed).cast("long").alias("nth_of_type")
    )


def unique_selectors(elements: DataFrame, candidates: list[tuple[str, int, Column, Column]]) -> DataFrame:
    """pair_id, ord, strategy, robustness, selector: each element's best candidate that selects it alone.

    A candidate is a name, its robustness, the selector it would give (or null) and the traits that the selector asks for; elements are selected
    by their traits, whether they offer the same selector or not.
    """
    from ..config import ANCHOR_ATTRIBUTES
    from ..sources.tables import kept, parts_of
    from .uniqueness import own_traits, selected

    listed = F.filter(F.array(*[F.struct(F.lit(r).alias("robustness"), F.lit(n).alias("strategy"), c.alias("selector"), F.array_sort(asks).alias("asks")) for n, r, c, asks in candidates]), lambda o: o["selector"].isNotNull())
    parts = parts_of(elements)
    offers = kept(elements.select("pair_id", "ord", F.inline(listed)), parts)
    matches = selected(kept(elements.select("pair_id", "ord", own_traits(ANCHOR_ATTRIBUTES).alias("has")), parts), offers)
    alone = offers.join(matches.where("n = 1"), ["pair_id", "ord", "asks"])
    best = alone.groupBy("pair_id", "ord").agg(F.max(F.struct("robustness", "strategy", "selector")).alias("best"))
    return best.select("pair_id", "ord", "best.strategy", "best.robustness", "best.selector")


def css_candidates() -> list[tuple[str, int, Column, Column]]:
    """Identifier, test attribute, two classes, one class."""
    from ..config import ANCHOR_ATTRIBUTES

    classes = F.array_distinct(F.filter(F.split(F.coalesce("class_name", F.lit("")), r"\s+"), stable_class))
    ident = F.concat(F.lit("#"), "element_id")
    first = lambda make: F.coalesce(*[F.when(F.coalesce(F.col("attributes")[a], F.lit("")) != "", make(a, F.col("attributes")[a])) for a in ANCHOR_ATTRIBUTES])
    tests = first(lambda a, v: F.concat(F.lit(f'[{a}="'), v, F.lit('"]')))
    dotted = lambda n: F.when(F.size(classes) >= n, F.concat("tag_name", F.lit("."), F.array_join(F.slice(classes, 1, n), ".")))
    asks = lambda n: F.transform(F.slice(classes, 1, n), lambda c: F.concat("tag_name", F.lit("."), c))
    return [
        ("id", 100, F.when(stable_id(F.col("element_id")), ident), F.array(ident)),
        ("test-attribute", 91, tests, F.array(first(lambda a, v: F.concat(F.lit(f"@{a}="), v)))),
        ("two-classes", 72, dotted(2), asks(2)),
        ("one-class", 68, dotted(1), asks(1)),
    ]
