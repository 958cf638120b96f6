"""Diffs of matched elements: properties, text and attributes in one long table, with severities.

A pair's style maps are read name by name on their own row, so the full outer join of properties needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CATEGORIES, CRITICAL, HIGH, MEDIUM, Mode
from ..functions import css
from ..functions.once import made_once

RANKS = ["critical", "high", "medium", "low"]
#: Border colours that follow the text colour where none is given.
DERIVED = [f"border-{s}-color" for s in ("top", "right", "bottom", "left")]


def category(prop: Column) -> Column:
    return F.coalesce(css.lookup({p: name for name, members in reversed(CATEGORIES.items()) for p in members}, prop), F.lit("other"))


def with_facts(rows: DataFrame) -> DataFrame:
    """Adds what is known of a property: how its values are normalised (kind_of), its category and the severity it is listed with.

    The properties are a constant table of a few hundred rows, which every task looks up once for each row.
    """
    categories = {p: name for name, members in reversed(CATEGORIES.items()) for p in members}
    listed = {p: "medium" for p in MEDIUM} | {p: "high" for p in HIGH} | {p: "critical" for p in CRITICAL}
    names = sorted({*css.KINDS, *categories, *listed})
    table = rows.sparkSession.createDataFrame([(n, css.KINDS.get(n), categories.get(n), listed.get(n)) for n in names], "property string, kind_of string, group string, listed string")
    return rows.join(F.broadcast(table), "property", "left").withColumn("group", F.coalesce("group", F.lit("other")))


def _is_color() -> Column:
    return (F.col("group") == "visual") | F.col("property").contains("color")


def _is_size() -> Column:
    return F.col("group").isin("layout", "spacing", "position") | F.col("property").rlike("width|height|size")


def with_parsed(rows: DataFrame) -> DataFrame:
    """Adds the rule that a property's tolerance follows, and what the rules read many times of both values in a row (x and y), as far as the property asks for it: colours, px amounts and numbers."""
    rule = F.when(_is_color(), "color").when(_is_size(), "px").when(F.col("property") == "opacity", "num")
    one = lambda v: {"color": F.when(_is_color(), css.channels(v)), "px": F.when(_is_size(), css.parse_px(v)), "num": F.when(F.col("property") == "opacity", css.leading_number(v))}
    return made_once(rows, rule=rule, **{f"{n}_{part}": c for n, v in (("x", "base_value"), ("y", "compare_value")) for part, c in one(F.col(v)).items()})


PARSED = ["rule", *[f"{n}_{part}" for n in "xy" for part in ("color", "px", "num")]]


def _both(part: str) -> tuple[Column, Column]:
    return F.col(f"x_{part}"), F.col(f"y_{part}")


def within_tolerance(mode: Mode) -> Column:
    """Whether two different values (parsed) count as equal; the first rule that fits the property decides."""
    x, y = map(css.rgb, _both("color"))
    channels = (F.abs(x["r"] - y["r"]) <= mode.color) & (F.abs(x["g"] - y["g"]) <= mode.color) & (F.abs(x["b"] - y["b"]) <= mode.color)
    alpha = F.coalesce(F.abs(x["a"] - y["a"]) <= 0.01, F.lit(False))
    apart = lambda part: F.abs(_both(part)[0] - _both(part)[1])
    rule = F.col("rule")
    within = F.when(rule == "color", channels & alpha).when(rule == "px", apart("px") <= mode.size).when(rule == "num", apart("num") <= mode.opacity)
    return F.coalesce(within, F.lit(False))


def severity(prop: Column, a: Column, b: Column, cat: Column) -> Column:
    """Severity of a diff with facts and parsed values. The first rule that fits: listed as critical, breaking the layout, listed as high, of high visual impact, listed as medium, layout, low."""
    blocky = lambda v: v.isin("block", "flex", "grid", "inline-block")
    (pa, pb), (na, nb), (ca, cb) = _both("px"), _both("num"), map(css.rgb, _both("color"))
    share = F.when((pa != 0) & (pb != 0), F.abs(pb - pa) / pa)
    breaks = (
        F.when(prop == "display", (a == "none") | (b == "none") | (blocky(a) != blocky(b)))
        .when(prop == "position", a.isin("absolute", "fixed") | b.isin("absolute", "fixed"))
        .when(prop.isin("width", "height"), share > 0.5)
    )
    impact = (
        F.when(prop == "opacity", F.abs(na - nb) > 0.3)
        .when(prop.contains("color"), F.abs(css.luminance(ca) - css.luminance(cb)) > 0.4)
        .when(prop == "font-size", share > 0.25)
    )
    listed = F.col("listed")
    return (
        F.when(listed == "critical", "critical")
        .when(breaks, "critical")
        .when(listed == "high", "high")
        .when(impact, "high")
        .when((listed == "medium") | (cat == "layout"), "medium")
        .otherwise("low")
    )


def pair_up(matches: DataFrame, base: DataFrame, comp: DataFrame) -> DataFrame:
    """Matches with the elements of both sides as structs b and c."""
    side = lambda d, o, n: d.select("pair_id", F.col("ord").alias(o), F.struct(*d.columns).alias(n))
    return matches.join(side(base, "b_ord", "b"), ["pair_id", "b_ord"]).join(side(comp, "c_ord", "c"), ["pair_id", "c_ord"])


def paired(base: DataFrame, comp: DataFrame, on: list[str]) -> DataFrame:
    """Pairs (b_ord, c_ord, b, c) of elements with equal keys: a match and its elements in one join."""
    side = lambda d, o, n: d.select(*on, F.col("ord").alias(o), F.struct(*d.columns).alias(n))
    return side(base, "b_ord", "b").join(side(comp, "c_ord", "c"), on)


def _text(side: str) -> Column:
    return F.trim(F.coalesce(F.col(f"{side}.text_content"), F.lit("")))


def entries(pairs: DataFrame, mode: Mode) -> DataFrame:
    """pair_id, b_ord, c_ord, kind, property, a, b, own: the raw values of a pair that differ, of all kinds, out of one generator.

    The generator gives the names of both sides, and values are looked up and held against each other in the rows that it makes: Spark compiles that, and interprets lambdas over maps.
    ``own`` has the pair's text colours (a, b) where a border colour could only repeat them.
    """
    empty = F.array().cast("array<string>")
    sides = [(css.expand_shorthands(F.col(f"{s}.styles")).alias(f"{s}_styles"), F.col(f"{s}.attributes").alias(f"{s}_attributes"), _text(s).alias(f"{s}_text")) for s in "bc"]
    names = lambda part: F.array_union(*[F.coalesce(F.map_keys(f"{s}_{part}"), empty) for s in "bc"])
    rows = pairs.select("pair_id", "b_ord", "c_ord", *[c for side in sides for c in side]).withColumns({"style_names": names("styles"), "attribute_names": names("attributes")})
    rows = rows.withColumns({"styles_end": F.size("style_names"), "attributes_end": F.size("style_names") + F.size("attribute_names")})
    listed = F.concat("style_names", "attribute_names", F.array(F.lit("textContent")) if mode.text else empty)
    rows = rows.select(*[c for c in rows.columns if not c.endswith("_names")], F.posexplode(listed).alias("at", "property"))
    p, style, attribute = F.col("property"), F.col("at") < F.col("styles_end"), F.col("at") < F.col("attributes_end")
    value = lambda s: F.when(style, F.col(f"{s}_styles")[p]).when(attribute, F.col(f"{s}_attributes")[p]).otherwise(F.col(f"{s}_text"))
    known = lambda these: F.lit(True) if these is None else p.isin(*these)
    wanted = F.when(style, known(mode.properties)).when(attribute, known(mode.attributes)).otherwise(True)
    colors = F.struct(F.col("b_styles")["color"].alias("a"), F.col("c_styles")["color"].alias("b"))
    own = F.when(style & p.isin(*DERIVED), colors) if mode.properties is None or "color" in mode.properties else F.lit(None).cast("struct<a:string,b:string>")
    kind = F.when(style, "style").when(attribute, "attribute").otherwise("text")
    found = rows.select("pair_id", "b_ord", "c_ord", kind.alias("kind"), p, value("b").alias("a"), value("c").alias("b"), own.alias("own"), wanted.alias("wanted"))
    return found.where(F.col("wanted") & ~F.col("a").eqNullSafe(F.col("b"))).drop("wanted")


def compare_pairs(pairs: DataFrame, mode: Mode, three_state: bool = False) -> DataFrame:
    """All diffs of all pairs, each with its severity, in one pass; ``three_state`` tells added and removed attributes from modified ones.

    Border colours that repeat the text colour's own change are left out on the pair's own row: where both values are equal, one tolerance holds for both.
    """
    kind, p, a, b = F.col("kind"), F.col("property"), F.col("base_value"), F.col("compare_value")
    style = kind == "style"
    plain = lambda v: F.when(style, css.normalize(p, v, kind=F.col("kind_of"))).otherwise(v)
    facts = ["kind", "property", "kind_of", "group", "listed"]
    rows = with_facts(entries(pairs, mode)).select("pair_id", "b_ord", "c_ord", *facts, "own", "a", "b")
    rows = made_once(rows, base_value=plain(F.col("a")), compare_value=plain(F.col("b"))).drop("a", "b")
    state = F.when(a.isNull(), "added").when(b.isNull(), "removed").otherwise("modified")
    repeats = F.when(F.col("own").isNotNull(), css.normalize_color(F.col("own.a")).eqNullSafe(a) & css.normalize_color(F.col("own.b")).eqNullSafe(b)).otherwise(False)
    rows = with_parsed(rows.where(~a.eqNullSafe(b)).where(~repeats).drop("own"))
    rows = rows.where(~(style & a.isNotNull() & b.isNotNull() & within_tolerance(mode)))
    cat = F.when(style, F.col("group")).when(kind == "attribute", "attribute").otherwise("content")
    rows = rows.withColumns({"type": F.when(style | (F.lit(three_state) & (kind == "attribute")), state).otherwise("modified"), "category": cat, "property": F.when(kind == "attribute", F.concat(F.lit("attr:"), p)).otherwise(p), "listed": F.when(style, F.col("listed"))})
    return rows.withColumn("severity", severity(p, a, b, F.col("category"))).drop("kind", "kind_of", "group", "listed", *PARSED)


def drop_current_color(diffs: DataFrame) -> DataFrame:
    """Without border-colour diffs that repeat the text colour's own change."""
    w = Window.partitionBy("pair_id", "b_ord", "c_ord")
    own = F.max(F.when(F.col("property") == "color", F.struct("base_value", "compare_value"))).over(w)  # the pair's rows lie together since its join
    repeats = F.col("property").isin(*DERIVED) & F.col("base_value").eqNullSafe(F.col("own.base_value")) & F.col("compare_value").eqNullSafe(F.col("own.compare_value"))
    return diffs.withColumn("own", own).where(~(F.col("own").isNotNull() & repeats)).drop("own")


def compare(matches: DataFrame, base: DataFrame, comp: DataFrame, mode: Mode) -> DataFrame:
    """All diffs of all matches, each with its severity."""
    return compare_pairs(pair_up(matches, base, comp), mode)


def worst(severities: Column) -> Column:
    """Name of the worst of an array of severities; null for none."""
    return F.get(F.array(*[F.lit(r) for r in RANKS]), F.array_min(F.transform(severities, lambda s: F.array_position(F.array(*[F.lit(r) for r in RANKS]), s))).cast("int") - 1)


def per_element(diffs: DataFrame) -> DataFrame:
    """One row per match with diffs: a count for each severity, the total and the worst."""
    counts = [F.count_if(F.col("severity") == r).alias(r) for r in RANKS]
    return diffs.groupBy("pair_id", "b_ord", "c_ord").agg(*counts, F.count("*").alias("total"), worst(F.collect_set("severity")).alias("overall"))


def summary(matches: DataFrame, diffs: DataFrame) -> DataFrame:
    """One row per pair: matched, unchanged and modified elements, diffs, and elements by worst severity."""
    by_element = per_element(diffs)
    changed = by_element.groupBy("pair_id").agg(F.count("*").alias("modified"), F.sum("total").alias("diffs"), *[F.count_if(F.col("overall") == r).alias(r) for r in RANKS])
    total = matches.groupBy("pair_id").agg(F.count("*").alias("matched"))
    joined = total.join(changed, "pair_id", "left").na.fill(0)
    return joined.select("pair_id", "matched", (F.col("matched") - F.col("modified")).alias("unchanged"), "modified", "diffs", *RANKS)
