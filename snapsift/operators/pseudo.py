"""Styles of pseudo-elements: nested maps (pseudo-element -> property -> value), compared in one pass over the pair's own row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What makes no pseudo-element, and the properties that are read of one.
NO_CONTENT = ["", "none", "normal", '""', "''"]
PROPERTIES = (
    "content display width height background-color color font-size font-family position top left right bottom transform opacity border padding margin box-shadow border-radius z-index visibility"
).split()
# End of fixed values.


def rendered(styles: Column) -> Column:
    """The pseudo-elements that show, with the values that are read of them (styles: pseudo-element -> property -> value)."""
    shows = F.map_filter(styles, lambda _, v: ~F.coalesce(v["content"], F.lit("")).isin(*NO_CONTENT))
    return F.transform_values(shows, lambda _, v: F.map_filter(v, lambda k, x: k.isin(*PROPERTIES) & (F.coalesce(x, F.lit("")) != "")))


def compare(base: DataFrame, comp: DataFrame) -> DataFrame:
    """pair_id, hpid, property, base_value, compare_value, type: what differs between the pseudo-elements (column ``pseudo``) of elements of one path on both sides.

    The hpid is the element's with the pseudo-element behind it. A side without the pseudo-element has none of its properties.
    """
    both = base.select("pair_id", "hpid", rendered(F.col("pseudo")).alias("a")).join(comp.select("pair_id", "hpid", rendered(F.col("pseudo")).alias("b")), ["pair_id", "hpid"])
    empty = F.create_map().cast("map<string,map<string,string>>")
    a, b = F.coalesce("a", empty), F.coalesce("b", empty)
    none = F.create_map().cast("map<string,string>")
    row = lambda name, k, x, y: F.struct(F.concat("hpid", name).alias("hpid"), k.alias("property"), x.alias("base_value"), y.alias("compare_value"))

    def of(name: Column) -> Column:
        x, y = F.coalesce(a[name], none), F.coalesce(b[name], none)
        changed = F.filter(F.array_union(F.map_keys(x), F.map_keys(y)), lambda k: ~x[k].eqNullSafe(y[k]))
        return F.transform(changed, lambda k: row(name, k, x[k], y[k]))

    rows = both.select("pair_id", F.inline(F.flatten(F.transform(F.array_union(F.map_keys(a), F.map_keys(b)), of))))
    kind = F.when(F.col("base_value").isNull(), "added").when(F.col("compare_value").isNull(), "removed").otherwise("modified")
    return rows.select("pair_id", "hpid", "property", "base_value", "compare_value", kind.alias("type"))
