"""CSS values as Column expressions: colours, lengths, fonts and shorthands in one comparable form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SIDES

# Named colours, kept keywords, generic families and spellings of common fonts.
NAMED = """aliceblue f0f8ff antiquewhite faebd7 aqua 00ffff aquamarine 7fffd4 azure f0ffff beige f5f5dc bisque ffe4c4 black 000000 blanchedalmond ffebcd
blue 0000ff blueviolet 8a2be2 brown a52a2a burlywood deb887 cadetblue 5f9ea0 chartreuse 7fff00 chocolate d2691e coral ff7f50 cornflowerblue 6495ed
cornsilk fff8dc crimson dc143c cyan 00ffff darkblue 00008b darkcyan 008b8b darkgoldenrod b8860b darkgray a9a9a9 darkgrey a9a9a9 darkgreen 006400
darkkhaki bdb76b darkmagenta 8b008b darkolivegreen 556b2f darkorange ff8c00 darkorchid 9932cc darkred 8b0000 darksalmon e9967a darkseagreen 8fbc8f
darkslateblue 483d8b darkslategray 2f4f4f darkslategrey 2f4f4f darkturquoise 00ced1 darkviolet 9400d3 deeppink ff1493 deepskyblue 00bfff dimgray 696969
dimgrey 696969 dodgerblue 1e90ff firebrick b22222 floralwhite fffaf0 forestgreen 228b22 fuchsia ff00ff gainsboro dcdcdc ghostwhite f8f8ff gold ffd700
goldenrod daa520 gray 808080 grey 808080 green 008000 greenyellow adff2f honeydew f0fff0 hotpink ff69b4 indianred cd5c5c indigo 4b0082 ivory fffff0
khaki f0e68c lavender e6e6fa lavenderblush fff0f5 lawngreen 7cfc00 lemonchiffon fffacd lightblue add8e6 lightcoral f08080 lightcyan e0ffff
lightgoldenrodyellow fafad2 lightgray d3d3d3 lightgrey d3d3d3 lightgreen 90ee90 lightpink ffb6c1 lightsalmon ffa07a lightseagreen 20b2aa
lightskyblue 87cefa lightslategray 778899 lightslategrey 778899 lightsteelblue b0c4de lightyellow ffffe0 lime 00ff00 limegreen 32cd32 linen faf0e6
magenta ff00ff maroon 800000 mediumaquamarine 66cdaa mediumblue 0000cd mediumorchid ba55d3 mediumpurple 9370db mediumseagreen 3cb371 mediumslateblue 7b68ee
mediumspringgreen 00fa9a mediumturquoise 48d1cc mediumvioletred c71585 midnightblue 191970 mintcream f5fffa mistyrose ffe4e1 moccasin ffe4b5
navajowhite ffdead navy 000080 oldlace fdf5e6 olive 808000 olivedrab 6b8e23 orange ffa500 orangered ff4500 orchid da70d6 palegoldenrod eee8aa
palegreen 98fb98 paleturquoise afeeee palevioletred db7093 papayawhip ffefd5 peachpuff ffdab9 peru cd853f pink ffc0cb plum dda0dd powderblue b0e0e6
purple 800080 rebeccapurple 663399 red ff0000 rosybrown bc8f8f royalblue 4169e1 saddlebrown 8b4513 salmon fa8072 sandybrown f4a460 seagreen 2e8b57
seashell fff5ee sienna a0522d silver c0c0c0 skyblue 87ceeb slateblue 6a5acd slategray 708090 slategrey 708090 snow fffafa springgreen 00ff7f
steelblue 4682b4 tan d2b48c teal 008080 thistle d8bfd8 tomato ff6347 turquoise 40e0d0 violet ee82ee wheat f5deb3 white ffffff whitesmoke f5f5f5
yellow ffff00 yellowgreen 9acd32""".split()
COLOR_KEYWORDS = ("inherit", "initial", "unset", "revert", "currentcolor")
LENGTH_KEYWORDS = ("auto", "none", "initial", "inherit", "unset", "normal")
GENERIC_FONTS = ("serif", "sans-serif", "monospace", "cursive", "fantasy", "system-ui", "ui-serif", "ui-sans-serif", "ui-monospace", "ui-rounded")
SPELLED_FONTS = {"comic sans ms": "Comic Sans MS", "trebuchet ms": "Trebuchet MS"}
BORDER_STYLES = ("none", "hidden", "dotted", "dashed", "solid", "double", "groove", "ridge", "inset", "outset")
PX_OF = {"px": 1.0, "em": 16.0, "rem": 16.0, "vw": 10.24, "vh": 7.68, "vmin": 7.68, "vmax": 10.24, "pt": 1.333333, "pc": 16.0, "in": 96.0, "cm": 37.7952755906, "mm": 3.77952755906, "q": 0.94488188976}
COLOR_PROPERTIES = (
    "color", "background-color", "border-color", "border-top-color", "border-right-color", "border-bottom-color", "border-left-color", "outline-color",
    "text-decoration-color", "column-rule-color", "caret-color"
)
_CORNERS = (
    "top-left", "top-right", "bottom-right", "bottom-left"
)
SIZE_PROPERTIES = (
    "width", "height", "min-width", "max-width", "min-height", "max-height", "top", "right", "bottom", "left", "margin", "padding", "border-width",
    "border-radius", "font-size", "line-height", "margin-top", "margin-right", "margin-bottom", "margin-left", "padding-top", "padding-right",
    "padding-bottom", "padding-left", "border-top-width", "border-right-width", "border-bottom-width", "border-left-width", "border-top-left-radius",
    "border-top-right-radius", "border-bottom-right-radius", "border-bottom-left-radius", "letter-spacing", "word-spacing", "gap", "row-gap",
    "column-gap", "grid-gap", "outline-width", "outline-offset", "text-indent"
)
SHORTHANDS = (
    "margin", "padding", "border-width", "border-style", "border-color", "border-radius", "border", "border-top", "border-right", "border-bottom",
    "border-left", "background", "font"
)
#: Plain values, whose normal form needs no arithmetic: whole numbers without leading zeros.
PLAIN_RGB = r"^rgb\((?:0|[1-9]\d{0,2}), (?:0|[1-9]\d{0,2}), (?:0|[1-9]\d{0,2})\)\z"
PLAIN_PX = r"^[1-9]\d{0,8}px\z"
# End of fixed values.


def number(value: Column) -> Column:
    """A number without a needless fraction: 1.0 is written 1, 0.5 stays."""
    return F.regexp_replace(value.cast("double").cast("string"), r"\.0$", "")


def rounded(value: Column) -> Column:
    """The nearest whole number, halves up."""
    return F.floor(value + 0.5).cast("int")


def rgba(r: Column, g: Column, b: Column, a: Column) -> Column:
    return F.concat(F.lit("rgba("), F.concat_ws(", ", r.cast("string"), g.cast("string"), b.cast("string"), number(a)), F.lit(")"))


def lookup(table: dict[str, str], key: Column) -> Column:
    """The value of a key in a constant table (null: none). The table is one literal of the plan, however long it is."""
    return F.str_to_map(F.lit(";".join(f"{k}={v}" for k, v in table.items())), F.lit(";"), F.lit("="))[key]


def hex_color(v: Column) -> Column:
    """#rgb, #rgba, #rrggbb and #rrggbbaa."""
    full = F.regexp_replace(v, "^#(.)(.)(.)(.?)$", "#$1$1$2$2$3$3$4$4")
    part = F.transform(F.array(F.lit(2), F.lit(4), F.lit(6), F.lit(8)), lambda at: F.conv(F.substring(full, at, F.lit(2)), 16, 10).cast("int"))
    alpha = F.when(F.length(full) == 9, F.floor(part[3] / 255 * 100 + 0.5) / 100).otherwise(1.0)
    return F.when(v.rlike("^#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})$"), rgba(part[0], part[1], part[2], alpha))


def _arguments(v: Column) -> Column:
    return F.transform(F.split(F.regexp_extract(v, r"\(([^)]*)\)", 1), ","), lambda x: F.trim(x))


def rgb_color(v: Column) -> Column:
    p = _arguments(v)
    c = [rounded(F.get(p, F.lit(k)).try_cast("double")) for k in range(3)]
    return rgba(*c, F.coalesce(F.get(p, F.lit(3)).try_cast("double"), F.lit(1.0)))


def hsl_color(v: Column) -> Column:
    p = _arguments(v)
    plain = lambda k: F.regexp_extract(F.get(p, F.lit(k)), r"^([-+]?[\d.]+)", 1).try_cast("double")
    h = F.pmod(plain(0), F.lit(360.0)) / 360
    s, light = (F.least(F.lit(1.0), F.greatest(F.lit(0.0), plain(k) / 100)) for k in (1, 2))
    q = F.when(light < 0.5, light * (1 + s)).otherwise(light + s - light * s)
    base = 2 * light - q

    def channel(shift: Column) -> Column:
        t = F.pmod(h + shift, F.lit(1.0))
        mixed = F.when(t < 1 / 6, base + (q - base) * 6 * t).when(t < 1 / 2, q).when(t < 2 / 3, base + (q - base) * (2 / 3 - t) * 6).otherwise(base)
        return rounded(F.when(s == 0, light).otherwise(mixed) * 255)

    c = F.transform(F.array(F.lit(1 / 3), F.lit(0.0), F.lit(-1 / 3)), channel)
    return rgba(c[0], c[1], c[2], F.coalesce(F.get(p, F.lit(3)).try_cast("double"), F.lit(1.0)))


def named_color(v: Column) -> Column:
    return hex_color(F.concat(F.lit("#"), lookup(dict(zip(NAMED[::2], NAMED[1::2], strict=True)), v)))


def normalize_color(value: Column) -> Column:
    v = F.lower(F.trim(value))
    return (
        F.when(value.rlike(PLAIN_RGB), F.concat(F.lit("rgba"), F.substring(value, F.lit(4), F.length(value) - 4), F.lit(", 1)")))
        .when(v == "transparent", F.lit("rgba(0, 0, 0, 0)"))
        .when(v.isin(*COLOR_KEYWORDS), v)
        .when(v.startswith("#"), F.coalesce(hex_color(v), value))
        .when(v.startswith("rgb"), F.coalesce(rgb_color(v), value))
        .when(v.startswith("hsl"), F.coalesce(hsl_color(v), value))
        .otherwise(F.coalesce(named_color(v), value))
    )


def two_places(value: Column) -> Column:
    """Two decimals, halves away from zero on the decimal form of the number."""
    return F.format_string("%.2f", value.cast("double"))


def normalize_unit(value: Column, prop: Column, context: dict[str, Column] | None = None) -> Column:
    """A length in px with two decimals. ``context`` may give parent_width, parent_height and parent_font_size for percentages."""
    v = F.lower(F.trim(value))
    amount = F.regexp_extract(v, r"^([-+]?\d*\.?\d+)([a-z%]*)$", 1).try_cast("double")
    unit = F.regexp_extract(v, r"^([-+]?\d*\.?\d+)([a-z%]*)$", 2)
    factor = lookup({k: str(f) for k, f in PX_OF.items()}, F.when(unit == "", "px").otherwise(unit)).cast("double")
    percent = F.concat(two_places(amount), F.lit("%"))
    if context:
        has = lambda *words: reduce(lambda a, b: a | b, [prop.contains(w) for w in words])
        ref = F.when(has("width", "left", "right", "column"), context["parent_width"]).when(has("height", "top", "bottom", "row"), context["parent_height"])
        ref = ref.when(has("font") | (prop == "line-height"), context["parent_font_size"])
        percent = F.when(ref.isNotNull(), F.concat(two_places(amount / 100 * ref), F.lit("px"))).otherwise(percent)
    return (
        F.when(value.rlike(PLAIN_PX), F.concat(F.substring(value, F.lit(1), F.length(value) - 2), F.lit(".00px")))
        .when(v.isin(*LENGTH_KEYWORDS), v)
        .when(v.isin("0", "0px"), F.lit("0px"))
        .when(unit == "%", percent)
        .when(factor.isNotNull() & amount.isNotNull(), F.concat(two_places(amount * factor), F.lit("px")))
        .otherwise(value)
    )


def context_dependent(value: Column) -> Column:
    return F.coalesce(F.lower(value).rlike("em|rem|%|vw|vh|vmin|vmax"), F.lit(False))


def normalize_font(value: Column) -> Column:
    """Family names without quotes, each in its usual spelling."""

    def one(font: Column) -> Column:
        bare = F.trim(F.regexp_replace(F.lower(font), "^['\"]|['\"]$", ""))
        capital = F.array_join(F.transform(F.split(bare, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")
        return F.when(bare.isin(*GENERIC_FONTS), bare).otherwise(F.coalesce(lookup(SPELLED_FONTS, bare), capital))

    fonts = F.filter(F.transform(F.split(value, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.coalesce(value, F.lit("")) == "", value).otherwise(F.array_join(F.transform(fonts, one), ", "))


#: How the values of a property are normalised.
KINDS = {p: "color" for p in COLOR_PROPERTIES} | {p: "size" for p in SIZE_PROPERTIES if p not in COLOR_PROPERTIES} | {"font-family": "font"}


def normalize(prop: Column, value: Column, context: dict[str, Column] | None = None, kind: Column | None = None) -> Column:
    """A value in its normal form; ``kind`` is that of the property, if it is known already."""
    kind = lookup(KINDS, prop) if kind is None else kind
    return F.when(kind == "color", normalize_color(value)).when(kind == "size", normalize_unit(value, prop, context)).when(kind == "font", normalize_font(value)).otherwise(value)


def box_values(value: Column) -> Column:
    """The four sides of a one- to four-value shorthand."""
    p = F.split(F.trim(value), r"\s+")
    top = F.get(p, F.lit(0))
    right = F.coalesce(F.get(p, F.lit(1)), top)
    bottom = F.coalesce(F.get(p, F.lit(2)), top)
    return F.array(top, right, bottom, F.coalesce(F.get(p, F.lit(3)), right))


def border_parts(value: Column) -> Column:
    """struct(width, style, color) of a border shorthand; the last token of a kind counts."""
    tokens = F.split(value, r"\s+")
    is_width = lambda t: t.rlike(r"^\d") | t.isin("thin", "medium", "thick")
    last = lambda keep: F.try_element_at(F.filter(tokens, keep), F.lit(-1))
    return F.struct(
        last(is_width).alias("width"),
        last(lambda t: t.isin(*BORDER_STYLES) & ~is_width(t)).alias("style"),
        last(lambda t: ~t.isin(*BORDER_STYLES) & ~is_width(t)).alias("color"),
    )


def font_parts(value: Column) -> Column:
    """struct(style, weight, size, line_height, family) of a font shorthand; the first token of a kind counts."""
    tokens = F.split(value, r"\s+")
    style = lambda t: t.isin("italic", "oblique")
    weight = lambda t: t.isin("bold", "bolder", "lighter") | t.rlike(r"^\d{3}$")
    size = lambda t: t.rlike(r"^\d") & ~weight(t)
    first = lambda keep: F.get(F.filter(tokens, keep), F.lit(0))
    sized = first(size)
    lines = F.get(F.filter(tokens, lambda t: size(t) & t.contains("/")), F.lit(0))
    return F.struct(
        first(style).alias("style"),
        first(weight).alias("weight"),
        F.regexp_extract(sized, "^([^/]+)", 1).alias("size"),
        F.when(lines.isNotNull(), F.regexp_extract(lines, "/(.+)", 1)).alias("line_height"),
        first(lambda t: ~style(t) & ~weight(t) & ~t.rlike(r"^\d")).alias("family"),
    )


def background_parts(value: Column) -> Column:
    image = F.regexp_extract(value, r"(url\([^)]+\))", 1)
    color = F.regexp_extract(value, r"(?i)(#[0-9a-f]{3,8}|rgba?\([^)]+\)|hsla?\([^)]+\)|[a-z]+)", 1)
    return F.struct(F.when(color != "", color).alias("color"), F.when(image != "", image).alias("image"))


def expand_shorthands(styles: Column) -> Column:
    """A style map whose shorthands have become longhands, where those were absent or empty.

    Names are data, so the plan holds one expression for a kind of shorthand and not one for every longhand.
    """
    boxes = {
        "padding": [f"padding-{s}" for s in SIDES],
        "margin": [f"margin-{s}" for s in SIDES],
        "border-width": [f"border-{s}-width" for s in SIDES],
        "border-style": [f"border-{s}-style" for s in SIDES],
        "border-color": [f"border-{s}-color" for s in SIDES],
        "border-radius": [f"border-{c}-radius" for c in _CORNERS],
    }
    texts = lambda names: F.array(*[F.lit(n) for n in names])
    entry = lambda k, v: F.struct(k.alias("key"), F.nullif(v, F.lit("")).alias("value"))
    as_map = lambda entries: F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    given = F.filter(F.array(*[F.struct(F.lit(short).alias("short"), texts(names).alias("names")) for short, names in boxes.items()]), lambda x: styles[x["short"]].isNotNull())
    from_boxes = F.flatten(F.transform(given, lambda x: F.transform(F.arrays_zip(x["names"].alias("n"), box_values(styles[x["short"]]).alias("v")), lambda e: entry(e["n"], e["v"]))))

    border, font, ground = border_parts(styles["border"]), font_parts(styles["font"]), background_parts(styles["background"])
    parts = F.array(*[F.struct(F.lit(part).alias("part"), border[part].alias("v")) for part in ("width", "style", "color")])
    from_border = F.flatten(F.transform(parts, lambda x: F.transform(texts(SIDES), lambda side: entry(F.concat(F.lit("border-"), side, F.lit("-"), x["part"]), x["v"]))))
    single = [entry(F.lit(f"background-{part}"), ground[part]) for part in ("color", "image")]
    single += [entry(F.lit(name), font[part]) for part, name in {"style": "font-style", "weight": "font-weight", "size": "font-size", "line_height": "line-height", "family": "font-family"}.items()]

    offered = F.map_zip_with(as_map(from_boxes), as_map(F.concat(from_border, F.array(*single))), lambda _, x, y: F.coalesce(x, y))
    news = F.map_filter(offered, lambda k, _: F.coalesce(styles[k], F.lit("")) == "")
    kept = F.map_filter(styles, lambda k, _: ~k.isin(*SHORTHANDS))
    expanded = F.map_zip_with(kept, news, lambda _, old, new: F.coalesce(new, old))
    return F.when(F.arrays_overlap(F.map_keys(styles), texts(SHORTHANDS)), expanded).otherwise(styles)


def channels(value: Column) -> Column:
    """[r, g, b, a] of the first rgb() in a value, without a where none is given; null where there is no rgb()."""
    found = F.regexp_extract(value, r"rgba?\((\d+,\s*\d+,\s*\d+(?:,\s*[\d.]+)?)\)", 1)
    return F.split(F.nullif(found, F.lit("")), r",\s*").try_cast("array<double>")


def rgb(parts: Column) -> dict[str, Column]:
    """r, g, b and a of ``channels``."""
    return {n: F.get(parts, F.lit(k)) for k, n in enumerate("rgba")}


def parse_rgba(value: Column) -> Column:
    """struct(r, g, b, a) of the first rgb() in a value; null where there is none."""
    c = rgb(channels(value))
    return F.when(c["r"].isNotNull(), F.struct(*[c[n].cast("int").alias(n) for n in "rgb"], c["a"].alias("a")))


def parse_px(value: Column) -> Column:
    """The amount of an unsigned px length."""
    return F.regexp_extract(value, r"^([0-9.]+)px$", 1).try_cast("double")


def leading_number(value: Column) -> Column:
    return F.regexp_extract(value, r"^\s*([-+]?\d*\.?\d+)", 1).try_cast("double")


def luminance(color: Column | dict[str, Column]) -> Column:
    """Relative luminance of r, g and b."""
    linear = lambda c: F.when(c / 255 <= 0.03928, c / 255 / 12.92).otherwise(F.pow((c / 255 + 0.055) / 1.055, F.lit(2.4)))
    shares = F.zip_with(F.array(*[color[n].cast("double") for n in "rgb"]), F.array(F.lit(0.2126), F.lit(0.7152), F.lit(0.0722)), lambda c, weight: weight * linear(c))
    return F.aggregate(shares, F.lit(0.0), lambda x, y: x + y)
