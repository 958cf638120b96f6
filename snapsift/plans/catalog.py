"""The registered queries of the engine's own operators, each with its SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures
from ..config import DEFAULT, DYNAMIC, STATIC
from ..functions import css
from ..operators import cascade, diff, filters, match, report, stats, urls, visual
from ..sources import html, tables
from ..streaming import readiness
from . import compare as plan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

B, C = fixtures.base_sql(), fixtures.compare_sql()
#: SQL of the two sides and of their elements paired by path.
SIDES = f"b AS ({B}), c AS ({C})"
PAIRED = f"{SIDES}, p AS (SELECT b.report_id AS pair_id, b.ord AS b_ord, c.ord AS c_ord, b AS x, c AS y, b.hpid FROM b JOIN c ON b.report_id = c.report_id AND b.hpid = c.hpid)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.elements(spark, sf_dir, "base")


def comp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.elements(spark, sf_dir, "compare")


# --- CSS values ---


@query("SELECT p_partkey, printf('#%02x%02x%02x', p_partkey % 256, (p_partkey // 3) % 256, p_size) AS raw, 'rgba(' || p_partkey % 256 || ', ' || (p_partkey // 3) % 256 || ', ' || p_size || ', 1)' AS color FROM part")
def normalize_color_hex(spark, sf_dir):
    raw = F.format_string("#%02x%02x%02x", F.col("p_partkey") % 256, F.floor(F.col("p_partkey") / 3) % 256, "p_size")
    return read(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), css.normalize_color(raw).alias("color"))


@query("SELECT p_partkey, 'rgba(' || p_partkey % 256 || ', ' || p_size || ', 7, ' || CASE p_partkey % 3 WHEN 0 THEN '1' WHEN 1 THEN '0.5' ELSE '0.25' END || ')' AS color FROM part")
def normalize_color_rgb(spark, sf_dir):
    head = F.concat_ws(",", F.col("p_partkey") % 256, "p_size", F.lit("7"))
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("rgb("), head, F.lit(")"))).otherwise(F.concat(F.lit("rgba("), head, F.when(F.col("p_partkey") % 3 == 1, ", 0.5)").otherwise(",.25)")))
    return read(spark, sf_dir, "part").select("p_partkey", css.normalize_color(raw).alias("color"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'rgba(102, 51, 153, 1)' WHEN 1 THEN 'rgba(250, 240, 230, 1)' WHEN 2 THEN 'rgba(0, 0, 0, 0)' WHEN 3 THEN 'currentcolor'
  WHEN 4 THEN 'rgba(0, 128, 128, 1)' ELSE 'nocolor' END AS color FROM part""")
def normalize_color_named(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in ("RebeccaPurple", " linen ", "transparent", "currentColor", "teal", "nocolor")])
    return read(spark, sf_dir, "part").select("p_partkey", css.normalize_color(F.get(names, (F.col("p_partkey") % 6).cast("int"))).alias("color"))


@query("""WITH v AS (SELECT p_partkey, p_partkey % 3 AS sector, p_size FROM part)
SELECT p_partkey, CASE sector WHEN 0 THEN 'rgba(255, 0, 0, 1)' WHEN 1 THEN 'rgba(0, 255, 0, 1)' ELSE 'rgba(0, 0, 255, 1)' END AS pure,
  'rgba(' || CAST(floor(255 * p_size / 100.0 + 0.5) AS BIGINT) || ', ' || CAST(floor(255 * p_size / 100.0 + 0.5) AS BIGINT) || ', ' || CAST(floor(255 * p_size / 100.0 + 0.5) AS BIGINT) || ', 1)' AS gray FROM v""")
def normalize_color_hsl(spark, sf_dir):
    pure = F.concat(F.lit("hsl("), (F.col("p_partkey") % 3 * 120).cast("string"), F.lit(", 100%, 50%)"))
    gray = F.concat(F.lit("hsl(77, 0%, "), F.col("p_size").cast("string"), F.lit("%)"))
    return read(spark, sf_dir, "part").select("p_partkey", css.normalize_color(pure).alias("pure"), css.normalize_color(gray).alias("gray"))


_UNITS = [("px", "1"), ("em", "16"), ("rem", "16"), ("pc", "16"), ("in", "96"), ("", "1")]


@query(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 100 = 0 AND l_suppkey % {len(_UNITS)} IN (0, {len(_UNITS) - 1}) THEN '0px'
  ELSE printf('%.2fpx', l_partkey % 100 * CASE l_suppkey % {len(_UNITS)} {' '.join(f'WHEN {k} THEN {f}' for k, (_, f) in enumerate(_UNITS))} END * 1.0) END AS length FROM lineitem""")
def normalize_unit(spark, sf_dir):
    unit = F.get(F.array(*[F.lit(u) for u, _ in _UNITS]), (F.col("l_suppkey") % len(_UNITS)).cast("int"))
    raw = F.concat((F.col("l_partkey") % 100).cast("string"), unit)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", css.normalize_unit(raw, F.lit("width")).alias("length"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Times New Roman, serif' WHEN 1 THEN 'Comic Sans MS' WHEN 2 THEN 'My Own Face, sans-serif' ELSE 'Arial, monospace' END AS font FROM part""")
def normalize_font(spark, sf_dir):
    raw = F.array(F.lit('"times new roman", serif'), F.lit(" 'COMIC sans ms'"), F.lit("my own FACE,, Sans-Serif"), F.lit("arial,monospace"))
    return read(spark, sf_dir, "part").select("p_partkey", css.normalize_font(F.get(raw, (F.col("p_partkey") % 4).cast("int"))).alias("font"))


@query("""SELECT p_partkey, p_size || 'px' AS t, CASE p_partkey % 4 WHEN 0 THEN p_size || 'px' ELSE '2px' END AS r, CASE WHEN p_partkey % 4 < 2 THEN p_size || 'px' ELSE '3px' END AS b,
  CASE p_partkey % 4 WHEN 0 THEN p_size || 'px' WHEN 3 THEN '4px' ELSE '2px' END AS l FROM part""")
def expand_box_shorthand(spark, sf_dir):
    n = (F.col("p_partkey") % 4 + 1).cast("int")
    raw = F.array_join(F.slice(F.array(F.concat(F.col("p_size").cast("string"), F.lit("px")), F.lit("2px"), F.lit("3px"), F.lit("4px")), F.lit(1), n), " ")
    styles = css.expand_shorthands(F.create_map(F.lit("margin"), raw))
    return read(spark, sf_dir, "part").select("p_partkey", *[styles[f"margin-{s}"].alias(s[0]) for s in ("top", "right", "bottom", "left")])


@query("""SELECT p_partkey, p_size || 'px' AS width, CASE WHEN p_partkey % 2 = 0 THEN 'solid' ELSE 'dashed' END AS style, 'red' AS color, 'bold' AS weight, '12px' AS size, '1.5' AS line, 'arial' AS family FROM part""")
def expand_border_and_font(spark, sf_dir):
    border = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, "px solid red").otherwise("px dashed red"))
    s = css.expand_shorthands(F.create_map(F.lit("border"), border, F.lit("font"), F.lit("bold 12px/1.5 arial")))
    names = {"width": "border-left-width", "style": "border-top-style", "color": "border-right-color", "weight": "font-weight", "size": "font-size", "line": "line-height", "family": "font-family"}
    return read(spark, sf_dir, "part").select("p_partkey", *[s[p].alias(n) for n, p in names.items()])


_LINEAR = "CASE WHEN {v} / 255.0 <= 0.03928 THEN {v} / 255.0 / 12.92 ELSE pow(({v} / 255.0 + 0.055) / 1.055, 2.4) END"


@query(f"SELECT p_partkey, CAST(floor((0.2126 * {_LINEAR.format(v='(p_partkey % 256)')} + 0.7152 * {_LINEAR.format(v='p_size')} + 0.0722 * {_LINEAR.format(v='100')}) * 1000000 + 0.5) AS BIGINT) AS luminance FROM part")
def color_luminance(spark, sf_dir):
    color = css.parse_rgba(F.concat(F.lit("rgb("), F.concat_ws(", ", F.col("p_partkey") % 256, "p_size", F.lit("100")), F.lit(")")))
    return read(spark, sf_dir, "part").select("p_partkey", F.floor(css.luminance(color) * 1000000 + 0.5).alias("luminance"))


# --- predicates and classifications ---


@query(f"WITH {SIDES} SELECT report_id AS pair_id, ord, CASE tag WHEN 'div' THEN 'T1' ELSE 'T2' END AS tier, CASE WHEN y < 60 THEN 'header' WHEN y > 255 THEN 'footer' ELSE 'main' END AS section FROM b")
def classify_tier_and_section(spark, sf_dir):
    b = base(spark, sf_dir)
    return b.select("pair_id", "ord", filters.tier(F.col("tag_name")).alias("tier"), filters.section_by_place(F.col("rect.y"), F.lit(300), F.lit(1000)).alias("section"))


@query(f"WITH {SIDES} SELECT report_id AS pair_id, ord FROM c WHERE display <> 'none' AND width > 0 AND height > 0")
def visible_elements(spark, sf_dir):
    return filters.visible(comp(spark, sf_dir)).select("pair_id", "ord")


@query(f"WITH {SIDES} SELECT report_id AS pair_id, ord, hpid FROM b WHERE ord <= 3")
def max_elements(spark, sf_dir):
    return filters.first_elements(base(spark, sf_dir), 3).select("pair_id", "ord", "hpid")


@query(f"WITH {SIDES} SELECT report_id AS pair_id, ord FROM b WHERE (k % 5 = 1 AND s % 4 = 2) OR (k % 5 = 2 AND s % 4 = 1) OR k % 5 = 3 OR s % 4 = 3 OR element_id = 'id-2' OR tag = 'p'")
def filter_expressions(spark, sf_dir):
    return base(spark, sf_dir).where(filters.expression_filter(".c1 c2, .c3", "#id-2, none", "P")).select("pair_id", "ord")


@query(f"WITH {SIDES}, k AS (SELECT report_id, hpid FROM b WHERE tag = 'span') SELECT report_id AS pair_id, hpid FROM k WHERE NOT EXISTS (SELECT 1 FROM k a WHERE a.report_id = k.report_id AND starts_with(k.hpid, a.hpid || '.'))")
def filter_top_roots(spark, sf_dir):
    return filters.top_roots(base(spark, sf_dir).where("tag_name = 'span'").select("pair_id", "hpid"))


@query("""SELECT c_custkey, NOT regexp_matches(CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN 'ember' || c_custkey WHEN 2 THEN 'main-nav' ELSE 'x-' || c_custkey END, '[0-9]{13,}|^(ember|react|vue|angular)[0-9]+$|-[0-9]{2,}$') AS stable,
  CASE c_custkey % 4 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN false ELSE true END AS static_text FROM customer""")
def stable_ids(spark, sf_dir):
    kind = (F.col("c_custkey") % 4).cast("int")
    key = F.col("c_custkey").cast("string")
    ids = F.get(F.array(F.col("c_name"), F.concat(F.lit("ember"), key), F.lit("main-nav"), F.concat(F.lit("x-"), key)), kind)
    texts = F.get(F.array(F.lit("12:30 today"), F.lit("Products"), F.lit("Loading..."), F.lit("About us")), kind)
    return read(spark, sf_dir, "customer").select("c_custkey", filters.stable_id(ids).alias("stable"), filters.static_text(texts).alias("static_text"))


@query(f"WITH {SIDES} SELECT report_id AS pair_id, ord, count(*) OVER (PARTITION BY report_id, list_sort(string_split(class_name, ' '))) AS occurrences FROM b")
def class_occurrence(spark, sf_dir):
    return filters.class_occurrence(base(spark, sf_dir))


@query(f"""WITH {SIDES}, s AS (SELECT *, CASE WHEN contains(hpid, '.') THEN regexp_replace(hpid, '\\.[^.]*$', '') ELSE '' END AS parent FROM b)
SELECT report_id AS pair_id, ord, lag(tag) OVER w AS previous, lead(tag) OVER w AS next, row_number() OVER w AS nth, row_number() OVER (PARTITION BY report_id, parent, tag ORDER BY ord) AS nth_of_type
FROM s WINDOW w AS (PARTITION BY report_id, parent ORDER BY ord)""")
def siblings(spark, sf_dir):
    return filters.siblings(base(spark, sf_dir))


@query(f"""WITH {SIDES}, e AS (SELECT *, string_split(class_name, ' ') AS classes FROM b), o AS (
  SELECT report_id, ord, 100 AS robustness, 'id' AS strategy, '#' || element_id AS selector, element_id AS i, NULL AS d, NULL AS t, []::VARCHAR[] AS c FROM e WHERE element_id IS NOT NULL AND NOT regexp_matches(element_id, '-[0-9][0-9]+$')
  UNION ALL SELECT report_id, ord, 91, 'test-attribute', '[data-testid="' || test_attr || '"]', NULL, test_attr, NULL, [] FROM e WHERE test_attr IS NOT NULL
  UNION ALL SELECT report_id, ord, 72, 'two-classes', tag || '.' || replace(class_name, ' ', '.'), NULL, NULL, tag, classes FROM e WHERE classes[1] <> classes[2]
  UNION ALL SELECT report_id, ord, 68, 'one-class', tag || '.' || classes[1], NULL, NULL, tag, classes[:1] FROM e),
u AS (SELECT o.report_id, o.ord, o.robustness, o.strategy, o.selector FROM o JOIN e ON e.report_id = o.report_id AND (i IS NULL OR e.element_id = i) AND (d IS NULL OR e.test_attr = d) AND (t IS NULL OR e.tag = t) AND list_has_all(e.classes, c) GROUP BY ALL HAVING count(*) = 1)
SELECT report_id AS pair_id, ord, arg_max(strategy, robustness) AS strategy, max(robustness) AS robustness, arg_max(selector, robustness) AS selector FROM u GROUP BY report_id, ord""")
def css_selectors(spark, sf_dir):
    return filters.unique_selectors(base(spark, sf_dir), filters.css_candidates())


# --- matching ---


def _verdict_sql(key: str, doubts: bool = True) -> str:
    return f"""WITH {SIDES}, kb AS (SELECT report_id, ord, {key} AS key FROM b), kc AS (SELECT report_id, ord, {key} AS key FROM c),
n AS (SELECT report_id, key, count(*) AS n, min(ord) AS c_ord FROM kc WHERE key IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY report_id, key ORDER BY ord) AS rn FROM kb)
SELECT r.report_id AS pair_id, r.ord AS b_ord, CASE WHEN n = 1 AND rn = 1 THEN 'definitive' WHEN n >= 2 AND {doubts} THEN 'ambiguous' ELSE 'orphan' END AS verdict, CASE WHEN n = 1 AND rn = 1 THEN c_ord END AS c_ord
FROM r LEFT JOIN n ON n.report_id = r.report_id AND n.key = r.key"""


def _verdicts(strategy: str):
    def run(spark, sf_dir):
        return match.key_verdicts(base(spark, sf_dir), comp(spark, sf_dir), match.strategy_key(strategy), strategy not in match.UNDOUBTING).select("pair_id", "b_ord", "verdict", "c_ord")

    return run


for _name, _strategy, _key in [
    ("match_test_attr", "test-attribute", "'data-testid::' || test_attr"),
    ("match_hpid", "absolute-hpid", "hpid"),
    ("match_id", "id", "element_id"),
    ("match_css", "css-selector", "tag || '.' || split_part(class_name, ' ', 1)"),
    ("match_xpath", "xpath", "'//' || tag || '[@title=''' || title || ''']'"),
    ("match_suffix", "suffix-realign", "CASE WHEN len(string_split(hpid, '.')) >= 2 THEN tag || '|' || hpid END"),
]:
    QUERIES[_name], SQL[_name] = _verdicts(_strategy), _verdict_sql(_key, _strategy not in match.UNDOUBTING)


def _keyed(key: str, b: str, c: str, to: str) -> str:
    return f"""{to}n AS (SELECT report_id, {key} AS key, count(*) AS n, min(ord) AS c_ord FROM {c} WHERE {key} IS NOT NULL GROUP BY ALL),
{to} AS (SELECT r.report_id, r.ord AS b_ord, c_ord, n, rn FROM (SELECT report_id, ord, {key} AS key, row_number() OVER (PARTITION BY report_id, {key} ORDER BY ord) AS rn FROM {b}) r JOIN {to}n USING (report_id, key))"""


_CASCADE = f"""WITH {SIDES}, {_keyed("'data-testid::' || test_attr", "b", "c", "m1")},
b2 AS (SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.report_id = b.report_id AND m1.b_ord = b.ord AND (n >= 2 OR rn = 1))),
c2 AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM m1 WHERE m1.report_id = c.report_id AND m1.c_ord = c.ord AND n = 1 AND rn = 1)), {_keyed("element_id", "b2", "c2", "m2")}"""


@query(f"{_CASCADE} SELECT report_id AS pair_id, b_ord, c_ord, 'test-attribute' AS strategy FROM m1 WHERE n = 1 AND rn = 1 UNION ALL SELECT report_id, b_ord, c_ord, 'id' FROM m2 WHERE n = 1 AND rn = 1")
def match_cascade(spark, sf_dir):
    found, _ = match.cascade(base(spark, sf_dir), comp(spark, sf_dir), [("test-attribute", 1.0), ("id", 0.9)])
    return found.select("pair_id", "b_ord", "c_ord", "strategy")


@query(f"WITH {SIDES} SELECT report_id AS pair_id, ord FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.report_id = b.report_id AND c.hpid = b.hpid)")
def unmatched_removed(spark, sf_dir):
    config = DEFAULT.merge(alignment=False, strategies=(("absolute-hpid", 0.95),))
    return match.match(base(spark, sf_dir), comp(spark, sf_dir), config)["removed"]


@query(f"WITH {SIDES} SELECT report_id AS pair_id, ord FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.report_id = b.report_id AND c.hpid = b.hpid)")
def unmatched_added(spark, sf_dir):
    config = DEFAULT.merge(alignment=False, strategies=(("absolute-hpid", 0.95),))
    return match.match(comp(spark, sf_dir), base(spark, sf_dir), config)["added"]


@query(f"""WITH {SIDES}, d AS (SELECT b.report_id AS pair_id, b.ord AS b_ord, c.ord AS c_ord, (b.x - c.x) * (b.x - c.x) + (b.y - c.y) * (b.y - c.y) AS square FROM b JOIN c ON b.report_id = c.report_id AND b.tag = c.tag)
SELECT pair_id, b_ord, arg_min(c_ord, square * 1000 + c_ord) AS c_ord, CAST(min(square) AS BIGINT) AS square FROM d WHERE square < 2500 GROUP BY pair_id, b_ord""")
def match_position(spark, sf_dir):
    return match.nearest(base(spark, sf_dir), comp(spark, sf_dir)).select("pair_id", "b_ord", "c_ord", F.floor(F.pow("distance", F.lit(2)) + 0.5).alias("square"))


@query(f"""WITH RECURSIVE {SIDES}, e AS (SELECT b.report_id, b.ord AS b_ord, c.ord AS c_ord, sqrt((b.x - c.x) ** 2 + (b.y - c.y) ** 2) AS d, floor(c.x / 50.0) - floor(b.x / 50.0) AS dx, floor(c.y / 50.0) - floor(b.y / 50.0) AS dy FROM b JOIN c ON b.report_id = c.report_id AND b.tag = c.tag),
n AS (SELECT *, greatest(0.1, 1 - d / 50) * 0.3 AS confidence FROM e WHERE abs(dx) <= 1 AND abs(dy) <= 1 AND d < 50 AND greatest(0.1, 1 - d / 50) * 0.3 >= 0.05),
l AS (SELECT report_id, b_ord, list(struct_pack(c := c_ord, v := confidence) ORDER BY d, dx, dy, c_ord) AS l, row_number() OVER (PARTITION BY report_id ORDER BY b_ord) AS k FROM n GROUP BY 1, 2),
r AS (SELECT DISTINCT report_id, 0::BIGINT AS k, NULL::BIGINT AS b_ord, NULL::STRUCT(c BIGINT, v DOUBLE) AS pick, []::BIGINT[] AS used FROM l
  UNION ALL SELECT l.report_id, l.k, l.b_ord, list_filter(l.l, lambda p: NOT list_contains(r.used, p.c))[1], list_concat(r.used, list_transform(list_filter(l.l, lambda p: NOT list_contains(r.used, p.c))[:1], lambda p: p.c)) FROM r JOIN l ON l.report_id = r.report_id AND l.k = r.k + 1)
SELECT report_id AS pair_id, b_ord, pick.c AS c_ord, CAST(round(1000 * pick.v) AS BIGINT) AS confidence FROM r WHERE pick IS NOT NULL""")
def match_nearest_free(spark, sf_dir):
    found = match.position_matches(base(spark, sf_dir), comp(spark, sf_dir), DEFAULT.merge(min_position=0.05))
    return found.select("pair_id", "b_ord", "c_ord", F.round(F.col("confidence") * 1000).cast("long").alias("confidence"))


#: The in-order pass step by step: r holds where both sides stand after each step, and what the step says.
_EVENT = "STRUCT(event VARCHAR, b_ord BIGINT, c_ord BIGINT, strategy VARCHAR)"
_ALIGN = f"""WITH RECURSIVE {SIDES}, bl AS (SELECT report_id, list(struct_pack(o := ord, p := hpid, t := tag) ORDER BY ord) AS l FROM b GROUP BY 1), cl AS (SELECT report_id, list(struct_pack(o := ord, p := hpid, t := tag) ORDER BY ord) AS l FROM c GROUP BY 1),
s AS (SELECT report_id, coalesce(bl.l, []) AS b, coalesce(cl.l, []) AS c FROM bl FULL JOIN cl USING (report_id)),
r(report_id, i, j, ev) AS (SELECT report_id, 1::BIGINT, 1::BIGINT, []::{_EVENT}[] FROM s
  UNION ALL SELECT report_id, CASE WHEN NOT same AND k1 IS NULL AND k2 IS NOT NULL THEN i + k2 + 1 ELSE i + 1 END, CASE WHEN NOT same AND k1 IS NOT NULL THEN j + k1 + 1 ELSE j + 1 END,
    CASE WHEN same AND x.t = y.t THEN [{{'event': 'pair', 'b_ord': x.o, 'c_ord': y.o, 'strategy': 'sequence-hpid'}}]
      WHEN same THEN [{{'event': 'removed', 'b_ord': x.o, 'c_ord': NULL, 'strategy': NULL}}, {{'event': 'added', 'b_ord': NULL, 'c_ord': y.o, 'strategy': NULL}}]
      WHEN k1 IS NOT NULL THEN list_concat(list_transform(c[j:j + k1 - 1], lambda e: {{'event': 'added', 'b_ord': NULL, 'c_ord': e.o, 'strategy': NULL}}), [{{'event': 'pair', 'b_ord': x.o, 'c_ord': c[j + k1].o, 'strategy': 'sequence-resync-add'}}])
      WHEN k2 IS NOT NULL THEN list_concat(list_transform(b[i:i + k2 - 1], lambda e: {{'event': 'removed', 'b_ord': e.o, 'c_ord': NULL, 'strategy': NULL}}), [{{'event': 'pair', 'b_ord': b[i + k2].o, 'c_ord': y.o, 'strategy': 'sequence-resync-remove'}}])
      ELSE [{{'event': 'orphan', 'b_ord': x.o, 'c_ord': y.o, 'strategy': NULL}}] END::{_EVENT}[]
  FROM (SELECT r.report_id, r.i, r.j, s.b, s.c, s.b[r.i] AS x, s.c[r.j] AS y, s.b[r.i].p = s.c[r.j].p AS same, nullif(list_position(list_transform(s.c[r.j + 1:r.j + {DEFAULT.look_ahead}], lambda e: e.p = s.b[r.i].p AND e.t = s.b[r.i].t), true), 0) AS k1,
      nullif(list_position(list_transform(s.b[r.i + 1:r.i + {DEFAULT.look_ahead}], lambda e: e.p = s.c[r.j].p AND e.t = s.c[r.j].t), true), 0) AS k2
    FROM r JOIN s ON s.report_id = r.report_id WHERE r.i <= len(s.b) AND r.j <= len(s.c)) z),
z AS (SELECT report_id, max(i) AS i, max(j) AS j FROM r GROUP BY 1),
events AS (SELECT report_id AS pair_id, unnest(ev) AS e FROM r UNION ALL SELECT s.report_id, unnest(list_transform(s.b[z.i:], lambda e: {{'event': 'removed', 'b_ord': e.o, 'c_ord': NULL, 'strategy': NULL}})::{_EVENT}[]) FROM s JOIN z ON z.report_id = s.report_id
  UNION ALL SELECT s.report_id, unnest(list_transform(s.c[z.j:], lambda e: {{'event': 'added', 'b_ord': NULL, 'c_ord': e.o, 'strategy': NULL}})::{_EVENT}[]) FROM s JOIN z ON z.report_id = s.report_id)"""


@query(f"{_ALIGN} SELECT pair_id, e.event AS event, e.b_ord AS b_ord, e.c_ord AS c_ord, e.strategy AS strategy FROM events")
def match_alignment(spark, sf_dir):
    return match.align(base(spark, sf_dir), comp(spark, sf_dir)).select("pair_id", "event", "b_ord", "c_ord", "strategy")


@query()
def match_all_strategies(spark, sf_dir):
    return match.match(base(spark, sf_dir), comp(spark, sf_dir), DEFAULT.merge(drop_alignment_orphans=False))["matches"]


def by_path(spark, sf_dir) -> DataFrame:
    b, c = base(spark, sf_dir), comp(spark, sf_dir)
    return b.select("pair_id", F.col("ord").alias("b_ord"), "hpid").join(c.select("pair_id", F.col("ord").alias("c_ord"), "hpid"), ["pair_id", "hpid"]).drop("hpid")


@query(f"""WITH {SIDES}, m AS (SELECT b.report_id AS pair_id, count(*) AS matched FROM b JOIN c ON b.report_id = c.report_id AND b.hpid = c.hpid GROUP BY 1), r AS (SELECT report_id AS pair_id, count(*) AS total FROM b GROUP BY 1)
SELECT pair_id, coalesce(matched, 0) AS matched, total - coalesce(matched, 0) AS removed, 0 AS added, CAST(floor(100.0 * coalesce(matched, 0) / total + 0.5) AS BIGINT) AS rate FROM r LEFT JOIN m USING (pair_id)""")
def match_rate(spark, sf_dir):
    found = match.match(base(spark, sf_dir), comp(spark, sf_dir), DEFAULT.merge(alignment=False, strategies=(("absolute-hpid", 0.95),)))
    return match.rate(found["matches"], found["removed"], found["added"])


# --- diffs ---


def _diffs_sql(color: int, size: int, rest: bool) -> str:
    """The long diff table of elements paired by path, each property by its own rule."""
    one = lambda prop, a, b, where, cat, sev, kind="'modified'": f"SELECT pair_id, b_ord, c_ord, hpid, '{prop}' AS property, {a} AS base_value, {b} AS compare_value, {kind} AS type, '{cat}' AS category, {sev} AS severity FROM p WHERE {where}"
    px = lambda v: f"CASE WHEN {v} = 0 THEN '0px' ELSE {v} || '.00px' END"
    rgba = lambda s: f"'rgba(' || {s}.red || ', ' || {s}.green || ', ' || {s}.blue || ', 1)'"
    beyond = lambda c, t: f"abs(x.{c} - y.{c}) > {t}"
    zero = "((x.margin = 0) <> (y.margin = 0) AND false)"
    parts = [
        one("width", px("x.width"), px("y.width"), beyond("width", size), "layout", "CASE WHEN abs(y.width - x.width) * 2 > x.width THEN 'critical' ELSE 'high' END"),
        one("color", rgba("x"), rgba("y"), beyond("red", color), "visual", "'high'"),
        one("margin-top", px("x.margin"), px("y.margin"), f"{beyond('margin', size)} OR {zero}", "spacing", "'medium'"),
        one("display", "x.display", "y.display", "x.display <> y.display", "layout", "'critical'"),
        one("font-size", px("x.font_size"), px("y.font_size"), beyond("font_size", size), "typography", "'high'"),
        one("opacity", "x.opacity", "y.opacity", "x.opacity IS DISTINCT FROM y.opacity", "visual", "'high'", "CASE WHEN x.opacity IS NULL THEN 'added' WHEN y.opacity IS NULL THEN 'removed' ELSE 'modified' END"),
    ]
    if rest:
        parts.append(one("attr:title", "x.title", "y.title", "x.title <> y.title", "attribute", "'low'"))
        parts.append(one("textContent", "x.words", "y.words", "x.words <> y.words", "content", "'low'"))
    return f"{PAIRED}, d AS ({' UNION ALL '.join(parts)})"


STATIC_SQL = _diffs_sql(5, 3, True)
COLUMNS = "pair_id, b_ord, c_ord, property, base_value, compare_value, type, category, severity"


def static_diffs(spark, sf_dir) -> DataFrame:
    return diff.compare_pairs(diff.paired(base(spark, sf_dir), comp(spark, sf_dir), ["pair_id", "hpid"]), STATIC)


@query(f"WITH {STATIC_SQL} SELECT {COLUMNS} FROM d")
def diff_static(spark, sf_dir):
    return static_diffs(spark, sf_dir).select(*COLUMNS.split(", "))


@query(f"WITH {_diffs_sql(8, 5, False)} SELECT {COLUMNS} FROM d")
def diff_dynamic(spark, sf_dir):
    return diff.compare_pairs(diff.paired(base(spark, sf_dir), comp(spark, sf_dir), ["pair_id", "hpid"]), DYNAMIC).select(*COLUMNS.split(", "))


_PER_ELEMENT = "e AS (SELECT pair_id, b_ord, c_ord, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low, count(*) AS total FROM d GROUP BY ALL)"
_OVERALL = "CASE WHEN critical > 0 THEN 'critical' WHEN high > 0 THEN 'high' WHEN medium > 0 THEN 'medium' ELSE 'low' END"


@query(f"WITH {STATIC_SQL}, {_PER_ELEMENT} SELECT *, {_OVERALL} AS overall FROM e")
def severity_annotated(spark, sf_dir):
    return diff.per_element(static_diffs(spark, sf_dir))


@query(f"""WITH {STATIC_SQL}, {_PER_ELEMENT}, o AS (SELECT *, {_OVERALL} AS overall FROM e), m AS (SELECT pair_id, count(*) AS matched FROM p GROUP BY 1),
g AS (SELECT pair_id, count(*) AS modified, sum(total) AS diffs, count(*) FILTER (overall = 'critical') AS critical, count(*) FILTER (overall = 'high') AS high, count(*) FILTER (overall = 'medium') AS medium, count(*) FILTER (overall = 'low') AS low FROM o GROUP BY 1)
SELECT pair_id, matched, matched - coalesce(modified, 0) AS unchanged, coalesce(modified, 0) AS modified, CAST(coalesce(diffs, 0) AS BIGINT) AS diffs, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low
FROM m LEFT JOIN g USING (pair_id)""")
def severity_summary(spark, sf_dir):
    return diff.summary(by_path(spark, sf_dir), static_diffs(spark, sf_dir))


@query("""WITH v AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)
SELECT l_orderkey AS pair_id, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS b_ord, 'color' AS property FROM v
UNION ALL SELECT l_orderkey, l_partkey * 100000 + l_suppkey * 10 + l_linenumber, 'border-top-color' FROM v WHERE l_partkey % 3 = 0""")
def diff_current_color(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    b_ord = F.col("l_partkey") * 100000 + F.col("l_suppkey") * 10 + F.col("l_linenumber")
    other = F.when(F.col("l_partkey") % 3 == 0, "blue").otherwise("red")
    both = F.explode(F.array(F.struct(F.lit("color").alias("property"), F.lit("red").alias("v")), F.struct(F.lit("border-top-color").alias("property"), other.alias("v")))).alias("e")
    long = rows.select(F.col("l_orderkey").alias("pair_id"), b_ord.alias("b_ord"), b_ord.alias("c_ord"), both).select("pair_id", "b_ord", "c_ord", "e.property", F.col("e.v").alias("base_value"), F.lit("green").alias("compare_value"))
    return diff.drop_current_color(long).select("pair_id", "b_ord", "property")


# --- hierarchy ---

_INHERITED = "('color', 'font-size')"


@query(f"""WITH {STATIC_SQL}, u AS (SELECT k.*, first_value(struct_pack(a := t.base_value, b := t.compare_value)) OVER (PARTITION BY k.pair_id, k.b_ord, k.property ORDER BY t.b_ord) AS theirs,
  row_number() OVER (PARTITION BY k.pair_id, k.b_ord, k.property ORDER BY t.b_ord) AS rn
  FROM d k JOIN d t ON t.pair_id = k.pair_id AND t.property = k.property AND starts_with(k.hpid, t.hpid || '.') WHERE k.property IN {_INHERITED})
SELECT d.pair_id, d.b_ord, d.property, coalesce(u.theirs.a = d.base_value AND u.theirs.b = d.compare_value, false) AS inherited FROM d LEFT JOIN u ON u.pair_id = d.pair_id AND u.b_ord = d.b_ord AND u.property = d.property AND u.rn = 1""")
def cascade_inherited(spark, sf_dir):
    paths = base(spark, sf_dir).select("pair_id", F.col("ord").alias("b_ord"), "hpid")
    return cascade.inherited(static_diffs(spark, sf_dir), paths).select("pair_id", "b_ord", "property", "inherited")


#: Apexes level by level, over a table of which element repeats all changes of which ancestor.
_APEX = f"""WITH RECURSIVE {STATIC_SQL}, x AS (SELECT d.pair_id, b_ord, b.hpid, property, base_value AS a, compare_value AS z, TRY_CAST(regexp_extract(compare_value, '^[-+]?[0-9.]+') AS DOUBLE) - TRY_CAST(regexp_extract(base_value, '^[-+]?[0-9.]+') AS DOUBLE) AS delta FROM d JOIN b ON b.report_id = d.pair_id AND b.ord = d.b_ord),
n AS (SELECT DISTINCT pair_id, hpid FROM x), up AS (SELECT n.pair_id, n.hpid, m.hpid AS above FROM n JOIN n m ON m.pair_id = n.pair_id AND starts_with(n.hpid, m.hpid || '.')), near AS (SELECT pair_id, hpid, arg_max(above, length(above)) AS above FROM up GROUP BY 1, 2),
rep AS (SELECT x.pair_id, x.hpid, up.above, x.property, coalesce(bool_or(CASE WHEN x.property IN ({', '.join(f"'{p}'" for p in cascade.INHERITED_AT_APEX)}) THEN x.a IS NOT DISTINCT FROM t.a AND x.z IS NOT DISTINCT FROM t.z ELSE x.property IN ({', '.join(f"'{p}'" for p in cascade.PROPAGATED)}) AND abs(x.delta - t.delta) <= {cascade.PROPAGATED_PX} END), false) AS alike
  FROM x JOIN up ON up.pair_id = x.pair_id AND up.hpid = x.hpid LEFT JOIN x t ON t.pair_id = x.pair_id AND t.hpid = up.above AND t.property = x.property GROUP BY ALL),
whole AS (SELECT pair_id, hpid, above, bool_and(alike) AS every FROM rep GROUP BY 1, 2, 3),
r(pair_id, hpid, apex, gone) AS (SELECT pair_id, hpid, NULL::VARCHAR, false FROM n ANTI JOIN near USING (pair_id, hpid)
  UNION ALL SELECT near.pair_id, near.hpid, CASE WHEN r.gone THEN r.apex ELSE r.hpid END, whole.every FROM r JOIN near ON near.pair_id = r.pair_id AND near.above = r.hpid JOIN whole ON whole.pair_id = near.pair_id AND whole.hpid = near.hpid AND whole.above = CASE WHEN r.gone THEN r.apex ELSE r.hpid END),
s AS (SELECT x.pair_id, x.b_ord, x.hpid, x.property, coalesce(rep.alike, false) AS suppressed, CASE WHEN rep.alike THEN r.apex END AS apex FROM x JOIN r ON r.pair_id = x.pair_id AND r.hpid = x.hpid LEFT JOIN rep ON rep.pair_id = x.pair_id AND rep.hpid = x.hpid AND rep.above = r.apex AND rep.property = x.property)"""


@query(f"{_APEX} SELECT * FROM s")
def apex_suppression(spark, sf_dir):
    paths = base(spark, sf_dir).select("pair_id", F.col("ord").alias("b_ord"), "hpid")
    return cascade.apex_suppression(static_diffs(spark, sf_dir), paths)


_IS_INHERITED = f"property IN ({', '.join(f"'{p}'" for p in cascade.INHERITED_AT_APEX)})"


@query(f"""{_APEX}, g AS (SELECT pair_id, apex, count(DISTINCT hpid) AS children, count(*) AS suppressed_diffs, count(*) FILTER ({_IS_INHERITED}) AS css, count(*) FILTER (NOT {_IS_INHERITED}) AS box FROM s WHERE suppressed GROUP BY 1, 2)
SELECT pair_id, apex, children, suppressed_diffs, CASE WHEN css > 0 AND box > 0 THEN 'MIXED' WHEN css > 0 THEN 'CSS_INHERIT' ELSE 'LAYOUT_FLOW' END AS kind,
  children || ' child element' || CASE WHEN children = 1 THEN '' ELSE 's' END || ' suppressed (' || css || ' CSS inherited ' || chr(183) || ' ' || box || ' layout reflow)' AS summary FROM g""")
def apex_report(spark, sf_dir):
    return cascade.apex_report(apex_suppression(spark, sf_dir))


@query(f"""WITH {SIDES}, own AS (SELECT DISTINCT report_id AS pair_id, hpid FROM c), up AS (SELECT DISTINCT pair_id, array_to_string(list_slice(string_split(hpid, '.'), 1, CAST(n AS BIGINT)), '.') AS hpid FROM (SELECT *, unnest(range(1, len(string_split(hpid, '.')))) AS n FROM own) x),
every AS (SELECT pair_id, hpid, false AS synthetic FROM own UNION ALL SELECT pair_id, hpid, true FROM up WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.pair_id = up.pair_id AND o.hpid = up.hpid))
SELECT pair_id, hpid, CASE WHEN contains(hpid, '.') THEN regexp_replace(hpid, '\\.[^.]*$', '') END AS parent, synthetic FROM every""")
def diff_tree(spark, sf_dir):
    return cascade.tree(comp(spark, sf_dir))


# --- grouped report ---

_LABEL = "tag || CASE WHEN element_id IS NULL THEN '' ELSE '#' || element_id END || '.' || replace(class_name, ' ', '.')"
_ITEMS = f"""l AS (SELECT report_id AS pair_id, ord AS b_ord, {_LABEL} AS label FROM b),
i AS (SELECT d.pair_id, d.b_ord, min(d.hpid) AS hpid, min(CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END) AS rank, count(*) AS total,
  string_agg(property || '=' || coalesce(base_value, '-') || '>' || coalesce(compare_value, '-'), ';' ORDER BY property) AS sig, string_agg(property, ',' ORDER BY property) AS properties FROM d GROUP BY 1, 2),
g AS (SELECT pair_id, rank, label, sig, min(b_ord) AS b_ord, count(*) AS recurrence, string_agg(hpid, ',' ORDER BY b_ord) AS hpids, min(total) AS total, min(properties) AS properties FROM i JOIN l USING (pair_id, b_ord) GROUP BY 1, 2, 3, 4)"""
_SEVERITY = "CASE rank WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' ELSE 'low' END"


def merged_items(spark, sf_dir, diffs: DataFrame | None = None) -> DataFrame:
    return report.merged(report.items(static_diffs(spark, sf_dir) if diffs is None else diffs, base(spark, sf_dir)))


@query(f"WITH {STATIC_SQL}, {_ITEMS} SELECT pair_id, {_SEVERITY} AS severity, label, b_ord, recurrence, hpids, total FROM g")
def dedupe_recurrence(spark, sf_dir):
    return merged_items(spark, sf_dir).drop("properties")


_BADGE = "CASE WHEN regexp_matches(properties, 'display|width|margin') THEN 'LAYOUT SHIFT' ELSE 'STYLE REGRESSION' END"


@query(f"WITH {STATIC_SQL}, {_ITEMS} SELECT pair_id, b_ord, {_BADGE} AS badge FROM g")
def narrative_badge(spark, sf_dir):
    return merged_items(spark, sf_dir).select("pair_id", "b_ord", report.badge(F.col("properties")).alias("badge"))


@query(f"""WITH {STATIC_SQL}, {_ITEMS}, s AS (SELECT pair_id, count(*) FILTER (rank = 1) AS critical, count(*) FILTER (rank = 2) AS high, count(*) FILTER (rank = 3) AS medium, count(*) FILTER (rank = 4) AS low,
  count(*) FILTER ({_BADGE} = 'LAYOUT SHIFT') AS layout, count(*) FILTER ({_BADGE} <> 'LAYOUT SHIFT') AS style FROM g GROUP BY 1)
SELECT *, (critical * 100 + high * 40 + medium * 15 + low * 3) / 10.0 AS penalty, CAST(greatest(0, floor((1 - (critical * 100 + high * 40 + medium * 15 + low * 3) / 1000.0) * 100 + 0.5)) AS BIGINT) AS impact_score FROM s""")
def impact_score(spark, sf_dir):
    return report.score(merged_items(spark, sf_dir))


@query(f"WITH {STATIC_SQL}, {_ITEMS}, r AS (SELECT pair_id, b_ord, label, total, row_number() OVER (PARTITION BY pair_id ORDER BY total DESC, b_ord) AS rank FROM g) SELECT * FROM r WHERE rank <= 3")
def top_items(spark, sf_dir):
    return report.top(merged_items(spark, sf_dir)).select("pair_id", "b_ord", "label", "total", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {STATIC_SQL} SELECT pair_id, b_ord, property FROM d WHERE severity = 'high' AND category IN ('layout', 'visual') AND property NOT IN ('attr:href', 'attr:src')")
def report_filters(spark, sf_dir):
    d = static_diffs(spark, sf_dir)
    return d.where((F.col("severity") == "high") & F.col("category").isin("layout", "visual") & ~F.col("property").isin("attr:href", "attr:src")).select("pair_id", "b_ord", "property")


@query("""WITH v AS (SELECT p_partkey, p_name AS a, p_name || CASE p_partkey % 3 WHEN 0 THEN ' ' || p_type ELSE ' x' END AS b, 100 AS wa, 100 + p_size AS wb FROM part),
t AS (SELECT *, CAST(levenshtein(a, b) AS DOUBLE) / length(b) * CASE WHEN length(b) < 8 THEN 0.3 ELSE 1 END AS d, least(CAST(length(b) AS DOUBLE) / length(a), 4.0) AS r, wb / 100.0 AS s FROM v),
e AS (SELECT *, least(abs(r - s) / greatest(r, s, 1.0), 1.0) AS err FROM t),
c AS (SELECT *, d * 0.5 + (1 - err) * 0.3 + 0.2 AS content, (1 - d) * 0.4 + err * 0.35 AS layout FROM e)
SELECT p_partkey, CAST(floor(d * 10000 + 0.5) AS BIGINT) AS divergence, CASE WHEN err < 0.2 THEN 'PROPORTIONAL' WHEN err > 0.65 THEN 'DISPROPORTIONAL' ELSE 'AMBIGUOUS' END AS signal,
  CASE WHEN content >= 0.65 THEN 'DEMOTE' WHEN content >= 0.45 AND content > layout THEN 'SOFT_DEMOTE' WHEN layout >= 0.65 THEN 'RETAIN' ELSE 'SOFT_DEMOTE' END AS action FROM c""")
def content_intelligence(spark, sf_dir):
    a, b = F.col("p_name"), F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), "p_type")).otherwise(" x"))
    before, after = F.lit("100.00px"), F.concat((100 + F.col("p_size")).cast("string"), F.lit(".00px"))
    d, e = report.text_divergence(a, b), report.proportion_error(a, b, before, after)
    # the generator makes columns of the two scores, which the verdict reads many times
    scored = read(spark, sf_dir, "part").select("p_partkey", F.inline(F.array(F.struct(d.alias("d"), e.alias("e")))))
    verdict = report.content_or_layout(F.col("d"), F.col("e.error"), F.lit(1), F.lit("high"))
    return scored.select("p_partkey", F.floor(F.col("d") * 10000 + 0.5).alias("divergence"), F.col("e.signal").alias("signal"), verdict["action"].alias("action"))


# --- addresses and rectangles ---

_PATH = "CASE WHEN regexp_replace(lower(regexp_extract({u}, '^[^:]+://[^/?#]*([^?#]*)', 1)), '/$', '') = '' THEN '/' ELSE regexp_replace(lower(regexp_extract({u}, '^[^:]+://[^/?#]*([^?#]*)', 1)), '/$', '') END"
_PARAMS = "list_sort(list_filter(string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(split_part(p, '=', 1)), '^(utm_.*|gclid|gad_source|fbclid|msclkid|_ga|_gl)$')))"


@query(f"""WITH v AS (SELECT page_id, url AS a, CASE page_id % 4 WHEN 0 THEN replace(url, 'https:', 'http:') WHEN 1 THEN url || '/x' WHEN 2 THEN split_part(split_part(url, '#', 1), '?', 1) || '?utm_medium=m' ELSE 'no url' END AS b FROM pages)
SELECT page_id, CASE WHEN b = 'no url' OR {_PATH.format(u='a')} <> {_PATH.format(u='b')} THEN 'INCOMPATIBLE' WHEN regexp_extract(a, '(#.+)$', 1) = regexp_extract(b, '(#.+)$', 1) AND {_PARAMS.format(u='a')} = {_PARAMS.format(u='b')} THEN 'COMPATIBLE' ELSE 'CAUTION' END AS classification FROM v""")
def url_compat(spark, sf_dir):
    kind, url = F.col("page_id") % 4, F.col("url")
    bare = F.concat(F.regexp_extract(url, "^([^?#]*)", 1), F.lit("?utm_medium=m"))
    other = F.when(kind == 0, F.replace(url, F.lit("https:"), F.lit("http:"))).when(kind == 1, F.concat(url, F.lit("/x"))).when(kind == 2, bare).otherwise("no url")
    return urls.compatibility(read(spark, sf_dir, "pages").select("page_id", "url", other.alias("other")), "url", "other").select("page_id", "classification")


def placed(spark, sf_dir) -> DataFrame:
    high = F.max(F.col("rect.y") + F.col("rect.height")).over(Window.partitionBy("pair_id"))
    return base(spark, sf_dir).select("pair_id", "ord", "hpid", F.col("rect.y").alias("document_y"), F.col("rect.height").alias("height"), high.alias("document_height"))


@query(f"WITH {SIDES} SELECT report_id AS pair_id, split_part(hpid, '.', 1) AS root, min(y) AS top, max(y + height) AS bottom, count(*) AS n FROM b GROUP BY 1, 2")
def keyframe_clusters(spark, sf_dir):
    return visual.clusters(placed(spark, sf_dir))


_CLAMP = "CASE WHEN total <= 120 THEN 0 ELSE floor(greatest(0, least({}, total - 120))) END"


@query(f"""WITH RECURSIVE {SIDES}, e AS (SELECT report_id, ord, (ord - 1) // 4 AS root, y, height, max(y + height) OVER (PARTITION BY report_id) AS total FROM b),
k AS (SELECT report_id, root, min(y) AS top, max(y + height) AS low, min(ord) AS first, max(total) AS total FROM e GROUP BY 1, 2),
p AS (SELECT e.*, row_number() OVER (PARTITION BY e.report_id, e.root ORDER BY y, ord) AS i, {_CLAMP.format("y - 40")} AS scroll FROM e JOIN (SELECT report_id, root FROM k WHERE low - top > 120) z USING (report_id, root)),
nx AS (SELECT p.report_id, p.root, p.i, min(q.i) AS next FROM p JOIN p q ON q.report_id = p.report_id AND q.root = p.root AND q.i > p.i AND q.y >= p.scroll + 120 GROUP BY 1, 2, 3),
s AS (SELECT report_id, root, 1::BIGINT AS i, 0 AS f FROM p WHERE i = 1 UNION ALL SELECT nx.report_id, nx.root, nx.next, f + 1 FROM s JOIN nx ON nx.report_id = s.report_id AND nx.root = s.root AND nx.i = s.i),
m AS (SELECT p.report_id, p.root, p.ord, max(s.f) AS f, arg_max(q.scroll, s.f) AS scroll FROM p JOIN s ON s.report_id = p.report_id AND s.root = p.root AND s.i <= p.i JOIN p q ON q.report_id = s.report_id AND q.root = s.root AND q.i = s.i GROUP BY 1, 2, 3
  UNION ALL SELECT e.report_id, e.root, e.ord, 0, {_CLAMP.format("(k.top + k.low) / 2 - 60").replace("total", "k.total")} FROM e JOIN k ON k.report_id = e.report_id AND k.root = e.root WHERE low - top <= 120),
o AS (SELECT m.report_id, m.root, max(f) + 1 AS n, min(top) AS top, min(first) AS first FROM m JOIN k ON k.report_id = m.report_id AND k.root = m.root GROUP BY 1, 2), w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY report_id ORDER BY top, first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM o)
SELECT m.report_id AS pair_id, m.ord, CAST(before + f AS BIGINT) AS frame, CAST(scroll AS BIGINT) AS scroll_y FROM m JOIN w ON w.report_id = m.report_id AND w.root = m.root""")
def keyframe_pack(spark, sf_dir):
    """Four elements each to a cluster: some fit the viewport, some do not."""
    root = F.floor((F.col("ord") - 1) / 4).cast("string")
    return visual.keyframes(placed(spark, sf_dir).withColumn("hpid", F.concat_ws(".", root, "hpid")), 120)


@query(f"""WITH {SIDES}, r AS (SELECT report_id AS pair_id, ord, y - 60 AS viewport_y, height, k % 10 <> 0 AS found FROM b), q AS (SELECT *, greatest(0, viewport_y) AS top, least(viewport_y + height, 100) AS bottom FROM r)
SELECT pair_id, ord, CASE WHEN found AND bottom > 0 THEN top END AS clipped_y, CASE WHEN found AND bottom > 0 THEN greatest(1, bottom - top) END AS clipped_height,
  CASE WHEN NOT found THEN false WHEN bottom <= 0 THEN true ELSE greatest(1, bottom - top) < height END AS clipped, CASE WHEN NOT found THEN 'element-not-found' WHEN bottom <= 0 THEN 'clipped-below-fold' END AS misaligned FROM q""")
def rect_clip(spark, sf_dir):
    k = F.regexp_extract("text_content", r"(\d+)", 1).cast("long")
    rects = base(spark, sf_dir).select("pair_id", "ord", (F.col("rect.y") - 60).alias("viewport_y"), F.col("rect.height").alias("height"), (k % 10 != 0).alias("found"))
    return visual.clip(rects, 100).drop("viewport_y", "height", "found")


@query(f"""WITH {SIDES}, r AS (SELECT report_id, tag, 'baseline' AS role, width, ord FROM b UNION ALL SELECT report_id, tag, 'compare', width, ord FROM c)
SELECT report_id AS pair_id, tag AS tag_name, arg_max(width, ord) FILTER (role = 'baseline') AS baseline, arg_max(width, ord) FILTER (role = 'compare') AS compare FROM r GROUP BY 1, 2""")
def rect_pivot(spark, sf_dir):
    side = lambda d, role: d.select("pair_id", "tag_name", F.lit(role).alias("role"), F.col("rect.width").alias("width"), "ord")
    both = side(base(spark, sf_dir), "baseline").unionByName(side(comp(spark, sf_dir), "compare"))
    return tables.role_pivot(both, ["pair_id", "tag_name"], "role", "width", "ord")


@query(f"WITH {SIDES} SELECT coalesce(b.report_id, c.report_id) AS pair_id, coalesce(b.hpid, c.hpid) AS hpid, b.x AS base_x, b.y AS base_y, c.x AS compare_x, c.y AS compare_y FROM b FULL JOIN c ON b.report_id = c.report_id AND b.hpid = c.hpid")
def visual_manifest(spark, sf_dir):
    flat = lambda d: d.select("pair_id", "hpid", "rect.x", "rect.y")
    return visual.manifest(flat(base(spark, sf_dir)), flat(comp(spark, sf_dir)), ["pair_id", "hpid"], ["x", "y"])


# --- storage, export, operations ---


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def retention_reports(spark, sf_dir):
    return tables.newest(read(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey", DEFAULT.max_reports).select("o_orderkey", "o_orderdate")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) r WHERE rn = 1 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def upsert_comparisons(spark, sf_dir):
    return tables.upsert(read(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey", DEFAULT.max_comparisons).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 1) AND l_suppkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def delete_cascade(spark, sf_dir):
    gone = read(spark, sf_dir, "part").where("p_size = 1").select("p_partkey")
    return tables.without_reports(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"), gone, "l_partkey", "l_suppkey")


@query('''SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN chr(39) || '=' || p_name WHEN 2 THEN '"' || p_name || ', ' || p_type || '"' WHEN 3 THEN '"a ""' || p_name || '""' || '"' ELSE '' END AS field FROM part''')
def csv_rows(spark, sf_dir):
    n = F.col("p_name")
    raw = F.get(F.array(n, F.concat(F.lit("="), n), F.concat(n, F.lit(", "), "p_type"), F.concat(F.lit('a "'), n, F.lit('"')), F.lit(None).cast("string")), (F.col("p_partkey") % 5).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", report.csv_field(raw).alias("field"))


@query(f"WITH {STATIC_SQL}, s AS (SELECT pair_id, b_ord, string_agg(property, ', ' ORDER BY property) AS changed FROM d GROUP BY 1, 2) SELECT s.pair_id, s.b_ord, changed, tag AS tag_name, tag || '.' || split_part(class_name, ' ', 1) AS selector FROM s JOIN b ON b.report_id = s.pair_id AND b.ord = s.b_ord")
def mini_html_rows(spark, sf_dir):
    return report.short_list(static_diffs(spark, sf_dir), base(spark, sf_dir))


@query(f"WITH {SIDES} SELECT report_id AS pair_id, ord, width || 'px' AS width, margin || 'px' AS margin_top, display, coalesce(opacity, '') AS opacity FROM b")
def style_pivot(spark, sf_dir):
    return tables.style_columns(base(spark, sf_dir), ["pair_id", "ord"], ["width", "margin-top", "display", "opacity"])


@query("""WITH t AS (SELECT event_type, count(*) AS n, sum(value) AS s, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1), r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT event_type, max(n) AS count, CAST(floor(max(s) + 0.5) AS BIGINT) AS total, CAST(floor(max(s / n) + 0.5) AS BIGINT) AS average, CAST(floor(max(lo) + 0.5) AS BIGINT) AS min, CAST(floor(max(hi) + 0.5) AS BIGINT) AS max,
  CAST(floor(sqrt(avg((value - s / n) * (value - s / n))) + 0.5) AS BIGINT) AS std_dev, CAST(floor(quantile_disc(value, 0.5) + 0.5) AS BIGINT) AS p50, CAST(floor(quantile_disc(value, 0.95) + 0.5) AS BIGINT) AS p95, CAST(floor(quantile_disc(value, 0.99) + 0.5) AS BIGINT) AS p99
FROM r JOIN t USING (event_type) WHERE rn <= 100 GROUP BY 1""")
def perf_stats(spark, sf_dir):
    return stats.durations(read(spark, sf_dir, "events"), "event_type", "value", "ts", "event_id")


@query("SELECT event_type, user_id, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2 ORDER BY last_seen DESC, event_type, user_id LIMIT 100")
def error_rollup(spark, sf_dir):
    return stats.errors(read(spark, sf_dir, "events"), "event_type", "user_id", "ts")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) / 1000000.0 AS t, event_type NOT IN ('view', 'error') AS visual, min(epoch_us(ts)) OVER (PARTITION BY user_id) / 1000000.0 AS started FROM events),
w AS (SELECT *, t - started AS since FROM e WHERE t - started <= 200000), m AS (SELECT user_id, since FROM w WHERE visual UNION ALL SELECT DISTINCT user_id, 0.0 FROM w),
g AS (SELECT user_id, since, lead(since) OVER (PARTITION BY user_id ORDER BY since) - since AS gap FROM m), q AS (SELECT user_id, min(since + 50000) AS quiet FROM g WHERE coalesce(gap >= 50000, true) AND since + 50000 <= 200000 GROUP BY 1),
n AS (SELECT w.user_id, max(coalesce(quiet, 200000)) AS settled, count(*) FILTER (NOT visual AND since < coalesce(quiet, 200000)) AS noise, max(quiet) AS quiet FROM w LEFT JOIN q USING (user_id) GROUP BY 1)
SELECT user_id, CAST(floor(settled + 0.5) AS BIGINT) AS settled, noise, CASE WHEN quiet IS NULL THEN 'DEGRADED' WHEN noise > 0 THEN 'STABLE' ELSE 'OPTIMAL' END AS quality FROM n""")
def readiness_sessions(spark, sf_dir):
    log = read(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0)
    done = readiness.replay(log, "user_id", "at", ~F.col("event_type").isin("view", "error"), 50000, 200000)
    return done.select("user_id", F.floor(F.col("settled") + 0.5).alias("settled"), "noise", "quality")


@query(SQL["readiness_sessions"])
def readiness_live(spark, sf_dir):
    """The verdicts of ``readiness_sessions``, from a stream with timers."""
    done = readiness.run_live(spark, f"{sf_dir}/events.parquet", "user_id", "ts", ~F.col("event_type").isin("view", "error"), 50000, 200000, "1 hour")
    return done.select("user_id", F.floor(F.col("settled") + 0.5).alias("settled"), "noise", "quality")


@query("""WITH v AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE event_type NOT IN ('view', 'error')),
g AS (SELECT *, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM v)
SELECT user_id, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) + 1800000000 AS end_us, count(*) AS events FROM g GROUP BY user_id, burst""")
def readiness_stream(spark, sf_dir):
    done = readiness.run_sessions(spark, f"{sf_dir}/events.parquet", "user_id", "ts", ~F.col("event_type").isin("view", "error"), "30 minutes", "1 hour")
    return done.select("user_id", F.unix_micros("start").alias("first_us"), F.unix_micros("end").alias("end_us"), "events")


@query()
def dom_elements(spark, sf_dir):
    return html.elements(read(spark, sf_dir, "pages"))


@query()
def compare_plan(spark, sf_dir):
    """The whole comparison: matched by anchors and document order, inherited diffs suppressed, scored."""
    return plan.compare(base(spark, sf_dir), comp(spark, sf_dir))["score"]


flagship = severity_summary
