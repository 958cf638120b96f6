"""Registered queries of filtered and shadow traversal, ancestors, tree expansion, badges, pseudo-elements and whole payloads, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import fixtures
from ..operators import cascade, diff, filters, grouped, match, pseudo, report, selectors
from ..sources import exports, html
from ..sources.tables import written
from .catalog import _APEX, _ITEMS, _OVERALL, _PER_ELEMENT, SIDES, SQL, STATIC_SQL, base, by_path, comp, merged_items, query, read, static_diffs
from .catalog_reports import _CHANGED, _changed, _items_and_judged, compared_once


@query(f"""WITH {SIDES}, m AS (SELECT * FROM b WHERE list_contains(string_split(class_name, ' '), 'c1') OR tag = 'p'), t AS (SELECT report_id, hpid, row_number() OVER (PARTITION BY report_id ORDER BY ord) AS n FROM m WHERE NOT EXISTS (SELECT 1 FROM m o WHERE o.report_id = m.report_id AND starts_with(m.hpid, o.hpid || '.')))
SELECT b.report_id AS pair_id, b.ord, CAST(n AS VARCHAR) || substr(b.hpid, length(t.hpid) + 1) AS hpid, b.hpid AS absolute_hpid, len(string_split(b.hpid, '.')) - len(string_split(t.hpid, '.')) AS depth FROM b JOIN t ON t.report_id = b.report_id AND (b.hpid = t.hpid OR starts_with(b.hpid, t.hpid || '.'))""")
def filtered_roots(spark, sf_dir):
    elements = base(spark, sf_dir)
    candidates = elements.where(filters.expression_filter(classes=".c1", tags="p")).select("pair_id", "ord", "hpid")
    return filters.rerooted(elements, candidates).select("pair_id", "ord", "hpid", "absolute_hpid", "depth")


@query(f"""WITH {_CHANGED}, s AS (SELECT pair_id, hpid, severity FROM ch), own AS (SELECT DISTINCT pair_id, hpid FROM s), up AS (SELECT DISTINCT pair_id, array_to_string(list_slice(string_split(hpid, '.'), 1, CAST(n AS BIGINT)), '.') AS hpid FROM (SELECT *, unnest(range(1, len(string_split(hpid, '.')))) AS n FROM own) x),
t AS (SELECT pair_id, hpid, false AS synthetic FROM own UNION ALL SELECT pair_id, hpid, true FROM up WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.pair_id = up.pair_id AND o.hpid = up.hpid)),
k AS (SELECT t.pair_id, t.hpid, any_value(t.synthetic) AS synthetic, count(DISTINCT x.hpid) AS children FROM t LEFT JOIN t x ON x.pair_id = t.pair_id AND regexp_replace(x.hpid, '\\.[^.]*$', '') = t.hpid AND contains(x.hpid, '.') GROUP BY 1, 2)
SELECT pair_id, hpid, synthetic, children, children > 0 AND EXISTS (SELECT 1 FROM s WHERE s.pair_id = k.pair_id AND (s.hpid = k.hpid OR starts_with(s.hpid, k.hpid || '.')) AND severity IN ('critical', 'high')) AS expand FROM k""")
def tree_expanded(spark, sf_dir):
    return cascade.expanded(fixtures.kept_pairs(_changed(spark, sf_dir).select("pair_id", "hpid", "severity"), sf_dir))


#: Elements of which some have no class, no stable attribute, or a landmark's tag.
_HOLDERS = f"h AS (SELECT report_id, ord, hpid, CASE tag WHEN 'div' THEN 'section' WHEN 'p' THEN 'form' ELSE tag END AS tag, CASE WHEN ord % 2 = 0 THEN class_name END AS class_name, CASE WHEN test_attr <> '12345678' THEN test_attr END AS test_attr, data_k FROM ({fixtures.selector_sql()}) x)"
_BEST = "CASE WHEN test_attr IS NOT NULL THEN 'data-testid' WHEN class_name IS NOT NULL THEN 'class' WHEN data_k IS NOT NULL THEN 'data-k' END AS name, coalesce(test_attr, class_name, data_k) AS value"
_ANCESTORS = f"""WITH {_HOLDERS}, s AS (SELECT *, {_BEST} FROM h), a AS (SELECT e.report_id AS pair_id, e.ord, len(string_split(e.hpid, '.')) - len(string_split(u.hpid, '.')) - 1 AS level, u.hpid AS up, u.tag AS tag_name, u.name, u.value FROM h e JOIN s u ON u.report_id = e.report_id AND starts_with(e.hpid, u.hpid || '.') AND u.name IS NOT NULL)"""


def _holders(spark, sf_dir):
    tag = F.col("tag_name")
    renamed = F.when(tag == "div", "section").when(tag == "p", "form").otherwise(tag)
    return fixtures.selector_elements(spark, sf_dir).withColumns({"tag_name": renamed, "class_name": F.when(F.col("ord") % 2 == 0, F.col("class_name")), "attributes": F.map_filter("attributes", lambda k, _: k != "title")})


@query(f"{_ANCESTORS} SELECT * FROM a WHERE level < 2")
def stable_ancestor_chain(spark, sf_dir):
    return selectors.stable_ancestors(_holders(spark, sf_dir), 2)


@query(f"{_ANCESTORS} SELECT pair_id, ord, arg_min(up, level) AS up, arg_min(name, level) AS name, arg_min(value, level) AS value FROM a WHERE level < 8 AND tag_name IN ('section', 'form') GROUP BY 1, 2")
def semantic_ancestors(spark, sf_dir):
    return selectors.semantic_ancestor(_holders(spark, sf_dir))


#: Pseudo-elements of the fixture: shown, without content, with another width, on one side only.
_PSEUDO = {"base": "k", "compare": "k + ord"}


def _pseudo_side(spark, sf_dir, side: str):
    n = F.expr(_PSEUDO[side])
    of = lambda content, width: F.create_map(F.lit("content"), content, F.lit("width"), F.concat(width.cast("string"), F.lit("px")), F.lit("cursor"), F.lit("none"))
    before = F.when(n % 3 != 0, of(F.when(n % 3 == 1, F.lit("none")).otherwise(F.lit("'x'")), n % 4))
    after = F.when(n % 5 != 0, of(F.concat(F.lit("'"), (n % 2).cast("string"), F.lit("'")), F.lit(7)))
    return fixtures.raw(spark, sf_dir, side).select(F.col("report_id").alias("pair_id"), "hpid", F.map_filter(F.create_map(F.lit("::before"), before, F.lit("::after"), after), lambda _, v: v.isNotNull()).alias("pseudo"))


def _pseudo_sql() -> str:
    side = lambda t: f"""SELECT report_id, hpid, '::before' AS name, property, value FROM (SELECT report_id, hpid, unnest([struct_pack(property := 'content', value := chr(39) || 'x' || chr(39)), struct_pack(property := 'width', value := n % 4 || 'px')], recursive := true) FROM (SELECT *, {_PSEUDO['base' if t == 'b' else 'compare']} AS n FROM {t}) z WHERE n % 3 = 2) y
  UNION ALL SELECT report_id, hpid, '::after', property, value FROM (SELECT report_id, hpid, unnest([struct_pack(property := 'content', value := chr(39) || n % 2 || chr(39)), struct_pack(property := 'width', value := '7px')], recursive := true) FROM (SELECT *, {_PSEUDO['base' if t == 'b' else 'compare']} AS n FROM {t}) z WHERE n % 5 <> 0) y"""  # noqa: E731
    return f"""{SIDES}, both_sides AS (SELECT b.report_id, b.hpid FROM b JOIN c ON b.report_id = c.report_id AND b.hpid = c.hpid), pb AS ({side('b')}), pc AS ({side('c')}),
ps AS (SELECT coalesce(x.report_id, y.report_id) AS pair_id, coalesce(x.hpid, y.hpid) AS element, coalesce(x.name, y.name) AS name, coalesce(x.property, y.property) AS property, x.value AS base_value, y.value AS compare_value FROM pb x FULL JOIN pc y ON x.report_id = y.report_id AND x.hpid = y.hpid AND x.name = y.name AND x.property = y.property WHERE x.value IS DISTINCT FROM y.value),
pd AS (SELECT pair_id, element || name AS hpid, property, base_value, compare_value, CASE WHEN base_value IS NULL THEN 'added' WHEN compare_value IS NULL THEN 'removed' ELSE 'modified' END AS type FROM ps SEMI JOIN both_sides ON both_sides.report_id = ps.pair_id AND both_sides.hpid = ps.element)"""


@query(f"WITH {_pseudo_sql()} SELECT * FROM pd")
def pseudo_styles(spark, sf_dir):
    return pseudo.compare(_pseudo_side(spark, sf_dir, "base"), _pseudo_side(spark, sf_dir, "compare"))


_LAYOUT_BADGE = "WHEN bool_or(regexp_matches(property, 'position|display|flex|grid|float|overflow|visibility|z-index|^width$|^height$|max-width|min-width|^margin|^padding')) THEN 'LAYOUT SHIFT' WHEN bool_or(regexp_matches(property, '^top$|^left$|^right$|^bottom$|transform')) THEN 'POSITION DRIFT' ELSE 'STYLE REGRESSION' END"


@query(f"""WITH {STATIC_SQL.removeprefix(SIDES + ', ')}, {_pseudo_sql().removeprefix(SIDES + ', ')} SELECT d.pair_id, b.hpid, CASE WHEN d.b_ord % 4 = 0 THEN 'CONTENT DIVERGENCE' {_LAYOUT_BADGE} AS badge FROM d JOIN b ON b.report_id = d.pair_id AND b.ord = d.b_ord GROUP BY d.pair_id, d.b_ord, b.hpid
UNION ALL SELECT DISTINCT pair_id, hpid, 'PSEUDO' FROM pd UNION ALL SELECT report_id, hpid, 'DOM DELETION' FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.report_id = b.report_id AND c.hpid = b.hpid)
UNION ALL SELECT report_id, hpid, 'DOM INSERTION' FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE c.report_id = b.report_id AND c.hpid = b.hpid)""".replace("WITH ", f"WITH {SIDES}, ", 1))
def tree_badges(spark, sf_dir):
    """Badges of every kind of tree node: changed elements (content or not), pseudo-elements, deleted and inserted elements."""
    b, c = base(spark, sf_dir).select("pair_id", "ord", "hpid"), comp(spark, sf_dir).select("pair_id", "hpid")
    properties = static_diffs(spark, sf_dir).groupBy("pair_id", "b_ord").agg(F.collect_set("property").alias("properties"))
    none = F.lit(None).cast("array<string>").alias("properties")
    node = lambda severity, content=False: [F.lit(severity).alias("severity"), F.lit(content).alias("content")]
    changed = properties.join(b.withColumnRenamed("ord", "b_ord"), ["pair_id", "b_ord"]).select("pair_id", "hpid", "properties", F.lit("high").alias("severity"), (F.col("b_ord") % 4 == 0).alias("content"))
    made = pseudo_styles(spark, sf_dir).select("pair_id", "hpid").distinct().select("pair_id", "hpid", none, *node("low"))
    gone = b.drop("ord").join(c, ["pair_id", "hpid"], "left_anti").select("pair_id", "hpid", none, *node("removed"))
    new = c.join(b, ["pair_id", "hpid"], "left_anti").select("pair_id", "hpid", none, *node("added"))
    rows = changed.unionByName(made).unionByName(gone).unionByName(new)
    return rows.select("pair_id", "hpid", report.narrative_badge(F.col("hpid"), F.col("severity"), F.col("properties"), F.col("content")).alias("badge"))


def _json_sql() -> str:
    q = lambda v: f"CASE WHEN {v} IS NULL THEN 'null' ELSE to_json({v})::VARCHAR END"
    side = "'{{\"url\":' || to_json({0}.o_orderstatus)::VARCHAR || ',\"elements\":' || {0}.n || '}}'"
    return f"""WITH {STATIC_SQL}, {_PER_ELEMENT}, o AS (SELECT *, {_OVERALL} AS overall FROM e), m AS (SELECT pair_id, count(*) AS matched FROM p GROUP BY 1),
gs AS (SELECT pair_id, count(*) AS modified, CAST(sum(total) AS BIGINT) AS diffs, count(*) FILTER (overall = 'critical') AS critical, count(*) FILTER (overall = 'high') AS high, count(*) FILTER (overall = 'medium') AS medium, count(*) FILTER (overall = 'low') AS low FROM o GROUP BY 1),
s AS (SELECT m.pair_id, matched, coalesce(modified, 0) AS modified, coalesce(diffs, 0) AS diffs, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low FROM m LEFT JOIN gs USING (pair_id)),
st AS (SELECT o_orderkey, min(o_orderstatus) AS o_orderstatus FROM orders GROUP BY 1), rb AS (SELECT report_id, min(o_orderstatus) AS o_orderstatus, count(*) AS n FROM b JOIN st ON o_orderkey = report_id GROUP BY 1), rc AS (SELECT report_id, min(o_orderstatus) AS o_orderstatus, count(*) AS n FROM c JOIN st ON o_orderkey = report_id GROUP BY 1),
j AS (SELECT pair_id, b_ord, string_agg('{{"property":' || {q('property')} || ',"baseValue":' || {q('base_value')} || ',"compareValue":' || {q('compare_value')} || ',"type":' || {q('type')} || ',"category":' || {q('category')} || ',"severity":' || {q('severity')} || '}}', ',' ORDER BY property) AS l FROM d GROUP BY 1, 2),
r AS (SELECT p.pair_id, '{{"hpid":"' || p.hpid || '","tagName":"' || (p.x).tag || '","strategy":"absolute-hpid","confidence":0.95,"differences":[' || coalesce(l, '') || ']}}' AS line, row_number() OVER (PARTITION BY p.pair_id ORDER BY p.b_ord) AS i FROM p LEFT JOIN j USING (pair_id, b_ord)),
u AS (SELECT report_id AS pair_id, '{{"status":"removed","hpid":"' || hpid || '","tagName":"' || tag || '"}}' AS line, row_number() OVER (PARTITION BY report_id ORDER BY ord) AS i FROM b WHERE report_id IN (SELECT pair_id FROM s) AND NOT EXISTS (SELECT 1 FROM c WHERE c.report_id = b.report_id AND c.hpid = b.hpid))
SELECT s.pair_id, 0 AS part, '{{"exportVersion":"1.0","baseline":' || coalesce({side.format('rb')}, 'null') || ',"compare":' || coalesce({side.format('rc')}, 'null') || ',"mode":"static","comparison":{{"summary":{{"matched":' || matched || ',"unchanged":' || matched - modified || ',"modified":' || modified || ',"diffs":' || diffs || ',"critical":' || critical || ',"high":' || high || ',"medium":' || medium || ',"low":' || low || '}},"results":[' AS line
  FROM s LEFT JOIN rb ON rb.report_id = s.pair_id LEFT JOIN rc ON rc.report_id = s.pair_id
UNION ALL SELECT pair_id, 1, CASE WHEN i > 1 THEN ',' ELSE '' END || line FROM r UNION ALL SELECT pair_id, 2, ']}},"unmatchedElements":[' FROM s UNION ALL SELECT pair_id, 3, CASE WHEN i > 1 THEN ',' ELSE '' END || line FROM u UNION ALL SELECT pair_id, 4, ']}}' FROM s"""


@query(_json_sql())
def comparison_json_lines(spark, sf_dir):
    b, c = base(spark, sf_dir), comp(spark, sf_dir)
    matches, diffs = by_path(spark, sf_dir), fixtures.kept_pairs(static_diffs(spark, sf_dir), sf_dir)
    matched = matches.join(b.select("pair_id", F.col("ord").alias("b_ord"), "hpid", "tag_name"), ["pair_id", "b_ord"]).withColumns({"strategy": F.lit("absolute-hpid"), "confidence": F.lit(0.95)})
    alone = b.join(c.select("pair_id", "hpid").distinct(), ["pair_id", "hpid"], "left_anti").withColumn("status", F.lit("removed"))
    status = read(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("pair_id")).agg(F.min("o_orderstatus").alias("url"))
    side = lambda d, name: d.groupBy("pair_id").agg(F.count("*").alias("elements")).join(status, "pair_id").select("pair_id", F.struct("url", "elements").alias(name))
    reports = side(b, "baseline").join(side(c, "compare"), "pair_id", "full")
    return exports.comparison_json(diff.summary(matches, diffs), reports, diffs, matched, alone, "static").select("pair_id", "part", "line")


@query()
def shadow_elements(spark, sf_dir):
    """The elements of all pages whose articles stand in open shadow roots, with the selectors of their hosts."""
    shadowed = F.replace(F.replace("html", F.lit("<article"), F.lit('<div id="host"><template shadowrootmode="open"><p>first</p><article')), F.lit("</article>"), F.lit("</article></template><i>light</i></div>"))
    rows = written(html.elements(read(spark, sf_dir, "pages").select("page_id", shadowed.alias("html"))))
    hosts = selectors.shadow_path(rows.withColumnRenamed("page_id", "pair_id"))
    return rows.join(hosts.select(F.col("pair_id").alias("page_id"), "ord", F.array_join("hosts", " ").alias("hosts")), ["page_id", "ord"], "left").select("page_id", "ord", "hpid", "depth", "tag_name", "text_content", "hosts")


@query(f"""WITH s AS ({SQL['impact_score']}), k AS ({SQL['change_distribution']}), n AS (SELECT *, greatest(layout + style + content + dom, 1) AS total FROM k),
p AS (SELECT pair_id, CAST(floor(layout * 1.0 / total * 100 + 0.5) AS BIGINT) AS layout, CAST(floor(style * 1.0 / total * 100 + 0.5) AS BIGINT) AS style, CAST(floor(content * 1.0 / total * 100 + 0.5) AS BIGINT) AS content FROM n)
SELECT pair_id, coalesce(impact_score, 100) AS score, CASE WHEN coalesce(impact_score, 100) >= 90 THEN 'score-great' WHEN coalesce(impact_score, 100) >= 70 THEN 'score-good' WHEN coalesce(impact_score, 100) >= 50 THEN 'score-warn' ELSE 'score-bad' END AS class,
  p.layout, p.style, p.content, greatest(0, 100 - p.layout - p.style - p.content) AS dom FROM p LEFT JOIN s USING (pair_id)""")
def executive_report(spark, sf_dir):
    """Score and shares of the kinds of change of every report; elements without a partner alone leave the score whole."""
    items, judged = _items_and_judged(spark, sf_dir)
    b, c = base(spark, sf_dir).select("pair_id", "hpid"), comp(spark, sf_dir).select("pair_id", "hpid")
    alone = b.join(c, ["pair_id", "hpid"], "left_anti").unionByName(c.join(b, ["pair_id", "hpid"], "left_anti"))
    kinds = fixtures.kept_pairs(report.distribution(grouped.rebucketed(items, judged), alone), sf_dir)
    score = F.coalesce("impact_score", F.lit(100))
    joined = kinds.join(report.score(items).select("pair_id", "impact_score"), "pair_id", "left")
    return joined.select("pair_id", score.alias("score"), grouped.score_class(score).alias("class"), F.inline(F.array(grouped.shares(F.col("layout"), F.col("style"), F.col("content"), F.col("dom")))))


@query(f"""{_APEX}, {_ITEMS}, ap AS (SELECT pair_id, apex, count(*) AS suppressed FROM s WHERE suppressed GROUP BY 1, 2), own AS (SELECT g.pair_id, g.b_ord, g.total, ap.suppressed, ap.apex IS NOT NULL AS is_apex FROM g JOIN b ON b.report_id = g.pair_id AND b.ord = g.b_ord LEFT JOIN ap ON ap.pair_id = g.pair_id AND ap.apex = b.hpid),
had AS (SELECT *, bool_or(is_apex) OVER (PARTITION BY pair_id) AS any_apex FROM own), ranked AS (SELECT pair_id, b_ord, total, is_apex, row_number() OVER (PARTITION BY pair_id ORDER BY CASE WHEN any_apex THEN suppressed ELSE total END DESC, b_ord) AS rank FROM had WHERE is_apex OR NOT any_apex) SELECT * FROM ranked WHERE rank <= 3""")
def top_apexes_of_reports(spark, sf_dir):
    """The apexes that took over most diffs of the elements below them, by the suppression of the same report."""
    diffs, elements = fixtures.kept_pairs(static_diffs(spark, sf_dir), sf_dir), base(spark, sf_dir)
    paths = elements.select("pair_id", F.col("ord").alias("b_ord"), "hpid")
    apexes = cascade.apex_report(cascade.apex_suppression(diffs, paths)).select("pair_id", F.col("apex").alias("hpid"), F.col("suppressed_diffs").alias("suppressed"))
    items = merged_items(spark, sf_dir, diffs).join(paths, ["pair_id", "b_ord"]).join(apexes, ["pair_id", "hpid"], "left").withColumn("is_apex", F.col("suppressed").isNotNull())
    return report.top_apexes(items).select("pair_id", "b_ord", "total", "is_apex", F.col("rank").cast("long").alias("rank"))


def _workbook_sql() -> str:
    cells = lambda *x: "concat_ws('|', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in x) + ")"
    names = lambda x: "'" + "|".join(x) + "'"
    element = ["b.hpid", "b.tag", "b.element_id", "b.class_name"]
    joined = "d JOIN b ON b.report_id = d.pair_id AND b.ord = d.b_ord"
    facts = ["'Field|Value'", "'|'", "'Total Matched|' || matched", "'Match Rate|' || rate || '%'", "'Unmatched (Baseline)|' || removed", "'Unmatched (Compare)|' || added", "'|'", "'Total Elements|' || matched", "'Unchanged Elements|' || unchanged", "'Modified Elements (apex only)|' || roots", "'Modified Elements (pre-filter)|' || modified", "'CSS Property Changes (propertyDiffCount)|' || diffs", "'|'", "'Critical|' || critical", "'High|' || high", "'Medium|' || medium", "'Low|' || low"]
    level = "CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END"
    return f"""WITH {STATIC_SQL}, {_PER_ELEMENT}, o AS (SELECT *, {_OVERALL} AS overall FROM e), m AS (SELECT pair_id, count(*) AS matched FROM p GROUP BY 1),
gs AS (SELECT pair_id, count(*) AS modified, CAST(sum(total) AS BIGINT) AS diffs, count(*) FILTER (overall = 'critical') AS critical, count(*) FILTER (overall = 'high') AS high, count(*) FILTER (overall = 'medium') AS medium, count(*) FILTER (overall = 'low') AS low FROM o GROUP BY 1),
ra AS (SELECT report_id, ord, 'removed' AS status, hpid, tag, element_id, class_name FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.report_id = b.report_id AND c.hpid = b.hpid) UNION ALL SELECT report_id, ord, 'added', hpid, tag, element_id, class_name FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE c.report_id = b.report_id AND c.hpid = b.hpid)),
rn AS (SELECT report_id, count(*) FILTER (status = 'removed') AS removed, count(*) FILTER (status = 'added') AS added FROM ra GROUP BY 1),
ch AS (SELECT DISTINCT o.pair_id, b.hpid FROM o JOIN b ON b.report_id = o.pair_id AND b.ord = o.b_ord), rt AS (SELECT pair_id, count(*) AS roots FROM ch WHERE NOT EXISTS (SELECT 1 FROM ch x WHERE x.pair_id = ch.pair_id AND starts_with(ch.hpid, x.hpid || '.')) GROUP BY 1),
s AS (SELECT m.pair_id, matched, matched - coalesce(modified, 0) AS unchanged, coalesce(modified, 0) AS modified, coalesce(diffs, 0) AS diffs, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(medium, 0) AS medium, coalesce(low, 0) AS low, coalesce(removed, 0) AS removed, coalesce(added, 0) AS added, coalesce(roots, 0) AS roots,
  CAST(floor(100.0 * matched / (matched + coalesce(removed, 0) + coalesce(added, 0)) + 0.5) AS BIGINT) AS rate FROM m LEFT JOIN gs USING (pair_id) LEFT JOIN rn ON rn.report_id = m.pair_id LEFT JOIN rt USING (pair_id)),
ev AS (SELECT s.pair_id, v.severity, v.l, (SELECT count(*) FROM d WHERE d.pair_id = s.pair_id AND d.severity = v.severity) AS n FROM s, (VALUES ('critical', 1), ('high', 2), ('medium', 3), ('low', 4)) v(severity, l))
SELECT pair_id, 0 AS sheet, 1 AS part, unnest([{', '.join(facts)}]) AS cells FROM s UNION ALL SELECT pair_id, 1, 0, {names(exports.SHEET_DIFFERENCES)} FROM s UNION ALL SELECT d.pair_id, 1, 1, {cells(*element, 'd.property', 'd.base_value', 'd.compare_value', 'd.type', 'd.category', 'd.severity')} FROM {joined}
UNION ALL SELECT pair_id, 2, 0, {names(exports.SHEET_MATCHED)} FROM s UNION ALL SELECT p.pair_id, 2, 1, {cells(*element)} || '|absolute-hpid|0.95|' || coalesce(total, 0) || '|' || coalesce(overall, 'none') FROM p JOIN b ON b.report_id = p.pair_id AND b.ord = p.b_ord LEFT JOIN o ON o.pair_id = p.pair_id AND o.b_ord = p.b_ord
UNION ALL SELECT pair_id, 3, 0, {names(exports.SHEET_UNMATCHED)} FROM s UNION ALL SELECT report_id, 3, CASE WHEN status = 'removed' THEN 1 ELSE 2 END, CASE WHEN status = 'removed' THEN 'Only in Baseline (removed)' ELSE 'Only in Compare (added)' END || '|' || {cells('hpid', 'tag', 'element_id', 'class_name')} FROM ra WHERE report_id IN (SELECT pair_id FROM s)
UNION ALL SELECT pair_id, 4, l * 4, upper(severity) || ' ' || chr(8212) || ' ' || n || ' property change' || CASE WHEN n = 1 THEN '' ELSE 's' END || '||||' FROM ev UNION ALL SELECT pair_id, 4, l * 4 + 1, {names(exports.SEVERITY_COLUMNS)} FROM ev WHERE n > 0
UNION ALL SELECT d.pair_id, 4, {level} * 4 + 2, {cells('b.hpid', 'b.tag', 'd.property', 'd.base_value', 'd.compare_value')} FROM {joined} UNION ALL SELECT pair_id, 4, l * 4 + 3, '||||' FROM ev"""


@query(_workbook_sql())
def workbook_rows(spark, sf_dir):
    b, c, matches, named_diffs, per = compared_once(spark, sf_dir)
    named = b.withColumnRenamed("ord", "b_ord")
    alone = lambda x, y, status: x.join(y.select("pair_id", "hpid").distinct(), ["pair_id", "hpid"], "left_anti").withColumn("status", F.lit(status))
    removed, added = alone(b, c, "removed"), alone(c, b, "added")
    changed = per.join(named.select("pair_id", "b_ord", "hpid"), ["pair_id", "b_ord"]).select("pair_id", "hpid")
    roots = filters.top_roots(changed).distinct().groupBy("pair_id").agg(F.count("*").alias("roots"))
    summary = diff.summary(matches, named_diffs).join(match.rate(matches, removed, added).select("pair_id", "removed", "added", "rate"), "pair_id", "left").join(roots, "pair_id", "left").na.fill(0)
    matched = matches.join(named, ["pair_id", "b_ord"]).join(per, ["pair_id", "b_ord"], "left").na.fill(0, ["total"]).withColumns({"strategy": F.lit("absolute-hpid"), "confidence": F.lit(0.95)})
    unmatched = removed.unionByName(added).join(summary.select("pair_id"), "pair_id", "left_semi")
    rows = exports.workbook(fixtures.kept_pairs(summary, sf_dir), named_diffs, matched, unmatched)
    return rows.select("pair_id", "sheet", "part", F.array_join("cells", "|").alias("cells"))
