"""Registered queries of the grouped report, exports, store, texts, surroundings and selectors, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixtures
from ..functions import texts
from ..operators import cascade, diff, enrich, grouped, match, report, selectors, urls, visual
from ..sources import exports, store
from .catalog import _CASCADE, _ITEMS, _LABEL, _OVERALL, _PER_ELEMENT, _SEVERITY, SIDES, STATIC_SQL, base, by_path, comp, merged_items, query, read, static_diffs

Q = "chr(39)"


# --- texts ---


@query("SELECT p_partkey, trim(regexp_replace('  ' || p_name || chr(9) || chr(10) || ' ' || p_type || ' ', '\\s+', ' ', 'g')) AS clean, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_type ELSE 'part' END AS crumb, printf('%.2f', p_size / 4.0) AS confidence, printf('%.1f', p_size * 1.0) || '%' AS share FROM part")
def clean_texts(spark, sf_dir):
    raw = F.concat(F.lit("  "), "p_name", F.lit("\t\n "), "p_type", F.lit(" "))
    k = F.col("p_partkey") % 3
    crumb = texts.first_given(F.when(k == 0, F.col("p_name")).otherwise(""), F.when(k == 1, F.col("p_type")), F.lit("part"))
    return read(spark, sf_dir, "part").select("p_partkey", texts.clean_text(raw).alias("clean"), crumb.alias("crumb"), texts.fixed(F.col("p_size") / 4, 2).alias("confidence"), F.concat(texts.fixed(F.col("p_size"), 1), F.lit("%")).alias("share"))


@query(f"""WITH v AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'o' || {Q} || p_name WHEN 2 THEN 'o' || {Q} || '"' || p_name ELSE '' END AS t, p_name || '.a:b <' || p_size || '> & "c"' AS u FROM part)
SELECT p_partkey, CASE WHEN NOT contains(t, {Q}) THEN {Q} || t || {Q} WHEN NOT contains(t, '"') THEN '"' || t || '"' ELSE 'concat(' || {Q} || replace(t, {Q}, {Q} || ', "' || {Q} || '", ' || {Q}) || {Q} || ')' END AS xpath,
  replace(replace(replace(replace(replace(replace(replace(u, '.', chr(92) || '.'), ':', chr(92) || ':'), '<', chr(92) || '<'), '>', chr(92) || '>'), '&', chr(92) || '&'), '"', chr(92) || '"'), '#', chr(92) || '#') AS css,
  replace(replace(replace(replace(u, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html FROM v""")
def escaped_texts(spark, sf_dir):
    n = F.col("p_name")
    raw = F.get(F.array(n, F.concat(F.lit("o'"), n), F.concat(F.lit("o'\""), n), F.lit("")), (F.col("p_partkey") % 4).cast("int"))
    other = F.concat(n, F.lit(".a:b <"), F.col("p_size").cast("string"), F.lit('> & "c"'))
    return read(spark, sf_dir, "part").select("p_partkey", texts.escape_xpath(raw).alias("xpath"), texts.escape_css(other).alias("css"), texts.escape_html(other).alias("html"))


@query("""WITH v AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'no url' ELSE url END AS u FROM pages), p AS (SELECT *, regexp_extract(u, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path FROM v)
SELECT page_id, CASE WHEN u = 'no url' THEN u ELSE lower(regexp_extract(u, '://([^/?#:]+)', 1)) END AS host, CASE WHEN u = 'no url' THEN '' WHEN replace(path, '/', '') = '' THEN '/' ELSE '/' || regexp_extract(path, '([^/]+)/*$', 1) END AS segment FROM p""")
def address_texts(spark, sf_dir):
    url = F.when(F.col("page_id") % 7 == 0, "no url").otherwise(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", texts.host_of(url).alias("host"), texts.last_segment(url).alias("segment"))


@query("""WITH e AS (SELECT event_id, ts, (epoch_us(max(ts) OVER ()) // 1000000 - epoch_us(ts) // 1000000) // 60 AS m FROM events)
SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN m < 1440 THEN m // 60 || 'h ago' ELSE m // 1440 || 'd ago' END AS ago, strftime(ts, '%Y-%m-%dT%H-%M-%S') AS file_time FROM e""")
def time_texts(spark, sf_dir):
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    now = F.lit(events.agg(F.max("ts")).first()[0])
    return events.select("event_id", texts.relative_time(F.col("ts"), now).alias("ago"), texts.file_time(F.col("ts")).alias("file_time"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'Visual Capture Failed: ' || p_name WHEN 2 THEN 'Visual Diff Skipped: No reason provided.' ELSE NULL END AS capture,
  CASE WHEN p_partkey % 2 = 0 THEN 'Page State Mismatch: ' || CASE WHEN p_size % 2 = 0 THEN 'SPA hash mismatch: #a vs #b · ' ELSE '' END || 'Query differences: p, ' || p_size END AS mismatch,
  CASE WHEN p_size > 20 THEN 'baseline tab: DevTools was open (viewport reduced to ' || (1000 - p_size * 10) || 'px). Screenshots taken at 912px using virtual viewport override.' END AS devtools FROM part""")
def banner_texts(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    status = F.get(F.array(F.lit("success"), F.lit("failed"), F.lit("skipped"), F.lit(None)), (k % 4).cast("int"))
    capture = texts.capture_banner(status, F.when(k % 4 == 1, F.col("p_name")).otherwise(""))
    mismatch = texts.mismatch_banner(F.when(k % 2 == 0, "CAUTION").otherwise("COMPATIBLE"), F.lit("#a"), F.when(size % 2 == 0, "#b").otherwise("#a"), F.array(F.lit("p"), size.cast("string")))
    devtools = texts.devtools_banner(F.lit("baseline"), F.lit(1000), 1000 - size * 10, F.lit(1200), F.lit(1200))
    return read(spark, sf_dir, "part").select("p_partkey", capture.alias("capture"), mismatch.alias("mismatch"), devtools.alias("devtools"))


# --- surroundings ---


@query("""SELECT p_partkey, NOT regexp_matches(v, '^[0-9]{8,}$|^ember[0-9]+$|-[0-9]+-[0-9]+$|^[0-9a-f]{8}-[0-9a-f]{4}') AND length(v) BETWEEN 1 AND 200 AS stable
FROM (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN p_name WHEN 1 THEN '' || (10000000 + p_partkey) WHEN 2 THEN 'ember' || p_partkey WHEN 3 THEN 'x-' || p_partkey || '-' || p_size WHEN 4 THEN 'abcdef01-2345' ELSE '' END AS v FROM part) t""")
def stable_values(spark, sf_dir):
    k, n = F.col("p_partkey").cast("string"), F.col("p_name")
    raw = F.array(n, (F.col("p_partkey") + 10000000).cast("string"), F.concat(F.lit("ember"), k), F.concat(F.lit("x-"), k, F.lit("-"), F.col("p_size").cast("string")), F.lit("abcdef01-2345"), F.lit(""))
    return read(spark, sf_dir, "part").select("p_partkey", enrich.stable_value(F.get(raw, (F.col("p_partkey") % 6).cast("int"))).alias("stable"))


@query(f"""WITH {SIDES}, o AS (SELECT report_id, ord, hpid, CASE WHEN k % 7 IN (1, 3) THEN 'header' WHEN k % 7 = 2 THEN 'main' WHEN k % 7 = 4 THEN 'footer' WHEN k % 7 = 5 THEN 'header' END AS own FROM b)
SELECT o.report_id AS pair_id, o.ord, arg_max(a.own, len(string_split(a.hpid, '.'))) AS section FROM o LEFT JOIN o a ON a.report_id = o.report_id AND a.own IS NOT NULL AND (a.hpid = o.hpid OR starts_with(o.hpid, a.hpid || '.')) GROUP BY 1, 2""")
def section_semantics(spark, sf_dir):
    k = F.regexp_extract("text_content", r"(\d+)", 1).cast("long") % 7
    tag = F.when(k == 1, "header").when(k == 2, "aside").when(k == 3, "nav").otherwise(F.col("tag_name"))
    rows = base(spark, sf_dir).withColumns({"tag_name": tag, "class_name": F.when(k == 4, "page-bottom x").otherwise(F.col("class_name")), "element_id": F.when(k == 5, "top").otherwise(F.col("element_id"))})
    return enrich.section_by_semantics(rows)


@query(f"""WITH {SIDES}, c0 AS (SELECT report_id, regexp_replace(hpid, '\\.[^.]*$', '') AS hpid, tag, count(*) AS n, min(ord) AS first FROM b WHERE contains(hpid, '.') GROUP BY 1, 2, 3)
SELECT report_id AS pair_id, hpid, CAST(sum(n) AS BIGINT) AS children, string_agg(tag || CASE WHEN n > 1 THEN '(' || n || ')' ELSE '' END, ' ' ORDER BY first) AS types FROM c0 GROUP BY 1, 2""")
def child_type_counts(spark, sf_dir):
    return enrich.child_types(base(spark, sf_dir)).withColumn("types", F.array_join("types", " "))


@query(f"""WITH {SIDES}, e AS (SELECT report_id, ord, hpid, tag || '.' || replace(class_name, ' ', '.') AS own, CASE WHEN contains(hpid, '.') THEN regexp_replace(hpid, '\\.[^.]*$', '') END AS parent, len(string_split(hpid, '.')) AS depth FROM b),
u AS (SELECT e.report_id, e.hpid, string_agg(a.own, ' ' ORDER BY a.depth DESC) AS parents FROM e JOIN e a ON a.report_id = e.report_id AND starts_with(e.hpid, a.hpid || '.') AND e.depth - a.depth <= 3 GROUP BY 1, 2),
d AS (SELECT report_id, parent AS hpid, string_agg(own, ' ' ORDER BY ord) AS children FROM (SELECT *, row_number() OVER (PARTITION BY report_id, parent ORDER BY ord) AS rn FROM e WHERE parent IS NOT NULL) z WHERE rn <= 10 GROUP BY 1, 2)
SELECT e.report_id AS pair_id, e.hpid, coalesce(parents, '') AS parents, coalesce(children, '') AS children FROM e LEFT JOIN u USING (report_id, hpid) LEFT JOIN d USING (report_id, hpid)""")
def class_hierarchies(spark, sf_dir):
    flat = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["tag"], F.lit("."), F.array_join(x["classes"], "."))), " ")
    return enrich.class_hierarchy(base(spark, sf_dir)).select("pair_id", "hpid", flat("parents").alias("parents"), flat("children").alias("children"))


@query("""SELECT event_id, NOT (user_id % 5 = 0 OR (event_type IN ('view', 'click') AND user_id % 3 = 0) OR (event_type = 'error' AND user_id % 2 = 0)) AS visual FROM events""")
def mutation_classes(spark, sf_dir):
    kind, u = F.col("event_type"), F.col("user_id")
    tag = F.when(u % 5 == 0, "gtm-frame").otherwise("div")
    attribute = F.when(kind.isin("view", "click") & (u % 3 == 0), "data-gtm").when(kind == "error", "class").otherwise("style")
    names = F.when(u % 2 == 0, "app Telemetry-box").otherwise("app")
    return read(spark, sf_dir, "events").select("event_id", enrich.visual_mutation(tag, F.lit("attributes"), attribute, names).alias("visual"))


@query(f"""WITH {SIDES} SELECT report_id AS pair_id, NOT bool_or((k % 40 = 0) OR (k % 9 = 1 AND s % 2 = 0 AND y <= 100 AND x <= 200)) AS ready FROM b GROUP BY 1""")
def page_ready(spark, sf_dir):
    k, facts = F.col("k"), fixtures.raw(spark, sf_dir, "base").select(F.col("report_id").alias("pair_id"), "ord", "k", (F.col("s") % 2 != 0).alias("complete"))
    rows = base(spark, sf_dir).select("pair_id", "ord", "tag_name", "class_name", "rect").join(facts, ["pair_id", "ord"])  # by place: a report can have a part twice
    rows = rows.withColumns({"class_name": F.when(k % 40 == 0, "img-skeleton").otherwise(F.col("class_name")), "tag_name": F.when(k % 9 == 1, "img").otherwise(F.col("tag_name"))})
    return enrich.document_ready(rows, 200, 100)


# --- visual ---


@query("""SELECT p_partkey, 's1_baseline_kf_' || p_size AS id, p_size % 3 <> p_partkey % 3 AS differ, CASE WHEN p_size % 5 = 0 THEN NULL ELSE CAST(least(97, greatest(3, floor(p_size * 20.0 / 1000 * 100 + 0.5))) AS BIGINT) END AS rail,
  1000 - (1000 - p_size * 10) > 200 AS detected, CASE WHEN p_size * 10 > 200 THEN 912 END AS bypass FROM part""")
def keyframe_texts(spark, sf_dir):
    size, k = F.col("p_size"), F.col("p_partkey")
    kf = lambda c: F.concat(F.lit("kf_"), c.cast("string"))
    seen = visual.devtools(F.lit(1000), 1000 - size * 10, F.lit(1000), F.lit(1000))
    rail = visual.rail_position(size * 20, F.when(size % 5 == 0, 0).otherwise(1000))
    return read(spark, sf_dir, "part").select(
        "p_partkey", visual.keyframe_id(F.lit("s1"), F.lit("baseline"), kf(size)).alias("id"), visual.frames_differ(kf(size % 3), kf(k % 3)).alias("differ"), rail.alias("rail"), seen["detected"].alias("detected"), seen["bypass_height"].alias("bypass")
    )


@query("""WITH v AS (SELECT p_partkey, (p_size * 7 % 300) * 1.0 AS x, (p_size * 11 % 500) * 1.0 AS y, (p_size * 3) * 1.0 AS w, least((p_size * 5) * 1.0, greatest(1.0, 450.0 - (p_size * 11 % 500))) AS h FROM part),
s AS (SELECT *, greatest(least(280 * 0.78 / w, 140 / greatest(h, 1.0)), 0.25) AS scale FROM v), m AS (SELECT *, least(30 / scale, 28.0) AS margin FROM s),
c AS (SELECT *, greatest(0.0, least(x - margin, 640 - w - 1)) AS px, greatest(0.0, least(y - margin, 450 - h - 1)) AS py FROM m)
SELECT p_partkey, CAST(floor(px * 1000 + 0.5) AS BIGINT) AS x, CAST(floor(py * 1000 + 0.5) AS BIGINT) AS y, CAST(floor(greatest(least(640.0, x + w + margin) - px, 1.0) * 1000 + 0.5) AS BIGINT) AS width, CAST(floor(greatest(least(450.0, y + h + margin) - py, 1.0) * 1000 + 0.5) AS BIGINT) AS height, CAST(floor(scale * 1000 + 0.5) AS BIGINT) AS scale FROM c""")
def thumbnail_crop(spark, sf_dir):
    size = F.col("p_size").cast("double")
    rect = F.struct((size * 7 % 300).alias("x"), (size * 11 % 500).alias("y"), (size * 3).alias("width"), (size * 5).alias("height"))
    c = visual.crop(rect, F.lit(1280.0), F.lit(900.0), F.lit(280.0), F.lit(None).cast("double"))
    return read(spark, sf_dir, "part").select("p_partkey", *[F.floor(c[n] * 1000 + 0.5).alias(n) for n in ("x", "y", "width", "height", "scale")])


_MEASURED = "SELECT report_id, 'kf_' || (ord % 3) AS frame, hpid AS id, k % 10 <> 0 AS found, k % 6 <> 0 AS in_viewport, x, y - 60 AS vy, width, height, k % 3 AS matches FROM b WHERE k % 13 <> 0"


@query(f"""WITH {SIDES}, m AS ({_MEASURED}), j AS (SELECT b.report_id AS pair_id, 'kf_' || (b.ord % 3) AS frame, b.hpid AS id, b.y AS document_y, coalesce(found, false) AS found, in_viewport, m.x, vy, m.width, m.height, matches, greatest(0, vy) AS top, least(vy + m.height, 100) AS bottom FROM b LEFT JOIN m ON m.report_id = b.report_id AND m.id = b.hpid),
s AS (SELECT *, found AND bottom > 0 AS usable FROM j)
SELECT pair_id, frame, id, document_y, CASE WHEN usable THEN x END AS x, CASE WHEN usable THEN top END AS y, CASE WHEN usable THEN width END AS width, CASE WHEN usable THEN greatest(1, bottom - top) END AS height, CASE WHEN usable THEN vy END AS raw_y, CASE WHEN usable THEN height END AS raw_height,
  NOT usable OR NOT in_viewport AS misaligned, CASE WHEN usable AND NOT in_viewport THEN 'outside-viewport' WHEN usable THEN NULL WHEN found THEN 'clipped-below-fold' ELSE 'element-not-found' END AS misalign_reason,
  CASE WHEN NOT found THEN false WHEN bottom <= 0 THEN true ELSE greatest(1, bottom - top) < height END AS rect_clipped, usable AND matches > 1 AS selector_ambiguous,
  CASE WHEN document_y % 60 = 0 THEN 'b' || document_y END AS pseudo_before, CASE WHEN document_y % 60 = 0 THEN 'a' END AS pseudo_after FROM s""")
def remeasured_manifest(spark, sf_dir):
    b = base(spark, sf_dir)
    k = F.regexp_extract("text_content", r"(\d+)", 1).cast("long")
    frame = F.concat(F.lit("kf_"), (F.col("ord") % 3).cast("string")).alias("frame")
    planned, places = b.select("pair_id", frame, F.col("hpid").alias("id")), b.select("pair_id", F.col("hpid").alias("id"), F.col("rect.y").alias("document_y"))
    seen = b.where(k % 13 != 0).select("pair_id", frame, F.col("hpid").alias("id"), (k % 10 != 0).alias("found"), (k % 6 != 0).alias("in_viewport"), F.col("rect.x").alias("viewport_x"), (F.col("rect.y") - 60).alias("viewport_y"), "rect.width", "rect.height", (k % 3).alias("matches"), F.when(k % 10 != 0, "outside-viewport").alias("reason"))
    pseudo = places.where("document_y % 60 = 0").select("pair_id", "id", F.concat(F.lit("b"), F.col("document_y").cast("string")).alias("before"), F.lit("a").alias("after"))
    return visual.with_pseudo(visual.remeasured(planned, seen, places, 100), pseudo)


@query(f"WITH {SIDES} SELECT report_id AS pair_id, hpid AS id, tag || '.' || split_part(class_name, ' ', 1) AS css_selector, '//' || tag || '[@title=' || {Q} || title || {Q} || ']' AS xpath FROM b WHERE ord % 2 = 0")
def selector_lookup(spark, sf_dir):
    b = base(spark, sf_dir)
    ids = b.where("ord % 2 = 0").select("pair_id", F.col("hpid").alias("id")).unionByName(b.where("ord = 1").select("pair_id", F.lit("9.9").alias("id")))
    return visual.selectors_of(ids, b)


@query(f"""WITH {SIDES}, s AS (SELECT report_id, hpid, ord, x, y, width, height FROM b), t AS (SELECT report_id, hpid, ord, x, y, width, height FROM c)
SELECT coalesce(s.report_id, t.report_id) AS pair_id, coalesce(s.hpid, t.hpid) AS hpid, CASE WHEN s.ord IS NULL THEN NULL WHEN s.ord % 2 = 0 THEN 1 ELSE 2 END AS baseline_dpr, s.y AS baseline_document_y, s.width AS baseline_width, CASE WHEN t.ord IS NULL THEN NULL WHEN t.ord % 2 = 0 THEN 1 ELSE 2 END AS compare_dpr, t.y AS compare_document_y, t.width AS compare_width
FROM s FULL JOIN t ON s.report_id = t.report_id AND s.hpid = t.hpid""")
def manifest_fields(spark, sf_dir):
    def side(d):
        own = {"keyframe_id": F.lit("kf_1"), "dpr": F.when(F.col("ord") % 2 == 0, 1), "scroll_y": F.lit(0), "document_y": F.col("rect.y"), "document_height": F.lit(1000), "x": F.col("rect.x"), "y": F.col("rect.y"), "width": F.col("rect.width"), "height": F.col("rect.height"), "raw_y": F.col("rect.y")}
        flags = {"misaligned": F.lit(False), "misalign_reason": F.lit(None).cast("string"), "selector_ambiguous": F.lit(False), "rect_clipped": F.lit(False)}
        return d.select("pair_id", "hpid", *[c.alias(n) for n, c in (own | flags).items()])

    rows = visual.flat_manifest(side(base(spark, sf_dir)), side(comp(spark, sf_dir)), ["pair_id", "hpid"])
    return rows.select("pair_id", "hpid", *[f"{s}_{f}" for s in ("baseline", "compare") for f in ("dpr", "document_y", "width")])


# --- grouped report ---

_VERDICT = f"""w AS (SELECT g.pair_id, g.b_ord, g.recurrence, g.rank AS old, x.words AS a, y.words AS z, x.width AS p, y.width AS q FROM g JOIN p ON p.pair_id = g.pair_id AND p.b_ord = g.b_ord),
v AS (SELECT *, CAST(levenshtein(a, z) AS DOUBLE) / greatest(length(a), length(z)) * CASE WHEN greatest(length(a), length(z)) < 8 THEN 0.3 ELSE 1 END AS d, least(abs(least(CAST(length(z) AS DOUBLE) / length(a), 4.0) - CAST(q AS DOUBLE) / p) / greatest(CAST(length(z) AS DOUBLE) / length(a), CAST(q AS DOUBLE) / p, 1.0), 1.0) AS e FROM w WHERE a <> z),
s AS (SELECT *, d * 0.5 + (1 - e) * 0.3 + CASE WHEN recurrence = 1 THEN 0.2 WHEN recurrence <= 3 THEN 0.05 ELSE 0.0 END AS content, (1 - d) * 0.4 + e * 0.35 + CASE WHEN recurrence = 1 THEN 0.0 WHEN recurrence <= 3 THEN 0.05 ELSE 0.2 END AS layout FROM v),
act AS (SELECT *, CASE WHEN content >= 0.65 THEN 'DEMOTE' WHEN content >= 0.45 AND content > layout THEN 'SOFT_DEMOTE' WHEN layout >= 0.65 THEN 'RETAIN' ELSE 'SOFT_DEMOTE' END AS action FROM s),
j AS (SELECT d.*, act.action, CASE act.action WHEN 'DEMOTE' THEN 'low' WHEN 'SOFT_DEMOTE' THEN 'medium' ELSE d.severity END AS severity_now FROM d JOIN g ON g.pair_id = d.pair_id AND g.b_ord = d.b_ord LEFT JOIN act ON act.pair_id = d.pair_id AND act.b_ord = d.b_ord AND d.property = 'width')"""


def _texts(spark, sf_dir) -> DataFrame:
    pairs = diff.paired(base(spark, sf_dir), comp(spark, sf_dir), ["pair_id", "hpid"])
    return pairs.select("pair_id", "b_ord", F.col("b.text_content").alias("base_text"), F.col("c.text_content").alias("compare_text"))


def judged_diffs(spark, sf_dir, diffs: DataFrame | None = None, items: DataFrame | None = None) -> DataFrame:
    diffs = fixtures.kept_pairs(static_diffs(spark, sf_dir), sf_dir) if diffs is None else diffs
    return grouped.apply_content(diffs, _texts(spark, sf_dir), merged_items(spark, sf_dir, diffs) if items is None else items)


def _items_and_judged(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The items of the diffs, and the diffs with their content verdicts; the diffs and the items are made once."""
    diffs = fixtures.kept_pairs(static_diffs(spark, sf_dir), sf_dir)
    items = fixtures.kept_pairs(merged_items(spark, sf_dir, diffs), sf_dir)
    return items, judged_diffs(spark, sf_dir, diffs, items)


@query(f"WITH {STATIC_SQL}, {_ITEMS}, {_VERDICT} SELECT pair_id, b_ord, property, severity_now AS severity, action FROM j")
def content_applied(spark, sf_dir):
    return judged_diffs(spark, sf_dir).select("pair_id", "b_ord", "property", "severity", "action")


@query(f"""WITH {STATIC_SQL}, {_ITEMS}, {_VERDICT}, n AS (SELECT pair_id, b_ord, min(CASE severity_now WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END) AS now, bool_and(action <> 'RETAIN') FILTER (property = 'width') AS content FROM j GROUP BY 1, 2),
r AS (SELECT g.pair_id, g.b_ord, g.total, CASE WHEN now > g.rank THEN now ELSE g.rank END AS rank, now > g.rank AND coalesce(n.content, false) AS content FROM g JOIN n USING (pair_id, b_ord))
SELECT pair_id, b_ord, {_SEVERITY} AS severity, content, row_number() OVER (PARTITION BY pair_id, rank ORDER BY total DESC, b_ord) AS place FROM r""")
def rebucketed_groups(spark, sf_dir):
    return grouped.rebucketed(*_items_and_judged(spark, sf_dir)).select("pair_id", "b_ord", "severity", "content", "place")


@query(f"""WITH {STATIC_SQL}, r AS (SELECT *, CASE severity WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END AS level FROM d)
SELECT pair_id, b_ord, category, string_agg(property, ',' ORDER BY level, property) AS properties FROM r GROUP BY 1, 2, 3""")
def diffs_by_category(spark, sf_dir):
    rows = grouped.by_category(static_diffs(spark, sf_dir)).select("pair_id", "b_ord", F.explode("groups").alias("category", "diffs"))
    return rows.select("pair_id", "b_ord", "category", F.array_join("diffs.property", ",").alias("properties"))


@query(f"WITH {STATIC_SQL}, {_ITEMS} SELECT pair_id, CAST(sum(total) AS BIGINT) AS property_diffs FROM g GROUP BY 1")
def property_diff_count(spark, sf_dir):
    return grouped.property_diffs(merged_items(spark, sf_dir))


@query(f"""WITH {STATIC_SQL}, {_PER_ELEMENT}, o AS (SELECT e.*, {_OVERALL} AS overall, hpid, CASE WHEN contains(hpid, '.') THEN regexp_replace(hpid, '\\.[^.]*$', '') ELSE '' END AS parent FROM e JOIN p USING (pair_id, b_ord, c_ord)),
t AS (SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM o u WHERE u.pair_id = o.pair_id AND u.hpid = o.parent))
SELECT pair_id, count(*) FILTER (overall = 'critical') AS critical, count(*) FILTER (overall = 'high') AS high, count(*) FILTER (overall = 'medium') AS medium, count(*) FILTER (overall = 'low') AS low FROM t GROUP BY 1""")
def root_severities(spark, sf_dir):
    paths = base(spark, sf_dir).select("pair_id", F.col("ord").alias("b_ord"), "hpid")
    return grouped.root_breakdown(fixtures.kept_pairs(diff.per_element(static_diffs(spark, sf_dir)).select("pair_id", "b_ord", "overall"), sf_dir), paths)


@query(f"""WITH {STATIC_SQL}, {_ITEMS}, e AS (SELECT pair_id, count(DISTINCT b_ord) AS n FROM d GROUP BY 1), m AS (SELECT pair_id, count(*) AS matched FROM p GROUP BY 1), r AS (SELECT pair_id, count(*) AS roots FROM g GROUP BY 1)
SELECT pair_id, matched, matched - coalesce(n, 0) AS unchanged, coalesce(n, 0) AS modified_before, coalesce(roots, 0) AS modified, coalesce(n, 0) - coalesce(roots, 0) AS suppressed_children FROM m LEFT JOIN e USING (pair_id) LEFT JOIN r USING (pair_id)""")
def report_reconciled(spark, sf_dir):
    diffs = fixtures.kept_pairs(static_diffs(spark, sf_dir), sf_dir)
    return grouped.reconciled(diff.summary(by_path(spark, sf_dir), diffs), merged_items(spark, sf_dir, diffs))


@query(f"""WITH {SIDES} SELECT report_id AS pair_id, ord, {_LABEL} AS element_key, hpid, words AS text_content, 'removed' AS status FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.report_id = b.report_id AND c.hpid = b.hpid)
UNION ALL SELECT report_id, ord, {_LABEL}, hpid, words, 'added' FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE c.report_id = b.report_id AND c.hpid = b.hpid)""")
def unmatched_groups(spark, sf_dir):
    b, c = base(spark, sf_dir), comp(spark, sf_dir)
    alone = lambda x, y: x.join(y.select("pair_id", "hpid").distinct(), ["pair_id", "hpid"], "left_anti")
    both = grouped.unmatched_group(alone(b, c), b, "removed").unionByName(grouped.unmatched_group(alone(c, b), c, "added"))
    return both.select("pair_id", "ord", "element_key", "hpid", "text_content", "status")


@query(f"""{_CASCADE}, a AS (SELECT DISTINCT report_id, b_ord, n, c_ord FROM m1 WHERE n >= 2)
SELECT a.report_id AS pair_id, a.b_ord, a.n AS candidates, a.c_ord AS first, 'test-attribute' AS strategy, {_LABEL} AS element_key, tag || '.' || split_part(class_name, ' ', 1) AS breadcrumb FROM a JOIN b ON b.report_id = a.report_id AND b.ord = a.b_ord""")
def ambiguous_groups(spark, sf_dir):
    b = base(spark, sf_dir)
    _, doubtful = match.cascade(b, comp(spark, sf_dir), [("test-attribute", 1.0)])
    return grouped.ambiguous_group(doubtful, b).select("pair_id", "b_ord", "candidates", "first", "strategy", "element_key", "breadcrumb")


def _changed(spark, sf_dir) -> DataFrame:
    paths = base(spark, sf_dir).select("pair_id", F.col("ord").alias("b_ord"), "hpid")
    return diff.per_element(static_diffs(spark, sf_dir)).join(paths, ["pair_id", "b_ord"]).select("pair_id", "hpid", F.col("overall").alias("severity"))


_CHANGED = f"{STATIC_SQL}, {_PER_ELEMENT}, ch AS (SELECT e.pair_id, hpid, {_OVERALL} AS severity FROM e JOIN p USING (pair_id, b_ord, c_ord)), nodes AS (SELECT report_id AS pair_id, hpid FROM b)"


@query(f"""WITH {_CHANGED} SELECT n.pair_id, n.hpid, count(ch.hpid) AS descendants, coalesce(bool_or(severity IN ('critical', 'high')), false) AS severe FROM nodes n LEFT JOIN ch ON ch.pair_id = n.pair_id AND starts_with(ch.hpid, n.hpid || '.') GROUP BY 1, 2""")
def diff_descendants(spark, sf_dir):
    return grouped.diff_descendants(base(spark, sf_dir).select("pair_id", "hpid"), _changed(spark, sf_dir))


@query(f"""WITH {_CHANGED} SELECT n.pair_id, n.hpid, CASE WHEN c.hpid IS NULL THEN 'DOM_DELETION' WHEN ch.severity = 'critical' THEN 'DIFF_APEX' WHEN ch.severity IS NOT NULL THEN 'DIFF_DETAIL' ELSE 'STRUCTURAL' END AS type
FROM nodes n LEFT JOIN ch ON ch.pair_id = n.pair_id AND ch.hpid = n.hpid LEFT JOIN c ON c.report_id = n.pair_id AND c.hpid = n.hpid UNION ALL SELECT c.report_id, c.hpid, 'DOM_INSERTION' FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE c.report_id = b.report_id AND c.hpid = b.hpid)""")
def node_classes(spark, sf_dir):
    b, c, changed = base(spark, sf_dir).select("pair_id", "hpid"), comp(spark, sf_dir).select("pair_id", "hpid"), fixtures.kept_pairs(_changed(spark, sf_dir), sf_dir)
    added, removed = c.join(b, ["pair_id", "hpid"], "left_anti"), b.join(c, ["pair_id", "hpid"], "left_anti")
    return grouped.node_classes(b.unionByName(added), changed, added, removed, changed.where("severity = 'critical'"))


_CONTENT = f"""{STATIC_SQL}, {_ITEMS}, {_VERDICT}, n AS (SELECT pair_id, b_ord, min(CASE severity_now WHEN 'critical' THEN 1 WHEN 'high' THEN 2 WHEN 'medium' THEN 3 ELSE 4 END) AS now, bool_and(action <> 'RETAIN') FILTER (property = 'width') AS content FROM j GROUP BY 1, 2),
r AS (SELECT g.*, now > g.rank AND coalesce(n.content, false) AS content, regexp_matches(properties, 'display|width|margin') AS layout FROM g JOIN n USING (pair_id, b_ord)),
dom AS (SELECT report_id AS pair_id FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.report_id = b.report_id AND c.hpid = b.hpid) UNION ALL SELECT report_id FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE c.report_id = b.report_id AND c.hpid = b.hpid))"""


@query(f"""WITH {_CONTENT}, k AS (SELECT pair_id, count(*) FILTER (layout AND NOT content) AS layout, count(*) FILTER (NOT layout AND NOT content) AS style, count(*) FILTER (content) AS content FROM r GROUP BY 1), o AS (SELECT pair_id, count(*) AS dom FROM dom GROUP BY 1)
SELECT pair_id, coalesce(layout, 0) AS layout, coalesce(style, 0) AS style, coalesce(content, 0) AS content, coalesce(dom, 0) AS dom FROM k FULL JOIN o USING (pair_id)""")
def change_distribution(spark, sf_dir):
    items = grouped.rebucketed(*_items_and_judged(spark, sf_dir))
    b, c = base(spark, sf_dir).select("pair_id", "hpid"), comp(spark, sf_dir).select("pair_id", "hpid")
    alone = lambda x, y: x.join(y.distinct(), ["pair_id", "hpid"], "left_anti")
    return report.distribution(items, alone(b, c).unionByName(alone(c, b)))


@query(f"""WITH {STATIC_SQL}, {_ITEMS}, a AS (SELECT *, rank = 1 AS is_apex, bool_or(rank = 1) OVER (PARTITION BY pair_id) AS any_apex FROM g),
t AS (SELECT pair_id, b_ord, total, is_apex, row_number() OVER (PARTITION BY pair_id ORDER BY CASE WHEN any_apex THEN total * 2 + recurrence ELSE total END DESC, b_ord) AS rank FROM a WHERE is_apex OR NOT any_apex) SELECT * FROM t WHERE rank <= 3""")
def top_apex_nodes(spark, sf_dir):
    items = merged_items(spark, sf_dir).withColumns({"is_apex": F.col("severity") == "critical", "suppressed": F.col("total") * 2 + F.col("recurrence")})
    return report.top_apexes(items).select("pair_id", "b_ord", "total", "is_apex", F.col("rank").cast("long").alias("rank"))


@query("""WITH v AS (SELECT p_partkey, p_size AS x, CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE p_size END AS y FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'INCOMPATIBLE' ELSE 'CAUTION' END AS classification, CASE WHEN p_partkey % 5 <> 0 THEN CASE WHEN x <> y THEN 'a:' || x || '>' || y || ' ' ELSE '' END || 'b:2>- a:3>- c:->5 d' END AS query, CASE WHEN p_partkey % 5 = 0 THEN '/p>/q' END AS path, CASE WHEN p_partkey % 5 <> 0 THEN '#h>' END AS hash FROM v""")
def url_delta(spark, sf_dir):
    size, k = F.col("p_size").cast("string"), F.col("p_partkey")
    a = F.concat(F.lit("https://h.example.com/P/?a="), size, F.lit("&b=2&a=3&utm_x=1#h"))
    b = F.concat(F.lit("http://other.example.com/"), F.when(k % 5 == 0, "q").otherwise("p"), F.lit("?a=0&c=5+d&gclid=7&a="), F.when(k % 2 == 0, "3").otherwise(size))
    found = urls.compatibility(read(spark, sf_dir, "part").select("p_partkey", a.alias("x"), b.alias("y")), "x", "y")
    text = F.array_join(F.transform("query_delta", lambda d: F.concat(d["key"], F.lit(":"), F.coalesce(d["baseline"], F.lit("-")), F.lit(">"), F.coalesce(d["compare"], F.lit("-")))), " ")
    both = lambda c: F.concat(F.col(c)["baseline"], F.lit(">"), F.col(c)["compare"])
    return found.select("p_partkey", "classification", text.alias("query"), both("path_delta").alias("path"), both("hash_delta").alias("hash"))


@query("""WITH v AS (SELECT p_partkey, p_size * 2 AS score, p_partkey % 5 AS l, p_size % 4 AS s, p_size % 3 AS c, p_partkey % 2 AS d FROM part), t AS (SELECT *, greatest(l + s + c + d, 1) AS n FROM v),
q AS (SELECT *, CAST(floor(l * 1.0 / n * 100 + 0.5) AS BIGINT) AS layout, CAST(floor(s * 1.0 / n * 100 + 0.5) AS BIGINT) AS style, CAST(floor(c * 1.0 / n * 100 + 0.5) AS BIGINT) AS content FROM t)
SELECT p_partkey, CASE WHEN score >= 90 THEN 'score-great' WHEN score >= 70 THEN 'score-good' WHEN score >= 50 THEN 'score-warn' ELSE 'score-bad' END AS class, layout, style, content, greatest(0, 100 - layout - style - content) AS dom FROM q""")
def executive_summary(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    return read(spark, sf_dir, "part").select("p_partkey", grouped.score_class(size * 2).alias("class"), F.inline(F.array(grouped.shares(k % 5, size % 4, size % 3, k % 2))))


@query(f"WITH {STATIC_SQL}, {_ITEMS}, x AS (SELECT pair_id, b_ord, hpids, unnest(range(1, len(string_split(hpids, ',')) + 1)) AS instance FROM g) SELECT pair_id, b_ord, string_split(hpids, ',')[instance] AS hpid, instance FROM x")
def recurrence_nodes(spark, sf_dir):
    return grouped.recurrences(merged_items(spark, sf_dir))


@query(f"""WITH {STATIC_SQL}, {_ITEMS}, n AS (SELECT report_id AS pair_id, hpid, {_LABEL} AS own FROM b) SELECT DISTINCT n.pair_id, n.hpid, coalesce(g.label, own) AS label FROM n LEFT JOIN g ON g.pair_id = n.pair_id AND list_contains(string_split(g.hpids, ','), n.hpid)""")
def label_map(spark, sf_dir):
    return grouped.labels(merged_items(spark, sf_dir), base(spark, sf_dir))


@query(f"""WITH {_CHANGED}, n AS (SELECT report_id AS pair_id, hpid || CASE WHEN k % 2 = 0 THEN '.7.8.9' ELSE '' END AS hpid FROM b), s AS (SELECT DISTINCT pair_id, hpid, unnest(range(1, len(string_split(hpid, '.')) + 1)) AS lv FROM n),
t AS (SELECT pair_id, hpid, lv, array_to_string(string_split(hpid, '.')[1:lv], '.') AS step FROM s), l AS (SELECT report_id AS pair_id, hpid AS step, {_LABEL} AS label FROM b),
cw AS (SELECT t.pair_id, t.hpid, list(coalesce(label, t.step) || CASE WHEN ch.hpid IS NULL THEN '' ELSE '*' END ORDER BY lv) AS way FROM t LEFT JOIN l USING (pair_id, step) LEFT JOIN ch ON ch.pair_id = t.pair_id AND ch.hpid = t.step GROUP BY 1, 2)
SELECT pair_id, hpid, CASE WHEN len(way) > 5 THEN way[1] || ' > … > ' || array_to_string(way[-3:], ' > ') ELSE array_to_string(way, ' > ') END AS crumbs FROM cw""")
def breadcrumbs(spark, sf_dir):
    b = base(spark, sf_dir)
    k = F.regexp_extract("text_content", r"(\d+)", 1).cast("long")
    nodes = b.select("pair_id", F.concat("hpid", F.when(k % 2 == 0, ".7.8.9").otherwise("")).alias("hpid")).distinct()
    named = b.select("pair_id", "hpid", report.label(F.col("tag_name"), F.col("element_id"), F.col("class_name")).alias("label"))
    text = F.array_join(F.transform("crumbs", lambda c: F.concat(c["label"], F.when(c["has_diff"], "*").otherwise(""))), " > ")
    return grouped.crumbs(nodes, named, _changed(spark, sf_dir)).select("pair_id", "hpid", text.alias("crumbs"))


@query(f"WITH {SIDES} SELECT report_id AS pair_id, hpid, row_number() OVER (PARTITION BY report_id ORDER BY list_transform(string_split(hpid, '.'), lambda v: CAST(v AS INTEGER)), ord) AS place FROM c")
def path_order(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("pair_id").orderBy(grouped.document_order(F.col("hpid")), "ord"))
    return comp(spark, sf_dir).select("pair_id", "hpid", place.cast("long").alias("place"))


@query(f"WITH {STATIC_SQL} SELECT d.pair_id, d.b_ord, d.property FROM d JOIN b ON b.report_id = d.pair_id AND b.ord = d.b_ord WHERE severity = 'high' AND category IN ('layout', 'visual') AND contains(lower({_LABEL}), 'c1')")
def shown_diffs(spark, sf_dir):
    return grouped.shown(static_diffs(spark, sf_dir), base(spark, sf_dir), "high", ["layout", "visual"], "C1").select("pair_id", "b_ord", "property")


# --- store and exports ---

_STORED = "SELECT o_orderkey AS comparison_id, o_custkey AS baseline_id, o_custkey + 1 AS compare_id, CASE WHEN o_orderkey % 2 = 0 THEN 'static' ELSE 'dynamic' END AS mode FROM orders"


def _comparisons(spark, sf_dir) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("comparison_id"), F.col("o_custkey").alias("baseline_id"), (F.col("o_custkey") + 1).alias("compare_id"), F.when(F.col("o_orderkey") % 2 == 0, "static").otherwise("dynamic").alias("mode"))


@query(f"WITH k AS ({_STORED}) SELECT k.comparison_id, baseline_id || '_' || compare_id || '_' || mode AS pair_key, count(l_orderkey) AS diffs FROM k LEFT JOIN lineitem ON l_orderkey = k.comparison_id WHERE baseline_id = 7 AND mode = 'static' GROUP BY 1, 2")
def stored_comparison(spark, sf_dir):
    found = store.by_pair(_comparisons(spark, sf_dir), 7, 8, "static")
    diffs = store.diffs_of(found, read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("comparison_id")))
    n = diffs.groupBy("comparison_id").agg(F.count("*").alias("diffs"))
    return found.join(n, "comparison_id", "left").select("comparison_id", store.pair_key(F.col("baseline_id"), F.col("compare_id"), F.col("mode")).alias("pair_key"), F.coalesce("diffs", F.lit(0)).alias("diffs"))


@query(f"""WITH k AS (SELECT baseline_id, compare_id, mode, min(comparison_id) AS comparison_id FROM ({_STORED}) s GROUP BY ALL), w AS (SELECT c_custkey AS baseline_id, c_custkey + 1 AS compare_id, 'static' AS mode FROM customer), n AS (SELECT l_orderkey AS comparison_id, count(*) AS n FROM lineitem GROUP BY 1)
SELECT w.*, k.comparison_id, CASE WHEN k.comparison_id IS NOT NULL THEN coalesce(n, 0) END AS n_diffs FROM w LEFT JOIN k USING (baseline_id, compare_id, mode) LEFT JOIN n ON n.comparison_id = k.comparison_id""")
def cached_comparisons(spark, sf_dir):
    kept = _comparisons(spark, sf_dir).groupBy("baseline_id", "compare_id", "mode").agg(F.min("comparison_id").alias("comparison_id"))
    c = read(spark, sf_dir, "customer")
    wanted = c.select(F.col("c_custkey").alias("baseline_id"), (F.col("c_custkey") + 1).alias("compare_id"), F.lit("static").alias("mode"))
    return store.cached(wanted, kept, read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("comparison_id")))


@query("""WITH t AS (SELECT p_partkey AS id, 's' || p_size % 4 AS session_id, p_name AS body FROM part), n AS (SELECT p_partkey * 2 AS id, 's' || p_size % 4 AS session_id, 'new' || p_partkey AS body FROM part)
SELECT * FROM (SELECT * FROM t WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n) u WHERE session_id <> 's1'""")
def put_and_delete(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    session = F.concat(F.lit("s"), (F.col("p_size") % 4).cast("string"))
    old = p.select(F.col("p_partkey").alias("id"), session.alias("session_id"), F.col("p_name").alias("body"))
    first = p.select((F.col("p_partkey") * 2).alias("id"), session.alias("session_id"), F.lit("first").alias("body"), F.lit(1).alias("put_order"))
    again = p.select((F.col("p_partkey") * 2).alias("id"), session.alias("session_id"), F.concat(F.lit("new"), F.col("p_partkey").cast("string")).alias("body"), F.lit(2).alias("put_order"))
    gone = spark.createDataFrame([("s1",)], "session_id string")
    return store.without_sessions(store.put(old, first.unionByName(again), "id"), gone).select("id", "session_id", "body")


@query("SELECT p_partkey AS keyframe, 's' || p_size % 4 AS session_id FROM part WHERE p_size % 4 = 2")
def session_keyframes(spark, sf_dir):
    frames = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("keyframe"), F.concat(F.lit("s"), (F.col("p_size") % 4).cast("string")).alias("session_id"))
    return store.keyframes_of(frames, "s2")


@query("SELECT p_partkey AS operation_id, p_partkey * 10 AS started FROM part WHERE p_size % 3 <> 0")
def pending_operations(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    begun = p.select(F.col("p_partkey").alias("operation_id"), F.lit("PENDING").alias("status"), (F.col("p_partkey") * 10).alias("at"))
    done = p.where("p_size % 3 = 0").select(F.col("p_partkey").alias("operation_id"), F.lit("COMPLETE").alias("status"), (F.col("p_partkey") * 10 + 5).alias("at"))
    return store.pending(begun.unionByName(done))


@query("""SELECT 'reports' AS name, (SELECT count(*) FROM orders) AS n UNION ALL SELECT 'comparisons', 0 UNION ALL SELECT 'visual_blobs', 0 UNION ALL SELECT 'elements', (SELECT count(*) FROM part)""")
def migrated_store(spark, sf_dir):
    tables = {"reports": read(spark, sf_dir, "orders"), "comparisons": read(spark, sf_dir, "customer"), "visual_blobs": read(spark, sf_dir, "supplier"), "elements": read(spark, sf_dir, "part")}
    counts = [t.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, t in store.migrate(tables, 4, 6).items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("""SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'same report' WHEN p_partkey % 7 = 0 THEN 'incompatible addresses' WHEN p_size = 1 THEN 'no elements' WHEN p_size % 4 < 3 OR p_partkey % 3 = 0 THEN 'version too old' END AS refused FROM part""")
def comparable_reports(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    version = F.when(k % 3 == 0, "2.9").when(k % 3 == 1, "3.0").otherwise("10")
    pairs = read(spark, sf_dir, "part").select("p_partkey", k.alias("baseline_id"), F.when(k % 11 == 0, k).otherwise(k + 1).alias("compare_id"), F.when(k % 7 == 0, "INCOMPATIBLE").otherwise("CAUTION").alias("classification"),
        (size - 1).alias("base_elements"), F.lit(1).alias("compare_elements"), F.concat((size % 4).cast("string"), F.lit(".1")).alias("base_version"), version.alias("compare_version"))
    return store.comparable(pairs).select("p_partkey", "refused")


_FIELD = "CASE WHEN {v} IS NULL THEN '' WHEN regexp_matches(CAST({v} AS VARCHAR), '[,\"]') THEN '\"' || replace(CAST({v} AS VARCHAR), '\"', '\"\"') || '\"' ELSE CAST({v} AS VARCHAR) END"


def _line(*cells: str) -> str:
    return " || ',' || ".join(_FIELD.format(v=c) for c in cells)


def _sections_sql() -> str:
    element = ["b.hpid", "b.tag", "b.element_id", "b.class_name", "b.words", "b.tag || '.' || split_part(b.class_name, ' ', 1)", "'//' || b.tag || '[@title=' || chr(39) || b.title || chr(39) || ']'"]
    head = lambda k, columns: f"SELECT pair_id, {k}, 0, '{exports.SECTIONS[k]}' FROM m" + (f" UNION ALL SELECT pair_id, {k}, 1, '{','.join(columns)}' FROM m" if columns else "")
    joined = "d JOIN b ON b.report_id = d.pair_id AND b.ord = d.b_ord"
    facts = [(0, "Total Matched", "matched"), (0, "Unchanged Elements", "matched - coalesce(modified, 0)"), (0, "Modified Elements", "coalesce(modified, 0)"), (0, "CSS Property Changes", "coalesce(diffs, 0)")]
    facts += [(1, r.capitalize(), f"coalesce({r}, 0)") for r in ("critical", "high", "medium", "low")]
    named = " UNION ALL ".join(f"SELECT pair_id, {k}, 2, '{name},' || {value} FROM m LEFT JOIN gs USING (pair_id)" for k, name, value in facts)
    alone = f"SELECT b.report_id, 4, 2, 'removed,' || {_line('b.hpid', 'b.hpid', *element[1:])} FROM b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.report_id = b.report_id AND c.hpid = b.hpid) AND b.report_id IN (SELECT pair_id FROM m)"
    return f"""WITH {STATIC_SQL}, {_PER_ELEMENT}, o AS (SELECT *, {_OVERALL} AS overall FROM e), m AS (SELECT pair_id, count(*) AS matched FROM p GROUP BY 1),
gs AS (SELECT pair_id, count(*) AS modified, CAST(sum(total) AS BIGINT) AS diffs, count(*) FILTER (overall = 'critical') AS critical, count(*) FILTER (overall = 'high') AS high, count(*) FILTER (overall = 'medium') AS medium, count(*) FILTER (overall = 'low') AS low FROM o GROUP BY 1),
x(pair_id, section, part, line) AS ({head(0, [])} UNION ALL {head(1, [])} UNION ALL {head(2, exports.DIFFERENCE_COLUMNS)} UNION ALL {head(3, exports.MATCHED_COLUMNS)} UNION ALL {head(4, exports.UNMATCHED_COLUMNS)} UNION ALL {head(5, exports.SEVERITY_COLUMNS)} UNION ALL {named}
UNION ALL SELECT d.pair_id, 2, 2, {_line(*element, 'd.property', 'd.category', 'd.base_value', 'd.compare_value', 'd.severity', 'd.type')} FROM {joined}
UNION ALL SELECT p.pair_id, 3, 2, {_line('b.hpid', 'b.tag', 'b.element_id', 'b.class_name')} || ',absolute-hpid,0.95,' || coalesce(total, 0) || ',' || coalesce(overall, 'none') FROM p JOIN b ON b.report_id = p.pair_id AND b.ord = p.b_ord LEFT JOIN o ON o.pair_id = p.pair_id AND o.b_ord = p.b_ord
UNION ALL {alone} UNION ALL SELECT d.pair_id, 5, 2, {_line('b.hpid', 'b.tag', 'd.property', 'd.base_value', 'd.compare_value')} FROM {joined}) SELECT pair_id, section, part, line FROM x"""


def compared_once(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Both sides' elements without styles and attributes, their matches by path, the diffs with their elements' columns, and totals by element: what exports read many times is made once."""
    told = ["pair_id", "ord", "hpid", "absolute_hpid", "tag_name", "element_id", "class_name", "text_content", "css_selector", "xpath"]
    b, c = (fixtures.kept_pairs(side(spark, sf_dir).select(*told), sf_dir) for side in (base, comp))
    matches = b.select("pair_id", F.col("ord").alias("b_ord"), "hpid").join(c.select("pair_id", F.col("ord").alias("c_ord"), "hpid"), ["pair_id", "hpid"]).drop("hpid")
    diffs = fixtures.kept_pairs(static_diffs(spark, sf_dir).join(b.withColumnRenamed("ord", "b_ord"), ["pair_id", "b_ord"]), sf_dir)
    return b, c, matches, diffs, fixtures.kept_pairs(diff.per_element(diffs).select("pair_id", "b_ord", "total", "overall"), sf_dir)


@query(_sections_sql())
def csv_sections(spark, sf_dir):
    b, c, matches, diffs, per = compared_once(spark, sf_dir)
    summary = fixtures.kept_pairs(diff.summary(matches, diffs), sf_dir)
    named = b.withColumnRenamed("ord", "b_ord")
    matched = matches.join(named, ["pair_id", "b_ord"]).join(per, ["pair_id", "b_ord"], "left").na.fill(0, ["total"]).withColumns({"strategy": F.lit("absolute-hpid"), "confidence": F.lit(0.95)})
    alone = b.join(c.select("pair_id", "hpid").distinct(), ["pair_id", "hpid"], "left_anti").join(summary.select("pair_id"), "pair_id", "left_semi").withColumn("status", F.lit("removed"))
    return exports.csv_sections(summary, diffs, matched, alone).select("pair_id", "section", "part", "line")


@query(f"""WITH {STATIC_SQL}, {_PER_ELEMENT}, o AS (SELECT *, {_OVERALL} AS overall FROM e), m AS (SELECT pair_id, count(*) AS matched FROM p GROUP BY 1),
gs AS (SELECT pair_id, count(*) AS modified, CAST(sum(total) AS BIGINT) AS diffs, count(*) FILTER (overall = 'critical') AS critical, count(*) FILTER (overall = 'high') AS high, count(*) FILTER (overall = 'medium') AS medium, count(*) FILTER (overall = 'low') AS low FROM o GROUP BY 1)
SELECT pair_id, '{{"exportVersion":"1.0","pairId":' || pair_id || ',"mode":"static","summary":{{"matched":' || matched || ',"unchanged":' || matched - coalesce(modified, 0) || ',"modified":' || coalesce(modified, 0) || ',"diffs":' || coalesce(diffs, 0) || ',"critical":' || coalesce(critical, 0) || ',"high":' || coalesce(high, 0) || ',"medium":' || coalesce(medium, 0) || ',"low":' || coalesce(low, 0) || '}}}}' AS payload FROM m LEFT JOIN gs USING (pair_id)""")
def json_payload(spark, sf_dir):
    return exports.json_payload(diff.summary(by_path(spark, sf_dir), static_diffs(spark, sf_dir)), "static")


@query(f"WITH {STATIC_SQL} SELECT pair_id, severity, count(*) AS changes, count(DISTINCT b_ord) AS elements FROM d GROUP BY 1, 2")
def sheet_by_severity(spark, sf_dir):
    d = static_diffs(spark, sf_dir)
    return exports.sheets(d, d, d, d)["By Severity"].drop("level")


# --- selectors ---


@query(f"""WITH {SIDES}, t AS (SELECT *, CASE WHEN contains(hpid, '.') THEN regexp_replace(hpid, '\\.[^.]*$', '') ELSE '' END AS parent, element_id IS NOT NULL AND NOT regexp_matches(element_id, '-[0-9][0-9]+$') AS named FROM b),
n AS (SELECT *, row_number() OVER (PARTITION BY report_id, parent, tag ORDER BY ord) AS n, count(*) OVER (PARTITION BY report_id, parent, tag) AS m, len(string_split(hpid, '.')) AS depth FROM t),
a AS (SELECT e.report_id, e.ord, u.depth, u.named, replace(u.element_id, '-', '-') AS element_id, u.tag || CASE WHEN u.m > 1 THEN ':nth-of-type(' || u.n || ')' ELSE '' END AS plain FROM n e JOIN n u ON u.report_id = e.report_id AND (u.hpid = e.hpid OR starts_with(e.hpid, u.hpid || '.'))),
s AS (SELECT report_id, ord, coalesce(max(depth) FILTER (named), 0) AS start FROM a GROUP BY 1, 2)
SELECT a.report_id AS pair_id, a.ord, string_agg(CASE WHEN a.depth = start THEN '#' || element_id ELSE plain END, ' > ' ORDER BY a.depth) AS path FROM a JOIN s USING (report_id, ord) WHERE a.depth >= start GROUP BY 1, 2""")
def css_position_paths(spark, sf_dir):
    return selectors.position_paths(base(spark, sf_dir), "css")


@query(f"""WITH {SIDES}, t AS (SELECT report_id, ord, hpid, CASE WHEN element_id IS NOT NULL AND NOT regexp_matches(element_id, '-[0-9][0-9]+$') THEN '//' || tag || '[@id=' || {Q} || element_id || {Q} || ']' WHEN test_attr IS NOT NULL THEN '//' || tag || '[@data-testid=' || {Q} || test_attr || {Q} || ']' END AS anchor FROM b)
SELECT e.report_id AS pair_id, e.ord, arg_max(u.anchor, length(u.hpid)) AS anchor, max(u.hpid) AS anchor_path FROM t e JOIN t u ON u.report_id = e.report_id AND u.anchor IS NOT NULL AND starts_with(e.hpid, u.hpid || '.') GROUP BY 1, 2""")
def xpath_anchors(spark, sf_dir):
    return selectors.anchors(base(spark, sf_dir), "xpath").drop("anchor_trait")


_STABLE_ID = "element_id IS NOT NULL AND NOT regexp_matches(element_id, '^uid-|-[0-9][0-9]+$')"


def _ladder_sql(kind: str) -> str:
    """The short ladders by looking at every element of a report for each candidate."""
    css = kind == "css"
    asks = lambda i="NULL", d="NULL", a="NULL", w="NULL", c="[]::VARCHAR[]": f"tag, {i} AS i, {d} AS d, {a} AS a, {w} AS w, {c} AS c"
    bracket = lambda name, v: f"""tag || '[{name}="' || {v} || '"]'""" if css else f"'//' || tag || '[@{name}=' || {Q} || {v} || {Q} || ']'"
    tests = lambda place, rank: f"SELECT report_id, ord, {place} AS place, {rank} AS confidence, 'test-attr' AS strategy, {bracket('data-testid', 'test_attr')} AS sel, {asks(d='test_attr')} FROM e WHERE test_attr <> '12345678'"
    offers = (
        [
            f"SELECT report_id, ord, 1 AS place, 100 AS confidence, 'id' AS strategy, tag || '#' || element_id AS sel, {asks(i='element_id')} FROM e WHERE {_STABLE_ID}",
            tests(2, 91),
            f"SELECT report_id, ord, 3, 88, 'data-attr', {bracket('data-k', 'data_k')}, {asks(a='data_k')} FROM e WHERE data_k IS NOT NULL",
            f"SELECT report_id, ord, 4, 72, 'class-combo', tag || '.' || classes[1] || '.' || classes[2], {asks(c='classes')} FROM e WHERE classes[1] <> classes[2]",
            f"SELECT report_id, ord, 5, 68, 'class-single', tag || '.' || classes[1], {asks(c='classes[:1]')} FROM e",
        ]
        if css
        else [
            f"SELECT report_id, ord, 1 AS place, 99 AS confidence, 'exact-text' AS strategy, '//' || tag || '[text()=' || {Q} || words || {Q} || ']' AS sel, {asks(w='words')} FROM e WHERE words <> '12:30'",
            tests(2, 98),
            f"SELECT report_id, ord, 3, 95, 'stable-id', {bracket('id', 'element_id')}, {asks(i='element_id')} FROM e WHERE {_STABLE_ID}",
        ]
    )
    named, place = ("'#' || element_id || ' '", "':nth-of-type(' || n || ')'") if css else (bracket("id", "element_id"), "'[' || n || ']'")
    tested = "'[data-testid=\"' || test_attr || '\"] '" if css else bracket("data-testid", "test_attr")
    number = "NULL" if css else "'(' || sel || ')[' || number || ']'"
    start = "'#' || element_id" if css else f"tag || '[@id=' || {Q} || element_id || {Q} || ']'"
    same_tag = "" if css else "AND q.tag = h.tag"
    joined = "string_agg(step, ' > ' ORDER BY depth)" if css else "'/' || string_agg(step, '/' ORDER BY depth)"
    return f"""WITH e AS (SELECT *, string_split(class_name, ' ') AS classes, {_STABLE_ID} AS named FROM ({fixtures.selector_sql()}) x), o AS ({' UNION ALL '.join(offers)}),
up AS (SELECT e.report_id, e.ord, u.hpid, u.tag, u.element_id, u.test_attr, u.named FROM e JOIN e u ON u.report_id = e.report_id AND starts_with(e.hpid, u.hpid || '.')),
h AS (SELECT report_id, ord, arg_max(CASE WHEN named THEN {named} ELSE {tested} END, length(hpid)) AS anchor, arg_max(tag, length(hpid)) AS tag, arg_max(CASE WHEN named THEN element_id ELSE '' END, length(hpid)) AS i, arg_max(CASE WHEN named THEN '' ELSE test_attr END, length(hpid)) AS d FROM up WHERE named OR test_attr IS NOT NULL GROUP BY 1, 2),
m AS (SELECT o.report_id, o.ord, o.place, o.confidence, o.strategy, o.sel, h.anchor, x.ord AS hit, h.anchor IS NOT NULL AND EXISTS (SELECT 1 FROM up q WHERE q.report_id = x.report_id AND q.ord = x.ord AND (q.element_id = h.i OR q.test_attr = h.d) {same_tag}) AS inside
  FROM o LEFT JOIN h ON h.report_id = o.report_id AND h.ord = o.ord JOIN e x ON x.report_id = o.report_id AND x.tag = o.tag AND (o.i IS NULL OR x.element_id = o.i) AND (o.d IS NULL OR x.test_attr = o.d) AND (o.a IS NULL OR x.data_k = o.a) AND (o.w IS NULL OR x.words = o.w) AND list_has_all(x.classes, o.c)),
n AS (SELECT report_id, ord, place, confidence, strategy, sel, anchor, count(*) AS n, count(*) FILTER (inside) AS under, count(*) FILTER (hit <= ord) AS number FROM m GROUP BY ALL),
s AS (SELECT *, CASE WHEN n = 1 THEN sel WHEN under = 1 THEN anchor || sel ELSE {number} END AS chosen FROM n),
p AS (SELECT *, CASE WHEN contains(hpid, '.') THEN regexp_replace(hpid, '\\.[^.]*$', '') ELSE '' END AS parent, len(string_split(hpid, '.')) AS depth FROM e),
r AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY report_id, parent, tag) AS of FROM p WINDOW w AS (PARTITION BY report_id, parent, tag ORDER BY ord)),
y AS (SELECT e.report_id, e.ord, u.depth, u.named, CASE WHEN u.named THEN {start.replace('element_id', 'u.element_id').replace('tag ||', 'u.tag ||')} END AS first, u.tag || CASE WHEN u.of > 1 THEN {place.replace('n ||', 'u.n ||')} ELSE '' END AS plain FROM e JOIN r u ON u.report_id = e.report_id AND (u.hpid = e.hpid OR starts_with(e.hpid, u.hpid || '.'))),
z AS (SELECT *, max(depth) FILTER (named) OVER (PARTITION BY report_id, ord) AS start FROM y), v AS (SELECT report_id, ord, depth, CASE WHEN depth = start THEN first ELSE plain END AS step FROM z WHERE start IS NULL OR depth >= start),
f AS (SELECT report_id, ord, {joined} AS path FROM v GROUP BY 1, 2), best AS (SELECT report_id, ord, arg_min(strategy, place) AS strategy, arg_min(confidence, place) AS confidence, arg_min(chosen, place) AS chosen FROM s WHERE chosen IS NOT NULL GROUP BY 1, 2)
SELECT f.report_id AS pair_id, f.ord, coalesce(strategy, 'fallback-position') AS strategy, coalesce(confidence, 30) AS confidence, coalesce(chosen, path) AS selector FROM f LEFT JOIN best ON best.report_id = f.report_id AND best.ord = f.ord"""


@query(_ladder_sql("xpath"))
def xpath_ladder(spark, sf_dir):
    return selectors.ladder(fixtures.selector_elements(spark, sf_dir), "xpath")


@query(_ladder_sql("css"))
def css_ladder(spark, sf_dir):
    return selectors.ladder(fixtures.selector_elements(spark, sf_dir), "css")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'data-a=' || p_name || ' ' ELSE '' END || 'data-z=z' AS kept FROM part")
def stable_attributes(spark, sf_dir):
    value = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("123456789")
    attributes = F.create_map(F.lit("data-z"), F.lit("z"), F.lit("data-a"), value, F.lit("data-testid"), F.lit("t"), F.lit("title"), F.lit("x"), F.lit("data-long"), F.repeat(F.lit("y"), F.lit(150)))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(selectors.stable_attributes(attributes), lambda e: F.concat(e["key"], F.lit("="), e["value"])), " ").alias("kept"))


@query()
def css_tiers(spark, sf_dir):
    return selectors.tiers(fixtures.selector_elements(spark, sf_dir), "css")


@query()
def xpath_tiers(spark, sf_dir):
    return selectors.tiers(fixtures.selector_elements(spark, sf_dir), "xpath")


@query(f"""WITH {SIDES}, t AS (SELECT *, CASE WHEN contains(hpid, '.') THEN replace(hpid, '1.', '1.0.') ELSE hpid END AS path FROM b), h AS (SELECT report_id, path, coalesce('[data-testid="' || test_attr || '"]', '#' || replace(element_id, '-', '-'), tag) AS sel FROM t)
SELECT t.report_id AS pair_id, t.ord, string_agg(h.sel, ' ' ORDER BY length(h.path)) AS hosts FROM t JOIN h ON h.report_id = t.report_id AND starts_with(t.path, h.path || '.0.') GROUP BY 1, 2""")
def shadow_paths(spark, sf_dir):
    deep = base(spark, sf_dir).withColumn("hpid", F.when(F.col("hpid").contains("."), F.replace("hpid", F.lit("1."), F.lit("1.0."))).otherwise(F.col("hpid")))
    return selectors.shadow_path(deep).withColumn("hosts", F.array_join("hosts", " "))


@query(f"""{_CASCADE}, f AS (SELECT report_id AS pair_id, 'test-attribute' AS strategy FROM m1 WHERE n = 1 AND rn = 1 UNION ALL SELECT report_id, 'id' FROM m2 WHERE n = 1 AND rn = 1),
k AS (SELECT pair_id, strategy, count(*) AS n FROM f GROUP BY 1, 2), s AS (SELECT pair_id, CAST(sum(n) AS BIGINT) AS matched, string_agg(strategy || '=' || n, ' ' ORDER BY strategy) AS strategies FROM k GROUP BY 1),
d AS (SELECT pair_id, count(*) AS ambiguous FROM (SELECT DISTINCT report_id AS pair_id, b_ord FROM m1 WHERE n >= 2 UNION ALL SELECT DISTINCT report_id, b_ord FROM m2 WHERE n >= 2) z GROUP BY 1)
SELECT pair_id, matched, coalesce(ambiguous, 0) AS ambiguous, strategies FROM s LEFT JOIN d USING (pair_id)""")
def match_metadata(spark, sf_dir):
    found, doubtful = match.cascade(base(spark, sf_dir), comp(spark, sf_dir), [("test-attribute", 1.0), ("id", 0.9)])
    none = found.select("pair_id").limit(0)
    done = match.metadata(found, doubtful, none, none)
    text = F.array_join(F.transform(F.map_entries("by_strategy"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")
    return done.select("pair_id", "matched", "ambiguous", text.alias("strategies"))


@query(f"""WITH {SIDES} SELECT DISTINCT report_id AS pair_id, 0 AS ord, 'HPID,Absolute HPID,Tag Name,Element ID,Class Name,Text Content,CSS Selector,XPath,x,y,width,height,display,opacity' AS line FROM b
UNION ALL SELECT report_id, ord, {_line('hpid', 'hpid', 'tag', 'element_id', 'class_name', 'words', "tag || '.' || split_part(class_name, ' ', 1)", "'//' || tag || '[@title=' || chr(39) || title || chr(39) || ']'", 'x', 'y', 'width', 'height', 'display', 'opacity')} FROM b""")
def extraction_lines(spark, sf_dir):
    return exports.element_lines(base(spark, sf_dir), ["display", "opacity"])


@query()
def page_payload(spark, sf_dir):
    """Items and nodes as the grouped report has them: what repeats its apex's change is left out, the rest is merged and judged by its texts, and elements of one side only are nodes too."""
    b, c = (side(spark, sf_dir).select("pair_id", "ord", "hpid") for side in (base, comp))
    diffs = fixtures.kept_pairs(static_diffs(spark, sf_dir), sf_dir)
    repeats = fixtures.kept_pairs(cascade.apex_suppression(diffs, b.withColumnRenamed("ord", "b_ord")).where("suppressed"), sf_dir)
    left = fixtures.kept_pairs(diffs.join(repeats, ["pair_id", "b_ord", "property"], "left_anti"), sf_dir)
    items = fixtures.kept_pairs(merged_items(spark, sf_dir, left), sf_dir)
    changed = grouped.recurrences(items)
    # an item is its first element's, and so are all its paths
    tops = changed.where("instance = 1").join(repeats.select("pair_id", F.col("apex").alias("hpid")).distinct(), ["pair_id", "hpid"], "left_semi").select("pair_id", "b_ord")
    alone = lambda x, y: x.join(y, ["pair_id", "hpid"], "left_anti")
    nodes = grouped.node_classes(b.unionByName(alone(c, b)), changed, alone(c, b), alone(b, c), changed.join(tops, ["pair_id", "b_ord"], "left_semi"))
    return exports.page_payload(grouped.rebucketed(items, judged_diffs(spark, sf_dir, left, items)), nodes)
