"""Shadow scopes, re-rooted paths, expanded trees, pseudo-elements and whole payloads on small inputs."""

import json

from snapsift.operators import cascade, filters, pseudo, selectors
from snapsift.sources import exports, html


def paths(text):
    return [(r["hpid"], r["depth"], r["tag_name"], r["text_content"]) for r in html.parse(text)]


def test_shadow_roots_are_scopes():
    got = paths("<body><p>a<div id=h>light<b>x</b><template shadowrootmode=open><p>in<section><i>deep</i></section></div></p><em>e</em></template><u>y</u></div><p>z</body>")
    assert got == [("1", 0, "body", None), ("1.1", 1, "p", "a"), ("1.2", 1, "div", "light"), ("1.2.0.1", 2, "p", "in"), ("1.2.0.2", 2, "section", None), ("1.2.0.2.1", 3, "i", "deep"), ("1.2.0.3", 2, "em", "e"), ("1.2.1", 2, "b", "x"), ("1.2.2", 2, "u", "y"), ("1.3", 1, "p", "z")]
    nested = paths("<body><div><template shadowrootmode=OPEN><div><template shadowrootmode=open><p>in</template></div></template><template shadowrootmode=open><p>second</template><template><p>plain</template></div></body>")
    assert nested == [("1", 0, "body", None), ("1.1", 1, "div", None), ("1.1.0.1", 2, "div", None), ("1.1.0.1.0.1", 3, "p", "in")]
    assert paths("<body><div><template shadowrootmode=closed><p>no</template></div></body>") == [("1", 0, "body", None), ("1.1", 1, "div", None)]
    assert paths("<body><div><template shadowrootmode=open><p>never closed") == [("1", 0, "body", None), ("1.1", 1, "div", None), ("1.1.0.1", 2, "p", "never closed")]


def test_shadow_paths_of_parsed_pages(spark):
    page = '<body><div id="a"><template shadowrootmode=open><span data-testid="t"><template shadowrootmode=open><p>in</p></template></span></template></div></body>'
    rows = html.elements(spark.createDataFrame([(1, page), (2, None)], "page_id long, html string")).withColumnRenamed("page_id", "pair_id")
    got = {r.ord: r.hosts for r in selectors.shadow_path(rows).collect()}
    assert got == {3: ["#a"], 4: ["#a", '[data-testid="t"]']}


def test_roots_count_anew(spark):
    rows = [(1, k, h, t) for k, (h, t) in enumerate([("1", "body"), ("1.1", "div"), ("1.1.0.1", "p"), ("1.1.2", "div"), ("1.2", "i"), ("1.10", "div"), ("1.10.3", "i")], 1)]
    e = spark.createDataFrame(rows, "pair_id long, ord long, hpid string, tag_name string")
    got = {r.absolute_hpid: (r.hpid, r.depth) for r in filters.rerooted(e, e.where("tag_name = 'div'")).collect()}
    assert got == {"1.1": ("1", 0), "1.1.0.1": ("1.0.1", 1), "1.1.2": ("1.2", 1), "1.10": ("2", 0), "1.10.3": ("2.3", 1)}
    assert filters.rerooted(e, e.where("false")).collect() == []


def test_trees_open_towards_urgent_nodes(spark):
    nodes = spark.createDataFrame([(1, "1.2.3", "high"), (1, "1.2", "low"), (1, "1.5.1.1", "low"), (1, "2", "critical")], "pair_id long, hpid string, severity string")
    got = {r.hpid: (r.synthetic, r.children, r.expand) for r in cascade.expanded(nodes).collect()}
    assert got == {"1": (True, 2, True), "1.2": (False, 1, True), "1.2.3": (False, 0, False), "1.5": (True, 1, False), "1.5.1": (True, 1, False), "1.5.1.1": (False, 0, False), "2": (False, 0, False)}


def test_best_attributes_in_their_order(spark):
    schema = "pair_id long, ord long, hpid string, tag_name string, element_id string, class_name string, text_content string, attributes map<string,string>"
    row = lambda k, h, t, c, a: (1, k, h, t, None, c, None, a)
    e = spark.createDataFrame([row(1, "1", "form", "box", {"data-z": "1"}), row(2, "1.1", "nav", None, {"data-testid": "12345678", "data-b": "2", "data-a": "1"}), row(3, "1.1.1", "div", "c", {"role": "x", "data-key": "k"}), row(4, "1.1.1.1", "p", None, {})], schema)
    got = {(r.ord, r.level): (r.up, r.name, r.value) for r in selectors.stable_ancestors(e, 2).collect()}
    assert got == {(2, 0): ("1", "class", "box"), (3, 0): ("1.1", "data-a", "1"), (3, 1): ("1", "class", "box"), (4, 0): ("1.1.1", "data-key", "k"), (4, 1): ("1.1", "data-a", "1")}
    assert {r.ord: r.up for r in selectors.semantic_ancestor(e).collect()} == {2: "1", 3: "1.1", 4: "1.1"}


def test_pseudo_elements_compare_in_one_pass(spark):
    side = lambda *maps: spark.createDataFrame([(1, str(k), m) for k, m in enumerate(maps)], "pair_id long, hpid string, pseudo map<string,map<string,string>>")
    a = side({"::before": {"content": "'a'", "color": "red", "cursor": "x"}}, {"::after": {"content": "none", "color": "red"}}, None, {"::after": {"content": "'b'"}})
    b = side({"::before": {"content": "'a'", "color": "blue", "width": "1px", "cursor": "y"}}, {"::after": {"content": "'n'", "color": "red"}}, {}, None)
    got = sorted(tuple(r)[1:] for r in pseudo.compare(a, b).collect())
    assert got == [("0::before", "color", "red", "blue", "modified"), ("0::before", "width", None, "1px", "added"), ("1::after", "color", None, "red", "added"), ("1::after", "content", None, "'n'", "added"), ("3::after", "content", "'b'", None, "removed")]


def test_json_lines_make_a_document(spark):
    summary = spark.createDataFrame([(1, 2, 1, 1, 2, 0, 2, 0, 0), (2, 0, 0, 0, 0, 0, 0, 0, 0)], "pair_id long, matched long, unchanged long, modified long, diffs long, critical long, high long, medium long, low long")
    reports = spark.createDataFrame([(1, ('http://a/"x"', 3), ("http://b", 2))], "pair_id long, baseline struct<url:string,n:long>, compare struct<url:string,n:long>")
    diffs = spark.createDataFrame([(1, 4, "width", "1px", "2px", "modified", "size", "high"), (1, 4, "color", None, "red", "added", "visual", "high")], "pair_id long, b_ord long, property string, base_value string, compare_value string, type string, category string, severity string")
    matched = spark.createDataFrame([(1, 4, "1.1", "p", "id", 0.9), (1, 10, "1.2", "a", "id", 0.9)], "pair_id long, b_ord long, hpid string, tag_name string, strategy string, confidence double")
    unmatched = spark.createDataFrame([(1, "removed", 9, "1.9", "b"), (1, "added", 12, "1.8", "i"), (1, "added", 3, "1.7", "i")], "pair_id long, status string, ord long, hpid string, tag_name string")
    rows = exports.comparison_json(summary, reports, diffs, matched, unmatched, "static").collect()
    text = {p: "".join(r.line for r in sorted((r for r in rows if r.pair_id == p), key=lambda r: (r.part, r.key))) for p in (1, 2)}
    one, two = json.loads(text[1]), json.loads(text[2])
    assert one["baseline"] == {"url": 'http://a/"x"', "n": 3} and two["baseline"] is None and two["comparison"]["results"] == two["unmatchedElements"] == []
    assert [(r["hpid"], [d["property"] for d in r["differences"]]) for r in one["comparison"]["results"]] == [("1.1", ["color", "width"]), ("1.2", [])] and one["comparison"]["results"][0]["differences"][0]["baseValue"] is None
    assert [(u["status"], u["hpid"]) for u in one["unmatchedElements"]] == [("added", "1.7"), ("added", "1.8"), ("removed", "1.9")]
