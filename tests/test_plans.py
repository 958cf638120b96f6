"""What plans must not do: make a value again for each of its uses, or run a step once for each of its readers."""

import json
from collections import Counter

from snapsift import fixtures
from snapsift.config import DEFAULT, STATIC
from snapsift.operators import diff, filters, match, selectors
from snapsift.plans import catalog, catalog_pages, catalog_reports  # noqa: F401  the others register their queries with the first

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_attributes_are_made_once_a_row(spark):
    elements = fixtures.selector_elements(spark, SF_DIR)
    for found in (selectors.stable_ancestors(elements, 2), selectors.semantic_ancestor(elements)):
        assert plan(found).count("map_filter") <= 2  # the elements are read twice, for what is asked and for what answers; it was over a hundred


def test_alignment_streams_its_pairs(spark):
    """No group goes to Python alone, and pairs that lie over several batches come out whole."""
    b, c = catalog.base(spark, SF_DIR), catalog.comp(spark, SF_DIR)
    got = match.align(b, c)
    assert "CoGroup" not in plan(got)
    want = sorted(map(str, got.collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        assert sorted(map(str, match.align(b, c).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_steps_of_matching_are_made_once(spark):
    """What a step finds is kept: neither elements nor document order are made again for the steps and results that read them."""
    found = match.match(catalog.base(spark, SF_DIR), catalog.comp(spark, SF_DIR), DEFAULT.merge(drop_alignment_orphans=False))
    for name, rows in found.items():
        assert not any(step in plan(rows) for step in ("map_filter", "MapInArrow", "Window")), name


def test_both_sides_of_a_pair_meet(spark):
    """Sides that are dealt by pair already, in adaptive plans that merge their partitions differently."""
    spark.conf.set("spark.sql.shuffle.partitions", 24)
    try:
        b, c = (filters.first_elements(side(spark, "/root/testdata/sf0.01"), 100) for side in (catalog.base, catalog.comp))
        pairs, both = match.align(b, c).where("event = 'pair'").count(), match.cascade(b, c, [("absolute-hpid", 1.0)])[0].count()
        assert pairs > 50_000 and both == b.join(c, ["pair_id", "hpid"]).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_page_with_a_part_twice(spark, tmp_path):
    """Two lines of one part by different suppliers are each an image of their own."""
    import duckdb

    con = duckdb.connect()
    line = "2.0::DOUBLE AS l_quantity, 1.0::DOUBLE AS l_extendedprice, 'A' AS l_returnflag, TIMESTAMP '2000-01-01' AS l_shipdate"
    con.execute(f"CREATE TABLE lineitem AS SELECT 1::BIGINT AS l_orderkey, 10::BIGINT AS l_partkey, k % 2::BIGINT AS l_suppkey, CASE WHEN k = 0 THEN 7 ELSE 1 END::INT AS l_linenumber, {line} FROM range(2) r(k) UNION ALL SELECT 1, 11, 1, 2 + k::INT, {line} FROM range(3) r(k)")
    con.execute(f"COPY lineitem TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    got = [(r.pair_id, r.ready) for r in catalog.QUERIES["page_ready"](spark, str(tmp_path)).collect()]
    assert got == con.sql(catalog.SQL["page_ready"]).fetchall() == [(1, True)]


def test_border_colours_that_follow_the_text(spark):
    """They are left out on the pair's own row, without a window over all diffs."""
    side = "pair_id long, ord long, styles map<string,string>, attributes map<string,string>, text_content string"
    of = lambda color, top, left: {"color": color, "border-top-color": top, "border-left-color": left}
    b = spark.createDataFrame([(1, 1, of("red", "rgb(255,0,0)", "red"), {}, "x"), (1, 2, of("red", "red", None), {}, "x"), (1, 3, {"border-top-color": "red"}, {}, None)], side)
    c = spark.createDataFrame([(1, 1, of("blue", "#00f", "green"), {}, "x"), (1, 2, of("red", "blue", "blue"), {}, "x"), (1, 3, {"border-top-color": "blue"}, {"color": "red"}, "y")], side)
    got = diff.compare_pairs(diff.paired(b, c, ["pair_id", "ord"]).selectExpr("pair_id", "b_ord", "c_ord", "b", "c"), STATIC)
    assert "Window" not in plan(got)
    kept = {(r.b_ord, r.property) for r in got.collect()}
    assert {k for k in kept if k[1].endswith("color")} >= {(1, "color"), (1, "border-left-color"), (2, "border-top-color"), (2, "border-left-color"), (3, "border-top-color")} and (1, "border-top-color") not in kept


def test_readers_of_the_diffs_share_them(spark):
    """``l_quantity`` is read by whatever makes elements anew: a tree, an export or labels made them for every reader."""
    made = lambda df: sum("Relation [" in line and "l_quantity" in line for line in plan(df).splitlines())
    assert made(catalog_pages.tree_expanded(spark, SF_DIR)) == 0
    assert made(catalog_pages.workbook_rows(spark, SF_DIR)) == 0
    assert made(catalog_reports.csv_sections(spark, SF_DIR)) == 0
    assert made(catalog_reports.label_map(spark, SF_DIR)) <= 4  # two sides of the diffs, labels of items, labels of all; it was seven


def test_page_payload_has_the_steps_of_the_report(spark):
    """Nodes as apexes, insertions and deletions make them, items without what repeats its apex and with the severities that texts leave them."""
    of = lambda rows, *names: {tuple(r[n] for n in names) for r in rows}
    b, c = (side(spark, SF_DIR).select("pair_id", "ord", "hpid").collect() for side in (catalog.base, catalog.comp))
    suppression = catalog.apex_suppression(spark, SF_DIR).collect()
    found = catalog_reports.page_payload(spark, SF_DIR).collect()
    nodes = {(r.pair_id, n["hpid"]): n["type"] for r in found for n in json.loads(r.nodes)}
    items = {(r.pair_id, i["b_ord"]): i for r in found if r["items"] for i in json.loads(r["items"])}
    here, there = of(b, "pair_id", "hpid"), of(c, "pair_id", "hpid")
    assert set(nodes) == here | there
    assert {k for k, t in nodes.items() if t == "DOM_DELETION"} == here - there and {k for k, t in nodes.items() if t == "DOM_INSERTION"} == there - here
    left, tops = of([r for r in suppression if not r.suppressed], "pair_id", "hpid"), of([r for r in suppression if r.suppressed], "pair_id", "apex")
    shown = {k for k, t in nodes.items() if t in ("DIFF_APEX", "DIFF_DETAIL")}
    assert shown == left and of(suppression, "pair_id", "hpid") - left
    path = {(r.pair_id, r.ord): r.hpid for r in b}
    for (pair, ord), item in items.items():
        kind = "DIFF_APEX" if (pair, path[pair, ord]) in tops else "DIFF_DETAIL"
        assert {nodes[pair, p] for p in item["hpids"].split(",")} == {kind}
    counts = Counter((r.pair_id, r.hpid) for r in suppression if not r.suppressed)
    assert all(item["total"] == counts[pair, path[pair, ord]] for (pair, ord), item in items.items())
    assert sum(len(i["hpids"].split(",")) for i in items.values()) == len(left)
