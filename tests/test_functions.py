"""Scalar goldens, and operators against plain models."""

import random

import pytest
from pyspark.sql import functions as F

from snapsift.config import DEFAULT, STATIC
from snapsift.functions import css
from snapsift.operators import diff, match, report, visual
from snapsift.sources import html


def values(spark, pairs, expression):
    rows = spark.createDataFrame([(k, v) for k, (v, _) in enumerate(pairs)], "k int, v string").select("k", expression(F.col("v")).alias("r")).collect()
    return [(pairs[r.k][0], r.r) for r in sorted(rows, key=lambda r: r.k)]


@pytest.mark.parametrize(
    "expression, pairs",
    [
        (css.normalize_color, [("#abc", "rgba(170, 187, 204, 1)"), ("#11223380", "rgba(17, 34, 51, 0.5)"), ("transparent", "rgba(0, 0, 0, 0)"), ("rebeccapurple", "rgba(102, 51, 153, 1)"),
                               ("hsl(120, 100%, 50%)", "rgba(0, 255, 0, 1)"), ("rgb(1,2,3)", "rgba(1, 2, 3, 1)"), ("nonsense", "nonsense"), (None, None)]),
        (lambda v: css.normalize_unit(v, F.lit("width")), [("1em", "16.00px"), ("50vw", "512.00px"), ("12pt", "16.00px"), ("0", "0px"), ("1.5", "1.50px"), ("50%", "50.00%"), ("auto", "auto"), ("x", "x"), (None, None)]),
        (css.normalize_font, [('"times new roman", serif', "Times New Roman, serif"), ("", ""), (None, None)]),
        (report.csv_field, [("=1", "'=1"), ('a"b', '"a""b"'), ("a,b", '"a,b"'), (None, ""), ("plain", "plain")]),
    ],
)
def test_goldens(spark, expression, pairs):
    assert values(spark, pairs, expression) == pairs


def test_text_divergence_reads_whole_texts(spark):
    """Texts that differ behind their 500th character only."""
    rows = spark.createDataFrame([("x" * 600 + "a" * 600, "x" * 600 + "b" * 600), ("x" * 900, "x" * 900)], "a string, b string")
    assert [r.d for r in rows.select(report.text_divergence(F.col("a"), F.col("b")).alias("d")).collect()] == [0.5, 0.0]



def test_shorthands(spark):
    row = spark.createDataFrame([({"margin": "1px 2px 3px", "margin-left": "9px", "border": "1px solid red"},)], "s map<string,string>").select(css.expand_shorthands(F.col("s")).alias("e")).first()
    assert row.e["margin-top"] == "1px" and row.e["margin-right"] == "2px" and row.e["margin-left"] == "9px" and row.e["border-top-style"] == "solid" and "margin" not in row.e


def test_key_verdicts_equal_the_greedy_loop(spark):
    rng = random.Random(2)
    b = [(p, o, rng.choice("abc") if rng.random() < 0.9 else None) for p in range(30) for o in range(rng.randint(0, 5))]
    c = [(p, o, rng.choice("abcd")) for p in range(30) for o in range(rng.randint(0, 4))]
    make = lambda rows: spark.createDataFrame(rows, "pair_id long, ord long, element_id string")
    got = {(r.pair_id, r.b_ord): (r.verdict, r.c_ord) for r in match.key_verdicts(make(b), make(c), F.col("element_id")).collect()}
    used = set()
    for p, o, key in b:
        every = [x for x in c if x[0] == p and x[2] == key and key]
        free = [x for x in every if x[:2] not in used]
        want = ("definitive", free[0][1]) if len(free) == 1 else ("ambiguous", None) if free else ("orphan", None)
        if want[0] == "definitive":
            used.add(free[0][:2])
        assert got[p, o] == want


def elements(spark, rows):
    schema = "pair_id long, ord long, hpid string, tag_name string, absolute_hpid string, element_id string, css_selector string, xpath string, text_content string, styles map<string,string>, attributes map<string,string>, rect struct<x:int,y:int>"
    return spark.createDataFrame([(1, k, h, t, h, None, None, None, "t", {"width": "10px"}, {}, (0, 0)) for k, (h, t) in enumerate(rows, 1)], schema)


def test_alignment_and_orphans(spark):
    left, right = elements(spark, [("1", "a"), ("1.1", "b")]), elements(spark, [("1", "a"), ("1.2", "c")])
    events = [(r.event, r.b_ord, r.c_ord) for r in match.align(left, right).orderBy("b_ord").collect()]
    assert events == [("pair", 1, 1), ("orphan", 2, 2)]
    dropped, kept = match.match(left, right), match.match(left, right, DEFAULT.merge(drop_alignment_orphans=False))
    assert dropped["removed"].count() == 0 and kept["removed"].count() == 1 and kept["added"].count() == 1


def test_a_report_equals_itself(spark):
    both = elements(spark, [("1", "a"), ("1.1", "b"), ("1.2", "c")])
    found = match.match(both, both)
    assert found["matches"].count() == 3 and diff.compare(found["matches"], both, both, STATIC).count() == 0


def test_keyframes_end_beyond_the_document(spark):
    rows = [(1, k, f"1.{k}", y, 50, 400) for k, y in enumerate([0, 90, 390, 900, 2000])]
    got = visual.keyframes(spark.createDataFrame(rows, "pair_id long, ord long, hpid string, document_y long, height long, document_height long"), 100).collect()
    assert sorted(r.ord for r in got) == [0, 1, 2, 3, 4]


def test_dom_paths():
    rows = html.parse("<html><body class='x'><div><p>a<p>b<script>no</script></div><br><ul><li>1<li>2</ul></body>")
    assert [(r["hpid"], r["tag_name"], r["text_content"]) for r in rows] == [("1", "body", None), ("1.1", "div", None), ("1.1.1", "p", "a"), ("1.1.2", "p", "b"), ("1.2", "ul", None), ("1.2.1", "li", "1"), ("1.2.2", "li", "2")]


def test_config():
    with pytest.raises(KeyError):
        DEFAULT.merge(nothing=1)
    with pytest.raises(ValueError):
        DEFAULT.merge(look_ahead=0)
    assert DEFAULT.mode("unknown") is DEFAULT.modes["static"]


def test_plain_values_have_the_form_of_others(spark):
    colors = ["rgb(1, 20, 255)", "rgb(01, 20, 255)", "rgb(1,20,255)", "rgb(1, 20, 255)\n", " RGB(1, 20, 255)", "rgb(1, 2)", "rgb(0, 0, 1000)", None]
    sizes = ["20px", "020px", "20px\n", "20PX", " 20px ", "0px", "1.5px", "123456789012px", None]
    rows = spark.createDataFrame([(c, s) for c, s in zip(colors + [None], sizes, strict=True)], "c string, s string")
    got = rows.select(css.normalize_color(F.col("c")).alias("c"), css.normalize_unit(F.col("s"), F.lit("width")).alias("s"), css.channels(css.normalize_color(F.col("c"))).alias("n")).collect()
    assert [r.c for r in got][:-1] == ["rgba(1, 20, 255, 1)"] * 5 + ["rgba(1, 2, 1)", "rgba(0, 0, 1000, 1)", None]
    assert [r.s for r in got] == ["20.00px", "20.00px", "20.00px", "20.00px", "20.00px", "0px", "1.50px", "123456789012.00px", None]
    assert [r.n for r in got][:-1] == [[1, 20, 255, 1]] * 5 + [[1, 2, 1], [0, 0, 1000, 1], None]
    assert rows.limit(1).select(css.channels(F.lit("url(x) rgb(1, 2, 3)")).alias("a"), css.channels(F.lit("rgba(1, 2, 3, 1.2.3)")).alias("b"), css.channels(F.lit("red")).alias("c")).first() == ([1, 2, 3], [1, 2, 3, None], None)
