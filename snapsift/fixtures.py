"""Synthetic element pairs over ``lineitem``, as SQL that Spark and DuckDB read alike, and as element tables for the operators.

One order is one pair of reports; its lines are elements. The compare side derives from the baseline by rules on line and order numbers.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.once import made_once
from .sources.tables import by_pair, kept, parts_of

HPIDS = ["1", "1.1", "1.1.1", "1.2", "1.2.1", "1.2.1.1"]

BASE_SQL = """
SELECT report_id, ord, k, s, q, f,
  CASE ord {hpids} ELSE '1.' || CAST(ord - 4 AS {text}) END AS hpid,
  CASE f WHEN 'A' THEN 'div' WHEN 'N' THEN 'span' ELSE 'p' END AS tag,
  CASE WHEN k % 4 = 0 THEN 't' || CAST(s % 3 AS {text}) END AS test_attr,
  CASE WHEN k % 3 = 0 THEN 'id-' || CAST(ord AS {text}) END AS element_id,
  'c' || CAST(k % 5 AS {text}) || ' c' || CAST(s % 4 AS {text}) AS class_name,
  q * 10 AS width, k % 90 + 10 AS height, k % 256 AS red, s % 256 AS green, 100 AS blue, q % 20 AS margin,
  CASE WHEN k % 7 = 0 THEN 'flex' ELSE 'block' END AS display, 16 AS font_size,
  CASE WHEN k % 9 = 0 THEN '0.5' END AS opacity, 'n' || CAST(s % 3 AS {text}) AS title,
  'item ' || CAST(k AS {text}) AS words, (q % 10) * 40 AS x, ord * 30 AS y
FROM (
  SELECT l_orderkey AS report_id, l_partkey AS k, l_suppkey AS s, CAST(floor(l_quantity) AS BIGINT) AS q, l_returnflag AS f,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS BIGINT) AS ord
  FROM {lineitem}
) numbered
"""

COMPARE_SQL = """
SELECT report_id, CAST(row_number() OVER (PARTITION BY report_id ORDER BY old) AS BIGINT) AS ord, k, s, q, f, hpid, tag, test_attr, element_id, class_name,
  width, height, red, green, blue, margin, display, font_size, opacity, title, words, x, y
FROM (
  SELECT report_id, ord AS old, k, s, q, f, hpid,
    CASE WHEN m % 17 = 0 THEN 'section' ELSE tag END AS tag, test_attr, element_id, class_name,
    CASE WHEN m % 25 = 2 THEN width * 2 WHEN m % 5 = 0 THEN width + 2 WHEN m % 5 = 1 THEN width + 20 ELSE width END AS width, height,
    CASE WHEN m % 6 = 0 THEN 255 - red WHEN m % 6 = 1 AND red <= 251 THEN red + 4 ELSE red END AS red, green, blue,
    CASE WHEN m % 8 = 0 THEN margin + 10 ELSE margin END AS margin,
    CASE WHEN m % 19 = 0 THEN 'none' ELSE display END AS display,
    CASE WHEN report_id % 5 = 0 THEN 24 ELSE font_size END AS font_size,
    CASE WHEN m % 9 = 0 THEN '0.9' WHEN m % 9 = 1 THEN NULL ELSE opacity END AS opacity,
    CASE WHEN m % 13 = 0 THEN 'n9' ELSE title END AS title,
    CASE WHEN m % 10 = 3 THEN words || ' and more' ELSE words END AS words, x, y + 20 * (m % 3) AS y
  FROM (SELECT *, (k + 7 * ord + 3 * report_id) % 1000 AS m FROM ({base}) b) marked
  WHERE m % 11 <> 0
) kept
"""

#: Elements that many selectors fit: repeated and unstable ids, unstable test attributes, attributes and texts that several share.
SELECTOR_SQL = """
SELECT report_id, ord, hpid, tag, class_name, title,
  CASE WHEN element_id IS NOT NULL THEN CASE WHEN ord % 5 = 4 THEN 'uid-' || CAST(ord AS {text}) ELSE 'id-' || CAST(ord % 4 AS {text}) END END AS element_id,
  CASE WHEN test_attr IS NOT NULL THEN CASE WHEN s % 5 = 0 THEN '12345678' ELSE test_attr END END AS test_attr,
  CASE WHEN s % 2 = 0 THEN 'v' || CAST(k % 3 AS {text}) END AS data_k,
  CASE WHEN k % 3 = 0 THEN '12:30' ELSE 'item ' || CAST(k % 5 AS {text}) END AS words
FROM ({base}) b
"""


def _fill(sql: str, lineitem: str, text: str, **more: str) -> str:
    hpids = " ".join(f"WHEN {k} THEN '{h}'" for k, h in enumerate(HPIDS, 1))
    return sql.format(hpids=hpids, text=text, lineitem=lineitem, **more)


def base_sql(lineitem: str = "lineitem", text: str = "VARCHAR") -> str:
    return _fill(BASE_SQL, lineitem, text)


def compare_sql(lineitem: str = "lineitem", text: str = "VARCHAR") -> str:
    return _fill(COMPARE_SQL, lineitem, text, base=base_sql(lineitem, text))


def selector_sql(lineitem: str = "lineitem", text: str = "VARCHAR") -> str:
    return _fill(SELECTOR_SQL, lineitem, text, base=base_sql(lineitem, text))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_pair(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey")


def kept_pairs(df: DataFrame, sf_dir: str) -> DataFrame:
    """``df`` made once, dealt as the elements are."""
    return kept(df, parts_of(df.sparkSession.read.parquet(f"{sf_dir}/lineitem.parquet")))


def selector_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The elements of ``SELECTOR_SQL`` as an element table."""
    r = spark.sql(selector_sql("{lineitem}", "STRING"), lineitem=_lines(spark, sf_dir))
    attributes = _given({"data-testid": F.col("test_attr")}, {"data-k": F.col("data_k")}, {"title": F.col("title")})
    made = made_once(r.select(F.col("report_id").alias("pair_id"), "ord", "hpid", F.col("tag").alias("tag_name"), "element_id", "class_name", F.col("words").alias("text_content"), "test_attr", "data_k", "title"), attributes=attributes)
    return made.drop("test_attr", "data_k", "title")


def _given(*groups: dict[str, Column]) -> Column:
    """A map of the values that are not null. Those of a group are seldom missing, so it is made as one map, and name by name where one is."""

    def of(group: dict[str, Column]) -> Column:
        whole = F.create_map(*[x for k, v in group.items() for x in (F.lit(k), v)])
        some = F.map_concat(*[of({k: v}) for k, v in group.items()]) if len(group) > 1 else F.create_map().cast("map<string,string>")
        return F.when(reduce(and_, [v.isNotNull() for v in group.values()]), whole).otherwise(some)

    return F.map_concat(*[of(g) for g in groups])


def raw(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    make = base_sql if side == "base" else compare_sql
    return spark.sql(make("{lineitem}", "STRING"), lineitem=_lines(spark, sf_dir))


def elements(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """The side's element table: one row per element of each pair."""
    r = raw(spark, sf_dir, side)
    px = lambda c: F.concat(F.col(c).cast("string"), F.lit("px"))
    styles = {
        "width": px("width"),
        "height": px("height"),
        "color": F.concat(F.lit("rgb("), F.concat_ws(", ", "red", "green", "blue"), F.lit(")")),
        "margin-top": px("margin"),
        "display": F.col("display"),
        "font-size": px("font_size"),
        "opacity": F.col("opacity"),
    }
    opacity = styles.pop("opacity")
    attributes = [{"data-testid": F.col("test_attr")}, {"title": F.col("title")}]
    css = F.concat(F.col("tag"), F.lit("."), F.split("class_name", " ")[0])
    r = made_once(r, styles=_given(styles, {"opacity": opacity}), attributes=_given(*attributes))
    return r.select(
        F.col("report_id").alias("pair_id"),
        "ord",
        "hpid",
        F.col("hpid").alias("absolute_hpid"),
        F.col("tag").alias("tag_name"),
        "element_id",
        "class_name",
        F.col("words").alias("text_content"),
        css.alias("css_selector"),
        F.concat(F.lit("//"), F.col("tag"), F.lit("[@title='"), F.col("title"), F.lit("']")).alias("xpath"),
        "styles",
        "attributes",
        F.struct(F.col("x"), F.col("y"), F.col("width"), F.col("height")).alias("rect"),
    )
