"""Every registered query of the engine against its SQL, on the smallest tables.

Unless SNAPSIFT_ALL is set, some of them stand for the others.
"""

import os
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

from snapsift.plans import catalog, catalog_pages, catalog_reports  # noqa: F401  the others register their queries with the first

SF_DIR = "/root/testdata/sf0.001"
TABLES = ["customer", "supplier", "part", "orders", "lineitem", "events", "pages"]
#: What stands for the others unless SNAPSIFT_ALL is set: queries of every module, few of those that plan the whole diff.
FOR_ALL = [
    "normalize_color_hex", "normalize_unit", "expand_border_and_font", "classify_tier_and_section", "css_selectors", "match_suffix", "match_cascade", "match_position", "unmatched_removed",
    "diff_dynamic", "cascade_inherited", "severity_summary", "diff_tree", "url_delta", "rect_pivot", "visual_manifest", "upsert_comparisons", "perf_stats", "readiness_sessions", "readiness_stream",
    "escaped_texts", "section_semantics", "class_hierarchies", "remeasured_manifest", "rebucketed_groups", "node_classes", "breadcrumbs", "cached_comparisons", "put_and_delete", "comparable_reports", "csv_sections", "xpath_ladder",
    "css_ladder", "apex_suppression", "keyframe_pack", "match_nearest_free", "match_alignment", "filtered_roots", "tree_expanded", "semantic_ancestors", "tree_badges", "comparison_json_lines", "workbook_rows", "top_apexes_of_reports", "readiness_live",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


def plain(value):
    """Numbers of one value are one number, whatever their type; nulls are None."""
    if value is None or value is pd.NA or (isinstance(value, float) and value != value):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, (int, float, Decimal)) or type(value).__module__ == "numpy" and hasattr(value, "item") and not isinstance(value.item(), (str, bool, type(None))):
        try:
            return round(float(value), 6)
        except (TypeError, ValueError):
            return str(value)
    return value.item() if type(value).__module__ == "numpy" and hasattr(value, "item") else value


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(str(tuple(map(plain, r))) for r in frame.itertuples(index=False))


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="needs the test tables")
@pytest.mark.parametrize("name", list(catalog.SQL) if os.environ.get("SNAPSIFT_ALL") else FOR_ALL)
def test_query_gives_what_its_sql_gives(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF_DIR).toPandas(), duck.sql(catalog.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_is_registered_once():
    assert set(catalog.SQL) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 100
