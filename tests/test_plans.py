"""Plans: what reaches the scan, and what stays out of the rows' way."""

import re

from quarrylens import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_used_columns_reach_the_scan(spark):
    p = plan(catalog.queries()["hotspots"](spark, SF))
    scans = " ".join(re.findall(r"ReadSchema: struct<([^>]*)>", p))
    assert "l_quantity" in scans and not re.search(r"\btext:|l_comment|l_tax|o_totalprice|p_brand|p_retailprice", scans)


def test_no_python_in_relational_queries(spark):
    for name in ("hotspots", "callers_of", "located_edges", "deadcode", "resolve_imports", "module_stats", "text_search", "edge_groups", "upsert_merge", "gain_per_command"):
        assert not re.search("Python|Pandas|ArrowEval|MapInArrow", plan(catalog.queries()[name](spark, SF))), name


def test_no_cross_products_of_tables(spark):
    for name in ("hotspots", "callers_of", "located_edges", "deadcode", "resolve_imports", "changed_symbols", "search_provenance"):
        assert "CartesianProduct" not in plan(catalog.queries()[name](spark, SF)), name
