"""Every registered query against its SQL on the smallest tables."""

import pytest

from quarrylens import catalog
from tests.compare import connect, differs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_equals_its_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert df.collect() is not None
    else:
        assert differs(df, con, sql) == ""


def test_only_sequential_results_have_no_sql():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"call_cycles", "communities", "bridges", "export_graph"}
