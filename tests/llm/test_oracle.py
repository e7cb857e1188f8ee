import pytest

from quarrylens.llm import queries as q
from tests.compare import connect, differs

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert differs(q.queries()[name](spark, SF), connect(SF), q.oracle_sql()[name]) == ""
