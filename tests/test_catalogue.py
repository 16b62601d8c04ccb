"""Every query of the engine against its SQL, at the smallest scale."""

import pytest

from strandmill.plans import catalogue
from tests.conftest import TINY


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_sql(spark, same_rows, name):
    same_rows(catalogue.QUERIES[name](spark, TINY), catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, TINY).count() > 0


def test_no_query_reads_a_part_of_its_rows():
    """No query picks rows by small ids or remainders, but for the query set of searches."""
    import inspect
    import re

    from strandmill.plans import note_queries

    code = inspect.getsource(catalogue) + inspect.getsource(note_queries)
    assert set(re.findall(r'where\("(?:vec_id|doc_id|conv_id|turn|record_id)[^"]*"\)', code)) == {'where("vec_id % 100 = 0")', 'where("doc_id % 100 = 0")'}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
