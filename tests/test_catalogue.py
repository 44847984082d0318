"""Every named query: equal to its SQL where it has some, else runnable with rows."""

import pytest

from attesta.plans import catalogue
from tests import compare

MAY_BE_EMPTY = {"temporal_dispersion", "open_questions"}


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, sf, name):
    compare.same(spark, sf, catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0 or name in MAY_BE_EMPTY


def test_entry(spark, sf):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
