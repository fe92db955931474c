"""Every query of the library against its SQL, on the smallest tables."""

import pytest

from tests.conftest import DATA, same_rows
from tessera.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_same_rows(spark, duck, name):
    same_rows(catalogue.QUERIES[name](spark, DATA), duck, catalogue.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
