"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

from corpusveil import catalogue
from tests.oracle import DATA, assert_same

needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")


@needs_data
@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, name):
    assert_same(spark, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


@needs_data
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ship(spark):
    """Workers can import the package though only the driver knows where it is."""
    from corpusveil.functions.ship import ship

    ship(spark)

    def run(batches):
        import corpusveil

        for b in batches:
            yield b.assign(ok=corpusveil.__doc__ is not None)

    assert spark.range(3).mapInPandas(run, "id long, ok boolean").filter("ok").count() == 3
