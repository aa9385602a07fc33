"""Every query against its SQL on the smallest tables; those without SQL must give rows."""

import pytest

from tidemark.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_as_sql(name, spark, sf, duck, same):
    same(catalogue.QUERIES[name](spark, sf).toPandas(), duck.execute(catalogue.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL) - {"weather_ridge", "power_grid"}))
def test_gives_rows(name, spark, sf):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
