import pytest
from compare import DATA, connect, same

from tabulon.plans import catalogue


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_against_sql(spark, con, name):
    same(catalogue.queries()[name](spark, DATA), con, catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


def test_schema_catalog_has_every_table_and_no_other(spark):
    from pathlib import Path

    spark.range(1).createOrReplaceTempView("left_by_another_query")
    got = {r.table for r in catalogue.queries()["q43_schema_catalog"](spark, DATA).collect()}
    assert got == {f"q43_{p.stem}" for p in Path(DATA).glob("*.parquet")} and len(got) == 14


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())
