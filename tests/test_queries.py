import pytest
from helpers import connect, plain, rounded

from attestra.plans import catalogue


@pytest.fixture(scope="module")
def sql(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_gives_the_rows_of_its_sql(spark, sf, sql, name):
    got, want = plain(catalogue.QUERIES[name](spark, sf).toPandas()), plain(sql.sql(catalogue.SQL[name]).df())
    assert got[0] == want[0]
    assert rounded(got[1]) == rounded(want[1])


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
