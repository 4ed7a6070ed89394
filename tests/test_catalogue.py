import pytest

from skyloom.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_gives_what_its_sql_gives(name, spark, sf_dir, same_as_sql):
    frame = catalogue.queries()[name](spark, sf_dir)
    sql = catalogue.oracle_sql().get(name)
    if sql:
        same_as_sql(frame, sql)
    else:
        assert frame.count() > 0


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
