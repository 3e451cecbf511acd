import __spark_entry__ as entry


def test_registry():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 30


def test_flagship(spark):
    assert entry.entry(spark).count() > 0
