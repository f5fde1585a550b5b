"""The entry points as a driver uses them."""

import __spark_entry__


def test_entry(spark):
    rows = __spark_entry__.entry(spark).collect()
    assert rows and {"ip", "class", "confidence"} <= set(rows[0].asDict())


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
