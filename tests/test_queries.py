import pytest

import __spark_entry__
from docloom import queries

from .conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    same_rows(df, duck, queries.ORACLES[name])


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_registry_is_complete():
    assert set(queries.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
