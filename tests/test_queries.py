import pytest

import __spark_entry__
from checks.compare import connect, differences

QUERIES = __spark_entry__.queries()
ORACLES = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    if name in ORACLES:
        assert differences(df, duck, ORACLES[name]) is None
    else:
        assert df.count() > 0
