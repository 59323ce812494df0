import pytest
from oracle import DATA, compare

from framekit.plans import queries as core


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_matches_sql(spark, name):
    compare(spark, core.queries()[name], core.oracle_sql()[name], f"{DATA}/sf0.001")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
