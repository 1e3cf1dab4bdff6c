"""Every registered query beside its checking SQL on the smallest set."""

import compare
import pytest

from catalogspark import plans

REG = plans.load_all()


@pytest.mark.parametrize("name", list(REG.QUERIES))
def test_query(spark, name):
    assert compare.differences(name, REG.QUERIES[name], REG.ORACLES.get(name), spark, "0.001") == ""


def test_every_oracle_belongs_to_a_query():
    assert set(REG.ORACLES) <= set(REG.QUERIES)
