"""Every query of the training-data operators that has SQL against it."""

import pytest

from compare import duck_rows, spark_rows
from longview.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, name):
    assert spark_rows(registry.queries()[name](spark, SF)) == duck_rows(SF, registry.oracle_sql()[name])
