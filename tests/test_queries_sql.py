import os

import pytest

from sqlcheck import same
from fluvispark.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, name):
    same(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)
