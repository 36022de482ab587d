import os

import pytest

from sqlcheck import same
from fluvispark.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_languages(spark):
    got = queries.op4_word_first_language(spark, SF).filter("held_out").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    assert got.filter("lang_pred <> lang").count() <= 0.02 * got.count()
