import os

import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"


def test_registry():
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and {"p3_found", "p4_found", "p5_found", "usage"} <= set(found)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")
def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["target", "type"] and df.count() > 0
