"""The two-level plans equal the row-by-row oracle SQL run by Spark itself
over the same fixture tables."""

import re

import pytest

import __spark_entry__ as E
from ledgerscope.plans.verify import compare_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", ["general_metrics", "asset_metrics", "date_presets"])
def test_two_level_equals_direct_in_spark(spark, key):
    for t in ("events", "customer", "nation"):
        spark.read.parquet(f"{SF}/{t}.parquet").createOrReplaceTempView(t)
    text = re.sub(r"CAST\((DATE '[0-9-]+') AS TIMESTAMP\)", r"CAST(\1 AS TIMESTAMP_NTZ)",
                  E.oracle_sql()[key])
    direct = spark.sql(text)
    ours = E.queries()[key](spark, SF)
    ok, msg, n = compare_rows(ours.columns, [tuple(r) for r in ours.collect()],
                              direct.columns, [tuple(r) for r in direct.collect()])
    assert ok and n > 0, msg
