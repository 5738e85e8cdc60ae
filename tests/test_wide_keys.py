"""Suppliers whose keys have more than five digits."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from tapewright.plans.registry import QUERIES
from tapewright.sources import panels

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_symbols_of_different_keys_differ(spark):
    keys = [7, 99_999, 10_000, 100_000, 100_001, 360_000, 36_000]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k long").select(panels.symbol(F.col("k"))).collect()]
    assert got == ["S00007", "S99999", "S10000", "S100000", "S100001", "S360000", "S36000"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_documents_of_companies_with_long_keys(spark, tmp_path):
    for t in ("nation", "region"):
        shutil.copy(f"{SF}/{t}.parquet", tmp_path)
    for t, key in (("supplier", "s_suppkey"), ("lineitem", "l_suppkey")):
        spark.read.parquet(f"{SF}/{t}.parquet").withColumn(key, F.when(F.col(key) <= 3, F.col(key) + 9_999).otherwise(F.col(key) + 99_996)).write.parquet(f"{tmp_path}/{t}.parquet")
    got = QUERIES["snk2_nested"](spark, str(tmp_path)).collect()
    companies = {r[0] for r in spark.read.parquet(f"{tmp_path}/supplier.parquet").select(panels.symbol(F.col("s_suppkey"))).collect()}
    assert {r["symbol"] for r in got} == companies and len(got) == 3 * len(companies) == 30
