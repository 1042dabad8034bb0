import json
import os
import tempfile

from pyspark.sql import types as T

from rebound.sources import read_attempts_csv, read_config, read_table, write_table
from conftest import SF_SMALL


def test_csv_skips_only_long_lines(spark):
    d = tempfile.mkdtemp(prefix="rebound-csv-")
    p = os.path.join(d, "a.csv")
    with open(p, "w") as f:
        f.write("transaction_id,amount_usd,retry_attempt_num\nA,10.5,1\nB,notanumber,2,extra\nC,abc,x\nD,3\nE, 4.5 ,,\nF,,7\n")
    schema = T.StructType([T.StructField("transaction_id", T.StringType()),
                           T.StructField("amount_usd", T.DoubleType()),
                           T.StructField("retry_attempt_num", T.IntegerType())])
    df = read_attempts_csv(spark, p, schema)
    rows = df.collect()
    assert df.count() == 4 and [r[0] for r in df.select("amount_usd").collect()] == [10.5, None, 3.0, None]
    assert [tuple(r) for r in rows] == [("A", 10.5, 1), ("C", None, None), ("D", 3.0, None), ("F", None, 7)]


def test_write_and_read_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="rebound-out-")
    df = read_table(spark, SF_SMALL, "orders", ["o_orderkey", "o_orderdate", "o_orderstatus"])
    assert dict(df.dtypes)["o_orderdate"] == "timestamp"            # NTZ adapted (T24)
    write_table(df, os.path.join(d, "o"), partition_by=["o_orderstatus"])
    assert spark.read.parquet(os.path.join(d, "o")).count() == df.count()


def test_read_config(spark):
    d = tempfile.mkdtemp(prefix="rebound-cfg-")
    p = os.path.join(d, "policy.json")
    with open(p, "w") as f:
        json.dump({"allowlist": ["amount_usd", "response_code"], "version": 2}, f)
    assert read_config(spark, p)["version"] == 2
