"""Force many narrowing passes and many prefix buckets on fixture data and
require the same results as with the default settings."""
import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID
from rebound.operators import metrics, ordered
from rebound.plans.q_labels import build_modeling
from rebound.sources import read_table


def test_split_equals_sorting(spark):
    m = build_modeling(spark, SF_MID)
    rows = sorted((r["timestamp"], r["transaction_id"]) for r in m.select("timestamp", "transaction_id").collect())
    n = len(rows)
    want = {i: "train" if k < int(n * 0.7) else "validation" if k < int(n * 0.85) else "test" for k, (_, i) in enumerate(rows)}
    assert {r["transaction_id"]: r["split"] for r in metrics.temporal_split(m).collect()} == want and n == 4933


def test_order_statistics_of_groups_nulls_and_ties(spark):
    rows = [(g, float(v % 5 if g == "tied" else v)) for g in ("a", "tied", None) for v in range(700)] + [("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    ranks = {(g,): [0, 1, 350, 698, 699, 700] for g in ("a", "tied", None)}
    for fanout in (2, 16, 512):
        got = ordered.order_statistics(df, "v", ranks, ["g"], fanout=fanout)
        for g in ("a", "tied", None):
            vals = sorted(v for k, v in rows if k == g and v is not None and v == v)
            assert [got[(g,), k] for k in ranks[(g,)]] == [vals[k] if k < 700 else None for k in ranks[(g,)]]


def test_quantiles_narrowing_match_duckdb(spark):
    li = read_table(spark, SF_MID, "lineitem", ["l_returnflag", "l_extendedprice", "l_quantity"])
    qs = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = ordered.exact_quantiles(li, "l_extendedprice", qs, ["l_returnflag"], fanout=8)
    con = duckdb.connect()
    for (flag,), vals in got.items():
        exp = con.execute(f"SELECT quantile_cont(l_extendedprice, {qs}) FROM read_parquet('{SF_MID}/lineitem.parquet') "
                          f"WHERE l_returnflag = '{flag}'").fetchone()[0]
        assert vals == pytest.approx(exp, rel=1e-12)
    # a heavily tied column resolves by equality counts, never collecting the tie
    q = ordered.exact_quantiles(li, "l_quantity", [0.5], fanout=4)[()]
    exp = con.execute(f"SELECT quantile_cont(l_quantity, 0.5) FROM read_parquet('{SF_MID}/lineitem.parquet')").fetchone()[0]
    assert q[0] == exp


def test_top_k_equals_sorting(spark):
    li = read_table(spark, SF_MID, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    counts = li.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).withColumn("neg", -F.col("n")) \
        .withColumn("g", F.lit(1))
    top = ordered.top_k_per_group(counts, ["g"], ["neg", "l_partkey"], 25)
    got = sorted((r["neg"], r["l_partkey"]) for r in top.collect())
    exp = sorted((r["neg"], r["l_partkey"]) for r in counts.collect())[:25]
    assert got == exp


def test_prefix_sums_many_buckets(spark):
    li = read_table(spark, SF_MID, "lineitem", ["l_returnflag", "l_extendedprice"])
    coll = li.groupBy("l_returnflag", "l_extendedprice").agg(F.count(F.lit(1)).alias("c"))
    many = ordered.prefix_sums(coll, "l_extendedprice", ["c"], ["l_returnflag"], buckets=200)
    one = ordered.prefix_sums(coll, "l_extendedprice", ["c"], ["l_returnflag"], buckets=1)
    key = lambda df: sorted((r["l_returnflag"], r["l_extendedprice"], r["c_before"]) for r in df.collect())
    assert key(many) == key(one)
