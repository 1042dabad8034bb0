"""The lines of an order travel once, and rows do not travel to meet a small encoder."""

import datetime as dt

from pyspark.sql import functions as F

from rebound.operators import features as FE
from rebound.plans import fixture as fx


def tables(spark, folder):
    """Orders whose key comes twice, is null or has no lines; lines of equal rank, null fields or a date before the order's."""
    day = lambda k: dt.datetime(2020, 1, 1) + dt.timedelta(days=k)
    orders = [(1, "F", day(0)), (1, "F", day(2)), (2, "F", day(5)), (2, "F", day(5)), (3, "O", day(0)), (None, "F", day(0)), (4, "F", None), (5, "F", day(1))]
    lines = [(1, 9, 1, 1, "A", "F", day(1)), (1, 9, 1, 1, "R", "F", day(1)), (1, 8, 1, 2, "A", "F", day(3)), (2, 1, 1, 1, None, "F", day(5)),
             (2, 1, 1, None, "A", "F", day(9)), (2, 2, 2, 1, "R", "O", day(4)), (3, 1, 1, 1, "A", "F", day(9)), (None, 1, 1, 1, "A", "F", day(9)), (4, 1, 1, 1, "A", "F", day(9))]
    spark.createDataFrame(orders, "o_orderkey long, o_orderstatus string, o_orderdate timestamp").write.parquet(f"{folder}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, "
                                 "l_shipdate timestamp").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def shuffles(df):
    return str(df._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning")


def test_lines_are_shuffled_once(spark, tmp_path):
    sf = tables(spark, tmp_path / "t")
    assert [shuffles(f(spark, sf)) for f in (fx.retry_summary, fx.retry_cells, fx.retries)] == [2, 2, 2]


def test_summary_and_cells_of_awkward_rows(spark, tmp_path):
    sf = tables(spark, tmp_path / "t")
    got = {r[0]: tuple(r)[1:] for r in fx.retry_summary(spark, sf).collect()}
    # order 1 has dates 0 and 2: the lines of day 1 count for the first, the line of day 3 for both
    assert got == {1: (4, 2, True, "APPROVED", 1, 24.0, 1, 24.0), 2: (4, 1, True, "APPROVED", None, 96.0, None, 96.0)}
    cells = fx.retry_cells(spark, sf).groupBy("original_transaction_id", "retry_attempt_num", "auth_status", "hours_since_original").agg(F.sum("weight"))
    assert {tuple(r) for r in cells.collect()} == {(1, 1, "APPROVED", 24.0, 1), (1, 1, "DECLINED", 24.0, 1), (1, 2, "APPROVED", 72.0, 1), (1, 2, "APPROVED", 24.0, 1),
                                                   (2, 1, "DECLINED", 0.0, 2), (2, None, "APPROVED", 96.0, 2)}


def test_rows_stay_where_they_are_for_a_small_encoder(spark):
    rows = spark.createDataFrame([(i, "abc"[i % 3], i % 2) for i in range(60)], "id long, c string, y int")
    out = FE.apply_target_encoding(rows, *(x for x in FE.fit_target_encoding(rows, ["c"], "y")[:1]), ["c"], 0.25)
    assert shuffles(out) == 0 and out.where("c__target_encoded = 0.25").count() == 0
    unseen = spark.createDataFrame([(1, "z"), (2, None)], "id long, c string")
    enc, _ = FE.fit_target_encoding(rows, ["c"], "y")
    assert [r[0] for r in FE.apply_target_encoding(unseen, enc, ["c"], 0.25).select("c__target_encoded").collect()] == [0.25, 0.25]
