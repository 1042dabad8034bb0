"""Bindings: the driver's TPC-H-style tables seen as payment data.

The operators are written against column roles (transaction_id, timestamp,
amount_usd, response_code, ...).  These views supply the roles from the
fixture tables; ``rebound.plans.sqlbase`` holds the same definitions in SQL.

declines  orders with o_orderstatus = 'F', joined to customer/nation/region
retries   lineitem rows of a declined order shipped on/after the order date
approved  orders with status O or P (approved originals)
events    one row per event; key = user_id ('error' = declined, 'purchase' = approved)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rebound.operators.chains import merge_retry_partials, retry_partials
from rebound.sources.tables import ntz_to_timestamp, read_table, table_path

# FIXED VALUES: order priority digit -> response code of the decline.
PRIORITY_CODES = {"1": "51", "2": "91", "3": "05", "4": "54", "5": "61"}

DECLINE_COLUMNS = ["transaction_id", "timestamp", "merchant_id", "merchant_vertical",
                   "merchant_country", "processor_name", "amount_usd", "response_code",
                   "is_soft_decline"]


def priority_code(priority: Column) -> Column:
    digit = F.substring(priority, 1, 1)
    expr = None
    for k, v in PRIORITY_CODES.items():
        expr = (F.when(digit == k, F.lit(v)) if expr is None else expr.when(digit == k, F.lit(v)))
    return expr


def _geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> (merchant vertical, country, processor).

    nation (25 rows) and region (5 rows) have a fixed size by definition of
    the schema, so broadcasting them is bounded; customer grows with the data
    and is left to AQE (it broadcasts only below the measured threshold).
    """
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = read_table(spark, sf_dir, "region", ["r_regionkey", "r_name"])
    return (customer
            .join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey, "left")
            .join(F.broadcast(region), nation.n_regionkey == region.r_regionkey, "left")
            .select("c_custkey", F.col("c_mktsegment").alias("merchant_vertical"),
                    F.col("n_name").alias("merchant_country"),
                    F.col("r_name").alias("processor_name")))


def originals(spark: SparkSession, sf_dir: str, statuses=("F", "O", "P"), date_range=None) -> DataFrame:
    """Original attempts (declined and approved) with all decline roles.

    Status and date filters are applied to the raw columns before the
    timestamp adapter, so both reach the Parquet scan as pushed filters.
    """
    orders = spark.read.parquet(table_path(sf_dir, "orders")).select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    if tuple(statuses) != ("F", "O", "P"):
        orders = orders.where(F.col("o_orderstatus").isin(*statuses))
    if date_range is not None:
        start, end = date_range
        dtype = orders.schema["o_orderdate"].dataType.simpleString()
        orders = orders.where((F.col("o_orderdate") >= F.lit(start).cast(dtype))
                              & (F.col("o_orderdate") < F.lit(end).cast(dtype)))
    orders = ntz_to_timestamp(orders)
    geo = _geo(spark, sf_dir)
    declined = F.col("o_orderstatus") == "F"
    code = priority_code(F.col("o_orderpriority"))
    return (orders.join(geo, orders.o_custkey == geo.c_custkey, "left")
            .select(F.col("o_orderkey").alias("transaction_id"),
                    F.col("o_orderdate").alias("timestamp"),
                    F.col("o_custkey").alias("merchant_id"),
                    "merchant_vertical", "merchant_country", "processor_name",
                    (F.col("o_totalprice") / F.lit(100)).alias("amount_usd"),
                    F.when(declined, code).otherwise(F.lit("00")).alias("response_code"),
                    (declined & (code != "54")).alias("is_soft_decline"),
                    F.when(declined, F.lit("DECLINED")).otherwise(F.lit("APPROVED")).alias("auth_status"),
                    F.lit(False).alias("is_retry")))


def declines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per original decline (the filter reaches the orders scan)."""
    return originals(spark, sf_dir, statuses=("F",)).select(*DECLINE_COLUMNS)


def decline_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(transaction_id, response_code) of the declines, from the orders alone."""
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"])
    return orders.where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("transaction_id"), priority_code(F.col("o_orderpriority")).alias("response_code"))


def declines_between(spark: SparkSession, sf_dir: str, start, end) -> DataFrame:
    """Declines of a date range [start, end) for batch scoring.  The range
    is applied to the raw order date, so it reaches the Parquet scan as a
    pushed filter (and prunes partitions when the table is date-partitioned)."""
    return originals(spark, sf_dir, statuses=("F",), date_range=(start, end)).select(*DECLINE_COLUMNS)


def _declined_order_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (read_table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_orderdate"])
            .where(F.col("o_orderstatus") == "F")
            .select("o_orderkey", "o_orderdate"))


def _retry_status(returnflag: Column, linestatus: Column) -> Column:
    return F.when((returnflag == "A") & (linestatus == "F"), F.lit("APPROVED")).otherwise(F.lit("DECLINED"))


def _hours_between(later: Column, earlier: Column) -> Column:
    return (F.unix_seconds(later) - F.unix_seconds(earlier)) / F.lit(3600.0)


def _declined_lines(spark: SparkSession, sf_dir: str, columns=()) -> DataFrame:
    """Lines of declined orders shipped on/after the order date: (link, attempt, status, ship date, hours, ``columns``).

    The lines are cut to fixed-size columns and travel once, to their orders;
    the summaries are built where they then lie.  The merge join keeps it so at
    every size: with the dates broadcast while they are few, the work would
    change its growth later.  A hot order is split by the skew join.
    """
    li = read_table(spark, sf_dir, "lineitem",
                    ["l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate", *columns])
    approved = _retry_status(F.col("l_returnflag"), F.col("l_linestatus")) == "APPROVED"
    li = li.select("l_orderkey", "l_linenumber", approved.alias("approved"), "l_shipdate", *columns)
    od = _declined_order_dates(spark, sf_dir).hint("merge")
    return (li.join(od, li.l_orderkey == od.o_orderkey)
            .where(F.col("l_shipdate") >= F.col("o_orderdate"))
            .select(F.col("l_orderkey").alias("original_transaction_id"),
                    F.col("l_linenumber").alias("retry_attempt_num"),
                    F.when(F.col("approved"), F.lit("APPROVED")).otherwise(F.lit("DECLINED")).alias("auth_status"),
                    F.col("l_shipdate").alias("ship"),
                    _hours_between(F.col("l_shipdate"), F.col("o_orderdate")).alias("hours"), *columns))


def retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-level retry attempts (used where single retries are needed)."""
    return _declined_lines(spark, sf_dir, ["l_partkey", "l_suppkey"]).select(
        "original_transaction_id", "retry_attempt_num", "auth_status", F.col("hours").alias("hours_since_original"),
        F.col("ship").alias("timestamp"), F.col("l_partkey").alias("retry_tb1"), F.col("l_suppkey").alias("retry_tb2"))


RETRY_ORDER = ["retry_attempt_num", "hours_since_original", "retry_tb1", "retry_tb2"]


def retry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-decline retry summary, aggregated *before* the join to the declines.

    Partials per (order, ship date, hours), merged per order; both lie where the
    lines of an order already are, so neither is shuffled again.
    """
    rows = (_declined_lines(spark, sf_dir, ["l_partkey", "l_suppkey"])
            .withColumnsRenamed({"l_partkey": "retry_tb1", "l_suppkey": "retry_tb2"}))
    partial = retry_partials(rows, ["original_transaction_id", "ship", "hours"],
                             order_cols=["retry_attempt_num", "retry_tb1", "retry_tb2"])
    return merge_retry_partials(partial, "original_transaction_id", hours_col="hours")


def events(spark: SparkSession, sf_dir: str, columns=None) -> DataFrame:
    return read_table(spark, sf_dir, "events", columns)


def retry_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retries aggregated per (order, delay, attempt, status) with a row-count
    ``weight``: enough for every per-(code, attempt, delay) rate."""
    keys = ["original_transaction_id", "retry_attempt_num", "auth_status", "hours"]
    return (_declined_lines(spark, sf_dir).groupBy(*keys).agg(F.count(F.lit(1)).alias("weight"))
            .select(*keys[:3], "weight", F.col("hours").alias("hours_since_original")))
