"""Driver table scans.

Only the needed columns are selected, so the Parquet scan's ReadSchema is
pruned to them; filters applied downstream reach PushedFilters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
               "o_orderdate", "o_orderpriority"]
CUSTOMER_COLS = ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"]
LINEITEM_COLS = ["l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus",
                 "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str,
          columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.select(*columns) if columns else df


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", ORDERS_COLS)


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer", CUSTOMER_COLS)


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem", LINEITEM_COLS)
